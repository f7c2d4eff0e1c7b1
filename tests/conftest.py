import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from quarry import session

    found = session.build(
        "tests", master=f"local[{os.environ.get('TEST_CPUS', '4')}]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g"
    )
    found.sparkContext.setLogLevel("ERROR")
    session.ship(found)
    yield found
    found.stop()
