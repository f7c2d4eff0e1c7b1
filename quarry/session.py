"""Session builder and small helpers that every operator shares."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def build(app: str = "quarry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver was started from."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder that all executors see: the cluster's (``spark.checkpoint.dir``), or a temporary one where the master is local.

    On a cluster without that setting there is none, and this fails: a folder of one machine would lose data in silence.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix=f"quarry-{name}-")
    atexit.register(shutil.rmtree, folder, True)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's folder (see ``shared_folder``).

    Spark's cleaner deletes it when its data frame is no longer referenced, if ``spark.cleaner.referenceTracking.cleanCheckpoints``
    is set, as ``build`` does.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession, "checkpoint"))
    return df.checkpoint(eager=True)


def free(*frames: DataFrame) -> None:
    """Drop what was cached of these frames."""
    for df in frames:
        df.unpersist()


@contextmanager
def duration(label: str = "Duration", say: Callable[[str], None] = print) -> Iterator[None]:
    """Say how many seconds the block took, even if it fails."""
    began = time.monotonic()
    try:
        yield
    finally:
        say(f"{label}: {time.monotonic() - began:.2f}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
