import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, component long, row string"


def sentence(rng: random.Random, words: list[str], n: int) -> str:
    return " ".join(rng.choice(words) for _ in range(n)) + "."


VOCABULARY = {
    "en": "the of and thing water other people word again light house found under which there their about would these".split(),
    "de": "der die und haus wasser andere leute wort wieder licht gefunden unter welche dort ihre würde diese straße zwischen über".split(),
}


def corpus() -> list[tuple]:
    """Documents of two languages with nulls, empty and long texts, repeated rows, near copies and names that clash."""
    rng = random.Random(5)
    rows: list[tuple] = []
    for i in range(120):
        lang = "en" if i % 3 else "de"
        text = "\n".join(sentence(rng, VOCABULARY[lang], rng.randint(15, 40)) for _ in range(4))
        rows.append([i, text, lang])
    rows.append([200, rows[0][1], "de"])
    rows.append([201, rows[0][1], "de"])
    rows.append([202, rows[0][1] + " haus", "de"])  # a near copy
    rows.append([203, None, "en"])
    rows.append([204, "", None])
    rows.append([205, "  \n\t\n", "en"])
    rows.append([206, "1234 %% 99", "en"])
    rows.append([207, "one two", "en"])
    rows.append([208, "ONE  two", "en"])
    rows.append([209, " ".join(rng.choice(VOCABULARY["en"]) for _ in range(30_000)), "en"])
    rows.append([210, "x" * 50_000, "en"])
    rows.append([1, rows[1][1], "en"])  # a repeated row
    rows.append([None, rows[2][1], "en"])
    rows.append([None, None, None])
    return [(i, t, lang, "s", len(t or ""), 7, 8, "clash") for i, t, lang in rows]


@pytest.fixture(scope="session")
def docs(spark):
    found = spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()
    return found


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
