"""Language identification by compression with one dictionary a language.

The letters of the whole text, in lower case and with a single space for all between them, are compressed with each
language's dictionary; the smallest size wins. ``margin`` is the second smallest size less the smallest, for each
byte compressed; a text whose margin is under ``least_margin`` is ``rejected``. ``score`` is the winner's share when
each size counts as a code length, tempered by ``TEMPER`` bytes.

Defined results: null texts and texts without a letter are ``und`` with score 0, margin 0 and rejected; ties go to
the language with most labelled rows, then to the first by name, with margin 0, so they are rejected; without any
labelled row every text is ``und``. Long texts count whole, piece by piece. Rows keep their multiplicity; an empty table gives no
rows; columns beside id and text, whatever their names, are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.batches import in_batches, release, tidy
from quarry.llm.compression import compressor, dictionary, labelled_sample, sizes

#: Below this many bytes of margin for each byte of letters, the language stays open.
LEAST_MARGIN = 0.002
TEMPER = 4.0
GAPS = re.compile(r"[\W\d_]+")
LETTER = regex.compile(r"\p{L}")
PLAIN = re.compile("[A-Za-z]")

Model = list[tuple[str, bytes]]


def letters(text: str) -> bytes:
    return GAPS.sub(" ", text.lower()).encode()


def fit(docs: DataFrame, labelled: DataFrame) -> Model:
    """One dictionary a language, commonest language first, from a bounded sample (see ``compression``)."""
    counts = {r[0]: r[1] for r in labelled.where(F.col("lang").isNotNull()).groupBy("lang").count().collect()}
    texts: dict[str, list[str]] = {}
    for _, text, lang in labelled_sample(docs, labelled, "doc_id", "lang"):
        texts.setdefault(lang, []).append(letters(text).decode())
    return [(lang, dictionary(texts[lang])) for lang in sorted(texts, key=lambda x: (-counts[x], x))]


def predict(docs: DataFrame, model: Model, least_margin: float = LEAST_MARGIN) -> DataFrame:
    """``doc_id, lang_pred, score, margin, rejected`` of every whole text."""
    langs = [lang for lang, _ in model]

    def one(text: str | None, compressors: list) -> tuple[str, float, float, bool]:
        if not text or not langs or not (PLAIN.search(text) or LETTER.search(text)):
            return "und", 0.0, 0.0, True
        data = letters(text)
        size = sizes(data, compressors)
        best = min(range(len(size)), key=lambda i: (size[i], i))
        score = 1 / sum(math.exp((size[best] - s) / TEMPER) for s in size)
        rest = [s for i, s in enumerate(size) if i != best]
        margin = (min(rest) - size[best]) / len(data) if rest else 1.0
        return langs[best], score, margin, margin < least_margin

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = [compressor(content) for _, content in model]
        for batch in batches:
            rows = [one(text, compressors) for text in batch.column(1).to_pylist()]
            lang, score, margin, rejected = map(list, zip(*rows, strict=True)) if rows else ([], [], [], [])
            columns = [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())]
            columns += [pa.array(margin, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "margin", "rejected"])

    schema = "doc_id long, lang_pred string, score double, margin double, rejected boolean"
    return in_batches(docs.select("doc_id", "text")).mapInArrow(tidy(run), schema)


def fold(key: str, parts: int) -> F.Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(key).cast("string")) % parts


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the rows whose fold of three is not 1, predict all rows; ``held_out`` marks fold 1."""
    model = fit(docs, docs.where(fold("doc_id", 3) != 1).select("doc_id", "lang"))
    return predict(docs, model).select(
        "doc_id",
        F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
        "margin",
        "rejected",
    )


def keep_identified(docs: DataFrame, least_margin: float = LEAST_MARGIN) -> DataFrame:
    """The documents whose language is found, all columns kept and ``lang`` as labelled.

    The prediction runs beside each row, so that repeated or null ids need no join back; only texts go to Python.
    """
    model = fit(docs, docs.select("doc_id", "lang"))

    def good(text: str | None, compressors: list) -> bool:
        if not (text and compressors and (PLAIN.search(text) or LETTER.search(text))):
            return False
        data = letters(text)
        size = sorted(sizes(data, compressors))
        return len(size) < 2 or (size[1] - size[0]) / len(data) >= least_margin

    @F.arrow_udf("boolean")
    def identified(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compressors = [compressor(content) for _, content in model]
        for texts in batches:
            yield pa.array([good(text, compressors) for text in texts.to_pylist()], pa.bool_())
        del compressors
        release()

    return in_batches(docs).where(identified("text"))
