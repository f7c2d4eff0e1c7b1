"""Quality rules with built-in functions only: base counts, and divergence from language references.

The histogram of a document's character classes and that of its common words are compared with its language's
references by Jensen-Shannon distance (square root of the divergence in bits, 0 to 1). References are taken over
all documents of the language: the share of each class in all characters, and the shares of the ``COMMON`` commonest
words and of all others in all words. Documents with fewer words or characters than the guards are not judged by
divergence, nor are those whose language is null or has no words.

Words are ``[^\\x20\\x09-\\x0D]+``. Defined results: a null or empty text has no words, all counts 0, fails the base
rule and isn't kept; ties among common words go to the first by name; repeated rows are judged each; an empty table
gives no rows; long texts are measured whole; ``kept`` passes other columns through, whatever their names. Three-word windows are
compared by a 64-bit hash within a text: of a text with n windows, one is taken for another by chance in n*n / 2**65 texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import cut

COMMON = 32
CODES = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
MOST_CLASS_DISTANCE, MOST_WORD_DISTANCE = 0.25, 0.5
LEAST_CHARACTERS, LEAST_WORDS = 200, 50
#: References of at most so many languages are broadcast; more are joined by a shuffle.
BROADCAST_LANGUAGES = 256
SPACE = r"[\x20\x09-\x0D]"
#: Character classes; what is in none of them is the last class.
SPACES = 3
CLASSES = [r"\p{Ll}+", r"\p{Lu}+", r"\p{Nd}+", r"[\x20\x09-\x0D]+", r"\p{P}+", r"\p{S}+"]


def words(text: Column) -> Column:
    trimmed = F.trim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE + "+")).otherwise(F.array().cast("array<string>"))


def shorter_by(text: Column, pattern: str) -> Column:
    """Characters of ``text`` in matches of ``pattern``."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def repeat_words(words: Column, n: Column, windows: Column) -> Column:
    """Words in three-word windows found twice or more; ``windows``: sorted structs of hash and place."""
    near = F.transform(
        windows,
        lambda x, i: F.when(
            (F.get(windows, i - 1)["h"] == x["h"]) | (F.get(windows, i + 1)["h"] == x["h"]), x["i"]
        ),
    )
    places = F.filter(near, lambda p: p.isNotNull())
    covered = F.flatten(F.transform(places, lambda p: F.array(p, p + 1, p + 2)))
    return F.size(F.array_distinct(covered)).cast("long")


def with_counts(docs: DataFrame) -> DataFrame:
    """Add the struct ``_m`` of base counts, ``_words`` and ``_classes`` to every row; other columns stay."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.withColumn("_text", text).withColumn("_words", words(F.col("_text")))
    split = split.withColumn("_classes", classes(F.col("_text")))
    n = F.size("_words")
    w = F.col("_words")
    # the places of windows: all but the last two words
    hashed = F.transform(
        F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
    )
    split = split.withColumn("_windows", F.sort_array(hashed))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.length(F.trim(x, F.lit(" \t\n\x0b\f\r"))) > 0)
    split = split.withColumn("_lines", lines)
    counts = F.struct(
        n.cast("long").alias("n_words"),
        (F.length("_text") - F.col("_classes")[SPACES]).cast("long").alias("word_chars"),
        shorter_by(F.col("_text"), r"[#*$%&|<>]+").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(w, n, F.col("_windows")).alias("n_repeat_words"),
    )
    return split.withColumn("_m", counts).drop("_windows", "_lines")


def classes(text: Column) -> Column:
    found = [shorter_by(text, c) for c in CLASSES]
    rest = F.length(text).cast("long")
    for c in found:
        rest = rest - c
    return F.array(*found, rest)


def common_words(docs: DataFrame) -> DataFrame:
    """``_lang, _common array<string>, _word_share array<double>, _longest`` of each language, over all documents."""
    text = F.coalesce(F.col("text"), F.lit(""))
    known = docs.where(F.col("lang").isNotNull()).select(F.col("lang").alias("_lang"), text.alias("_text"))
    counted = known.select("_lang", F.explode(words(F.col("_text"))).alias("word")).groupBy("_lang", "word").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("_lang").orderBy(F.desc("n"), "word")
    counted = cut(counted)
    sums = counted.groupBy("_lang").agg(F.sum("n").alias("_all"))
    top = counted.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= COMMON)
    top = top.groupBy("_lang").agg(F.sort_array(F.collect_list(F.struct("_at", "word", "n"))).alias("_top"))
    return top.join(sums, "_lang").select(
        "_lang",
        F.transform("_top", lambda x: x["word"]).alias("_common"),
        F.concat(
            F.array((F.col("_all") - F.aggregate("_top", F.lit(0).cast("long"), lambda s, x: s + x["n"])) / F.col("_all")),
            F.transform("_top", lambda x: x["n"] / F.col("_all")),
        ).alias("_word_share"),
        F.array_max(F.transform("_top", lambda x: F.octet_length(x["word"]))).alias("_longest"),
    )


def class_shares(classed: DataFrame) -> DataFrame:
    """``_lang, _class_share array<double>`` from ``lang, _classes`` of all documents."""
    summed = classed.where(F.col("lang").isNotNull()).groupBy(F.col("lang").alias("_lang")).agg(
        *[F.sum(F.col("_classes")[i]).alias(f"c{i}") for i in range(len(CLASSES) + 1)]
    )
    every = sum((F.col(f"c{i}") for i in range(1, len(CLASSES) + 1)), F.col("c0"))
    return summed.select("_lang", F.array(*[F.try_divide(F.col(f"c{i}"), every) for i in range(len(CLASSES) + 1)]).alias("_class_share"))


def small_side(references: DataFrame) -> DataFrame:
    """Checkpointed, and marked for broadcast if the number of its languages allows it."""
    references = cut(references)
    few = references.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES
    return F.broadcast(references) if few else references


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""

    def part(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))


def measured(docs: DataFrame) -> DataFrame:
    """Add ``_m`` (base counts), ``_classes``, ``_length`` and ``_word_distance`` to every row.

    ``_barrier`` is there for filters above: one that uses it can't be pushed below, where it would repeat every count.
    """
    common = small_side(common_words(docs))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = with_counts(docs).join(common, F.col("lang") == F.col("_lang"), "left")
    # words longer than every common word need no look-up
    place = lambda w: F.array_position(F.col("_common"), w).cast("int")
    code = F.transform(
        "_words",
        lambda w: F.when(F.octet_length(w) <= F.col("_longest"), F.substring(F.lit(CODES), place(w) + 1, F.lit(1))).otherwise(F.lit(CODES[0])),
    )
    rows = rows.withColumn("_codes", F.array_join(code, "")).drop("_words")
    n = F.col("_m.n_words")
    found = [F.length("_codes") - F.length(F.replace("_codes", F.lit(c), F.lit(""))) for c in CODES[: COMMON + 1]]
    share = F.slice(F.transform(F.array(*found), lambda c: F.try_divide(c, n)), F.lit(1), F.size("_word_share"))
    far = F.when((n >= LEAST_WORDS) & F.col("_lang").isNotNull(), distance(share, F.col("_word_share")))
    return rows.select(*columns, "_m", "_classes", F.length("_text").alias("_length"), far.alias("_word_distance"), F.monotonically_increasing_id().alias("_barrier"))


def verdicts(rows: DataFrame, shares: DataFrame) -> DataFrame:
    """Add ``_class_distance``, ``_base_failed`` and ``_kept`` to measured rows."""
    columns = [F.col(f"`{c}`") for c in rows.columns]
    rows = rows.join(small_side(shares), F.col("lang") == F.col("_lang"), "left")
    n = F.col("_m.n_words")
    class_share = F.transform("_classes", lambda c: F.try_divide(c, F.col("_length")))
    far = F.when((F.col("_length") >= LEAST_CHARACTERS) & F.col("_lang").isNotNull(), distance(class_share, F.col("_class_share")))
    rows = rows.select(*columns, far.alias("_class_distance"))
    failed = (n < 50) | (100 * F.col("_m.n_repeat_words") > 50 * n)
    near = (F.coalesce("_word_distance", F.lit(0.0)) <= MOST_WORD_DISTANCE) & (F.coalesce("_class_distance", F.lit(0.0)) <= MOST_CLASS_DISTANCE)
    return rows.withColumn("_base_failed", failed).withColumn("_kept", ~failed & near)


def judge(docs: DataFrame) -> DataFrame:
    """Every row of ``text, lang`` and any columns without a leading underscore, with ``_m`` (base counts), ``_word_distance``,
    ``_class_distance``, ``_base_failed`` and ``_kept``; whole rows pass through, so the classes are counted once for the references and once with the rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    shares = class_shares(docs.select("lang", classes(text).alias("_classes")))
    return verdicts(measured(docs), shares).drop("_classes", "_length")


def kept(docs: DataFrame) -> DataFrame:
    """The rows that pass, whole; they travel as one struct, so no column's name can clash."""
    rows = docs.select("text", "lang", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return judge(rows).where(F.col("_kept") & (F.col("_barrier") >= 0)).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def assess(docs: DataFrame) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed`` and ``kept`` of every document: texts are measured once."""
    rows = cut(measured(docs.select("doc_id", "text", "lang")).drop("text"))
    return verdicts(rows, class_shares(rows)).select(
        "doc_id",
        "_m.*",
        F.col("_base_failed").alias("base_failed"),
        F.col("_kept").alias("kept"),
        F.round("_class_distance", 6).alias("class_distance"),
        F.round("_word_distance", 6).alias("word_distance"),
    )
