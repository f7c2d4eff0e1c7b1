"""Registered queries of the engine's own operators, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import cluster, correlate, graph, itemsets, profiles, recommend, relational, similarity, sketch
from quarry.plans import bfr as bfr_plan
from quarry.plans import girvan_newman as gn_plan
from quarry.session import cut, shared_folder, table
from quarry.sources import sinks, views
from quarry.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

STOP = ["the", "of", "and", "de", "la", "der", "die", "el", "a", "in"]
SUPPORT = 0.0035

RATINGS = """ratings AS (SELECT event_id, user_id AS "user", CAST(json_extract_string(props, '$.k') AS BIGINT) AS item,
 CAST(1 + CAST(floor(value) AS BIGINT) % 5 AS BIGINT) AS stars FROM events)"""
MEANS = RATINGS + """, means AS (SELECT "user", item, avg(stars) AS rating FROM ratings GROUP BY 1, 2)"""
TRAIN = RATINGS + """, train AS (SELECT * FROM ratings WHERE event_id % 10 <> 0 AND item < 95),
 means AS (SELECT "user", item, avg(stars) AS rating FROM train GROUP BY 1, 2),
 test AS (SELECT event_id, "user", item FROM ratings WHERE event_id % 10 = 0)"""
BASKETS = "baskets AS (SELECT DISTINCT l_orderkey AS basket, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey)"
TOKENS = r"""tokens AS (SELECT doc_id AS doc, source, unnest(list_filter(regexp_split_to_array(lower(text), '[(\[,.!?:;\]) ]+'), lambda t: t <> '')) AS word FROM documents)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def support_of(baskets: DataFrame) -> int:
    import math

    n = itemsets.baskets_in(baskets) if "w" in baskets.columns else baskets.select("basket").distinct().count()
    return max(1, math.ceil(SUPPORT * n))


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = views.ratings(spark, sf_dir).where((F.col("event_id") % 10 != 0) & (F.col("item") < 95))
    return views.mean_ratings(rated)


def test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.ratings(spark, sf_dir).where(F.col("event_id") % 10 == 0).select("event_id", "user", "item")


# --- relational -------------------------------------------------------------------------------------------------


@query("review_totals", "SELECT count(*) AS n_total, count(*) FILTER (WHERE substr(CAST(ts AS VARCHAR), 1, 7) = '2024-01') AS n_year, count(DISTINCT user_id) AS n_users FROM events")
def review_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return relational.totals(rows, "user_id", F.date_format("ts", "yyyy-MM") == "2024-01")


@query("top_users", "SELECT user_id, count(*) AS n_reviews FROM events GROUP BY user_id ORDER BY n_reviews DESC, user_id LIMIT 10")
def top_users(spark, sf_dir):
    return relational.top_counts(table(spark, sf_dir, "events"), "user_id", 10, "n_reviews")


@query("top_words", f"WITH {TOKENS} SELECT word, count(*) AS n_words FROM tokens WHERE word NOT IN ({', '.join(repr(w) for w in STOP)}) GROUP BY word ORDER BY n_words DESC, word LIMIT 20")
def top_words(spark, sf_dir):
    stop = spark.createDataFrame([(w,) for w in STOP], "word string")
    return relational.top_words(views.tokens(spark, sf_dir).select("word"), F.broadcast(stop), 20)


def _words_b_sql() -> str:
    pattern = X.PUNCTUATION_AND_DIGITS.replace("'", "''")
    return f"""WITH words AS (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '{pattern}'), lambda t: t <> '')) AS word FROM documents)
 SELECT word, count(*) AS n_words FROM words WHERE word NOT IN ({', '.join(repr(w) for w in STOP)}) GROUP BY word ORDER BY n_words DESC, word LIMIT 50"""


@query("top_words_of_profiles", _words_b_sql())
def top_words_of_profiles(spark, sf_dir):
    stop = spark.createDataFrame([(w,) for w in STOP], "word string")
    words = table(spark, sf_dir, "documents").select(F.explode(X.tokens(F.col("text"), X.PUNCTUATION_AND_DIGITS)).alias("word"))
    return relational.top_words(words, F.broadcast(stop), 50)


def _category(spark, sf_dir, merge):
    scores = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_quantity").alias("score"))
    categories = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.split("p_type", " ").alias("categories"))
    return relational.category_average(scores, categories, 20, (3, 3), merge)


CATEGORY = """WITH m AS (SELECT l_partkey AS item, round(avg(l_quantity), 3) AS mean FROM lineitem GROUP BY 1),
 c AS (SELECT p_partkey AS item, unnest(string_split(p_type, ' ')) AS category FROM part)
 SELECT category, round(avg(mean), 3) AS stars FROM m JOIN c USING (item) GROUP BY 1 ORDER BY stars DESC, category LIMIT 20"""


@query("category_avg", CATEGORY)
def category_avg(spark, sf_dir):
    return _category(spark, sf_dir, False)


@query("category_avg_merge_join", CATEGORY)
def category_avg_merge_join(spark, sf_dir):
    return _category(spark, sf_dir, True)


@query("popular_items", f"WITH {RATINGS} SELECT item, count(*) AS n_reviews FROM ratings GROUP BY item HAVING count(*) > 9")
def popular_items(spark, sf_dir):
    return relational.popular(views.ratings(spark, sf_dir), "item", 9)


@query("partition_profile", f"WITH {RATINGS} SELECT item % 8 AS partition, count(*) AS n_items FROM ratings GROUP BY 1")
def partition_profile(spark, sf_dir):
    return relational.repartition_profile(views.ratings(spark, sf_dir), F.col("item"), 8)


@query("filtered_join_pairs", "SELECT o_orderkey, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def filtered_join_pairs(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    customer = table(spark, sf_dir, "customer")
    joined = relational.filtered_join(orders, customer, "c_custkey", F.col("c_mktsegment") == "BUILDING")
    return joined.select("o_orderkey", "c_custkey", "c_name")


@query("totals_document", """SELECT '{"n_total":' || count(*) || ',"n_users":' || count(DISTINCT user_id) || '}' AS value FROM events""")
def totals_document(spark, sf_dir):
    return sinks.json_document(review_totals(spark, sf_dir).select("n_total", "n_users"))


# --- itemsets ---------------------------------------------------------------------------------------------------

#: Every subset of every basket: baskets are small.
ITEMSETS = f"""WITH RECURSIVE {BASKETS}, s AS (SELECT ceil({SUPPORT} * count(DISTINCT basket)) AS support FROM baskets),
 subsets AS (SELECT basket, item AS items, item AS last, 1 AS size FROM baskets
  UNION ALL SELECT g.basket, g.items || ',' || b.item, b.item, size + 1 FROM subsets g JOIN baskets b ON b.basket = g.basket AND b.item > g.last)"""
ALL_ITEMSETS = ITEMSETS + """ SELECT items, CAST(count(*) AS BIGINT) AS n FROM subsets, s GROUP BY items, support HAVING count(*) >= support"""
PAIRS = ITEMSETS + " SELECT items, CAST(count(*) AS BIGINT) AS n FROM subsets, s WHERE size = 2 GROUP BY items, support HAVING count(*) >= support"


def _named(found: DataFrame) -> DataFrame:
    return found.select(F.array_join("items", ",").alias("items"), "n")


@query("baskets", f"WITH {BASKETS} SELECT basket, string_agg(item, ',' ORDER BY item) AS items FROM baskets GROUP BY 1")
def basket_lists(spark, sf_dir):
    return itemsets.basket_items(views.baskets(spark, sf_dir)).select("basket", F.array_join("items", ",").alias("items"))


def _gathered(spark, sf_dir, part=None):
    return itemsets.gathered(views.basket_lines(spark, sf_dir), part)


@query("frequent_pairs", PAIRS)
def frequent_pairs(spark, sf_dir):
    baskets = _gathered(spark, sf_dir)
    return _named(itemsets.apriori(baskets, support_of(baskets), 2).where(F.size("items") == 2))


@query("frequent_itemsets_apriori", ALL_ITEMSETS)
def frequent_itemsets_apriori(spark, sf_dir):
    baskets = _gathered(spark, sf_dir)
    return _named(itemsets.apriori(baskets, support_of(baskets)))


@query("frequent_itemsets_fpgrowth", ALL_ITEMSETS)
def frequent_itemsets_fpgrowth(spark, sf_dir):
    baskets = _gathered(spark, sf_dir)
    return _named(itemsets.fpgrowth(baskets, support_of(baskets)))


@query("frequent_itemsets_two_pass", ALL_ITEMSETS)
def frequent_itemsets_two_pass(spark, sf_dir):
    baskets = _gathered(spark, sf_dir, F.pmod("basket", F.lit(4)))
    return _named(itemsets.two_pass(baskets, support_of(baskets)))


@query("son_candidates", ITEMSETS + """, sizes AS (SELECT basket % 4 AS part, count(DISTINCT basket) AS size FROM baskets GROUP BY 1),
 shares AS (SELECT part, greatest(1, ceil(support * size / (SELECT sum(size) FROM sizes))) AS least FROM sizes, s)
 SELECT DISTINCT items FROM (SELECT items, part, least FROM subsets JOIN shares ON part = basket % 4 GROUP BY items, part, least HAVING count(*) >= least)""")
def son_candidates(spark, sf_dir):
    baskets = _gathered(spark, sf_dir, F.pmod("basket", F.lit(4)))
    found = itemsets.partition_candidates(baskets, support_of(baskets))
    return found.select(F.array_join("items", ",").alias("items"))


@query("pcy_frequent_pairs", PAIRS)
def pcy_frequent_pairs(spark, sf_dir):
    baskets = _gathered(spark, sf_dir)
    return _named(itemsets.pcy_pairs(baskets, support_of(baskets), 6_000_000))


@query("large_basket_itemsets")
def large_basket_itemsets(spark, sf_dir):
    baskets = itemsets.larger_baskets(_gathered(spark, sf_dir), 4)
    return _named(itemsets.apriori(baskets, support_of(baskets)))


SQL["large_basket_itemsets"] = ALL_ITEMSETS.replace(
    "WITH RECURSIVE baskets AS", "WITH RECURSIVE every AS", 1
).replace(", s AS", ", baskets AS (SELECT * FROM every WHERE basket IN (SELECT basket FROM every GROUP BY 1 HAVING count(*) > 4)), s AS", 1)


@query("pcy_bucket_counts", f"""WITH {BASKETS}, codes AS (SELECT item, dense_rank() OVER (ORDER BY item) - 1 AS code FROM (SELECT DISTINCT item FROM baskets)),
 coded AS (SELECT basket, code FROM baskets JOIN codes USING (item))
 SELECT (a.code + b.code) % 250 AS bucket, count(*) AS n FROM coded a JOIN coded b ON a.basket = b.basket AND a.code < b.code GROUP BY 1""")
def pcy_bucket_counts(spark, sf_dir):
    baskets = cut(views.baskets(spark, sf_dir))
    coded = baskets.join(itemsets.dense_codes(baskets, "item"), "item")
    return itemsets.pair_buckets(coded, F.col("code"), 250)


# --- similarity -------------------------------------------------------------------------------------------------

MEMBERS = RATINGS + """, members AS (SELECT DISTINCT item, "user" FROM ratings), size AS (SELECT item, count(*) AS n FROM members GROUP BY 1),
 codes AS (SELECT "user", dense_rank() OVER (ORDER BY "user") - 1 AS code FROM (SELECT DISTINCT "user" FROM members)),
 m AS (SELECT count(*) AS m FROM codes)"""
SIGNATURE = MEMBERS + """, signature AS (SELECT item, CAST(c AS INTEGER) AS c, min((code + 113 * c) % m) AS low FROM members JOIN codes USING ("user"), m, range(160) r(c) GROUP BY 1, 2),
 banded AS (SELECT item, c // 4 AS band, (sum(low * 177 * (c % 4 + 1)) + 199) % 100 AS bucket FROM signature GROUP BY 1, 2),
 candidates AS (SELECT DISTINCT a.item AS a, b.item AS b FROM banded a JOIN banded b ON a.band = b.band AND a.bucket = b.bucket AND a.item < b.item)"""
JACCARD = """, shared AS (SELECT x.item AS a, y.item AS b, count(*) AS shared FROM members x JOIN members y ON x."user" = y."user" AND x.item < y.item GROUP BY 1, 2),
 jaccard AS (SELECT a, b, shared / (sa.n + sb.n - shared) AS s FROM shared JOIN size sa ON a = sa.item JOIN size sb ON b = sb.item)"""


def _signature(spark, sf_dir):
    members = cut(views.ratings(spark, sf_dir).select("item", "user").distinct())
    codes = cut(itemsets.dense_codes(members, "user"))
    modulus = codes.agg(F.count(F.lit(1)).alias("m"))
    return members, similarity.minhash(members.join(codes, "user"), "item", "code", modulus)


def _candidates(spark, sf_dir):
    members, signature = _signature(spark, sf_dir)
    return members, similarity.band_candidates(similarity.bands(signature, "item", 4, 177, 199, 100), "item")


@query("jaccard_pairs", "WITH " + MEMBERS + JACCARD + " SELECT a, b, round(s, 9) AS similarity FROM jaccard WHERE s >= 0.35")
def jaccard_pairs(spark, sf_dir):
    found = similarity.jaccard(views.ratings(spark, sf_dir), "item", "user", 0.35)
    return found.select("a", "b", F.round("similarity", 9).alias("similarity"))


@query("minhash_signature", "WITH " + SIGNATURE + " SELECT item, c, low FROM signature")
def minhash_signature(spark, sf_dir):
    return _signature(spark, sf_dir)[1]


@query("lsh_candidates", "WITH " + SIGNATURE + " SELECT a, b FROM candidates")
def lsh_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir)[1]


@query("lsh_similar_items", "WITH " + SIGNATURE + JACCARD + " SELECT a, b, round(s, 9) AS similarity FROM jaccard JOIN candidates USING (a, b) WHERE s >= 0.05")
def lsh_similar_items(spark, sf_dir):
    members, candidates = _candidates(spark, sf_dir)
    found = similarity.jaccard(members, "item", "user", 0.05, candidates, alike=True)
    return found.select("a", "b", F.round("similarity", 9).alias("similarity"))


# --- content profiles -------------------------------------------------------------------------------------------

PROFILE = TOKENS + """, tf AS (SELECT doc, word, count(*) AS tf FROM tokens GROUP BY 1, 2), words AS (SELECT word, sum(tf) AS n FROM tf GROUP BY 1),
 keep AS (SELECT word FROM words WHERE n >= 0.000001 * (SELECT sum(n) FROM words)), n_docs AS (SELECT count(*) AS n_docs FROM documents),
 idf AS (SELECT word, n_docs / count(*) AS idf FROM tf JOIN keep USING (word), n_docs GROUP BY word, n_docs),
 top AS (SELECT * FROM (SELECT doc, word, tf * idf AS score, row_number() OVER (PARTITION BY doc ORDER BY tf * idf DESC, word) AS rank FROM tf JOIN idf USING (word)) WHERE rank <= 200),
 owned AS (SELECT DISTINCT source AS "user", doc_id AS doc FROM documents), profile AS (SELECT DISTINCT "user", word FROM owned JOIN top USING (doc))"""


def _profile(spark, sf_dir):
    tf = profiles.term_frequency(views.tokens(spark, sf_dir, by_doc=True))
    docs = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n_docs"))
    idf = profiles.common_frequencies(tf, docs, 1e-6)
    owned = table(spark, sf_dir, "documents").select(F.col("source").alias("user"), F.col("doc_id").alias("doc")).distinct()
    return tf, idf, profiles.top_terms(tf, F.broadcast(idf), 200), owned


@query("term_frequency", f"WITH {PROFILE} SELECT doc, word, tf FROM tf")
def term_frequency(spark, sf_dir):
    return profiles.term_frequency(views.tokens(spark, sf_dir))


@query("idf", f"WITH {PROFILE} SELECT word, round(idf, 9) AS idf FROM idf")
def idf(spark, sf_dir):
    return _profile(spark, sf_dir)[1].select("word", F.round("idf", 9).alias("idf"))


@query("tfidf_top_terms", f"WITH {PROFILE} SELECT doc, word, rank FROM top")
def tfidf_top_terms(spark, sf_dir):
    return _profile(spark, sf_dir)[2].select("doc", "word", F.col("rank").cast("long").alias("rank"))


@query("user_profile", f'WITH {PROFILE} SELECT "user", word FROM profile')
def user_profile(spark, sf_dir):
    _, _, top, owned = _profile(spark, sf_dir)
    return profiles.union_profile(owned, top)


@query("profile_cosine", f"""WITH {PROFILE}, shared AS (SELECT o."user", doc, count(*) AS n FROM owned o JOIN top t USING (doc) JOIN profile p ON p."user" = o."user" AND p.word = t.word GROUP BY 1, 2),
 nu AS (SELECT "user", count(*) AS nu FROM profile GROUP BY 1), nd AS (SELECT doc, count(*) AS nd FROM top GROUP BY 1)
 SELECT "user", doc, round(n / sqrt(nu * nd), 9) AS similarity FROM shared JOIN nu USING ("user") JOIN nd USING (doc) WHERE n / sqrt(nu * nd) >= 0.01""")
def profile_cosine(spark, sf_dir):
    _, _, top, owned = _profile(spark, sf_dir)
    return profiles.owned_cosine(owned, top, 0.01)


# --- collaborative filtering ------------------------------------------------------------------------------------


def pearson_sql(source: str, key: str, by: str, least: int, extra: str = "") -> str:
    return f"""SELECT a, b, n, round(cov / sqrt(vx * vy), 9) AS s FROM (SELECT x."{key}" AS a, y."{key}" AS b, count(*) AS n,
 avg(x.rating * y.rating) - avg(x.rating) * avg(y.rating) AS cov, avg(x.rating * x.rating) - avg(x.rating) * avg(x.rating) AS vx,
 avg(y.rating * y.rating) - avg(y.rating) * avg(y.rating) AS vy FROM {source} x JOIN {source} y ON x."{by}" = y."{by}" AND x."{key}" < y."{key}" {extra} GROUP BY 1, 2)
 WHERE n >= {least} AND vx > 1e-12 AND vy > 1e-12"""


BOTH = "SELECT a, b, s FROM pairs UNION ALL SELECT b, a, s FROM pairs"
ITEM_MODEL = TRAIN + f", pairs AS (SELECT * FROM ({pearson_sql('means', 'item', 'user', 3)}) WHERE s > 1e-9), model AS ({BOTH})"
USER_MODEL = TRAIN + f", pairs AS (SELECT * FROM ({pearson_sql('means', 'user', 'item', 6)}) WHERE s >= 0.2), model AS ({BOTH})"
ABOVE = """, um AS (SELECT "user", avg(rating) AS mean FROM means GROUP BY 1), asked AS (SELECT DISTINCT "user", item FROM test),
 near AS (SELECT * FROM (SELECT t."user", t.item, m.s, r.rating, b.mean AS mean_b, row_number() OVER (PARTITION BY t."user", t.item ORDER BY m.s DESC, m.b) AS k
  FROM asked t JOIN model m ON m.a = t."user" JOIN means r ON r."user" = m.b AND r.item = t.item JOIN um b ON b."user" = m.b) WHERE k <= {n}),
 above AS (SELECT "user", item, mean + sum(s * (rating - mean_b)) / sum(s) AS prediction FROM near JOIN um USING ("user") GROUP BY "user", item, mean)"""


@query("avg_ratings", f'WITH {MEANS} SELECT "user", item, round(rating, 9) AS rating FROM means')
def avg_ratings(spark, sf_dir):
    return views.mean_ratings(views.ratings(spark, sf_dir)).select("user", "item", F.round("rating", 9).alias("rating"))


@query("item_pearson", f"WITH {MEANS}, pairs AS ({pearson_sql('means', 'item', 'user', 3)}) SELECT a, b, n, round(s, 6) AS similarity FROM pairs WHERE s > 1e-9")
def item_pearson(spark, sf_dir):
    means = cut(views.mean_ratings(views.ratings(spark, sf_dir)))
    found = similarity.pearson(means, "item", "user", "rating", 3).where(F.col("similarity") > 1e-9)
    return found.select("a", "b", "n", F.round("similarity", 6).alias("similarity"))


@query("item_cf_predict", f"""WITH {ITEM_MODEL}, asked AS (SELECT DISTINCT "user", item FROM test), near AS (SELECT * FROM (SELECT t."user", t.item, m.s, r.rating,
 row_number() OVER (PARTITION BY t."user", t.item ORDER BY m.s DESC, m.b) AS k FROM asked t JOIN model m ON m.a = t.item JOIN means r ON r."user" = t."user" AND r.item = m.b) WHERE k <= 3)
 SELECT "user", item, round(sum(s * rating) / sum(s), 4) AS prediction FROM near GROUP BY 1, 2""")
def item_cf_predict(spark, sf_dir):
    rated = cut(train(spark, sf_dir))
    model = similarity.both_ways(similarity.pearson(rated, "item", "user", "rating", 3).where(F.col("similarity") > 1e-9))
    asked = test(spark, sf_dir).select("user", "item").distinct()
    found = recommend.item_predictions(asked, rated, model, 3)
    return found.select("user", "item", F.round("prediction", 4).alias("prediction"))


USER_LSH = RATINGS + """, train AS (SELECT * FROM ratings WHERE event_id % 10 <> 0 AND item < 95),
 means AS (SELECT "user", item, round(avg(stars), 1) AS rating FROM train GROUP BY 1, 2), test AS (SELECT event_id, "user", item FROM ratings WHERE event_id % 10 = 0),
 codes AS (SELECT item, dense_rank() OVER (ORDER BY item) - 1 AS code FROM (SELECT DISTINCT item FROM means)), m AS (SELECT count(*) AS m FROM codes),
 signature AS (SELECT "user", c, min((code + 37 * c) % m) AS low FROM means JOIN codes USING (item), m, range(120) r(c) GROUP BY 1, 2),
 banded AS (SELECT "user", c // 3 AS band, (sum(low * 17 * (c % 3 + 1)) + 19) % 183 AS bucket FROM signature GROUP BY 1, 2),
 candidates AS (SELECT DISTINCT x."user" AS a, y."user" AS b FROM banded x JOIN banded y ON x.band = y.band AND x.bucket = y.bucket AND x."user" < y."user"),
 size AS (SELECT "user", count(*) AS n FROM means GROUP BY 1),
 near_sets AS (SELECT a, b FROM (SELECT c.a, c.b, count(*) AS shared FROM candidates c JOIN means x ON x."user" = c.a JOIN means y ON y."user" = c.b AND y.item = x.item GROUP BY 1, 2)
  JOIN size sa ON sa."user" = a JOIN size sb ON sb."user" = b WHERE shared / (sa.n + sb.n - shared) >= 0.01),
 pairs AS (SELECT p.* FROM (""" + pearson_sql("means", "user", "item", 3) + """) p JOIN near_sets USING (a, b) WHERE s > 1e-9), model AS (""" + BOTH + ")"


def _user_lsh(spark, sf_dir):
    rated = views.ratings(spark, sf_dir).where((F.col("event_id") % 10 != 0) & (F.col("item") < 95))
    means = cut(rated.groupBy("user", "item").agg(F.round(F.avg("stars"), 1).alias("rating")))
    codes = cut(itemsets.dense_codes(means, "item"))
    signature = similarity.minhash(means.join(codes, "item"), "user", "code", codes.agg(F.count(F.lit(1)).alias("m")), 120, 37)
    banded = similarity.bands(signature, "user", 3, 17, 19, 183)
    if dense := correlate.raters(means, "user", "item", "rating", codes):
        buckets = F.sort_array(F.collect_list(F.struct("band", "bucket")))
        values = banded.groupBy(F.col("user").alias("id")).agg(F.transform(buckets, lambda x: x["bucket"]).alias("values"))
        return means, dense._replace(sets=cut(dense.sets.join(values, "id"))), None
    candidates = similarity.band_candidates(banded, "user")
    near = cut(similarity.jaccard(means, "user", "item", 0.01, candidates).select("a", "b"))
    found = similarity.pearson(means, "user", "item", "rating", 3, near).where(F.col("similarity") > 1e-9)
    return means, None, found


#: Users that share one of 40 buckets and a hundredth of their items.
LSH_RULE = correlate.Rule(common=3, above=1e-9, share=0.01, bands=40)


@query("user_lsh_pearson", f"WITH {USER_LSH} SELECT a, b, n, round(s, 6) AS similarity FROM pairs")
def user_lsh_pearson(spark, sf_dir):
    _, dense, found = _user_lsh(spark, sf_dir)
    if dense:
        found = correlate.pairs(dense.sets, dense.width, LSH_RULE)
    return found.select("a", "b", "n", F.round("similarity", 6).alias("similarity"))


@query("user_cf_predict", f"WITH {USER_LSH}{ABOVE.format(n=5)} SELECT \"user\", item, round(prediction, 4) AS prediction FROM above")
def user_cf_predict(spark, sf_dir):
    means, dense, pairs = _user_lsh(spark, sf_dir)
    asked = test(spark, sf_dir).select("user", "item").distinct()
    if dense:
        found = _dense_predictions(asked, means, dense, LSH_RULE, 5)
    else:
        found = recommend.user_predictions(asked, means, similarity.both_ways(cut(pairs)), 5)
    return found.select("user", "item", F.round("prediction", 4).alias("prediction"))


def _dense_predictions(asked, rated, dense, rule, k):
    ask = asked.join(dense.codes, "item").select(F.col("user").alias("id"), "code")
    return correlate.predictions(correlate.near_ratings(dense.sets, ask, dense.width, rule, k), rated, dense.codes)


MODEL_RULE = correlate.Rule(common=6, least=0.2)


def _user_model(rated):
    return similarity.both_ways(cut(similarity.pearson(rated, "user", "item", "rating", 6).where(F.col("similarity") >= 0.2)))


@query("user_model", f"WITH {USER_MODEL} SELECT a, count(*) AS n_neighbours, round(max(s), 6) AS best FROM model GROUP BY 1")
def user_model(spark, sf_dir):
    rated = cut(train(spark, sf_dir))
    if dense := correlate.raters(rated, "user", "item", "rating"):
        return correlate.neighbourhoods(dense.sets, dense.width, MODEL_RULE).select("a", "n_neighbours", F.round("best", 6).alias("best"))
    lists = recommend.neighbour_lists(_user_model(rated))
    return lists.select("a", F.size("neighbours").cast("long").alias("n_neighbours"), F.round(F.col("neighbours")[0]["similarity"], 6).alias("best"))


@query("user_cf_fallback", f"""WITH {USER_MODEL}{ABOVE.format(n=20)}, im AS (SELECT item, avg(rating) AS item_mean FROM means GROUP BY 1)
 SELECT t.event_id, t."user", t.item, round(CASE WHEN item_mean IS NOT NULL THEN coalesce(a.prediction, item_mean) ELSE coalesce(um.mean, 4.8) END, 4) AS prediction,
 CASE WHEN item_mean IS NOT NULL AND a.prediction IS NOT NULL THEN 'near' WHEN item_mean IS NOT NULL THEN 'item' WHEN um.mean IS NOT NULL THEN 'user' ELSE 'default' END AS path
 FROM test t LEFT JOIN im ON im.item = t.item LEFT JOIN um ON um."user" = t."user" LEFT JOIN above a ON a."user" = t."user" AND a.item = t.item""")
def user_cf_fallback(spark, sf_dir):
    rated = cut(train(spark, sf_dir))
    asked = test(spark, sf_dir)
    if dense := correlate.raters(rated, "user", "item", "rating"):
        found = recommend.with_fallbacks(asked, rated, None, near=_dense_predictions(asked.select("user", "item"), rated, dense, MODEL_RULE, 20))
    else:
        found = recommend.with_fallbacks(asked, rated, _user_model(rated))
    return found.withColumn("prediction", F.round("prediction", 4))


# --- graphs -----------------------------------------------------------------------------------------------------


def graph_sql(least: int) -> str:
    return RATINGS + f""", members AS (SELECT DISTINCT "user", item FROM ratings),
 edges AS (SELECT x."user" AS src, y."user" AS dst FROM members x JOIN members y ON x.item = y.item AND x."user" < y."user" GROUP BY 1, 2 HAVING count(*) >= {least}),
 arcs AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges), nodes AS (SELECT DISTINCT src AS node FROM arcs)"""


def edges_of(spark, sf_dir, least):
    return cut(graph.cooccurrence(views.ratings(spark, sf_dir), "user", "item", least))


@query("cooccurrence_graph", f"WITH {graph_sql(32)} SELECT src, dst FROM edges")
def cooccurrence_graph(spark, sf_dir):
    return graph.cooccurrence(views.ratings(spark, sf_dir), "user", "item", 32)


@query("degrees", f"WITH {graph_sql(32)} SELECT src AS node, count(*) AS degree FROM arcs GROUP BY 1")
def degrees(spark, sf_dir):
    return graph.cooccurrence_degrees(views.ratings(spark, sf_dir), "user", "item", 32)


def _propagated(rounds: int) -> str:
    steps = ["l0 AS (SELECT node, node AS community FROM nodes)"]
    for i in range(1, rounds + 1):
        steps.append(f"""l{i} AS (SELECT node, community FROM (SELECT src AS node, community, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, community) AS k
 FROM arcs JOIN l{i - 1} ON dst = l{i - 1}.node GROUP BY src, community) WHERE k = 1)""")
    return ", ".join(steps)


@query("label_propagation", f"WITH {graph_sql(32)}, {_propagated(5)} SELECT node, community FROM l5")
def label_propagation(spark, sf_dir):
    return graph.cooccurrence_labels(views.ratings(spark, sf_dir), "user", "item", 32, 5)


COMPONENTS = """, reach AS (SELECT node, node AS root FROM nodes UNION SELECT a.dst, r.root FROM reach r JOIN arcs a ON a.src = r.node),
 parts AS (SELECT node, min(root) AS component FROM reach GROUP BY 1)"""


@query("connected_components", f"WITH RECURSIVE {graph_sql(34)}{COMPONENTS} SELECT node, component FROM parts")
def connected_components(spark, sf_dir):
    return graph.cooccurrence_components(views.ratings(spark, sf_dir), "user", "item", 34)


@query("bfs_levels", f"""WITH RECURSIVE {graph_sql(34)}, walk AS (SELECT (SELECT min(node) FROM nodes) AS node, 0 AS distance UNION SELECT a.dst, w.distance + 1 FROM walk w JOIN arcs a ON a.src = w.node WHERE w.distance < 12)
 SELECT node, CAST(min(distance) AS INTEGER) AS distance FROM walk WHERE node IS NOT NULL GROUP BY 1""")
def bfs_levels(spark, sf_dir):
    return graph.cooccurrence_levels(views.ratings(spark, sf_dir), "user", "item", 34)


#: All shortest paths, one by one: those that grow by an arc to a node one level further from their root.
BETWEENNESS = """, walk AS (SELECT node AS root, node, 0 AS distance FROM nodes UNION SELECT w.root, a.dst, w.distance + 1 FROM walk w JOIN arcs a ON a.src = w.node WHERE w.distance < 12),
 level AS (SELECT root, node, min(distance) AS distance FROM walk GROUP BY 1, 2),
 path AS (SELECT node AS root, node, 0 AS distance, [node] AS nodes FROM nodes
  UNION ALL SELECT p.root, a.dst, p.distance + 1, list_append(p.nodes, a.dst) FROM path p JOIN arcs a ON a.src = p.node JOIN level l ON l.root = p.root AND l.node = a.dst AND l.distance = p.distance + 1),
 share AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY root, node) AS part FROM path),
 step AS (SELECT nodes[i] AS x, nodes[i + 1] AS y, part FROM (SELECT nodes, part, unnest(range(1, len(nodes))) AS i FROM share))"""


@query("edge_betweenness", f"WITH RECURSIVE {graph_sql(34)}{BETWEENNESS} SELECT least(x, y) AS src, greatest(x, y) AS dst, round(sum(part) / 2, 6) AS betweenness FROM step GROUP BY 1, 2")
def edge_betweenness(spark, sf_dir):
    found = graph.edge_betweenness(edges_of(spark, sf_dir, 34))
    return found.select("src", "dst", F.round("betweenness", 6).alias("betweenness"))


@query("modularity", f"""WITH RECURSIVE {graph_sql(34)}{COMPONENTS}, deg AS (SELECT src AS node, count(*) AS k FROM arcs GROUP BY 1), m AS (SELECT count(*) AS m FROM edges),
 pairs AS (SELECT sum(x.k * y.k) AS kk FROM parts p JOIN parts q ON p.component = q.component AND p.node < q.node JOIN deg x ON x.node = p.node JOIN deg y ON y.node = q.node)
 SELECT round(m - kk / (2 * m), 6) AS modularity FROM pairs, m""")
def modularity(spark, sf_dir):
    rated = cut(views.ratings(spark, sf_dir).select("user", "item").distinct())
    found = graph.modularity_of_components(*(f(rated, "user", "item", 34) for f in (graph.cooccurrence_degrees, graph.cooccurrence_components)))
    return found.select(F.round("modularity", 6).alias("modularity"))


@query("girvan_newman")
def girvan_newman(spark, sf_dir):
    return gn_plan.girvan_newman(edges_of(spark, sf_dir, 38))


# --- clusters ---------------------------------------------------------------------------------------------------

POINTS = "points AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 8) AS vector, label AS cluster FROM embeddings)"
STATS = POINTS + """, long AS (SELECT id, cluster, unnest(vector) AS x, generate_subscripts(vector, 1) AS dim FROM points),
 stats AS (SELECT cluster, dim, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM long GROUP BY 1, 2)"""


def _labelled_points(spark, sf_dir):
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"))
    return views.points(spark, sf_dir).join(labels, "id")


@query("cluster_stats", f"WITH {STATS} SELECT cluster, CAST(dim - 1 AS INTEGER) AS dim, n, round(s, 5) AS s, round(q, 4) AS q FROM stats")
def cluster_stats(spark, sf_dir):
    found = cluster.statistics(_labelled_points(spark, sf_dir))
    long = found.select("cluster", "n", F.posexplode(F.arrays_zip("sum", "sumsq")).alias("dim", "z"))
    return long.select("cluster", "dim", "n", F.round("z.sum", 5).alias("s"), F.round("z.sumsq", 4).alias("q"))


@query("nearest_centroid", f"""WITH {STATS}, d AS (SELECT l.id, t.cluster, sum((x - s / n) * (x - s / n)) AS d FROM long l JOIN stats t USING (dim) GROUP BY 1, 2)
 SELECT id, cluster FROM (SELECT id, cluster, row_number() OVER (PARTITION BY id ORDER BY d, cluster) AS k FROM d) WHERE k = 1""")
def nearest_centroid(spark, sf_dir):
    points = _labelled_points(spark, sf_dir)
    centres = cluster.described(cluster.statistics(points)).select("cluster", "centre")
    return cluster.nearest(points.select("id", "vector"), centres).select("id", "cluster")


@query("mahalanobis_assign", f"""WITH {STATS}, v AS (SELECT cluster, dim, s / n AS c, greatest(0, q / n - (s / n) * (s / n)) AS v FROM stats),
 d AS (SELECT l.id, v.cluster, sum(CASE WHEN v > 0 THEN (x - c) * (x - c) / v ELSE 0 END) AS d, count(*) AS dims FROM long l JOIN v USING (dim) GROUP BY 1, 2)
 SELECT id, min(cluster) FILTER (WHERE d < 1 * dims) AS cluster FROM d GROUP BY 1""")
def mahalanobis_assign(spark, sf_dir):
    points = _labelled_points(spark, sf_dir)
    clusters = cluster.described(cluster.statistics(points)).select("cluster", "centre", "variance")
    return cluster.first_within(points.select("id", "vector"), clusters, 1.0).select("id", "cluster")


def _farthest_sql(k: int) -> str:
    far = "list_sum(list_transform(list_zip(vector, centre), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = ["c0 AS (SELECT id, vector AS centre FROM points ORDER BY id LIMIT 1)", f"l0 AS (SELECT p.id, vector, {far} AS least FROM points p, c0)"]
    for i in range(1, k):
        steps.append(f"c{i} AS (SELECT id, vector AS centre FROM l{i - 1} WHERE least > 0 ORDER BY least DESC, id LIMIT 1)")
        steps.append(f"l{i} AS (SELECT l.id, vector, least(least, {far}) AS least FROM l{i - 1} l, c{i})")
    return f"WITH {POINTS}, {', '.join(steps)} " + " UNION ALL ".join(f"SELECT {i} AS cluster, id FROM c{i}" for i in range(k))


@query("farthest_first", _farthest_sql(8))
def farthest_first(spark, sf_dir):
    return cluster.farthest_first(views.points(spark, sf_dir), 8).select("cluster", "id")


@query("kmeans", f"""WITH {STATS}, c0 AS (SELECT cluster, dim, s / n AS c FROM stats), d0 AS (SELECT l.id, t.cluster, sum((x - c) * (x - c)) AS d FROM long l JOIN c0 t USING (dim) GROUP BY 1, 2),
 a1 AS (SELECT id, cluster FROM (SELECT id, cluster, row_number() OVER (PARTITION BY id ORDER BY d, cluster) AS k FROM d0) WHERE k = 1),
 c1 AS (SELECT a.cluster, dim, avg(x) AS c FROM a1 a JOIN long l USING (id) GROUP BY 1, 2), d1 AS (SELECT l.id, t.cluster, sum((x - c) * (x - c)) AS d FROM long l JOIN c1 t USING (dim) GROUP BY 1, 2),
 a2 AS (SELECT id, cluster FROM (SELECT id, cluster, row_number() OVER (PARTITION BY id ORDER BY d, cluster) AS k FROM d1) WHERE k = 1)
 SELECT cluster, count(*) AS n FROM a2 GROUP BY 1""")
def kmeans(spark, sf_dir):
    points = _labelled_points(spark, sf_dir)
    seeds = cluster.described(cluster.statistics(points)).select("cluster", "centre")
    return cluster.lloyd_centres(cut(points.select("id", "vector")), cut(seeds), 2).select("cluster", "n")


def _bfr(spark, sf_dir):
    points = cut(views.points(spark, sf_dir))
    return bfr_plan.bfr([points.where(F.col("round") == r).select("id", "vector") for r in range(5)], 5)


@query("bfr")
def bfr(spark, sf_dir):
    return _bfr(spark, sf_dir)[0]


@query("bfr_rounds")
def bfr_rounds(spark, sf_dir):
    return _bfr(spark, sf_dir)[1]


# --- sketches and streams ---------------------------------------------------------------------------------------

BITS, STEP = 1442, 144
CODE = "list_reduce(list_prepend(0::BIGINT, list_transform(regexp_extract_all(hex(encode({t})), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda a, x: (a * 256 + x) % {m})"
BLOOM = f"""build AS (SELECT DISTINCT p_brand AS t FROM part WHERE p_brand <> ''), coded AS (SELECT {CODE.format(t='t', m=BITS)} AS v FROM build),
 bits AS (SELECT DISTINCT (v + {STEP} * i) % {BITS} AS place FROM coded, range(1, 11) r(i))"""


@query("bloom_bits", f"WITH {BLOOM} SELECT place FROM bits")
def bloom_bits(spark, sf_dir):
    return sketch.bloom_bits(table(spark, sf_dir, "part").select("p_brand").distinct(), "p_brand", BITS, STEP)


@query("bloom_probe", f"""WITH {BLOOM}, asked AS (SELECT DISTINCT p_type AS t FROM part UNION SELECT p_brand FROM part), codes AS (SELECT t, {CODE.format(t='t', m=BITS)} AS v FROM asked),
 hit AS (SELECT t, min(CASE WHEN place IS NULL THEN 0 ELSE 1 END) AS prediction FROM (SELECT DISTINCT t, (v + {STEP} * i) % {BITS} AS p FROM codes, range(1, 11) r(i)) LEFT JOIN bits ON p = place GROUP BY 1)
 SELECT t AS name, prediction FROM hit""")
def bloom_probe(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    filled = sketch.bloom_bits(part.select("p_brand").distinct(), "p_brand", BITS, STEP)
    asked = part.select(F.col("p_type").alias("name")).union(part.select("p_brand")).distinct()
    return sketch.bloom_probe(asked, "name", filled, BITS, STEP)


WINDOWS = "spans AS (SELECT user_id, time_bucket(INTERVAL '2 hours', ts) - o * INTERVAL '2 hours' AS start FROM events, range(3) r(o))"


@query("distinct_per_sliding_window", f"WITH {WINDOWS} SELECT CAST(start AS VARCHAR) AS start, count(DISTINCT user_id) AS n_users FROM spans GROUP BY 1")
def distinct_per_sliding_window(spark, sf_dir):
    found = windows.distinct_per_window(table(spark, sf_dir, "events"), "6 hours", "2 hours")
    return found.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n_users")


def _fm_sql() -> str:
    zeros = "CASE WHEN h = 0 THEN 3 ELSE length(regexp_extract(bin(h), '0*$')) END"
    return f"""WITH {WINDOWS}, h AS (SELECT start, user_id, g, k, (user_id * (2 * g + 3) + 17 * (k + 1) + 131 * g) % (997 + 10 * g) AS h FROM spans, range(8) a(g), range(9) b(k)),
 mx AS (SELECT start, g, k, max({zeros}) AS z FROM h GROUP BY 1, 2, 3), means AS (SELECT start, g, avg(pow(2.0, z)) AS e FROM mx GROUP BY 1, 2),
 truth AS (SELECT start, count(DISTINCT user_id) AS truth FROM spans GROUP BY 1)
 SELECT CAST(start AS VARCHAR) AS start, truth, round(median(e), 4) AS estimate FROM means JOIN truth USING (start) GROUP BY 1, 2"""


@query("fm_estimate", _fm_sql())
def fm_estimate(spark, sf_dir):
    spans = table(spark, sf_dir, "events").select(F.window(F.col("ts").cast("timestamp"), "6 hours", "2 hours").alias("w"), "user_id")
    spans = spans.select(F.col("w.start").alias("start"), "user_id")
    found = sketch.fm_estimate(spans, ["start"], F.col("user_id"))
    return found.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "truth", F.round("estimate", 4).alias("estimate"))


@query("bottomk_sample", "SELECT event_id, event_type FROM events ORDER BY (event_id * 48271) % 2147483647, event_id LIMIT 100")
def bottomk_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", ((F.col("event_id") * 48271) % 2147483647).alias("_o"))
    return sketch.bottom_k(rows, F.struct("_o", "event_id"), 100).select("event_id", "event_type")


@query("top3_tags", """WITH c AS (SELECT event_type AS tag, count(*) AS n FROM events WHERE regexp_full_match(event_type, '[A-Za-z0-9 _]*') GROUP BY 1)
 SELECT tag, n, rank FROM (SELECT tag, n, dense_rank() OVER (ORDER BY n DESC) AS rank FROM c) WHERE rank <= 3""")
def top3_tags(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where(F.col("event_type").rlike("^[A-Za-z0-9 _]*$")).select(F.col("event_type").alias("tag"))
    return sketch.top_ranks(rows, "tag", 3).withColumn("rank", F.col("rank").cast("long"))


@query("stream_windowed_distinct", f"WITH {WINDOWS} SELECT CAST(start AS VARCHAR) AS start, count(DISTINCT user_id) AS n_users FROM spans GROUP BY 1")
def stream_windowed_distinct(spark, sf_dir):
    """Every micro-batch goes to parquet; the stream's (window, user) states are final in complete mode."""
    folder = shared_folder(spark, "stream")
    state = windows.windowed(views.event_stream(spark, sf_dir), "6 hours", "2 hours")
    windows.run_available(state, lambda df, _: df.write.mode("overwrite").parquet(f"{folder}/out"), f"{folder}/checkpoint", "complete")
    found = spark.read.parquet(f"{folder}/out").groupBy("start").agg(F.count(F.lit(1)).alias("n_users"))
    return found.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n_users")


@query("stream_reservoir")
def stream_reservoir(spark, sf_dir):
    folder = shared_folder(spark, "stream")
    tags = views.event_stream(spark, sf_dir).select("event_id", F.col("event_type").alias("tag"))
    windows.run_available(windows.reservoir(tags), lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{folder}/out"), f"{folder}/checkpoint", "update")
    latest = spark.read.parquet(f"{folder}/out").groupBy("salt").agg(F.max_by(F.struct("seen", "sample"), "batch").alias("x"))
    return windows.merged_sample(latest.select("salt", "x.*"), 100)


@query("stream_fm_report", _fm_sql())
def stream_fm_report(spark, sf_dir):
    """Per-window truth and estimate, added to a CSV report by every micro-batch; the rows of the last one."""
    folder = shared_folder(spark, "stream")
    each = windows.window_report(f"{folder}/report", lambda df: sketch.fm_estimate(df, ["start"], F.col("user_id")))
    windows.run_available(windows.windowed(views.event_stream(spark, sf_dir), "6 hours", "2 hours"), each, f"{folder}/checkpoint", "complete")
    report = views.csv_with_header(spark, f"{folder}/report", "batch int, Time string, Truth long, Estimation double")
    last = report.agg(F.max("batch").alias("batch"))
    return report.join(last, "batch").select(F.col("Time").alias("start"), F.col("Truth").alias("truth"), F.round("Estimation", 4).alias("estimate"))


@query("plain_tags", "SELECT event_type AS tag, count(*) AS n FROM events WHERE regexp_full_match(event_type, '[A-Za-z0-9 ]*') GROUP BY 1")
def plain_tags(spark, sf_dir):
    tags = table(spark, sf_dir, "events").select(F.col("event_type").alias("tag"))
    return tags.where(X.plain_tag(F.col("tag"))).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("stream_top_tags")
def stream_top_tags(spark, sf_dir):
    """Running ranks over the reservoir's sample, reported by every micro-batch."""
    folder = shared_folder(spark, "stream")
    tags = views.event_stream(spark, sf_dir).select("event_id", F.col("event_type").alias("tag")).where(X.plain_tag(F.col("tag")))
    windows.run_available(windows.reservoir(tags), windows.sample_report(folder), f"{folder}/checkpoint", "update")
    return views.csv_with_header(spark, f"{folder}/report", "batch int, seen long, tag string, n long, rank int")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
