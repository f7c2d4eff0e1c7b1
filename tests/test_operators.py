"""Small fixtures worked out by hand, and laws that results must keep."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from quarry import catalog, session
from quarry.functions import hashing, text, vectors
from quarry.operators import cluster, graph, itemsets, recommend, relational, similarity, sketch
from quarry.plans import bfr, girvan_newman
from quarry.session import cut
from quarry.sources import sinks, views
from quarry.streaming import windows


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def dealt(n):
    return F.pmod(F.xxhash64("basket"), F.lit(n))


@pytest.fixture
def baskets(spark):
    data = [("1", "abc"), ("2", "ab"), ("3", "ac"), ("4", "bc")]
    return spark.createDataFrame([(b, i) for b, items in data for i in items], "basket string, item string")


EXPECTED = [("a", 3), ("a,b", 2), ("a,c", 2), ("b", 3), ("b,c", 2), ("c", 3)]


@pytest.mark.parametrize("how", [lambda b: itemsets.apriori(b, 2, 3), lambda b: itemsets.fpgrowth(b, 2), lambda b: itemsets.two_pass(b, 2, dealt(2))])
def test_itemsets(baskets, how):
    found = how(baskets)
    assert rows(found.select(F.array_join("items", ","), "n")) == EXPECTED


@pytest.mark.parametrize("how", [lambda b: itemsets.apriori(b, 2), lambda b: itemsets.fpgrowth(b, 2), lambda b: itemsets.two_pass(b, 2, dealt(2))])
def test_itemsets_to_the_last_level(spark, how):
    data = [("1", "abcde"), ("2", "abcde"), ("3", "abf"), ("4", "f"), ("5", "ag")]
    held = [set(items) for _, items in data]
    found = how(spark.createDataFrame([(b, i) for b, items in data for i in items], "basket string, item string"))
    every = [c for k in range(1, 6) for c in combinations("abcdefg", k)]
    want = {",".join(c): n for c in every if (n := sum(set(c) <= h for h in held)) >= 2}
    assert dict(rows(found.select(F.array_join("items", ","), "n"))) == want and "a,b,c,d,e" in want


def test_candidates_to_the_last_level(spark):
    b = spark.createDataFrame([(b, i) for b in "12" for i in "abcde"], "basket string, item string")
    assert itemsets.partition_candidates(b, 2, dealt(2)).count() == 31


def test_pair_of_two_singletons(spark):
    b = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "a"), ("2", "b")], "basket string, item string")
    assert rows(itemsets.two_pass(b, 2, dealt(2)).select(F.array_join("items", ","), "n")) == [("a", 2), ("a,b", 2), ("b", 2)]


def test_candidates_hold_all_frequent(baskets):
    found = {r[0] for r in itemsets.partition_candidates(baskets, 2, dealt(3)).select(F.array_join("items", ",")).collect()}
    assert {k for k, _ in EXPECTED} <= found


def test_parts_follow_the_data(baskets, monkeypatch):
    monkeypatch.setattr(itemsets, "PART", 2)
    assert rows(itemsets.two_pass(baskets, 2).select(F.array_join("items", ","), "n")) == EXPECTED


@pytest.mark.parametrize("buckets", [1, 2, 5000])
def test_bucket_pruning_keeps_all_frequent_pairs(baskets, buckets):
    assert rows(itemsets.pcy_pairs(baskets, 2, buckets).select(F.array_join("items", ","), "n")) == [("a,b", 2), ("a,c", 2), ("b,c", 2)]


def test_dense_codes(spark):
    values = [f"v{i % 70:03d}" for i in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(7)
    assert rows(itemsets.dense_codes(df, "v")) == [(v, i) for i, v in enumerate(sorted(set(values)))]


@pytest.mark.parametrize("least", [0.05, 0.2, 0.35, 1.0])
def test_jaccard_equals_all_pairs(spark, least):
    import random

    rng = random.Random(5)
    sets = {k: frozenset(m for m in range(20) if rng.random() < (0.9 if m < 3 else 0.3)) for k in range(40)} | {90: frozenset({1, 7}), 91: frozenset({1, 7})}
    df = spark.createDataFrame([(k, m) for k, ms in sets.items() for m in ms], "k long, m long")
    want = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] & sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least]
    assert rows(similarity.jaccard(df, "k", "m", least).select("a", "b")) == want and want


@pytest.mark.parametrize("least", [1, 3, 6])
def test_cooccurrence_equals_all_pairs(spark, least):
    import random

    rng = random.Random(3)
    sets = {k: {m for m in range(30) if rng.random() < (0.9 if m < 4 else 0.2)} for k in range(40)}
    df = spark.createDataFrame([(k, m) for k, ms in sets.items() for m in ms for _ in range(2)], "k long, m long")
    want = [(a, b) for a, b in combinations(range(40), 2) if len(sets[a] & sets[b]) >= least]
    assert rows(graph.cooccurrence(df, "k", "m", least)) == want


def test_itemset_report(baskets):
    report = sinks.itemset_report(itemsets.apriori(baskets, 2, 2)).collect()
    assert [r["line"] for r in report] == ["('a'),('b'),('c')", "('a', 'b'),('a', 'c'),('b', 'c')"]


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def test_betweenness_of_a_path(spark):
    found = graph.edge_betweenness(edges(spark, [(1, 2), (2, 3), (3, 4)]))
    assert rows(found) == [(1, 2, 3.0), (2, 3, 4.0), (3, 4, 3.0)]


def test_bridge(spark):
    e = edges(spark, [(1, 2), (1, 3), (2, 3), (4, 5), (4, 6), (5, 6), (3, 4)])
    top = graph.edge_betweenness(e).orderBy(F.desc("betweenness")).first()
    assert (top["src"], top["dst"], top["betweenness"]) == (3, 4, 9.0)
    assert rows(girvan_newman.girvan_newman(e, 2)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4)]
    assert rows(graph.components(e))[0] == (1, 1)


def test_girvan_newman_query_waits_as_long_as_its_plan(monkeypatch):
    seen = []
    monkeypatch.setattr(catalog, "edges_of", lambda *args: None)
    monkeypatch.setattr(girvan_newman, "girvan_newman", lambda edges, patience=15: seen.append(patience))
    catalog.QUERIES["girvan_newman"](None, "")
    assert seen == [15]


def test_label_propagation_and_report(spark):
    e = edges(spark, [(1, 2), (1, 3), (2, 3), (7, 8), (7, 9), (8, 9)])
    found = graph.label_propagation(e)
    assert len({c for n, c in rows(found) if n < 4}) == 1
    assert sinks.community_report(graph.components(e).withColumnRenamed("component", "community")).count() == 2


def test_pearson(spark):
    r = spark.createDataFrame(
        [(1, i, x) for i, x in enumerate([1.0, 2.0, 3.0])] + [(2, i, x) for i, x in enumerate([2.0, 3.0, 4.0])] + [(3, i, 4.0) for i in range(3)],
        "user long, item long, rating double",
    )
    assert rows(similarity.pearson(r, "user", "item", "rating", 3)) == [(1, 2, 3, 1.0)]


def test_jaccard(spark):
    m = spark.createDataFrame([("x", i) for i in (1, 2, 3)] + [("y", i) for i in (2, 3, 4)], "k string, m long")
    assert rows(similarity.jaccard(m, "k", "m", 0.1)) == [("x", "y", 0.5)]


def test_fallbacks(spark):
    rated = spark.createDataFrame([(1, 10, 4.0), (2, 10, 2.0)], "user long, item long, rating double")
    asked = spark.createDataFrame([(1, 3, 10), (2, 1, 99), (3, 9, 99)], "event_id long, user long, item long")
    model = spark.createDataFrame([], "a long, b long, similarity double")
    found = {r["event_id"]: (r["prediction"], r["path"]) for r in recommend.with_fallbacks(asked, rated, model).collect()}
    assert found == {1: (3.0, "item"), 2: (4.0, "user"), 3: (4.8, "default")}


def test_bloom(spark):
    bits, step = sketch.bloom_size(2)
    assert (bits, step) == (28, 2)
    items = spark.createDataFrame([("x",), ("y",)], "c string")
    asked = spark.createDataFrame([("x",), ("y",), ("",), (None,)], "c string")
    found = sketch.bloom_probe(asked, "c", sketch.bloom_bits(items, "c", bits, step), bits, step)
    assert sorted((r["c"] or "", r["prediction"]) for r in found.collect()) == [("", 0), ("", 0), ("x", 1), ("y", 1)]
    assert sketch.bloom_filter(items, "c", 10).mightContain("x")


def test_big_integer_hash(spark):
    words = ["", "a", "Las Vegas", "é" * 20, "x" * 100]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    found = {r["t"]: r["h"] for r in df.select("t", hashing.bytes_modulo(F.col("t"), 997).alias("h")).collect()}
    assert found == {w: (int(w.encode().hex(), 16) if w else 0) % 997 for w in words}


def test_trailing_zeros(spark):
    df = spark.createDataFrame([(12,), (1,), (0,), (8,)], "v long")
    assert [r[0] for r in df.select(hashing.trailing_zeros(F.col("v"))).collect()] == [2, 0, 3, 3]


def test_top_ranks(spark):
    df = spark.createDataFrame([(t,) for t in "aaaaabbbbbcccdde"], "tag string")
    assert [r[0] for r in rows(sketch.top_ranks(df, "tag", 3))] == ["a", "b", "c", "d"]


def test_mahalanobis(spark):
    p = spark.createDataFrame([(1, [2.0, 2.0]), (2, [9.0, 0.0])], "id long, vector array<double>")
    c = spark.createDataFrame([(0, [0.0, 0.0], [1.0, 4.0])], "cluster int, centre array<double>, variance array<double>")
    assert rows(cluster.first_within(p, c, 4.0).select("id", F.coalesce("cluster", F.lit(-1)))) == [(1, 0), (2, -1)]
    d = vectors.squared_mahalanobis(F.array(F.lit(2.0), F.lit(2.0)), F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(4.0)))
    assert spark.range(1).select(d).first()[0] == 5.0


def test_bfr_keeps_every_point(spark):
    import random

    rng = random.Random(1)
    data = [(i, [rng.gauss(10 * (i % 3), 1), rng.gauss(-10 * (i % 3), 1)], i // 60) for i in range(180)]
    points = cut(spark.createDataFrame(data, "id long, vector array<double>, round long"))
    labels, metrics = bfr.bfr([points.where(F.col("round") == r).select("id", "vector") for r in range(3)], 3)
    assert labels.count() == 180 == labels.select("id").distinct().count()
    for r in metrics.collect():
        assert r["n_discard_points"] + r["n_compressed_points"] + r["n_retained_points"] == 60 * r["round"]


def test_partition_profile(spark):
    df = spark.range(100).repartition(5)
    assert sum(n for _, n in rows(relational.partition_profile(df))) == 100
    assert rows(relational.repartition_profile(spark.range(8), F.col("id"), 4)) == [(0, 2), (1, 2), (2, 2), (3, 2)]


def test_categories_and_tokens(spark):
    df = spark.createDataFrame([(None,), ("a, b",)], "c string")
    assert [r[0] for r in df.select(text.list_or_none(F.col("c"))).collect()] == [["None"], ["a", "b"]]
    one = spark.createDataFrame([("The cat; (the) dog.",)], "t string")
    assert one.select(text.tokens(F.col("t"))).first()[0] == ["the", "cat", "the", "dog"]


def test_readers(spark, tmp_path):
    (tmp_path / "v.txt").write_text("1,0.5,2\n2,1,1\n")
    assert rows(views.vectors(spark, str(tmp_path / "v.txt")))[0] == (1, [0.5, 2.0])
    assert [p.rsplit("/", 1)[1] for p in views.rounds(spark, str(tmp_path))] == ["v.txt"]
    (tmp_path / "r.json").write_text('{"user_id":"u","stars":4.0}\n')
    assert views.json_lines(spark, str(tmp_path / "r.json"), views.REVIEW).first()["stars"] == 4.0
    bad = spark.createDataFrame([('{"city":"A"}',), ("no json",)], "value string")
    assert [r[0] for r in bad.select(views.tolerant_field(F.col("value"), "city")).collect()] == ["A", ""]
    (tmp_path / "b.csv").write_text("user,item\n1,2\n")
    assert rows(views.csv_with_header(spark, str(tmp_path / "b.csv"), "user string, item string")) == [("1", "2")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, 0), (1, 1)], "o long, p long")
    assert sinks.prediction_line(df, "o", "p").first()[0] == "1 0"
    sinks.csv(df, str(tmp_path / "c"))
    sinks.json_lines(df, str(tmp_path / "j"))
    sinks.model(df, str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == spark.read.json(str(tmp_path / "j")).count() == 2


def test_reservoir_is_whole_when_small(spark, tmp_path):
    spark.createDataFrame([(i, f"t{i}") for i in range(50)], "event_id long, tag string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, tag string").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    windows.run_available(windows.reservoir(stream, 100), lambda d, n: d.withColumn("batch", F.lit(n)).write.mode("append").parquet(out), str(tmp_path / "cp"), "update")
    latest = spark.read.parquet(out).select("salt", "seen", "sample")
    assert windows.merged_sample(latest, 100).distinct().count() == 50


def test_model_documents_and_reports(spark, tmp_path):
    pairs = spark.createDataFrame([("x", "y", 0.5)], "a string, b string, similarity double")
    sinks.pair_model(pairs, str(tmp_path / "pairs"))
    assert rows(views.pair_model(spark, str(tmp_path / "pairs"))) == [("x", "y", 0.5)]
    (tmp_path / "odd.json").write_text('{"b1": "x", "b2": "y", "sim": 1}\nnot json\n{"b1": "z"}\n')
    assert rows(views.pair_model(spark, str(tmp_path / "odd.json"))) == [("x", "y", 1.0)]
    sinks.model_document({"model": pairs, "users": pairs.select("a")}, str(tmp_path / "doc"))
    assert rows(views.model_part(spark, str(tmp_path / "doc"), "users", "a string")) == [("x",)]
    for _ in range(2):
        sinks.append_csv(pairs, str(tmp_path / "csv"))
    assert rows(views.csv_with_header(spark, str(tmp_path / "csv"), "a string, b string, similarity double")) == [("x", "y", 0.5)] * 2
    between = spark.createDataFrame([(1, 2, 0.25), (2, 3, 1.0)], "src long, dst long, betweenness double")
    assert [r[0] for r in sinks.betweenness_report(between).collect()] == ["('2', '3'), 1.0", "('1', '2'), 0.25"]


def test_durations_and_shared_folders(spark):
    said = []
    with pytest.raises(ValueError), session.duration("took", said.append):
        raise ValueError
    assert said[0].startswith("took: 0.")

    class Cluster:
        conf = {}
        sparkContext = type("C", (), {"master": "spark://somewhere:7077"})

    with pytest.raises(RuntimeError):
        session.shared_folder(Cluster, "x")
    cached = spark.range(3).cache()
    session.free(cached)
    assert not cached.is_cached


def test_stream_reports(spark, tmp_path):
    spark.range(500).select(F.col("id").alias("event_id"), F.when(F.col("id") % 5 == 0, "rare").otherwise("common").alias("tag")).repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, tag string").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    folder = str(tmp_path / "state")
    windows.run_available(windows.reservoir(stream, 40), windows.sample_report(folder, 40), f"{folder}/checkpoint", "update")
    report = views.csv_with_header(spark, f"{folder}/report", "batch int, seen long, tag string, n long, rank int").collect()
    last = max(r["batch"] for r in report)
    assert last >= 1 and {(r["tag"], r["rank"]) for r in report if r["batch"] == last} == {("common", 1), ("rare", 2)}
    assert {r["seen"] for r in report if r["batch"] == last} == {500} and sum(r["n"] for r in report if r["batch"] == last) == 40


def test_disconnect_rule(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))

    def fails(df, n):
        raise RuntimeError("HTTP 420: calm down")

    windows.run_available(stream, fails, str(tmp_path / "c1"), disconnect=windows.refused())
    with pytest.raises(Exception, match="420"):
        windows.run_available(stream, fails, str(tmp_path / "c2"), disconnect=windows.refused(503))
