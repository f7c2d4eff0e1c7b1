"""Urls, embeddings, and the pipeline as a whole."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import ann, urls
from quarry.llm.unionfind import local_components

from .conftest import SCHEMA, VOCABULARY, corpus, sentence

PAGES = {
    "https://WWW.Example.com/en/x?q=1": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
    "http://example.com/en/": ("example.com", "/en/", "example.com/en/", "block"),
    "http://a.example.com/en/1#t": ("a.example.com", "/en/1", "example.com/en/", "block"),
    "http://example.com": ("example.com", "", None, None),
    "http://example.com?x": ("example.com", "", None, None),
    "http://badexample.com/en/": ("badexample.com", "/en/", "com/", "allow"),
    "http://x.net/es/1": ("x.net", "/es/1", "net/es/", "block"),
    "http://x.net/e": ("x.net", "/e", None, None),
    "http://x.net/fr/a://b/": ("x.net", "/fr/a://b/", "net/fr/", "block"),
    "no scheme": ("", "", None, None),
    "": ("", "", None, None),
}


def test_rules_of_urls(spark):
    rows = list(PAGES) + [None]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    found = {rows[r["page_id"]]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, urls.page_trials(pages, labels)).collect()}
    for url, (host, path, rule, verdict) in PAGES.items():
        assert found[url] == (host, path, rule, verdict or "allow")
    assert found[None] == ("", "", None, "allow")
    assert urls.judge(pages.limit(0), urls.page_trials(pages.limit(0), labels)).count() == 0


def test_reputation(spark):
    trials = [("good.org", 0)] * 60 + [("spam.org", 1)] * 55 + [("spam.org", 0)] * 5 + [("a.spam.org", None)] + [("new.org", 1)] + [("quiet.org", None)] * 3
    trials += [(f"h{i}.org", 0) for i in range(50) for _ in range(9)]
    found = {r["host"]: r for r in urls.reputation(spark.createDataFrame(trials, "host string, bad int")).collect()}
    assert found["spam.org"]["bound"] > urls.BLOCK_ABOVE > found["good.org"]["bound"]
    assert found["new.org"]["bound"] < urls.BLOCK_ABOVE  # one bad page proves nothing
    assert found["a.spam.org"]["mean"] > found["quiet.org"]["mean"]  # the domain speaks for its hosts
    names = spark.createDataFrame([("a.b.co.uk",), ("x.y.com",), ("com",), ("",)], "h string")
    assert [tuple(r) for r in names.select(urls.domain(F.col("h")), urls.suffix(F.col("h"))).collect()] == [("b.co.uk", "co.uk"), ("y.com", "com"), ("com", "com"), ("", "")]


def families(n, seed, dims=16):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    while i < n:
        base = rng.normal(size=dims)
        for _ in range(int(rng.choice([1, 1, 2, 5, 40]))):
            rows.append((i, (base + rng.normal(size=dims) * 0.02).astype("f4").tolist(), int(rng.integers(2))))
            i += 1
    rows += [(10**6 + k, rows[0][1], rows[0][2]) for k in range(30)]  # equal vectors
    rows += [(2 * 10**6, None, 1), (2 * 10**6 + 1, [0.0] * dims, 1), (2 * 10**6 + 2, [1.0] * dims, None), (2 * 10**6 + 3, [float("nan")] + [1.0] * (dims - 1), 1)]
    rows += [(2 * 10**6 + 4, [], 1), (2 * 10**6 + 5, [None] + [1.0] * (dims - 1), 1), (2 * 10**6 + 6, [float("inf")] * dims, 0), (2 * 10**6 + 7, [1.0], 1)]
    return rows


def brute(rows):
    good = {i: np.array(v, "f8") for i, v, lab in rows if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    label = {i: lab for i, _, lab in rows}
    out = {i: (0, i) for i, _, _ in rows}
    for lab in {label[i] for i in good}:
        for size in {len(v) for v in good.values()}:
            ids = sorted(i for i in good if label[i] == lab and len(good[i]) == size)
            if not ids:
                continue
            x = ann.unit([good[i] for i in ids])
            near = x @ x.T >= 0.98
            np.fill_diagonal(near, False)
            root = local_components(len(ids), np.array(np.nonzero(near)))
            out |= {i: (int(near[k].sum()), ids[root[k]]) for k, i in enumerate(ids)}
    return out


@pytest.mark.parametrize("shard", [1500, 60])
def test_embeddings(spark, monkeypatch, shard):
    monkeypatch.setattr(ann, "SHARD", shard)
    rows = families(700, 3)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1)).withColumn("shard", F.lit("x"))
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in ann.near_duplicates(df).collect()}
    want = brute(rows)
    assert found.keys() == want.keys()
    linked = sum(n for n, _ in want.values())
    assert sum(min(found[i][0], n) for i, (n, _) in want.items()) >= 0.97 * linked
    assert all(found[i][0] <= n for i, (n, _) in want.items())
    assert np.mean([found[i][1] == c for i, (_, c) in want.items()]) >= 0.97
    assert ann.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("url", "doc"),
    [
        ("http://10.0.0.1/x", None),
        ("http://h.org/2024-05-report", None),
        ("http://h.org/a7/x?y=/8/#/9/", None),
        ("http://h.org/en/12/13", 12),
        ("http://h.org/en/14.html?x", 14),
        ("http://h.org/99999999999999999999", None),
        (None, None),
    ],
)
def test_page_names_a_document(spark, url, doc):
    pages = spark.createDataFrame([(1, url)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0) for i in (10, 2024, 7, 8, 9, 12, 13, 14)], "doc_id long, quality int")
    assert [r["bad"] for r in urls.page_trials(pages, labels).collect()] == [1 if doc else None]


def test_labels_block_and_allow(spark):
    """A host of bad pages is blocked, its good neighbour is not; labels alone of a bad domain block a host without any."""
    sites = [("bad.farm.org", 60, 1), ("worse.farm.org", 60, 1), ("good.town.org", 60, 0), ("mixed.town.org", 40, 0.1), ("fine.com", 400, 0)]
    rows, bad, n = [], [], 0
    for site, count, share in sites:
        for k in range(count):
            rows.append((n, f"http://{site}/p/{n}"))
            bad.append((n, int(k >= share * count)))  # quality
            n += 1
    rows += [(n, "http://new.farm.org/x"), (n + 1, "http://new.town.org/x"), (n + 2, "http://one.com/x"), (n + 3, None), (n + 4, "http://bad.farm.net/es/1")]
    pages = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string")
    labels = spark.createDataFrame(bad, "doc_id long, quality int")
    found = {r["host"]: r["verdict"] for r in urls.judge(pages, urls.page_trials(pages, labels)).collect()}
    assert found == {
        "bad.farm.org": "block",
        "worse.farm.org": "block",
        "new.farm.org": "block",
        "good.town.org": "allow",
        "mixed.town.org": "allow",
        "new.town.org": "allow",
        "one.com": "allow",
        "": "allow",
        "fine.com": "allow",
        "bad.farm.net": "block",
    }
    few = labels.where("doc_id < 2")  # two bad pages are not enough
    assert {r["verdict"] for r in urls.judge(pages, urls.page_trials(pages, few)).where("host = 'bad.farm.org'").collect()} == {"allow"}
    assert urls.judge(pages.limit(0), urls.page_trials(pages.limit(0), labels)).count() == 0


def clump(n, seed, least, dims=64):
    """Different vectors in one label with all cosines of at least ``least``, and some far from them."""
    rng = np.random.default_rng(seed)
    off = rng.normal(size=(n, dims - 1))
    off *= np.sqrt((1 - least) / (1 + least)) / np.linalg.norm(off, axis=1, keepdims=True)
    x = np.concatenate([np.ones((n, 1)), off], axis=1)
    far = np.concatenate([np.zeros((50, 1)), rng.normal(size=(50, dims - 1))], axis=1)
    return [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([x, far]))]


def test_clump_larger_than_a_shard(spark):
    n = 10_000
    df = spark.createDataFrame(clump(n, 4, 0.981), "vec_id long, embedding array<float>, label int").repartition(4)
    found = ann.near_duplicates(df).toPandas().sort_values("vec_id")
    assert (found["n_links"][found["vec_id"] < n] == n - 1).all()
    assert (found["component_id"][found["vec_id"] < n] == 0).all()
    assert (found["n_links"][found["vec_id"] >= n] == 0).all()


def test_shard_of_the_nearest_centroid_holds_all_links():
    rng = np.random.default_rng(6)
    x = ann.unit([b + 0.05 * rng.normal(size=6) for b in ann.unit(list(rng.normal(size=(300, 6)))) for _ in range(4)])
    c = ann.fit_centroids(x, 20)
    copies, own = ann.reached(x, c, 0.98), (x @ c.T).argmax(axis=1)
    u, v = np.nonzero(x @ x.T >= 0.98)
    assert copies[v, own[u]].all() and copies.mean() < 1


def clumps(n, each, dims=64):
    """``n`` clumps about orthogonal axes, one label: more than a shard in all, and centroids separate them."""
    rows = [(v, k) for k in range(n) for _, v, _ in clump(each, k, 0.981, dims)[:each]]
    return [(i, np.roll(v, k).tolist(), 0) for i, (v, k) in enumerate(rows)]


@pytest.mark.parametrize("torn", [False, True])
def test_links_of_several_shards(spark, monkeypatch, torn):
    rows = clumps(10, 330)
    sharded, whole = [], ann.divided

    def tear(*args):
        out = whole(*args)
        sharded.append(out)
        return out.withColumn("shard", F.concat_ws(".", "shard", (F.col("node") % 2).cast("string"))) if torn else out

    monkeypatch.setattr(ann, "divided", tear)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in ann.near_duplicates(df).collect()}
    assert sharded[0].select("shard").distinct().count() > 1
    want = brute(rows)
    if torn:  # the audit of the label sees what its shards can't
        assert found == want
    assert sum(min(found[i][0], n) for i, (n, _) in want.items()) >= 0.97 * sum(n for n, _ in want.values())
    assert {i: c for i, (_, c) in found.items()} == {i: c for i, (_, c) in want.items()}


def test_search_that_misses_is_exact_at_last():
    x = ann.unit([v for _, v, _ in clump(300, 2, 0.981)])
    pairs = ann.audited(x, [np.empty(0, np.int64)] * len(x), np.arange(len(x)), 0.98)
    assert pairs.shape[1] == 300 * 299


def test_robust_pruning_keeps_rows_reachable():
    x = ann.unit(list(np.random.default_rng(1).normal(size=(400, 8))))
    lists = ann.pruned(x)
    seen, front = {0}, [0]
    while front:
        front = [int(v) for u in front for v in lists[u] if int(v) not in seen and not seen.add(int(v))]
    assert len(seen) == 400
    pairs = ann.search(x, lists, np.arange(400), 32, 0.9)
    truth = x @ x.T >= 0.9
    np.fill_diagonal(truth, False)
    assert pairs.shape[1] >= 0.95 * truth.sum()


def test_pipeline(spark):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline

    docs = spark.createDataFrame(corpus(), SCHEMA)
    for name in ("_text", "_m", "_lang", "_common", "_words", "_classes", "_kept", "_barrier", "_gone", "_n_kept", "id", "lines", "new", "hi", "key"):
        docs = docs.withColumn(name, F.lit(name))
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        if name != "best_fit_packing":
            assert out.columns == docs.columns
            assert {(r["_text"], r["_m"], r["_gone"], r["id"]) for r in out.collect()} == {("_text", "_m", "_gone", "id")}
        out = spark.createDataFrame(out.collect(), out.schema)
        counts.append(out.count())
        docs = out
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "line_dedup", "near_dedup", "best_fit_packing"]
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0


def test_clean_documents_stay(spark):
    import corpus_pipeline

    rng = random.Random(12)
    words = [f"{a}{b}" for a in "water light house people thing other".split() for b in ("", "s", "ing", "er", "ful")] + ["the", "of", "and"] * 8
    rows = [(i, "\n".join(sentence(rng, words, 30) for _ in range(5)), "en", "s", 0, 1, 2, "c") for i in range(80)]
    rows += [(100 + i, "\n".join(sentence(rng, VOCABULARY["de"], 30) for _ in range(5)), "de", "s", 0, 1, 2, "c") for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, "")
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.count() == 120


def test_counts_are_of_whole_tables(spark):
    assert collections.Counter(r[0] for r in corpus())[1] == 2
