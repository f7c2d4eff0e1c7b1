"""Operators on documents, against brute force or the library they must agree with."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import bpe, langid, lines, minhash, packing, quality, rules, shards, shingles, tokens
from quarry.llm.unionfind import components

from .conftest import SCHEMA, VOCABULARY, corpus, sentence

PATH = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def closed(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# --- BPE

ODD = ["", None, "a", "The cat's 12 dogs!!", "<|endoftext|> x<|startoftext|>y", "Σίσυφος İstanbul ß ﬁ", "中文 ど", "e\u0301 \x1c\x85 \u2003z", "</w> <| a|>", "q" * 5000, "'ll 'LL don't"]


def test_encoder_is_the_library():
    rng = random.Random(2)
    letters = ["a", "th", "ing", "'s", "é", "É", "1", "!", "..", " ", "\n", "tion", "\u0308", "ı", "\x00", "<|endoftext|>"]
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    library, encoder = Tokenizer.from_file(PATH), bpe.Encoder(PATH)
    for text, mine in zip(texts, encoder.encode(texts), strict=True):
        theirs = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(mine, "<u4").tolist() == theirs, text
        assert encoder.decode(theirs) == library.decode(theirs, skip_special_tokens=False)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 50)
    rng = random.Random(3)
    texts = [sentence(rng, VOCABULARY["de"], 30) + str(rng.random()) for _ in range(200)]
    encoder, library = bpe.Encoder(PATH), Tokenizer.from_file(PATH)
    for _ in range(3):
        for text, mine in zip(texts, encoder.encode(texts), strict=True):
            assert np.frombuffer(mine, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_digests(docs, none):
    library = Tokenizer.from_file(PATH)
    want = collections.Counter()
    for row in corpus():
        ids = library.encode(row[1] or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        back = library.decode(ids, skip_special_tokens=False)
        want[(row[0], len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest())] += 1
    assert collections.Counter(tuple(r) for r in bpe.round_trip_digests(docs, PATH).collect()) == want
    assert bpe.round_trip_digests(none, PATH).count() == 0


def test_encode_and_decode(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    encoded = bpe.encode(df, PATH)
    library = Tokenizer.from_file(PATH)
    for r in encoded.collect():
        assert list(r["ids"]) == library.encode(ODD[r["doc_id"]] or "", add_special_tokens=False).ids
    assert bpe.decode(encoded, PATH).count() == len(ODD)


# --- packing


def ids(encoder, text):
    return np.frombuffer(encoder.encode(text), "<u4").tolist()


def test_packed_ids_are_the_library_s(monkeypatch):
    """All Latin characters and some others, in every kind of neighbourhood, with a memory of 50 pieces."""
    monkeypatch.setattr(tokens, "MEMO", 50)
    rng = random.Random(4)
    letters = ["a", "Th", "ing", "'s", "'LL", "É", "²", "½", "9", "!", "..", " ", "\n", "ŉ", "Ɓ", "Ⱥ", "İ", "ı", "Σ", "\u0308", "\x00", "\x1c", "\x85", "\xa0", "中", "<|endoftext|>", "<|ENDOFTEXT|>"]
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += [f"x{c}1{c}{c} {c}'s A'{c}'{c}S !'{c}%. {c}" for c in map(chr, range(0x300))]
    library, encoder = Tokenizer.from_file(PATH), tokens.Encoder(PATH)
    for text in texts:
        assert ids(encoder, text) == library.encode(text or "", add_special_tokens=False).ids, text
    assert len(encoder.codes) <= 50 and len(encoder.codes.old) <= 50


def test_packing_encodes_a_word_once():
    """Whatever its case, the punctuation around it and the text it comes in: most of the time goes to words that are seen first."""
    encoder, asked = tokens.Encoder(PATH), collections.Counter()
    tokenize = encoder.codes.tokenize
    encoder.codes.tokenize = lambda word: asked.update([word]) or tokenize(word)
    for text in ("The sea, the isle.", "THE SEA; the isle! (sea)", "Isle: sea.", "the\tsea\nisle", "The sea \u2013 the isle!"):
        encoder.encode(text)
    assert set(asked.values()) == {1} and asked.keys() == {"the", "sea", "isle", ",", ".", ";", "!", "(", ")", ":"}


@pytest.mark.parametrize("seed", range(30))
def test_patterns_use_every_piece(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 50, 100])
    counts = {rng.randint(1, capacity): rng.randint(1, 9) for _ in range(rng.randint(1, 10))}
    found, used = packing.bin_completion(counts, capacity).patterns, collections.Counter()
    for filling, bins in found:
        assert bins > 0 and sum(n * c for n, c in filling) <= capacity
        for n, c in filling:
            used[n] += c * bins
    assert used == collections.Counter(counts)
    bins = sum(p.bins for p in found)
    assert packing.lower_bound(counts, capacity) <= bins <= sum(p.bins for p in packing.best_fit(counts, capacity))


def fewest_bins(pieces, capacity):
    """By trying every way: pieces longest first, each in every bin with room (equal rooms once), or in a new one."""
    pieces = sorted(pieces, reverse=True)
    best = len(pieces)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(pieces):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= pieces[i]:
                left = list(rooms)
                left.remove(room)
                go(i + 1, [*left, room - pieces[i]])
        go(i + 1, [*rooms, capacity - pieces[i]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(60))
def test_search_finds_the_fewest_bins(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 20, 31])
    pieces = [rng.randint(2, capacity * 2 // 3) for _ in range(rng.randint(5, 12))]
    found = packing.bin_completion(dict(collections.Counter(pieces)), capacity)
    assert found.proved and found.bins == sum(p.bins for p in found.patterns) == fewest_bins(pieces, capacity)
    assert found.bound <= found.bins


def test_search_beats_best_fit():
    counts = {6: 2, 5: 2, 4: 2, 3: 2, 2: 2}  # 40 in 4 bins of 10, exactly
    assert packing.bin_completion(counts, 10).bins == 4
    counts = {10: 30, 4: 30, 3: 60}  # 30 bins of 10, 4, 3 and 3; best fit takes 31
    found = packing.bin_completion(counts, 20)
    assert found.bins == 30 and found.proved and sum(p.bins for p in packing.best_fit(counts, 20)) == 31


def test_completions_are_the_undominated_fillings():
    """Against all maximal fillings, compared two by two: each one tried is dominated by none, and what is left out is dominated by one tried."""
    rng = random.Random(7)
    for _ in range(60):
        left = {rng.randint(1, 12): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        room = rng.randint(3, 20)
        every = [()]
        for n, c in left.items():
            every = [(*f, *([n] * k)) for f in every for k in range(c + 1)]
        every = {tuple(sorted(f, reverse=True)) for f in every if sum(f) <= room}

        def covers(big, small):
            """Whether ``small`` can be packed in bins of the sizes in ``big``."""
            return not small or any(x >= small[0] and covers((*big[:i], x - small[0], *big[i + 1 :]), small[1:]) for i, x in enumerate(big))

        found = {tuple(n for n, c in f for _ in range(c)) for f in packing.completions(dict(left), room, room, [10**6])}
        assert found <= every
        for f in every:
            if f not in found:
                assert any(covers(g, f) for g in found), (left, room, f, found)
        assert not any(f != g and covers(g, f) and sum(g) >= sum(f) and g > f for f in found for g in found)


def test_pack_keeps_columns(spark, monkeypatch):
    """Hot lengths of null ids are ranked in cells; columns named as the operator's own are kept."""
    monkeypatch.setattr(packing, "CELL", 10)
    df = spark.createDataFrame([(None, 5, i, 0, 1) for i in range(100)] + [(1, 7, 0, 0, 1)], "doc_id long, length long, _rank int, `offset` int, `id` int")
    found = packing.pack(df, 20).toPandas()
    assert list(found.columns) == [*df.columns, "sequence_id", "offset_"]
    assert sorted(found["_rank"]) == sorted([*range(100), 0]) and found["sequence_id"].nunique() == 26
    for _, part in found.sort_values("offset_").groupby("sequence_id"):
        assert (part["offset_"].to_numpy() == part["length"].cumsum().shift(fill_value=0).to_numpy()).all() and part["length"].sum() <= 20


@pytest.mark.parametrize("cell", [200_000, 3])
def test_packing(docs, none, monkeypatch, cell):
    monkeypatch.setattr(packing, "CELL", cell)
    found = [r.asDict() for r in packing.pack_documents(docs, PATH).collect()]
    library = Tokenizer.from_file(PATH)
    want = collections.Counter()
    for row in corpus():
        ids = library.encode(row[1] or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[(row[0], k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    by = collections.defaultdict(list)
    for r in found:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(by) == -(-sum(r["length"] for r in found) // 2048)
    assert packing.pack_documents(none, PATH).count() == 0


# --- near-duplicates


def brute_groups(rows, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = []
    for row in rows:
        words = WORD.findall((row[1] or "").translate(lower))
        found.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    pairs = []
    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None or not found[a] or not found[b]:
                continue
            shared = len(found[a] & found[b])
            if 100 * shared >= percent * (len(found[a]) + len(found[b]) - shared):
                pairs.append((a, b))
    # rows of one id count as one
    first = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            pairs.append((i, first.setdefault(row[0], i)))
    root = closed(len(rows), pairs)
    least = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            least[root[i]] = min(least.get(root[i], row[0]), row[0])
    return collections.Counter((row[0], len(found[i]), least.get(root[i]) if row[0] is not None else None) for i, row in enumerate(rows))


def test_near_duplicates(docs, none):
    found = minhash.near_duplicates(docs, 85).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == brute_groups(corpus(), 85)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in found)
    assert minhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("block", [2048, 4])
def test_chains_of_near_copies(spark, monkeypatch, block):
    """Copies that drift away from the first, in one big family: links that no first member sees; small blocks force splitting."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(8)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(160)]
    rows = []
    for i in range(60):
        rows.append((i * 3 % 61, " ".join(words), None, None, None, None, None, None))
        words[rng.randrange(160)] = f"v{i}"
    rows.append((500, " ".join(f"u{i}" for i in range(160)), None, None, None, None, None, None))
    df = spark.createDataFrame(rows, SCHEMA)
    found = collections.Counter((r[0], r[1], r[2]) for r in minhash.near_duplicates(df, 85).collect())
    assert found == brute_groups(rows, 85)


@pytest.mark.parametrize("block", [1024, 8])
def test_template_families(spark, monkeypatch, block):
    """Members that are 70 to 90 % alike: candidates by the hundred, links only from 85 % on."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(21)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(70):
        words, at = list(base), rng.randrange(150)
        n = rng.randrange(4, 46)
        words[at : at + n] = [f"x{i}.{k}" for k in range(n)]
        rows.append((i, " ".join(words), None, None, None, None, None, None))
    found = collections.Counter((r[0], r[1], r[2]) for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), 85).collect())
    assert found == brute_groups(rows, 85)


def test_pigeonhole():
    """Every pair within reach shares a key, wherever its errors are."""
    rng = np.random.default_rng(4)
    most = minhash.reach(85)
    chunks = list(range(most // 2 + 1))
    for _ in range(300):
        a = rng.integers(0, 1 << 16, shingles.SYMBOLS).astype(np.uint16)
        b = a.copy()
        b[rng.choice(shingles.SYMBOLS, most, replace=False)] ^= np.uint16(1)
        ka, kb = minhash._chunk_keys(np.stack([a, b]), chunks)
        assert set(ka.tolist()) & set(kb.tolist())


def test_union_find(spark):
    rng = random.Random(9)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 400)] + [(5, 5), (None, 3)]
    df = spark.createDataFrame(pairs, "a long, b long")
    real = [(a, b) for a, b in pairs if a is not None and a != b]
    root = closed(500, real)
    assert {tuple(r) for r in components(df).collect()} == {(n, root[n]) for p in real for n in p}
    assert components(df.limit(0)).count() == 0


# --- lines


def test_lines(docs, none):
    rows = corpus()
    first = {}
    for row in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        for k, x in enumerate(lines.normal_lines(row[1])):
            if x:
                first.setdefault(x, (row[0], k))
    every = list(first)
    sets = [lines.shingle_set(x) for x in every]
    pairs = [(a, b) for a in range(len(every)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = closed(len(every), pairs)
    stay = collections.defaultdict(lambda: (1 << 60, 0))
    for i, x in enumerate(every):
        stay[root[i]] = min(stay[root[i]], first[x])
    stay = set(stay.values())
    want = collections.Counter()
    for row in rows:
        text = row[1]
        if row[0] is not None and text is not None:
            text = "\n".join(x for k, x in enumerate(text.split("\n")) if not x.strip(lines.SPACE) or (row[0], k) in stay)
        want[(row[0], text)] += 1
    found = lines.dedup_lines(docs)
    assert collections.Counter((r["doc_id"], r["text"]) for r in found.collect()) == want
    assert found.columns == [*docs.columns, "n_lines", "n_kept"]
    assert lines.dedup_lines(none).count() == 0


def brute_links(every, percent=80):
    sets = [lines.shingle_set(x) for x in every]
    return {(b, a) for a in range(len(every)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}


@pytest.mark.parametrize("few", [1, 12])
def test_group_links(few, monkeypatch):
    """Both ways to compare a group equal brute force on all of its pairs."""
    monkeypatch.setattr(lines, "FEW", few)
    rng = random.Random(4)
    base = "".join(rng.choice("abcde ") for _ in range(60)).strip()
    every = sorted({b" ".join((base[: rng.randrange(5, 60)] + rng.choice("xyz\u00e9") * rng.randrange(4)).encode().split()) for _ in range(90)})
    want = {(b, a) for b, a in brute_links(every) if a // 30 == b // 30}
    r, c = lines.group_links(np.arange(len(every)) // 30, np.arange(len(every)), every, 80)
    found = {(int(min(a, b)), int(max(a, b))) for a, b in zip(r, c, strict=True)}
    assert found <= want and want and closed(len(every), found) == closed(len(every), want)


@pytest.mark.parametrize("block", [8, 1024])
def test_short_lines(spark, block, monkeypatch):
    """Lines of 9 to 40 characters, with one character less or another end, give the components of brute force, in blocks or not."""
    monkeypatch.setattr(lines, "BLOCK", block)
    rng = random.Random(11)
    every = set()
    for _ in range(300):
        x = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(9, 41)))
        every |= {x, x[:-1], x + "s", x[: len(x) - 2] + "qq"}
    every |= {f"a line that many share {i:02d}" for i in range(40)}
    every = sorted(every)
    df = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")
    root = closed(len(every), brute_links([x.encode() for x in every]))
    found = {r["doc_id"]: r["text"] for r in lines.dedup_lines(df).collect()}
    assert found == {i: x if root[i] == i else "" for i, x in enumerate(every)}


def test_lines_names(spark):
    """Columns named as the operator's own pass through; without lines left, documents can be dropped; null ids stay."""
    schema = "doc_id long, text string, _n_kept int, n_lines int, n_kept int, `id` string, `row` string, lines string, new string, hi int, component int"
    rows = [(1, "one line", 1, 2, 3, "a", "b", "c", "d", 4, 5), (2, "one  LINE", 6, 7, 8, "e", "f", "g", "h", 9, 10), (None, "one line", None, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    found = lines.dedup_lines(df)
    assert found.columns == [*df.columns, "n_lines_", "n_kept_"]
    assert {tuple(r) for r in found.collect()} == {(*rows[0], 1, 1), (2, "", *rows[1][2:], 1, 0), (*rows[2], 1, 1)}
    assert {r["doc_id"] for r in lines.dedup_lines(df, drop_emptied=True).collect()} == {1, None}


def test_fuzzy_lines(spark):
    base = "a line of some length that stands in many documents, with a date in it: 2021"
    texts = [base + "\nown line of the first", base.replace("2021", "2022"), base.upper() + "\n\nanother thing altogether", "short", "short"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["text"] for r in lines.dedup_lines(df).collect()}
    assert found == {0: texts[0], 1: "", 2: "\nanother thing altogether", 3: "short", 4: ""}


# --- language, quality, rules


def test_language(docs, none):
    found = langid.identify(docs).collect()
    by = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    for row in corpus()[:120]:
        assert by[row[0]]["lang_pred"] == row[2]
    for i in (203, 204, 205, 206):
        assert by[i]["lang_pred"] == "und" and by[i]["rejected"]
    assert all(0 <= r["score"] <= 1 for r in found) and len(found) == len(corpus())
    assert by[1]["held_out"] == (zlib.crc32(b"1") % 3 == 1)
    assert langid.identify(none).count() == 0
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and {203, 204, 205, 206}.isdisjoint(r["doc_id"] for r in kept.select("doc_id").collect())


def test_long_texts_are_learned_whole(spark):
    """A language whose labelled texts are all long, and begin in another one, is learned from what follows."""
    rng = random.Random(13)
    start = sentence(rng, VOCABULARY["en"], 300)
    rows = [(i, sentence(rng, VOCABULARY["en"], 60), "en") for i in range(40)]
    rows += [(100 + i, start + " " + sentence(rng, VOCABULARY["de"], 6000), "de") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, df.select("doc_id", "lang"))
    asked = spark.createDataFrame([(1, sentence(rng, VOCABULARY["de"], 40)), (2, sentence(rng, VOCABULARY["en"], 40))], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict(asked, model).collect()} == {1: "de", 2: "en"}


def test_quality_of_empty_tables(spark, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    assert quality.assess(none, labels).count() == 0
    lone = spark.createDataFrame([(9, "a text")], "doc_id long, text string")
    assert 0 < quality.assess(lone, labels).first()["score"] < 1


def test_quality(spark, docs, none):
    rng = random.Random(1)
    good = [(i, sentence(rng, VOCABULARY["en"], 60)) for i in range(300)]
    bad = [(i + 300, " ".join(f"{w}$$$ {w.upper()}!!" for w in sentence(rng, VOCABULARY["de"], 30).split())) for i in range(100)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(400)] + [(None, 1), (7, None)], "doc_id long, quality int")
    found = quality.assess(df, labels).collect()
    held = [r for r in found if r["held_out"]]
    assert len(held) > 40 and all(r["predicted"] == int(r["doc_id"] < 300) for r in held)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in found)
    model = quality.fit(df, labels)
    assert quality.score(docs, model).count() == len(corpus())
    assert quality.assess(none, labels.limit(0)).count() == 0
    lonely = quality.score(docs, quality.fit(df, labels.where("quality = 1"))).select("score").distinct().collect()
    assert len(lonely) == 1


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = collections.defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    repeated = {j for at in windows.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    seen, duplicates = set(), 0
    for x in text.split("\n"):
        if WORD.search(x):
            duplicates += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), duplicates, len(repeated)


def test_rules(docs, none):
    found = rules.assess(docs).collect()
    want = collections.Counter((r[0], *brute_counts(r[1])) for r in corpus())
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert collections.Counter(tuple(r[n] for n in names) for r in found) == want
    for r in found:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert rules.assess(none).count() == 0
    kept = rules.kept(docs)
    assert kept.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == collections.Counter(r["doc_id"] for r in found if r["kept"])


def test_divergence(spark):
    rng = random.Random(6)
    plain = [(i, sentence(rng, VOCABULARY["en"], 200), "en") for i in range(60)]
    odd = [(100, " ".join(w.upper() + "###" for w in sentence(rng, VOCABULARY["en"], 200).split()), "en")]
    df = spark.createDataFrame(plain + odd, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in rules.assess(df).collect()}
    assert not found[100]["base_failed"] and not found[100]["kept"]
    assert sum(r["kept"] for r in found.values()) == 60


# --- shards


def test_shards(docs, none):
    found = shards.shard(docs).collect()
    assert len(found) == len(corpus())
    by = collections.defaultdict(list)
    for r in found:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(40))
    sizes = collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found)
    assert sizes == collections.Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in corpus())
    assert shards.shard(none).count() == 0


def test_placement_by_dot_product():
    """Against a plain re-statement: largest first, each to the highest dot product with what is left."""
    rng = np.random.default_rng(3)
    need = rng.random((200, 3)) * np.array([0.3, 0.2, 0.1])
    left, want = [[1.0] * 3 for _ in range(7)], {}
    for i in sorted(range(200), key=lambda i: (-max(need[i]), i)):
        dots = [sum(a * b for a, b in zip(r, need[i], strict=True)) for r in left]
        want[i] = dots.index(max(dots))
        left[want[i]] = [a - b for a, b in zip(left[want[i]], need[i], strict=True)]
    found, residual = shards.place(need, 7)
    assert found.tolist() == [want[i] for i in range(200)] and np.allclose(residual, left)


@pytest.mark.parametrize("chunk", [8, 1024])
def test_small_groups_are_placed_whole(spark, chunk, monkeypatch):
    """With a coarse bound for large groups most are placed by the tasks: shards stay balanced, groups whole, slots gapless; a hot group
    of null ids is split."""
    monkeypatch.setattr(shards, "CHUNK", chunk)
    monkeypatch.setattr(shards, "CELL", 50)
    monkeypatch.setattr(shards, "PARTS", 4)
    rng = random.Random(2)
    rows = [(i % 5000, f"text {i % 9000} " + "word " * ((i % 9000) % 40)) for i in range(10_000)] + [(None, "hot text of many")] * 4000
    rng.shuffle(rows)
    found = shards.shard(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert len(found) == len(rows)
    for _, part in found.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    for column, most in (("size", 0.04), ("tokens", 0.04)):
        by = found.groupby("shard")[column].sum()
        assert len(by) == 40 and by.max() - by.min() < most * by.mean()
    n = found.groupby("shard").size()
    assert n.max() - n.min() < 0.04 * n.mean() + 4
    hot = zlib.crc32(b"hot text of many")
    assert found[found["text_crc32"] != hot].groupby("text_crc32")["shard"].nunique().max() == 1
    assert found[found["text_crc32"] == hot]["shard"].nunique() > 5


def test_hot_group_is_split(spark):
    rows = [(i, "same text") for i in range(4000)] + [(i + 4000, f"text number {i} " * (i % 7 + 1)) for i in range(8000)]
    found = shards.shard(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    assert len(found) == 40 and all(r["m"] == r["n"] - 1 for r in found)
    b = [r["b"] for r in found]
    assert max(b) - min(b) < 0.02 * max(b)
    whole = shards.shard(spark.createDataFrame(rows[3950:], "doc_id long, text string")).where("text_crc32 = %d" % zlib.crc32(b"same text"))
    assert whole.select("shard").distinct().count() == 1
