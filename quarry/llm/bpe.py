"""BPE encoding and decoding by prefix-sharing trie traversal.

Distinct words of a batch are put in sorted order, which is the depth-first order of their trie: the
stack holds, for every prefix on the path from the root, the last token of that prefix's encoding, and
a word only extends the stack below the prefix that it shares with the word before. The last token of a
longer prefix follows from the states above it: it is the one token that ends there and forms a stable
pair with the last token of what precedes it, so shared prefixes are encoded once and no merge loop
runs over any word.

Results for odd input: a null text is the empty text (no ids, empty decoding); an empty text likewise;
special tokens spelled out in a text become their own ids, as in the library; long words and long texts
are encoded whole, in time linear in their length. Rows keep their multiplicity; an empty table gives no
rows; columns other than those asked for, whatever their names, are ignored. What a task remembers of its
texts is dropped when it ends.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm.batches import in_batches, tidy

#: Entries that a task remembers in each of two generations; older ones are dropped and made again.
MEMO = 200_000
#: Pairs of a token and what may follow it that a worker remembers.
FOLLOWED = 400_000
END = "</w>"
#: Below this code point, letter and digit classes are the same in every Unicode version in use.
STABLE = 0x0530
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
WORDS_OR_SPACE = regex.compile(WORDS.pattern + "| ")
SPACES = regex.compile("[\t\n\v\f\r \x85\xa0  -     　]+")
ODD = re.compile("[\x1c-\x1f]")
FAR = re.compile(f"[^\\x00-{chr(STABLE - 1)}]")


def byte_letters() -> list[str]:
    """The printable stand-in of every byte, as byte-level vocabularies spell them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class Memo(dict):
    """Ids of pieces of text, in two generations; what neither knows comes out as None and is noted in ``missing``."""

    def __init__(self) -> None:
        super().__init__()
        self.old: dict[str, bytes] = {}
        self.missing: set[str] = set()

    def __missing__(self, chunk: str) -> bytes | None:
        code = self.old.get(chunk)
        if code is None:
            self.missing.add(chunk)
        else:
            self[chunk] = code
        return code

    def age(self) -> None:
        if len(self) > MEMO:
            self.old = dict(self)
            self.clear()


class Encoder:
    """Encoder and decoder of one vocabulary file; one for each task (see ``load``)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.ids: dict[str, int] = model["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.special_re = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for t, i in [*self.ids.items(), *self.special.items()]:
            self.tokens[i] = t
        self.left, self.right = list(range(size)), list(range(size))
        self.merged: dict[int, int] = {}
        for a, b in model["model"]["merges"]:
            i, a, b = self.ids[a + b], self.ids[a], self.ids[b]
            self.left[i], self.right[i] = a, b
            self.merged[a << 20 | b] = i
        self.ends = {t[: -len(END)]: i for t, i in self.ids.items() if t.endswith(END)}
        self.longest = max(map(len, self.ids))
        self.packed = [struct.pack("<I", i) for i in range(size)]
        self.letters = dict(enumerate(byte_letters())) | {10: "\n"}
        # by token (last: at the start): what may follow it inside a word, and to its end; filled as needed
        self.follow: list[dict[str, int]] = [{} for _ in range(size + 1)]
        self.end_follow: list[dict[str, int]] = [{} for _ in range(size + 1)]
        self.followed = 0
        self.new = Memo()

    def stable(self, a: int, b: int) -> bool:
        """Whether the text of ``a`` then ``b`` is encoded as just these two tokens.

        Both are taken apart along the seam, latest merge first; a merge across the seam that comes
        before the merge which hides it would have been made instead.
        """
        first, second, bar, left, right, merged = a, b, 1 << 60, self.left, self.right, self.merged
        while True:
            across = merged.get(first << 20 | second)
            if across is not None and across < bar:
                return False
            # a later merge on the left, or one on the right: undo the later one of the two
            if first > second and right[first] != first:
                bar, first = first, right[first]
            elif left[second] != second:
                bar, second = second + 1, left[second]
            elif right[first] != first:
                bar, first = first, right[first]
            else:
                return True

    def words(self, spelled: Iterable[str]) -> dict[str, bytes]:
        """Ids, as little-endian unsigned 32-bit integers, of words spelled in byte letters.

        Of all tokens that end at a place just one can be the last there, so they are tried from the
        shortest, which is the likeliest.
        """
        longest, packed, follow, grow = self.longest, self.packed, self.follow, self.grow
        end_follow, end_grow = self.end_follow, self.end_grow
        out: dict[str, bytes] = {}
        last, done = [-1], [b""]  # by prefix length: last token (-1: none), and all tokens so far
        before = ""
        for word in sorted(spelled):
            n = len(word)
            shared, most = 0, min(n, len(before)) - 1
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], done[shared + 1 :]
            for i in range(shared + 1, n):
                for j in range(i - 1, max(-1, i - longest - 1), -1):
                    a, piece = last[j], word[j:i]
                    t = follow[a].get(piece)
                    if t is None:
                        t = grow(a, piece)
                    if t >= 0:
                        last.append(t)
                        done.append(done[j] + packed[t])
                        break
            for j in range(n - 1, max(-1, n - longest - 1), -1):
                a, piece = last[j], word[j:]
                t = end_follow[a].get(piece)
                if t is None:
                    t = end_grow(a, piece)
                if t >= 0:
                    out[word] = done[j] + packed[t]
                    break
            before = word
        return out

    def grow(self, a: int, piece: str) -> int:
        """The token spelled ``piece``, if it may come right after token ``a`` (-1: at the start), or -1; remembered."""
        return self._grow(self.follow, self.ids, a, piece)

    def end_grow(self, a: int, piece: str) -> int:
        """The same for the token that ends a word."""
        return self._grow(self.end_follow, self.ends, a, piece)

    def _grow(self, follow: list[dict[str, int]], ids: dict[str, int], a: int, piece: str) -> int:
        t = ids.get(piece, -1)
        if t >= 0 and a >= 0 and not self.stable(a, t):
            t = -1
        self.followed += 1
        if self.followed > FOLLOWED:
            self.followed = 0
            for known in (*self.follow, *self.end_follow):
                known.clear()
        follow[a][piece] = t
        return t

    def spell(self, words: list[str]) -> list[str]:
        """Words in byte letters; none of them holds a line feed."""
        return "\n".join(words).encode().decode("latin-1").translate(self.letters).split("\n") if words else []

    def learn(self, chunks: set[str]) -> None:
        """Remember the ids of pieces of text without white space."""
        marked = self.special_re
        parts: list[str] = []  # pieces to encode
        rebuilt: dict[str, list[str]] = {}  # pieces that hold special tokens
        if marked:
            for c in chunks:
                if "<|" in c and marked.search(c):
                    rebuilt[c] = [x for x in marked.split(c) if x]
            plain = chunks.difference(rebuilt)
            plain.update(x for xs in rebuilt.values() for x in xs if x not in self.special)
        else:
            plain = chunks
        near, far = [], []
        for c in plain:
            (far if FAR.search(c) else near).append(c)
        del plain
        new = self.new
        for at in range(0, len(near), 50_000):
            some = near[at : at + 50_000]
            line = self.normalizer.normalize_str(" ".join(some))
            if FAR.search(line) or line.count(" ") != len(some) - 1:
                far += some  # normalising led out of the stable range, or away from one piece a word
                continue
            found = WORDS_OR_SPACE.findall(line)
            distinct = list(set(found).difference((" ",)))
            spelled = self.spell(distinct)
            coded = self.words(spelled)
            of = {w: coded[x] for w, x in zip(distinct, spelled, strict=True)}
            del coded
            i = 0
            for c in some:
                code = b""
                while i < len(found):
                    w = found[i]
                    i += 1
                    if w == " ":
                        break
                    code += of[w]
                new[c] = code
        for at in range(0, len(far), 10_000):
            some = far[at : at + 10_000]
            split = [[w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(c))] for c in some]
            coded = self.words(w for ws in split for w in ws)
            new.update((c, b"".join(map(coded.__getitem__, ws))) for c, ws in zip(some, split, strict=True))
        for c, xs in rebuilt.items():
            new[c] = b"".join([self.packed[self.special[x]] if x in self.special else new[x] for x in xs])

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of every whole text, as bytes of little-endian unsigned 32-bit integers."""
        group: list[list[str]] = []
        held = 0
        for text in texts:
            chunks = [] if not text else text.split() if not ODD.search(text) else [c for c in SPACES.split(text) if c]
            group.append(chunks)
            held += len(chunks)
            if held > 200_000:
                yield from self._encode(group)
                group, held = [], 0
        yield from self._encode(group)

    def _encode(self, group: list[list[str]]) -> Iterator[bytes]:
        new = self.new
        new.age()
        get = new.__getitem__
        coded = [list(map(get, chunks)) for chunks in group]
        missing, new.missing = new.missing, set()
        self.learn(missing)
        for chunks, codes in zip(group, coded, strict=True):
            try:
                yield b"".join(codes)
            except TypeError:  # some were missing
                yield b"".join([get(c) if code is None else code for c, code in zip(chunks, codes, strict=True)])

    def decode(self, ids: Iterable[int]) -> str:
        """As the library decodes with special tokens kept: the file names no decoder, so tokens are joined by spaces."""
        return " ".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=1)
def load(path: str) -> Encoder:
    """The encoder of a task; ``load.cache_clear`` at its end, as a worker goes on to other things with what it holds."""
    return Encoder(path)


def encode_with(
    docs: DataFrame, path: str, project: Callable[[Encoder, pa.Array, Iterator[bytes]], pa.RecordBatch], schema: str
) -> DataFrame:
    """Encode ``doc_id, text`` and hand each batch's ids to ``project`` in the same pass, so that ids need not leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(path)
        for batch in batches:
            yield project(encoder, batch.column(0), encoder.encode(batch.column(1).to_pylist()))

    return in_batches(docs.select("doc_id", "text")).mapInArrow(tidy(run, load.cache_clear), schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids array<bigint>`` of every whole text."""

    def project(encoder: Encoder, doc_ids: pa.Array, ids: Iterator[bytes]) -> pa.RecordBatch:
        rows = [np.frombuffer(b, "<u4").astype("i8") for b in ids]
        return pa.RecordBatch.from_arrays([doc_ids, pa.array(rows, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return encode_with(docs, path, project, "doc_id long, ids array<long>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``; null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(path)
        for batch in batches:
            texts = [encoder.decode(i or []) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return in_batches(encoded.select("doc_id", F.col("ids").cast("array<long>").alias("ids"))).mapInArrow(tidy(run, load.cache_clear), "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Number of ids and digests of the ids and of their decoding, of every whole text."""

    def project(encoder: Encoder, doc_ids: pa.Array, ids: Iterator[bytes]) -> pa.RecordBatch:
        n, hashed, decoded = [], [], []
        for b in ids:
            n.append(len(b) // 4)
            hashed.append(hashlib.sha256(b).hexdigest())
            decoded.append(hashlib.sha256(encoder.decode(np.frombuffer(b, "<u4").tolist()).encode()).hexdigest())
        columns = [doc_ids, pa.array(n, pa.int64()), pa.array(hashed, pa.string()), pa.array(decoded, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encode_with(docs, path, project, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
