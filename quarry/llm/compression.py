"""Raw-content zstandard dictionaries as class models: the size that a text takes with each is its code length.

A text is cut in pieces of ``PIECE`` bytes, all of which are compressed, each on its own: so a long text cannot
become its own dictionary, and the whole of it counts. Dictionaries are made of a bounded, documented sample of
labelled rows: at most ``rows`` of a class, in the order of a hash of the id, and no further row once their texts have ``size``
bytes. A row that is taken is taken whole, whatever its length.
"""

from __future__ import annotations

import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE = 512
LEVEL = 3
#: Labelled rows of a class that are sampled at most, and bytes of their texts that are enough.
ROWS = 1000
SIZE = 1 << 20
#: Goes before every piece: a run that any compressor shortens, so that no short piece is merely stored.
LEAD = b" " * 64


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, label: str, rows: int = ROWS, size: int = SIZE) -> list[tuple]:
    """``(key, text, label)`` of the first rows of each label, in the order of a hash of the key: whole texts, at most ``rows``, until
    they have ``size`` bytes together.

    ``labels`` holds key and label only, so the choice is made on narrow rows (each partition keeps no more than
    ``rows`` of a label before the exchange); texts are read for the chosen keys alone. Texts that are null or empty are passed over.
    """
    order = Window.partitionBy(label).orderBy(F.xxhash64(key), key)
    chosen = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(key, label)
    chosen = chosen.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= rows)
    picked = sorted(chosen.select(key, label, "_at").collect(), key=lambda r: (str(r[1]), r[2]))  # bounded: rows x labels

    def texts(keys: list, what: Column) -> dict:
        """The greatest value by key, as ids may be repeated."""
        return dict(map(tuple, docs.where(F.col(key).isin(keys)).groupBy(key).agg(F.max(what)).collect())) if keys else {}

    length = texts([r[0] for r in picked], F.octet_length("text"))
    held: dict = {}
    taken = []
    for k, of, _ in picked:
        if length.get(k) and held.get(of, 0) < size:
            held[of] = held.get(of, 0) + length[k]
            taken.append((k, of))
    by_key = texts([k for k, _ in taken], F.col("text"))
    return [(k, by_key[k], of) for k, of in taken if by_key[k]]


def dictionary(texts: list[str], size: int = SIZE) -> bytes:
    """A raw-content dictionary of distinct whole texts, in their order, until it has ``size`` bytes."""
    parts, held = [], 0
    for text in dict.fromkeys(texts):
        if held >= size:
            break
        parts.append(text.encode())
        held += len(parts[-1]) + 1
    return b"\n".join(parts)


def compressor(content: bytes, level: int = LEVEL) -> zstandard.ZstdCompressor:
    if len(content) < 8:  # no dictionary to speak of
        return zstandard.ZstdCompressor(level=level)
    parameters = zstandard.ZstdCompressionParameters.from_level(
        level,
        dict_size=len(content),
        source_size=PIECE,
        write_content_size=0,
        write_dict_id=0,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    model = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=model, compression_params=parameters)


def sizes(data: bytes, compressors: list[zstandard.ZstdCompressor], piece: int = PIECE) -> list[int]:
    """Bytes that the whole of ``data`` takes with each compressor."""
    pieces = [LEAD + data[i : i + piece] for i in range(0, len(data), piece)]
    return [sum([len(c.compress(p)) for p in pieces]) for c in compressors]
