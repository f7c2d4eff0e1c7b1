"""Ids of whole texts, as the tokenizers library gives them, with each distinct word encoded once.

The library spends most of its time on normalising and splitting, and on words that it has seen. Here a text of Latin
letters is lower-cased and cut into the library's words by one expression, and only words that are not remembered go to
the library's model. Other texts, and those that spell out a special token, are cut at white space, which no word and no special
token holds; their pieces that are not remembered are taken likewise if Latin, and go through the whole library if not.

Results for odd input: a null or empty text has no ids; long texts and long words are encoded whole. The vocabulary's normalizer and
splitter must be those of ``word_bpe_49k.json``: NFC, white space, lower case; words of letters, single digits, the rest.
"""

from __future__ import annotations

import re
import struct
import unicodedata

from tokenizers import Tokenizer

from quarry.llm.bpe import ODD, SPACES, byte_letters

#: Entries that an encoder remembers in each of two generations, of pieces up to ``LONG`` characters; older ones are dropped and made again.
MEMO = 200_000
LONG = 100
#: Up to ``LATIN`` there are no combining marks, and letters but İ lower-case one by one, to letters up to ``LOWER``.
LATIN, LOWER = 0x0239, 0x02AF
#: What is not Latin, or white space to Python but not to the library.
NOT_LATIN = re.compile(f"[^\\x00-\\x1b\\x20-\\u012f\\u0131-{chr(LATIN)}]")


def latin_words() -> re.Pattern[str]:
    """The words of lower-cased Latin text."""
    letters, digits = ("".join(re.escape(c) for c in map(chr, range(LOWER + 1)) if unicodedata.category(c)[0] == k) for k in "LN")
    return re.compile(f"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{digits}]|[^{letters}{digits}\\t\\n\\v\\f\\r \\x85\\xa0]+")


LATIN_WORDS = latin_words()


class Codes(dict):
    """Ids of pieces of text, as bytes of little-endian unsigned 32-bit integers, in two generations.

    A word of a Latin text is the only word of itself, so words and pieces between white space are remembered together.
    """

    def __init__(self, library: Tokenizer) -> None:
        super().__init__()
        self.old: dict[str, bytes] = {}
        self.library, self.tokenize = library, library.model.tokenize
        special = [re.escape(t.content) for t in library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special)) if special else None
        self.letters = dict(enumerate(byte_letters()))
        self.packed = [struct.pack("<I", i) for i in range(max(library.get_vocab(with_added_tokens=True).values()) + 1)]

    def is_latin(self, text: str) -> bool:
        return not NOT_LATIN.search(text) and not (self.special and self.special.search(text))

    def __missing__(self, piece: str) -> bytes:
        code = self.old.get(piece)
        if code is None:
            code = self.encode(piece)
        if len(piece) <= LONG:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[piece] = code
        return code

    def encode(self, piece: str) -> bytes:
        packed = self.packed
        if self.is_latin(piece):
            words = LATIN_WORDS.findall(piece.lower())
            if words != [piece]:
                return b"".join(map(self.__getitem__, words))
            spelled = piece if piece.isascii() and piece.isalpha() else piece.encode().decode("latin-1").translate(self.letters)
            return b"".join([packed[t.id] for t in self.tokenize(spelled)])
        return b"".join([packed[i] for i in self.library.encode(piece, add_special_tokens=False).ids])


class Encoder:
    """Encoder of one vocabulary file; what it remembers goes with it."""

    def __init__(self, path: str) -> None:
        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        self.codes = Codes(library)

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, as bytes of little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.codes.is_latin(text):
            pieces = LATIN_WORDS.findall(text.lower())
        else:
            pieces = text.split() if not ODD.search(text) else [c for c in SPACES.split(text) if c]
        return b"".join(map(self.codes.__getitem__, pieces))
