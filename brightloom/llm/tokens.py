"""Token ids of whole texts, one library call for each distinct piece of text.

A word-level BPE first splits a text into pieces that never join again. Each
worker keeps the ids of the pieces it has met, up to a bound, and asks the
tokenizers library's model for new ones only. That holds for text of printable
Latin characters, split by the tokenizer file's own pattern; a word with any
other character is given to the library whole, since white space always
separates. A tokenizer file of another make is used on whole texts.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa

CACHED_PIECES = 1 << 19
TEXT_AT_ONCE = 1 << 22  # bytes of text encoded into one batch of results
LATIN = range(0x250)
#: Only characters whose lower case is Latin as well: the split's classes know no others.
_CASED = "".join(chr(c) for c in LATIN[0xA1:] if all(ord(x) in LATIN for x in chr(c).lower()))
_PLAIN = re.compile(f"[\t\n\r -;=-~{_CASED}]*")  # no "<": it may begin an added token


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte that byte-level BPE works on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, spare = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in table:
            table[b] = chr(spare)
            spare += 1
    return [table[b] for b in range(256)]


def _latin(pattern: str) -> re.Pattern:
    """The split pattern for text of Latin characters, letters and numbers spelled out."""
    for kind in "LN":
        members = "".join(re.escape(chr(c)) for c in LATIN if unicodedata.category(chr(c))[0] == kind)
        pattern = pattern.replace(f"[\\p{{{kind}}}]", f"[{members}]").replace(f"\\p{{{kind}}}", members)
    return re.compile(pattern)


class _Pieces(dict):
    """Ids of each piece met so far, in the narrowest little-endian type."""

    def __init__(self, encode, width: str):
        self.encode, self.kind = encode, "H" if width == "<u2" else "I"

    def __missing__(self, piece: str) -> bytes:
        self[piece] = ids = pack(f"<{len(found := self.encode(piece))}{self.kind}", *found)
        return ids


class Encoder:
    """Encodes texts without special tokens, as ``Tokenizer.encode`` does."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.width = id_width(self.vocabulary)
        self.model = self.tokenizer.model
        self.split: re.Pattern | None = None
        normal = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        before = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if normal == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in before] == ["Split", "ByteLevel"] and before[0]["invert"] and not before[1]["use_regex"]:
            self.split = _latin(before[0]["pattern"]["Regex"])
            self.letters = _byte_letters()
            self.pieces = _Pieces(self._piece, self.width)

    def _piece(self, piece: str) -> list[int]:
        letters = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
        return [t.id for t in self.model.tokenize(letters)]

    def _latin_ids(self, text: str) -> np.ndarray:
        found = self.split.findall(text.lower())
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, found)), self.width)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text in the narrowest type that holds them."""
        if self.split is None:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.width)
        if len(self.pieces) > CACHED_PIECES:
            self.pieces = _Pieces(self._piece, self.width)
        if _PLAIN.fullmatch(text):
            return self._latin_ids(text)
        parts, run = [], []
        for word in text.replace("\n", " ").split(" "):
            if _PLAIN.fullmatch(word):
                run.append(word)
                continue
            parts.append(self._latin_ids(" ".join(run)))
            parts.append(np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, self.width))
            run = []
        parts.append(self._latin_ids(" ".join(run)))
        return np.concatenate(parts)


def text_slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about ``TEXT_AT_ONCE`` bytes of text, so that results stay small."""
    begin, held = 0, 0
    for i, text in enumerate(batch.column(column)):
        held += text.as_buffer().size
        if held >= TEXT_AT_ONCE:
            yield batch.slice(begin, i + 1 - begin)
            begin, held = i + 1, 0
    if begin < batch.num_rows:
        yield batch.slice(begin)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def id_width(vocabulary: int) -> str:
    """The narrowest little-endian type that holds every id."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"
