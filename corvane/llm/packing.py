"""Packing by power-of-two decomposition: a document's ids are cut into pieces of binary length, largest first.

Every piece is a sequence of its own in the bucket of its length, so no sequence crosses documents and none needs
padding. A document of T ids has T // max_len pieces of `max_len` and one piece per set bit of the rest. Ids are
those of the tokenizers library followed by one end id. Pre-tokens are met again and again, so their ids are
remembered in a bounded table per worker; byte-level BPE never merges across pre-tokens, so the ids are the same.

The name of a special token in a text is ordinary text, as the vocabulary's description has it (`encode_special_tokens`):
a document must not be able to write a control id. With `special_as_text=False` such names become their ids.

Nulls: a null text is empty and has only the end id; a null doc_id stays null. Repeated rows are packed one by one.
A very long text is tokenised whole. No rows: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import blocks

MAX_LEN, END_ID = 2048, 1
#: Pre-tokens that a worker remembers at most.
MEMO = 600_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


#: The pre-token pattern of the vocabulary in the standard library's terms, for texts without `_unlike` characters.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall


@lru_cache(maxsize=1)
def _unlike() -> re.Pattern:
    """Characters that the standard library may class otherwise than the tokenizer: numbers that are no decimal
    digits, separators U+001C-1F and U+0085, U+180E, those unassigned or private, and all beyond the basic plane."""
    odd = [c for c in range(0x10000) if unicodedata.category(chr(c)) in ("Nl", "No", "Cn", "Co", "Cs") or c in (*range(0x1C, 0x20), 0x85, 0x180E)]
    odd_set, ranges = set(odd), []
    for c in odd:
        if c - 1 not in odd_set:
            ranges.append([c, c])
        ranges[-1][1] = c
    return re.compile("[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in ranges) + "\U00010000-\U0010ffff]")


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class _Memo(dict):
    """Pre-token -> its ids as little-endian 32-bit bytes."""

    def __init__(self, path: str, special_as_text: bool) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.merge, self.letters, self.odd = self.tokenizer.model.tokenize, _byte_letters(), _unlike().search
        self.added = () if special_as_text else tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", [t.id for t in self.merge(piece.encode().decode("latin-1").translate(self.letters))]).tobytes()
        if len(piece) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if self.odd(text) or any(x in text for x in self.added):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, _SPLIT(text)))


@lru_cache(maxsize=4)
def _memo(path: str, special_as_text: bool = True) -> _Memo:
    return _Memo(path, special_as_text)


def cuts(total: int, max_len: int = MAX_LEN) -> list[int]:
    """Binary lengths whose sum is `total`: whole `max_len` pieces, then the set bits of the rest, largest first."""
    rest = total % max_len
    return [max_len] * (total // max_len) + [1 << b for b in range(max_len.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces(docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN, end_id: int = END_ID, with_ids: bool = False, special_as_text: bool = True) -> DataFrame:
    """A row per piece; with `with_ids` also the piece's ids as little-endian 32-bit bytes."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo(tokenizer_path, special_as_text)
        for part in blocks(batches):
            out: list[list] = [[], [], [], [], [], []]
            doc, start, length, crc, tokens, raw = out
            for i, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                ids = (memo.ids(text) if text else b"") + end
                total, at = len(ids) // 4, 0
                for n in cuts(total, max_len):
                    own = ids[4 * at : 4 * (at + n)]
                    doc.append(i)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(own))
                    tokens.append(total)
                    if with_ids:
                        raw.append(own)
                    at += n
            columns = [pa.array(x, pa.int64()) for x in out[:5]] + ([pa.array(raw, pa.binary())] if with_ids else [])
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(columns)])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA + ", ids binary" * with_ids)


def packed(docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN, end_id: int = END_ID, with_ids: bool = False, special_as_text: bool = True) -> DataFrame:
    """The pieces with the sequence each one is (numbered over all buckets), its place there and its bucket."""
    out = pieces(docs, tokenizer_path, max_len, end_id, with_ids, special_as_text)
    return out.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "bucket": F.col("length").cast("int")})
