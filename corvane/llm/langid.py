"""Language ID with language-bitmask n-gram filters.

The letters of a text (A-Z lower-cased, everything that is no letter a blank) give byte 4-grams. A bit-sliced
Bloom filter has a 64-bit mask in each slot, a bit for each language; a language's bit is set in the slots of every n-gram that
its learning texts contain. The AND of an n-gram's slots returns all languages that contain it at once. An n-gram's
hit is shared among its languages, so one that all contain tells nothing. A text's popcounts per language, less the
false positives that the filter's fill lets expect, decide.

Nulls: rows with null lang are not learned from; a null text, or one without a letter, is `und` with score 0. A
text none of whose n-grams is known gets the commonest language with score 0; ties go to the smaller name.
Repeated rows get equal results; no rows: no rows; very long texts are read whole. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import blocks, crc_mod, flat, written
from corvane.llm.kernels import LOWER, U, mix
from corvane.llm.learning import TRAIN_ROWS

HELD_MOD, HELD = 4, 2
#: Slots of the filter (8 bytes each) and hash functions; languages beyond 64 take further 64-bit slices.
SLOTS, HASHES = 1 << 20, 2
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = LOWER[97:123]
_FOLD[65:91] = LOWER[65:91]
_FOLD[128:] = np.arange(128, 256)


def grams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """4-gram (as an integer) and row of every position, each text between two blanks; blank-only grams are left out."""
    rows = len(off) - 1
    size = np.diff(off)
    row = np.repeat(np.arange(rows), size + 4)
    text = np.full(len(buf) + 4 * rows, 32, np.uint8)
    text[np.arange(len(buf)) + np.repeat(4 * np.arange(rows) + 1, size)] = _FOLD[buf]
    if len(text) < 4:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    g = np.zeros(len(text) - 3, np.uint32)
    for i in range(4):
        g = (g << np.uint32(8)) | text[i : len(text) - 3 + i]
    use = (row[:-3] == row[3:]) & ((g & np.uint32(0x00FFFF00)) != np.uint32(0x00202000))
    return g[use], row[:-3][use]


def slots(g: np.ndarray) -> tuple[np.ndarray, ...]:
    h = mix(g.astype(U) + U(1))
    return tuple(((h >> U(21 * i)) & U(SLOTS - 1)).astype(np.int64) for i in range(HASHES))


class Model:
    def __init__(self, languages: list[str], slices: np.ndarray, common: str) -> None:
        self.languages, self.slices, self.common = languages, slices, common  # slices: [slice, slot] masks
        fill = np.array([((slices[i // 64] >> U(i % 64)) & U(1)).mean() for i in range(len(languages))])
        self.chance = fill**HASHES

    def counts(self, g: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """N-grams of each text by their shares, and for each language those that it contains, corrected for false positives."""
        at = slots(g)
        found = []
        for masks in self.slices:
            own = masks[at[0]]
            for x in at[1:]:
                own = own & masks[x]
            found.append(own)
        share = 1 / np.maximum(sum(np.bitwise_count(x).astype(np.int64) for x in found), 1)
        n, hits = np.bincount(row, weights=share, minlength=rows), np.zeros((rows, len(self.languages)))
        for i in range(len(self.languages)):
            has = np.flatnonzero((found[i // 64] >> U(i % 64)) & U(1))
            hits[:, i] = np.bincount(row[has], weights=share[has], minlength=rows)
        return n, (hits - self.chance * n[:, None]) / np.maximum(1 - self.chance, 1e-9)

    def predict(self, buf: np.ndarray, off: np.ndarray, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        rows = len(off) - 1
        out, score = ["und"] * rows, np.zeros(rows)
        lettered = np.zeros(len(buf) + 1, np.int64)
        np.cumsum((_FOLD[buf] != 32), out=lettered[1:])
        ascii_letters = np.zeros(len(buf) + 1, np.int64)
        np.cumsum((_FOLD[buf] != 32) & (buf < 128), out=ascii_letters[1:])
        has = ascii_letters[off[1:]] > ascii_letters[off[:-1]]
        for r in np.flatnonzero(~has & (lettered[off[1:]] > lettered[off[:-1]])):
            has[r] = any(c.isalpha() for c in texts[int(r)].as_py())
        if not self.languages:
            return out, score
        _, count = self.counts(*grams(buf, off), rows)
        count = np.maximum(count, 0)
        best = count.argmax(1)
        top = count[np.arange(rows), best]
        sure = top / np.maximum(count.sum(1), 1e-9)
        for r in np.flatnonzero(has).tolist():
            out[r] = self.languages[best[r]] if top[r] > 0 else self.common
            score[r] = min(1.0, sure[r]) if top[r] > 0 else 0.0
        return out, score


def train(docs: DataFrame, limit: int = TRAIN_ROWS, mod: int = HELD_MOD, held: int = HELD) -> Model:
    """Filters from at most `limit` documents with a language, outside the held-out part."""
    seen = docs.filter(F.col("lang").isNotNull() & (crc_mod("doc_id", mod) != held)).select("doc_id", "lang")
    seen = seen.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id", "lang").limit(limit).distinct()
    rows = written(docs.select("doc_id", "text", "lang").join(F.broadcast(seen), ["doc_id", "lang"]).select("text", "lang"), "lang-learning")
    sizes = rows.groupBy("lang").count().toPandas().sort_values("lang")
    languages = sizes["lang"].tolist()
    if not languages:
        return Model([], np.zeros((1, SLOTS), U), "und")
    code = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            g, row = grams(*flat(part.column("text")))
            of = np.array([code[x] for x in part.column("lang").to_pylist()], np.int64)[row]
            kind = np.unique(of.astype(np.int64) << 32 | g)
            yield pa.RecordBatch.from_arrays([pa.array(kind & 0xFFFFFFFF), pa.array((kind >> 32).astype(np.int32))], names=["g", "i"])

    got = rows.mapInArrow(run, "g long, i int").distinct().toPandas()  # from at most `limit` documents
    g, i = got["g"].to_numpy(), got["i"].to_numpy()
    slices = np.zeros(((len(languages) + 63) // 64, SLOTS), U)
    for x in np.unique(i):
        for at in slots(g[i == x].astype(np.uint32)):
            slices[x // 64][at] |= U(1) << U(x % 64)
    return Model(languages, slices, str(sizes.sort_values(["count", "lang"], ascending=[False, True])["lang"].iloc[0]))


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """A row per document: doc_id, held_out, lang_pred, score."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast(model)  # 8 bytes x SLOTS x slices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = share.value
        for part in blocks(batches):
            text = part.column("text")
            lang, score = own.predict(*flat(text), text)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (crc_mod("doc_id", HELD_MOD) == HELD).alias("held_out"), "lang_pred", "score")
