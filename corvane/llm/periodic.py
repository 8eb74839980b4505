"""Periodic runs of words: stretches that repeat their first `period` words at least twice over, and texts without the repeats.

All-lag scan: the word ids of a text are compared with themselves shifted by every lag up to half the text, and true
stretches are run-length coded; a stretch of `m` equal places at lag `q` is a run of m + q words with period q. Short
texts are scanned many at a time (ids are unlike between texts, so no stretch crosses them), longest last, so that a lag
only meets texts it fits in. For a lag of 16 and more the shift is first compared at every (lag // 4)th place: a stretch
that is long enough holds four such places in a row, so where there are no four the lag has no run, exactly. A text of
over `LONG` bytes is cut into ranges of `LAGS` lags, and Spark deals the pairs of text and range to its tasks.

A stretch whose smallest period is q also shows at the multiples of q, with the same borders; the least lag of equal
borders stays. What a text's runs need is bounded by the text: (start, length) pairs of its own words.

Words are `[^\\x20\\x09-\\x0D]+` of the UTF-8 bytes, compared byte for byte (ids come from a dictionary, not from hashes).

Nulls: a null text has no words, no run and an empty collapsed text; a null doc_id stays null. Empty texts: the same. Very
long texts are scanned whole, in ranges. Ties between runs of equal length: the smallest start, then the smallest period.
Repeated rows are scanned one by one. No rows: no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import blocks, written

MIN_LENGTH = 12
#: Bytes of text from which a text is scanned in ranges of its own, and the lags of a range.
LONG, LAGS = 1 << 16, 1 << 14
#: Bytes of text scanned together.
TOGETHER = 1 << 22
SPAN = "struct<start:long,length:long,period:long>"
#: Which original word stands at each place of a text: (doc_id, words) -> places, or None for the text as it is.
Reorder = Callable[[int | None, int], np.ndarray | None]


def _stretches(equal: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the maximal true stretches of `least` places and more."""
    at = np.flatnonzero(equal)
    if len(at) < least:
        return at[:0], at[:0]
    cut = np.flatnonzero(np.diff(at) != 1)
    first, last = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]
    size = last - first + 1
    long = size >= least
    return first[long], size[long]


def _at_lag(ids: np.ndarray, lag: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of `ids` against itself shifted by `lag`."""
    n = len(ids) - lag
    step = least // 4
    if step < 4:
        return _stretches(ids[:n] == ids[lag:], least)
    hit = ids[:n:step] == ids[lag::step][: -(-n // step)]
    group, size = _stretches(hit, 4)
    if not len(group):
        return group, group
    if len(group) > 64:
        return _stretches(ids[:n] == ids[lag:], least)
    out = []
    for g, m in zip(group.tolist(), size.tolist(), strict=True):
        low, high = max(0, (g - 1) * step + 1), min(n, (g + m) * step)
        start, length = _stretches(ids[low:high] == ids[low + lag : high + lag], least)
        out.append((start + low, length))
    return np.concatenate([s for s, _ in out]), np.concatenate([m for _, m in out])


def scan(ids: np.ndarray, sizes: np.ndarray, low: int, high: int, min_length: int = MIN_LENGTH) -> np.ndarray:
    """Rows (start, length, period) of the runs with a lag in [low, high), by start, length and period.

    ids: the texts' word ids end to end, no id in two texts; sizes: the texts' words, ascending.
    """
    first = np.concatenate([[0], np.cumsum(sizes)])
    found = []
    for lag in range(max(1, low), high):
        at = first[np.searchsorted(sizes, max(2 * lag, min_length))]  # shorter texts have no run at this lag
        if at == len(ids):
            break
        start, size = _at_lag(ids[at:], lag, max(lag, min_length - lag))
        if len(start):
            found.append(np.stack([start + at, size + lag, np.full(len(start), lag)], 1))
    return least_periods(np.concatenate(found)) if found else np.zeros((0, 3), np.int64)


def least_periods(rows: np.ndarray) -> np.ndarray:
    """Of rows with equal start and length the one with the least period, by start and length."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    return rows[new]


def _words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []  # splits at exactly \x20 and \x09-\x0D


def _placed(words: list[bytes], doc: int | None, reorder: Reorder | None) -> list[bytes]:
    places = reorder(doc, len(words)) if reorder and words else None
    return words if places is None else [words[i] for i in places.tolist()]


def _ids(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words end to end, and the words of each text."""
    new, ids = itertools.count(), []
    for words in texts:
        ids.append(np.fromiter(map(defaultdict(new.__next__).__getitem__, words), np.int32, len(words)))
    return np.concatenate(ids) if ids else np.zeros(0, np.int32), np.array([len(x) for x in ids], np.int64)


def collapsed(words: list[bytes], runs: np.ndarray) -> str:
    """The text without what any run repeats after its first `period` words."""
    if len(runs):
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
        np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
        words = list(itertools.compress(words, (np.cumsum(edge[:-1]) == 0).tolist()))
    return b" ".join(words).decode()


def _batch(docs: list, texts: list[list[bytes]], runs: list[np.ndarray], kept: list[str]) -> pa.RecordBatch:
    rows = np.concatenate([x[np.lexsort((x[:, 2], x[:, 0]))] for x in runs]) if runs else np.zeros((0, 3), np.int64)
    spans = pa.StructArray.from_arrays([pa.array(rows[:, i].astype(np.int64)) for i in range(3)], names=["start", "length", "period"])
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in runs])]).astype(np.int32)
    columns = [pa.array(docs, pa.int64()), pa.array([len(x) for x in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), spans), pa.array(kept, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])


def _whole(reorder: Reorder | None, min_length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, limit=TOGETHER):
            docs = part.column("doc_id").to_pylist()
            texts = [_placed(_words(t), d, reorder) for d, t in zip(docs, part.column("text").to_pylist(), strict=True)]
            order = sorted(range(len(docs)), key=lambda i: len(texts[i]))
            docs, texts = [docs[i] for i in order], [texts[i] for i in order]
            ids, sizes = _ids(texts)
            rows = scan(ids, sizes, 1, len(texts[-1]) // 2 + 1, min_length)
            first = np.concatenate([[0], np.cumsum(sizes)])
            cut = np.searchsorted(rows[:, 0], first)
            runs = [rows[cut[i] : cut[i + 1]] - [first[i], 0, 0] for i in range(len(docs))]
            yield _batch(docs, texts, runs, [collapsed(w, r) for w, r in zip(texts, runs, strict=True)])

    return run


def _ranges(reorder: Reorder | None, lags: int) -> Callable:
    """(_row, text as it is placed, low, high) for every range of lags of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, limit=TOGETHER):
            for row, doc, text in zip(*(part.column(c).to_pylist() for c in ("_row", "doc_id", "text")), strict=True):
                words = _placed(_words(text), doc, reorder)
                placed = b" ".join(words).decode()
                for low in range(1, max(2, len(words) // 2 + 1), lags):
                    yield pa.RecordBatch.from_pydict({"_row": [row], "text": [placed], "low": [low], "high": [min(low + lags, len(words) // 2 + 1)]})

    return run


def _scanned(min_length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, limit=1):
            for row, text, low, high in zip(*(part.column(c).to_pylist() for c in ("_row", "text", "low", "high")), strict=True):
                ids, sizes = _ids([_words(text)])
                found = scan(ids, sizes, low, high, min_length)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), row)), *(pa.array(found[:, i].astype(np.int64)) for i in range(3))], names=["_row", "start", "length", "period"])

    return run


def _finished(reorder: Reorder | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, limit=TOGETHER):
            for doc, text, spans in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                words = _placed(_words(text), doc, reorder)
                runs = np.array([(s["start"], s["length"], s["period"]) for s in spans or []], np.int64).reshape(-1, 3)
                yield _batch([doc], [words], [runs], [collapsed(words, runs)])

    return run


def periodic_runs(docs: DataFrame, reorder: Reorder | None = None, min_length: int = MIN_LENGTH, long: int = LONG, lags: int = LAGS) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and the collapsed text of every row of `docs` (doc_id, text).

    A run has at least `min_length` words and twice its smallest period. `reorder` puts other words of a text in its places first.
    """
    out = f"doc_id long, n_words long, runs array<{SPAN}>, collapsed string"
    rows = docs.select("doc_id", "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    short = rows.filter(size <= long).mapInArrow(_whole(reorder, min_length), out)
    # Numbered in a written table: a source that is computed again could number its rows otherwise.
    alone = written(rows.filter(size > long).withColumn("_row", F.monotonically_increasing_id()), "long-texts")
    if alone.isEmpty():
        return short
    pairs = alone.mapInArrow(_ranges(reorder, lags), "_row long, text string, low long, high long").repartition("_row", "low")
    found = pairs.mapInArrow(_scanned(min_length), "_row long, start long, length long, period long")
    least = found.groupBy("_row", "start", "length").agg(F.min("period").alias("period"))
    spans = least.groupBy("_row").agg(F.collect_list(F.struct("start", "length", "period")).alias("spans"))
    return short.unionByName(alone.join(spans, "_row", "left").mapInArrow(_finished(reorder), out))


def digests(found: DataFrame) -> DataFrame:
    """The longest run of each row, and digests of its runs and of its collapsed text."""
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    # Least of (-length, start, period) is the longest run, ties to the smallest start, then period.
    top = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("a"), r["start"].alias("b"), r["period"].alias("c"))))
    return found.withColumn("_top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_top.b").alias("start"), (-F.col("_top.a")).alias("length"), F.col("_top.c").alias("period"),
        F.expr("(-_top.a * 1000) div _top.c").alias("exponent_milli"), F.sha2(F.array_join(F.transform(line, lambda s: F.concat(s, F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )
