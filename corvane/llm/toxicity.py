"""Toxic passages by maximum-scoring segment search.

Each token, and each leading part of 5 to 7 bytes of one, has a log-odds: its rate in documents marked toxic against
the others, with a Dirichlet prior that grows with the counts of both, less some standard errors, so that only
well-supported ones are positive. A token's score is the best of its own and its parts'. A
linear-time scan finds all maximal scoring segments of a text. Under the clean documents' token rates the best
score of n random tokens has an extreme-value law, P(S > s) = 1 - exp(-K n exp(-lambda s)); a segment is
significant when its own expected count is small. The normalised scores of a document's segments are aggregated
and set to a probability by a logistic fit on the learning rows.

Tokens are runs of letters (A-Z lower-cased) and of bytes over 127. Nulls: a null text is empty; null marks are
not learned from. Empty texts have no segment and the score of one. Without marks of both kinds scores are the
share of marks 1 (0.5 without any). Ties and repeated rows get equal scores; no rows: no rows; texts of any
length are scanned whole. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import blocks, crc_mod, flat, written
from corvane.llm.kernels import LOWER, hash_spans, mix, word_spans
from corvane.llm.learning import TRAIN_ROWS, learning_rows, logistic, sigmoid

CUT, HELD_MOD, HELD = 0.5, 5, 0
#: Prior counts: so many of any token, and so many more in proportion to its rate in both kinds of documents.
FLOOR, PRIOR, ERRORS, DRIFT = 0.5, 200.0, 2.0, -0.7
PARTS = (5, 6, 7)
#: Counts of documents by mark (a: 1, b: other) and fold.
FOLDED = ("a0", "b0", "a1", "b1")
_SEP = np.ones(256, bool)
_SEP[[*range(97, 123), *range(128, 256)]] = False


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each token and of its leading parts (the token's own where it is no longer), and row, start and end."""
    low = LOWER[buf]
    starts, ends, row = word_spans(low, off, _SEP)
    own = hash_spans(low, starts, ends)
    parts = []
    for n in PARTS:
        h = own.copy()
        longer = np.flatnonzero(ends - starts > n)
        h[longer] = hash_spans(low, starts[longer], starts[longer] + n) ^ np.uint64(n << 32 | 0x5A17)
        parts.append(h)
    return [own, *parts], row, starts, ends


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, one past last, score) in time linear in the tokens.

    Tokens of negative score between positive ones are summed first. A stack holds candidates with the running
    sums left of them and at their right end; a new one is joined with the nearest candidate on the left whose left
    sum is lower and whose right sum is not lower; those in between are absorbed.
    """
    up = np.flatnonzero(score > 0)
    if not len(up):
        return []
    total = np.concatenate([[0.0], np.cumsum(score)])
    stack: list[list] = []  # first, end, left sum, right sum, nearest candidate with a lower left sum
    for i in up.tolist():
        new = [i, i + 1, total[i], total[i + 1]]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= new[3]:
                stack.append([*new, j])
                break
            new = [stack[j][0], new[1], stack[j][2], new[3]]
            del stack[j:]
    return [(a, b, float(r - left)) for a, b, left, r, _ in stack]


class Model:
    def __init__(self, key: np.ndarray, value: np.ndarray, unknown: float, lam: float, k: float, coef: np.ndarray, base: float) -> None:
        self.key, self.value, self.unknown, self.lam, self.k, self.coef, self.base = key, value, unknown, lam, k, coef, base

    def token_scores(self, forms: list[np.ndarray]) -> np.ndarray:
        """The best score of a token and its parts where one is positive, else that of any other token."""
        out = np.full(len(forms[0]), self.unknown)
        if len(self.key):
            for h in forms:
                at = np.minimum(np.searchsorted(self.key, h), len(self.key) - 1)
                np.maximum(out, np.where(self.key[at] == h, self.value[at], self.unknown), out=out)
        return out

    def summary(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """Features of each text's segments, and its significant passages as (first byte, end byte, normalised score)."""
        rows = len(off) - 1
        forms, row, starts, ends = tokens(buf, off)
        score = self.token_scores(forms)
        first = np.searchsorted(row, np.arange(rows + 1))
        out, found = np.zeros((rows, 7)), [[] for _ in range(rows)]
        out[:, 0] = 1
        n = np.diff(first)
        out[:, 4] = np.log1p(n) / 5
        for r in np.unique(row[score > 0]).tolist():
            a, b = first[r], first[r + 1]
            space = np.log(self.k * (b - a) + 1e-9)
            best = total = peak = 0.0
            for i, j, s in segments(score[a:b]):
                bits = self.lam * s
                total += bits
                best, peak = max(best, bits - space), max(peak, bits)
                if bits > np.log(self.k / 0.05 + 1e-9):
                    found[r].append((int(starts[a + i] - off[r]), int(ends[a + j - 1] - off[r]), bits))
            out[r, 1:4] = min(best, 40) / 10, min(total, 400) / (10 + b - a) * 5, np.log1p(len(found[r]))
            out[r, 5] = np.log1p(total) / 3
            out[r, 6] = min(peak, 40) / 10
        return out, found

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(x @ self.coef) if len(self.coef) else np.full(len(x), self.base)


def _counts(rows: DataFrame) -> DataFrame:
    """Hash of a token or part, and for each fold the documents marked 1 (a0, a1) and others (b0, b1) that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            forms, row, _, _ = tokens(*flat(part.column("text")))
            every, row = np.concatenate(forms), np.tile(row, len(forms))
            _, once = np.unique(mix(every + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
            h, kind = every[once], (2 * np.asarray(part.column("fold")) + np.asarray(part.column("y")))[row[once]]
            for which, name in enumerate(("b0", "a0", "b1", "a1")):
                values, n = np.unique(h[kind == which], return_counts=True)
                zero = np.zeros(len(values), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), *(pa.array(n if c == name else zero) for c in FOLDED)], names=["h", *FOLDED])

    return rows.mapInArrow(run, "h long, " + ", ".join(f"{c} long" for c in FOLDED)).groupBy("h").agg(*(F.sum(c).alias(c) for c in FOLDED))


def token_score(a: Column | np.ndarray, b: Column | np.ndarray, total_a: float, total_b: float, log: Callable, sqrt: Callable) -> Column | np.ndarray:
    """Lower bound of a token's log-odds, from the documents of both kinds that have it."""
    prior = FLOOR + PRIOR * (a + b) / max(1.0, total_a + total_b)
    odds = log((a + prior) / (total_a + PRIOR)) - log((b + prior) / (total_b + PRIOR))
    return odds - ERRORS * sqrt(1 / (a + prior) + 1 / (b + prior))


def extreme_value(value: np.ndarray, rate: np.ndarray) -> tuple[float, float]:
    """lambda and K of the extreme-value law, from the positive scores and their rates in clean text; other tokens score DRIFT.

    lambda is where the mean of exp(lambda score) over a clean text's tokens is 1; segments begin at positive tokens only.
    """
    rest = max(0.0, 1 - float(rate.sum()))

    def mean(lam: float) -> float:
        return float((rate * np.exp(np.minimum(lam * value, 500))).sum()) + rest * np.exp(lam * DRIFT)

    lo, hi = 1e-3, 1.0
    while mean(hi) < 1 and hi < 20:
        hi *= 2
    for _ in range(60):
        lam = (lo + hi) / 2
        lo, hi = (lo, lam) if mean(lam) > 1 else (lam, hi)
    return lo, max(1e-6, float(rate.sum()))


def _scorer(counts: DataFrame, folds: tuple[int, ...]) -> Model:
    """The token scores and the extreme-value law from the documents of some folds; it isn't calibrated yet."""
    own = counts.select("h", sum(F.col(f"a{f}") for f in folds).alias("a"), sum(F.col(f"b{f}") for f in folds).alias("b")).filter("a + b > 0")
    total_a, total_b, kinds = own.agg(F.sum("a").cast("double"), F.sum("b").cast("double"), F.count(F.lit(1))).first()
    score = token_score(F.col("a"), F.col("b"), total_a, total_b, F.ln, F.sqrt)
    top = own.withColumn("value", score).filter("value > 0").toPandas().sort_values("h")  # tokens of at most `limit` documents
    key = top["h"].to_numpy(np.int64).view(np.uint64)
    order, value = np.argsort(key), top["value"].to_numpy(float)
    lam, k = extreme_value(value, (top["b"].to_numpy(float) + 0.5) / (total_b + 0.5 * kinds + 1))
    return Model(key[order], value[order], DRIFT, lam, k, np.zeros(0), 0.5)


def train(docs: DataFrame, labels: DataFrame, mark: str = "toxic", limit: int = TRAIN_ROWS) -> Model:
    """The model from at most `limit` marked rows outside the held-out part. Every token of theirs with a positive score is in it.

    The logistic fit sees each row as a row that gave no token a score: the rows are halved by a hash, and the features of a
    half come from the tokens of the other one. Where a half lacks one of the marks they come from all rows.
    """
    rows = learning_rows(docs, labels, mark, HELD_MOD, HELD, limit)
    rows = written(rows.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(2)).cast("int")), "toxic-learning")
    marks = {(r["fold"], r["y"]): r["count"] for r in rows.groupBy("fold", "y").count().collect()}
    n, ones = sum(marks.values()), sum(c for (_, y), c in marks.items() if y)
    if not n or ones in (0, n):
        return Model(np.zeros(0, np.uint64), np.zeros(0), DRIFT, 1.0, 1.0, np.zeros(0), ones / n if n else 0.5)
    counts = written(_counts(rows), "toxic-tokens")
    model = _scorer(counts, (0, 1))
    others = [_scorer(counts, (1,)), _scorer(counts, (0,))] if len(marks) == 4 else [model, model]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            fold = np.asarray(part.column("fold"))
            for f, other in enumerate(others):
                some = part.filter(pa.array(fold == f))
                if some.num_rows:
                    x, _ = other.summary(*flat(some.column("text")))
                    yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    got = rows.mapInArrow(run, "doc_id long, y int, x array<double>").toPandas().sort_values(["doc_id", "y"])
    x, y = np.stack(got["x"].to_numpy()), got["y"].to_numpy(float)
    model.coef, model.base = logistic(x, y, ridge=0.1), float(y.mean())
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted, passages (start and end byte, normalised score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())]))
        for part in blocks(batches):
            x, found = model.summary(*flat(part.column("text")))
            spans = pa.array([[{"start": a, "end": b, "bits": s} for a, b, s in f] for f in found], kind)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.score(x)), spans], names=["doc_id", "score", "passages"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, passages array<struct<start: long, end: long, bits: double>>")
    return out.select("doc_id", (crc_mod("doc_id", HELD_MOD) == HELD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "passages")
