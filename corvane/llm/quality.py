"""Quality classifier by Bradley-Terry pairwise ranking.

Features of a whole text (byte classes, word shapes, repetition) are computed in one vectorised pass. Preference
pairs (a document marked 1 over one marked 0) are drawn by a seed from a bounded sample of marked rows; the
coefficients minimise the logistic loss of the pairs' feature differences. The threshold is a quantile of the
learning rows' scores: the share of documents marked 0. Scores are given on a scale where it stands at 0.7.

Nulls: a null text is an empty one, with the features of no words; marks that are null are not learned from.
Without marks of both kinds every score is the share of marks 1 (0.5 without any), and `accepted_rows`, which then has
nothing to reject by, keeps every row. Ties and repeated rows get
equal scores. No rows: no rows. Texts of any length are read whole. Extra columns are ignored by `scored` and
kept by `accepted_rows`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from corvane.llm.common import blocks, crc_mod, flat
from corvane.llm.kernels import LOWER, U, hash_spans, mix, shingles, word_spans
from corvane.llm.learning import TRAIN_ROWS, learning_rows, logistic, sigmoid

CUT, PAIRS, HELD_MOD, HELD = 0.7, 100_000, 4, 2
_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",;:", "!", "?", "|", "#$%&*@^~", "<>[]{}()/\\=+_-`", "\"'")
_OF = np.full(256, len(_CLASSES) + 1, np.int64)
for _i, _x in enumerate(_CLASSES):
    _OF[[ord(c) for c in _x]] = _i
_OF[128:] = len(_CLASSES)
_N = len(_CLASSES) + 2


def _distinct(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Distinct hashes in each row."""
    key = mix(h + row.astype(U) * U(0x9E3779B97F4A7C15))
    _, first = np.unique(key, return_index=True)
    return np.bincount(row[first], minlength=rows)


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of features for each text."""
    rows = len(off) - 1
    size = np.diff(off)
    byte_row = np.repeat(np.arange(rows), size)
    share = np.bincount(byte_row * _N + _OF[buf], minlength=rows * _N).reshape(rows, _N) / np.maximum(size, 1)[:, None]
    low = LOWER[buf]
    starts, ends, row = word_spans(low, off)
    words = hash_spans(low, starts, ends)
    n = np.bincount(row, minlength=rows)
    many = np.maximum(n, 1)
    length = np.bincount(row, weights=ends - starts, minlength=rows) / many
    square = np.bincount(row, weights=(ends - starts) ** 2.0, minlength=rows) / many
    same = np.bincount(row[1:], weights=(words[1:] == words[:-1]) & (row[1:] == row[:-1]), minlength=rows) / many if len(row) else np.zeros(rows)
    three, of = shingles(words, row, 3, rows)
    kinds, kinds3 = _distinct(words, row, rows), _distinct(three, of, rows)
    n3 = np.maximum(np.bincount(of, minlength=rows), 1)
    base = np.column_stack([share, length / 10, np.sqrt(np.maximum(square - length**2, 0)) / 10, same, kinds / many, np.log1p(kinds) / np.log1p(many), kinds3 / n3, np.log1p(n) / 10, n == 0])
    return np.column_stack([base, np.sqrt(base[:, :_N]), np.log(share[:, 1] + 0.01) - np.log(share[:, 0] + 0.01), (base[:, _N + 5] - 1) ** 2])


class Model:
    """Standardised linear score, shifted so that the quantile threshold stands at CUT."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, coef: np.ndarray, at: float, base: float) -> None:
        self.mean, self.scale, self.coef, self.at, self.base = mean, scale, coef, at, base

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.coef

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.coef):
            return np.full(len(x), self.base)
        return sigmoid(self.raw(x) - self.at + np.log(CUT / (1 - CUT)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 5) -> Model:
    """Bradley-Terry coefficients from `pairs` seeded preferences of a row marked 1 over a row marked 0."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Model(np.zeros(0), np.ones(0), np.zeros(0), 0.0, float(y.mean()) if len(y) else 0.5)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / scale, -8, 8)
    draw = np.random.default_rng(seed)
    better, worse = draw.choice(good, pairs), draw.choice(bad, pairs)
    flip = draw.random(pairs) < 0.5
    diff = np.where(flip[:, None], -1, 1) * (z[better] - z[worse])
    coef = logistic(diff, (~flip).astype(float), ridge=5.0)
    at = float(np.quantile(z @ coef, len(bad) / len(y)))
    return Model(mean, scale, coef, at, float(y.mean()))


def train(docs: DataFrame, labels: DataFrame, mark: str = "quality", mod: int = HELD_MOD, held: int = HELD, limit: int = TRAIN_ROWS) -> Model:
    """The model from at most `limit` marked rows outside the held-out part; only their features reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            x = features(*flat(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    got = learning_rows(docs, labels, mark, mod, held, limit).mapInArrow(run, "doc_id long, y int, x array<double>").toPandas().sort_values(["doc_id", "y"])
    if not len(got):
        return fit(np.zeros((0, 1)), np.zeros(0))
    return fit(np.stack(got["x"].to_numpy()), got["y"].to_numpy())


def score_of(text: Column, model: Model) -> Column:
    """The score of a text; null counts as empty. Only the text goes to Python, the row stays where it is."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            part = pa.RecordBatch.from_arrays([batch], names=["text"])
            yield pa.array(np.concatenate([np.zeros(0), *(model.score(features(*flat(b.column("text")))) for b in blocks(iter([part])))]))

    return F.arrow_udf(run, DoubleType(), F.ArrowUDFType.SCALAR_ITER)(text)


def scored(docs: DataFrame, model: Model, mod: int = HELD_MOD, held: int = HELD) -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted."""
    out = docs.select("doc_id", score_of(F.col("text"), model).alias("score"))
    return out.select("doc_id", (crc_mod("doc_id", mod) == held).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def accepted_rows(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` that the classifier accepts, with their columns as they came; all if it learned nothing."""
    if not len(model.coef):
        return docs
    rows = docs.select(F.struct("*").alias("_row"), score_of(F.col("text"), model).alias("_score"))
    return rows.filter(F.col("_score") >= CUT).select("_row.*")
