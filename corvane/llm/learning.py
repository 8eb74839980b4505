"""Small learners on bounded samples: logistic regression, and the labelled rows they may see."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import crc_mod

#: Labelled rows that a classifier learns from at most, the smallest seeded hashes first.
TRAIN_ROWS = 20_000


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 60) -> np.ndarray:
    """Coefficients by Newton's method on the ridge-penalised logistic loss."""
    w = np.zeros(x.shape[1])
    weight = np.ones(len(y)) if weight is None else weight
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + (ridge + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-7:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def learning_rows(docs: DataFrame, marks: DataFrame, mark: str, mod: int, out: int, limit: int = TRAIN_ROWS) -> DataFrame:
    """(text, y) of at most `limit` marked documents whose crc32(doc_id) mod `mod` is not `out`.

    The marks are cut to `limit` rows by a seeded hash before they meet the documents, so what is broadcast has
    at most `limit` rows and no text is shuffled. A document with several marks has their mean, 0.5 and over being 1.
    """
    seen = marks.filter(F.col(mark).isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", mod) != out))
    seen = seen.groupBy("doc_id").agg((F.avg(F.col(mark).cast("double")) >= 0.5).cast("int").alias("y"))
    seen = seen.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(limit)
    return docs.select("doc_id", "text").join(F.broadcast(seen), "doc_id").select("doc_id", "text", "y")
