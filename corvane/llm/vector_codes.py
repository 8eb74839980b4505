"""Vector codes: each vector is cut into parts, and a part is coded as the index of its codebook's nearest entry.

Everything is integer arithmetic, so any order of work gives the same rows. A component x becomes floor(1024 * x). The
codebooks start as the parts of the rows with the least ids. Each round the driver builds a kd-tree for every codebook
and broadcasts them (at most `words` entries a part, whatever the table holds); tasks assign their rows' parts, add them up per
entry, and Spark sums these partial sums. The driver gets one row per component of a codebook, never rows of the table.

The search is branch and bound over the tree, for many parts at a time: a part goes to the child on its side first, then
to the other one unless that child's box is farther than the best entry found. A box at exactly that distance is visited
too, so of entries at equal distance the least index is found, wherever it stands in the tree.

Integers that squared distances could push out of 64 bits are handled as Python integers by the same code, more slowly.
Sums travel as four limbs of 36 bits, exact for every 32-bit float.

Nulls: rows whose vector is null or holds a null or non-finite component are dropped (a double beyond the range of 32-bit
floats counts as infinite). Empty vectors, and vectors of another dimension than most (ties: the smaller), can't be cut alike
and are dropped too. A null vec_id is coded but starts no codebook (unless no row has an id: then the null ones do). Ties: rows that repeat a vec_id start the codebooks in the order of
their components. Null labels are one label. A dimension that the parts don't divide is cut as evenly as whole numbers
allow. Fewer rows than `words`: as many entries. Errors beyond a long are the largest long. No rows: no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import written

PARTS, WORDS, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries in a leaf of the tree at most, rows that a task assigns together.
LEAF, TOGETHER = 16, 8192
LIMB = 36
MOST = (1 << 63) - 1
FLOAT_MOST = 3.4028235677973366e38


def usable(v: str) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) > FLOAT_MOST))
    return F.col(v).isNotNull() & (F.size(v) > 0) & F.coalesce(~bad, F.lit(False))


def narrow(dims: int) -> int:
    """Components below this bound keep squared distances over `dims` components within 64 bits."""
    return math.isqrt(MOST // max(1, dims)) // 2


def integers(v: np.ndarray) -> np.ndarray:
    """floor(1024 * x), as 64-bit integers where all fit and as Python integers otherwise."""
    scaled = np.floor(v.astype(np.float64) * SCALE)
    if np.abs(scaled).max(initial=0) < narrow(v.shape[-1]):
        return scaled.astype(np.int64)
    return np.array([int(x) for x in scaled.ravel()], object).reshape(scaled.shape)


def compact(x: np.ndarray) -> np.ndarray:
    """Python integers as 64-bit ones where all are narrow."""
    return x.astype(np.int64) if x.dtype == object and max(map(abs, x.ravel().tolist()), default=0) < narrow(x.shape[-1]) else x


class Tree:
    """A kd-tree over a codebook's entries: boxes of index ranges, halved along the widest component down to leaves."""

    def __init__(self, entries: np.ndarray, index: np.ndarray | None = None) -> None:
        index = np.arange(len(entries)) if index is None else index
        own = entries[index]
        self.low, self.high, self.leaf = own.min(0), own.max(0), len(index) <= LEAF
        if self.leaf:
            self.index = np.sort(index)
            self.entries = entries[self.index]
            return
        self.axis = int(np.argmax(self.high - self.low))
        order = index[np.argsort(own[:, self.axis], kind="stable")]
        half = len(order) // 2
        self.split = entries[order[half], self.axis]
        self.left, self.right = Tree(entries, order[:half]), Tree(entries, order[half:])

    def bound(self, x: np.ndarray) -> np.ndarray:
        """Squared distance of each x to the box."""
        out = np.maximum(self.low - x, 0) + np.maximum(x - self.high, 0)  # at most one of the two is not 0
        return (out * out).sum(1)

    def visit(self, x: np.ndarray, rows: np.ndarray, best: np.ndarray, at: np.ndarray) -> None:
        if self.leaf:
            gap = x[rows][:, None, :] - self.entries[None]
            far = (gap * gap).sum(2)
            own = far.argmin(1)  # the first of equals has the least index
            far, own = far[np.arange(len(rows)), own], self.index[own]
            closer = (at[rows] < 0) | (far < best[rows]) | ((far == best[rows]) & (own < at[rows]))
            best[rows[closer]], at[rows[closer]] = far[closer], own[closer]
            return
        near = x[rows, self.axis] < self.split
        for own, first, second in ((near, self.left, self.right), (~near, self.right, self.left)):
            some = rows[own.astype(bool)]
            if len(some):
                first.visit(x, some, best, at)
                some = some[(second.bound(x[some]) <= best[some]).astype(bool)]
                if len(some):
                    second.visit(x, some, best, at)


def nearest(x: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Index of each part's nearest entry, the least of equals, and its squared distance."""
    if x.dtype != tree.low.dtype:
        x = x.astype(object)
    best, at = np.zeros(len(x), tree.low.dtype if x.dtype != object else object), np.full(len(x), -1, np.int64)
    tree.visit(x, np.arange(len(x)), best, at)
    return at, best


def bounds(dims: int, parts: int) -> list[tuple[int, int]]:
    return [(i * dims // parts, (i + 1) * dims // parts) for i in range(parts)]


def _vectors(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            part = batch.slice(at, TOGETHER)
            yield part, integers(part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))


def _sums(trees: Callable[[], list[Tree]], dims: int, parts: int) -> Callable:
    """(part, entry, at, l0..l3): the task's sum of each component of each entry; at = -1 counts its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list] = {}
        for _, x in _vectors(batches, dims):
            for p, ((low, high), tree) in enumerate(zip(bounds(dims, parts), trees(), strict=True)):
                own = x[:, low:high]
                at, _ = nearest(own, tree)
                order = np.argsort(at, kind="stable")
                entries, first = np.unique(at[order], return_index=True)
                size = np.diff([*first, len(order)])
                for e, n, s in zip(entries.tolist(), size.tolist(), np.add.reduceat(own[order], first, axis=0).tolist(), strict=True):
                    before = total.get((p, e), [0] * (high - low + 1))
                    total[p, e] = [a + b for a, b in zip(before, [n, *s], strict=True)]
        rows = [(p, e, k - 1, s) for (p, e), row in total.items() for k, s in enumerate(row)]
        mask = (1 << LIMB) - 1
        limbs = [[s >> i * LIMB & mask if i < 3 else s >> 3 * LIMB for _, _, _, s in rows] for i in range(4)]
        columns = [pa.array([r[i] for r in rows], pa.int32()) for i in range(3)] + [pa.array(x, pa.int64()) for x in limbs]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "at", "l0", "l1", "l2", "l3"])

    return run


def _coded(trees: Callable[[], list[Tree]], dims: int, parts: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _vectors(batches, dims):
            code, error = [], 0
            for (low, high), tree in zip(bounds(dims, parts), trees(), strict=True):
                at, far = nearest(x[:, low:high], tree)
                code.append(at)
                error = far.astype(object) + error
            digits = max(2, len(f"{max(size(t) for t in trees()) - 1:x}"))
            codes = ["".join(f"{i:0{digits}x}" for i in row) for row in np.stack(code, 1).tolist()]
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array(codes, pa.string()), pa.array([min(int(e), MOST) for e in error], pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def size(tree: Tree) -> int:
    return len(tree.index) if tree.leaf else size(tree.left) + size(tree.right)


def updated(book: np.ndarray, rows: list, part: int) -> np.ndarray:
    """Entries as the componentwise floor of sum / count; unused ones stay."""
    sums = {(r["entry"], r["at"]): sum(r[f"l{i}"] << i * LIMB for i in range(4)) for r in rows if r["part"] == part}
    out = book.astype(object)
    for e in range(len(book)):
        if n := sums.get((e, -1), 0):
            out[e] = [sums[e, k] // n for k in range(book.shape[1])]
    return compact(out)


def learned(kept: DataFrame, dims: int, parts: int, words: int, rounds: int) -> list[np.ndarray]:
    """The codebooks after all rounds."""
    spark = kept.sparkSession
    start = kept.orderBy(F.col("vec_id").isNull(), "vec_id", "v").limit(words)
    if kept.filter("vec_id is not null").limit(1).count():
        start = kept.filter("vec_id is not null").orderBy("vec_id", "v").limit(words)
    first = integers(np.array([r["v"] for r in start.select("v").collect()], np.float64))
    books = [compact(first[:, low:high]) for low, high in bounds(dims, parts)]
    for _ in range(rounds):
        trees = spark.sparkContext.broadcast([Tree(b) for b in books])
        part = kept.select("v").mapInArrow(_sums(lambda t=trees: t.value, dims, parts), "part int, entry int, at int, l0 long, l1 long, l2 long, l3 long")
        rows = part.groupBy("part", "entry", "at").agg(*(F.sum(f"l{i}").alias(f"l{i}") for i in range(4))).collect()  # one row per component of the codebooks
        books = [updated(b, rows, p) for p, b in enumerate(books)]
        trees.unpersist()
    return books


def books_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compressed(table: DataFrame, parts: int = PARTS, words: int = WORDS, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of every kept row of `table` (vec_id, embedding, label), written, and the codebooks."""
    spark = table.sparkSession
    rows = table.select("vec_id", "label", F.col("embedding").alias("v")).filter(usable("v"))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], f"vec_id long, label {dict(rows.dtypes)['label']}, code string, error long"), []
    dims = sizes["d"]
    kept = written(rows.filter(F.size("v") == dims), "vectors")
    books = learned(kept, dims, parts, words, rounds)
    trees = spark.sparkContext.broadcast([Tree(b) for b in books])
    out = kept.mapInArrow(_coded(lambda: trees.value, dims, parts), f"vec_id long, label {dict(kept.dtypes)['label']}, code string, error long")
    return written(out, "codes"), books


def codes(table: DataFrame) -> DataFrame:
    """Every kept row with its code, its error, its label's summed error and the digest of the codebooks."""
    coded, books = compressed(table)
    # Summed per label before it is joined back, so a label that holds most rows is one row per task; the joined rows of
    # a hot label are split by the adaptive skew join.
    total = coded.groupBy(F.col("label").alias("_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("_sum"))
    most = F.lit(MOST).cast("decimal(38,0)")
    out = coded.join(total, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", F.least("_sum", most).cast("long").alias("label_error"), F.lit(books_sha256(books)).alias("codebooks_sha256"))
