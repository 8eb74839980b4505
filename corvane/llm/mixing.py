"""Mixing sources to target weights: whole passes, a seeded share of every exact length, and a knapsack for the rest.

A source's target T is met by floor(T / S) whole passes over it (S: its words) and a remaining budget below S. The
budget is filled by document counts per exact length: every length gives the same share of its documents, then
the largest lengths that still fit, and the last words are fitted by bounded-knapsack dynamic programming over every
length that has documents left. Where no document left fits but one more of the shortest ends nearer to the target, it is
taken too, so a source of one long document is not left out. Which documents of a length are taken is settled by a seeded hash of (doc_id, text): the count-th smallest hash is
found by histogram bins within bins, so a length that holds a third of all rows is never one task.

Nulls: a null text has size 0; a null source is a source of its own, last in order. A document of size 0 is never
taken. Sources without words have target 0. Repeated rows are documents of their own. No rows: no rows. Extra
columns are ignored by `mix` and kept by `mixed_rows`.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from corvane.llm.common import WORD, written

WEIGHTS, CAP = (5.0, 2.0, 1.0), 3
#: Words of the knapsack's table, which is exact for what is left then; where that falls short, twice the longest document.
DP_WORDS, DP_MOST = 1 << 15, 1 << 22
#: Hash bins of a length: bins before the boundary hash are taken whole. Its own bin has as many inner ones, of which one is ranked.
BINS = 1024


def targets(sizes: Sequence[int], weights: Sequence[float], cap: float = CAP) -> list[float]:
    """Shares of sum(sizes) by weight; what exceeds cap x size goes to the others by weight until none exceeds it."""
    out, left, open_ = [0.0] * len(sizes), float(sum(sizes)), list(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > cap * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = float(cap * sizes[i])
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take so that their sum is as large as possible, at most `budget`."""
    best = np.full(budget + 1, -1, np.int64)  # the item by which a sum was first reached
    best[0] = len(lengths)
    steps = np.zeros(budget + 1, np.int64)  # and how many of it
    for i, (length, count) in enumerate(zip(lengths, counts, strict=True)):
        reach = best >= 0
        if reach[budget]:
            break
        # For each residue, a sum is reached by at most `count` steps from the last sum reached before.
        for step in range(1, min(count, budget // length) + 1):
            fresh = np.zeros(budget + 1, bool)
            fresh[length * step :] = reach[: budget + 1 - length * step]
            fresh &= best < 0
            if not fresh.any() and step > 1:
                break
            best[fresh], steps[fresh] = i, step
    take, at = [0] * len(lengths), int(np.flatnonzero(best >= 0).max())
    while at:
        i = int(best[at])
        take[i] = int(steps[at])
        at -= take[i] * lengths[i]
    return take


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each exact length fill `budget` words; lengths ascending and positive."""
    total = int((lengths * counts).sum())
    take = np.zeros(len(lengths), np.int64)
    if budget <= 0 or not total:
        return take
    if budget >= total:
        return counts.copy()
    take = (counts * (budget / total)).astype(np.int64)
    left = budget - int((take * lengths).sum())
    more = _fill(lengths, counts - take, left, DP_WORDS)
    wide = min(DP_MOST, 2 * int(lengths[counts > take].max()))
    if wide > DP_WORDS and (more * lengths).sum() < left:  # long documents: the knapsack must hold two of any length
        more = max(more, _fill(lengths, counts - take, left, wide), key=lambda x: int((x * lengths).sum()))
    return take + more


def _fill(lengths: np.ndarray, counts: np.ndarray, left: int, table: int) -> np.ndarray:
    """Documents for `left` words: the largest lengths, then a knapsack of at most `table` words."""
    take = np.zeros(len(lengths), np.int64)
    for i in range(len(lengths) - 1, -1, -1):  # the largest first, while more is open than the knapsack takes
        if left <= table:
            break
        more = min(int(counts[i]), max(0, (left - table // 2) // int(lengths[i])))
        take[i] += more
        left -= more * int(lengths[i])
    if left > table:  # no more than one document fits: each length still open is over half of what is left
        fits = np.flatnonzero((counts > take) & (lengths <= left))
        if len(fits):
            take[fits[-1]] += 1
            left -= int(lengths[fits[-1]])
    free = np.flatnonzero((counts > take) & (lengths <= left))
    if len(free) and left <= table:
        take[free] += knapsack([int(lengths[i]) for i in free], [int(counts[i] - take[i]) for i in free], left)
    return take


def nearest(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """The fit, and one more of the shortest documents left where that ends nearer to `budget`, above it."""
    take = fit(lengths, counts, budget)
    gap, open_ = budget - int((take * lengths).sum()), np.flatnonzero(counts > take)
    if len(open_) and int(lengths[open_[0]]) - gap < gap:
        take[open_[0]] += 1
    return take


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def copies(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = CAP, seed: int = 17, keep: bool = False) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, copies (and the row itself as _row if `keep`)."""
    spark = docs.sparkSession
    sized = docs.select(*([F.struct("*").alias("_row")] if keep else []), "doc_id", F.col("source").alias("_source"), size_of().alias("size"), F.xxhash64("doc_id", "text", F.lit(seed)).alias("_hash"))
    sized = sized if keep else written(sized, "mix-sizes")
    null, bins = F.col("_source").isNull(), F.pmod(F.shiftright("_hash", 20), F.lit(BINS)).cast("int")
    histogram = sized.groupBy("_source", "size").agg(F.count(F.lit(1)).alias("n"))
    histogram = written(histogram, "mix-lengths")  # exact: a row per source and length
    sources = histogram.groupBy("_source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"), F.sum("n").alias("_docs"))
    rows = sorted(((r["_source"], int(r["source_size"])) for r in sources.collect()), key=lambda r: (r[0] is None, r[0] or ""))  # one row per source
    goal = targets([r[1] for r in rows], [weights[i % len(weights)] for i in range(len(rows))], cap)
    plan = spark.createDataFrame([(r[0], r[1], g) for r, g in zip(rows, goal, strict=True)], "_source string, source_size long, target double")

    def fill(key: tuple, lengths: pd.DataFrame) -> pd.DataFrame:
        lengths = lengths.sort_values("size")
        words, target = int(lengths["source_size"].iloc[0]), float(lengths["target"].iloc[0])
        passes = min(cap, int(target // words)) if words else 0
        size, n = lengths["size"].to_numpy(np.int64), lengths["n"].to_numpy(np.int64)
        some = size > 0
        extra = np.zeros(len(size), np.int64)
        if words and passes < cap:
            extra[some] = nearest(size[some], n[some], round(target - passes * words))
        return lengths.assign(_passes=np.where(some, passes, 0), _extra=extra)[["_source", "size", "source_size", "target", "_passes", "_extra"]]

    lengths = histogram.join(plan, histogram["_source"].eqNullSafe(plan["_source"])).select(histogram["_source"], "size", "n", "source_size", "target")
    lengths = lengths.groupBy("_source").applyInPandas(fill, "_source string, size long, source_size long, target double, _passes long, _extra long")
    lengths = written(lengths, "mix-counts")
    # The _extra-th smallest hash of each length: bins below it are taken whole, then the inner bins of its own bin, then ranks.
    inner = F.pmod(F.shiftright("_hash", 40), F.lit(BINS)).cast("int")
    same = (F.col("_z") == F.col("size")) & F.col("_s").eqNullSafe(F.col("_source"))
    wanted = lengths.filter("_extra > 0").select(F.col("_source").alias("_s"), F.col("size").alias("_z"), F.col("_extra").alias("_want"))
    binned = sized.groupBy("_source", "size", bins.alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    outer = written(_boundary(binned.join(wanted, same)), "mix-bins")
    asked = outer.select(F.col("_source").alias("_s"), F.col("size").alias("_z"), F.col("_bin").alias("_at"), F.col("_rest").alias("_want"))
    within = sized.withColumn("_bin", bins).join(asked, same & (F.col("_bin") == F.col("_at"))).groupBy("_source", "size", "_want", inner.alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    fine = _boundary(within).select(F.col("_source").alias("_fs"), F.col("size").alias("_fz"), F.col("_bin").alias("_cut2"), F.col("_rest").alias("_rest2"))
    cut = outer.join(fine, (F.col("_fz") == F.col("size")) & F.col("_fs").eqNullSafe(F.col("_source")), "left").select(F.col("_source").alias("_cs"), F.col("size").alias("_cz"), F.col("_bin").alias("_cut"), F.coalesce("_cut2", F.lit(0)).alias("_cut2"), F.coalesce("_rest2", F.lit(0)).alias("_rest"))
    lengths = lengths.join(cut, (F.col("_cz") == F.col("size")) & F.col("_cs").eqNullSafe(F.col("_source")), "left").select("_source", "size", "source_size", "target", "_passes", "_extra", F.coalesce("_cut", F.lit(BINS)).alias("_cut"), F.coalesce("_cut2", F.lit(0)).alias("_cut2"), F.coalesce("_rest", F.lit(0)).alias("_rest"))
    lengths = written(lengths.withColumnsRenamed({"_source": "_s", "size": "_z"}), "mix-cuts")
    joined = sized.withColumns({"_bin": bins, "_inner": inner}).join(lengths, (F.col("_z") == F.col("size")) & F.coalesce(F.col("_s"), F.lit("")).eqNullSafe(F.coalesce(F.col("_source"), F.lit(""))) & (F.col("_s").isNull() == null))
    edge = (F.col("_bin") == F.col("_cut")) & (F.col("_inner") == F.col("_cut2")) & (F.col("_rest") > 0)
    before = (F.col("_bin") < F.col("_cut")) | ((F.col("_bin") == F.col("_cut")) & (F.col("_inner") < F.col("_cut2")))
    ranked = F.row_number().over(Window.partitionBy("_source", "size").orderBy("_hash", "doc_id"))
    sure = joined.filter(~edge).withColumn("_more", F.when((F.col("_extra") > 0) & before, 1).otherwise(0))
    rest = joined.filter(edge).withColumn("_more", F.when(ranked <= F.col("_rest"), 1).otherwise(0))
    return sure.unionByName(rest).select(*(["_row"] if keep else []), "doc_id", "size", "source_size", "target", (F.col("_passes") + F.col("_more")).alias("copies"))


def _boundary(binned: DataFrame) -> DataFrame:
    """Of each (_source, size) the bin in which its _want-th row lies, and how many rows of that bin (_rest) that takes."""
    below = F.coalesce(F.sum("_n").over(Window.partitionBy("_source", "size").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = binned.withColumn("_below", below).filter("_below <= _want and _below + _n > _want")
    return cut.select("_source", "size", "_bin", (F.col("_want") - F.col("_below")).alias("_rest"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = CAP, seed: int = 17) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken."""
    return copies(docs, weights, cap, seed).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_rows(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = CAP, seed: int = 17) -> DataFrame:
    """The mix itself: the rows of `docs`, each as often as the mix takes it."""
    taken = copies(docs, weights, cap, seed, keep=True).filter("copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")
