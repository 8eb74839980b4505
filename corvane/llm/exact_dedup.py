"""Exact dedup by an extendible-hash index on shared files (DataFrame functions only).

Keys are 64-bit hashes of the text. A directory over the leading key bits is built by doubling: a bucket that
holds more rows than its capacity is split by one more bit, up to `max_depth`. A bucket that is still overfull
holds copies of few keys, so its rows are dealt to several owners by a salt. Each owner task takes a contiguous
range of buckets, and chains texts whose keys collide, which compares their bytes. The index entries
(bucket, key, digest, rows, row to keep) are files in the shared folder; a lookup joins the documents with them.

Nulls: a null text counts as empty; a null doc_id sorts below all others. Repeated rows: of rows with equal text
and equal doc_id one stays, the last in the order of the input files. No rows: no rows. Texts of any length are
compared whole. Other columns are kept by `keep_rows`, whatever their names. Rows are numbered once, in a written
table that every step reads, so it doesn't matter where `docs` comes from and whether Spark computes it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import partitions, written

#: Bits of the largest directory: at most 2**16 entries, so its size is bounded.
MAX_DEPTH = 16


def directory(counts: dict[int, int], capacity: int, max_depth: int = MAX_DEPTH) -> list[tuple[int, int, int]]:
    """Buckets as (first prefix, depth, rows), by splitting every overfull bucket in two until none is left."""
    size = 1 << max_depth
    total = [0] * (size + 1)
    for i in range(size):
        total[i + 1] = total[i] + counts.get(i, 0)
    out, stack = [], [(0, 0)]
    while stack:
        first, depth = stack.pop()
        width = size >> depth
        rows = total[first + width] - total[first]
        if rows > capacity and depth < max_depth:
            stack += [(first + width // 2, depth + 1), (first, depth + 1)]
        else:
            out.append((first, depth, rows))
    return out


def _numbered(docs: DataFrame, text: str, order: str, rows: bool = False) -> DataFrame:
    """_text, _order, _uid (and the row itself as _row) of each row, written."""
    own = [F.coalesce(F.col(text), F.lit("")).alias("_text")] if not rows else [F.struct("*").alias("_row")]
    out = written(docs.select(*own, F.coalesce(F.col(order), F.lit(-(1 << 63))).cast("long").alias("_order"), F.monotonically_increasing_id().alias("_uid")), "numbered")
    return out.withColumn("_text", F.coalesce(F.col("_row")[text], F.lit(""))) if rows else out


def index(numbered: DataFrame, capacity: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(digests, entries): a digest row per document (uid, order, key, sha) and an index entry per distinct text."""
    spark, parts = numbered.sparkSession, partitions(numbered.sparkSession)
    full = numbered.select("_text", "_order", "_uid").withColumn("_key", F.xxhash64("_text"))
    prefix = F.shiftrightunsigned("_key", 64 - MAX_DEPTH).cast("int")
    counts = {r[0]: r[1] for r in full.groupBy(prefix.alias("p")).count().collect()}  # at most 2**MAX_DEPTH rows
    rows = sum(counts.values())
    capacity = capacity or max(16, -(-rows // (8 * parts)))
    buckets = directory(counts, capacity)
    share, seen, table = max(1, -(-rows // parts)), 0, []
    for n, (first, depth, count) in enumerate(buckets):
        salts = max(1, -(-count // capacity))
        table.append((first, n, min(parts - 1, seen // share), salts, MAX_DEPTH - depth))
        seen += count
    # A directory entry per prefix that has rows: bounded by 2**MAX_DEPTH.
    entry, of = [], 0
    for p in sorted(counts):
        while of + 1 < len(table) and table[of + 1][0] <= p:
            of += 1
        entry.append((p, table[of][1], table[of][2], table[of][3]))
    names = spark.createDataFrame(entry, "_prefix int, _bucket int, _owner int, _salts int") if entry else spark.createDataFrame([], "_prefix int, _bucket int, _owner int, _salts int")
    dealt = (
        full.withColumn("_prefix", prefix)
        .join(F.broadcast(names), "_prefix")
        .withColumn("_owner", F.when(F.col("_salts") > 1, F.pmod(F.col("_owner") + F.pmod(F.xxhash64("_uid"), F.col("_salts")), F.lit(parts))).otherwise(F.col("_owner")).cast("int"))
    )
    chained = (
        dealt.repartitionById(parts, "_owner")
        .groupBy("_owner", "_bucket", "_key", "_text")
        .agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct("_order", "_uid")).alias("_keep"))
        .select("_bucket", "_key", F.sha2("_text", 256).alias("_sha"), "_n", F.col("_keep._order").alias("_keep_order"), F.col("_keep._uid").alias("_keep_uid"))
    )
    chained = written(chained, "hash-index")
    entries = chained.groupBy("_key", "_sha").agg(F.sum("_n").alias("_n"), F.max(F.struct("_keep_order", "_keep_uid")).alias("_keep"))
    entries = entries.filter("_n > 1").select("_key", "_sha", "_n", F.col("_keep._keep_order").alias("_keep_order"), F.col("_keep._keep_uid").alias("_keep_uid"))
    digests = full.select("_uid", "_order", "_key", F.sha2("_text", 256).alias("_sha"))
    return digests, written(entries, "hash-index-merged")


def exact_groups(docs: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    digests, entries = index(_numbered(docs, text, order))
    null = F.lit(-(1 << 63)).cast("long")
    out = digests.join(entries, ["_key", "_sha"], "left")
    return out.select(
        F.nullif("_order", null).alias("doc_id"), F.nullif(F.coalesce("_keep_order", "_order"), null).alias("keep_id"), F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("_uid") == F.col("_keep_uid"), F.lit(True)).alias("kept"), F.col("_sha").alias("text_sha256"),
    )


def keep_rows(docs: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """The rows of `docs` that stay, with their columns as they came."""
    numbered = _numbered(docs, text, order, rows=True)
    _, entries = index(numbered)
    wide = numbered.select("_row", "_uid", F.xxhash64("_text").alias("_key"), F.sha2("_text", 256).alias("_sha"))
    out = wide.join(entries.select("_key", "_sha", "_keep_uid"), ["_key", "_sha"], "left")
    return out.filter(F.col("_keep_uid").isNull() | (F.col("_keep_uid") == F.col("_uid"))).select("_row.*")
