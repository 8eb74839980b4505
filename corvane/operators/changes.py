"""Incremental maintenance: what changed on disk, and the next snapshot of the index's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.schemas import RELATION_KEY


def change_set(disk: DataFrame, index: DataFrame) -> DataFrame:
    """(path, change): added, modified, deleted or unchanged, by content hash alone."""
    d, i = disk.select("path", F.col("content_hash").alias("_d")), index.select("path", F.col("content_hash").alias("_i"))
    change = F.when(F.col("_i").isNull(), "added").when(F.col("_d").isNull(), "deleted").when(F.col("_d") == F.col("_i"), "unchanged").otherwise("modified")
    return d.join(i, "path", "full_outer").select("path", change.alias("change"))


def unread(listing: DataFrame, index: DataFrame) -> DataFrame:
    """Rows of `listing` (path, mtime_ms, size_bytes) whose time or size differ from the index: those to read."""
    return listing.join(index.select("path", "mtime_ms", "size_bytes"), ["path", "mtime_ms", "size_bytes"], "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """`new` in place of the rows of `old` with its keys."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def first_wins(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row per key, the first by `order`."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def dedup_relations(relations: DataFrame) -> DataFrame:
    """One row per key: a resolved one first, then by metadata and target, so that reruns agree."""
    return first_wins(relations, RELATION_KEY, [F.col("target_id").isNull(), F.col("metadata").asc_nulls_last(), F.col("target_id")])


def demote(relations: DataFrame, entities: DataFrame, paths: DataFrame) -> DataFrame:
    """Edges after the files of `paths` (column path) are purged.

    Edges born in them go. Edges of other files into their entities go back to unresolved, hint kept.
    """
    gone = entities.join(paths.select(F.col("path").alias("file_path")), "file_path", "left_semi").select(F.col("id").alias("target_id")).distinct().withColumn("_gone", F.lit(True))
    kept = relations.join(paths.select(F.col("path").alias("file_path")), "file_path", "left_anti").join(gone, "target_id", "left")
    lost = F.coalesce("_gone", F.lit(False))
    out = kept.withColumns({"resolution": F.when(lost, "UNRESOLVED").otherwise(F.col("resolution")), "confidence": F.when(lost, 0.0).otherwise(F.col("confidence")), "target_id": F.when(~lost, F.col("target_id"))})
    return out.select(*relations.columns)


def purge(table: DataFrame, paths: DataFrame, column: str) -> DataFrame:
    """`table` without the rows of the files in `paths`."""
    return table.join(paths.select(F.col("path").alias(column)), column, "left_anti").select(*table.columns)


def ordinals(entities: DataFrame) -> DataFrame:
    """Ordinal of each repeat of a type and qualified name within a file, in order of position, from 0."""
    w = Window.partitionBy("file_path", "type", "qualified_name").orderBy("start_byte", "end_byte")
    return entities.withColumn("ordinal", F.row_number().over(w) - 1)
