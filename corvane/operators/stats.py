"""Health of an index: counts, coverage and resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.scoring import ratio
from corvane.schemas import ANALYSED


def index_stats(files: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """One row: files, entities, relations, unresolved, total_tokens, coverage, resolved_ratio."""
    f = files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("token_estimate"), F.lit(0)).alias("total_tokens"), F.count_if(F.col("parse_state").isin(*ANALYSED)).alias("_ok"))
    e = entities.agg(F.count(F.lit(1)).alias("entities"))
    r = relations.agg(F.count(F.lit(1)).alias("relations"), F.count_if(F.col("target_id").isNull()).alias("unresolved"))
    out = f.crossJoin(e).crossJoin(r)  # one row each
    return out.select("files", "entities", "relations", "unresolved", "total_tokens", ratio(F.col("_ok"), F.col("files")).alias("coverage"), F.when(F.col("relations") > 0, 1 - F.col("unresolved") / F.col("relations")).otherwise(0.0).alias("resolved_ratio"))


def counts(table: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """(column, n), most first; the k first if asked."""
    out = table.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), column).limit(k) if k else out


def resolution_report(relations: DataFrame) -> DataFrame:
    return counts(relations, "resolution")


def skip_reasons(files: DataFrame) -> DataFrame:
    """(reason, n) of the files that were not read, most first; the reason is the one in their pseudo-hash."""
    reason = F.regexp_extract("content_hash", r"^skipped:([A-Z_]+):", 1)
    return files.filter(F.col("content_hash").startswith("skipped:")).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
