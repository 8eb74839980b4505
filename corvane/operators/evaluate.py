"""Evaluation of selections against labelled cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.scoring import ratio
from corvane.functions.words import CASE_EXTENSIONS, REJECTED_SUBJECTS

MAX_FILES, MIN_WORDS = 20, 3


def reject_reason(subject: Column, files: Column) -> Column:
    """Why a commit makes no case, null if it makes one; the first reason holds."""
    words = F.size(F.filter(F.split(F.trim(subject), r"\s+"), lambda w: w != ""))
    code = F.exists(files, lambda p: F.lower(F.regexp_extract(p, r"\.([^./]+)$", 1)).isin(*CASE_EXTENSIONS))
    generic = F.lit(False)
    for pattern in REJECTED_SUBJECTS:
        generic = generic | F.trim(subject).rlike("(?i)" + pattern)
    return (
        F.when(generic, "subject").when(words < MIN_WORDS, "short message").when(F.size(files) == 0, "no files")
        .when(F.size(files) > MAX_FILES, "too many files").when(~code, "no code")
    )


def corpus(commits: DataFrame, limit: int) -> DataFrame:
    """The latest `limit` commits (sha, subject, files, ts) that make a case, with their code files as gold."""
    fit = commits.withColumn("reason", reject_reason(F.col("subject"), F.col("files"))).filter("reason is null")
    gold = F.filter("files", lambda p: F.lower(F.regexp_extract(p, r"\.([^./]+)$", 1)).isin(*CASE_EXTENSIONS))
    n = F.row_number().over(Window.orderBy(F.desc("ts"), "sha"))
    return fit.orderBy(F.desc("ts"), "sha").limit(limit).withColumn("n", n).select("sha", F.col("subject").alias("task"), gold.alias("expected"), "n")


def case_results(selected: DataFrame, gold: DataFrame) -> DataFrame:
    """(case_id, n_selected, n_expected, hits, recall, precision) from selected and gold (case_id, path)."""
    s, g = selected.select("case_id", "path").distinct(), gold.select("case_id", "path").distinct()
    hits = s.join(g, ["case_id", "path"]).groupBy("case_id").agg(F.count(F.lit(1)).alias("hits"))
    out = g.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_expected")).join(s.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_selected")), "case_id", "left").join(hits, "case_id", "left")
    n, h = F.coalesce("n_selected", F.lit(0)), F.coalesce("hits", F.lit(0))
    return out.select("case_id", n.alias("n_selected"), "n_expected", h.alias("hits"), ratio(h, F.col("n_expected")).alias("recall"), ratio(h, n).alias("precision"))


def percentile(values: Column, f: float) -> Column:
    """The element at floor(f n), the last at most, of the ascending values (an array)."""
    return F.try_element_at(F.sort_array(values), F.least(F.size(values), F.floor(F.lit(f) * F.size(values)).cast("int") + 1))


def place(n: int, f: float) -> float:
    """The share of n ascending values that picks the one at floor(f n), the last at most, as a discrete percentile."""
    return (min(n - 1, int(f * n)) + 0.5) / n if n else 0.5


def report(results: DataFrame, time: str | None = None) -> DataFrame:
    """One row over all cases: means, misses, and median and 95th percentile of `time`, which are picked from counts per value."""
    aggs = [F.count(F.lit(1)).alias("cases"), F.avg("recall").alias("mean_recall"), F.avg("precision").alias("mean_precision"), F.count_if(F.col("recall") == 0).alias("misses")]
    if time:
        n = results.filter(F.col(time).isNotNull()).count()
        aggs += [F.expr(f"percentile_disc({place(n, f)!r}D) WITHIN GROUP (ORDER BY `{time}`)").cast(results.schema[time].dataType).alias(name) for name, f in (("median", 0.5), ("p95", 0.95))]
    return results.agg(*aggs)


def worst(results: DataFrame, k: int = 8) -> DataFrame:
    """The k cases of least recall, ties to the smaller case."""
    return results.orderBy("recall", "case_id").limit(k)
