"""Graph operators over an edge table (source_id, target_id, type, confidence)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import kept

#: Steps of an entity that stand together: an entity with more has its steps dealt over as many lists as it needs.
LIST = 4096


def _steps(edges: DataFrame, direction: str) -> DataFrame:
    """(a, b, c): steps from a to b with confidence c; BOTH is the union of both ways, so each hop is one equi-join."""
    known = edges.filter("source_id is not null and target_id is not null")
    out = known.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.col("confidence").alias("c"))
    back = out.select(F.col("b").alias("a"), F.col("a").alias("b"), "c")
    return {"OUT": out, "IN": back, "BOTH": out.unionByName(back)}[direction]


def neighbors(
    edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "OUT", types: Sequence[str] | None = None, min_confidence: float = 0.0, limit: int | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """(entity_id, hop_distance, path_confidence) within `depth` steps of the seeds (column id), and `by` columns of
    the seeds, whose values traverse apart.

    Least hop and greatest product of confidences are taken apart from each other. Edges under `min_confidence` are not walked.
    A hop goes on only from entities that it reached with a greater confidence than any hop before: another walk
    through one can't end better than the walk that was there first, since products only shrink. The traversal ends when no entity
    is left. An entity's steps are cut into lists of about `LIST`, so a hub's are dealt over many tasks. Each hop is a
    written table. Depth below 1 gives no rows.
    """
    by = list(by)
    start = seeds.select(*by, F.col("id").alias("entity_id")).distinct().withColumns({"hop_distance": F.lit(0), "path_confidence": F.lit(1.0)})
    if depth < 1:
        return start.limit(0)
    used = edges.filter(F.col("confidence") >= min_confidence)
    if types is not None:
        used = used.filter(F.col("type").isin(*types))
    steps = _steps(used, direction).groupBy("a", "b").agg(F.max("c").alias("c"))
    if depth > 1:
        steps = kept(steps)
    lists = steps.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / LIST).cast("int").alias("_lists"))
    dealt = steps.join(lists, "a").select("a", "b", "c", F.pmod(F.xxhash64("b"), F.col("_lists")).cast("int").alias("_list"))
    best = frontier = start
    for hop in range(1, depth + 1):
        spread = frontier.join(lists, F.col("entity_id") == F.col("a")).select(*by, "a", "path_confidence", F.explode(F.sequence(F.lit(0), F.col("_lists") - 1)).alias("_list"))
        reached = spread.join(dealt, ["a", "_list"]).groupBy(*by, F.col("b").alias("entity_id")).agg(F.max(F.col("path_confidence") * F.col("c")).alias("_new"))
        both = best.withColumn("_new", F.lit(None).cast("double")).unionByName(reached.select(*by, "entity_id", F.lit(None).cast("int").alias("hop_distance"), F.lit(None).cast("double").alias("path_confidence"), "_new"))
        met = both.groupBy(*by, "entity_id").agg(F.max("hop_distance").alias("hop_distance"), F.max("path_confidence").alias("path_confidence"), F.max("_new").alias("_new"))
        better = F.coalesce(F.col("_new") > F.coalesce("path_confidence", F.lit(-1.0)), F.lit(False))
        met = met.select(*by, "entity_id", F.coalesce("hop_distance", F.lit(hop)).alias("hop_distance"), F.greatest("path_confidence", "_new").alias("path_confidence"), better.alias("_better"))
        met = met if hop == depth else kept(met)
        best, frontier = met.drop("_better"), met.filter("_better").drop("_better", "hop_distance")
        if hop < depth and frontier.isEmpty():
            break
    return best if limit is None else best.orderBy("hop_distance", F.desc("path_confidence"), "entity_id").limit(limit)


def in_degrees(edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(id, degree): edges into each id; with `ids` (column id) those only, 0 where none comes in."""
    degree = edges.filter("target_id is not null").groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    if ids is None:
        return degree
    return ids.select("id").distinct().join(degree, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def direct_partners(edges: DataFrame, seeds: DataFrame, kind: str = "CALLS") -> DataFrame:
    """(id): what seeds (column id) call and what calls them."""
    calls = edges.filter((F.col("type") == kind) & F.col("target_id").isNotNull())
    called = calls.join(seeds.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(F.col("target_id").alias("id"))
    calling = calls.join(seeds.select(F.col("id").alias("target_id")), "target_id", "left_semi").select(F.col("source_id").alias("id"))
    return called.unionByName(calling).distinct()


def linked_tests(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id): sources of TESTS edges into the seeds."""
    tests = edges.filter(F.col("type") == "TESTS")
    return tests.join(seeds.select(F.col("id").alias("target_id")), "target_id", "left_semi").select(F.col("source_id").alias("id")).distinct()


def low_confidence_incoming(edges: DataFrame, bound: float = 0.75) -> DataFrame:
    """(id, low): incoming edges under `bound`."""
    return edges.filter("target_id is not null").groupBy(F.col("target_id").alias("id")).agg(F.count_if(F.col("confidence") < bound).alias("low"))
