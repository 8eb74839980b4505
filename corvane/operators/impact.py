"""Impact: what is reached backwards from a symbol, with a stated risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import scoring
from corvane.functions.words import IMPACT_TYPES
from corvane.operators import graph

HOPS, EDGE_CONFIDENCE, LOW = 3, 0.3, 0.75


def targets(entities: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, id, exported, alternatives) for asked (query_id, target): by id, else the first exported by name, else the first."""
    forms = [entities.select(F.col(c).alias("target"), "id", "exported", F.lit(o).alias("_o")) for o, c in enumerate(("id", "name", "qualified_name"))]
    met = asked.join(forms[0].unionByName(forms[1]).unionByName(forms[2]), "target").groupBy("query_id", "id").agg(F.min(F.least("_o", F.lit(1))).alias("_o"), F.first("exported").alias("exported"))
    w = Window.partitionBy("query_id").orderBy("_o", F.desc("exported"), "id")
    met = met.withColumns({"_n": F.row_number().over(w), "alternatives": F.count(F.lit(1)).over(Window.partitionBy("query_id")) - 1})
    return met.filter("_n = 1").select("query_id", "id", "exported", "alternatives")


def alternatives(entities: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, id): the other entities that an asked target (query_id, target) names, beside the chosen one."""
    forms = entities.select(F.explode(F.array_distinct(F.array("id", "name", "qualified_name"))).alias("target"), "id")
    chosen = targets(entities, asked).select("query_id", "id")
    return asked.join(forms, "target").select("query_id", "id").distinct().join(chosen, ["query_id", "id"], "left_anti")


def reached(entities: DataFrame, relations: DataFrame, chosen: DataFrame, hops: int = HOPS, min_confidence: float = EDGE_CONFIDENCE) -> DataFrame:
    """(query_id, id, reach, hop_distance, path_confidence, ...): direct at hop 1, indirect beyond; the target itself is left out."""
    near = graph.neighbors(relations, chosen.select("query_id", "id"), hops, "IN", IMPACT_TYPES, min_confidence, by=["query_id"]).filter("hop_distance > 0")
    rows = near.withColumnRenamed("entity_id", "id").join(entities.select("id", "type", "qualified_name", "file_path"), "id")
    return rows.withColumns({"reach": F.when(F.col("hop_distance") == 1, "direct").otherwise("indirect"), "is_test": scoring.is_test(F.col("type"), F.col("file_path"))})


def report(entities: DataFrame, relations: DataFrame, chosen: DataFrame, hops: int = HOPS, min_confidence: float = EDGE_CONFIDENCE) -> DataFrame:
    """A row per target: counts, files, tests, critical dependencies, low-confidence edges, risk and its reason."""
    rows = reached(entities, relations, chosen, hops, min_confidence)
    counts = rows.groupBy("query_id").agg(F.count_if(F.col("reach") == "direct").alias("direct"), F.count_if(F.col("reach") == "indirect").alias("indirect"), F.countDistinct("file_path").alias("files"), F.count_if("is_test").alias("tests"))
    low = relations.join(chosen.select("query_id", F.col("id").alias("target_id")), "target_id").groupBy("query_id").agg(F.count_if(F.col("confidence") < LOW).alias("low_confidence_edges"))
    needs = relations.filter("type = 'CALLS' and target_id is not null").join(chosen.select("query_id", F.col("id").alias("source_id")), "source_id").groupBy("query_id", "target_hint").agg(F.min("line").alias("line"))
    needs = needs.groupBy("query_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("line", "target_hint"))), lambda x: x["target_hint"]), 1, 10).alias("critical_dependencies"))
    out = chosen.join(counts, "query_id", "left").join(low, "query_id", "left").join(needs, "query_id", "left")
    n = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("direct", "indirect", "files", "tests", "low_confidence_edges")}
    out = out.withColumns({**n, "critical_dependencies": F.coalesce("critical_dependencies", F.array().cast("array<string>"))})
    args = [F.col(c) for c in ("direct", "indirect", "files", "tests", "exported")]
    return out.withColumns({"risk": scoring.risk(*args), "risk_reason": scoring.risk_reason(*args)})
