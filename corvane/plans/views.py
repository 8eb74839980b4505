"""The index's tables as views over the star-schema test tables, for queries that run on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import ids, text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paths(docs: DataFrame) -> DataFrame:
    """Documents as files: source/doc_id.ending, the ending standing for the language."""
    ending = F.when(F.col("lang") == "en", "ts").when(F.col("lang") == "fr", "py").when(F.col("lang") == "de", "js").otherwise("md")
    return docs.withColumn("path", F.concat_ws("/", "source", F.concat_ws(".", F.col("doc_id").cast("string"), ending)))


PATHS_SQL = "SELECT *, source || '/' || doc_id || '.' || CASE lang WHEN 'en' THEN 'ts' WHEN 'fr' THEN 'py' WHEN 'de' THEN 'js' ELSE 'md' END AS path FROM documents"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = paths(table(spark, sf_dir, "documents"))
    return docs.select("path", ids.language(F.col("path")).alias("language"), F.octet_length("text").alias("size_bytes"), text.line_count(F.col("text")).alias("line_count"), ids.content_hash(F.col("text")).alias("content_hash"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as named entities: the name repeats, the brand is the file, the size's parity the visibility."""
    p = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") % 3 == 0, "FUNCTION").when(F.col("p_size") % 3 == 1, "METHOD").otherwise("CLASS")
    return p.select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"), kind.alias("type"), F.col("p_name").alias("name"), F.concat_ws(".", "p_type", "p_name").alias("qualified_name"),
        F.col("p_brand").alias("file_path"), (F.col("p_size") % 2 == 0).alias("exported"), F.col("p_size").alias("token_estimate"),
    )


ENTITIES_SQL = """SELECT 'P' || p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'FUNCTION' WHEN 1 THEN 'METHOD' ELSE 'CLASS' END AS type, p_name AS name,
  p_type || '.' || p_name AS qualified_name, p_brand AS file_path, p_size % 2 = 0 AS exported, p_size AS token_estimate FROM part"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as edges from part to supplier; the confidence is one less the discount, the type the return flag's."""
    kind = F.when(F.col("l_returnflag") == "A", "CALLS").when(F.col("l_returnflag") == "N", "IMPORTS").otherwise("TESTS")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("source_id"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("target_id"), kind.alias("type"),
        F.round(1 - 5 * F.col("l_discount"), 2).alias("confidence"), F.col("l_linenumber").alias("line"), F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("file_path"),
    )


EDGES_SQL = """SELECT 'P' || l_partkey AS source_id, 'S' || l_suppkey AS target_id, CASE l_returnflag WHEN 'A' THEN 'CALLS' WHEN 'N' THEN 'IMPORTS' ELSE 'TESTS' END AS type,
  round(1 - 5 * l_discount, 2) AS confidence, l_linenumber AS line, 'O' || l_orderkey AS file_path FROM lineitem"""


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, nation, customer and supplier as a tree of edges from child to parent."""
    n, c, s = (table(spark, sf_dir, x) for x in ("nation", "customer", "supplier"))
    up = n.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("source_id"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("target_id"), F.lit("IMPORTS").alias("type"), F.lit(0.9).alias("confidence"))
    mid = c.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("source_id"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("target_id"), F.lit("CALLS").alias("type"), F.when(F.col("c_acctbal") < 0, 0.25).otherwise(0.75).alias("confidence"))
    low = s.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("source_id"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("target_id"), F.lit("EXTENDS").alias("type"), F.lit(0.5).alias("confidence"))
    return up.unionByName(mid).unionByName(low)


HIERARCHY_SQL = """SELECT 'N' || n_nationkey AS source_id, 'R' || n_regionkey AS target_id, 'IMPORTS' AS type, 0.9::DOUBLE AS confidence FROM nation
  UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 'CALLS', CASE WHEN c_acctbal < 0 THEN 0.25 ELSE 0.75 END::DOUBLE FROM customer
  UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'EXTENDS', 0.5::DOUBLE FROM supplier"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("task"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("terms"), F.coalesce("text", F.lit("")).alias("literals"))
