"""A stored inverted index: segments of postings in buckets of terms, tombstones, and merges.

A posting (term, id, file_path, f, length, seq) stands in the bucket of its term's first six characters, so a clause,
exact or prefix, reads one bucket's files: the bucket is a partition folder, and only those asked for are listed and opened. Within
a bucket rows are sorted by term. A change of files appends a segment with the postings of their entities and a tombstone
for every file whose older postings no longer hold; nothing that stood before is rewritten. When there are `MERGE_AT` segments
they are merged into one without the dead rows. What BM25 needs of the whole corpus, the count of documents and their total length, is kept in
the state, so a question opens its buckets and the tombstones and nothing else.

The state is a small dictionary that the store's manifest holds: a version sees the segments that its manifest lists.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import PREFIX
from corvane.operators import search
from corvane.session import kept

BUCKETS, MERGE_AT = 64, 8
POSTINGS = "term string, id string, file_path string, f double, length long, seq int, bucket int"
DOCS = "id string, file_path string, length long, seq int"
TOMBS = "file_path string, seq int"
EMPTY = {"segments": [], "next": 0, "documents": 0, "length": 0}


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(term, 1, PREFIX)), F.lit(BUCKETS)).cast("int")


class Postings:
    """The postings below a folder, as a state has them."""

    def __init__(self, spark: SparkSession, root: str, state: dict | None = None) -> None:
        self.spark, self.root, self.state = spark, root.rstrip("/"), state or dict(EMPTY)

    def _table(self, name: str, ddl: str, buckets: list[int] | None = None) -> DataFrame:
        """A table's rows over all segments; of the postings only the folders of the asked buckets are read."""
        out = self.spark.createDataFrame([], ddl).limit(0)
        for segment in self.state["segments"]:
            rows = self.spark.read.schema(ddl).parquet(f"{self.root}/{segment}/{name}")
            out = out.unionByName(rows if buckets is None else rows.filter(F.col("bucket").isin(*buckets)))
        return out

    def _living(self, rows: DataFrame) -> DataFrame:
        """Rows that no later segment has a tombstone for."""
        dead = self._table("tombs", TOMBS).groupBy("file_path").agg(F.max("seq").alias("_dead"))
        return rows.join(dead, "file_path", "left").filter("_dead is null or seq >= _dead").drop("_dead")

    def added(self, docs: DataFrame, gone: DataFrame, columns: dict[str, float] | None = None) -> dict:
        """The state after `docs` (id, file_path and the text columns) are added and the older documents of the files of `gone` (file_path) are dropped.

        The older documents of a file that `docs` has are dropped only if `gone` names it too.
        """
        state, seq, name = self.state, self.state["next"], f"segment-{uuid.uuid4().hex}"
        at = f"{self.root}/{name}"
        columns = columns or search.WEIGHTS
        # Each text is cut into words once, and the documents' lengths and the postings are both read from that.
        words = kept(search.worded(docs, columns, ("file_path",)))
        facts = words.select(F.col("id").cast("string").alias("id"), "file_path", F.col("length").cast("long").alias("length"), F.lit(seq).alias("seq"))
        facts.write.parquet(f"{at}/docs")
        facts = self.spark.read.schema(DOCS).parquet(f"{at}/docs")
        gone.select("file_path").distinct().withColumn("seq", F.lit(seq)).write.parquet(f"{at}/tombs")
        tombs = self.spark.read.schema(TOMBS).parquet(f"{at}/tombs")
        # Postings carry what is known of their document: only the write's own shuffle moves them.
        found = search.summed(words)
        rows = found.select("term", F.col("id").cast("string").alias("id"), "file_path", F.col("f").cast("double").alias("f"), F.col("length").cast("long").alias("length"), F.lit(seq).alias("seq"), bucket(F.col("term")).alias("bucket"))
        # A rebalance splits the bucket of a very common term over tasks, and puts small ones together.
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{at}/postings")
        lost = self._living(self._table("docs", DOCS)).join(tombs.select("file_path"), "file_path", "left_semi").agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        more = facts.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        new = {"segments": [*state["segments"], name], "next": seq + 1, "documents": state["documents"] - lost[0] + more[0], "length": state["length"] - lost[1] + more[1]}
        self.state = new
        return self.merged() if len(new["segments"]) >= MERGE_AT else new

    def merged(self) -> dict:
        """The state with one segment that has the living rows alone; older segments stay for the versions that list them."""
        seq, name = self.state["next"], f"segment-{uuid.uuid4().hex}"
        at = f"{self.root}/{name}"
        self._living(self._table("docs", DOCS)).withColumn("seq", F.lit(seq)).write.parquet(f"{at}/docs")
        self.spark.createDataFrame([], TOMBS).write.parquet(f"{at}/tombs")
        rows = self._living(self._table("postings", POSTINGS)).withColumn("seq", F.lit(seq))
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{at}/postings")
        self.state = self.state | {"segments": [name], "next": seq + 1}
        return self.state

    def scores(self, asked: DataFrame) -> DataFrame:
        """(query_id, id, score) by BM25 for the clauses `asked` (query_id, term, is_prefix)."""
        buckets = [r[0] for r in asked.select(bucket(F.col("term")).alias("b")).distinct().collect()]  # at most BUCKETS numbers
        rows = self._living(self._table("postings", POSTINGS, buckets))
        n, total = self.state["documents"], self.state["length"]
        corpus = self.spark.createDataFrame([(n, total / n if n else 0.0)], "n_docs long, mean double")
        return search.bm25(rows, None, asked, corpus)

    def terms(self) -> DataFrame:
        """(term, n_docs): every living term and the documents that have it."""
        return self._living(self._table("postings", POSTINGS)).groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"))
