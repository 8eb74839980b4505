"""Connected components of an edge table by least labels with pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every end of `edges` (a, b): label is the least node that is reachable.

    A round gives each node the least label among its neighbours' and its own, then that label's own label; it is
    a written table. The rounds needed grow with the logarithm of the longest path for the shapes met here, and the
    loop ends when no label changes, which it must reach since every round before lowers one. Null ends are left out; repeated edges and loops do no harm.
    """
    both = edges.filter("a is not null and b is not null").select("a", "b")
    both = written(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("_near"))
        least = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.least("label", "_near").alias("_new"), F.col("label").alias("_old"))
        jump = labels.select(F.col("node").alias("_to"), F.col("label").alias("_jump"))
        out = least.join(jump, F.col("_new") == F.col("_to"), "left").select("node", F.least("_new", "_jump").alias("label"), (F.least("_new", "_jump") < F.col("_old")).alias("_moved"))
        out, before = written(out, "labels"), labels
        labels = out.select("node", "label")
        discard(before)
        labels._written_at = out._written_at
        if not out.filter("_moved").limit(1).count():
            discard(both)
            return labels
