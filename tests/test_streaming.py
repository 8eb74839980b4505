from pyspark.sql import functions as F

from corvane.streaming import feed


def test_follow_keeps_a_snapshot(spark, tmp_path):
    ddl = "path string, content_hash string, seen_at long"
    spark.createDataFrame([("a", "1", 1), ("b", "1", 1), ("a", "2", 2)], ddl).coalesce(1).write.json(f"{tmp_path}/in", mode="append")
    state = {"now": spark.createDataFrame([], "path string, content_hash string")}

    def write(df, number):
        df.write.mode("overwrite").parquet(f"{tmp_path}/s{number}")
        state["now"] = spark.read.parquet(f"{tmp_path}/s{number}")

    run = lambda: feed.follow(spark.readStream.schema(ddl).json(f"{tmp_path}/in"), lambda: state["now"], write, f"{tmp_path}/check").awaitTermination(60)
    run()
    assert {(r[0], r[1]) for r in state["now"].collect()} == {("a", "2"), ("b", "1")}
    spark.createDataFrame([("b", None, 3), ("c", "1", 3)], ddl).coalesce(1).write.json(f"{tmp_path}/in", mode="append")
    run()
    assert {(r[0], r[1]) for r in state["now"].collect()} == {("a", "2"), ("c", "1")}


def test_recency_plan(spark, tmp_path):
    spark.createDataFrame([("a", "2024-01-01 10:00:00")], "path string, ts string").write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema("path string, ts timestamp").json(f"{tmp_path}/in")
    q = feed.recency(stream).select("path", F.col("last")).writeStream.format("memory").queryName("recency").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("recency").count() == 1
