"""Postings are added up within each document's row."""

from corvane.operators import search


def test_postings_are_counted_without_a_shuffle(spark):
    docs = spark.createDataFrame([(1, "f1", "a b", "b c b"), (2, "f2", "", ""), (3, "f3", None, "c")], "id long, file_path string, terms string, literals string")
    got = search.counted(docs, None, ("file_path",))
    assert sorted(map(tuple, got.collect())) == [("a", 1, "f1", 4.0, 5), ("b", 1, "f1", 6.0, 5), ("c", 1, "f1", 1.0, 5), ("c", 3, "f3", 1.0, 1)]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
