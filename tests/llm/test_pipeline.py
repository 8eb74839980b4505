import os

import pytest

pytestmark = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")


def test_stages_take_effect(spark):
    import corpus_pipeline
    from corvane.llm.common import written

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, "/root/testdata/sf0.001"), name)
        assert docs.columns == names
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] > counts[3] and counts[4] > 0
    assert docs.select("text").distinct().count() <= counts[3]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001")
    assert last.count() > 0 and last.filter("length > 2048").count() == 0


def test_stages_on_odd_rows(spark, docs, tmp_path):
    """Null, empty and long texts, repeated rows, a null doc_id, few words, and columns that clash with the stages' own."""
    import corpus_pipeline
    from corvane.llm.common import written

    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None, None, "a"), (2, "", None, "a"), (3, " \t", None, None), (4, "few words", None, "a"), (5, "few words", None, "b"), (5, "few words", None, "b"), (None, "no id", None, "b"), (6, long, None, "a"), (7, long + " x", None, "a")]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    table = docs(rows, {"_row": 1, "_score": 0.5, "_key": "k", "_uid": 2, "node": 3, "size": 4, "bucket": 5, "copies": 6})
    names, left = table.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = written(stage(spark, table, str(tmp_path)), name)
        assert table.columns == names
        left.append(sorted((r["doc_id"] or 0) for r in table.select("doc_id").collect()))
    assert left[0] == [0, 1, 2, 3, 4, 5, 5, 6, 7]  # no marks: all stay
    assert left[1] == [0, 2, 3, 5, 6, 7]  # the largest doc_id of equal texts, null and empty being equal
    assert left[2] == [0, 2, 3, 5, 6]  # 6 and 7 are near copies
    assert set(left[3]) <= {0, 5, 6}  # texts without words are never taken
    last = corpus_pipeline.STAGES[-1][1](spark, table, str(tmp_path))
    assert last.filter("doc_id = 6").count() > 1


def test_stages_on_no_rows(spark, docs, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    table = docs([])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table, str(tmp_path)).isEmpty()
