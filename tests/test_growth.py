"""Work that grows with the rows is dealt out by the row, and what a worker holds at once doesn't grow with them."""

import json
import re

import pyarrow as pa
from pyspark.sql import functions as F

from corvane.extract import registry
from corvane.functions import text
from corvane.operators import resolve, search
from corvane.sources import scan


def test_files_are_read_by_many_tasks(spark, tmp_path):
    many = 3 * scan.FILES + 1
    paths = spark.range(many).selectExpr("cast(id as string) path").coalesce(1)
    assert scan.opened(spark, str(tmp_path), paths).rdd.getNumPartitions() >= 4  # a rebalance by bytes made one task of them


def test_a_flat_folder_is_handed_over_in_parts(tmp_path):
    for i in range(40):
        (tmp_path / f"{i}.ts").write_text("")
    held, scan.ROWS = scan.ROWS, 16
    try:
        got = list(scan._walker(str(tmp_path), [], 256)(iter([pa.RecordBatch.from_pydict({"path": [""]})])))
    finally:
        scan.ROWS = held
    assert [b.num_rows for b in got] == [16, 16, 9] and sum(k == "file" for b in got for k in b.column("kind").to_pylist()) == 40


def test_extraction_hands_over_bounded_batches():
    source = "\n".join(f"export function f{i}() {{ return g(); }}" for i in range(300))
    batch = pa.RecordBatch.from_pydict({"path": [f"{i}.ts" for i in range(150)], "language": ["typescript"] * 150, "content": [source] * 150})
    got = list(registry.rows_of(iter([batch]), ["path", "language", "content"]))
    assert sum(b.num_rows for b in got) == 150 and [p for b in got for p in b.column("path").to_pylist()] == [f"{i}.ts" for i in range(150)]
    assert len(got) > 1 and max(b.nbytes for b in got) < 2 * registry.HELD


def test_charges_by_the_unit():
    assert [text.estimate(x) for x in ("", "3abc", "a3.5", "x.3.4_", "     ", "a     b", "a      \nb", "HTTPServer_x", "_$", "5$", "\u00e9")] == [0, 2, 3, 4, 1, 3, 3, 3, 1, 2, 1]


def test_the_best_of_a_query_are_chosen_where_documents_lie(spark):
    docs = spark.range(300).selectExpr("id", "'' terms", "concat_ws(' ', 'common', 'word', if(id % 7 = 0, 'wordsmith', 'x'), repeat('common ', cast(id % 5 as int))) literals")
    asked = spark.createDataFrame([(q, t, p) for q in (1, 2) for t, p in (("common", False), ("word", False), ("wordsm", True))][1:], "query_id int, term string, is_prefix boolean")
    found, lengths = search.occurrences(docs)
    full, best = search.bm25(found, lengths, asked), search.bm25(found, lengths, asked, k=9)
    assert "hashpartitioning(query_id" not in full._jdf.queryExecution().executedPlan().toString()
    want = search.top(full.selectExpr("query_id", "id", "round(score, 9) score"), 9).select("query_id", "id", "score")
    assert sorted(map(tuple, best.collect())) == sorted(map(tuple, want.collect())) and best.count() == 18


def test_edges_that_ask_the_same_are_resolved_once(spark):
    entities = spark.createDataFrame([("e1", "run", "A.run", "a", True), ("e2", "run", "B.run", "b", False), ("s", "go", "B.go", "b", True)], "id string, name string, qualified_name string, file_path string, exported boolean")
    edges = [("s", "CALLS", "run", i, "b", m) for i in range(50) for m in (None, '{"expression": "this.run"}', '{"expression": "x.run"}')[i % 3 :][:1]]
    edges += [("s", "CALLS", "run", 0, "b", '{"expression": "this.run"}'), ("s", "CALLS", None, 0, "b", None)]  # one key, two calls; no hint
    edges = spark.createDataFrame(edges, "source_id string, type string, target_hint string, line int, file_path string, metadata string").withColumn("target_id", F.lit(None).cast("string"))
    bound = spark.createDataFrame([], "file_path string, local_name string, bound_path string")
    got = resolve.resolve_symbols(edges, entities, bound)
    rows = {r["line"]: (r["new_target"], r["new_resolution"], r["new_confidence"]) for r in got.collect()}
    assert got.count() == 50 and rows == {i: (("e2", "EXACT", 1.0), ("e2", "EXACT", 1.0), ("e2", "AMBIGUOUS", 0.5))[i % 3] if i % 3 or not i else ("e2", "SCOPED", 0.75) for i in range(50)}
    assert re.search(r"Aggregate \[target_hint[^\]]*_receiver", got._jdf.queryExecution().optimizedPlan().toString())  # questions, not edges, are probed


def test_imports_ask_for_their_stems(spark):
    files = ["a/x.ts", "a/x.js", "a/x/index.tsx", "a/y.mjs", "a/y.mjs.ts", "b.d.ts", "b", "p/__init__.py", "p/q.py", "a/.ts", "a/z.js/index.js", "a/index.ts"]
    asked = [("a/f.ts", h) for h in ("./x", "./x.js", "./y.mjs", "./y", "../b", "../p", "./z.js", ".", "./", "../../out", "./none", "..", "./.js")] + [("p/q.py", h) for h in (".", ".q", "..b", "..p")]
    imports = spark.createDataFrame([(f, "IMPORTS", h, 1, f) for f, h in asked], "source_id string, type string, target_hint string, line int, file_path string")
    table = spark.createDataFrame([(p,) for p in files], "path string")
    plain = imports.select("file_path", "target_hint", F.posexplode(resolve.import_candidates(F.col("file_path"), F.col("target_hint"))).alias("at", "path")).join(table, "path")
    want = {(r["file_path"], r["target_hint"]): r["path"] for r in plain.groupBy("file_path", "target_hint").agg(F.min_by("path", "at").alias("path")).collect()}
    got = resolve.resolve_imports(imports, table)
    assert {(r["file_path"], r["target_hint"]): r["path"] for r in got.collect()} == want and len(want) > 8
    assert "posexplode" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_nested_entities_are_charged_once(monkeypatch):
    import random

    draw, seen, plain = random.Random(5), [], text.estimate
    for _ in range(400):
        source = "".join(draw.choices(["a", "Bc", "aB", "HTTPServer", "somethinglonger", "Somethinglonger", "_", "$", ".", "3", "12.5", " ", "     ", "\t", "\n", "\r\n", "(", "\u00e9", "\u4e2d"], k=30))
        spans = [tuple(sorted((draw.randint(0, len(source)), draw.randint(0, len(source))))) for _ in range(5)] + [(0, len(source)), (4, 2)]
        assert text.estimates(source, spans) == [plain(source[a:b]) for a, b in spans]
    monkeypatch.setattr(text, "estimate", lambda t: seen.append(len(t)) or plain(t))
    source = 'class A:\n    def run(self):\n        return "' + "some words of a text " * 50 + '"\n'
    got = registry.EXTRACTORS["python"]("a.py", source).entities
    assert [e["token_estimate"] for e in got] == [plain(source[e["start_byte"] : e["end_byte"]]) for e in got] and len(got) == 3
    assert got[1]["literals"] == got[2]["literals"] == text.literal_words(source) and sum(seen) <= len(source)


def test_a_plain_word_is_charged_as_by_its_parts():
    for unit in ("a", "word", "Word", "sevenly", "eightlon", "twelveletter", "thirteenletre", "HTTP", "aB", "HTTPServer", "\u00e9", "\u4e2d", "_", "a1"):
        assert text.estimate(unit) == len(text._ONE_EACH.findall(text._BORDER.sub(" ", unit)))


def test_only_named_columns_are_measured(monkeypatch):
    source = "class A:\n    def run(self):\n        return 'words of it'\n"
    full, names = registry.EXTRACTORS["python"]("a.py", source).entities, ("id", "start_line")
    monkeypatch.setattr("corvane.extract.rows.estimates", None)
    monkeypatch.setattr("corvane.extract.rows.content_words", None)
    batch = pa.RecordBatch.from_pydict({"path": ["a.py"], "language": ["python"], "content": [source]})
    (got,) = registry.rows_of(iter([batch]), ["path", "language", "content"], names)
    assert json.loads(got.column("entities")[0].as_py()) == [{c: e[c] for c in names} for e in full] and len(full) == 3
