"""What a scan does per file grows with the files alone and is done once, by many tasks."""

from pyspark.sql import functions as F

from corvane.api import Project
from corvane.extract import script
from corvane.functions import text
from corvane.operators import postings, search
from corvane.plans.projects import tree
from corvane.sources import ignore, scan


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_paths_are_tested_after_they_are_dealt_out(spark, tmp_path, monkeypatch):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.ts").write_text("f()")
    seen, plain = [], scan.kept
    monkeypatch.setattr(scan, "kept", lambda df: seen.append(df) or plain(df))
    scan.scan(spark, str(tmp_path))
    dealt = next(plan(df) for df in seen if "state" in df.columns)
    assert "RLIKE" in dealt and "RLIKE" not in dealt.split("Exchange")[1]


def test_ignored_folders_above_a_file(spark):
    rules = [ignore.compile_line(x) for x in ("build/", "/a/b", "*.tmp", "c?")]
    paths = {"build/x.ts": True, "x/build/y/z.ts": True, "build": False, "a/b/c/d.ts": True, "x/a/b/d.ts": False, "a.tmp/x.ts": True, "x.tmp": True, "cd/x.ts": True, "cde/x.ts": False, "rebuild/x.ts": False}
    got = spark.createDataFrame([(p,) for p in paths], "path string").select("path", ignore.ignored_file(F.col("path"), rules)).collect()
    assert {r[0]: r[1] for r in got} == paths


def test_estimates_are_made_where_files_are_read(spark, tmp_path):
    (tmp_path / "a.md").write_text("some plain words, HTTPServer and 12345\n")
    (tmp_path / "b.md").write_bytes(b"\xff\xfe words")
    (tmp_path / "c.md").write_text("more words")
    files = spark.createDataFrame([("a.md", True), ("b.md", True), ("c.md", False)], "path string, now boolean")
    got = {r["path"]: r["estimate"] for r in scan.opened(spark, str(tmp_path), files, "now").collect()}
    assert got == {"a.md": text.estimate((tmp_path / "a.md").read_text()), "b.md": None, "c.md": None}


def test_tokens_of_files_after_a_scan(spark, tmp_path):
    root = tmp_path / "p"
    root.mkdir()
    said = {"a.ts": "export function f(x) { return g(x, 'some words'); }\n", "b.py": "def f():\n    return g()\n", "bad.ts": "function bad( {{{", "c.md": "plain words\r\n12345", "empty.ts": ""}
    for name, content in said.items():
        (root / name).write_bytes(content.encode())
    p = Project(spark, str(root), f"file://{tmp_path}/index")
    p.scan()
    assert {r["path"]: r["token_estimate"] for r in p.files().collect()} == {name: text.estimate(content) for name, content in said.items()}
    (root / "a.ts").write_text("export const y = 1;\n")
    p.scan()
    assert p.file("a.ts").first()["token_estimate"] == text.estimate("export const y = 1;\n") and p.file("b.py").first()["token_estimate"] == text.estimate(said["b.py"])


def test_words_are_cut_once_for_lengths_and_postings(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(str(i), f"f{i}", "a.b a", "x y z" if i % 2 else "x b x") for i in range(20)], "id string, file_path string, terms string, literals string")
    asked, plain = [], search.tokens
    monkeypatch.setattr(search, "tokens", lambda c: asked.append(c) or plain(c))
    index = postings.Postings(spark, f"file://{tmp_path}/i")
    index.added(docs, docs.select("file_path").limit(0))
    assert len(asked) == 2  # a column of text each
    rows = index._table("postings", postings.POSTINGS)
    want = [("1", t, f, 6) for t, f in (("a", 8.0), ("b", 4.0), ("x", 1.0), ("y", 1.0), ("z", 1.0))] + [("2", t, f, 6) for t, f in (("a", 8.0), ("b", 5.0), ("x", 2.0))]
    assert sorted(map(tuple, rows.filter("id in ('1', '2')").select("id", "term", "f", "length").collect())) == want


def test_a_file_that_is_written_again_has_the_new_content_alone(spark, tmp_path):
    for content in ("a long content", "short"):
        tree(spark, spark.createDataFrame([("d/x.ts", content)], "path string, content string"), str(tmp_path))
        assert [(f.name, f.read_text()) for f in (tmp_path / "d").iterdir()] == [("x.ts", content)]


def test_tokens_end_before_the_blanks_that_follow():
    code, comments = script.tokenize('  a  /* c */  "s\\"t"  \n')
    assert [(t.text, t.start, t.end) for t in code + comments] == [("a", 2, 3), ('"s\\"t"', 14, 20), ("/* c */", 5, 12)]
