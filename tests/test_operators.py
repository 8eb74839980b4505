from pyspark.sql import functions as F

from corvane.operators import changes, evaluate, graph, resolve, search, select
from corvane.schemas import RELATIONS
from corvane.sources import ignore, secrets

EDGE = "source_id string, target_id string, type string, confidence double"


def walk(spark, edges, seeds, depth, direction, **more):
    df = graph.neighbors(spark.createDataFrame(edges, EDGE), spark.createDataFrame([(s,) for s in seeds], "id string"), depth, direction, **more)
    return {r["entity_id"]: (r["hop_distance"], r["path_confidence"]) for r in df.collect()}


def test_neighbors(spark):
    chain = [("d", "a", "CALLS", 1.0), ("a", "b", "CALLS", 1.0), ("b", "c", "CALLS", 1.0)]
    assert walk(spark, chain, ["a"], 2, "OUT") == {"a": (0, 1.0), "b": (1, 1.0), "c": (2, 1.0)}
    assert "c" not in walk(spark, chain, ["a"], 1, "OUT")
    assert set(walk(spark, chain, ["b"], 2, "IN")) == {"b", "a", "d"}
    assert walk(spark, [("a", "b", "CALLS", 0.5), ("b", "c", "CALLS", 0.5)], ["a"], 2, "OUT")["c"] == (2, 0.25)
    assert "b" not in walk(spark, [("a", "b", "CALLS", 0.2)], ["a"], 2, "OUT", min_confidence=0.5)
    assert set(walk(spark, [("a", "b", "CALLS", 1.0), ("b", "a", "CALLS", 1.0)], ["a"], 5, "OUT")) == {"a", "b"}
    imports = [("a", "b", "IMPORTS", 1.0)]
    assert "b" not in walk(spark, imports, ["a"], 1, "OUT", types=["CALLS"]) and "b" in walk(spark, imports, ["a"], 1, "OUT", types=["IMPORTS"])
    assert walk(spark, chain, ["a"], 0, "OUT") == {}


def test_degrees(spark):
    edges = spark.createDataFrame([("a", "t", "CALLS", 1.0), ("b", "t", "CALLS", 1.0)], EDGE)
    got = graph.in_degrees(edges, spark.createDataFrame([("t",), ("a",)], "id string")).collect()
    assert {r["id"]: r["degree"] for r in got} == {"t": 2, "a": 0}


def test_change_set(spark):
    ddl = "path string, content_hash string"
    got = changes.change_set(spark.createDataFrame([("a", "h1"), ("b", "other"), ("c", "h3")], ddl), spark.createDataFrame([("a", "h1"), ("b", "h2"), ("z", "h")], ddl))
    assert {r["path"]: r["change"] for r in got.collect()} == {"a": "unchanged", "b": "modified", "c": "added", "z": "deleted"}


def test_demotion(spark):
    rows = [("x#1", "y#1", "f", "CALLS", "EXACT", 1.0, "x", 1, None), ("y#1", "x#1", "g", "CALLS", "EXACT", 1.0, "y", 1, None)]
    entities = spark.createDataFrame([("x#1", "x"), ("y#1", "y")], "id string, file_path string")
    got = changes.demote(spark.createDataFrame(rows, RELATIONS), entities, spark.createDataFrame([("y",)], "path string")).collect()
    assert [(r["source_id"], r["target_id"], r["resolution"], r["confidence"], r["target_hint"]) for r in got] == [("x#1", None, "UNRESOLVED", 0.0, "f")]


def test_import_candidates(spark):
    cases = [("src/a/s.ts", "./r.js", "src/a/r.ts"), ("src/a/s.ts", "../lib", "src/lib/index.ts"), ("main.ts", "./x", "x.tsx"), ("pkg/a.py", ".b", "pkg/b.py"), ("pkg/sub/a.py", "..c", "pkg/c.py")]
    for file, hint, want in cases:
        assert want in spark.range(1).select(resolve.import_candidates(F.lit(file), F.lit(hint)).alias("c")).first()["c"], hint


def test_bm25_prefers_rare_and_exact(spark):
    docs = spark.createDataFrame([(1, "integracao dashboard", ""), (2, "integration test", ""), (3, "other words", "")], "id long, terms string, literals string")
    found, lengths = search.postings(docs)
    asked = spark.createDataFrame([(0, "integration", False), (0, "integr", True)], "query_id int, term string, is_prefix boolean")
    got = [r["id"] for r in search.top(search.bm25(found, lengths, asked), 5).orderBy("rank").collect()]
    assert got[0] == 2 and set(got) == {1, 2}


def test_greedy_degrades_and_caps_files(spark):
    ddl = "query_id int, id string, file_path string, score double, token_estimate int, hop_distance int, n_full int, n_signature int, n_reference int"
    rows = [(0, "a", "f1", 90.0, 100, 0, 100, 30, 10), (0, "b", "f2", 80.0, 100, 1, 100, 30, 10), (0, "c", "f3", 70.0, 10, 1, None, 20, 10)]
    got = select.greedy(spark.createDataFrame(rows, ddl), spark.createDataFrame([(0, 145)], "query_id int, budget int"))
    assert {r["id"]: (r["detail"], r["reason"]) for r in got.collect()} == {"a": ("FULL", None), "b": ("SIGNATURE", None), "c": ("REFERENCE", None)}
    got = select.greedy(spark.createDataFrame(rows, ddl), spark.createDataFrame([(0, 500)], "query_id int, budget int"), max_files=1)
    assert {r["id"]: r["reason"] for r in got.collect()} == {"a": None, "b": "files", "c": "files"}


def test_ignore_rules(spark):
    def ignored(path, lines, directory=False):
        return spark.range(1).select(ignore.ignored(F.lit(path), [r for r in map(ignore.compile_line, lines) if r], directory).alias("x")).first()["x"]

    assert ignored("a/b/node_modules", ["node_modules"]) and ignored("x/y.log", ["*.log"]) and not ignored("x/y.log", ["*.log", "!y.log"])
    assert ignored("doc/frotz", ["doc/frotz"]) and not ignored("a/doc/frotz", ["doc/frotz"])
    assert ignored("a/b/c/x.ts", ["**/c/**"]) and not ignored("abc", ["a?"]) and ignored("ab", ["a?"])
    assert not ignored("build", ["build/"]) and ignored("build", ["build/"], directory=True)
    assert ignore.compile_line("# c") is None and ignore.compile_line("  ") is None


def test_secrets(spark):
    blocked = lambda p: spark.range(1).select(secrets.path_blocked(F.lit(p)).alias("x")).first()["x"]
    assert all(map(blocked, (".env", "config/.env.production", "certs/server.pem", ".ssh/id_rsa")))
    assert not any(map(blocked, ("src/env.ts", "src/services/keyboard.ts")))
    reason = lambda t: spark.range(1).select(secrets.content_reason(F.lit(t)).alias("x")).first()["x"]
    assert reason("-----BEGIN RSA PRIVATE KEY-----\n" + "Ab1+" * 16) and reason('k = "AKIA' + "A" * 16 + '"') and reason("DB=postgres://user:pass@host:5432/db")
    assert not any(map(reason, ("if (line === '-----BEGIN PRIVATE KEY-----') skip();", "const password = req.body.password;", "interface Credentials { apiKey: string }")))


def test_percentile_and_rejects(spark):
    df = spark.createDataFrame([([3, 1, 2, 4],)], "v array<int>")
    assert df.select(evaluate.percentile(F.col("v"), 0.5).alias("x")).first()["x"] == 3
    assert df.select(evaluate.percentile(F.col("v"), 0.95).alias("x")).first()["x"] == 4
    rows = [("wip x y z", ["a.ts"]), ("fix", ["a.ts"]), ("two words", ["a.ts"]), ("some real message", []), ("some real message", ["a.md"]), ("some real message", ["a.ts"])]
    got = spark.createDataFrame(rows, "s string, f array<string>").select(evaluate.reject_reason(F.col("s"), F.col("f")).alias("r")).toPandas()["r"].tolist()
    assert got == ["subject", "subject", "short message", "no files", "no code", None]
