"""Stored postings, several writers, the pruned walk, and the operators that run in rounds, against plain versions."""

import json
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from corvane import schemas
from corvane.api import Project
from corvane.operators import graph, postings, rank, resolve, search, select
from corvane.operators.store import TABLES, Conflict, Store
from corvane.sources import ignore, scan

# --- postings ---


def ask(spark, *terms):
    return spark.createDataFrame([(0, t, len(t) == 6) for t in terms], "query_id int, term string, is_prefix boolean")


def docs_of(spark, rows):
    return spark.createDataFrame([(str(i), f"f{i}", "", t) for i, t in rows], "id string, file_path string, terms string, literals string")


def scores(found):
    return sorted((r["id"], round(r["score"], 9)) for r in found.collect())


def test_segments_and_tombstones_are_a_rebuild(spark, tmp_path):
    draw = random.Random(1)
    vocabulary = ["common", *(f"{p}{s}" for p in ("sellin", "buying", "q") for s in ("", "g", "gly", "x"))]
    now = {i: " ".join(draw.choice(vocabulary) for _ in range(12)) for i in range(40)}
    index = postings.Postings(spark, f"file://{tmp_path}/p")
    index.added(docs_of(spark, now.items()), spark.createDataFrame([], "file_path string"))
    for step in range(9):  # more than MERGE_AT
        new = {i: " ".join(draw.choice(vocabulary) for _ in range(9)) for i in draw.sample(range(60), 6)}
        gone = draw.sample(sorted(now), 3)
        index.added(docs_of(spark, new.items()), spark.createDataFrame([(f"f{i}",) for i in [*new, *gone]], "file_path string"))
        now = {i: t for i, t in now.items() if i not in gone} | new
        if step in (0, 8):
            asked = ask(spark, "common", "q", "sellin", "buying", "none")
            found, lengths = search.postings(docs_of(spark, now.items()))
            assert scores(index.scores(asked)) == scores(search.bm25(found, lengths, asked))
            assert index.state["documents"] == len(now)
    assert len(index.state["segments"]) < postings.MERGE_AT and not index.scores(ask(spark, "none")).count()


def test_a_question_opens_its_buckets_alone(spark, tmp_path):
    index = postings.Postings(spark, f"file://{tmp_path}/p")
    index.added(docs_of(spark, [(i, " ".join(f"word{k}" for k in range(300))) for i in range(5)]), spark.createDataFrame([], "file_path string"))
    state = index.state
    used = spark.createDataFrame([("word7",)], "t string").select(postings.bucket(F.col("t"))).first()[0]
    for name in os.listdir(tmp_path / "p" / state["segments"][0] / "postings"):
        if name.startswith("bucket=") and name != f"bucket={used}":
            for f in os.listdir(tmp_path / "p" / state["segments"][0] / "postings" / name):
                (tmp_path / "p" / state["segments"][0] / "postings" / name / f).write_bytes(b"spoilt")
    assert len(scores(postings.Postings(spark, f"file://{tmp_path}/p", state).scores(ask(spark, "word7")))) == 5


# --- store ---


def rows(spark, *paths):
    return {t: spark.createDataFrame([(p, *[None] * 9) for p in paths] if t == "files" else [], ddl) for t, ddl in TABLES.items()}


def test_the_second_of_two_writers_is_told(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/i")
    store.commit(rows(spark, "a"))
    base = store.current()
    store.commit(rows(spark, "a", "b"), base)
    with pytest.raises(Conflict):
        store.commit(rows(spark, "a", "c"), base)
    assert {r["path"] for r in store.read("files").collect()} == {"a", "b"} and store.manifest()["number"] == 2


def test_writers_at_once_lose_nothing(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/i")
    failed = []

    def add(path):
        def change(base):
            tables = {t: store.read(t, base) if base else spark.createDataFrame([], ddl) for t, ddl in TABLES.items()}
            return tables | {"files": tables["files"].unionByName(rows(spark, path)["files"])}, None

        try:
            store.transact(change)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=add, args=(f"p{i}",)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and {r["path"] for r in store.read("files").collect()} == {f"p{i}" for i in range(4)}
    assert len(store.versions()) == 4 and store.as_of(store.versions()[0], "files").count() == 1
    store.set_meta({"k": "v"})
    assert store.meta() == {"k": "v"} and store.read("files").count() == 4


def test_another_schema_version(spark, tmp_path, monkeypatch):
    Store(spark, f"file://{tmp_path}/i").commit(rows(spark, "a"))
    monkeypatch.setattr(schemas, "SCHEMA_VERSION", 99)
    with pytest.raises(ValueError, match="schema version"):
        Store(spark, f"file://{tmp_path}/i").read("files")
    again = Store(spark, f"file://{tmp_path}/i", "recreate")
    assert again.read("files").count() == 0
    again.transact(lambda base: (rows(spark, "z"), None))
    assert [r["path"] for r in Store(spark, f"file://{tmp_path}/i").read("files").collect()] == ["z"]


# --- scan ---


def test_pruned_folders_are_not_listed(spark, tmp_path):
    for i in range(100):
        at = tmp_path / "t" / "skipped" / f"d{i}"
        at.mkdir(parents=True)
        for k in range(100):
            (at / f"{k}.ts").touch()
    (tmp_path / "t" / "a" / "node_modules").mkdir(parents=True)
    (tmp_path / "t" / "a" / "node_modules" / "m.js").touch()
    (tmp_path / "t" / "a" / "b").mkdir()
    for name in ("x.ts", "a/y.ts", "a/b/z.ts"):
        (tmp_path / "t" / name).write_text("let a = 1")
    os.symlink(tmp_path / "t", tmp_path / "t" / "a" / "round")
    got = scan.walk(spark, str(tmp_path / "t"), ignore.compile_lines("skipped/\n")).collect()
    assert sorted((r["path"], r["kind"]) for r in got) == [("", "folder"), ("a", "folder"), ("a/b", "folder"), ("a/b/z.ts", "file"), ("a/y.ts", "file"), ("x.ts", "file")]
    every = scan.walk(spark, str(tmp_path / "t"), ignore.compile_lines("skipped/\n!skipped/d1/5.ts\n"), quota=7)
    assert every.filter("kind = 'file'").count() == 10_003 and every.filter("kind = 'folder'").count() == 104


def test_only_changed_files_are_opened(spark, tmp_path):
    root = tmp_path / "t"
    root.mkdir()
    for i in range(60):
        (root / f"{i}.ts").write_text(f"export const v{i} = {i};")
    (root / "big.ts").write_text("x" * 5000)
    known = scan.scan(spark, str(root), ignores=[], max_bytes=4000)[0].cache()
    assert known.count() == 61 and known.filter("parse_state = 'SKIPPED_TOO_LARGE'").count() == 1
    for i in range(60):  # other contents of the same size and time: who opened them would see it
        stat = os.stat(root / f"{i}.ts")
        (root / f"{i}.ts").write_text("?" * stat.st_size)
        if i != 7:
            os.utime(root / f"{i}.ts", ns=(stat.st_atime_ns, stat.st_mtime_ns))
    os.utime(root / "7.ts", ns=(1, 1_600_000_000_000_000_000))
    fresh, same = scan.scan(spark, str(root), known, [], max_bytes=4000)
    assert [r["path"] for r in fresh.select("path").collect()] == ["7.ts"] and same.count() == 60
    assert scan.opened(spark, str(root), spark.createDataFrame([("3.ts",), ("gone.ts",)], "path string")).count() == 1


# --- resolution ---


def test_a_name_that_everything_has_adds_no_row_per_candidate(spark):
    many = 4000
    entities = spark.range(many).select(F.concat(F.lit("e"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("id"), F.lit("save").alias("name"), F.concat(F.lit("C"), F.col("id").cast("string"), F.lit(".save")).alias("qualified_name"), F.concat(F.lit("f"), (F.col("id") % 50).cast("string")).alias("file_path"), (F.col("id") % 3 == 2).alias("exported"))
    edges = spark.range(3000).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("source_id"), F.lit("save").alias("target_hint"), F.lit("CALLS").alias("type"), F.concat(F.lit("f"), (F.col("id") % 60).cast("string")).alias("file_path"), F.lit(1).alias("line"), F.when(F.col("id") % 2 == 0, F.lit('{"expression": "x.save"}')).alias("metadata"))
    none = spark.createDataFrame([], "file_path string, local_name string, bound_path string")
    got = resolve.resolve_symbols(edges, entities, none)
    rows = got.collect()
    assert len(rows) == 3000 and {r["new_confidence"] for r in rows} == {1 / many}
    local = {r["source_id"]: r["new_target"] for r in rows}
    assert local["s0"] == "e00050" and local["s51"] == "e00002"  # a member call: the first exported one of its file; else the first exported of all
    counts = resolve.summaries(entities).groupBy((F.col("in_file") == resolve.ANY).alias("a"), (F.col("as_name") == resolve.ANY).alias("b")).count()
    assert counts.filter("a and b").first()["count"] == many + 1


def test_rules_in_order(spark):
    e = [("k1", "run", "K.run", "a.ts", True), ("k2", "run", "L.run", "b.ts", False), ("k3", "run", "M.run", "c.ts", True), ("me", "go", "L.go", "b.ts", True), ("one", "only", "only", "z.ts", False)]
    entities = spark.createDataFrame(e, "id string, name string, qualified_name string, file_path string, exported boolean")
    expression = lambda x: json.dumps({"expression": x})
    edges = [("me", "run", "b.ts", 1, expression("this.run")), ("x", "run", "q.ts", 2, expression("new M().run")), ("x", "run", "q.ts", 3, expression("k.run")), ("x", "run", "q.ts", 4, None), ("x", "run", "b.ts", 5, None), ("x", "only", "q.ts", 6, None), ("x", "only", "q.ts", 7, expression("y.only")), ("x", "run", "r.ts", 8, None), ("x", "nothing", "r.ts", 9, None)]
    edges = spark.createDataFrame([(s, None, h, "CALLS", f, n, m) for s, h, f, n, m in edges], "source_id string, target_id string, target_hint string, type string, file_path string, line int, metadata string")
    bound = spark.createDataFrame([("q.ts", "k", "a.ts"), ("r.ts", "run", "c.ts")], "file_path string, local_name string, bound_path string")
    got = {r["line"]: (r["new_target"], r["new_resolution"], round(r["new_confidence"], 3)) for r in resolve.resolve_symbols(edges, entities, bound).collect()}
    assert got == {1: ("k2", "EXACT", 1.0), 2: ("k3", "EXACT", 1.0), 3: ("k1", "SCOPED", 0.75), 4: ("k1", "AMBIGUOUS", 0.333), 5: ("k2", "SCOPED", 0.75), 6: ("one", "SCOPED", 0.75), 7: ("one", "AMBIGUOUS", 0.5), 8: ("k3", "EXACT", 1.0)}


# --- selection ---


def one_by_one(candidates, budget, max_files):
    left, files, out = budget, set(), []
    for c in sorted(candidates, key=lambda c: (-c["score"], -c["score"] / max(1, c["token_estimate"]), c["id"])):
        detail, tokens, reason = None, 0, "budget"
        if c["file_path"] not in files and len(files) >= max_files:
            reason = "files"
        elif left > select.REFERENCE_COST:
            for level in select.LEVELS[0 if c["score"] >= 55 or c["hop_distance"] == 0 else 1 :]:
                cost = c[f"n_{level.lower()}"]
                if cost is not None and cost <= left:
                    detail, tokens, reason = level, cost, None
                    break
        if detail:
            left -= tokens
            files.add(c["file_path"])
        out.append((c["query_id"], c["id"], detail, tokens, reason))
    return out


def test_greedy_in_rounds_is_one_by_one(spark):
    draw = random.Random(2)
    rows = []
    for q in range(12):
        for i in range(draw.choice([0, 1, 30, 120])):
            rows.append({"query_id": q, "id": f"e{i:03d}", "file_path": f"f{draw.randrange(draw.choice([3, 12, 60]))}", "score": float(draw.randrange(20, 80)), "token_estimate": draw.randrange(0, 300), "hop_distance": draw.randrange(3), "n_full": draw.choice([None, draw.randrange(1, 900)]), "n_signature": draw.randrange(1, 90), "n_reference": draw.choice([None, draw.randrange(1, 20)])})
    frame = spark.createDataFrame(rows, "query_id int, id string, file_path string, score double, token_estimate int, hop_distance int, n_full int, n_signature int, n_reference int")
    budgets = {q: draw.choice([10, 40, 700, 3000, 20_000]) for q in range(12)}
    got = select.greedy(frame, spark.createDataFrame(list(budgets.items()), "query_id int, budget int"), 6)
    want = [x for q, b in budgets.items() for x in one_by_one([r for r in rows if r["query_id"] == q], b, 6)]
    assert sorted(tuple(r[c] for c in ("query_id", "id", "detail", "tokens", "reason")) for r in got.collect()) == sorted(want)
    assert {x[4] for x in want} == {None, "budget", "files"}
    assert select.greedy(frame.limit(0), spark.createDataFrame([], "query_id int, budget int")).isEmpty()


# --- traversal ---


def test_hubs_and_better_late_walks(spark, monkeypatch):
    monkeypatch.setattr(graph, "LIST", 16)
    edges = [("hub", f"n{i}", 0.5 + i / 1000) for i in range(300)] + [(f"n{i}", "end", 0.9) for i in range(300)] + [("s", "hub", 0.9), ("s", "end", 0.1), ("end", "last", 1.0), ("last", "s", 1.0)]
    frame = spark.createDataFrame([(a, b, "CALLS", c) for a, b, c in edges], "source_id string, target_id string, type string, confidence double")
    got = {r["entity_id"]: (r["hop_distance"], round(r["path_confidence"], 6)) for r in graph.neighbors(frame, spark.createDataFrame([("s",)], "id string"), 6).collect()}
    assert got["end"] == (1, round(0.9 * 0.799 * 0.9, 6)) and got["last"] == (2, round(0.9 * 0.799 * 0.9, 6)) and got["s"] == (0, 1.0) and len(got) == 304


# --- lexicon and the rest of the project ---


def test_a_task_finds_a_file_through_its_group(spark, tmp_path):
    root = tmp_path / "p"
    (root / "src").mkdir(parents=True)
    (root / "src/invoice.ts").write_text("export function invoiceTotal(rows) { return rows.length; }\n")
    (root / "src/weather.ts").write_text("export function rainfall() { return 1; }\n")
    p = Project(spark, str(root), f"file://{tmp_path}/index")
    p.scan()
    task = "improve the faturamento"
    assert not [i for i in p.context(task)["items"] if i["file_path"] == "src/invoice.ts"]
    p.config["context"]["dictionary"] = [["faturamento", "invoice"]]
    found = p.context(task)
    assert {i["file_path"] for i in found["items"]} == {"src/invoice.ts"}
    first = found["items"][0]["id"]
    assert {"path term", "text"} & set(found["reasons"][first])


def test_groups_that_share_a_word_stay_apart(spark):
    groups = spark.createDataFrame([(["A", "b"],), (["b", "c", "c"],), (["alone"],)], "words array<string>")
    assert sorted(tuple(r) for r in search.lexicon(groups).collect()) == [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")]
    tasks = spark.createDataFrame([(1, "see abacus"), (2, "zzz")], "query_id int, task string")
    lex = search.lexicon(spark.createDataFrame([(["abacus", "Calculator"],)], "words array<string>"))
    got = {r["query_id"]: r for r in rank.analysed(tasks, lex).collect()}
    assert got[1]["terms"] == ["see", "abacus", "calculator"] and got[2]["terms"] == ["zzz"]
    assert {(c["term"], c["is_prefix"]) for c in got[1]["clauses"]} >= {("calculator", False), ("calcul", True), ("abacus", False)}
