from corvane.api import Project
from corvane.extract import python, script

REPO = """import { db } from './db';
/** Saves sales. */
export class SalesRepository extends Base {
  async findSalesBySeller(id: string): Promise<Sale[]> { return this.query(id); }
  query(id) { return db.run(`select ${id}`); }
}
export const LIMIT = 10;
"""
SERVICE = """import { SalesRepository } from './repo.js';
export function report(seller: string) { return new SalesRepository().findSalesBySeller(seller); }
"""


def names(found):
    return {(e["type"], e["qualified_name"]) for e in found.entities}


def test_script_extraction():
    got = script.extract("a.ts", "typescript", REPO + "interface I { a: string }\ntype T = string;\nlet counter = 0;\nconst { x, y: z } = require('lib');\nconst f = (a) => g(a);")
    assert {("CLASS", "SalesRepository"), ("METHOD", "SalesRepository.query"), ("CONSTANT", "LIMIT"), ("INTERFACE", "I"), ("TYPE", "T"), ("VARIABLE", "counter"), ("FUNCTION", "f")} <= names(got)
    assert ("IMPORTS", "lib") in {(r["type"], r["target_hint"]) for r in got.relations} and ("CALLS", "g") in {(r["type"], r["target_hint"]) for r in got.relations}
    assert not got.partial
    assert ("COMPONENT", "Card") in names(script.extract("a.tsx", "tsx", "export function Card(p) { return <div>{p.x}</div>; }"))
    broken = script.extract("b.ts", "typescript", "export function ok() { return 1; }\nfunction bad( {{{")
    assert broken.partial and ("FUNCTION", "ok") in names(broken)
    assert [e["type"] for e in script.extract("e.ts", "typescript", "").entities] == ["FILE"]


def test_python_extraction():
    got = python.extract("m.py", 'import os\nfrom a.b import c as d\nclass K(Base):\n    """Doc."""\n    @wrap\n    def run(self):\n        return self.go(d())\ndef _p():\n    pass\nMAX = 1\n')
    assert {("CLASS", "K"), ("METHOD", "K.run"), ("FUNCTION", "_p"), ("CONSTANT", "MAX")} <= names(got)
    exported = {e["qualified_name"]: e["exported"] for e in got.entities}
    assert exported["K.run"] and not exported["_p"]
    edges = {(r["type"], r["target_hint"]) for r in got.relations}
    assert {("IMPORTS", "os"), ("IMPORTS", "a.b"), ("EXTENDS", "Base"), ("CALLS", "go"), ("CALLS", "d")} <= edges
    broken = python.extract("b.py", "def ok():\n    pass\n\ndef bad(:\n")
    assert broken.partial and ("FUNCTION", "ok") in names(broken)


def test_ordinals():
    got = script.extract("a.js", "javascript", "function f() {}\nfunction f() {}")
    assert [e["id"] for e in got.entities] == ["a.js#FILE:a.js", "a.js#FUNCTION:f", "a.js#FUNCTION:f~1"]


def test_scan_incremental_and_questions(spark, tmp_path):
    root = tmp_path / "p"
    (root / "src").mkdir(parents=True)
    (root / "src/repo.ts").write_text(REPO)
    (root / "src/service.ts").write_text(SERVICE)
    (root / "src/other.py").write_text("def alone():\n    return 1\n")
    (root / "key.txt").write_text("AKIA" + "A" * 16)
    (root / "node_modules/x").mkdir(parents=True)
    (root / "node_modules/x/i.js").write_text("x()")
    p = Project(spark, str(root), f"file://{tmp_path}/index")
    assert p.scan() == {"added": 4, "modified": 0, "deleted": 0, "unchanged": 0}
    assert p.scan() == {"added": 0, "modified": 0, "deleted": 0, "unchanged": 4}
    assert p.file("key.txt").first()["parse_state"] == "SKIPPED_SECRET"
    call = p.relations(hints=None, path="src/service.ts").filter("target_hint = 'findSalesBySeller'").first()
    assert (call["resolution"], call["confidence"]) == ("EXACT", 1.0)
    report = p.impact("findSalesBySeller")
    assert report["report"]["direct"] == 1 and report["report"]["risk"] == "MEDIUM"
    found = p.context("fix findSalesBySeller")
    assert found["kind"] == "BUG_FIX" and any(i["file_path"] == "src/repo.ts" for i in found["items"]) and "findSalesBySeller" in found["package"]
    # The target's file goes: the edge into it is kept as unresolved; it comes back: exact again without a new parse.
    (root / "src/repo.ts").rename(tmp_path / "repo.ts")
    assert p.scan()["deleted"] == 1
    call = p.relations(path="src/service.ts").filter("target_hint = 'findSalesBySeller'").first()
    assert (call["resolution"], call["target_id"]) == ("UNRESOLVED", None)
    (tmp_path / "repo.ts").rename(root / "src/repo.ts")
    assert p.freshness().count() == 1
    assert p.scan() == {"added": 1, "modified": 0, "deleted": 0, "unchanged": 3}
    assert p.relations(path="src/service.ts").filter("target_hint = 'findSalesBySeller'").first()["resolution"] == "EXACT"
    assert p.status()["stats"]["files"] == 4


def test_sources_nested_too_deep_keep_what_stands_before():
    first = "def ok():\n    return 1\n\n"
    for rest in ("x = " + "+".join(["a"] * 20_000), "y = " + "(" * 5000 + ")" * 5000, "not " * 50_000 + "x", "f(" * 3000, "z = " + ".".join(["a"] * 50_000)):
        got = python.extract("m.py", first + rest + "\n")
        assert got.partial and ("FUNCTION", "ok") in names(got)
        script.extract("m.ts", "typescript", first + rest)
    for n in (900, 1500, 3000):
        got = python.extract("m.py", "def ok():\n    return " + "+".join(["a()"] * n) + "\n")
        assert not got.partial and len([r for r in got.relations if r["target_hint"] == "a"]) == n
    chain = "def ok():\n    pass\nif a:\n    f()\n" + "".join(f"elif a == {i}:\n    f()\n" for i in range(2500))
    assert ("FUNCTION", "ok") in names(python.extract("m.py", chain)) or python.extract("m.py", chain).partial
    deep = python.extract("m.py", first + "x" + ".y()" * 700 + "\n")
    assert ("FUNCTION", "ok") in names(deep)
