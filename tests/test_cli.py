"""The command line: flags, exit codes and what is printed."""

import json

import pytest

from corvane import __main__ as cli
from corvane import render


@pytest.fixture
def root(tmp_path):
    (tmp_path / "a.ts").write_text("/** Sums rows. */\nexport function rowTotal(rows) { return helper(rows); }\nexport function helper(x) { return x; }\n")
    (tmp_path / "b.tsx").write_text("import { rowTotal } from './a.js';\nexport function Table(p) { return <b>{rowTotal(p.rows)}</b>; }\n")
    return str(tmp_path)


def test_commands(spark, root, capsys, monkeypatch):
    monkeypatch.setattr(spark, "stop", lambda: None)

    def run(*argv):
        code = cli.main(["--root", root, *argv])
        return code, capsys.readouterr()

    assert run("init")[0] == 0
    code, said = run("init")
    assert code == 1 and "is there already" in said.err
    assert run("init", "--force")[0] == 0
    code, said = run("scan")
    assert code == 0 and json.loads(said.out)["added"] == 2 and "scanning" in said.err
    code, said = run("--quiet", "scan")
    assert json.loads(said.out)["unchanged"] == 2 and "scanning" not in said.err
    code, said = run("status")
    status = json.loads(said.out)
    assert status["stale"] == 0 and status["skipped"] == {} and status["top_languages"] == {"typescript": 1, "tsx": 1}
    code, said = run("context", "fix rowTotal", "--raw")
    assert said.out.startswith("# TASK\nfix rowTotal") and "// Sums rows." in said.out
    code, said = run("context", "fix rowTotal", "--explain")
    assert said.out.startswith("BUG_FIX: ") and "symbol rowTotal" in said.out and "# TASK" in said.out
    code, said = run("--json", "context", "fix rowTotal")
    assert json.loads(said.out)["kind"] == "BUG_FIX"
    code, said = run("impact", "rowTotal")
    assert said.out.startswith("target a.ts#FUNCTION:rowTotal") and "1 direct, 0 indirect" in said.out and "What the target needs\n  helper" in said.out
    code, said = run("--json", "impact", "rowTotal")
    report = json.loads(said.out)
    assert report["report"]["direct"] == 1 and report["alternatives"] == [] and report["report"]["critical_dependencies"] == ["helper"]
    assert run("impact", "nothing")[0] == 1 and run("context", "x", "--budget", "10")[0] == 1
    code, said = run("graph", "--any", "thing")
    assert code == 3 and "planned" in said.err
    for bad in (["nonsense"], ["context", "x", "--budget", "nan"], ["scan", "--wrong"]):
        with pytest.raises(SystemExit) as stop:
            cli.main(["--root", root, *bad])
        assert stop.value.code == 2


def test_long_lists_say_that_they_are_cut():
    row = {"qualified_name": "q", "file_path": "f", "hop_distance": 1, "path_confidence": 0.5}
    report = {"id": "x", "direct": 30, "indirect": 0, "files": 3, "tests": 0, "risk": "HIGH", "risk_reason": "many", "critical_dependencies": [], "low_confidence_edges": 2}
    text = render.impact({"report": report, "alternatives": list("abcdefg"), "reached": [row | {"reach": "direct"}] * 30})
    assert "and 2 more" in text and "and 10 more" in text and "Indirect" not in text and "2 incoming edges are guesses" in text
    text = render.bench({"cases": 2, "mean_recall": 0.5, "mean_precision": 0.25, "misses": 1, "median": 3.2, "p95": 9.0, "rejected": {"subject": 1, "no code": 4}, "worst": [{"case_id": "abc", "recall": 0.0, "hits": 0, "n_expected": 2, "n_selected": 1}]})
    assert "recall 50 %, precision 25 %" in text and text.index("4 no code") < text.index("1 subject") and "0 of 2 files in 1 selected" in text
    assert render.bench({"cases": 0, "mean_recall": None, "mean_precision": None, "misses": 0, "median": None, "p95": None, "rejected": {}, "worst": []}) == "0 cases\nrecall -, precision -, 0 without a hit"
