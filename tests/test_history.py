"""History as ranges, any revision's files, and the bench on states before commits."""

import subprocess

import pytest

from corvane.api import Project
from corvane.sources import history


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q", "-b", "main")
    (root / "src").mkdir()

    def commit(n, subject, files, gone=()):
        for name, text in files.items():
            (root / name).write_text(text)
        for name in gone:
            (root / name).unlink()
        git("add", "-A")
        subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", "commit", "-q", "-m", subject], check=True, env={"GIT_COMMITTER_DATE": f"{1_700_000_000 + n * 86400} +0000", "GIT_AUTHOR_DATE": f"{1_700_000_000 + n * 86400} +0000", "PATH": "/usr/bin:/bin"})

    commit(1, "first import of everything", {"src/rate.py": "def monthly_rate():\n    return 1\n", "src/tax.py": "def tax():\n    return 2\n", "é.md": "x"})
    commit(2, "wip", {"src/tax.py": "def tax():\n    return 3\n"})
    commit(3, "correct the monthly rate of sales", {"src/rate.py": "def monthly_rate():\n    return 5\ndef added_by_the_commit():\n    return 0\n"})
    commit(4, "remove the old tax module", {"src/new.py": "def other():\n    pass\n"}, ["src/tax.py"])
    return str(root)


def test_ranges_give_the_whole_history(spark, repo):
    every = {r["subject"]: r["files"] for r in history._read(spark, repo, table="commits", chunk="1").collect()}
    assert len(every) == 4 and every["first import of everything"] == ["src/rate.py", "src/tax.py", "é.md"]
    assert history._read(spark, repo, table="commits", chunk="1").rdd.getNumPartitions() == 4
    assert history.commits(spark, repo, 2).count() == 2
    assert {r["path"]: r["ts"] for r in history.touched(history.commits(spark, repo)).collect()}["src/rate.py"] == 1_700_000_000 + 3 * 86400


def test_no_repository(spark, tmp_path):
    assert history.commits(spark, str(tmp_path)).count() == 0 and history.changes(spark, str(tmp_path)).count() == 0


def test_files_as_of_a_commit(spark, repo):
    held = history.intervals(history.changes(spark, repo))
    rows = history.blobs(repo, history.as_of(held, {"0": 0, "1": 1, "2": 2, "3": 3, "4": 4})).collect()
    text = {(r["case_id"], r["path"]): bytes(r["content"]).decode() for r in rows}
    assert {c for c, _ in text} == {"1", "2", "3", "4"}
    assert text["1", "src/tax.py"].endswith("2\n") and text["2", "src/tax.py"].endswith("3\n") and ("4", "src/tax.py") not in text
    assert "added_by_the_commit" in text["4", "src/rate.py"] and "added_by_the_commit" not in text["2", "src/rate.py"] and text["4", "é.md"] == "x"


def test_bench_asks_the_state_before(spark, repo, tmp_path):
    p = Project(spark, repo, f"file://{tmp_path}/index")
    state = p.state_before({"a": 2, "b": 3})
    assert {r["path"] for r in state.filter("case_id = 'a'").collect()} == {"src/rate.py", "src/tax.py", "é.md"}
    got = p.bench(limit=5)
    assert got["cases"] == 3 and got["rejected"] == {"subject": 1}
    recall = {r["case_id"]: r["recall"] for r in got["worst"]}
    task = {r["subject"]: r["sha"] for r in history.commits(spark, repo).collect()}
    assert recall[task["correct the monthly rate of sales"]] == 1.0
    assert recall[task["first import of everything"]] == 0.0  # nothing stood before it
