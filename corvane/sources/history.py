"""Commit history as a partitioned source, and any revision's files as an as-of look-up over intervals of blobs.

`spark.read.format("corvane_history")` splits the history of one commit into ranges of `chunk` commits, each read by a task
with one subprocess. The commit is fixed when the read is planned, so a task that runs again gives the same rows. The repository must be
mounted where the tasks run. Without a repository there are no rows.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

DEPTH, CHUNK = 400, 200
COMMITS = "sha string, ts long, subject string, files array<string>"
CHANGES = "n long, sha string, ts long, path string, blob string"
_NONE = "0" * 40


def _git(root: str, *args: str) -> str | None:
    """What git prints; None where it fails, as without a repository."""
    try:
        done = subprocess.run(["git", "-c", "core.quotepath=off", "-C", root, *args], capture_output=True, check=False)
    except OSError:
        return None
    return done.stdout.decode("utf-8", "replace") if done.returncode == 0 else None


class Range(InputPartition):
    def __init__(self, head: str, skip: int, count: int, total: int) -> None:
        self.head, self.skip, self.count, self.total = head, skip, count, total


class History(DataSource):
    """Options: path, table (commits, or changes of the first-parent chain), head, depth (0: all), chunk."""

    @classmethod
    def name(cls) -> str:
        return "corvane_history"

    def schema(self) -> str:
        return CHANGES if self.options.get("table") == "changes" else COMMITS

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return HistoryReader(dict(self.options))


class HistoryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.changes = options["path"], options.get("table") == "changes"
        self.head, self.depth, self.chunk = options.get("head", "HEAD"), int(options.get("depth", "0")), int(options.get("chunk", str(CHUNK)))

    def _which(self) -> list[str]:
        return ["--first-parent"] if self.changes else ["--no-merges"]

    def partitions(self) -> list[Range]:
        head = _git(self.root, "rev-parse", "--verify", "-q", self.head)
        counted = head and _git(self.root, "rev-list", "--count", *self._which(), head.strip())
        if not counted:
            return [Range("", 0, 0, 0)]
        every = int(counted)
        use = min(every, self.depth) if self.depth else every
        return [Range(head.strip(), at, min(self.chunk, use - at), every) for at in range(0, use, self.chunk)] or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.count:
            return
        more = ["-m", "--raw", "--no-abbrev", "--no-renames"] if self.changes else ["--name-only"]
        out = _git(self.root, "log", partition.head, f"--skip={partition.skip}", f"--max-count={partition.count}", *self._which(), *more, "--format=%x1e%H%x1f%ct%x1f%s") or ""
        for i, record in enumerate(out.split("\x1e")[1:]):
            head, _, body = record.partition("\n")
            sha, ts, subject = head.split("\x1f", 2)
            lines = [x for x in body.split("\n") if x]
            if not self.changes:
                yield sha, int(ts), subject, lines
                continue
            for line in lines:
                facts, _, path = line.partition("\t")
                blob = facts.split(" ")[3]
                yield partition.total - partition.skip - i, sha, int(ts), path, None if blob == _NONE else blob


def _read(spark: SparkSession, root: str, **options: str) -> DataFrame:
    spark.dataSource.register(History)
    return spark.read.format(History.name()).options(path=root, **options).load()


def commits(spark: SparkSession, root: str, depth: int = DEPTH) -> DataFrame:
    """(sha, ts, subject, files) of the latest `depth` commits that are no merges (0: of all); empty where there is no history."""
    return _read(spark, root, table="commits", depth=str(depth))


def touched(history: DataFrame) -> DataFrame:
    """(path, ts): each path's latest commit."""
    return history.select(F.explode("files").alias("path"), "ts").groupBy("path").agg(F.max("ts").alias("ts"))


def changes(spark: SparkSession, root: str) -> DataFrame:
    """(n, sha, ts, path, blob): what each commit of the first-parent chain made of a path, null where it deleted it; n counts from the oldest, 1."""
    return _read(spark, root, table="changes")


def intervals(changed: DataFrame) -> DataFrame:
    """(path, blob, start, end): a path holds a blob from commit `start` on and before `end` (null: still)."""
    until = F.lead("n").over(Window.partitionBy("path").orderBy("n"))
    return changed.withColumn("end", until).filter("blob is not null").select("path", "blob", F.col("n").alias("start"), "end")


def as_of(held: DataFrame, points: dict[str, int]) -> DataFrame:
    """(case_id, path, blob): the files at each of the points (name to commit number), a bounded list that the caller gives.

    Each interval finds the points inside it by itself, so nothing is shuffled or crossed.
    """
    if not points:
        return held.select(F.lit("").alias("case_id"), "path", "blob").limit(0)
    at = F.array(*(F.struct(F.lit(c).alias("case_id"), F.lit(n).cast("long").alias("n")) for c, n in sorted(points.items())))
    inside = F.filter(at, lambda p: (p["n"] >= F.col("start")) & (F.col("end").isNull() | (p["n"] < F.col("end"))))
    return held.select(F.explode(inside).alias("_"), "path", "blob").select("_.case_id", "path", "blob")


def blobs(root: str, wanted: DataFrame) -> DataFrame:
    """`wanted` (blob and other columns) with each blob's bytes as `content`; a task reads all of its blobs with one subprocess."""
    names = wanted.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with subprocess.Popen(["git", "-C", root, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as git:
            for batch in batches:
                for i, blob in enumerate(batch.column("blob").to_pylist()):
                    git.stdin.write(f"{blob}\n".encode())
                    git.stdin.flush()
                    head = git.stdout.readline().split()
                    if head[1:2] != [b"blob"]:  # a submodule, or an object that isn't there
                        if len(head) == 3:
                            git.stdout.read(int(head[2]) + 1)
                        continue
                    content = git.stdout.read(int(head[2]))
                    git.stdout.read(1)
                    yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.array([content], pa.binary())], names=[*names, "content"])
            git.stdin.close()

    return wanted.hint("rebalance").mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in wanted.dtypes) + ", content binary")
