"""Scan of a source tree: a pruned walk, cheap tests on paths and sizes, and contents read for what is left alone."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.ids import content_hash, language
from corvane.functions.text import estimate, estimate_tokens, line_count
from corvane.functions.words import DEFAULT_EXCLUDES, DENY_PATHS, PARSED_LANGUAGES
from corvane.operators.changes import unread
from corvane.session import kept
from corvane.sources import ignore, secrets

MAX_BYTES, BINARY_SNIFF = 1 << 20, 8000
ALWAYS = (".git/", ".corvane/", "node_modules/")


#: Folders that one task opens below each of its starting folders before it hands the rest on.
QUOTA = 256
#: Rows that a walk hands over at once, files that a task reads, the bytes of them that it hands over at once, and paths that a task tests.
ROWS, FILES, HELD, PATHS = 16_384, 512, 4 << 20, 50_000
LISTED = "path string, kind string, mtime_ms double, size_bytes long"


def local_path(root: str) -> str | None:
    """The path of a root on a file system that is mounted on every machine; None where it is another store."""
    return unquote(urlparse(root).path) if root.startswith("file:") else None if "://" in root else root


def _entries(root: str, folder: str) -> Iterator[tuple[str, bool, float, int]]:
    """(name, is a folder, mtime_ms, size) of what a folder holds; links are left out, so a walk can't go round."""
    base = local_path(root)
    if base is not None:
        with os.scandir(os.path.join(base, folder)) as found:
            for e in found:
                if e.is_dir(follow_symlinks=False):
                    yield e.name, True, 0.0, 0
                elif e.is_file(follow_symlinks=False):
                    stat = e.stat(follow_symlinks=False)
                    yield e.name, False, stat.st_mtime_ns / 1e6, stat.st_size
        return
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(root)
    for info in system.get_file_info(fs.FileSelector(f"{at.rstrip('/')}/{folder}".rstrip("/"))):
        yield info.base_name, info.type == fs.FileType.Directory, (info.mtime_ns or 0) / 1e6, info.size or 0


def _pruned(ignores: list[ignore.Rule]) -> Callable[[str, str], bool]:
    """Whether a folder (path, name) isn't opened: one that is never read, or an ignored one if no rule brings anything back."""
    always = {x.rstrip("/") for x in ALWAYS}
    last_first = [] if any(r.negated for r in ignores) else [re.compile(r.regex) for r in reversed(ignores)]
    return lambda path, name: name in always or any(r.search(path) for r in last_first)


def _walker(root: str, ignores: list[ignore.Rule], quota: int) -> Callable:
    types = (pa.string(), pa.string(), pa.float64(), pa.int64())

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["path", "kind", "mtime_ms", "size_bytes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pruned = _pruned(ignores)
        for start in (p for batch in batches for p in batch.column("path").to_pylist()):
            rows, todo, files, folders = [], [start], 0, 0
            while todo and files < quota * 64 and folders < quota:
                folder = todo.pop()
                try:
                    for name, is_folder, mtime, size in _entries(root, folder):
                        path = f"{folder}/{name}" if folder else name
                        if not is_folder:
                            rows.append((path, "file", mtime, size))
                            files += 1
                        elif not pruned(path, name):
                            todo.append(path)
                        if len(rows) >= ROWS:
                            yield made(rows)
                            rows = []
                    rows.append((folder, "folder", 0.0, 0))
                    folders += 1
                except OSError:
                    rows.append((folder, "unreadable", 0.0, 0))
            rows += [(folder, "open", 0.0, 0) for folder in todo]
            if rows:
                yield made(rows)

    return run


def walk(spark: SparkSession, root: str, ignores: list[ignore.Rule], quota: int = QUOTA) -> DataFrame:
    """(path, kind, mtime_ms, size_bytes): the files below the root, and the folders that were opened or couldn't be (unreadable).

    Folders are rows. Tasks open them, a bounded number below each, and what they leave is dealt out again in the next
    round; a folder that the rules prune is never opened.
    """
    frontier, parts = spark.createDataFrame([("",)], "path string"), []
    many = 1
    while many:
        tasks = min(many, max(spark.sparkContext.defaultParallelism, many // quota))
        parts.append(kept(frontier.repartition(tasks).mapInArrow(_walker(root, ignores, quota), LISTED)))
        frontier = parts[-1].filter("kind = 'open'").select("path")
        many = frontier.count()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("kind <> 'open'")


def opened(spark: SparkSession, root: str, files: DataFrame, measured: str | None = None) -> DataFrame:
    """`files` (path and other columns) with the bytes of each as `content`; only these files are opened, each by one task.

    A file that is gone by now gives no row. With `measured`, the name of a boolean column, files where it holds also get their
    `estimate` of tokens, null where they are no UTF-8.
    """
    base, names = local_path(root), files.columns

    def read(path: str) -> bytes | None:
        try:
            if base is not None:
                with open(os.path.join(base, path), "rb") as f:
                    return f.read()
            from pyarrow import fs

            system, at = fs.FileSystem.from_uri(root)
            with system.open_input_stream(f"{at.rstrip('/')}/{path}") as f:
                return f.read()
        except OSError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, held, size = [], [], 0
            for i, path in enumerate(batch.column("path").to_pylist()):
                content = read(path)
                if content is None:
                    continue
                found.append(i)
                held.append(content)
                size += len(content)
                if size >= HELD:
                    yield made(batch, found, held)
                    found, held, size = [], [], 0
            if found:
                yield made(batch, found, held)

    def made(batch: pa.RecordBatch, found: list[int], held: list[bytes]) -> pa.RecordBatch:
        own = batch.take(pa.array(found))
        more = {"content": pa.array(held, pa.binary())}
        if measured:
            more["estimate"] = pa.array([tokens(h) if m else None for h, m in zip(held, own.column(measured).to_pylist(), strict=True)], pa.int32())
        return pa.RecordBatch.from_arrays([*own.columns, *more.values()], names=[*names, *more])

    ddl = ", ".join(f"`{n}` {t}" for n, t in files.dtypes) + ", content binary" + (", estimate int" if measured else "")
    return files.repartition(tasks(files, FILES)).mapInArrow(run, ddl)


def tokens(content: bytes) -> int | None:
    try:
        return estimate(content.decode("utf-8"))
    except UnicodeDecodeError:
        return None


def tasks(rows: DataFrame, each: int) -> int:
    """Tasks for `rows`, `each` to a task: such work is by the row, while Spark's own sizes go by the bytes, of which paths have few."""
    many = rows.count()
    return max(min(many, rows.sparkSession.sparkContext.defaultParallelism), -(-many // each), 1)


def contents(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """(path, content) of the given files (path) under the root, as text; no other file is opened."""
    return opened(spark, root, files.select("path").distinct()).select("path", F.decode("content", "UTF-8").alias("content"))


def rules(spark: SparkSession, root: str, excludes: tuple[str, ...] = DEFAULT_EXCLUDES) -> list[ignore.Rule]:
    """Configured excludes, then the root's own ignore file, which may override them."""
    own = opened(spark, root, spark.createDataFrame([(".gitignore",)], "path string")).select(F.col("content").cast("string")).collect()
    return [r for r in map(ignore.compile_line, (*ALWAYS, *excludes)) if r] + [r for x in own for r in ignore.compile_lines(x[0])]


def path_state(path: Column, size: Column, ignores: list[ignore.Rule], deny: tuple[str, ...] = DENY_PATHS, max_bytes: int = MAX_BYTES) -> Column:
    """Why a file is skipped before it is read; null if it is read."""
    return F.when(ignore.ignored_file(path, ignores), "SKIPPED_IGNORED").when(secrets.path_blocked(path, deny), "SKIPPED_SECRET").when(size > max_bytes, "SKIPPED_TOO_LARGE")


def content_state(content: Column) -> Column:
    """The state of a file that was read (bytes)."""
    return F.when(F.position(F.lit(b"\x00"), F.substring(content, 1, BINARY_SNIFF)) > 0, "SKIPPED_BINARY").when(secrets.content_reason(content.cast("string")).isNotNull(), "SKIPPED_SECRET")


def file_rows(read: DataFrame, *keys: str) -> DataFrame:
    """Index rows of files (path, mtime_ms, size_bytes, content bytes or null, state or null), with the columns `keys` as they are.

    A column `estimate`, if there is one, has the tokens of those files for which it isn't null.
    """
    text = F.decode("content", "UTF-8")
    lang, state, text_ = F.col("language"), F.col("_state"), F.col("_text")
    skipped = state.isNotNull()
    spent = F.coalesce("estimate", estimate_tokens(text_)) if "estimate" in read.columns else estimate_tokens(text_)
    out = read.withColumns({"_state": F.coalesce("state", content_state(F.col("content"))), "language": language(F.col("path")), "_text": text})
    return out.select(
        *keys, "path", "language", "size_bytes", F.coalesce(F.when(~skipped, line_count(text_)), F.lit(0)).cast("int").alias("line_count"),
        F.when(skipped, F.concat(F.lit("skipped:"), state, F.lit(":"), F.col("size_bytes").cast("string"))).otherwise(content_hash(text_)).alias("content_hash"),
        F.coalesce("_state", F.when(lang.isin(*PARSED_LANGUAGES), "OK").otherwise("UNSUPPORTED_LANGUAGE")).alias("parse_state"), F.lit(None).cast("string").alias("parse_error"),
        F.unix_millis(F.current_timestamp()).alias("indexed_at"), "mtime_ms", F.coalesce(F.when(~skipped, spent), F.lit(0)).alias("token_estimate"), F.when(~skipped, text_).alias("content"),
    )


def scan(
    spark: SparkSession, root: str, known: DataFrame | None = None, ignores: list[ignore.Rule] | None = None, deny: tuple[str, ...] = DENY_PATHS, max_bytes: int = MAX_BYTES, later: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """(rows, unchanged): index rows with contents of new or touched files, and paths that time and size prove unchanged.

    Ignored files give no row, and folders that hold nothing else are not opened. `known` has path, mtime_ms and size_bytes. A
    file is opened only if it has a row and no state of its path. Files in the languages `later`, which the caller measures, get 0 for their token_estimate.
    """
    ignores = ignores if ignores is not None else rules(spark, root)
    files = walk(spark, root, ignores).filter("kind = 'file'").select("path", "mtime_ms", "size_bytes")
    files = files.repartition(tasks(files, PATHS))  # a folder is listed by one task, but its paths are tested by many
    # Written before it is filtered: Spark would move the filter, and the tests with it, to before the paths are dealt out.
    found = kept(files.withColumn("state", path_state(F.col("path"), F.col("size_bytes"), ignores, deny, max_bytes))).filter("state is null or state <> 'SKIPPED_IGNORED'")
    fresh = kept(unread(found, known)) if known is not None else found
    same = found.join(known.select("path", "mtime_ms", "size_bytes"), ["path", "mtime_ms", "size_bytes"], "left_semi").select("path") if known is not None else found.select("path").limit(0)
    read = fresh.filter("state is null").withColumn("now", ~language(F.col("path")).isin(*later))
    wanted = opened(spark, root, read, "now").withColumn("estimate", F.when(F.col("now"), F.col("estimate")).otherwise(0))
    rest = fresh.filter("state is not null").withColumns({"content": F.lit(None).cast("binary"), "estimate": F.lit(0)})
    names = ["path", "mtime_ms", "size_bytes", "content", "state", "estimate"]
    return file_rows(wanted.select(*names).unionByName(rest.select(*names))), same


def include_list(spark: SparkSession, path: str) -> DataFrame:
    """(path): the lines of a list file but blank ones and comments."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("path")).filter((F.col("path") != "") & ~F.col("path").startswith("#"))
