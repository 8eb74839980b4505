"""Extractors by language, and their application to a table of sources."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.extract import python, script
from corvane.extract.rows import ENTITY_FIELDS, Extraction
from corvane.schemas import ENTITIES, RELATIONS

EXTRACTORS: dict[str, Callable[[str, str], Extraction]] = {
    "python": python.extract,
    "typescript": lambda p, s: script.extract(p, "typescript", s),
    "tsx": lambda p, s: script.extract(p, "tsx", s),
    "javascript": lambda p, s: script.extract(p, "javascript", s),
}


#: Sources that a worker takes up at once, and the characters of rows that it hands over at once: its memory doesn't grow with Spark's batches.
SOURCES, HELD = 64, 4 << 20


def register(language: str, extractor: Callable[[str, str], Extraction]) -> None:
    EXTRACTORS[language] = extractor


def supports(language: str) -> bool:
    return language in EXTRACTORS


def extracted(sources: DataFrame, key: str | None = None, columns: Sequence[str] = ENTITY_FIELDS) -> DataFrame:
    """(path, parse_state, parse_error, entities, relations) of sources (path, language, content), rows as JSON arrays.

    With `key` its column of text comes along, as where a path has several contents. Entities get all of their columns, or
    those that are named: Spark can't tell a worker what is read of its rows.

    A language without an extractor gives no rows. A broken source gives what can be read of it.
    """

    names = ["path", "language", "content", *([key] if key else [])]
    return sources.select(*names).mapInArrow(lambda batches: rows_of(batches, names, columns), ", ".join(f"{c} string" for c in (*FOUND, *names[3:])))


FOUND = ("path", "parse_state", "parse_error", "entities", "relations")


def rows_of(batches: Iterator[pa.RecordBatch], names: list[str], columns: Sequence[str] = ENTITY_FIELDS) -> Iterator[pa.RecordBatch]:
    """The rows of `extracted` for batches with the columns `names`, in batches of bounded size."""
    for batch in batches:
        rows, held = [], 0
        for at in range(0, batch.num_rows, SOURCES):
            part = batch.slice(at, SOURCES)
            for path, language, content, *rest in zip(*(part.column(c).to_pylist() for c in names), strict=True):
                if language not in EXTRACTORS or content is None:
                    rows.append((path, "UNSUPPORTED_LANGUAGE", None, "[]", "[]", *rest))
                else:
                    got = EXTRACTORS[language](path, content)
                    rows.append((path, "PARSE_ERROR" if got.partial else "OK", "syntax error" if got.partial else None, json.dumps(got.measured(columns)), json.dumps(got.relations), *rest))
                held += len(rows[-1][3]) + len(rows[-1][4])
                if held >= HELD:
                    yield _batch(rows, names)
                    rows, held = [], 0
        if rows:
            yield _batch(rows, names)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=[*FOUND, *names[3:]])


def entities(found: DataFrame, columns: Sequence[str] = ENTITY_FIELDS) -> DataFrame:
    return found.select(F.explode(F.from_json("entities", f"array<struct<{_struct(ENTITIES, columns)}>>")).alias("e")).select("e.*")


def relations(found: DataFrame) -> DataFrame:
    return found.select(F.explode(F.from_json("relations", f"array<struct<{_struct(RELATIONS)}>>")).alias("r")).select("r.*")


def _struct(ddl: str, columns: Sequence[str] | None = None) -> str:
    return ", ".join(f"{n}: {k}" for n, k in (x.split(" ") for x in ddl.split(", ")) if columns is None or n in columns)
