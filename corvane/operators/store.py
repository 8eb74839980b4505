"""Versioned snapshots of the index: a folder of tables per commit, and a numbered manifest that names them.

A commit writes its tables first and then takes the next number by creating that manifest, which only one writer can. A
writer that finds the number taken starts again from the version that took it (`transact`), so no commit is lost and
readers see one version or the next. The full-text tables (`operators.postings`) are shared by versions: a manifest lists their segments.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

from corvane import schemas

TABLES = {"files": schemas.FILES, "entities": schemas.ENTITIES, "relations": schemas.RELATIONS, "meta": schemas.META}
TRIES = 8


class Conflict(RuntimeError):
    """Another writer committed first."""


class Store:
    def __init__(self, spark: SparkSession, root: str, on_mismatch: str = "error") -> None:
        """`on_mismatch`: what an index of another schema version is taken for: an error, or (recreate) no index."""
        self.spark, self.root, self.on_mismatch = spark, root.rstrip("/"), on_mismatch

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, fs = self._file(folder)
        return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []

    def _create(self, name: str, text: str) -> None:
        """Makes a whole file that wasn't there, or raises Conflict: of several writers one succeeds."""
        path, fs = self._file(name)
        spare, _ = self._file(f"{name}.{uuid.uuid4().hex}.new")
        out = fs.create(spare, False)
        out.write(bytearray(text, "utf-8"))
        out.close()
        if fs.getUri().getScheme() == "file":  # a hard link is made or refused in one step
            here = [Path(unquote(urlparse(p.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()).path)) for p in (spare, path)]
            try:
                os.link(*here)
            except FileExistsError:
                raise Conflict(name) from None
            finally:
                fs.delete(spare, False)
            return
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration())
        try:  # renames that don't overwrite are atomic in the name node
            context.rename(spare, path, self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception:
            if not fs.exists(path):
                raise
            fs.delete(spare, False)
            raise Conflict(name) from None

    def manifest(self, number: int | None = None) -> dict | None:
        """The newest manifest, or the one of that number."""
        if number is None:
            numbers = [int(n[:-5]) for n in self._names("manifests") if n.endswith(".json")]
            if not numbers:
                return None
            number = max(numbers)
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.root}/manifests/{number:08d}.json").collect()))

    def current(self) -> dict | None:
        """The newest manifest; an index of another schema version is refused, or taken for none."""
        m = self.manifest()
        if m and m["schema_version"] != schemas.SCHEMA_VERSION:
            if self.on_mismatch == "recreate":
                return None
            raise ValueError(f"index has schema version {m['schema_version']}, expected {schemas.SCHEMA_VERSION}: rebuild it")
        return m

    def version(self) -> str | None:
        m = self.current()
        return m["version"] if m else None

    def read(self, table: str, base: dict | None = None) -> DataFrame:
        """A table as the manifest `base` has it, the newest by default."""
        m = base or self.current()
        return self.as_of(m["version"], table) if m else self.spark.createDataFrame([], TABLES[table])

    def commit(self, tables: dict[str, DataFrame], base: dict | None = None, postings: dict | None = None) -> str:
        """Writes all tables as the version after `base`. Conflict if another one came after it."""
        newest = self.manifest()
        before = (base or {}).get("number", 0)
        if base is None and newest:
            before = newest["number"]
        version = f"v-{uuid.uuid4().hex}"
        for name in TABLES:
            tables[name].write.parquet(f"{self.root}/{version}/{name}")
        state = postings if postings is not None else (base or newest or {}).get("postings")
        self._create(f"manifests/{before + 1:08d}.json", json.dumps({"number": before + 1, "version": version, "schema_version": schemas.SCHEMA_VERSION, "postings": state}))
        return version

    def transact(self, change: Callable[[dict | None], tuple[dict[str, DataFrame], dict | None] | None], tries: int = TRIES) -> str | None:
        """Commits what `change` makes of the newest manifest: (tables, postings state), or None for nothing to do.

        It is called again with a newer manifest whenever another writer came first.
        """
        for left in range(tries - 1, -1, -1):
            base = self.current()
            made = change(base)
            if made is None:
                return base["version"] if base else None
            try:
                return self.commit(made[0], base or {"number": (self.manifest() or {"number": 0})["number"]}, made[1])
            except Conflict:
                if not left:
                    raise
        return None

    def meta(self) -> dict[str, str]:
        return {r["key"]: r["value"] for r in self.read("meta").collect()}

    def set_meta(self, values: dict[str, str]) -> None:
        """Writes a version whose meta rows have these values, the last to write a key winning; other tables stay."""

        def change(base: dict | None) -> tuple[dict[str, DataFrame], dict | None]:
            tables = {t: self.read(t, base) for t in TABLES}
            meta = {r["key"]: r["value"] for r in tables["meta"].collect()} | values
            return tables | {"meta": self.spark.createDataFrame(list(meta.items()), schemas.META)}, (base or {}).get("postings")

        self.transact(change)

    def versions(self) -> list[str]:
        """Every committed version, oldest first."""
        return [self.manifest(int(n[:-5]))["version"] for n in self._names("manifests") if n.endswith(".json")]

    def as_of(self, version: str, table: str) -> DataFrame:
        """A table as an earlier version has it."""
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.root}/{version}/{table}")
