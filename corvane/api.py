"""A project: a source tree, its index, and the three questions on it."""

from __future__ import annotations

import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane import schemas
from corvane.extract import registry
from corvane.functions import text
from corvane.functions.words import PARSED_LANGUAGES
from corvane.operators import changes, evaluate, graph, impact, rank, resolve, search, select, stats
from corvane.operators.postings import Postings
from corvane.operators.store import TABLES, Store
from corvane.session import kept, reachable
from corvane.sources import config, history, scan
from corvane.sources.ignore import compile_line


class Project:
    """`root` is the source tree; the index stands in `index`, by default a folder below it."""

    def __init__(self, spark: SparkSession, root: str, index: str | None = None) -> None:
        self.spark, self.root = reachable(spark), str(Path(root).resolve())
        self.config = config.load(self.root)
        self.store = Store(spark, index or f"{self.root}/.corvane/index")

    def init(self, force: bool = False) -> Path:
        """Writes the configuration; one that is there already is only replaced, by the defaults, with `force`."""
        if Path(self.root, config.FILE).exists() and not force:
            raise FileExistsError(f"{config.FILE} is there already")
        self.config = config.defaults(Path(self.root).name) if force else self.config
        return config.write(self.root, self.config)

    # --- scan ---

    def _rules(self) -> list:
        own = [compile_line(".corvane/")]
        return own + scan.rules(self.spark, self.root, tuple(self.config["indexing"]["excludes"]))

    def _disk(self, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Sources get 0 for their token_estimate: their extraction tells it."""
        deny = tuple(self.config["security"]["deny_paths"])
        return scan.scan(self.spark, self.root, known, self._rules(), deny, self.config["indexing"]["max_file_bytes"], PARSED_LANGUAGES)

    def scan(self, rebuild: bool = False) -> dict[str, int]:
        """Brings the index in line with the disk; with `rebuild` everything is read and vanished files go too.

        Several scans may run at once: one that another overtakes starts again from the version that the other committed.
        """
        report: dict[str, int] = {}

        def change(base: dict | None) -> tuple[dict[str, DataFrame], dict | None] | None:
            report.clear()
            made, counts = self._changed(base, rebuild)
            report.update(counts)
            return made

        self.store.transact(change)
        return report

    def _postings(self, base: dict | None) -> Postings:
        return Postings(self.spark, f"{self.store.root}/postings", (base or {}).get("postings"))

    def _changed(self, base: dict | None, rebuild: bool) -> tuple[tuple[dict[str, DataFrame], dict] | None, dict[str, int]]:
        """The tables and postings after a scan from the version `base`, and how many files changed how."""
        anew = rebuild or not base
        # With no rows by their plans, Spark drops the joins with them.
        old = {t: self.spark.createDataFrame([], TABLES[t]).limit(0) if anew else self.store.read(t, base) for t in ("files", "entities", "relations")}
        fresh, same = self._disk(None if anew else old["files"])
        fresh = kept(fresh)
        signatures = fresh.select("path", "content_hash").unionByName(same.join(old["files"].select("path", "content_hash"), "path"))
        diff = kept(changes.change_set(signatures, old["files"]))
        count = {r["change"]: r["count"] for r in diff.groupBy("change").count().collect()}
        report = {c: count.get(c, 0) for c in ("added", "modified", "deleted", "unchanged")}
        changed, gone = diff.filter("change in ('added', 'modified')").select("path"), diff.filter("change in ('modified', 'deleted')").select("path")
        if not (report["added"] or report["modified"] or report["deleted"]) and base and not rebuild:
            return None, report
        # Where all that was read has changed, as in a first scan, the contents needn't meet the changes.
        rows = fresh if report["unchanged"] == same.count() else fresh.join(changed, "path", "left_semi")
        found = kept(registry.extracted(rows.filter(F.col("parse_state").isin("OK") & F.col("language").isin(*PARSED_LANGUAGES))))
        new = kept(registry.entities(found).select(*old["entities"].columns))  # written, as is what follows of the edges: each is read many times
        states = found.select("path", F.col("parse_state").alias("_state"), F.col("parse_error").alias("_error"))
        own = new.filter("type = 'FILE'").select(F.col("file_path").alias("path"), F.col("token_estimate").alias("_tokens"))
        new_files = rows.drop("content").join(states, "path", "left").join(own, "path", "left")
        told = {"parse_state": F.coalesce("_state", "parse_state"), "parse_error": F.coalesce("_error", "parse_error"), "token_estimate": F.coalesce("_tokens", "token_estimate")}
        new_files = new_files.withColumns(told).select(*old["files"].columns)
        files = changes.purge(old["files"], changed.unionByName(gone).distinct(), "path").unionByName(new_files)
        entities = changes.purge(old["entities"], gone, "file_path").unionByName(new)
        still = changes.demote(old["relations"], old["entities"], gone)
        relations = kept(changes.dedup_relations(still.unionByName(registry.relations(found).select(*old["relations"].columns))))
        relations = resolve.resolve_all(relations, entities, files)
        postings = self._postings(None if rebuild else base).added(search_documents(new), gone.select(F.col("path").alias("file_path")))
        stamp = [("schema_version", str(schemas.SCHEMA_VERSION)), ("last_scan_at", str(int(time.time() * 1000))), ("project_name", self.config["project"]["name"])]
        return ({"files": files, "entities": entities, "relations": relations, "meta": self.spark.createDataFrame(stamp, schemas.META)}, postings), report

    def freshness(self) -> DataFrame:
        """(path, change) of what a scan would do, without doing it."""
        known = self.store.read("files")
        fresh, same = self._disk(known)
        signatures = fresh.select("path", "content_hash").unionByName(same.join(known.select("path", "content_hash"), "path"))
        return changes.change_set(signatures, known).filter("change <> 'unchanged'")

    # --- point look-ups ---

    def file(self, path: str) -> DataFrame:
        return self.store.read("files").filter(F.col("path") == path)

    def files(self) -> DataFrame:
        return self.store.read("files").orderBy("path")

    def signatures(self) -> DataFrame:
        return self.store.read("files").select("path", "content_hash", "mtime_ms", "size_bytes")

    def entities(self, ids: list[str] | None = None, path: str | None = None, name: str | None = None, types: list[str] | None = None) -> DataFrame:
        out = self.store.read("entities")
        out = out.filter(F.col("id").isin(*ids)) if ids is not None else out
        out = out.filter(F.col("file_path") == path).orderBy("start_line") if path is not None else out
        out = out.filter((F.col("name") == name) | (F.col("qualified_name") == name)) if name is not None else out
        return out.filter(F.col("type").isin(*types)) if types is not None else out

    def relations(self, source: str | None = None, target: str | None = None, path: str | None = None, unresolved: bool = False, hints: list[str] | None = None) -> DataFrame:
        out = self.store.read("relations")
        for column, value in (("source_id", source), ("target_id", target), ("file_path", path)):
            out = out.filter(F.col(column) == value) if value is not None else out
        out = out.filter("target_id is null") if unresolved or hints is not None else out
        return out.filter(F.col("target_hint").isin(*hints)) if hints is not None else out

    def neighbors(self, ids: list[str], depth: int, direction: str = "OUT", types: list[str] | None = None, min_confidence: float = 0.0, limit: int = 5000) -> DataFrame:
        seeds = self.store.read("entities").filter(F.col("id").isin(*ids)).select("id")
        return graph.neighbors(self.store.read("relations"), seeds, depth, direction, types, min_confidence, limit)

    # --- questions ---

    def search(self, query: str, k: int = 40) -> DataFrame:
        """The k best entities; of the stored index only the buckets of the query's terms are opened."""
        asked = rank.analysed(self.spark.createDataFrame([(0, query)], "query_id int, task string"))
        return search.top(self._postings(self.store.current()).scores(search.clauses(asked)), k).select("id", "score", "rank")

    def lexicon(self) -> DataFrame | None:
        """(term, synonym) of the configured groups; None without any."""
        groups = config.synonym_groups(self.config)
        return search.lexicon(self.spark.createDataFrame([(g,) for g in groups], "words array<string>")) if groups else None

    def context(self, task: str, budget: int | None = None, hops: int | None = None, include: list[str] | None = None, weights: dict[str, float] | None = None) -> dict:
        """The selected items, what was left out, metrics and the package as text."""
        tasks = self.spark.createDataFrame([(0, task, include or [])], "query_id int, task string, includes array<string>")
        base = self.store.current()
        index = {t: self.store.read(t, base) for t in ("files", "entities", "relations")}
        commits = history.touched(history.commits(self.spark, self.root))
        return self._selected(tasks, index, self._postings(base).scores, commits, lambda paths: scan.contents(self.spark, self.root, paths), budget, hops, weights)

    def _selected(
        self, tasks: DataFrame, index: dict[str, DataFrame], find: Callable[[DataFrame], DataFrame], commits: DataFrame, contents: Callable[[DataFrame], DataFrame], budget: int | None = None,
        hops: int | None = None, weights: dict[str, float] | None = None,
    ) -> dict:
        """What `context` returns, for one task over any state of the index."""
        own = self.config["context"]
        budgets = select.budgets(tasks, budget or own["budget"], own["margin"])
        ranked = kept(rank.score_floor(rank.rank(tasks, index["entities"], index["relations"], index["files"], find, commits, hops if hops is not None else own["max_hops"], weights, self.lexicon())))
        costed = kept(select.rendered(ranked, index["relations"], contents(ranked.select(F.col("file_path").alias("path"))), index["entities"]))
        decisions = kept(select.greedy(costed, budgets))
        total = index["files"].agg(F.coalesce(F.sum("token_estimate"), F.lit(0)).alias("total_tokens"))
        return {
            "kind": rank.analysed(tasks).first()["kind"], "items": [r.asDict() for r in decisions.filter("detail is not null").orderBy("file_path", F.desc(F.round("score")), "id").collect()],
            "omitted": [r.asDict() for r in decisions.filter("detail is null").orderBy(F.desc("score"), "id").collect()], "metrics": [r.asDict() for r in select.metrics(decisions, budgets, total).collect()],
            "package": select.package(decisions, costed, tasks).first()["package"],
            "reasons": {r["id"]: r["reasons"] for r in ranked.join(decisions.filter("detail is not null").select("id"), "id", "left_semi").select("id", "reasons").collect()},
        }

    def impact(self, symbol: str, hops: int = impact.HOPS, min_confidence: float = impact.EDGE_CONFIDENCE) -> dict:
        entities, relations = self.store.read("entities"), self.store.read("relations")
        asked = self.spark.createDataFrame([(0, symbol)], "query_id int, target string")
        chosen = kept(impact.targets(entities, asked))
        if chosen.isEmpty():
            raise LookupError(f"SYMBOL_NOT_FOUND: {symbol}")
        rows = impact.reached(entities, relations, chosen, hops, min_confidence).orderBy(F.desc("path_confidence"), "qualified_name")
        return {"report": impact.report(entities, relations, chosen, hops, min_confidence).first().asDict(), "reached": [r.asDict() for r in rows.collect()], "alternatives": sorted(r["id"] for r in impact.alternatives(entities, asked).collect())}

    def status(self) -> dict:
        files, entities, relations = (self.store.read(t) for t in ("files", "entities", "relations"))
        rows = lambda df: {r[0]: r[1] for r in df.collect()}
        return {
            "stats": stats.index_stats(files, entities, relations).first().asDict(), "entities_by_type": rows(stats.counts(entities, "type")), "files_by_language": rows(stats.counts(files, "language")),
            "top_languages": rows(stats.counts(files, "language", 4)), "parse_states": rows(stats.counts(files, "parse_state")), "skipped": rows(stats.skip_reasons(files)), "resolution": rows(stats.resolution_report(relations)), "meta": self.store.meta(),
        }

    def state_before(self, points: dict[str, int]) -> DataFrame:
        """(case_id, path, blob, content and the columns of files) as they were at the commits of `points` (name to number on the first-parent chain).

        Each blob of a path is read and looked at once, however many cases hold it.
        """
        held = kept(history.as_of(history.intervals(history.changes(self.spark, self.root)), points))
        state = scan.path_state(F.col("path"), F.lit(0), self._rules(), tuple(self.config["security"]["deny_paths"]))
        once = history.blobs(self.root, held.select("path", "blob").distinct().filter(state.isNull()))
        size = F.octet_length("content").cast("long")
        most = self.config["indexing"]["max_file_bytes"]
        read = once.select("path", "blob", F.lit(0.0).alias("mtime_ms"), size.alias("size_bytes"), F.when(size <= most, F.col("content")).alias("content"), F.when(size > most, "SKIPPED_TOO_LARGE").alias("state"))
        return held.join(scan.file_rows(read, "blob"), ["path", "blob"])

    def bench(self, limit: int = 20, budget: int = 20_000) -> dict:
        """Recall and precision of contexts on the project's own commits, each asked of the index as it was before its commit."""
        chain = history.changes(self.spark, self.root).select("sha", "n").distinct()
        every = kept(history.commits(self.spark, self.root, limit * 6).join(chain, "sha"))
        rejected = every.withColumn("reason", evaluate.reject_reason(F.col("subject"), F.col("files"))).filter("reason is not null").groupBy("reason").count()
        cases = evaluate.corpus(every.drop("n"), limit).join(every.select("sha", "ts", F.col("n").alias("at")), "sha").orderBy("n").collect()
        files = kept(self.state_before({c["sha"]: c["at"] - 1 for c in cases}))
        sources = files.filter(F.col("parse_state").isin("OK") & F.col("language").isin(*PARSED_LANGUAGES)).select("path", "blob", "language", "content").dropDuplicates(["path", "blob"])
        found = kept(registry.extracted(sources, "blob"))
        chosen, gold, times = [], [], []
        for c in cases:
            own = files.filter(F.col("case_id") == c["sha"])
            got = found.join(own.select("path", "blob"), ["path", "blob"], "left_semi")
            entities = kept(registry.entities(got))
            index = {"files": own, "entities": entities, "relations": kept(resolve.resolve_all(changes.dedup_relations(registry.relations(got)), entities, own))}
            postings, lengths = search.occurrences(search_documents(entities))
            earlier = history.touched(every.filter(F.col("n") < c["at"]))
            tasks = self.spark.createDataFrame([(0, c["task"], [])], "query_id int, task string, includes array<string>")
            began = time.time()
            out = self._selected(tasks, index, lambda asked, p=postings, n=lengths: search.bm25(p, n, asked), earlier, lambda paths, o=own: o.join(paths.distinct(), "path", "left_semi").select("path", "content"), budget)
            times.append((c["sha"], (time.time() - began) * 1000))
            chosen += [(c["sha"], i["file_path"]) for i in out["items"]]
            gold += [(c["sha"], p) for p in c["expected"]]
        frame = lambda rows, ddl: self.spark.createDataFrame(rows, ddl)
        results = evaluate.case_results(frame(chosen, "case_id string, path string"), frame(gold, "case_id string, path string")).join(frame(times, "case_id string, ms double"), "case_id")
        return evaluate.report(results, "ms").first().asDict() | {"worst": [r.asDict() for r in evaluate.worst(results).collect()], "rejected": {r["reason"]: r["count"] for r in rejected.collect()}}


def search_documents(entities: DataFrame) -> DataFrame:
    """(id, file_path, terms, literals): the texts that entities are found by."""
    terms = text.strip_accents(text.search_terms(F.col("name"), F.col("qualified_name"), F.col("signature"), F.col("documentation")))
    return entities.select("id", "file_path", terms.alias("terms"), "literals")
