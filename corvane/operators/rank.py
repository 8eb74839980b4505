"""Relevance ranking: seeds, expansion, nine signals and a weighted score, for many tasks at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import scoring, text
from corvane.functions.words import SIGNAL_WEIGHTS
from corvane.operators import graph, search
from corvane.session import kept

LEXICAL_SEEDS, LEXICAL_HITS, PATH_FILES, RECENT_FILES, CANDIDATES, EDGE_CONFIDENCE = 40, 500, 6, 8, 3000, 0.2


def analysed(tasks: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """Tasks (query_id, task, optional includes) with kind, symbols, paths, terms and query clauses.

    With a lexicon (term, synonym) the terms have their synonyms too, and the clauses those of the synonyms.
    """
    t = tasks.withColumn("_folded", text.strip_accents("task"))
    t = t.withColumn("a", text.analyze_task(F.col("task"), F.col("_folded"))).withColumn("clauses", text.query_terms(F.col("_folded")))
    include = F.col("includes") if "includes" in tasks.columns else F.array().cast("array<string>")
    out = t.select("query_id", "task", "a.kind", "a.symbols", "a.paths", "a.terms", "clauses", include.alias("includes"))
    if lexicon is None:
        return out
    more = search.expand_terms(out.select("query_id", F.explode("terms").alias("term")), lexicon).groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("_terms"))
    wide = out.join(more, "query_id", "left")
    added = F.array_except(F.coalesce("_terms", F.array().cast("array<string>")), "terms")
    wide = wide.withColumn("_more", text.strip_accents(F.array_join(added, " ")))
    return wide.withColumns({"terms": F.array_union("terms", added), "clauses": F.array_union("clauses", text.query_terms(F.col("_more")))}).select(*out.columns)


def recent_files(commits: DataFrame, k: int = RECENT_FILES) -> DataFrame:
    """The k paths (path, ts) of the latest commits."""
    return commits.groupBy("path").agg(F.max("ts").alias("ts")).orderBy(F.desc("ts"), "path").limit(k)


def seeds(tasks: DataFrame, entities: DataFrame, files: DataFrame, scores: DataFrame, commits: DataFrame) -> DataFrame:
    """(query_id, id, reasons): symbol, cited path, path-term and lexical seeds; recent files only where there is none."""
    cited = tasks.select("query_id", F.explode("symbols").alias("symbol"))
    named = entities.select("id", F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("symbol"))
    by_name = named.join(cited, "symbol").select("query_id", "id", F.lit(1).alias("o"), F.concat(F.lit("symbol "), F.col("symbol")).alias("reason"))
    paths = tasks.select("query_id", F.explode(F.concat("paths", "includes")).alias("file_path")).distinct()
    near = search.paths_with_terms(files, tasks.select("query_id", text.path_terms(F.col("terms")).alias("terms")), PATH_FILES)
    places = paths.select("query_id", "file_path", F.lit(2).alias("o"), F.concat(F.lit("path "), F.col("file_path")).alias("reason"))
    places = places.unionByName(near.select("query_id", F.col("path").alias("file_path"), F.lit(3).alias("o"), F.lit("path term").alias("reason")))
    by_path = entities.select("id", "file_path").join(places, "file_path").select("query_id", "id", "o", "reason")
    lexical = search.top(scores, LEXICAL_SEEDS).select("query_id", "id", F.lit(4).alias("o"), F.lit("text").alias("reason"))
    every = kept(by_name.unionByName(by_path).unionByName(lexical))
    none = tasks.select("query_id").join(every.select("query_id").distinct(), "query_id", "left_anti")
    last = entities.join(recent_files(commits).select(F.col("path").alias("file_path")), "file_path").crossJoin(none)  # 8 files at most
    every = every.unionByName(last.select("query_id", "id", F.lit("recent").alias("reason"), F.lit(5).alias("o")))
    return every.groupBy("query_id", "id").agg(F.transform(F.array_sort(F.collect_set(F.struct("o", "reason"))), lambda x: x["reason"]).alias("reasons"))


def rank(
    tasks: DataFrame, entities: DataFrame, relations: DataFrame, files: DataFrame, find: Callable[[DataFrame], DataFrame], commits: DataFrame, hops: int = 2, weights: dict[str, float] | None = None,
    lexicon: DataFrame | None = None,
) -> DataFrame:
    """Scored candidates of each task: query_id, id, hop_distance, the nine signals, score, reasons.

    `find` gives (query_id, id, score) for clauses (query_id, term, is_prefix): a stored index, or BM25 over postings made for the purpose.
    What is known of an entity alone is joined to the entities; what is known of a task's candidate meets in one grouping by (query_id, id).
    """
    tasks = kept(analysed(tasks, lexicon))
    # Sums of doubles depend on their order in the last digits: ties are told at nine.
    scores = kept(find(search.clauses(tasks)).withColumn("score", F.round("score", 9)))
    start = kept(seeds(tasks, entities, files, scores, commits))
    near = graph.neighbors(relations, start.select("query_id", "id"), hops, "BOTH", min_confidence=EDGE_CONFIDENCE, by=["query_id"])
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("hop_distance", F.desc("path_confidence"), "entity_id"))
    near = near.withColumn("_n", order).filter((F.col("_n") <= CANDIDATES) | (F.col("hop_distance") == 0)).select("query_id", F.col("entity_id").alias("id"), "hop_distance")
    calls = relations.filter("type = 'CALLS' and target_id is not null")
    called = start.select("query_id", F.col("id").alias("source_id")).join(calls, "source_id").select("query_id", F.col("target_id").alias("id"))
    calling = start.select("query_id", F.col("id").alias("target_id")).join(calls, "target_id").select("query_id", F.col("source_id").alias("id"))
    tests = relations.filter("type = 'TESTS'").join(start.select("query_id", F.col("id").alias("target_id")), "target_id").select("query_id", F.col("source_id").alias("id"))
    facts = {"hop_distance": "int", "lexical": "double", "_partner": "double", "_test": "double"}

    def fact(rows: DataFrame, name: str, value: Column) -> DataFrame:
        return rows.select("query_id", "id", *((value if c == name else F.lit(None)).cast(t).alias(c) for c, t in facts.items()))

    every = fact(near, "hop_distance", F.col("hop_distance"))
    for rows, name, value in ((search.normalised(scores, LEXICAL_HITS), "lexical", F.col("lexical")), (called.unionByName(calling), "_partner", F.lit(1.0)), (tests, "_test", F.lit(1.0))):
        every = every.unionByName(fact(rows, name, value))
    met = every.groupBy("query_id", "id").agg(*(F.max(c).alias(c) for c in facts)).filter("hop_distance is not null")
    met = met.join(start, ["query_id", "id"], "left")  # texts stay out of the grouping, which then needs no sort
    touched = commits.groupBy(F.col("path").alias("file_path")).agg(F.max("ts").alias("_ts"))
    newest = commits.agg(F.max("ts").alias("_newest"))
    known = entities.join(graph.in_degrees(relations), "id", "left").join(touched, "file_path", "left").crossJoin(F.broadcast(newest))  # one row
    rows = met.join(known, "id").join(tasks.select("query_id", "kind", "symbols"), "query_id")
    most = F.greatest(F.lit(1), F.max(F.coalesce("degree", F.lit(0))).over(Window.partitionBy("query_id")))
    signals = {
        "semantic": F.lit(0.0), "lexical": F.coalesce("lexical", F.lit(0.0)), "symbol_match": scoring.symbol_match(F.col("name"), F.col("qualified_name"), F.col("symbols")),
        "graph_proximity": 1.0 / (1 + F.col("hop_distance")), "call_relationship": F.coalesce("_partner", F.lit(0.0)), "file_importance": F.coalesce("degree", F.lit(0)) / most,
        "task_type": scoring.affinity(F.col("kind"), F.col("type")), "recent_changes": scoring.recency(F.col("_ts"), F.col("_newest")), "test_relationship": F.coalesce("_test", F.lit(0.0)),
    }
    rows = rows.withColumns({f"s_{k}": v for k, v in signals.items()})
    reasons = F.concat(
        F.coalesce("reasons", F.array().cast("array<string>")), F.when(F.col("s_lexical") > 0, F.array(F.lit("text match"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("s_call_relationship") > 0, F.array(F.lit("calls or is called by a seed"))).otherwise(F.array().cast("array<string>")), F.when(F.col("s_recent_changes") > 0.5, F.array(F.lit("changed lately"))).otherwise(F.array().cast("array<string>")),
    )
    score = scoring.weighted_score({k: F.col(f"s_{k}") for k in signals}, weights or SIGNAL_WEIGHTS)
    return rows.select("query_id", "id", "type", "name", "qualified_name", "file_path", "start_line", "start_byte", "end_byte", "signature", "documentation", "token_estimate", "hop_distance", *(f"s_{k}" for k in signals), F.round(score, 9).alias("score"), F.array_distinct(reasons).alias("reasons"))


def score_floor(ranked: DataFrame) -> DataFrame:
    """Candidates at or over the floor: a quarter of their task's best score, 12 at least."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    floor = F.greatest(F.lit(scoring.FLOOR_SHARE) * F.col("_best"), F.lit(scoring.FLOOR_LEAST))
    return ranked.withColumn("_best", best).filter(F.col("score") >= floor).drop("_best")
