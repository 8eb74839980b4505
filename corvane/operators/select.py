"""Selection of ranked candidates under a token budget, and rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import scoring
from corvane.functions.text import estimate_tokens
from corvane.session import kept

FULL_SCORE, REFERENCE_COST, MAX_FILES = 55.0, 12, 12
LEVELS = ("FULL", "SIGNATURE", "REFERENCE")


def rendered(ranked: DataFrame, relations: DataFrame, sources: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Candidates with their text at each level (null where there is none) and its token cost.

    Texts and costs are made once per entity, not per task; with `entities` the tasks' rows needn't be searched for them.
    """
    columns = ["id", "type", "qualified_name", "file_path", "start_line", "start_byte", "end_byte", "signature", "documentation"]
    items = ranked.select(*columns).dropDuplicates(["id"]) if entities is None else entities.select(*columns).join(ranked.select("id").distinct(), "id", "left_semi")
    first = lambda c: F.substring_index(F.col(c), "\n", 1)
    calls = relations.filter("type = 'CALLS'").groupBy(F.col("source_id").alias("id"), "target_hint").agg(F.min("line").alias("l"))
    calls = calls.groupBy("id").agg(F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("l", "target_hint"))), lambda x: x["target_hint"]), 1, 12), ", ").alias("_calls"))
    base = relations.filter("type = 'EXTENDS'").groupBy(F.col("source_id").alias("id")).agg(F.min_by("target_hint", F.struct("line", "target_hint")).alias("_extends"))
    rows = items.join(calls, "id", "left").join(base, "id", "left").join(sources.select(F.col("path").alias("file_path"), "content"), "file_path", "left")
    place = F.concat_ws(":", "file_path", "start_line")
    reference = F.concat(F.col("type"), F.lit(" "), F.col("qualified_name"), F.lit("  ("), place, F.lit(")"))
    signature = F.concat_ws("\n", reference, F.concat(F.lit("  "), F.col("signature")), F.concat(F.lit("  DOC: "), first("documentation")), F.concat(F.lit("  CALLS: "), F.col("_calls")), F.concat(F.lit("  EXTENDS: "), F.col("_extends")))
    code = F.substring(F.col("content"), F.col("start_byte") + 1, F.col("end_byte") - F.col("start_byte"))
    full = F.when(F.trim(code) != "", F.concat_ws("\n", F.concat(F.lit("// "), place, F.lit(" — "), F.col("type"), F.lit(" "), F.col("qualified_name")), F.concat(F.lit("// "), first("documentation")), code))
    rows = rows.withColumns({"t_full": full, "t_signature": signature, "t_reference": reference})
    rows = rows.withColumns({f"n_{x.lower()}": F.when(F.col(f"t_{x.lower()}").isNotNull(), estimate_tokens(F.col(f"t_{x.lower()}"))) for x in LEVELS})
    return ranked.join(rows.select("id", *(f"{k}_{x.lower()}" for k in "tn" for x in LEVELS)), "id")


def greedy(ranked: DataFrame, budgets: DataFrame, max_files: int = MAX_FILES) -> DataFrame:
    """Decisions (query_id, id, detail, tokens, reason) over candidates with costs n_full, n_signature and n_reference.

    In order of score, density and id a candidate takes the richest level that fits, FULL only from a score of 55 or
    as a seed. Detail is null for those left out, with the reason. `budgets`: query_id, budget.

    What is left only shrinks, so a level that costs more than is left now will never fit and goes at once. Of the candidates that
    have a level, the longest prefix whose richest levels fit together, with their new files, is taken in one round by running
    sums; then levels are struck again for the smaller rest. Each round takes the first open candidate of a task at least, and a task
    ends when no candidate has a level. Rounds are written tables; there is no Python in them.
    """
    density = F.col("score") / F.greatest(F.col("token_estimate"), F.lit(1))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc(density), "id"))
    rich = (F.col("score") >= FULL_SCORE) | (F.col("hop_distance") == 0)
    costs = F.array(*(F.struct(F.lit(x).alias("level"), (F.when(rich, F.col("n_full")) if x == "FULL" else F.col(f"n_{x.lower()}")).cast("int").alias("cost")) for x in LEVELS))
    rows = ranked.join(budgets, "query_id").select("query_id", "id", "file_path", "score", order.alias("_n"), F.filter(costs, lambda c: c["cost"].isNotNull()).alias("_costs"), F.col("budget").alias("_left"))
    start = kept(rows)
    state = start.withColumns({"_files": F.lit(0), "_known": F.lit(False)})
    query, running = Window.partitionBy("query_id"), Window.partitionBy("query_id").orderBy("_n")
    taken = []
    while True:
        fits = F.filter("_costs", lambda c: c["cost"] <= F.col("_left"))
        now = state.withColumn("_costs", fits).filter((F.size("_costs") > 0) & (F.col("_left") > REFERENCE_COST) & (F.col("_known") | (F.col("_files") < max_files)))
        own = F.col("_costs")[0]["cost"]
        first = ~F.col("_known") & (F.row_number().over(Window.partitionBy("query_id", "file_path").orderBy("_n")) == 1)
        now = now.withColumns({"_own": own, "_first": first})
        now = now.withColumns({"_sum": F.sum("_own").over(running), "_new": F.count_if("_first").over(running)})
        safe = (F.col("_sum") <= F.col("_left")) & (F.col("_left") - F.col("_sum") + F.col("_own") > REFERENCE_COST) & (F.col("_files") + F.col("_new") <= max_files)  # once false, false from there on
        now = now.withColumn("_safe", safe).withColumns({
            "_spent": F.coalesce(F.sum(F.when(F.col("_safe"), F.col("_own"))).over(query), F.lit(0)), "_opened": F.count_if(F.col("_safe") & F.col("_first")).over(query),
            "_mine": F.max("_safe").over(Window.partitionBy("query_id", "file_path")),
        })
        now = kept(now)
        taken.append(now.filter("_safe").select("query_id", "id", "_n", F.col("_costs")[0]["level"].alias("detail"), F.col("_own").alias("tokens")))
        state = now.filter("not _safe").select(*start.columns[:-1], (F.col("_left") - F.col("_spent")).cast("int").alias("_left"), (F.col("_files") + F.col("_opened")).cast("int").alias("_files"), (F.col("_known") | F.col("_mine")).alias("_known"))
        if state.isEmpty():
            break
    chosen = taken[0]
    for t in taken[1:]:
        chosen = chosen.unionByName(t)
    out = start.drop("_costs", "_left").join(chosen.select("query_id", "_n", "detail", "tokens"), ["query_id", "_n"], "left")
    # A candidate that is left out was so for its file if twelve others were open at its turn and its own was not.
    picked = F.col("detail").isNotNull()
    opener = picked & (F.row_number().over(Window.partitionBy("query_id", "file_path").orderBy(~picked, "_n")) == 1)
    out = out.withColumn("_opener", opener).withColumns({"_before": F.count_if("_opener").over(running), "_since": F.min(F.when(picked, F.col("_n"))).over(Window.partitionBy("query_id", "file_path"))})
    full = (F.col("_before") >= max_files) & (F.col("_since").isNull() | (F.col("_since") > F.col("_n")))
    return out.select("query_id", "id", "file_path", F.col("score").cast("double").alias("score"), "detail", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.when(~picked, F.when(full, "files").otherwise("budget")).alias("reason"))


def metrics(decisions: DataFrame, budgets: DataFrame, total_tokens: DataFrame) -> DataFrame:
    """Per task: selected and omitted, files, tokens and the share of the project's tokens (one row) that is saved."""
    per = decisions.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("considered"), F.count("detail").alias("selected"), F.countDistinct(F.when(F.col("detail").isNotNull(), F.col("file_path"))).alias("files"), F.sum("tokens").alias("spent")
    )
    out = per.join(budgets, "query_id").crossJoin(F.broadcast(total_tokens))
    return out.withColumn("reduction", F.when(F.col("total_tokens") > 0, 1 - F.col("spent") / F.col("total_tokens")).otherwise(0.0))


def package(decisions: DataFrame, texts: DataFrame, tasks: DataFrame) -> DataFrame:
    """(query_id, package): a text with the selected items by file and score, and the first 15 omitted ones."""
    chosen = decisions.join(texts.select("query_id", "id", "t_full", "t_signature", "t_reference"), ["query_id", "id"])
    body = F.when(F.col("detail") == "FULL", F.col("t_full")).when(F.col("detail") == "SIGNATURE", F.col("t_signature")).otherwise(F.col("t_reference"))
    first = F.row_number().over(Window.partitionBy("query_id", "file_path").orderBy(F.desc(F.round("score")), "id")) == 1
    items = chosen.filter("detail is not null").withColumn("body", F.when(first, F.concat(F.lit("\n## "), F.col("file_path"), F.lit("\n\n"), body)).otherwise(F.concat(F.lit("\n"), body)))
    items = items.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_path", (-F.round("score")).alias("s"), "id", "body"))), lambda x: x["body"]), "\n").alias("_items"))
    left = decisions.filter("detail is null").groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), 1, 15).alias("_left"))
    left = left.select("query_id", F.concat(F.lit("\n\n# OMITTED\n"), F.col("_n").cast("string"), F.lit(" relevant items did not fit\n"), F.array_join(F.transform("_left", lambda x: F.concat(F.lit("- "), x["id"])), "\n")).alias("_omitted"))
    out = tasks.select("query_id", "task").join(items, "query_id", "left").join(left, "query_id", "left")
    return out.select("query_id", F.concat(F.lit("# TASK\n"), F.col("task"), F.lit("\n\n# CONTEXT\n"), F.coalesce("_items", F.lit("")), F.coalesce("_omitted", F.lit(""))).alias("package"))


def budgets(tasks: DataFrame, budget: int, margin: float = 0.05) -> DataFrame:
    if budget < 500:
        raise ValueError("BUDGET_TOO_SMALL: 500 tokens at least")
    return tasks.select("query_id", scoring.effective_budget(F.lit(float(budget)), F.lit(margin)).cast("int").alias("budget"))


