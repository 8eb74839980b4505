"""Further queries over the test tables, each with its SQL: scalars, look-ups, resolution, ranking and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import ids, scoring, text, words
from corvane.operators import changes, evaluate, graph, impact, rank, resolve, search, select, stats
from corvane.plans import views
from corvane.plans.catalogue import SQL, _AFFINITY_SQL, _CLAUSES_SQL, _DOCS_SQL, _IMPACT_SQL, _KIND_SQL, _SPLIT, _TOKENS, _TWO, _asked, _bm25_sql, _cases, _CASES_SQL, _code_index, _disk_and_index, _quote, _ranked, _tree, query
from corvane.plans.views import EDGES_SQL, ENTITIES_SQL, HIERARCHY_SQL, PATHS_SQL, table
from corvane.sources import ignore, scan, secrets

# --- scalars -------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, list_aggregate([p_brand, p_type], 'string_agg', '.') AS qualified, p_brand || '#PART:' || p_type || '.' || p_name || CASE WHEN p_size % 3 > 0 THEN '~' || p_size % 3 ELSE '' END AS id FROM part")
def entity_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    name = ids.qualify(F.col("p_type"), F.col("p_name"))
    return p.select("p_partkey", ids.qualify(F.col("p_brand"), F.col("p_type")).alias("qualified"), ids.entity_id(F.col("p_brand"), F.lit("PART"), name, F.col("p_size") % 3).alias("id"))


@query("SELECT p_partkey, p_brand AS path, 'PART' AS type, p_type || '.' || p_name AS qualified, CAST(p_size % 3 AS INTEGER) AS ordinal FROM part")
def entity_ids_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    made = ids.entity_id(F.col("p_brand"), F.lit("PART"), ids.qualify(F.col("p_type"), F.col("p_name")), F.col("p_size") % 3)
    return p.select("p_partkey", ids.parse_entity_id(made).alias("e")).select("p_partkey", "e.*")


@query("SELECT page_id, replace(replace(url, '/', '\\'), '\\', '/') AS path FROM pages")
def posix_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", ids.posix_path(F.replace("url", F.lit("/"), F.lit("\\"))).alias("path"))


@query("SELECT doc_id, source || '/' || doc_id AS near, CASE WHEN doc_id % 2 = 0 THEN doc_id || '.x' END AS above FROM documents")
def normalized_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    near = F.concat(F.col("source"), F.lit("/./a//b/../../"), i)
    above = F.concat(F.when(F.col("doc_id") % 2 == 0, "a/..").otherwise("a/../.."), F.lit("/"), i, F.lit(".x"))
    return d.select("doc_id", ids.normalize_path(near).alias("near"), ids.normalize_path(above).alias("above"))


@query("SELECT p_partkey, p_name AS base, p_type AS bare, 'Says ' || p_name || chr(10) || 'twice.' AS comment FROM part")
def names_and_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = text.base_name(F.concat(F.lit("a.b."), F.col("p_name"), F.lit("<T, U>")))
    comment = F.concat(F.lit("/** Says "), F.col("p_name"), F.lit("\n *\n * twice. */"))
    return table(spark, sf_dir, "part").select("p_partkey", base.alias("base"), text.strip_quotes(F.concat(F.lit("'"), F.col("p_type"), F.lit('"'))).alias("bare"), text.clean_comment(comment).alias("comment"))


_TERMS_OF = "list_distinct(list_append(list_transform(" + _SPLIT + ", lambda p: lower(p)), lower({0})))"


@query(f"""SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(array_to_string(flatten([{_TERMS_OF.format('p_name')}, {_TERMS_OF.format("(p_type || '.' || p_name)")},
  flatten(list_transform(list_filter(regexp_split_to_array(p_brand, '[^A-Za-z0-9_$]+'), lambda w: length(w) >= 2), lambda w: {_TERMS_OF.format('w')}))]), ' '), ' '))), ' ') AS terms FROM part""")
def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.search_terms(F.col("p_name"), F.concat_ws(".", "p_type", "p_name"), F.col("p_brand"), F.lit(None).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(F.split(found, " ")), " ").alias("terms")).withColumn("terms", F.array_join(F.array_sort(F.array_distinct(F.split("terms", " "))), " "))


@query(f"SELECT item_id, array_to_string(list_sort(list_distinct(list_transform(flatten(list_transform(list_filter(regexp_split_to_array(strip_accents(text), '[^\\w$]+'), lambda w: length(w) >= 3), lambda w: {_SPLIT.format('w')})), lambda p: lower(p)))), ' ') AS terms FROM benchmark")
def task_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = table(spark, sf_dir, "benchmark").withColumn("f", text.strip_accents("text"))
    return folded.select("item_id", F.array_join(F.array_sort(text.task_terms(F.col("f"))), " ").alias("terms"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 1.0 WHEN p_size % 3 = 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS match, CAST(floor(p_size * 1000 * (1 - least(greatest(p_size / 50.0 - 0.2, 0), 0.5))) AS BIGINT) AS budget,
  round(p_retailprice / greatest(1, p_size - 10), 6) AS density, CASE p_size % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 WHEN 2 THEN least(0.5, 1.0 / p_size) ELSE 0.0 END::DOUBLE AS confidence, p_size % 5 < 4 AS container FROM part""")
def score_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, name = F.col("p_size"), F.col("p_name")
    symbols = F.array(F.lit("~"), F.when(size % 3 == 0, F.upper(name)).when(size % 3 == 1, F.concat(F.lit("x."), name, F.lit(".y"))).otherwise(F.lit("~~")))
    tier = F.when(size % 4 == 0, "EXACT").when(size % 4 == 1, "SCOPED").when(size % 4 == 2, "AMBIGUOUS").otherwise("UNRESOLVED")
    kinds = F.array(*(F.lit(x) for x in ("FILE", "DIRECTORY", "PROJECT", "MODULE", "FUNCTION")))
    return table(spark, sf_dir, "part").select(
        "p_partkey", scoring.symbol_match(name, F.concat_ws(".", "p_type", "p_name"), symbols).alias("match"), scoring.effective_budget(size * 1000, size / 50.0 - 0.2).cast("long").alias("budget"),
        F.round(scoring.density(F.col("p_retailprice"), size - 10), 6).alias("density"), scoring.tier_confidence(tier, size).cast("double").alias("confidence"), scoring.is_container(F.element_at(kinds, (size % 5 + 1).cast("int"))).alias("container"),
    )


# The literal words of a page, word after word: the state is what was found and the characters left.
_LITERAL_SQL = f"""WITH RECURSIVE p AS (SELECT page_id, html, regexp_extract_all(html, '>([^<>{{}}]{{3,300}})<', 1) AS visible FROM pages),
  q AS (SELECT page_id, html, visible, list_filter(regexp_split_to_array(array_to_string(list_concat(visible, quoted), ' '), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 3 AND lower(w) NOT IN ({_quote(words.NON_CONTENT_WORDS)})) AS ws
    FROM (SELECT *, list_transform(list_filter(regexp_extract_all(html, '(?s)((?:class|className|styles?|cn|clsx|tw)\\s*[=(:]\\s*)?("(?:[^"\\\\]|\\\\.)*"|''(?:[^''\\\\]|\\\\.)*''|`(?:[^`\\\\]|\\\\.)*`)'), lambda m: NOT regexp_matches(m, '^(class|className|style|styles|cn|clsx|tw)\\s*[=(:]')), lambda m: substr(m, 2, length(m) - 2)) AS quoted FROM p)),
  step(page_id, ws, n, found, left_) AS (SELECT page_id, list_transform(ws, lambda w: lower(w)), 1, []::VARCHAR[], 600 FROM q
    UNION ALL SELECT page_id, ws, n + 1, CASE WHEN list_contains(found, ws[n]) THEN found ELSE list_append(found, ws[n]) END, CASE WHEN list_contains(found, ws[n]) THEN left_ ELSE left_ - length(ws[n]) - 1 END FROM step WHERE n <= len(ws) AND left_ > 0)
  SELECT page_id, arg_max(CASE WHEN len(found) = 0 THEN NULL ELSE array_to_string(found, ' ') END, n) AS literals FROM step GROUP BY page_id"""


# --- scan ----------------------------------------------------------------------------------------------------------

_IGNORES = ("blog/", "*.html", "/news/**", "docs/?1*", "**/tmp/**")


@query("""SELECT page_id, path, starts_with(path, 'blog/') OR contains(path, '/blog/') OR ends_with(path, '.html') OR regexp_matches(path, '^news/.') OR regexp_matches(path, '^docs/[^/]1[^/]*(/|$)') OR regexp_matches(path, '(^|/)tmp/.') AS ignored
  FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*/?', '') AS path FROM pages)""")
def ignored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", "^[a-z]+://[^/]*/?", "")
    rules = [ignore.compile_line(x) for x in _IGNORES]
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"), ignore.ignored_file(path, rules).alias("ignored"))


@query("""SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'SKIPPED_SECRET' WHEN strlen(text) > 20000 THEN 'SKIPPED_TOO_LARGE' WHEN doc_id % 8 = 0 THEN 'SKIPPED_BINARY'
  WHEN regexp_matches(substr(text, 1, 16384), '-----BEGIN [A-Z ]*PRIVATE KEY-----\\s+[A-Za-z0-9+/=]{40,}|\\b(AKIA|ASIA)[0-9A-Z]{16}\\b|\\b(gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{40,})|\\bsk-(ant-|proj-)?[A-Za-z0-9_-]{24,}|\\bxox[abposr]-[A-Za-z0-9-]{10,}|"type"\\s*:\\s*"service_account"|\\b[a-z][a-z0-9+.-]*://[^\\s:/@]+:[^\\s:/@]+@[^\\s/]+') THEN 'SKIPPED_SECRET' ELSE 'OK' END AS state FROM documents""")
def file_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan's own states, for documents as files: a ninth under a secret path, an eighth with a null byte at the head."""
    d = table(spark, sf_dir, "documents")
    path = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("config/.env."), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit(".ts")))
    head = F.when(F.col("doc_id") % 8 == 0, F.lit("\x00")).otherwise(F.lit(""))
    state = F.coalesce(scan.path_state(path, F.octet_length("text"), [], max_bytes=20_000), scan.content_state(F.concat(head, "text").cast("binary")), F.lit("OK"))
    return d.select("doc_id", state.alias("state"))


@query(f"SELECT path FROM ({PATHS_SQL}) WHERE doc_id % 4 = 0 OR doc_id % 6 = 0")
def unread_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.paths(table(spark, sf_dir, "documents")).select("doc_id", "path", F.col("doc_id").cast("double").alias("mtime_ms"), F.octet_length("text").cast("long").alias("size_bytes"))
    old = d.filter("doc_id % 4 <> 0").withColumn("size_bytes", F.col("size_bytes") + F.when(F.col("doc_id") % 6 == 0, 1).otherwise(0))
    return changes.unread(d, old).select("path")


@query(f"SELECT CASE doc_id % 3 WHEN 0 THEN 'SKIPPED_BINARY' ELSE 'SKIPPED_SECRET' END AS reason, count(*) AS n FROM ({PATHS_SQL}) WHERE doc_id % 3 < 2 GROUP BY ALL")
def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    mark = F.when(i % 3 == 0, "skipped:SKIPPED_BINARY:9").when(i % 3 == 1, "skipped:SKIPPED_SECRET:7").otherwise("0123abc")
    return stats.skip_reasons(table(spark, sf_dir, "documents").select(mark.alias("content_hash")))


@query(f"SELECT resolution, count(*) AS n FROM (SELECT CASE WHEN confidence >= 0.9 THEN 'EXACT' WHEN confidence >= 0.7 THEN 'SCOPED' ELSE 'UNRESOLVED' END AS resolution FROM ({EDGES_SQL})) GROUP BY ALL")
def resolution_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("confidence")
    return stats.resolution_report(views.edges(spark, sf_dir).withColumn("resolution", F.when(c >= 0.9, "EXACT").when(c >= 0.7, "SCOPED").otherwise("UNRESOLVED")))


@query(f"SELECT path, content_hash FROM (SELECT path, sha256(replace(text, chr(13) || chr(10), chr(10))) AS content_hash FROM ({PATHS_SQL})) WHERE path NOT LIKE 'src1/%'")
def purged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    disk, _ = _disk_and_index(spark, sf_dir)
    return changes.purge(disk, disk.filter(F.col("path").startswith("src1/")).select("path"), "path")


@query("""SELECT source_id, type, target_hint, CAST(line AS INTEGER) AS line, file_path, min(target) AS target_id FROM (SELECT 'u' || user_id AS source_id, event_type AS type, 'h' || user_id % 7 AS target_hint, event_id % 3 AS line, 'f' AS file_path, CASE WHEN event_id % 2 = 0 THEN 't' || event_id % 5 END AS target FROM events) GROUP BY ALL""")
def relations_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, s = table(spark, sf_dir, "events"), lambda c: c.cast("string")
    rows = e.select(
        F.concat(F.lit("u"), s(F.col("user_id"))).alias("source_id"), F.col("event_type").alias("type"), F.concat(F.lit("h"), s(F.col("user_id") % 7)).alias("target_hint"), (F.col("event_id") % 3).cast("int").alias("line"),
        F.lit("f").alias("file_path"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("t"), s(F.col("event_id") % 5))).alias("target_id"), F.lit(None).cast("string").alias("metadata"),
    )
    return changes.dedup_relations(rows).drop("metadata")


# --- graph and impact ----------------------------------------------------------------------------------------------


@query(f"""WITH e AS (SELECT * FROM ({HIERARCHY_SQL})), one AS (SELECT source_id AS id, max(confidence) AS c FROM e WHERE target_id = 'N3' GROUP BY ALL), every_ AS (SELECT 'N3' AS entity_id, 0 AS hop_distance, 1.0::DOUBLE AS path_confidence UNION ALL SELECT id, 1, c FROM one)
  SELECT * FROM every_ ORDER BY hop_distance, path_confidence DESC, entity_id LIMIT 20""")
def neighbors_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbors(views.hierarchy(spark, sf_dir), spark.createDataFrame([("N3",)], "id string"), 2, "IN", limit=20)


@query(f"SELECT DISTINCT q.query_id, e.id FROM ({ENTITIES_SQL}) e JOIN (SELECT 1 AS query_id, (SELECT min(p_name) FROM part) AS target UNION ALL SELECT 2, (SELECT max(p_name) FROM part)) q ON e.name = q.target QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY NOT exported, id) > 1")
def impact_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    least, most = table(spark, sf_dir, "part").agg(F.min("p_name"), F.max("p_name")).first()
    return impact.alternatives(views.entities(spark, sf_dir), spark.createDataFrame([(1, least), (2, most)], "query_id int, target string"))


@query("SELECT q.query_id, e.id, e.exported FROM (" + ENTITIES_SQL + ") e JOIN (SELECT 1 AS query_id, (SELECT min(p_name) FROM part) AS target UNION ALL SELECT 2, 'P7') q ON e.name = q.target OR e.id = q.target QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY NOT exported, id) = 1")
def impact_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    least = table(spark, sf_dir, "part").agg(F.min("p_name")).first()[0]
    return impact.targets(views.entities(spark, sf_dir), spark.createDataFrame([(1, least), (2, "P7")], "query_id int, target string")).select("query_id", "id", "exported")


@query(_IMPACT_SQL + ", n AS (SELECT q.query_id, count(f.id) AS reach, count(CASE WHEN hop_distance = 1 THEN 1 END) AS direct FROM q LEFT JOIN full_ f USING (query_id) GROUP BY q.query_id) SELECT query_id, direct, reach - direct AS indirect FROM n")
def impact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, edges = _tree(spark, sf_dir)
    return impact.report(entities, edges, impact.targets(entities, _asked(spark))).select("query_id", "direct", "indirect")


@query(_CASES_SQL + " SELECT case_id, round(recall, 6) AS recall FROM z ORDER BY z.recall, case_id LIMIT 8")
def eval_worst_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.worst(_cases(spark, sf_dir)).select("case_id", F.round("recall", 6).alias("recall"))


# --- resolution ----------------------------------------------------------------------------------------------------

#: (importing file, specifier, the file it means or None), @ standing for a document's id.
_IMPORTS = (
    ("src@/a/one.ts", "./two", "src@/a/two.ts"), ("src@/a/one.ts", "./two.js", "src@/a/two.ts"), ("src@/a/one.ts", "../lib", "src@/lib/index.ts"), ("src@/a/one.ts", "../lib.js", "src@/lib/index.ts"),
    ("src@/a/one.ts", "./types", "src@/a/types.d.ts"), ("src@/a/one.ts", "./plain.mjs", "src@/a/plain.mjs"), ("src@/a/one.ts", "node:fs", None), ("src@/a/one.ts", "react", None), ("src@/a/one.ts", "../../../out", None),
    ("pkg@/m.py", ".sub", "pkg@/sub/__init__.py"), ("pkg@/sub/n.py", "..m", "pkg@/m.py"), ("pkg@/m.py", "pkg@.sub.n", "pkg@/sub/n.py"), ("pkg@/m.py", "os.path", None),
)
_IMPORT_FILES = ("src@/a/one.ts", "src@/a/two.ts", "src@/a/types.d.ts", "src@/a/plain.mjs", "src@/lib/index.ts", "pkg@/m.py", "pkg@/sub/__init__.py", "pkg@/sub/n.py")


@query("SELECT replace(f, '@', doc_id::VARCHAR) AS file_path, replace(h, '@', doc_id::VARCHAR) AS target_hint, replace(p, '@', doc_id::VARCHAR) AS path FROM documents, (VALUES " + ", ".join(f"('{f}', '{h}', '{p}')" for f, h, p in _IMPORTS if p) + ") v(f, h, p)")
def import_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document every kind of specifier: without an ending, with the output's, a folder's index, declarations, relative and dotted modules; externals resolve to nothing."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("_i"))
    own = lambda c: F.replace(F.col(c), F.lit("@"), F.col("_i"))
    files = docs.select("_i", F.explode(F.array(*(F.lit(x) for x in _IMPORT_FILES))).alias("_f")).select(own("_f").alias("path"))
    asked = docs.select("_i", F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.lit(h).alias("h")) for f, h, _ in _IMPORTS))).alias("_")).select("_i", "_.f", "_.h")
    imports = asked.select(own("f").alias("source_id"), F.lit("IMPORTS").alias("type"), own("h").alias("target_hint"), F.lit(1).alias("line"), own("f").alias("file_path"))
    return resolve.resolve_imports(imports, files).select("file_path", "target_hint", "path")


_RULES_SQL = """SELECT 'O' || p_partkey AS source_id, 'E' || p_partkey || CASE rule WHEN 0 THEN '/bound' WHEN 1 THEN '/Own.run' WHEN 2 THEN '/Made.run' WHEN 3 THEN '/far' WHEN 4 THEN '/near' WHEN 5 THEN '/only' WHEN 6 THEN '/near' ELSE '/a' END AS new_target,
  CASE WHEN rule <= 2 THEN 'EXACT' WHEN rule <= 5 THEN 'SCOPED' ELSE 'AMBIGUOUS' END AS new_resolution, CASE WHEN rule <= 2 THEN 1.0 WHEN rule <= 5 THEN 0.75 ELSE 0.5 END::DOUBLE AS new_confidence FROM (SELECT p_partkey, p_partkey % 8 AS rule FROM part)"""


@query(_RULES_SQL)
def resolve_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge per part, dealt to the eight rules by its key: bound name, this, new, bound receiver, one in the file, one anywhere, member guess, homonyms."""
    p, s = table(spark, sf_dir, "part"), lambda x: F.concat(F.lit(x), F.col("p_partkey").cast("string"))
    rule = F.col("p_partkey") % 8
    hint = F.concat(F.lit("run"), F.col("p_partkey").cast("string"))
    pick = lambda *xs: F.element_at(F.array(*(F.lit(x) for x in xs)), (rule + 1).cast("int"))
    prefix = pick(None, "this.", "new Made().", "lib.", None, None, "x.", None)
    expression = F.when(prefix.isNotNull(), F.concat(prefix, hint))
    edges = p.select(s("O").alias("source_id"), F.lit(None).cast("string").alias("target_id"), hint.alias("target_hint"), F.lit("CALLS").alias("type"), s("f").alias("file_path"), F.lit(1).alias("line"), F.when(expression.isNotNull(), F.to_json(F.struct(expression.alias("expression")))).alias("metadata"))

    def entity(tag: str, rules: tuple, file: str, qualified: F.Column, exported: bool = False, name: F.Column = hint) -> DataFrame:
        return p.filter(rule.isin(*rules)).select(F.concat(s("E"), F.lit(tag)).alias("id"), name.alias("name"), qualified.alias("qualified_name"), s(file).alias("file_path"), F.lit(exported).alias("exported"))

    dotted = lambda c: F.concat(F.lit(c + "."), hint)
    source = p.select(s("O").alias("id"), F.lit("go").alias("name"), F.when(rule == 1, "Own.go").otherwise("go").alias("qualified_name"), s("f").alias("file_path"), F.lit(True).alias("exported"))
    every = [
        source, entity("/bound", (0,), "b", hint), entity("/else", (0, 3), "c", hint, True), entity("/Own.run", (1,), "f", dotted("Own")), entity("/Other.run", (1,), "f", dotted("Other"), True), entity("/Made.run", (2,), "m", dotted("Made")),
        entity("/Other.run", (2,), "m", dotted("Other"), True), entity("/far", (3,), "b", hint), entity("/near", (4, 6), "f", hint), entity("/out", (4, 6), "c", hint, True), entity("/only", (5,), "c", hint), entity("/b", (7,), "c", hint), entity("/a", (7,), "d", hint, True),
    ]
    entities = every[0]
    for e in every[1:]:
        entities = entities.unionByName(e)
    bound = p.select(s("f").alias("file_path"), F.when(rule == 0, hint).otherwise(F.lit("lib")).alias("local_name"), s("b").alias("bound_path"))
    return resolve.resolve_symbols(edges, entities, bound).select("source_id", "new_target", "new_resolution", F.col("new_confidence").cast("double").alias("new_confidence"))


@query("SELECT 'O' || p_partkey AS source_id, CASE WHEN p_size % 2 = 0 THEN 'old' WHEN p_size % 3 = 0 THEN 'new' END AS target_id, CASE WHEN p_size % 2 = 0 THEN 'EXACT' WHEN p_size % 3 = 0 THEN 'SCOPED' ELSE 'UNRESOLVED' END AS resolution FROM part")
def updates_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    key = [F.concat(F.lit("O"), F.col("p_partkey").cast("string")).alias("source_id"), F.lit("CALLS").alias("type"), F.lit("h").alias("target_hint"), F.lit(1).alias("line"), F.lit("f").alias("file_path")]
    even = F.col("p_size") % 2 == 0
    relations = p.select(*key, F.when(even, "old").alias("target_id"), F.when(even, "EXACT").otherwise("UNRESOLVED").alias("resolution"), F.when(even, 1.0).otherwise(0.0).alias("confidence"))
    updates = p.filter("p_size % 3 = 0").select(*key, F.lit("new").alias("new_target"), F.lit("SCOPED").alias("new_resolution"), F.lit(0.75).alias("new_confidence"))
    return resolve.apply_updates(relations, updates).select("source_id", "target_id", "resolution")


# --- extraction ----------------------------------------------------------------------------------------------------

_PYTHON_SQL = f"""SELECT path || '#' || kind || ':' || replace(q, '@', CASE kind WHEN 'FILE' THEN path ELSE doc_id::VARCHAR END) AS id, kind AS type, replace(q, '@', CASE kind WHEN 'FILE' THEN path ELSE doc_id::VARCHAR END) AS qualified_name, exported, first_line AS start_line
  FROM ({PATHS_SQL}), (VALUES ('FILE', '@', true, 1), ('CLASS', 'C@', true, 2), ('METHOD', 'C@.run', true, 3), ('METHOD', 'C@._hidden', false, 5), ('FUNCTION', 'f@', true, 7), ('FUNCTION', '_g@', false, 9)) v(kind, q, exported, first_line)"""


@query(_PYTHON_SQL)
def extracted_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python module per document: a class with a public and a private method, a public and a private function."""
    from corvane.extract import registry

    i, said = F.col("doc_id").cast("string"), F.to_json(F.struct("text"))
    code = F.concat(
        F.lit("import os\nclass C"), i, F.lit("(Base):\n    def run(self):\n        return self._hidden()\n    def _hidden(self):\n        return "), said, F.lit("\ndef f"), i, F.lit("(x: int) -> int:\n    return _g"), i, F.lit("(x)\ndef _g"), i, F.lit("(x):\n    return x\n")
    )
    rows = views.paths(table(spark, sf_dir, "documents")).select("path", F.lit("python").alias("language"), code.alias("content"))
    columns = ("id", "type", "qualified_name", "exported", "start_line")
    return registry.entities(registry.extracted(rows, columns=columns), columns).select(*columns)


_SCRIPT_SQL = f"""SELECT kind AS type, replace(q, '@', CASE kind WHEN 'FILE' THEN path ELSE doc_id::VARCHAR END) AS qualified_name, exported, first_line AS start_line, path AS file_path
  FROM ({PATHS_SQL}), (VALUES ('FILE', '@', true, 1), ('CLASS', 'C@', true, 2), ('METHOD', 'C@.run', true, 3), ('FUNCTION', 'f@', true, 5), ('INTERFACE', 'I@', false, 6), ('TYPE', 'T@', true, 7), ('CONSTANT', 'K@', true, 8), ('VARIABLE', 'v@', false, 9), ('FUNCTION', 'g@', false, 10)) v(kind, q, exported, first_line)"""


def _script(i: F.Column) -> F.Column:
    parts = ["import { save } from './other.js';\nexport class C", " {\n  run(x: string) { return this.repo.save(x); }\n}\nexport function f", "(a: number): number { return save(a); }\ninterface I", " { a: string }\nexport type T", " = string | number;\nexport const K", " = 1;\nlet v", " = 'x';\nconst g", " = (a: number) => save(a);\n"]
    return F.concat(*(x for p in parts[:-1] for x in (F.lit(p), i)), F.lit(parts[-1]))


@query(_SCRIPT_SQL)
def extracted_typescript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A TypeScript file per document, with every kind of entity."""
    from corvane.extract import registry

    rows = views.paths(table(spark, sf_dir, "documents")).select("path", F.lit("typescript").alias("language"), _script(F.col("doc_id").cast("string")).alias("content"))
    return registry.entities(registry.extracted(rows)).select("type", "qualified_name", "exported", "start_line", "file_path")


@query(f"""SELECT path AS file_path, type, hint AS target_hint, line FROM ({PATHS_SQL}), (VALUES ('IMPORTS', './other.js', 1), ('CALLS', 'save', 3), ('CALLS', 'save', 5), ('CALLS', 'save', 10)) v(type, hint, line)""")
def extracted_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.extract import registry

    rows = views.paths(table(spark, sf_dir, "documents")).select("path", F.lit("typescript").alias("language"), _script(F.col("doc_id").cast("string")).alias("content"))
    return registry.relations(registry.extracted(rows)).filter("type in ('IMPORTS', 'CALLS')").select("file_path", "type", "target_hint", "line")


# --- ranking and selection -----------------------------------------------------------------------------------------

_NAME = "regexp_split_to_array(text, '[^A-Za-z]+')[1]"
_ENTITY_SQL = f"""SELECT 'D' || doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'FUNCTION' WHEN 1 THEN 'CLASS' ELSE 'FILE' END AS type, {_NAME} AS name, concat_ws('.', source, {_NAME}) AS qualified_name, path AS file_path, CAST(floor(length(text) / 4) AS INTEGER) AS token_estimate,
  regexp_split_to_array(coalesce(text, ''), chr(10))[1] AS signature, text, doc_id FROM ({PATHS_SQL})"""
_RANK_SQL = (
    _bm25_sql(_TWO, True).replace(_DOCS_SQL, f"SELECT 'D' || doc_id AS id, coalesce({_NAME}, '') AS terms, coalesce(text, '') AS literals FROM documents").replace("scores AS (SELECT query_id, id, sum(s) AS score", "scores AS (SELECT query_id, id, round(sum(s), 9) AS score")
    + f""", ent AS ({_ENTITY_SQL}), task AS (SELECT item_id AS query_id, text AS task, {_KIND_SQL} AS kind,
    list_distinct(list_filter(regexp_split_to_array(text, '[^\\w$.]+'), lambda w: length(w) >= 3 AND regexp_matches(w, '[a-z][A-Z]|_|^[A-Z][a-z]{{2,}}$') AND lower(w) NOT IN ({_quote(words.INTENT_WORDS)}))) AS symbols FROM benchmark),
  sym AS (SELECT query_id, unnest(symbols) AS symbol FROM task),
  seed AS (SELECT query_id, id, 1 AS o, 'symbol ' || symbol AS reason FROM sym JOIN ent ON name = symbol OR qualified_name = symbol
    UNION SELECT query_id, id, 4, 'text' FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM scores) WHERE n <= 40),
  start AS (SELECT query_id, id, array_to_string(list_transform(list_sort(list(DISTINCT {{'o': o, 'reason': reason}})), lambda x: x.reason), '; ') AS reasons FROM seed GROUP BY ALL),
  calls AS (SELECT 'D' || doc_id AS a, 'D' || (doc_id * 7 + 3) % 500 AS b FROM documents), way AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM calls UNION ALL SELECT b, a FROM calls)),
  h1 AS (SELECT DISTINCT query_id, b AS id FROM start JOIN way ON a = start.id), h2 AS (SELECT DISTINCT query_id, b AS id FROM h1 JOIN way ON a = h1.id),
  near AS (SELECT query_id, id, min(hop) AS hop, max(c) AS c FROM (SELECT query_id, id, 0 AS hop, 1.0 AS c FROM start UNION ALL SELECT query_id, id, 1, 0.75 FROM h1 UNION ALL SELECT query_id, id, 2, 0.5625 FROM h2) GROUP BY ALL),
  cand AS (SELECT query_id, id, hop FROM near QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hop, c DESC, id) <= 3000 OR hop = 0),
  lex AS (SELECT query_id, id, least(1.0, score / best) AS lexical FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n, max(score) OVER (PARTITION BY query_id) AS best FROM scores) WHERE n <= 500 AND best > 0),
  deg AS (SELECT b AS id, count(*) AS degree FROM calls GROUP BY b), partner AS (SELECT query_id, b AS id FROM start JOIN calls ON a = start.id UNION SELECT query_id, a FROM start JOIN calls ON b = start.id),
  newest AS (SELECT max(doc_id % 100 * 86400) AS newest FROM documents),
  sig AS (SELECT c.query_id, c.id, c.hop, e.type, e.file_path, e.qualified_name, e.signature, e.token_estimate, e.text, coalesce(s.reasons, '') AS reasons, coalesce(l.lexical, 0) AS lexical, p.id IS NOT NULL AS is_partner,
    CASE WHEN len(list_filter(t.symbols, lambda s: lower(s) = lower(e.name) OR lower(s) = lower(e.qualified_name))) > 0 THEN 1.0 WHEN len(list_filter(t.symbols, lambda s: contains(lower(e.qualified_name), lower(s)) OR contains(lower(s), lower(e.name)))) > 0 THEN 0.5 ELSE 0.0 END AS symbol_match,
    coalesce(d.degree, 0) / greatest(1, max(coalesce(d.degree, 0)) OVER (PARTITION BY c.query_id)) AS importance, (SELECT any_value(a) FROM (SELECT t.kind AS kind, e.type AS type) z, LATERAL (SELECT {_AFFINITY_SQL.replace('kind =', 'z.kind =').replace('type =', 'z.type =')} AS a)) AS affinity,
    pow(2.0, -greatest(0, (newest - e.doc_id % 100 * 86400) / 86400.0) / 30) AS recent
    FROM cand c JOIN ent e ON e.id = c.id JOIN task t ON t.query_id = c.query_id LEFT JOIN start s ON s.query_id = c.query_id AND s.id = c.id LEFT JOIN lex l ON l.query_id = c.query_id AND l.id = c.id LEFT JOIN partner p ON p.query_id = c.query_id AND p.id = c.id LEFT JOIN deg d ON d.id = c.id, newest),
  ranked AS (SELECT *, round(100 * (0.25 * lexical + 0.20 * symbol_match + 0.20 / (1 + hop) + 0.10 * is_partner::INT + 0.05 * importance + 0.08 * affinity + 0.05 * recent), 9) AS score FROM sig)"""
)
#: Candidates in the order of choice; each takes the richest level that fits what is left, unless it would open a 13th file.
_GREEDY_SQL = (
    _RANK_SQL.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", floor_ AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM ranked) WHERE score >= greatest(0.25 * best, 12.0)),
  cost AS (SELECT id, {_TOKENS.format('reference')} AS n_reference, {_TOKENS.format("(reference || chr(10) || '  ' || signature || chr(10) || '  CALLS: x')")} AS n_signature, CASE WHEN trim(text, ' ') <> '' THEN {_TOKENS.format("('// ' || file_path || ':1 — ' || type || ' ' || qualified_name || chr(10) || text)")} END AS n_full
    FROM (SELECT DISTINCT id, type || ' ' || qualified_name || '  (' || file_path || ':1)' AS reference, signature, text, file_path, type, qualified_name FROM floor_)),
  line AS (SELECT query_id, f.id, file_path, score, score >= 55 OR hop = 0 AS rich, n_full, n_signature, n_reference, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, score / greatest(1, token_estimate) DESC, f.id) AS n FROM floor_ f JOIN cost USING (id)),
  pick(query_id, n, left_, files, id, file_path, score, detail, tokens, reason) AS (
    SELECT item_id, 0::BIGINT, 19000, []::VARCHAR[], NULL::VARCHAR, NULL::VARCHAR, NULL::DOUBLE, NULL::VARCHAR, 0, NULL::VARCHAR FROM benchmark
    UNION ALL SELECT query_id, n, left_ - CASE WHEN detail IS NULL THEN 0 ELSE cost END, CASE WHEN detail IS NULL OR list_contains(files, file_path) THEN files ELSE list_append(files, file_path) END, id, file_path, score, detail, CASE WHEN detail IS NULL THEN 0 ELSE cost END, CASE WHEN detail IS NULL THEN CASE WHEN capped THEN 'files' ELSE 'budget' END END
    FROM (SELECT *, CASE detail WHEN 'FULL' THEN n_full WHEN 'SIGNATURE' THEN n_signature ELSE n_reference END AS cost FROM (SELECT l.*, p.left_, p.files, len(p.files) >= 12 AND NOT list_contains(p.files, l.file_path) AS capped,
      CASE WHEN (len(p.files) >= 12 AND NOT list_contains(p.files, l.file_path)) OR p.left_ <= 12 THEN NULL WHEN l.rich AND l.n_full <= p.left_ THEN 'FULL' WHEN l.n_signature <= p.left_ THEN 'SIGNATURE' WHEN l.n_reference <= p.left_ THEN 'REFERENCE' END AS detail
      FROM pick p JOIN line l ON l.query_id = p.query_id AND l.n = p.n + 1)))
  SELECT query_id, id, file_path, round(score, 6) AS score, detail, CAST(tokens AS INTEGER) AS tokens, reason FROM pick WHERE n > 0"""
)
_RANKED_SQL = _RANK_SQL + """ SELECT query_id, id, hop AS hop_distance, round(score, 6) AS score, array_to_string(list_filter([reasons, CASE WHEN lexical > 0 THEN 'text match' END, CASE WHEN is_partner THEN 'calls or is called by a seed' END, CASE WHEN recent > 0.5 THEN 'changed lately' END], lambda x: x <> ''), '; ') AS reasons FROM ranked"""

SQL |= {"rank_candidates": _RANKED_SQL, "context_greedy": _GREEDY_SQL, "literal_terms": _LITERAL_SQL}


@query(_RANK_SQL + " SELECT query_id, id, round(lexical, 6) AS lexical, symbol_match::DOUBLE AS symbol_match, round(1.0 / (1 + hop), 6)::DOUBLE AS graph_proximity, is_partner::INT::DOUBLE AS call_relationship, round(importance, 6) AS file_importance, affinity::DOUBLE AS task_type, round(recent, 6) AS recent_changes FROM ranked")
def rank_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("lexical", "symbol_match", "graph_proximity", "call_relationship", "file_importance", "task_type", "recent_changes")
    return _ranked(spark, sf_dir, _code_index(spark, sf_dir)).select("query_id", "id", *(F.round(F.col(f"s_{n}").cast("double"), 6).alias(n) for n in names))


@query(_GREEDY_SQL.replace("SELECT query_id, id, file_path, round(score, 6) AS score, detail, CAST(tokens AS INTEGER) AS tokens, reason FROM pick WHERE n > 0", "SELECT query_id, count(*) AS considered, count(detail) AS selected, count(DISTINCT CASE WHEN detail IS NOT NULL THEN file_path END) AS files, CAST(sum(tokens) AS BIGINT) AS spent FROM pick WHERE n > 0 GROUP BY query_id"))
def context_spent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.plans.catalogue import context_greedy

    budgets = select.budgets(views.tasks(spark, sf_dir), 20_000)
    out = select.metrics(context_greedy(spark, sf_dir), budgets, spark.createDataFrame([(1,)], "total_tokens long"))
    return out.select("query_id", "considered", "selected", "files", F.col("spent").cast("long").alias("spent"))


# --- more of extraction --------------------------------------------------------------------------------------------

_TSX = ["/** Shows ", ". */\nexport function Card", "(props: Props) {\n  return <div className=\"box\">{format(props.x)}</div>;\n}\nexport const Row", " = (p) => <Card", " x={p.x} />;\n"]
_JS = ["const { load", ", keep } = require('./lib", "');\nclass Box", " extends Base", " {\n  open() { return load", "(1); }\n}\nmodule.exports = { Box", " };\n"]
_BROKEN = ["export function ok", "() { return 1; }\nfunction bad", "( {{{ return\n"]


def _with_id(parts: list[str]) -> F.Column:
    i = F.col("doc_id").cast("string")
    return F.concat(*(x for p in parts[:-1] for x in (F.lit(p), i)), F.lit(parts[-1]))


def _odd_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A component file, a CommonJS file and a broken file per document."""
    from corvane.extract import registry

    docs, rows = table(spark, sf_dir, "documents").select("doc_id"), None
    for ending, language, parts in (("tsx", "tsx", _TSX), ("cjs", "javascript", _JS), ("bad.ts", "typescript", _BROKEN)):
        own = docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("." + ending)).alias("path"), F.lit(language).alias("language"), _with_id(parts).alias("content"))
        rows = own if rows is None else rows.unionByName(own)
    return registry.extracted(rows)


@query("""SELECT 'd' || doc_id || e AS file_path, kind AS type, replace(q, '@', doc_id::VARCHAR) AS qualified_name, exported, replace(doc, '@', doc_id::VARCHAR) AS documentation FROM documents,
  (VALUES ('.tsx', 'COMPONENT', 'Card@', true, 'Shows @.'), ('.tsx', 'COMPONENT', 'Row@', true, NULL), ('.cjs', 'CLASS', 'Box@', false, NULL), ('.cjs', 'METHOD', 'Box@.open', false, NULL), ('.bad.ts', 'FUNCTION', 'ok@', true, NULL)) v(e, kind, q, exported, doc)""")
def extracted_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a component file, a CommonJS file and a broken file say, with documentation; of the broken one what stands before the fault."""
    from corvane.extract import registry

    got = registry.entities(_odd_sources(spark, sf_dir)).filter("type <> 'FILE' and qualified_name not like 'bad%'")
    return got.select("file_path", "type", "qualified_name", "exported", "documentation")


@query("""SELECT 'd' || doc_id || e AS path, state AS parse_state FROM documents, (VALUES ('.tsx', 'OK'), ('.cjs', 'OK'), ('.bad.ts', 'PARSE_ERROR')) v(e, state)""")
def extracted_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _odd_sources(spark, sf_dir).select("path", "parse_state")


@query("""SELECT 'd' || doc_id || '.cjs' AS file_path, kind AS type, replace(hint, '@', doc_id::VARCHAR) AS target_hint, line FROM documents,
  (VALUES ('IMPORTS', './lib@', 1), ('EXTENDS', 'Base@', 2), ('CALLS', 'load@', 3)) v(kind, hint, line)""")
def extracted_commonjs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.extract import registry

    return registry.relations(_odd_sources(spark, sf_dir)).filter("file_path like '%.cjs' and type in ('IMPORTS', 'EXTENDS', 'CALLS') and target_hint <> 'require'").select("file_path", "type", "target_hint", "line")


@query("""SELECT path, qualified_name, signature FROM (SELECT 'd' || doc_id || '.tsx' AS path, 'Card' || doc_id AS qualified_name, 'export function Card' || doc_id || '(props: Props)' AS signature FROM documents)""")
def extracted_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.extract import registry

    return registry.entities(_odd_sources(spark, sf_dir)).filter("name like 'Card%'").select(F.col("file_path").alias("path"), "qualified_name", "signature")


# --- seeds of every kind -------------------------------------------------------------------------------------------

@query("""SELECT query_id, id, reasons FROM (
  SELECT doc_id AS query_id, 'e:report' || doc_id || '/page.ts' AS id, 'path report' || doc_id || '/page.ts' AS reasons FROM documents
  UNION ALL SELECT doc_id, 'e:extra' || doc_id || '.py', 'path extra' || doc_id || '.py' FROM documents)""")
def rank_cited_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds of tasks that cite a path and are given another: a task and two files per document."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("_i"))
    tasks = d.select(F.col("doc_id").alias("query_id"), F.concat(F.lit("see report"), "_i", F.lit("/page.ts")).alias("task"), F.array(F.concat(F.lit("extra"), "_i", F.lit(".py"))).alias("includes"))
    files = d.select(F.explode(F.array(F.concat(F.lit("report"), "_i", F.lit("/page.ts")), F.concat(F.lit("extra"), "_i", F.lit(".py")))).alias("path"))
    asked = rank.analysed(tasks).withColumn("terms", F.array().cast("array<string>"))
    entities = files.select(F.concat(F.lit("e:"), "path").alias("id"), F.col("path").alias("name"), F.col("path").alias("qualified_name"), F.col("path").alias("file_path"))
    none = spark.createDataFrame([], "query_id long, id string, score double")
    out = rank.seeds(asked, entities, files, none, spark.createDataFrame([], "path string, ts long"))
    return out.select("query_id", "id", F.array_join("reasons", "; ").alias("reasons"))


@query("""WITH u AS (SELECT user_id, max(epoch_us(ts)) AS ts FROM events GROUP BY user_id), last AS (SELECT user_id FROM u ORDER BY ts DESC, 'u' || user_id LIMIT 8)
  SELECT item_id AS query_id, 'e' || user_id AS id, 'recent' AS reasons FROM benchmark, last""")
def rank_recent_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks that nothing else answers start from the eight files that changed last."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("_u"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))
    files = e.select(F.concat(F.lit("u"), "_u").alias("path"), "_u").distinct()
    entities = files.select(F.concat(F.lit("e"), "_u").alias("id"), F.lit("?").alias("name"), F.lit("?").alias("qualified_name"), F.col("path").alias("file_path"))
    asked = rank.analysed(views.tasks(spark, sf_dir)).withColumns({"symbols": F.array().cast("array<string>"), "paths": F.array().cast("array<string>"), "terms": F.array().cast("array<string>")})
    none = spark.createDataFrame([], "query_id long, id string, score double")
    out = rank.seeds(asked, entities, files.select("path"), none, e.select(F.concat(F.lit("u"), "_u").alias("path"), "ts"))
    return out.select("query_id", "id", F.array_join("reasons", "; ").alias("reasons"))
