"""Every operator as a query over the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import ids, scoring, text, words
from corvane.operators import changes, evaluate, graph, impact, rank, resolve, search, select, stats
from corvane.plans import views
from corvane.session import kept
from corvane.plans.views import EDGES_SQL, ENTITIES_SQL, HIERARCHY_SQL, PATHS_SQL, table
from corvane.sources import ignore, secrets

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _quote(values: tuple[str, ...] | list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# --- files and scalars ---------------------------------------------------------------------------------------------

_LANG_SQL = "CASE " + " ".join(f"WHEN lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1)) = '{k}' THEN '{v}'" for k, v in words.LANGUAGES.items()) + " ELSE 'unknown' END"


@query(f"SELECT path, {_LANG_SQL} AS language, strlen(text) AS size_bytes, CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS line_count, sha256(replace(text, chr(13) || chr(10), chr(10))) AS content_hash FROM ({PATHS_SQL})")
def file_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.files(spark, sf_dir)


@query(f"SELECT page_id, {_LANG_SQL} AS language FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*/?', '') AS path FROM pages)")
def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", ids.language(F.regexp_replace("url", "^[a-z]+://[^/]*/?", "")).alias("language"))


@query(f"SELECT path, line_count, left(h, 12) AS short_hash FROM (SELECT path, CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS line_count, sha256(replace(text, chr(13) || chr(10), chr(10))) AS h FROM ({PATHS_SQL}))")
def line_count_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.paths(table(spark, sf_dir, "documents"))
    return docs.select("path", text.line_count(F.col("text")).alias("line_count"), ids.short_hash(F.col("text")).alias("short_hash"))


@query(f"""SELECT path, state, CASE WHEN state = 'OK' THEN NULL ELSE 'skipped:' || state || ':' || size END AS pseudo_hash FROM (
  SELECT path, strlen(text) AS size, CASE WHEN strlen(text) > 8000 THEN 'SKIPPED_TOO_LARGE' WHEN contains(text, chr(0)) THEN 'SKIPPED_BINARY'
    WHEN regexp_matches(substr(text, 1, 16384), 'password=') THEN 'SKIPPED_SECRET' ELSE 'OK' END AS state FROM ({PATHS_SQL}))""")
def skip_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.paths(table(spark, sf_dir, "documents"))
    size = F.octet_length("text")
    found = secrets.content_reason(F.col("text"), (("password", "password="),))
    state = F.when(size > 8000, "SKIPPED_TOO_LARGE").when(F.position(F.lit("\x00"), F.col("text")) > 0, "SKIPPED_BINARY").when(found.isNotNull(), "SKIPPED_SECRET").otherwise("OK")
    return docs.select("path", state.alias("state"), F.when(state != "OK", F.concat(F.lit("skipped:"), state, F.lit(":"), size.cast("string"))).alias("pseudo_hash"))


_TEST_SECRETS = (("cloud access key", "AKIA[0-9A-Z]{16}"), ("hex token", 'token = "[0-9a-f]{40}"'), ("password", "password=[0-9a-f]{18}"))


@query(
    "SELECT doc_id, reason FROM (SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(substr(text, 1, 16384), '{p}') THEN '{r}'" for r, p in _TEST_SECRETS) + " END AS reason FROM documents) WHERE reason IS NOT NULL"
)
def secret_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", secrets.content_reason(F.col("text"), _TEST_SECRETS).alias("reason")).filter("reason is not null")


_IGNORES = ["blog/", "*.html", "!index*", "/news/**", "docs/?1*", "**/tmp/**"]
_RULES = [ignore.compile_line(x) for x in _IGNORES]


@query(
    "SELECT page_id, path, " + "".join(f"CASE WHEN regexp_matches(path, '{r.regex}') THEN {str(not r.negated).lower()} ELSE " for r in reversed(_RULES) if not r.directory_only) + "false" + " END" * sum(not r.directory_only for r in _RULES)
    + " AS ignored FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*/?', '') AS path FROM pages)"
)
def ignore_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", "^[a-z]+://[^/]*/?", "")
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"), ignore.ignored(path, _RULES).alias("ignored"))


_SPACED = r"regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')"
_SPLIT = "list_filter(regexp_split_to_array(" + _SPACED + ", '[^A-Za-z0-9]+'), lambda p: p <> '')"
_UNITS = r"regexp_extract_all(coalesce({0}, ''), '[A-Za-z_$][A-Za-z0-9_$]*|\d[\d._]*|\s+|[^\sA-Za-z0-9_$]')"
_COST = (
    r"CASE WHEN regexp_matches(u, '^[A-Za-z_$]') THEN greatest(1, coalesce(list_sum(list_transform(list_filter(regexp_split_to_array(" + _SPACED.format("u") + r", '[\s_$]+'), lambda p: p <> ''), lambda p: CASE WHEN length(p) <= 7 THEN 1 ELSE CAST(ceil(length(p) / 6) AS INTEGER) END)), 0))"
    r" WHEN regexp_matches(u, '^[0-9]') THEN greatest(1, CAST(ceil(length(u) / 3) AS INTEGER)) WHEN regexp_matches(u, '^\s') THEN CASE WHEN contains(u, chr(10)) THEN length(u) - length(replace(u, chr(10), '')) WHEN length(u) > 4 THEN 1 ELSE 0 END ELSE 1 END"
)
_TOKENS = "CAST(coalesce(list_sum(list_transform(" + _UNITS + ", lambda u: " + _COST + ")), 0) AS INTEGER)"


@query("SELECT doc_id, " + _TOKENS.format("text") + " AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


_NAME_SQL = "replace(p_brand, '#', '') || 'HTTP' || replace(p_type, ' ', '_') || '-' || p_name"


def _part_name() -> F.Column:
    return F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("HTTP"), F.replace("p_type", F.lit(" "), F.lit("_")), F.lit("-"), F.col("p_name"))


@query("SELECT p_partkey, array_to_string(" + _SPLIT.format(_NAME_SQL) + ", ' ') AS parts FROM part")
def identifier_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.split_identifier(_part_name()), " ").alias("parts"))


_DISTINCT = "list_transform(list_filter(list_zip({0}, range(1, len({0}) + 1)), lambda z: list_position({0}, z[1]) = z[2]), lambda z: z[1])"


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(list_append(list_transform(" + _SPLIT.format(_NAME_SQL) + ", lambda p: lower(p)), lower(" + _NAME_SQL + ")))), ' ') AS terms FROM part")
def identifier_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(text.identifier_terms(_part_name())), " ").alias("terms"))


@query("""SELECT item_id, array_to_string(list_sort(list_distinct(flatten(list_transform(list_filter(list_transform(regexp_split_to_array(strip_accents(text), '[^A-Za-z0-9_]+'), lambda w: lower(w)), lambda w: length(w) >= 6),
  lambda w: CASE WHEN length(w) >= 8 THEN [w, substr(w, 1, 6)] ELSE [w] END)))), ' ') AS forms FROM benchmark""")
def path_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = table(spark, sf_dir, "benchmark").withColumn("f", text.strip_accents("text"))
    return folded.select("item_id", F.array_join(F.array_sort(text.path_terms(F.split("f", "[^A-Za-z0-9_]+"))), " ").alias("forms"))


@query("SELECT doc_id, md5(strip_accents(text)) AS folded FROM documents")
def strip_diacritics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.strip_accents("text").alias("f")).select("doc_id", F.md5(F.col("f").cast("binary")).alias("folded"))


@query("SELECT page_id, array_to_string(regexp_extract_all(html, '>([^<>{}]{3,300})<', 1), '|') AS visible FROM pages")
def literal_terms_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.regexp_extract_all("html", F.lit(">([^<>{}]{3,300})<")), "|").alias("visible"))


@query()
def literal_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.literal_terms("html").alias("literals"))


_KIND_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{h}')" for h in hints) + f" THEN '{k}'" for k, hints in words.KIND_HINTS) + " ELSE 'UNKNOWN' END"


@query(f"SELECT conv_id, turn, {_KIND_SQL} AS kind FROM conversations")
def task_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.classify_task(F.col("text")).alias("kind"))


@query(f"""SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(text, '[^\\w$.]+'), lambda w: length(w) >= 3 AND regexp_matches(w, '[a-z][A-Z]|_|^[A-Z][a-z]{{2,}}$') AND lower(w) NOT IN ({_quote(words.INTENT_WORDS)})))), ' ') AS symbols FROM conversations""")
def task_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(text.task_symbols(F.col("text"))), " ").alias("symbols"))


@query("SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(url, '[\\w./-]+\\.(?:ts|tsx|js|jsx|mjs|cjs|py|sql|css|html)\\b'))), ' ') AS paths FROM pages")
def task_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.array_sort(text.task_paths(F.col("url"))), " ").alias("paths"))


_LEXICON = [("the", "this"), ("with", "and"), ("for", "from"), ("of", "on")]


@query(f"""WITH t AS (SELECT DISTINCT item_id AS query_id, lower(unnest(regexp_split_to_array(text, '[^A-Za-z]+'))) AS term FROM benchmark),
  l(a, b) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _LEXICON)}), s AS (SELECT a, b FROM l UNION SELECT b, a FROM l)
  SELECT query_id, term FROM t WHERE term <> '' UNION SELECT query_id, b FROM t JOIN s ON term = a""")
def lexicon_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.split(F.lower("text"), "[^A-Za-z]+")).alias("term")).filter("term <> ''").distinct()
    return search.expand_terms(terms, spark.createDataFrame(_LEXICON, "term string, synonym string"))


# --- text search ---------------------------------------------------------------------------------------------------

_DOCS_SQL = "SELECT doc_id AS id, coalesce(source, '') AS terms, coalesce(text, '') AS literals FROM documents"
_TOK = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def _posting_sql(columns: dict[str, float]) -> str:
    every = " UNION ALL ".join(f"SELECT id, unnest({_TOK.format(c)}) AS term, {w}::DOUBLE AS w FROM docs" for c, w in columns.items())
    return f"docs AS ({_DOCS_SQL}), every_ AS ({every}), post AS (SELECT term, id, sum(w) AS f FROM every_ GROUP BY term, id), lens AS (SELECT id, {' + '.join(f'len({_TOK.format(c)})' for c in columns)} AS length FROM docs), corpus AS (SELECT count(*) AS n_docs, avg(length) AS mean FROM lens)"


_CLAUSES_SQL = f"""words AS (SELECT item_id AS query_id, unnest(list_filter(regexp_split_to_array(strip_accents(text), '[^A-Za-z0-9_$]+'), lambda w: length(w) >= 2)) AS w FROM benchmark),
  terms_ AS (SELECT DISTINCT query_id, unnest(list_append(list_transform({_SPLIT.format('w')}, lambda p: lower(p)), lower(w))) AS term FROM words),
  kept AS (SELECT query_id, term FROM terms_ WHERE length(term) >= 2 AND term NOT IN ({_quote(words.INTENT_WORDS)}))"""


def _bm25_sql(columns: dict[str, float], prefix: bool) -> str:
    asked = "SELECT query_id, term, false AS is_prefix FROM kept" + (" UNION SELECT query_id, substr(term, 1, 6), true FROM kept WHERE length(term) >= 8" if prefix else "")
    return f"""WITH {_posting_sql(columns)}, {_CLAUSES_SQL}, asked AS ({asked}),
  hits AS (SELECT c.term, c.is_prefix, p.id, sum(p.f) AS f FROM (SELECT DISTINCT term, is_prefix FROM asked) c JOIN post p ON CASE WHEN c.is_prefix THEN length(p.term) >= 6 AND substr(p.term, 1, 6) = c.term ELSE p.term = c.term END GROUP BY ALL),
  spread AS (SELECT term, is_prefix, count(*) AS n FROM hits GROUP BY ALL),
  scored AS (SELECT h.term, h.is_prefix, h.id, greatest(ln((n_docs - n + 0.5) / (n + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / mean)) AS s FROM hits h JOIN spread USING (term, is_prefix) JOIN lens USING (id), corpus),
  scores AS (SELECT query_id, id, sum(s) AS score FROM asked JOIN scored USING (term, is_prefix) GROUP BY ALL)"""


_TOP_SQL = " SELECT query_id, id, round(round(score, 9), 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank FROM scores QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 10"
_ONE, _TWO = {"literals": 1.0}, {"terms": 4.0, "literals": 1.0}


def _scores(spark: SparkSession, sf_dir: str, columns: dict[str, float], prefix: bool, k: int = 10) -> DataFrame:
    tasks = views.tasks(spark, sf_dir).withColumn("f", text.strip_accents("task")).select("query_id", text.query_terms(F.col("f")).alias("clauses"))
    asked = search.clauses(tasks)
    asked = asked if prefix else asked.filter("not is_prefix")
    found, lengths = search.occurrences(views.documents(spark, sf_dir), columns)
    return search.bm25(found, lengths, asked, k=k)


def _top10(scores: DataFrame) -> DataFrame:
    # Sums of doubles depend on their order in the last digits: ties are told at nine.
    return search.top(scores.withColumn("score", F.round("score", 9)), 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_posting_sql(_ONE)} SELECT term, count(*) AS n_docs, CAST(sum(f) AS BIGINT) AS n FROM post GROUP BY term")
def postings_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = search.postings(views.documents(spark, sf_dir), _ONE)
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("f").cast("long").alias("n"))


@query(_bm25_sql(_ONE, False) + _TOP_SQL)
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top10(_scores(spark, sf_dir, _ONE, False))


@query(_bm25_sql(_TWO, False) + _TOP_SQL)
def bm25_two_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top10(_scores(spark, sf_dir, _TWO, False))


@query(_bm25_sql(_ONE, True) + _TOP_SQL)
def bm25_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top10(_scores(spark, sf_dir, _ONE, True))


@query(_bm25_sql(_ONE, False) + """, ranked AS (SELECT query_id, id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS n, max(round(score, 9)) OVER (PARTITION BY query_id) AS best FROM scores)
  SELECT query_id, id, round(least(1.0, score / best), 6) AS lexical FROM ranked WHERE n <= 500 AND best > 0""")
def lexical_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _scores(spark, sf_dir, _ONE, False, 500)
    return search.normalised(scores).select("query_id", "id", F.round("lexical", 6).alias("lexical"))


_URL_TERMS = [(1, ["blog", "news"]), (2, ["docs"]), (3, ["html"]), (4, ["a", "zz"])]


@query("WITH q(query_id, terms) AS (VALUES " + ", ".join(f"({i}, [{_quote(t)}])" for i, t in _URL_TERMS) + """), met AS (SELECT DISTINCT query_id, url AS path, length(url) AS n FROM q JOIN pages ON len(list_filter(terms, lambda t: contains(lower(url), t))) > 0)
  SELECT CAST(query_id AS INTEGER) AS query_id, path, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n, path) AS INTEGER) AS rank FROM met QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n, path) <= 6""")
def path_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame(_URL_TERMS, "query_id int, terms array<string>")
    return search.paths_with_terms(table(spark, sf_dir, "pages").select(F.col("url").alias("path")).distinct(), asked, 6)


# --- incremental maintenance ---------------------------------------------------------------------------------------


@query(f"""WITH d AS (SELECT doc_id, path, sha256(replace(text, chr(13) || chr(10), chr(10))) AS h FROM ({PATHS_SQL})),
  i AS (SELECT path, CASE WHEN doc_id % 10 = 0 THEN 'old' ELSE h END AS h FROM d WHERE doc_id % 7 <> 0 UNION ALL SELECT 'gone/' || path, h FROM d WHERE doc_id % 17 = 0)
  SELECT coalesce(d.path, i.path) AS path, CASE WHEN i.path IS NULL THEN 'added' WHEN d.path IS NULL THEN 'deleted' WHEN d.h = i.h THEN 'unchanged' ELSE 'modified' END AS change FROM d FULL JOIN i ON d.path = i.path""")
def change_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    disk, index = _disk_and_index(spark, sf_dir)
    return changes.change_set(disk, index)


def _disk_and_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The documents as files, and an older index that lacks a seventh, has other contents for a tenth and some files more."""
    d = views.paths(table(spark, sf_dir, "documents")).select("doc_id", "path", ids.content_hash(F.col("text")).alias("content_hash"))
    old = d.filter("doc_id % 7 <> 0").withColumn("content_hash", F.when(F.col("doc_id") % 10 == 0, "old").otherwise(F.col("content_hash")))
    gone = d.filter("doc_id % 17 = 0").withColumn("path", F.concat(F.lit("gone/"), F.col("path")))
    return d.drop("doc_id"), old.unionByName(gone).drop("doc_id")


@query(f"""WITH d AS (SELECT doc_id, path, sha256(replace(text, chr(13) || chr(10), chr(10))) AS content_hash FROM ({PATHS_SQL})),
  i AS (SELECT path, CASE WHEN doc_id % 10 = 0 THEN 'old' ELSE content_hash END AS content_hash FROM d WHERE doc_id % 7 <> 0 UNION ALL SELECT 'gone/' || path, content_hash FROM d WHERE doc_id % 17 = 0)
  SELECT path, content_hash FROM d UNION ALL SELECT path, content_hash FROM i WHERE path NOT IN (SELECT path FROM d)""")
def upsert_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    disk, index = _disk_and_index(spark, sf_dir)
    return changes.upsert(index, disk, ["path"])


@query(f"""WITH e AS (SELECT source_id, target_id, type, confidence, line, file_path FROM ({EDGES_SQL})), gone AS (SELECT 'S' || s_suppkey AS id FROM supplier WHERE s_nationkey = 3)
  SELECT source_id, CASE WHEN target_id IN (SELECT id FROM gone) THEN NULL ELSE target_id END AS target_id, CASE WHEN target_id IN (SELECT id FROM gone) THEN 'UNRESOLVED' ELSE 'EXACT' END AS resolution,
  CASE WHEN target_id IN (SELECT id FROM gone) THEN 0.0 ELSE confidence END AS confidence, line, file_path FROM e WHERE file_path NOT IN ('N3', 'O3')""")
def purge_demote(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = views.edges(spark, sf_dir).withColumn("resolution", F.lit("EXACT"))
    suppliers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("file_path"))
    paths = spark.createDataFrame([("N3",), ("O3",)], "path string")
    return changes.demote(edges, suppliers, paths).select("source_id", "target_id", "resolution", "confidence", "line", "file_path")


@query("SELECT lang, text_hash, doc_id FROM (SELECT lang, sha256(coalesce(text, '')) AS text_hash, doc_id, row_number() OVER (PARTITION BY lang, coalesce(text, '') ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"), "doc_id")
    return changes.first_wins(rows, ["lang", "text_hash"], ["doc_id"])


@query(f"SELECT id, CAST(row_number() OVER (PARTITION BY file_path, type, qualified_name ORDER BY token_estimate, id) - 1 AS INTEGER) AS ordinal FROM ({ENTITIES_SQL})")
def ordinal_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.ordinals(views.entities(spark, sf_dir).withColumns({"start_byte": F.col("token_estimate"), "end_byte": F.col("id")})).select("id", "ordinal")


# --- statistics ----------------------------------------------------------------------------------------------------


@query(f"""WITH f AS (SELECT path, {_LANG_SQL} AS language, strlen(text) AS size_bytes FROM ({PATHS_SQL})), e AS ({ENTITIES_SQL}), r AS ({EDGES_SQL})
  SELECT (SELECT count(*) FROM f) AS files, (SELECT count(*) FROM e) AS entities, (SELECT count(*) FROM r) AS relations, (SELECT count(*) FROM r WHERE confidence < 0.6) AS unresolved,
  (SELECT CAST(sum(size_bytes) AS BIGINT) FROM f) AS total_tokens, (SELECT round(avg(CASE WHEN language IN ('typescript', 'python', 'javascript') THEN 1.0 ELSE 0.0 END), 6) FROM f) AS coverage,
  (SELECT round(1 - avg(CASE WHEN confidence < 0.6 THEN 1.0 ELSE 0.0 END), 6) FROM r) AS resolved_ratio""")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = views.files(spark, sf_dir).withColumns({"token_estimate": F.col("size_bytes"), "parse_state": F.when(F.col("language").isin(*words.PARSED_LANGUAGES), "OK").otherwise("UNSUPPORTED_LANGUAGE")})
    edges = views.edges(spark, sf_dir).withColumn("target_id", F.when(F.col("confidence") >= 0.6, F.col("target_id")))
    out = stats.index_stats(files, views.entities(spark, sf_dir), edges)
    return out.withColumns({"coverage": F.round("coverage", 6), "resolved_ratio": F.round("resolved_ratio", 6)})


@query(f"SELECT type, count(*) AS n FROM ({ENTITIES_SQL}) GROUP BY type")
def counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.counts(views.entities(spark, sf_dir), "type")


@query(f"SELECT language, count(*) AS n FROM (SELECT {_LANG_SQL} AS language FROM ({PATHS_SQL})) GROUP BY language ORDER BY n DESC, language LIMIT 4")
def languages_top4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.counts(views.files(spark, sf_dir), "language", 4)


@query(f"SELECT language, round(avg(CASE WHEN language IN ('typescript', 'tsx', 'javascript', 'python') THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM (SELECT {_LANG_SQL} AS language FROM ({PATHS_SQL})) GROUP BY language")
def coverage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.col("language").isin(*words.PARSED_LANGUAGES).cast("double")
    return views.files(spark, sf_dir).groupBy("language").agg(F.round(F.avg(parsed), 6).alias("coverage"))


# --- graph ---------------------------------------------------------------------------------------------------------


@query("SELECT 'S' || s_suppkey AS id, count(l_suppkey) AS degree FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey")
def in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"))
    return graph.in_degrees(views.edges(spark, sf_dir), wanted)


def _walk_sql(edges: str, seeds: str, depth: int, where: str = "true", both: bool = False, back: bool = False) -> str:
    way = "SELECT target_id AS a, source_id AS b, confidence FROM e" if back else "SELECT source_id AS a, target_id AS b, confidence FROM e"
    if both:
        way = "SELECT source_id AS a, target_id AS b, confidence FROM e UNION ALL SELECT target_id, source_id, confidence FROM e"
    return f"""WITH RECURSIVE e AS (SELECT * FROM ({edges}) WHERE {where}), step AS (SELECT a, b, max(confidence) AS c FROM ({way}) GROUP BY a, b),
  walk(entity_id, hop_distance, path_confidence) AS (SELECT id, 0, 1.0::DOUBLE FROM ({seeds}) UNION SELECT b, hop_distance + 1, path_confidence * c FROM walk JOIN step ON entity_id = a WHERE hop_distance < {depth})
  SELECT entity_id, min(hop_distance) AS hop_distance, round(max(path_confidence), 6) AS path_confidence FROM walk GROUP BY entity_id"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("path_confidence", F.round("path_confidence", 6))


@query(_walk_sql(HIERARCHY_SQL, "SELECT 'C' || c_custkey AS id FROM customer", 3))
def neighbors_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"))
    return _rounded(graph.neighbors(views.hierarchy(spark, sf_dir), seeds, 3, "OUT"))


@query(_walk_sql(HIERARCHY_SQL, "SELECT 'R' || r_regionkey AS id FROM region WHERE r_regionkey = 1", 2, back=True))
def neighbors_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "region").filter("r_regionkey = 1").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("id"))
    return _rounded(graph.neighbors(views.hierarchy(spark, sf_dir), seeds, 2, "IN"))


@query(_walk_sql(HIERARCHY_SQL, "SELECT 'N' || n_nationkey AS id FROM nation WHERE n_nationkey < 3", 3, both=True))
def neighbors_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "nation").filter("n_nationkey < 3").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("id"))
    return _rounded(graph.neighbors(views.hierarchy(spark, sf_dir), seeds, 3, "BOTH"))


@query(_walk_sql(HIERARCHY_SQL, "SELECT 'N' || n_nationkey AS id FROM nation", 2, where="type IN ('CALLS', 'IMPORTS') AND confidence >= 0.5", both=True))
def neighbors_typed_min_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("id"))
    return _rounded(graph.neighbors(views.hierarchy(spark, sf_dir), seeds, 2, "BOTH", ["CALLS", "IMPORTS"], 0.5))


@query(f"""WITH e AS ({EDGES_SQL}), s AS (SELECT 'P' || p_partkey AS id FROM part UNION ALL SELECT 'S1')
  SELECT target_id AS id FROM e WHERE type = 'CALLS' AND source_id IN (SELECT id FROM s) UNION SELECT source_id FROM e WHERE type = 'CALLS' AND target_id IN (SELECT id FROM s)""")
def direct_call_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.direct_partners(views.edges(spark, sf_dir), _part_seeds(spark, sf_dir))


def _part_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"))
    return parts.unionByName(spark.createDataFrame([("S1",)], "id string"))


@query(f"SELECT DISTINCT source_id AS id FROM ({EDGES_SQL}) WHERE type = 'TESTS'")
def test_linked_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"))
    return graph.linked_tests(views.edges(spark, sf_dir), suppliers)


# --- resolution ----------------------------------------------------------------------------------------------------


def _name_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unresolved edges: each order line names its part from the part's file, some as member calls with a receiver."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    member = F.when(F.col("l_linenumber") % 3 == 0, F.to_json(F.struct(F.concat(F.lit("obj."), F.col("p_name")).alias("expression"))))
    return table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("source_id"), F.lit(None).cast("string").alias("target_id"), F.col("p_name").alias("target_hint"), F.lit("CALLS").alias("type"),
        F.col("p_brand").alias("file_path"), F.col("l_linenumber").alias("line"), member.alias("metadata"),
    ).dropDuplicates(["source_id", "target_hint", "file_path", "line"])


@query(f"""WITH ent AS ({ENTITIES_SQL}),
  edge AS (SELECT DISTINCT 'O' || l_orderkey AS source_id, p_name AS target_hint, p_brand AS file_path, l_linenumber AS line, l_linenumber % 3 = 0 AS member FROM lineitem JOIN part ON l_partkey = p_partkey),
  bound AS (SELECT p_brand AS file_path, p_name AS target_hint, m AS bound FROM (SELECT DISTINCT p_brand, p_name FROM part WHERE p_size % 5 = 0) JOIN (SELECT p_name, max(p_brand) AS m FROM part GROUP BY p_name) USING (p_name)),
  name_file AS (SELECT file_path, target_hint, member, count(*) AS edges FROM edge GROUP BY ALL),
  c AS (SELECT e.*, ent.id, ent.exported, ent.file_path = e.file_path AS local, coalesce(ent.file_path = b.bound, false) AS is_bound FROM name_file e LEFT JOIN bound b USING (file_path, target_hint) JOIN ent ON ent.name = e.target_hint OR ent.qualified_name = e.target_hint),
  k AS (SELECT *, count(*) OVER w AS n, sum(local::INT) OVER w AS locals FROM c WINDOW w AS (PARTITION BY target_hint, file_path, member)),
  r AS (SELECT *, CASE WHEN is_bound THEN 1 WHEN NOT member AND local AND locals = 1 THEN 5 WHEN NOT member AND n = 1 THEN 6 WHEN member AND local THEN 7 ELSE 8 END AS rule FROM k),
  best AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY target_hint, file_path, member ORDER BY rule, NOT exported, id) = 1)
  SELECT source_id, target_hint, line, file_path, id AS new_target, CASE WHEN rule = 1 THEN 'EXACT' WHEN rule <= 6 THEN 'SCOPED' ELSE 'AMBIGUOUS' END AS new_resolution, round(CASE WHEN rule = 1 THEN 1.0 WHEN rule <= 6 THEN 0.75 ELSE least(0.5, 1.0 / n) END, 6)::DOUBLE AS new_confidence
  FROM edge JOIN best USING (target_hint, file_path, member)""")
def resolve_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    last = part.groupBy("p_name").agg(F.max("p_brand").alias("bound_path"))
    bound = part.filter("p_size % 5 = 0").select(F.col("p_brand").alias("file_path"), "p_name").distinct().join(last, "p_name").select("file_path", F.col("p_name").alias("local_name"), "bound_path")
    out = resolve.resolve_symbols(_name_edges(spark, sf_dir), views.entities(spark, sf_dir), bound)
    return out.select("source_id", "target_hint", "line", "file_path", "new_target", "new_resolution", F.round("new_confidence", 6).alias("new_confidence"))


@query(f"""WITH f AS ({PATHS_SQL}) SELECT a.path AS file_path, '../' || b.source || '/' || b.doc_id AS target_hint, b.path FROM f a JOIN f b ON b.doc_id = a.doc_id + 1 WHERE regexp_matches(b.path, '\\.(ts|js|py)$')""")
def import_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.paths(table(spark, sf_dir, "documents")).select("doc_id", "source", "path")
    b = f.select((F.col("doc_id") - 1).alias("doc_id"), F.concat(F.lit("../"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("target_hint"))
    imports = f.join(b, "doc_id").select(F.col("path").alias("source_id"), F.lit("IMPORTS").alias("type"), "target_hint", F.lit(1).alias("line"), F.col("path").alias("file_path"))
    return resolve.resolve_imports(imports, f.select("path")).select("file_path", "target_hint", "path")


@query("""SELECT file_path, local_name, bound_path FROM (SELECT 'f' || conv_id % 20 AS file_path, role AS local_name, 'p' || turn AS bound_path, row_number() OVER (PARTITION BY conv_id % 20, role ORDER BY conv_id * 100 + turn DESC) AS n FROM conversations) WHERE n = 1""")
def bindings_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    rows = c.select(F.concat(F.lit("f"), (F.col("conv_id") % 20).cast("string")).alias("file_path"), F.array("role").alias("names"), F.concat(F.lit("p"), F.col("turn").cast("string")).alias("path"), (F.col("conv_id") * 100 + F.col("turn")).alias("line"))
    return resolve.bindings(rows)


# --- ranking and selection -----------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT user_id, max(epoch(ts)) AS last FROM events GROUP BY user_id), m AS (SELECT max(last) AS newest FROM t)
  SELECT user_id, round(pow(2.0, -greatest(0, (newest - last) / 86400.0) / 30), 6) AS recency FROM t, m""")
def recency_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "events").groupBy("user_id").agg((F.unix_micros(F.max("ts").cast("timestamp")) / 1e6).alias("last"))
    newest = last.agg(F.max("last").alias("newest"))
    return last.crossJoin(F.broadcast(newest)).select("user_id", F.round(scoring.recency(F.col("last"), F.col("newest")), 6).alias("recency"))


@query("SELECT 'u' || user_id AS path, CAST(max(epoch_us(ts)) AS BIGINT) AS ts FROM events GROUP BY user_id ORDER BY ts DESC, path LIMIT 8")
def recent_files_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))
    return rank.recent_files(e)


_AFFINITY_SQL = "CASE " + " ".join(f"WHEN kind = '{k}' AND type = '{t}' THEN {v}" for k, row in words.TASK_AFFINITY.items() for t, v in row.items()) + " ".join([""] + [f"WHEN type = '{t}' THEN {v}" for t, v in words.BASE_AFFINITY.items()]) + " ELSE 0.5 END::DOUBLE"
_TYPES = (*words.BASE_AFFINITY, "OTHER")


@query(f"""WITH turns AS (SELECT conv_id, turn, {_KIND_SQL} AS kind, [{_quote(_TYPES)}][1 + conv_id % {len(_TYPES)}] AS type FROM conversations)
  SELECT conv_id, turn, kind, type, {_AFFINITY_SQL} AS affinity FROM turns""")
def affinity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affinity of each turn's kind of task to a type that goes round with the conversation."""
    turns = table(spark, sf_dir, "conversations")
    kind, type_ = text.classify_task(F.col("text")), F.element_at(F.array(*(F.lit(t) for t in _TYPES)), (1 + F.col("conv_id") % len(_TYPES)).cast("int"))
    return turns.select("conv_id", "turn", kind.alias("kind"), type_.alias("type")).withColumn("affinity", scoring.affinity(F.col("kind"), F.col("type")).cast("double"))


@query("SELECT l_orderkey, l_linenumber, round(100 * (0.25 * l_discount * 10 + 0.20 * l_tax * 10 + 0.20 / (1 + l_linenumber)), 6) AS score FROM lineitem")
def weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = {"lexical": F.col("l_discount") * 10, "symbol_match": F.col("l_tax") * 10, "graph_proximity": 1.0 / (1 + F.col("l_linenumber")), "semantic": F.lit(1.0)}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(scoring.weighted_score(signals), 6).alias("score"))


def _code_index(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Documents as one entity a file, conversations' turns as calls between them."""
    d = views.paths(table(spark, sf_dir, "documents"))
    line, word = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1), F.split("text", r"[^A-Za-z]+", 2)[0]
    kind = F.when(F.col("doc_id") % 3 == 0, "FUNCTION").when(F.col("doc_id") % 3 == 1, "CLASS").otherwise("FILE")
    e = d.select(
        F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("id"), kind.alias("type"), word.alias("name"), F.concat_ws(".", "source", word).alias("qualified_name"), F.col("path").alias("file_path"),
        F.lit(1).alias("start_line"), F.lit(0).alias("start_byte"), F.length("text").alias("end_byte"), line.alias("signature"), F.lit(None).cast("string").alias("documentation"), (F.col("doc_id") % 2 == 0).alias("exported"), (F.length("text") / 4).cast("int").alias("token_estimate"), F.col("text").alias("literals"),
    )
    near = d.select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("source_id"), F.concat(F.lit("D"), ((F.col("doc_id") * 7 + 3) % F.lit(500)).cast("string")).alias("target_id"), F.lit("CALLS").alias("type"), F.lit("x").alias("target_hint"), F.lit(1).alias("line"), F.lit(0.75).alias("confidence"), F.col("path").alias("file_path"))
    commits = d.select("path", (F.col("doc_id") % 100 * 86400).alias("ts"))
    found, lengths = search.occurrences(e.withColumn("terms", F.coalesce("name", F.lit(""))))
    return {"entities": kept(e.drop("literals")), "relations": near, "files": d.select("path"), "postings": found, "lengths": lengths, "commits": commits, "sources": d.select("path", F.col("text").alias("content"))}


def _ranked(spark: SparkSession, sf_dir: str, x: dict[str, DataFrame]) -> DataFrame:
    return rank.rank(views.tasks(spark, sf_dir), x["entities"], x["relations"], x["files"], lambda asked: search.bm25(x["postings"], x["lengths"], asked, k=rank.LEXICAL_HITS), x["commits"])


@query()
def rank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir, _code_index(spark, sf_dir)).select("query_id", "id", "hop_distance", F.round("score", 6).alias("score"), F.array_join("reasons", "; ").alias("reasons"))


@query("""WITH s AS (SELECT l_orderkey AS query_id, l_linenumber AS id, l_extendedprice / 1000 AS score FROM lineitem), b AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM s)
  SELECT query_id, id, round(score, 6) AS score FROM b WHERE score >= greatest(0.25 * best, 12.0)""")
def score_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("id"), (F.col("l_extendedprice") / 1000).alias("score"))
    return rank.score_floor(rows).withColumn("score", F.round("score", 6))


@query()
def context_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _code_index(spark, sf_dir)
    ranked = kept(rank.score_floor(_ranked(spark, sf_dir, x)))
    costed = select.rendered(ranked, x["relations"], x["sources"], x["entities"])
    return select.greedy(costed, select.budgets(views.tasks(spark, sf_dir), 20_000)).withColumn("score", F.round("score", 6))


@query("""WITH d AS (SELECT l_orderkey AS query_id, count(*) AS considered, count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS selected, count(DISTINCT CASE WHEN l_returnflag = 'N' THEN l_suppkey END) AS files,
  CAST(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS BIGINT) AS spent FROM lineitem GROUP BY l_orderkey), t AS (SELECT CAST(sum(l_quantity) AS BIGINT) AS total_tokens FROM lineitem)
  SELECT query_id, considered, selected, files, spent, 100 AS budget, total_tokens, round(1 - spent / total_tokens, 9) AS reduction FROM d, t""")
def context_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    kept = F.col("l_returnflag") == "N"
    decided = l.select(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("file_path"), F.when(kept, "FULL").alias("detail"), F.when(kept, F.col("l_quantity")).otherwise(0).cast("long").alias("tokens"))
    budgets = l.select(F.col("l_orderkey").alias("query_id"), F.lit(100).alias("budget")).distinct()
    out = select.metrics(decided, budgets, l.agg(F.sum("l_quantity").cast("long").alias("total_tokens")))
    return out.withColumn("reduction", F.round("reduction", 9))


# --- impact --------------------------------------------------------------------------------------------------------


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges = views.hierarchy(spark, sf_dir).withColumns({"target_hint": F.col("target_id"), "line": F.lit(1)})
    kind = F.when(F.col("id").startswith("S"), "TEST").otherwise("FUNCTION")
    every = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("file_path")).unionByName(table(spark, sf_dir, "region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("id"), F.lit("root").alias("file_path")))
    return every.select("id", F.col("id").alias("name"), F.col("id").alias("qualified_name"), "file_path", kind.alias("type"), F.lit(True).alias("exported")), edges


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, "R1"), (2, "N3"), (3, "C5"), (4, "N24")], "query_id int, target string")


_IMPACT_SQL = f"""WITH RECURSIVE e AS (SELECT * FROM ({HIERARCHY_SQL}) WHERE confidence >= 0.3), q(query_id, id) AS (VALUES (1, 'R1'), (2, 'N3'), (3, 'C5'), (4, 'N24')),
  walk(query_id, id, hop, conf) AS (SELECT query_id, id, 0, 1.0::DOUBLE FROM q UNION SELECT query_id, source_id, hop + 1, conf * confidence FROM walk JOIN e ON target_id = walk.id WHERE hop < 3),
  hit AS (SELECT query_id, id, min(hop) AS hop_distance, max(conf) AS path_confidence FROM walk GROUP BY ALL HAVING min(hop) > 0),
  full_ AS (SELECT h.*, t.target_id AS file_path, id LIKE 'S%' AS is_test FROM hit h JOIN ({HIERARCHY_SQL}) t ON t.source_id = h.id)"""


@query(_IMPACT_SQL + " SELECT query_id, id, CASE WHEN hop_distance = 1 THEN 'direct' ELSE 'indirect' END AS reach, hop_distance, round(path_confidence, 6) AS path_confidence, is_test FROM full_")
def impact_direct_indirect(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, edges = _tree(spark, sf_dir)
    rows = impact.reached(entities, edges, impact.targets(entities, _asked(spark)))
    return _rounded(rows.select("query_id", "id", "reach", "hop_distance", "path_confidence", "is_test"))


@query(_IMPACT_SQL + f""", n AS (SELECT q.query_id, count(CASE WHEN hop_distance = 1 THEN 1 END) AS direct, count(CASE WHEN hop_distance > 1 THEN 1 END) AS indirect, count(DISTINCT file_path) AS files, count(CASE WHEN is_test THEN 1 END) AS tests FROM q LEFT JOIN full_ f USING (query_id) GROUP BY q.query_id),
  low AS (SELECT query_id, count(CASE WHEN confidence < 0.75 THEN 1 END) AS low_confidence_edges FROM q LEFT JOIN ({HIERARCHY_SQL}) h ON h.target_id = q.id GROUP BY query_id)
  SELECT query_id, direct, indirect, files, tests, low_confidence_edges, CASE WHEN direct + indirect = 0 THEN 'LOW' WHEN direct + indirect > 20 OR files > 10 THEN 'HIGH' WHEN direct + indirect > 5 OR files > 3 OR tests = 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM n JOIN low USING (query_id)""")
def impact_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, edges = _tree(spark, sf_dir)
    return impact.report(entities, edges, impact.targets(entities, _asked(spark))).select("query_id", "direct", "indirect", "files", "tests", "low_confidence_edges", "risk")


@query(f"SELECT target_id AS id, count(CASE WHEN confidence < 0.75 THEN 1 END) AS low FROM ({EDGES_SQL}) GROUP BY target_id")
def impact_low_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.low_confidence_incoming(views.edges(spark, sf_dir))


# --- evaluation ----------------------------------------------------------------------------------------------------


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits: the priority is the subject, the parts are the files."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    ending = F.when(F.col("l_linenumber") % 2 == 0, ".ts").otherwise(".md")
    files = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.concat(F.lit("p"), F.col("l_partkey").cast("string"), ending))).alias("files"))
    subject = F.when(F.col("o_orderkey") % 11 == 0, "WIP on things").when(F.col("o_orderkey") % 5 == 0, "fix").when(F.col("o_orderkey") % 7 == 0, "Merged the report tables").when(F.col("o_orderkey") % 13 == 0, "Bumper stock page")
    subject = subject.when(F.col("o_orderkey") % 17 == 0, "Format: all files").otherwise(F.concat(F.lit("Order with priority "), F.col("o_orderpriority")))
    joined = o.join(files, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select(F.col("o_orderkey").alias("sha"), subject.alias("subject"), F.coalesce("files", F.array().cast("array<string>")).alias("files"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("ts"))


_COMMITS_SQL = """WITH f AS (SELECT l_orderkey, list_sort(list('p' || l_partkey || CASE WHEN l_linenumber % 2 = 0 THEN '.ts' ELSE '.md' END)) AS files FROM lineitem GROUP BY l_orderkey),
  c AS (SELECT o_orderkey AS sha, CASE WHEN o_orderkey % 11 = 0 THEN 'WIP on things' WHEN o_orderkey % 5 = 0 THEN 'fix' WHEN o_orderkey % 7 = 0 THEN 'Merged the report tables' WHEN o_orderkey % 13 = 0 THEN 'Bumper stock page' WHEN o_orderkey % 17 = 0 THEN 'Format: all files' ELSE 'Order with priority ' || o_orderpriority END AS subject, coalesce(files, []) AS files, epoch_us(o_orderdate) AS ts FROM orders LEFT JOIN f ON l_orderkey = o_orderkey),
  r AS (SELECT *, CASE WHEN regexp_matches(lower(trim(subject)), '^(wip|merge|revert|bump)([^a-z0-9_]|$)') OR starts_with(lower(trim(subject)), 'chore') OR starts_with(lower(trim(subject)), 'lint') OR starts_with(lower(trim(subject)), 'format')
      OR lower(trim(subject)) IN ('fix', 'fixes', 'fixed', 'ajuste', 'ajustes', 'update', 'atualiza', 'atualizando', 'atualizacao', 'atualização', 'primeiro commit', 'initial commit') THEN 'subject' WHEN len(list_filter(regexp_split_to_array(trim(subject), '\\s+'), lambda w: w <> '')) < 3 THEN 'short message'
    WHEN len(files) = 0 THEN 'no files' WHEN len(files) > 20 THEN 'too many files' WHEN len(list_filter(files, lambda p: regexp_matches(p, '\\.ts$'))) = 0 THEN 'no code' END AS reason FROM c)"""


@query(_COMMITS_SQL + " SELECT sha, subject AS task, array_to_string(list_filter(files, lambda p: regexp_matches(p, '\\.ts$')), ' ') AS expected, CAST(row_number() OVER (ORDER BY ts DESC, sha) AS INTEGER) AS n FROM r WHERE reason IS NULL ORDER BY n LIMIT 50")
def corpus_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.corpus(_commits(spark, sf_dir), 50).withColumn("expected", F.array_join("expected", " "))


@query(_COMMITS_SQL + " SELECT coalesce(reason, 'case') AS reason, count(*) AS n FROM r GROUP BY ALL")
def commit_reject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = evaluate.reject_reason(F.col("subject"), F.col("files"))
    return stats.counts(_commits(spark, sf_dir).select(F.coalesce(reason, F.lit("case")).alias("reason")), "reason")


_CASES_SQL = """WITH g AS (SELECT DISTINCT l_orderkey AS case_id, l_suppkey AS path FROM lineitem), s AS (SELECT DISTINCT l_orderkey AS case_id, l_suppkey AS path FROM lineitem WHERE l_quantity > 25),
  x AS (SELECT g.case_id, count(s.path) AS hits, count(*) AS n_expected FROM g LEFT JOIN s USING (case_id, path) GROUP BY g.case_id), y AS (SELECT case_id, count(*) AS n_selected FROM s GROUP BY case_id),
  z AS (SELECT case_id, coalesce(n_selected, 0) AS n_selected, n_expected, hits, hits / n_expected AS recall, CASE WHEN coalesce(n_selected, 0) = 0 THEN 0 ELSE hits / n_selected END AS precision FROM x LEFT JOIN y USING (case_id))"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_suppkey").alias("path"), "l_quantity")
    return evaluate.case_results(l.filter("l_quantity > 25"), l)


@query(_CASES_SQL + " SELECT case_id, n_selected, n_expected, hits, round(recall, 6) AS recall, round(precision, 6) AS precision FROM z")
def eval_recall_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, sf_dir).withColumns({"recall": F.round("recall", 6), "precision": F.round("precision", 6)})


@query(_CASES_SQL + """, v AS (SELECT list_sort(list(n_selected)) AS a FROM z) SELECT count(*) AS cases, round(avg(recall), 6) AS mean_recall, round(avg(precision), 6) AS mean_precision, count(CASE WHEN recall = 0 THEN 1 END) AS misses,
  any_value(a[least(len(a), CAST(floor(0.5 * len(a)) AS INTEGER) + 1)]) AS median, any_value(a[least(len(a), CAST(floor(0.95 * len(a)) AS INTEGER) + 1)]) AS p95 FROM z, v""")
def eval_aggregate_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.report(_cases(spark, sf_dir), "n_selected")
    return out.withColumns({"mean_recall": F.round("mean_recall", 6), "mean_precision": F.round("mean_precision", 6)})


@query()
def entity_extract_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the bodies of Python functions, extracted again."""
    from corvane.extract import registry

    d = views.paths(table(spark, sf_dir, "documents"))
    body = F.concat(F.lit("def f"), F.col("doc_id").cast("string"), F.lit("(x):\n    return g("), F.to_json(F.struct("text")), F.lit(")\n"))
    found = registry.extracted(d.select("path", F.lit("python").alias("language"), body.alias("content")))
    return registry.entities(found).select("id", "type", "name", "qualified_name", "start_line", "end_line", "exported", "fingerprint", "token_estimate")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 hits of each task, those over the floor, with token costs and the share of the corpus that is saved."""
    scores = _scores(spark, sf_dir, _TWO, True)
    top = rank.score_floor(search.top(scores, 40).withColumn("score", F.col("score") * 10))
    cost = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", text.estimate_tokens(F.col("text")).alias("tokens"))
    total = F.sum("tokens").over(Window.partitionBy("query_id"))
    every = cost.agg(F.sum("tokens").alias("all_tokens"))
    return top.join(cost, "id").crossJoin(F.broadcast(every)).select("query_id", "id", "source", "rank", "score", "tokens", (1 - total / F.col("all_tokens")).alias("reduction"))


from corvane.plans import lookups, projects  # noqa: E402,F401  their queries register themselves here
