"""Queries that run the whole engine on a source tree which Spark writes from `documents`, and on indexes that it stores."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.api import Project
from corvane.functions import words
from corvane.operators import postings, rank, search
from corvane.plans import views
from corvane.plans.catalogue import _CLAUSES_SQL, _LANG_SQL, _ONE, _SPLIT, _bm25_sql, _quote, _top10, _TOP_SQL, query
from corvane.plans.views import PATHS_SQL, table
from corvane.session import shared_folder
from corvane.sources import scan


def tree(spark: SparkSession, rows: DataFrame, root: str) -> None:
    """Writes (path, content) below the root, a file a row; a null content deletes the file."""
    base = scan.local_path(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = set()
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                at = os.path.join(base, path)
                if content is None:
                    os.remove(at)
                    continue
                if os.path.dirname(at) not in made:
                    made.add(os.path.dirname(at))
                    os.makedirs(os.path.dirname(at), exist_ok=True)
                # Attempts of a task write the same bytes, so one needs no file of its own: a folder's files are made one after another, and a rename doubles that.
                with os.fdopen(os.open(at, os.O_WRONLY | os.O_CREAT, 0o666), "wb") as f:
                    f.write(content.encode())
                    f.truncate()
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    rows.select("path", "content").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def project(spark: SparkSession, sf_dir: str) -> Project:
    """The documents as a scanned project, with every seventh below a folder that the rules leave out."""
    root = shared_folder(spark)
    if scan.local_path(root) is None:
        raise ValueError("the shared folder must be mounted on every machine to hold a source tree")
    docs = views.paths(table(spark, sf_dir, "documents"))
    out = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("node_modules/"), "path")).otherwise(F.col("path"))
    tree(spark, docs.select(out.alias("path"), F.coalesce("text", F.lit("")).alias("content")), root)
    found = Project(spark, scan.local_path(root), f"{root}-index")
    found.scan()
    return found


_TREE = f"(SELECT doc_id, path, coalesce(text, '') AS text FROM ({PATHS_SQL}) WHERE doc_id % 7 <> 0)"
_LINES = "CAST(CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS INTEGER)"


@query(f"SELECT path, {_LANG_SQL} AS language, strlen(text) AS size_bytes, {_LINES} AS line_count, sha256(replace(text, chr(13) || chr(10), chr(10))) AS content_hash FROM {_TREE}")
def project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files table after a scan: the rows of the whole tree but the pruned folder's."""
    return project(spark, sf_dir).files().select("path", "language", "size_bytes", "line_count", "content_hash")


@query(f"""SELECT CASE WHEN doc_id % 10 = 1 THEN 'deleted' WHEN doc_id % 10 = 0 THEN 'modified' ELSE 'unchanged' END AS change, count(*) AS n FROM {_TREE} GROUP BY ALL UNION ALL SELECT 'added', 1""")
def project_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second scan reports after a tenth of the files were rewritten, a tenth deleted and one added."""
    p = project(spark, sf_dir)
    docs = views.paths(table(spark, sf_dir, "documents")).filter("doc_id % 7 <> 0 and doc_id % 10 < 2")
    tree(spark, docs.select("path", F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("changed\\n"), F.coalesce("text", F.lit("")))).alias("content")), p.root)
    tree(spark, spark.createDataFrame([("added/one.md", "new")], "path string, content string"), p.root)
    report = p.scan()
    return spark.createDataFrame([(k, v) for k, v in report.items() if v], "change string, n long")


@query(f"""SELECT 'file' AS asked, path AS found FROM {_TREE} WHERE doc_id = (SELECT min(doc_id) FROM {_TREE})
  UNION ALL SELECT 'entity', path || '#FILE:' || path FROM {_TREE} WHERE {_LANG_SQL} IN ('typescript', 'javascript', 'python')
  UNION ALL SELECT 'signature', path FROM {_TREE}""")
def project_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-ups by path, by type and by id over the stored tables."""
    p = project(spark, sf_dir)
    first = views.paths(table(spark, sf_dir, "documents")).filter("doc_id % 7 <> 0").orderBy("doc_id").first()["path"]
    by_type = p.entities(types=["FILE"]).select("id")
    own = p.entities(path=first, types=["FILE"]).select("id").unionByName(p.entities(name=first, types=["FILE"]).select("id")).distinct()
    by_id = by_type.join(own, "id", "left_anti").unionByName(own)
    rows = [p.file(first).select(F.lit("file").alias("asked"), F.col("path").alias("found")), by_id.select(F.lit("entity").alias("asked"), F.col("id").alias("found")), p.signatures().select(F.lit("signature").alias("asked"), F.col("path").alias("found"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# --- stored postings and the lexicon -------------------------------------------------------------------------------

_REPLACED = "SELECT doc_id AS id, coalesce(source, '') AS terms, CASE WHEN doc_id % 10 = 0 THEN 'replaced ' || reverse(coalesce(text, '')) ELSE coalesce(text, '') END AS literals FROM documents WHERE doc_id % 10 <> 1"


def replaced_postings(spark: SparkSession, sf_dir: str) -> postings.Postings:
    """An index of all documents, to which a segment was added that replaces a tenth of them and drops another tenth."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file_path"), F.coalesce("source", F.lit("")).alias("terms"), F.coalesce("text", F.lit("")).alias("literals"), "doc_id")
    index = postings.Postings(spark, shared_folder(spark))
    index.added(docs.drop("doc_id"), docs.select("file_path").limit(0), _ONE)
    new = docs.filter("doc_id % 10 = 0").withColumn("literals", F.concat(F.lit("replaced "), F.reverse("literals")))
    index.added(new.drop("doc_id"), docs.filter("doc_id % 10 < 2").select("file_path"), _ONE)
    return index


@query(_bm25_sql(_ONE, True).replace("SELECT doc_id AS id, coalesce(source, '') AS terms, coalesce(text, '') AS literals FROM documents", _REPLACED) + _TOP_SQL)
def stored_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over a stored index whose tenth was replaced, as over one that is built anew."""
    asked = search.clauses(rank.analysed(views.tasks(spark, sf_dir)))
    scores = replaced_postings(spark, sf_dir).scores(asked)
    return _top10(scores.withColumn("id", F.col("id").cast("long")))


@query("SELECT term, count(*) AS n_docs FROM (SELECT DISTINCT id, unnest(list_filter(regexp_split_to_array(lower(literals), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')) AS term FROM (" + _REPLACED + ")) GROUP BY term")
def stored_postings_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every living term of that index after its segments were merged."""
    index = replaced_postings(spark, sf_dir)
    index.merged()
    return index.terms()


_GROUPS = (("answer", "thing", "report"), ("report", "shore"), ("river", "the", "nicht"))
_PAIRS = sorted({(a, b) for g in _GROUPS for a in g for b in g if a != b})
_LEXICON_SQL = _bm25_sql(_ONE, True).replace(
    _CLAUSES_SQL,
    f"""lexi(a, b) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _PAIRS)}), parts AS (SELECT item_id AS query_id, unnest(flatten(list_transform(list_filter(regexp_split_to_array(strip_accents(text), '[^\\w$]+'), lambda w: length(w) >= 3), lambda w: list_transform({_SPLIT.format('w')}, lambda p: lower(p))))) AS t FROM benchmark),
  words AS (SELECT item_id AS query_id, unnest(list_filter(regexp_split_to_array(strip_accents(text), '[^A-Za-z0-9_$]+'), lambda w: length(w) >= 2)) AS w FROM benchmark UNION ALL SELECT query_id, b FROM parts JOIN lexi ON t = a),
  terms_ AS (SELECT DISTINCT query_id, unnest(list_append(list_transform({_SPLIT.format('w')}, lambda p: lower(p)), lower(w))) AS term FROM words),
  kept AS (SELECT query_id, term FROM terms_ WHERE length(term) >= 2 AND term NOT IN ({_quote(words.INTENT_WORDS)}))""",
)


@query(_LEXICON_SQL + _TOP_SQL)
def lexicon_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 of tasks whose terms have the synonyms of their groups: a document may share none of the task's own words."""
    groups = search.lexicon(spark.createDataFrame([(list(g),) for g in _GROUPS], "words array<string>"))
    asked = search.clauses(rank.analysed(views.tasks(spark, sf_dir), groups))
    found, lengths = search.occurrences(views.documents(spark, sf_dir), _ONE)
    return _top10(search.bm25(found, lengths, asked, k=10))


# --- a project of code ---------------------------------------------------------------------------------------------

#: What is written for a document: @ is its id, + the next one, and ? its text as a string.
_CODE = """import { f+ } from './d+.js';
/** Says @. */
export function f@(x: string): string { return f+(x); }
export class C@ {
  run(x: string) { return this.go(x); }
  go(x: string) { return f@(x); }
}
export const said@ = ?;
"""


def code_project(spark: SparkSession, sf_dir: str) -> Project:
    """A scanned project with a TypeScript file per document, each of which imports and calls the next one's function."""
    root = shared_folder(spark)
    i, n = F.col("doc_id").cast("string"), (F.col("doc_id") + 1).cast("string")
    said = F.get_json_object(F.to_json(F.struct(F.struct(F.coalesce("text", F.lit("")).alias("t")).alias("o"))), "$.o")
    code = F.replace(F.replace(F.replace(F.lit(_CODE), F.lit("@"), i), F.lit("+"), n), F.lit("?"), said)
    docs = table(spark, sf_dir, "documents").filter("doc_id is not null")
    tree(spark, docs.groupBy("doc_id").agg(F.max("text").alias("text")).select(F.concat(F.lit("code/d"), i, F.lit(".ts")).alias("path"), code.alias("content")), root)
    found = Project(spark, scan.local_path(root), f"{root}-index")
    found.scan()
    return found


_NEXT = "EXISTS (SELECT 1 FROM d n WHERE n.doc_id = d.doc_id + 1)"
_CODE_SQL = f"""WITH d AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), p AS (SELECT doc_id, 'code/d' || doc_id || '.ts' AS path, 'code/d' || (doc_id + 1) || '.ts' AS nxt, {_NEXT} AS met FROM d),
  rel AS (SELECT path AS file_path, 'IMPORTS' AS type, './d' || (doc_id + 1) || '.js' AS target_hint, CASE WHEN met THEN nxt || '#FILE:' || nxt END AS target_id, CASE WHEN met THEN 'EXACT' ELSE 'UNRESOLVED' END AS resolution, CASE WHEN met THEN 1.0 ELSE 0.0 END AS confidence FROM p
    UNION ALL SELECT path, 'CALLS', 'f' || (doc_id + 1), CASE WHEN met THEN nxt || '#FUNCTION:f' || (doc_id + 1) END, CASE WHEN met THEN 'EXACT' ELSE 'UNRESOLVED' END, CASE WHEN met THEN 1.0 ELSE 0.0 END FROM p
    UNION ALL SELECT path, 'CALLS', 'go', path || '#METHOD:C' || doc_id || '.go', 'EXACT', 1.0 FROM p
    UNION ALL SELECT path, 'CALLS', 'f' || doc_id, path || '#FUNCTION:f' || doc_id, 'SCOPED', 0.75 FROM p)"""


@query(_CODE_SQL + " SELECT file_path, type, target_hint, target_id, resolution, confidence::DOUBLE AS confidence FROM rel")
def project_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edge of the scanned code with what it was resolved to."""
    return code_project(spark, sf_dir).relations().select("file_path", "type", "target_hint", "target_id", "resolution", "confidence")


@query(_CODE_SQL + """ SELECT 'source' AS asked, count(*) AS n FROM rel WHERE file_path = 'code/d7.ts' AND type = 'CALLS' AND target_hint = 'f8' UNION ALL SELECT 'target', 2 UNION ALL SELECT 'file', count(*) FROM rel WHERE file_path = 'code/d7.ts'
  UNION ALL SELECT 'unresolved', count(*) FROM rel WHERE target_id IS NULL UNION ALL SELECT 'hints', count(*) FROM rel WHERE target_id IS NULL AND type = 'CALLS' UNION ALL SELECT 'ids', 1 UNION ALL SELECT 'neighbors', 4 UNION ALL SELECT 'search', 1""")
def project_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-ups of edges by source, target, file, openness and hint; of an entity by id; a traversal; and a search that one entity alone answers best."""
    p = code_project(spark, sf_dir)
    own = "code/d7.ts#FUNCTION:f7"
    open_ = [r["target_hint"] for r in p.relations(unresolved=True).filter("type = 'CALLS'").select("target_hint").collect()]  # the last document's call
    asked = {
        "source": p.relations(source=own), "target": p.relations(target=own), "file": p.relations(path="code/d7.ts"), "unresolved": p.relations(unresolved=True), "hints": p.relations(hints=open_),
        "ids": p.entities(ids=[own]), "neighbors": p.neighbors([own], 3, "OUT", ["CALLS"]), "search": p.search("f7", 1).filter(F.col("id").like("code/d7.ts#%")),
    }
    out = None
    for name, rows in asked.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("asked"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT 2::BIGINT AS direct, 6::BIGINT AS indirect, 4::BIGINT AS files, 0::BIGINT AS tests, 'MEDIUM' AS risk, 'f9' AS critical_dependencies, (SELECT count(*) FROM documents WHERE doc_id = -1) AS alternatives")
def project_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impact of one function of the chain: its callers, theirs, and the risk."""
    found = code_project(spark, sf_dir).impact("f8")
    row = found["report"]
    return spark.createDataFrame([(row["direct"], row["indirect"], row["files"], row["tests"], row["risk"], ", ".join(row["critical_dependencies"]), len(found["alternatives"]))], "direct long, indirect long, files long, tests long, risk string, critical_dependencies string, alternatives long")


@query("SELECT 'BUG_FIX' AS kind, 'code/d8.ts#FUNCTION:f8' AS id, 'FULL' AS detail, true AS in_package, true AS within FROM (SELECT 1 FROM documents LIMIT 1)")
def project_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A context for a task that names a function: that function in full, in the package, and all within the budget."""
    found = code_project(spark, sf_dir).context("fix f_8 in `f8`", budget=4000)
    spent = found["metrics"][0]["spent"]
    rows = [(found["kind"], i["id"], i["detail"], "export function f8(x: string)" in found["package"], spent <= 3800) for i in found["items"] if i["id"] == "code/d8.ts#FUNCTION:f8"]
    return spark.createDataFrame(rows, "kind string, id string, detail string, in_package boolean, within boolean")
