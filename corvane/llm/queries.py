"""The thin contract queries opN_<name>, and their SQL where SQL can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: The key of the pseudonyms that the query shows; a deployment passes its own secret to the operator.
PII_KEY = "contract-query"


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.pii import pseudonymised

    return pseudonymised(_table(spark, sf_dir, "documents"), PII_KEY)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.toxicity import scored, train

    docs = _table(spark, sf_dir, "documents")
    return scored(docs, train(docs, _table(spark, sf_dir, "labels")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.langid import predicted, train

    docs = _table(spark, sf_dir, "documents")
    return predicted(docs, train(docs))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.ngram_join import near_groups

    return near_groups(_table(spark, sf_dir, "documents"), k=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.quality import scored, train

    docs = _table(spark, sf_dir, "documents")
    return scored(docs, train(docs, _table(spark, sf_dir, "labels")))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.exact_dedup import exact_groups

    return exact_groups(_table(spark, sf_dir, "documents"))


def op7_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.suffix_dedup import deduplicated

    return deduplicated(_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.packing import packed

    return packed(_table(spark, sf_dir, "documents"), tokenizer_path())


def op11_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from corvane.llm.fertility import verdicts

    return verdicts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.vector_codes import codes

    return codes(_table(spark, sf_dir, "embeddings"))


def planted_places(doc_id: int | None, n: int) -> np.ndarray | None:
    """The contract's periods: with h the crc32 of a tenth of the ids, words from place a on repeat the p words there."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.periodic import digests, periodic_runs

    return digests(periodic_runs(_table(spark, sf_dir, "documents"), planted_places))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pii_pseudonyms, op2_toxicity, op3_language_id, op4_ngram_join, op5_quality, op6_exact_dedup, op7_additive_quantisation, op8_suffix_dedup, op9_mixing, op10_packing, op11_fertility_rules, op12_vector_codes, op13_periodic_runs)}

def _op12_sql(parts: int = 4, words: int = 256, rounds: int = 4) -> str:
    """Assignment and update as a chain of common table expressions, one pair a round."""
    far = "list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - b.v[i]) * (p.v[i] - b.v[i])))"
    near = f"SELECT rid, part, arg_min(e, (far, e)) AS e, min(far) AS far FROM (SELECT p.rid, p.part, b.e, {far} AS far FROM pieces p JOIN book{{0}} b USING (part)) GROUP BY rid, part"
    steps = []
    for r in range(rounds):
        steps.append(f"near{r} AS MATERIALIZED ({near.format(r)})")
        steps.append(f"""sums{r} AS MATERIALIZED (SELECT part, e, i, sum(x) AS s, count(*) AS n FROM (SELECT part, n.e, unnest(p.v) AS x, unnest(range(1, len(p.v) + 1)) AS i FROM near{r} n JOIN pieces p USING (rid, part)) GROUP BY ALL)""")
        steps.append(f"""book{r + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN
  (SELECT part, e, list(CAST((s - ((s % n) + n) % n) / n AS HUGEINT) ORDER BY i) AS v FROM (SELECT part, e, i, CAST(s AS HUGEINT) AS s, CAST(n AS HUGEINT) AS n FROM sums{r}) GROUP BY part, e) m USING (part, e))""".replace(") / n AS HUGEINT)", ") // n AS HUGEINT)"))
    return f"""WITH good AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
pieces AS MATERIALIZED (SELECT rid, part, v[part * len(v) // {parts} + 1:(part + 1) * len(v) // {parts}] AS v FROM good, (SELECT unnest(range({parts})) AS part)),
book0 AS MATERIALIZED (SELECT part, rid - 1 AS e, v FROM pieces WHERE rid <= {words}),
{", ".join(steps)},
last AS MATERIALIZED ({near.format(rounds)}),
coded AS (SELECT rid, string_agg(lpad(lower(hex(e)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM last GROUP BY rid),
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN good USING (rid), digest"""


SQL = {
    "op12_vector_codes": _op12_sql(),
    "op7_additive_quantisation": """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
near AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])), lambda a, b: a + b)) AS score
  FROM good q JOIN good c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM near QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) <= 10""",
    "op4_ngram_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT reach.doc_id, pairs.b FROM reach JOIN pairs ON reach.r = pairs.a)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(r) AS component_id FROM sets JOIN reach USING (doc_id) GROUP BY ALL""",
    "op6_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
}
