"""Full-text search: postings of two weighted columns and BM25 with exact and prefix clauses.

Score of a document for a clause: idf x f (k1 + 1) / (f + k1 (1 - b + b length / mean length)), where f is the sum
of the columns' term counts by weight, and idf is ln((N - n + 0.5) / (n + 0.5)), at least 1e-6. Clauses add up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import PREFIX
from corvane.session import kept

K1, B, IDF_LEAST = 1.2, 0.75, 1e-6
WEIGHTS = {"terms": 4.0, "literals": 1.0}
#: Asked clauses that every task holds at most.
HELD = 200_000


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def occurrences(docs: DataFrame, columns: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(occurrences, lengths) of docs (id and the columns): (term, id, f), a row for each token with f the weight of its column, and (id, length) unweighted.

    `bm25` adds them up after it has dropped those that no clause asks for, so a question on an index that isn't stored counts only its own terms.
    """
    columns = columns or WEIGHTS
    own = F.explode(F.array(*(F.struct(tokens(F.col(c)).alias("t"), F.lit(w).alias("f")) for c, w in columns.items())))
    every = docs.select("id", own.alias("_c")).select("id", F.explode("_c.t").alias("term"), "_c.f")
    length = sum((F.size(tokens(F.col(c))) for c in columns), F.lit(0))
    return every.select("term", "id", "f"), docs.select("id", length.alias("length"))


def _weighted(words: Column, weight: float) -> Column:
    return F.transform(words, lambda t: F.struct(t.alias("term"), F.lit(weight).alias("f")))


def worded(docs: DataFrame, columns: dict[str, float], own: tuple[str, ...] = ()) -> DataFrame:
    """(id, own columns, length, _words): each document's tokens as an array of (term, f) with f the weight of its column; every text is cut once."""
    names = {c: f"_t{i}" for i, c in enumerate(columns)}
    cut = docs.select("id", *own, *(tokens(F.col(c)).alias(n) for c, n in names.items()))
    words = F.concat(*(_weighted(F.col(names[c]), w) for c, w in columns.items()))
    return cut.select("id", *own, sum((F.size(n) for n in names.values()), F.lit(0)).alias("length"), words.alias("_words"))


def counted(docs: DataFrame, columns: dict[str, float] | None = None, own: tuple[str, ...] = ()) -> DataFrame:
    """(term, id, own columns, f, length): the postings of docs whose ids are distinct, added up within each row, so that no token is shuffled."""
    return summed(worded(docs, columns or WEIGHTS, own))


def summed(rows: DataFrame) -> DataFrame:
    """`counted` of what `worded` gives. A row that says no word twice has its postings already; only others are sorted and added up."""
    rows = rows.filter(F.size("_words") > 0).withColumn("_once", F.size(F.array_distinct("_words.term")) == F.size("_words"))
    rows = rows.withColumn("_words", F.when(F.col("_once"), F.col("_words")).otherwise(F.sort_array("_words")))
    begins = F.filter(F.sequence(F.lit(0), F.size("_words") - 1), lambda i: (i == 0) | (F.get("_words", i)["term"] != F.get("_words", i - 1)["term"]))
    rows = rows.withColumn("_at", F.when(~F.col("_once"), begins))

    def posting(at: Column, i: Column) -> Column:
        many = F.coalesce(F.get("_at", i + 1), F.size("_words")) - at
        return F.struct(F.get("_words", at)["term"].alias("term"), F.aggregate(F.slice("_words", at + 1, many), F.lit(0.0), lambda s, x: s + x["f"]).alias("f"))

    own = [c for c in rows.columns if c not in ("_words", "_once", "_at", "length")]
    found = F.when(F.col("_once"), F.col("_words")).otherwise(F.transform("_at", posting))
    return rows.select(*own, "length", F.inline_outer(found)).select("term", *own, "f", "length")


def postings(docs: DataFrame, columns: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) of docs (id and the columns): (term, id, f) with f weighted, and (id, length) unweighted."""
    every, lengths = occurrences(docs, columns)
    return every.groupBy("term", "id").agg(F.sum("f").alias("f")), lengths


def clauses(terms: DataFrame) -> DataFrame:
    """Rows (query_id, term, is_prefix) of a table (query_id, clauses)."""
    return terms.select("query_id", F.explode("clauses").alias("c")).select("query_id", "c.term", "c.is_prefix").distinct()


def bm25(found: DataFrame, lengths: DataFrame | None, asked: DataFrame, corpus: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """(query_id, id, score) for all documents that meet a clause of `asked` (query_id, term, is_prefix), or for the k best of each query (`top` of the scores at nine digits).

    Postings that carry their document's length need no `lengths`, and `corpus` (n_docs, mean: one row) then.

    Postings (or occurrences) are read once: each is offered as its word and, where it is long enough, as its prefix, and stays where a clause asks for
    it. A prefix clause is one term whose count is the sum over the words that begin with it; prefixes have a fixed length, so
    they too are an equi-join. What meets a clause, and the lengths, are written tables, since both are counted and then joined. Up to
    `HELD` clauses are sent to every task; what meets them is dealt by document, so that a query's clauses add up, and with k all but the k best of each
    part go, where the document lies: pairs of query and document are never shuffled.
    """
    own = ["length"] if lengths is None else []
    asked = kept(asked.select("query_id", F.col("term").alias("clause"), "is_prefix"))
    sent = F.broadcast if asked.count() <= HELD else lambda df: df
    word, begun = (F.struct(c.alias("clause"), F.lit(p).alias("is_prefix")) for c, p in ((F.col("term"), False), (F.substring("term", 1, PREFIX), True)))
    offers = F.when(F.length("term") >= PREFIX, F.array(word, begun)).otherwise(F.array(word))
    kinds = asked.select("clause", "is_prefix").distinct()
    if sent is F.broadcast:  # most words begin as no clause does, and are offered as nothing
        begins = kinds.select(F.substring("clause", 1, PREFIX).alias("_begin")).distinct()
        found = found.join(sent(begins), F.substring("term", 1, PREFIX) == F.col("_begin"), "left_semi")
    offered = found.select("id", "f", *own, F.explode(offers).alias("_o")).select("_o.clause", "_o.is_prefix", "id", "f", *own)
    hits = kept(offered.join(sent(kinds), ["clause", "is_prefix"]).groupBy("clause", "is_prefix", "id").agg(F.sum("f").alias("f"), *(F.first(c).alias(c) for c in own)))
    spread = hits.groupBy("clause", "is_prefix").agg(F.count(F.lit(1)).alias("n"))
    lengths = None if lengths is None else kept(lengths)
    if corpus is None:
        corpus = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("mean"))
    hits = hits.repartition("id")
    hits = (hits.join(lengths, "id") if lengths is not None else hits).join(sent(asked.join(spread, ["clause", "is_prefix"])), ["clause", "is_prefix"]).crossJoin(F.broadcast(corpus))  # one row
    idf = F.greatest(F.ln((F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(IDF_LEAST))
    part_score = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scores = hits.select("query_id", "id", part_score.alias("s")).groupBy("query_id", "id").agg(F.sum("s").alias("score"))
    return scores if k is None else top(scores.withColumn("score", F.round("score", 9)), k).drop("rank")


def top(scores: DataFrame, k: int) -> DataFrame:
    """The k best of each query, ties to the smaller id."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= k)


def normalised(scores: DataFrame, k: int = 500) -> DataFrame:
    """The k best of each query as a share of its best; no rows where the best is 0 or less."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return top(scores, k).withColumn("_best", best).filter("_best > 0").select("query_id", "id", F.least(F.lit(1.0), F.col("score") / F.col("_best")).alias("lexical"))


def paths_with_terms(files: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, path): the k shortest paths that contain a term of `asked` (query_id, terms), case-free.

    A path that contains a term contains its first `PREFIX` letters: the paths' pieces of that length meet them in an equi-join. Terms of
    tasks are no shorter; a shorter one, of whatever length, meets pieces of its own length.
    """
    terms = asked.select("query_id", F.explode("terms").alias("_t")).select("query_id", F.lower("_t").alias("_t")).filter("_t <> ''").distinct()
    terms = terms.withColumn("_piece", F.substring("_t", 1, PREFIX))
    low = F.lower("path")
    begins = F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1)))
    long = files.select("path").distinct().select("path", F.explode(F.array_distinct(F.transform(begins, lambda i: F.substring(low, i, F.lit(PREFIX))))).alias("_piece"))
    met = long.join(terms.filter(F.length("_piece") == PREFIX), "_piece").filter(F.lower("path").contains(F.col("_t"))).select("query_id", "path")
    sizes = terms.filter(F.length("_piece") < PREFIX).select(F.length("_piece").alias("_size")).distinct()  # a row for each of the lengths below PREFIX at most
    short = long.select("path", "_piece").join(F.broadcast(sizes), F.length("_piece") >= F.col("_size")).select("path", F.substring(F.col("_piece"), F.lit(1), F.col("_size")).alias("_piece")).distinct()
    met = met.unionByName(short.join(terms.filter(F.length("_piece") < PREFIX), "_piece").select("query_id", "path")).distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.length("path"), "path"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "path", "rank")


def lexicon(groups: DataFrame) -> DataFrame:
    """(term, synonym) of groups of synonyms (column words, an array): each word of a group stands for its others. Groups that share a word aren't one."""
    low = groups.select(F.array_distinct(F.transform("words", lambda w: F.lower(F.trim(w)))).alias("_g"))
    pairs = low.select("_g", F.explode("_g").alias("term")).select("term", F.explode("_g").alias("synonym"))
    return pairs.filter("term <> synonym and term <> '' and synonym <> ''").distinct()


def expand_terms(terms: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(query_id, term): the terms and their synonyms of a symmetric lexicon (term, synonym)."""
    both = lexicon.select("term", "synonym").unionByName(lexicon.select(F.col("synonym").alias("term"), F.col("term").alias("synonym"))).distinct()
    more = terms.join(both, "term").select("query_id", F.col("synonym").alias("term"))
    return terms.select("query_id", "term").unionByName(more).distinct()
