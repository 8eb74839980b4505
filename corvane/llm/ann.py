"""Approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of full-dimensional codewords, one from each codebook. The codebooks are learned on a bounded
sample (residual k-means, then least squares of each book with the others held); a beam search codes every vector. The norm of the
decoded vector is stored, so |q - x|^2 is |q|^2 - 2 (sum of table entries <q, c>) + norm: a lookup per book. The coding
error |x - decoded| is stored too: a row is no nearer than its decoded distance less its error. The best rows by codes
give a distance that k rows keep within; every row whose bound is not above it is then ranked by exact distance. So the
k nearest are found whatever the codes are worth; poor codes only rule out fewer rows.

Rows of codes and vectors stand in chunks and queries in blocks of bounded size; each pair of a chunk and a block gives a
query's k nearest rows of that chunk. Rows are dealt to chunks by a hash. Equal scores go to the smaller vec_id everywhere, so a vector that a third of the rows share
does no harm. Vectors that are null, zero, hold a null or non-finite component, or have another dimension than most
take no part. A null vec_id takes no part. Rows that repeat a vec_id are candidates and queries of their own. With fewer candidates
than `k` all are returned. No rows: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from corvane.llm.common import written

#: Rows that the codebooks are learned on at most, the smallest seeded hashes first.
SAMPLE = 8192
BOOKS, WORDS, BEAM, ROUNDS = 16, 256, 8, 2
CHUNK, BLOCK = 4096, 512
#: Bytes of vectors from which a chunk is closed early.
CHUNK_BYTES = 1 << 24


def usable(v: str) -> Column:
    """The vector takes part, its dimension aside."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(v).isNotNull() & F.coalesce(~bad, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes by beam search, and the decoded vectors."""
    n, (m, k, d) = len(x), books.shape
    cross = (books**2).sum(2)
    rest = x[:, None, :].astype(np.float32)  # residuals of the beams
    codes = np.zeros((n, 1, 0), np.uint8)
    for i in range(m):
        width = rest.shape[1]
        error = (rest**2).sum(2)[:, :, None] - 2 * (rest.reshape(-1, d) @ books[i].T).reshape(n, width, k) + cross[i]
        flat = error.reshape(n, -1)
        keep = min(beam, flat.shape[1]) if i < m - 1 else 1
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(flat.shape[1]), (n, 1))
        if keep == 1:
            best = flat.argmin(1)[:, None]
        of, word = best // k, best % k
        rest = np.take_along_axis(rest, of[:, :, None], 1) - books[i][word]
        codes = np.concatenate([np.take_along_axis(codes, of[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
    return codes[:, 0], x - rest[:, 0]


def learn(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    """Codebooks [book, word, dimension] for the sample x."""
    draw, (n, d) = np.random.default_rng(seed), x.shape
    words = min(words, max(1, n))
    out, rest = np.zeros((books, words, d), np.float32), x.astype(np.float32).copy()
    for i in range(books):
        centre = rest[draw.choice(n, words, replace=False)] + 0
        for _ in range(6):
            near = (-2 * rest @ centre.T + (centre**2).sum(1)).argmin(1)
            count = np.bincount(near, minlength=words)
            total = np.zeros((words, d), np.float32)
            np.add.at(total, near, rest)
            centre = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centre)
        near = (-2 * rest @ centre.T + (centre**2).sum(1)).argmin(1)
        out[i], rest = centre, rest - centre[near]
    for _ in range(rounds):  # least squares of the sample on its codes, book after book with the others held
        codes = np.concatenate([encode(x[i : i + 512], out)[0] for i in range(0, n, 512)])
        rest = x - sum(out[i][codes[:, i]] for i in range(books))
        for _ in range(3):
            for i in range(books):
                own = codes[:, i]
                rest += out[i][own]
                count = np.bincount(own, minlength=words)
                total = np.zeros((words, d), np.float32)
                np.add.at(total, own, rest)
                out[i] = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], out[i])
                rest -= out[i][own]
    return out


def train(vectors: DataFrame, limit: int = SAMPLE) -> np.ndarray | None:
    """Codebooks from at most `limit` vectors (columns vec_id, v)."""
    rows = vectors.orderBy(F.xxhash64("vec_id", F.lit(11)), "vec_id").limit(limit).toPandas().sort_values("vec_id")
    return learn(np.stack(rows["v"].to_numpy()).astype(np.float32)) if len(rows) else None


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, d)


def _kind(vectors: DataFrame) -> str:
    """How a chunk holds the components: exactly."""
    return "<f4" if isinstance(vectors.schema["v"].dataType.elementType, FloatType) else "<f8"


def index(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """Chunks: ids, codes, norms, coding errors and vectors of up to 2 x CHUNK rows, as bytes. Every row is coded."""
    share = vectors.sparkSession.sparkContext.broadcast(books)  # BOOKS x WORDS x dimension floats
    kind = _kind(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = share.value
        words, d = books.astype(np.float64), books.shape[2]
        ids, codes, norms, errors, own = kept = [], [], [], [], []

        def chunk() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([np.concatenate(x).tobytes()], pa.binary()) for x in kept], names=["ids", "codes", "norms", "errors", "own"])
            for x in kept:
                x.clear()
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _matrix(part.column("v"), d)
                code = encode(x.astype(np.float32), books)[0]
                decoded = sum(words[b][code[:, b]] for b in range(len(words)))
                ids.append(np.asarray(part.column("vec_id")).astype(np.int64))
                codes.append(code)
                norms.append((decoded**2).sum(1))
                errors.append(np.sqrt(((x - decoded) ** 2).sum(1)))
                own.append(x.astype(kind))
                if sum(map(len, ids)) >= 2 * CHUNK or sum(x.nbytes for x in own) >= CHUNK_BYTES:
                    yield chunk()
        if ids:
            yield chunk()

    parts = max(1, -(-vectors.count() // CHUNK))
    return vectors.select("vec_id", "v").repartition(parts, F.xxhash64("vec_id", F.lit(5))).mapInArrow(run, "ids binary, codes binary, norms binary, errors binary, own binary")


def _distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact distances of the rows of x from q, components summed in order."""
    total = np.zeros(len(x))
    for i in range(len(q)):
        total += (q[i] - x[:, i]) ** 2
    return np.sqrt(total)


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least scores in order, ties to the smaller id."""
    if len(score) > k:
        within = np.flatnonzero(score <= np.partition(score, k - 1)[k - 1])
        return within[np.lexsort((ids[within], score[within]))][:k]
    return np.lexsort((ids, score))


def _candidates(q: np.ndarray, x: np.ndarray, square: np.ndarray, there: np.ndarray, decoded: np.ndarray, errors: np.ndarray, k: int) -> np.ndarray:
    """Places among `there` that hold the k rows nearest to q, ties included. decoded: distances of the decoded rows."""
    if len(there) <= k:
        return there
    # Rounding is far below this share of the lengths; what is not a number is no reason to leave a row out.
    scale = np.sqrt(q @ q) + np.sqrt(square[there].max())
    best = there[np.argpartition(decoded[there], k - 1)[:k]]
    bound = _distances(q, x[best]).max() + 1e-6 * scale
    there = there[~(decoded[there] - errors[there] > bound)]
    rough = square[there] - 2 * ((x @ q)[there] if 4 * len(there) > len(x) else x[there] @ q)
    return there[~(rough > np.partition(rough, k - 1)[k - 1] + 1e-9 * scale**2)]


def search(vectors: DataFrame, queries: DataFrame, books: np.ndarray, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each query (vec_id, v), by exact distance."""
    spark, d, kind = vectors.sparkSession, books.shape[2], _kind(vectors)
    share = spark.sparkContext.broadcast(books)
    chunks = written(index(vectors, books), "codes")
    blocks = max(1, -(-queries.count() // BLOCK))
    asked = queries.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("vec_id", "v")).alias("asked"))
    asked = written(asked.select("asked"), "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = share.value.astype(np.float64)
        m = len(words)
        for batch in batches:
            for r in range(batch.num_rows):
                ids, norms, errors = (np.frombuffer(batch.column(c)[r].as_py(), t) for c, t in (("ids", np.int64), ("norms", np.float64), ("errors", np.float64)))
                codes = np.frombuffer(batch.column("codes")[r].as_py(), np.uint8).reshape(-1, m).T.astype(np.int64)
                x = np.frombuffer(batch.column("own")[r].as_py(), kind).reshape(-1, d).astype(np.float64)
                square = (x**2).sum(1)
                asked = batch.column("asked")[r].values
                who, q = np.asarray(asked.field("vec_id")), _matrix(asked.field("v"), d)
                out_q, out_v, out_s = [], [], []
                for i in range(len(who)):
                    table = words @ q[i]
                    decoded = norms + q[i] @ q[i]
                    for b in range(m):
                        decoded -= 2 * table[b][codes[b]]
                    there = _candidates(q[i], x, square, np.flatnonzero(ids != who[i]), np.sqrt(np.maximum(decoded, 0)), errors, k)
                    score = _distances(q[i], x[there])
                    top = _first(score, ids[there], k)
                    out_q.append(np.full(len(top), who[i]))
                    out_v.append(ids[there][top])
                    out_s.append(score[top])
                if out_q:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_q, out_v, out_s)], names=["query_id", "vec_id", "score"])

    found = chunks.crossJoin(asked).mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(table: DataFrame, every: int = 100, k: int = 10, vector: str = "embedding") -> DataFrame:
    """The k nearest rows of each row whose vec_id is divisible by `every`."""
    spark = table.sparkSession
    rows = table.select("vec_id", F.col(vector).alias("v")).filter(F.col("vec_id").isNotNull() & usable("v"))
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("v") == most["d"])
    return search(rows, rows.filter(F.col("vec_id") % every == 0), train(rows), k)
