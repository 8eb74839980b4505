"""Removal of long repeated byte strings by a range-partitioned sparse suffix array.

Every window of `length` bytes has one anchor: its least GRAM-byte string by hash, the first of equals. Equal windows have
equal anchors at equal places, so the suffixes that begin at anchors stand for all. They are range-partitioned by
their leading tokens (the GRAM bytes at the anchor, as big-endian words) with splitters that Spark samples;
each bucket sorts its suffixes by multikey quicksort and compares neighbours; runs at the ends of buckets are
compared across boundaries. So each bucket holds a bounded share even if a third of all suffixes are equal.

Suffixes without an equal neighbour are done. For the others, whether a window is repeated is settled exactly, by
comparing 64-bit hashes of strings: the windows of an anchor are dealt into spans; if the string over a whole
span repeats, all of its windows do; if the string that they have in common does not, none does; other spans are cut finer, down to
single windows, together with one of each kind of settled span that may share windows with them. Counts are pre-aggregated, so no task ever holds a group of equal strings.

Bytes are the text's UTF-8; a null text is empty. Matches never cross documents; texts under `length` bytes lose
nothing. Repeated rows are documents of their own, so all their windows repeat. A very long text is
one row. No rows: no rows. Texts are numbered once, in a written table that every step reads, so it doesn't matter where
`docs` comes from and whether Spark computes it again. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import ARROW_ROWS, blocks, discard, flat, partitions, setting, written
from corvane.llm.kernels import U, mix, prefix_hash, rolling, span_hash

LENGTH, GRAM = 400, 64
#: Windows per span, level by level.
WIDTHS = (128, 16, 4, 1)
#: Bytes of text that a worker takes at a time, each of which costs it some 150 bytes of arrays, and rows that Spark hands to it at once.
BLOCK, ROWS = 1 << 18, 1_000
_KEYS = [f"k{i}" for i in range(GRAM // 8)]
_ANCHOR = "uid long, pos int, lo short, hi short, " + ", ".join(f"{k} long" for k in _KEYS)


def anchors(buf: np.ndarray, off: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, first window, last window) of each run of windows with one anchor; places are in `buf`."""
    none = np.zeros(0, np.int64)
    size = np.diff(off)
    if not len(size) or size.max() < length:
        return none, none, none, none
    n = len(buf) - GRAM + 1
    key = (rolling(buf, GRAM) & U(0xFFFFFFFF00000000)) | np.arange(n, dtype=U)
    w = length - GRAM + 1
    padded = np.full(-(-n // w) * w + w, np.iinfo(np.uint64).max, U)
    padded[:n] = key
    tiles = padded.reshape(-1, w)
    left = np.minimum.accumulate(tiles, axis=1).ravel()
    right = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - w + 1  # windows that lie in the block
    least = np.minimum(right[:starts], left[w - 1 : w - 1 + starts])
    rows = np.flatnonzero(size >= length)
    count = size[rows] - length + 1
    row = np.repeat(rows, count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(off[:-1][rows], count)
    anchor = (least[place] & U(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]))
    end = np.concatenate([new[1:], [len(place)]]) - 1
    return row[new], anchor[new], place[new], place[end]


def _words(buf: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The GRAM bytes at each place as signed words in the order of the bytes."""
    raw = buf[at[:, None] + np.arange(GRAM)]
    words = np.ascontiguousarray(raw).view(">u8").astype(U) ^ U(1 << 63)
    return [np.ascontiguousarray(words[:, i]).view(np.int64) for i in range(GRAM // 8)]


def _anchor_table(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "_text", BLOCK):
            buf, off = flat(part.column("_text"))
            row, anchor, first, last = anchors(buf, off, length)
            uid = np.asarray(part.column("_uid"))[row] if len(row) else np.zeros(0, np.int64)
            words = _words(buf, anchor) if len(row) else [np.zeros(0, np.int64)] * len(_KEYS)
            columns = [uid, (anchor - off[row]).astype(np.int32), (anchor - last).astype(np.int16), (anchor - first).astype(np.int16), *words]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["uid", "pos", "lo", "hi", *_KEYS])

    return docs.mapInArrow(run, _ANCHOR)


def multikey_order(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order by words, each further word sorting only what the words before left tied; and the runs of equals."""
    order = np.argsort(keys[0], kind="quicksort")
    run = np.concatenate([[0], np.cumsum(keys[0][order][1:] != keys[0][order][:-1])]) if len(order) else np.zeros(0, np.int64)
    for key in keys[1:]:
        size = np.bincount(run) if len(run) else np.zeros(0, np.int64)
        tied = np.flatnonzero(size[run] > 1) if len(run) else run
        if not len(tied):
            break
        inner = np.lexsort((key[order[tied]], run[tied]))
        order[tied] = order[tied[inner]]
        value = key[order]
        run = np.concatenate([[0], np.cumsum((run[1:] != run[:-1]) | ((value[1:] != value[:-1]) & (size[run[1:]] > 1)))])
    return order, run


def _repeated_anchors(table: DataFrame) -> DataFrame:
    """The anchors whose leading tokens stand at another anchor too."""
    spark = table.sparkSession
    dealt = table.repartitionByRange(partitions(spark), *_KEYS, F.xxhash64("uid", "pos"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if whole is None or not whole.num_rows:
            return
        keys = [whole.column(k).to_numpy() for k in _KEYS]
        order, group = multikey_order(keys)
        size = np.bincount(group)
        equal = size[group] > 1  # a neighbour in the bucket has the same leading tokens
        edge = (group == 0) | (group == group[-1])
        use = equal | edge
        kept = whole.take(pa.array(order[use]))
        for name in _KEYS:  # the tokens are needed across boundaries only
            at = kept.schema.get_field_index(name)
            kept = kept.set_column(at, name, pc.if_else(pa.array(edge[use]), kept.column(name), pa.scalar(None, pa.int64())))
        # A run at an end of the bucket is told once, by its first suffix, to the buckets beside it.
        tells = edge & np.concatenate([[True], group[1:] != group[:-1]])
        kept = kept.append_column("equal", pa.array(equal[use])).append_column("edge", pa.array(edge[use])).append_column("tells", pa.array(tells[use]))
        yield from kept.to_batches(max_chunksize=50_000)

    marked = written(dealt.mapInArrow(run, _ANCHOR + ", equal boolean, edge boolean, tells boolean"), "suffixes")
    across = marked.filter("tells").groupBy(*_KEYS).count().filter("count > 1").drop("count")  # at most two rows a bucket
    over = marked.filter("edge and not equal").join(F.broadcast(across), _KEYS, "left_semi")
    names = ["uid", "pos", "lo", "hi"]
    return marked.filter("equal").select(*names).unionByName(over.select(*names))


def _context_table(docs: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """The bytes under the windows of each anchor: uid, pos, lo, hi, bytes."""
    by_doc = found.groupBy("uid").agg(F.collect_list(F.struct("pos", "lo", "hi")).alias("_at"))  # bounded by the text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "_text", BLOCK):
            text, at = part.column("_text").cast(pa.binary()), part.column("_at")
            count = np.asarray(at.value_lengths())
            inner = at.flatten()
            pos, lo, hi = (np.asarray(inner.field(i)).astype(np.int64) for i in range(3))
            row = np.repeat(np.arange(len(count)), count)
            raw = text.to_pylist()
            data = [raw[r][p - h : p - a + length] for r, p, a, h in zip(row.tolist(), pos.tolist(), lo.tolist(), hi.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(part.column("_uid"))[row]), pa.array(pos.astype(np.int32)), pa.array(lo.astype(np.int16)), pa.array(hi.astype(np.int16)), pa.array(data, pa.binary())], names=["uid", "pos", "lo", "hi", "bytes"])

    joined = docs.join(by_doc, F.col("_uid") == F.col("uid")).select("_uid", "_text", "_at")
    return written(joined.mapInArrow(run, "uid long, pos int, lo short, hi short, bytes binary"), "contexts")


def _spans(context: DataFrame, level: int, length: int) -> DataFrame:
    """(uid, pos, first, last, common, whole): the spans of windows at this level, with hashes of what the windows
    have in common and of what they cover. A column `of` lists the spans of the level before that are cut here."""
    width, before = WIDTHS[level], WIDTHS[level - 1] if level else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "bytes", BLOCK):
            buf, off = flat(part.column("bytes"))
            prefix = prefix_hash(buf)
            lo, hi = (np.asarray(part.column(c)).astype(np.int64) for c in ("lo", "hi"))
            if before is None:
                start = lo // width
                count = hi // width - start + 1
                row = np.repeat(np.arange(len(lo)), count)
                first = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + start[row]) * width
            else:
                of = part.column("of")
                many = np.asarray(of.value_lengths())
                outer, steps = np.asarray(of.flatten()).astype(np.int64), before // width
                row = np.repeat(np.repeat(np.arange(len(lo)), many), steps)
                first = np.repeat(outer, steps) + np.tile(np.arange(steps), len(outer)) * width
                meets = (first <= hi[row]) & (first + width - 1 >= lo[row])
                row, first = row[meets], first[meets]
            last = first + width - 1
            a, b = np.maximum(first, lo[row]), np.minimum(last, hi[row])
            origin = off[:-1][row] + hi[row]  # where the anchor stands in the bytes
            where = mix(first.astype(U) << U(16) | U(level))
            common = span_hash(prefix, origin - first, origin - last + length) ^ where
            whole = span_hash(prefix, origin - b, origin - a + length) ^ mix(a.astype(U) << U(32) | b.astype(U) << U(16) | U(level + 64))
            columns = [np.asarray(part.column("uid"))[row], np.asarray(part.column("pos"))[row], a.astype(np.int16), b.astype(np.int16), first.astype(np.int16), common.view(np.int64), whole.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["uid", "pos", "a", "b", "first", "common", "whole"])

    return context.mapInArrow(run, "uid long, pos int, a short, b short, first short, common long, whole long")


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(uid, start, end): byte spans whose union is what is covered by repeated windows. `docs` has _uid and _text."""
    table = written(_anchor_table(docs, length), "anchors")
    found = _repeated_anchors(table)
    discard(table)
    context = _context_table(docs, found, length)
    out, rest = [], context
    for level, width in enumerate(WIDTHS):
        spans = written(_spans(rest, level, length), f"spans-{width}")
        # What spans cover: how often, and one of each kind. Both counts are pre-aggregated before the shuffle.
        kinds = spans.groupBy("whole").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("uid", "pos", "first", "common")).alias("_one")).filter("_n > 1")
        kinds = written(kinds.select(F.col("whole").alias("_w"), "_one"), "repeated-wholes")
        full = spans.join(kinds.select("_w"), F.col("whole") == F.col("_w"), "left_semi")
        out.append(full.select("uid", (F.col("pos") - F.col("b")).alias("start"), (F.col("pos") - F.col("a") + length).alias("end")))
        if width == 1:
            break
        again = spans.groupBy("common").count().filter("count > 1").select(F.col("common").alias("_h"))
        some = spans.join(kinds.select("_w"), F.col("whole") == F.col("_w"), "left_anti").join(written(again, "repeated-parts"), F.col("common") == F.col("_h"), "left_semi")
        some = written(some.select("uid", "pos", "first", "common"), "spans-open")
        # Of those settled as repeated, one of each kind goes on where an open span may share some of its windows.
        one = kinds.select("_one.*").join(some.select(F.col("common").alias("_c")).distinct(), F.col("common") == F.col("_c"), "left_semi")
        cut = written(some.unionByName(one).groupBy("uid", "pos").agg(F.collect_set("first").alias("of")), "spans-cut")  # few per anchor
        # Later levels cut only what this one leaves open, so the other bytes are not moved again.
        rest, before = written(rest.drop("of").join(cut.hint("shuffle_hash"), ["uid", "pos"]), "contexts"), rest
        discard(before)
    spans = out[0]
    for more in out[1:]:
        spans = spans.unionByName(more)
    return spans


def merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the maximal runs that spans cover, in order; spans of a row that touch are one run."""
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    if not len(row):
        return row, start, end
    wide = end.max() + 1  # so that no span reaches into the next row
    reach = np.maximum.accumulate(row * wide + end) - row * wide
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] > reach[:-1])]))
    return row[new], start[new], reach[np.concatenate([new[1:], [len(row)]]) - 1]


def deduplicated(docs: DataFrame, length: int = LENGTH, with_bytes: bool = False) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes if asked)."""
    with setting(docs.sparkSession, ARROW_ROWS, str(ROWS)):
        return written(_removed(docs, length, with_bytes), "removed")


def _removed(docs: DataFrame, length: int, with_bytes: bool) -> DataFrame:
    texts = written(docs.select(F.monotonically_increasing_id().alias("_uid"), F.coalesce("text", F.lit("")).alias("_text"), "doc_id"), "texts")
    spans = written(repeated_spans(texts.select("_uid", "_text"), length), "repeated-spans")
    by_doc = written(spans.groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("_cut")), "cuts")  # bounded by the text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, "_text", BLOCK):
            buf, off = flat(part.column("_text"))
            cut, n = part.column("_cut"), part.num_rows
            spans = cut.flatten()
            row = np.repeat(np.arange(n), np.asarray(cut.value_lengths().fill_null(0)))
            row, start, end = merged(row, *(np.asarray(spans.field(i)).astype(np.int64) for i in range(2)))
            removed = np.zeros(n, np.int64)
            np.add.at(removed, row, end - start)
            first = np.searchsorted(row, np.arange(n + 1))
            sha, kept = [], []
            for i in range(n):
                text, runs = memoryview(buf[off[i] : off[i + 1]]), slice(first[i], first[i + 1])
                left = [text[a:b] for a, b in zip([0, *end[runs].tolist()], [*start[runs].tolist(), len(text)], strict=True)]
                digest = hashlib.sha256()
                for piece in left:
                    digest.update(piece)
                sha.append(digest.hexdigest())
                if with_bytes:
                    kept.append(b"".join(left))
            columns = [part.column("doc_id"), pa.array(np.diff(off)), pa.array(removed), pa.array(np.diff(first)), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept, pa.binary())] if with_bytes else []), names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_bytes])

    joined = texts.join(by_doc, F.col("_uid") == F.col("uid"), "left").select("doc_id", "_text", "_cut")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes)
