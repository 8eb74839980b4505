"""N-gram Jaccard join by vertical partitioning.

A document's set is its distinct word shingles as 64-bit hashes, in one global order (that of the hashes). The order
is cut into fragments. Two sets of similarity p % differ in at most d = (|a| + |b|) (100 - p) / (100 + p) shingles, so
with more than d fragments they agree in a whole one: those are the candidates, found by fragment signatures. How
many fragments the order is cut into follows from the length class; a set near its class's end is also
cut for the next one. Candidate pairs are then counted fragment by fragment, in coarser cuts of the same order of
bounded size, and the partial overlaps are summed per pair.

Equal sets are one node. There are some fragments more than that, so similar sets agree in several: a set may
then leave out its empty fragments, and those whose signature very many documents share, if it has no more of both than there
are spare ones. Every node also has parity bits: a bit per cell of a cut of the order into about as many cells as it has shingles,
set where the cell holds an odd number of them. Two sets differ in no fewer shingles than their bits do, so most candidates
are ruled out exactly before any shingles move.

Three rounds test candidates. First, of a signature's nodes only the least and the greatest are paired with the others. Then,
for signatures whose nodes are still in different components, every such pair where they are few; where they are
many (unavoidably common signatures), the nodes are compared in blocks of bounded size, by their bits and then
with their overlaps counted for all pairs of a block at once; only links that join different components leave a
block. So no component is missed, and a large group of copies gives a number of rows linear in its size.

A set may be empty (null or empty text, no words): it links with nothing. With fewer than k words the whole
sequence is the only shingle. A row without doc_id links as any other and has its component's least doc_id, null where no
linked row has one; repeated rows are equal sets, and rows that repeat a
doc_id stay or go together. No rows: no rows.
Texts of any length are read whole. Extra columns are ignored by `near_groups` and kept by `keep_rows`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import blocks, discard, flat, written
from corvane.llm.components import components
from corvane.llm.kernels import U, mix, shingles, word_hashes

#: A length class ends at so many times its first size. Wide classes spare most sets a second one but have smaller fragments.
GROWTH = 2.25
#: Shingles that a fragment of the counting cut has on average at most.
SEGMENT = 4096
#: Documents that may share a signature before it counts as common.
COMMON = 32
#: Nodes and shingles of a block of the last round at most, on average over the blocks of a component.
BLOCK_NODES, BLOCK_GRAMS = 512, 1_000_000


class Cuts:
    """Length classes for a similarity of `percent`, and how many fragments each is cut into."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.growth = max(GROWTH, 110 / percent)
        self.starts = [1]

    def differ(self, a: int, b: int) -> int:
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def of(self, n: int) -> tuple[int, int, int]:
        """Class, its first and its last size."""
        while self.starts[-1] <= n:
            self.starts.append(max(self.starts[-1] + 1, int(self.starts[-1] * self.growth)))
        i = int(np.searchsorted(self.starts, n, side="right")) - 1
        return i, self.starts[i], self.starts[i + 1] - 1

    def keys(self, n: int) -> list[tuple[int, int, int, int]]:
        """(class, fragments, fragments that this set enters, empty ones it may leave out) for each class it enters."""
        out = []
        i, _, last = self.of(n)
        most = n * 100 // self.percent  # the largest partner
        while True:
            d = self.differ(last, last)
            if d:
                spare = 2 + d // 8
                own = self.differ(n, min(last, most))
                out.append((i, d + 1 + spare, min(d, own) + 1 + spare, spare))
            if most <= last:
                return out
            i, _, last = self.of(last + 1)


def signatures(u: np.ndarray, cuts: Cuts) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
    """For each class that the sorted shingle hashes `u` enter: the signatures of its fragments, and how many may be left out.

    Empty fragments are left out at once as far as they may be; what is left of the allowance is for common ones.
    """
    total = np.zeros(len(u) + 1, U)
    np.cumsum(mix(u), out=total[1:])
    out, spares = [], []
    for i, fragments, enter, spare in cuts.keys(len(u)):
        cut = ((u >> U(32)) * U(fragments)) >> U(32)
        at = np.searchsorted(cut, np.arange(enter + 1, dtype=U))
        sums, size = total[at[1:]] - total[at[:-1]], np.diff(at)
        # The last bit tells the class's parity, and so which of a set's two classes a signature is of.
        sig = mix(sums ^ mix(np.arange(enter, dtype=U) + U(i << 32))) >> U(1) << U(1) | U(i & 1)
        empty = size == 0
        gone = int(empty.sum())
        out.append(sig if gone > spare else sig[~empty])
        spares.append((i & 1, -1 if gone > spare else spare - gone))
    return out, spares


def _sets(part: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a block."""
    buf, off = flat(part.column("text"))
    h, row = shingles(*word_hashes(buf, off), k, len(off) - 1)
    at = np.searchsorted(row, np.arange(len(off)))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        u = np.sort(h[a:b])
        yield u[np.concatenate([[True], u[1:] != u[:-1]])] if len(u) else u


def _node(u: np.ndarray) -> int:
    """64 bits that stand for a set."""
    return int(mix(mix(u).sum(dtype=U, keepdims=True) + np.full(1, len(u), U) * U(0x9E3779B97F4A7C15)).view(np.int64)[0])


def parity_bits(u: np.ndarray) -> bytes:
    """A bit for each cell of the order of low bits, about as many cells as shingles: is their number there odd?"""
    cells = max(64, 1 << (len(u) - 1).bit_length())
    odd = np.bincount((u & U(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def bits_apart(a: bytes, b: bytes) -> int:
    """How many shingles two sets differ in at least. Bits for twice the cells are those for half of them by folding."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    m, n = len(a), len(b)
    while m > n:
        m //= 2
        x = x >> 8 * m ^ x & (1 << 8 * m) - 1
    while n > m:
        n //= 2
        y = y >> 8 * n ^ y & (1 << 8 * n) - 1
    return (x ^ y).bit_count()


def _sets_table(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n, node, parity bits, and an entry per class: the signatures and how many common ones may be left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = Cuts(percent)
        for part in blocks(batches):
            n, node, bits, sigs, spares, per_doc = [], [], [], [], [], []
            for u in _sets(part, k):
                n.append(len(u))
                node.append(_node(u) if len(u) else None)
                bits.append(parity_bits(u) if len(u) else None)
                own, spare = signatures(u, cuts)
                sigs += own
                spares += spare
                per_doc.append(len(own))
            inner = np.concatenate([[0], np.cumsum([len(s) for s in sigs])]).astype(np.int32)
            outer = np.concatenate([[0], np.cumsum(per_doc)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(inner), pa.array(np.concatenate(sigs).view(np.int64) if sigs else np.zeros(0, np.int64)))
            entries = pa.StructArray.from_arrays([lists, pa.array([x for x, _ in spares], pa.int32()), pa.array([x for _, x in spares], pa.int32())], names=["sigs", "entry", "spare"])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(bits, pa.binary()), pa.ListArray.from_arrays(pa.array(outer), entries)], names=["doc_id", "n", "node", "bits", "classes"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, node long, bits binary, classes array<struct<sigs: array<long>, entry: int, spare: int>>")


def _counting_cut(n: int, segment: int) -> int:
    """Fragments of the counting cut for pairs whose larger set has `n` shingles: a power of two."""
    return 1 << max(0, (n - 1) // segment).bit_length()


def _segments(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, n, cut, fragment, grams) of the sets that pairs ask for, in each cut that a partner may ask for."""
    segment = SEGMENT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            node, n, cut, fragment, grams = [], [], [], [], []
            for u in _sets(part, k):
                if not len(u):
                    continue
                own = _node(u)
                most, cuts = len(u) * 100 // percent, [_counting_cut(len(u), segment)]
                while cuts[-1] < _counting_cut(most, segment):
                    cuts.append(cuts[-1] * 2)
                for c in cuts:
                    at = np.searchsorted(((u >> U(32)) * U(c)) >> U(32), np.arange(c + 1, dtype=U))
                    for f in range(c):
                        node.append(own)
                        n.append(len(u))
                        cut.append(c)
                        fragment.append(f)
                        grams.append(u[at[f] : at[f + 1]].view(np.int64))
            columns = [pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(cut, pa.int32()), pa.array(fragment, pa.int32()), pa.array(grams, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "cut", "fragment", "grams"])

    return docs.mapInArrow(run, "node long, n long, cut int, fragment int, grams array<long>")


def _linked(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) that are similar enough: partial overlaps per fragment, summed per pair."""
    most = F.greatest("na", "nb")
    cut = F.lit(1)
    for bit in range(40):
        cut = F.when(most > F.lit(SEGMENT << bit), F.lit(2 << bit)).otherwise(cut) if bit < 30 else cut
    pairs = pairs.withColumn("_cut", cut.cast("int"))
    left = segments.select(F.col("node").alias("a"), F.col("cut").alias("_cut"), "fragment", F.col("grams").alias("_left"))
    right = segments.select(F.col("node").alias("b"), F.col("cut").alias("_cut"), "fragment", F.col("grams").alias("_right"))
    met = pairs.join(left, ["a", "_cut"]).join(right, ["b", "_cut", "fragment"])
    partial = met.select("a", "b", "fragment", "na", "nb", F.size(F.array_intersect("_left", "_right")).alias("_both"))
    # Rows that repeat a doc_id may give a segment twice; of its counts one is taken.
    total = partial.groupBy("a", "b", "fragment").agg(F.max("_both").alias("_both"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    total = total.groupBy("a", "b").agg(F.sum("_both").alias("both"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return total.filter(F.lit(100) * F.col("both") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b", "both", "na", "nb")


def _members(sets: DataFrame) -> DataFrame:
    """(sig, node, n): signatures that documents of different sets may share, without the common ones that a set may leave out."""
    shared = written(sets.select(F.explode(F.flatten("classes.sigs")).alias("sig")).groupBy("sig").count().filter("count > 1"), "shared-signatures")
    # Only signature and node move for every row; what belongs to a node's class is joined to the few rows that are left.
    rows = sets.select("node", F.explode(F.flatten("classes.sigs")).alias("sig"))
    met = written(rows.join(shared.hint("shuffle_hash"), "sig").select("sig", "node", "count").distinct(), "signature-members")
    discard(shared)
    about = sets.select("node", "n", F.explode("classes").alias("c")).groupBy("node", "c.entry").agg(F.first("n").alias("n"), F.first("c.spare").alias("spare"))
    met = written(met.withColumn("entry", F.col("sig").bitwiseAND(F.lit(1)).cast("int")).join(about, ["node", "entry"]), "signature-members")
    common = F.col("count") > COMMON
    many = met.filter(common).groupBy("node", "entry").agg(F.count(F.lit(1)).alias("_n"), F.first("spare").alias("_spare")).filter("_n > _spare").select(F.col("node").alias("_node"), F.col("entry").alias("_entry"))
    stay = met.filter(common).join(many, (F.col("node") == F.col("_node")) & (F.col("entry") == F.col("_entry")), "left_semi")
    out = written(met.filter(~common).unionByName(stay).select("sig", "node", "n"), "members")
    discard(met)
    return out


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) that neither sizes nor parity bits rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            most = (np.asarray(part.column("na")) + np.asarray(part.column("nb"))) * (100 - percent) // (100 + percent)
            ok = [bits_apart(x, y) <= d for x, y, d in zip(part.column("_x").to_pylist(), part.column("_y").to_pylist(), most.tolist(), strict=True)]
            yield part.select(["a", "b", "na", "nb"]).filter(pa.array(ok, pa.bool_()))

    bits = sets.filter("node is not null").groupBy("node").agg(F.first("bits").alias("bits"))
    near = pairs.filter(F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb"))
    wide = near.join(bits.select(F.col("node").alias("a"), F.col("bits").alias("_x")), "a").join(bits.select(F.col("node").alias("b"), F.col("bits").alias("_y")), "b")
    return wide.select("a", "b", "na", "nb", "_x", "_y").mapInArrow(run, "a long, b long, na long, nb long")


def _segments_of(nodes: DataFrame, sets: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The segments of the asked nodes, whose sets are read again, each from the documents of one doc_id.

    A node that only rows without doc_id have is read from those rows.
    """
    ids = sets.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(nodes.distinct(), "node", "left_semi").select("doc_id").distinct()
    texts = docs.select("doc_id", "text")
    found = texts.join(ids.filter("doc_id is not null"), "doc_id", "left_semi").select("text")
    if not ids.filter("doc_id is null").isEmpty():
        found = found.unionByName(texts.filter("doc_id is null").select("text"))
    return written(_segments(found, k, percent), "segments")


def _found(pairs: DataFrame, sets: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The links (a, b) among the pairs."""
    pairs = written(_possible(pairs, sets, percent), "pairs")
    segments = _segments_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), sets, docs, k, percent)
    out = written(_linked(pairs, segments, percent).select("a", "b"), "links")
    discard(segments)
    return out


def _labelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """`nodes` with the label of their component, their own where they have no link."""
    own = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
    return nodes.join(own, F.col("node") == F.col("_n"), "left").withColumn("label", F.coalesce("_l", "node")).drop("_n", "_l")


def _may_link(table: pa.Table, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of a left and a right row of a block have different labels and are ruled out by neither sizes nor bits."""
    label, n = (table.column(c).to_numpy() for c in ("label", "n"))
    raw = table.column("bits").to_pylist()
    size = np.array([len(x) for x in raw])
    out = np.zeros((len(left), len(right)), bool)
    for level in np.unique(size).tolist():

        def folded(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Places in `rows` of sets with bits of this level or twice as many, and their bits at this level."""
            at = np.flatnonzero((size[rows] == level) | (size[rows] == 2 * level))
            bits = np.zeros((len(at), level // 8), np.uint64)
            for i, r in enumerate(rows[at].tolist()):
                x = np.frombuffer(raw[r], np.uint64)
                bits[i] = x if len(raw[r]) == level else x[: level // 8] ^ x[level // 8 :]
            return at, bits

        (at, x), (to, y) = folded(left), folded(right)
        for i, own in zip(at.tolist(), x, strict=True):
            r, others = left[i], right[to]
            most = (n[r] + n[others]) * (100 - percent) // (100 + percent)
            ok = (label[others] != label[r]) & (100 * np.minimum(n[r], n[others]) >= percent * np.maximum(n[r], n[others])) & ((size[others] == level) | (size[r] == level))
            some = np.flatnonzero(ok)
            out[i, to[some]] = np.bitwise_count(y[some] ^ own).sum(1) <= most[some]
    return out


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Left and right rows of a group, and whether it compares a block with itself."""
    side = table.column("side").to_numpy()
    one = bool((side == 0).all())
    left = np.flatnonzero(side == 0)
    return left, left if one else np.flatnonzero(side == 1), one


def _open_nodes(grouped: DataFrame, percent: int) -> DataFrame:
    """Nodes (part, node) that some node of another label may be similar to, from rows (part, i, j, side, node, label, n, bits)."""

    def run(table: pa.Table) -> pa.Table:
        left, right, one = _sides(table)
        may = _may_link(table, left, right, percent)
        use = left[may.any(1)] if one else np.concatenate([left[may.any(1)], right[may.any(0)]])
        return table.select(["part", "node"]).take(pa.array(use))

    return grouped.groupBy("part", "i", "j").applyInArrow(run, "part long, node long").distinct()


def _block_links(grouped: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different labels in each component of candidates, from rows that have grams too."""

    def run(table: pa.Table) -> pa.Table:
        left, right, one = _sides(table)
        side, node, label = (table.column(c).to_numpy() for c in ("side", "node", "label"))
        grams = table.column("grams").combine_chunks()
        n = grams.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        rows = len(node)
        place = np.zeros(rows, np.int64)
        place[left] = np.arange(len(left))
        if not one:
            place[right] = np.arange(len(right))
        share = _may_link(table, left, right, percent)
        if one:
            share &= np.tri(rows, k=-1, dtype=bool)
        if not share.any():
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        na, nb = n[left][:, None], n[right][None, :]
        use_a, use_b = share.any(1), share.any(0)
        value, of = np.asarray(grams.flatten()), np.repeat(np.arange(rows), n)
        _, column, count = np.unique(value, return_inverse=True, return_counts=True)
        use = count[column] > 1
        _, column = np.unique(column[use], return_inverse=True)
        of = of[use]
        both = np.zeros(share.shape, np.float32)
        step = 4096  # columns at a time: a fragment of the order, whose partial overlaps are added
        order = np.argsort(column, kind="stable")
        column, of = column[order], of[order]
        edge = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + step + 1, step))
        for x, y in zip(edge[:-1], edge[1:], strict=True):
            c, r = column[x:y] % step, of[x:y]
            m = np.zeros((len(left), step), np.float32)
            s = side[r] == 0
            m[place[r[s]], c[s]] = 1
            o = m
            if not one:
                o = np.zeros((len(right), step), np.float32)
                o[place[r[~s]], c[~s]] = 1
            both[np.ix_(use_a, use_b)] += m[use_a] @ o[use_b].T
        share &= 100 * both >= percent * (na + nb - both)
        a, b = np.nonzero(share)
        parent: dict[int, int] = {}

        def root(v: int) -> int:
            while parent.setdefault(v, v) != v:
                parent[v] = v = parent[parent[v]]
            return v

        out = []
        for x, y in zip(left[a].tolist(), right[b].tolist(), strict=True):
            p, q = root(int(label[x])), root(int(label[y]))
            if p != q:
                parent[p] = q
                out.append((int(node[x]), int(node[y])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return grouped.groupBy("part", "i", "j").applyInArrow(run, "a long, b long")


def _blocked(rows: DataFrame) -> DataFrame:
    """Rows (part, node, n, ...) dealt to pairs of blocks (part, i, j, side) of their component."""
    size = rows.groupBy("part").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.ceil(F.sum("n") / BLOCK_GRAMS)).cast("int").alias("_b"))
    rows = rows.join(size, "part").withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_b")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    rows = rows.withColumns({"i": F.least("_own", "_other"), "j": F.greatest("_own", "_other"), "side": F.when(F.col("_own") <= F.col("_other"), 0).otherwise(1)})
    return rows.drop("_b", "_own", "_other")


def _ordered(a: str, b: str, na: str, nb: str) -> list:
    """Columns a, b, na, nb with the smaller node first."""
    first = F.col(a) < F.col(b)
    return [F.when(first, F.col(x)).otherwise(F.col(y)).alias(c) for c, x, y in (("a", a, b), ("b", b, a), ("na", na, nb), ("nb", nb, na))]


def links(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(sets, labels): a row per document (doc_id, n, node, bits); the components of linked nodes (node, label)."""
    wide = written(_sets_table(docs, k, percent), "shingle-sets")
    sets, members = written(wide.select("doc_id", "n", "node", "bits"), "sets"), _members(wide)
    discard(wide)
    # First round: the ends of each signature with its other nodes.
    groups = members.groupBy("sig").agg(F.min(F.struct("node", "n")).alias("lo"), F.max(F.struct("node", "n")).alias("hi"), F.count(F.lit(1)).alias("m"))
    groups = written(groups.filter("m > 1"), "signature-ends")
    star = members.join(groups, "sig").select("node", "n", F.explode(F.array("lo", "hi")).alias("end")).select("node", "n", F.col("end.node").alias("_e"), F.col("end.n").alias("_en")).filter("node <> _e")
    found = _found(star.select(*_ordered("node", "_e", "n", "_en")).distinct(), sets, docs, k, percent)
    labels = components(found)
    # Second round: signatures of few nodes that are still in different components, all pairs between those.
    marked = written(_labelled(members.join(groups.filter("m > 2").select("sig", "m"), "sig"), labels), "members-labelled")
    discard(members)
    mixed = marked.groupBy("sig").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).filter("_lo < _hi").select("sig")
    marked = marked.join(mixed, "sig", "left_semi")
    few = marked.filter(F.col("m") <= COMMON)
    other = few.select("sig", F.col("node").alias("_e"), F.col("n").alias("_en"), F.col("label").alias("_el"))
    pairs = few.join(other, "sig").filter("node < _e and label <> _el").select(F.col("node").alias("a"), F.col("_e").alias("b"), F.col("n").alias("na"), F.col("_en").alias("nb")).distinct()
    more = _found(pairs, sets, docs, k, percent)
    if not more.isEmpty():
        found = found.unionByName(more)
        labels = components(found)
    # Last round: signatures of many nodes, in blocks of the components that these signatures connect.
    many = written(marked.filter(F.col("m") > COMMON).select("sig", "node"), "common-members")
    if many.isEmpty():
        return sets, labels
    least = many.groupBy("sig").agg(F.min("node").alias("a"))
    parts = components(many.join(least, "sig").select("a", F.col("node").alias("b")).distinct()).select("node", F.col("label").alias("part"))
    nodes = _labelled(parts, labels).join(sets.filter("node is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits")), "node")
    nodes = written(nodes, "candidates")
    mixed = nodes.groupBy("part").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).filter("_lo < _hi").select("part")
    open_ = written(_open_nodes(_blocked(nodes.join(mixed, "part", "left_semi")), percent), "candidates-open")
    if open_.isEmpty():
        return sets, labels
    segments = _segments_of(open_.select("node"), sets, docs, k, percent)
    grams = segments.dropDuplicates(["node", "cut", "fragment"])
    grams = grams.join(grams.groupBy("node").agg(F.min("cut").alias("cut")), ["node", "cut"]).groupBy("node").agg(F.flatten(F.collect_list("grams")).alias("grams"))
    last = written(_block_links(_blocked(nodes.join(open_, ["part", "node"], "left_semi").join(grams, "node")), percent), "links")
    discard(segments)
    if not last.isEmpty():
        labels = components(found.unionByName(last))
    return sets, labels


def near_groups(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id (least doc_id reachable), class_id (its set)."""
    sets, labels = links(docs, k, percent)
    marked = _labelled(sets.select("doc_id", "n", "node"), labels)
    marked = written(marked, "sets-marked")
    least = written(marked.filter("label is not null").groupBy(F.col("label").alias("_l")).agg(F.min("doc_id").alias("_least")), "least-ids")
    out = marked.join(least, F.col("label") == F.col("_l"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("_least", "doc_id").alias("component_id"), F.col("node").alias("class_id"))


def keep_rows(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` of which each component keeps the one with the least doc_id, with their columns as they came."""
    groups = near_groups(docs, k, percent)
    gone = groups.filter("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"))
    return rows.join(gone, F.col("_id") == F.col("_gone"), "left_anti").select("_row.*")
