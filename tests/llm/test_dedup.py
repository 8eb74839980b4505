import hashlib
import random

import pytest

from corvane.llm import exact_dedup, ngram_join, suffix_dedup
from corvane.llm.components import components

CLASH = {"_row": 1, "_uid": 2, "_key": "k", "node": 3, "sig": 4, "uid": 5}


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


# --- exact ---


def test_exact_groups(docs):
    got = exact_dedup.exact_groups(docs([(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b" * 100_000), (6, "b" * 100_000), (7, "B")]))
    assert rows(got, "doc_id", "keep_id", "group_size", "kept") == [(1, 2, 2, False), (2, 2, 2, True), (3, 4, 2, False), (4, 4, 2, True), (5, 6, 2, False), (6, 6, 2, True), (7, 7, 1, True)]
    assert {r["text_sha256"] for r in got.filter("doc_id in (1, 2)").collect()} == {hashlib.sha256(b"a").hexdigest()}


def test_exact_empty_and_repeats(docs):
    assert exact_dedup.exact_groups(docs([])).count() == 0
    got = exact_dedup.exact_groups(docs([(1, "a"), (1, "a"), (None, "a"), (None, "z")]))
    assert sorted(r["kept"] for r in got.filter("doc_id = 1").collect()) == [False, True]
    assert got.filter("doc_id is null and kept").count() == 1


def test_exact_keep_rows_keeps_columns(docs):
    table = docs([(1, "a", "en", "s"), (2, "a", "en", "s"), (3, None)], CLASH)
    got = exact_dedup.keep_rows(table)
    assert got.columns == table.columns and rows(got, "doc_id") == [(2,), (3,)]


def test_directory_doubles_until_buckets_fit():
    buckets = exact_dedup.directory({0: 5, 1: 5, 2: 1, 15: 40}, 6, max_depth=4)
    assert sum(16 >> d for _, d, _ in buckets) == 16
    assert all(n <= 6 or d == 4 for _, d, n in buckets) and sum(n for *_, n in buckets) == 51


def test_one_text_holds_a_third(docs):
    table = docs([(i, "same" if i % 3 == 0 else f"t{i}") for i in range(300)])
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(table).collect()}
    assert got[0]["group_size"] == 100 and got[0]["keep_id"] == 297 and got[1]["group_size"] == 1


# --- near ---


def brute(texts, k, percent):
    def grams(t):
        import re

        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        if not w:
            return frozenset()
        return frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))

    sets = {i: grams(t) for i, t in texts}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted((i, len(sets[i]), root(i)) for i in ids)


def families(seed, n, words=60, edits=6, common=False):
    """Texts that are edits of a few originals, with similarities around the threshold."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(4))
    line = [word() for _ in range(8)]
    origins = [[word() for _ in range(draw.randint(3, words))] for _ in range(4)]
    out = []
    for i in range(n):
        w = list(draw.choice(origins)) if draw.random() < 0.9 else [word() for _ in range(draw.randint(0, words))]
        for _ in range(draw.randint(0, edits) if len(w) > 12 else draw.randint(0, 1)):
            if w:
                w[draw.randrange(len(w))] = word()
        out.append((i, " ".join((line if common and draw.random() < 0.7 else []) + w)))
    return out


@pytest.mark.parametrize(("seed", "k", "percent", "common"), [(1, 3, 90, False), (2, 5, 80, True), (3, 3, 80, True)])
def test_near_groups_are_brute_force(docs, monkeypatch, seed, k, percent, common):
    monkeypatch.setattr(ngram_join, "COMMON", 4)
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", 20)
    texts = families(seed, 120, common=common) + [(900, None), (901, ""), (902, "one two"), (903, "ONE  two"), (904, "a"), (905, " \t\n")]
    got = ngram_join.near_groups(docs(texts), k, percent)
    assert rows(got, "doc_id", "n_shingles", "component_id") == brute(texts, k, percent)


def test_near_long_texts_count_by_fragments(docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "SEGMENT", 64)
    draw = random.Random(5)
    w = [f"w{draw.randrange(10**6)}" for _ in range(3000)]
    other = list(w)
    for i in range(0, 3000, 100):
        other[i] = "x"
    texts = [(1, " ".join(w)), (2, " ".join(other)), (3, " ".join(w[:2000]))]
    assert rows(ngram_join.near_groups(docs(texts), 3, 90), "doc_id", "component_id") == [(1, 1), (2, 1), (3, 3)]


def test_near_empty_and_keep_rows(docs):
    assert ngram_join.near_groups(docs([]), 3, 90).count() == 0
    text = " ".join(f"w{i}" for i in range(50))
    table = docs([(1, text), (2, text + " x"), (3, "other"), (4, None), (None, text)], CLASH)
    got = ngram_join.keep_rows(table, 5, 80)
    assert got.columns == table.columns and {r["doc_id"] for r in got.collect()} == {1, 3, 4, None}


def test_fragments_outnumber_differences():
    cuts = ngram_join.Cuts(80)
    for n in range(1, 400):
        for m in range(n, n * 100 // 80 + 1):
            d = (n + m) * 20 // 180
            both = {k[0]: k for k in cuts.keys(n)}.keys() & {k[0]: k for k in cuts.keys(m)}.keys()
            if d:
                assert any(min({k[0]: k[2] for k in cuts.keys(x)}[c] for x in (n, m)) >= d + 1 + {k[0]: k[3] for k in cuts.keys(n)}[c] for c in both), (n, m)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(1, 31), 1), 100: 100, 101: 100}


# --- repeated strings ---


def removed(texts, length):
    seen = {}
    raw = [(i, (t or "").encode()) for i, t in texts]
    for _, b in raw:
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]] = seen.get(b[p : p + length], 0) + 1
    out = []
    for i, b in raw:
        mark = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                mark[p : p + length] = b"\1" * length
        kept = bytes(c for c, m in zip(b, mark, strict=True) if not m)
        out.append((i, len(b), sum(mark), sum(1 for j, m in enumerate(mark) if m and not (j and mark[j - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_suffixes_are_brute_force(docs, seed):
    draw = random.Random(seed)
    noise = lambda n: "".join(draw.choice("ab cdé") for _ in range(n))
    passage, other = noise(700), noise(430)
    texts = [(i, noise(draw.randint(0, 500)) + passage[draw.randint(0, 300) :][: draw.randint(100, 700)] + noise(draw.randint(0, 300))) for i in range(25)]
    texts += [(50, other), (51, "x" + other[:-1] + "y"), (52, "ab" * 500), (53, None), (54, ""), (55, passage * 3), (56, noise(399)), (57, texts[0][1]), (58, "q" * 400), (59, "q" * 401)]
    got = suffix_dedup.deduplicated(docs(texts, CLASH))
    assert rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == removed(texts, 400)


def test_suffixes_empty_repeats_and_bytes(docs):
    assert suffix_dedup.deduplicated(docs([])).count() == 0
    text = "".join(random.Random(3).choice("abcdefgh ") for _ in range(450))
    got = suffix_dedup.deduplicated(docs([(1, text), (1, text), (2, "short")]), with_bytes=True)
    assert rows(got, "doc_id", "n_removed") == [(1, 450), (1, 450), (2, 0)]
    assert bytes(got.filter("doc_id = 2").first()["kept"]) == b"short"


def test_multikey_order():
    import numpy as np

    draw = np.random.default_rng(0)
    keys = [draw.integers(0, 3, 500) for _ in range(4)]
    order, run = suffix_dedup.multikey_order(keys)
    got = [tuple(k[i] for k in keys) for i in order]
    assert got == sorted(got)
    assert all((got[i] == got[i + 1]) == (run[i] == run[i + 1]) for i in range(499))


def test_suffix_workers_hold_a_bounded_share(spark, docs):
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    texts = ["".join(random.Random(i).choices("abcdefgh ", k=4_000)) for i in range(1_000)]
    batch = pa.RecordBatch.from_pydict({"_uid": list(range(len(texts))), "_text": texts})
    run = suffix_dedup._anchor_table(SimpleNamespace(mapInArrow=lambda f, _: f), 400)
    tracemalloc.start()
    try:
        found = sum(b.num_rows for b in run(iter([batch])))
        assert found > len(texts) and tracemalloc.get_traced_memory()[1] < 64 << 20
    finally:
        tracemalloc.stop()
    # Spark hands over few rows at once, and the session is left as it was.
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen, put = spark.conf.get(key), [], type(spark.conf).set
    type(spark.conf).set = lambda self, k, v: (seen.append((k, v)), put(self, k, v))[1]
    try:
        suffix_dedup.deduplicated(docs([(1, texts[0])]))
    finally:
        type(spark.conf).set = put
    assert any(k == key and int(v) <= 1_000 for k, v in seen) and spark.conf.get(key) == before
    got = suffix_dedup.merged(*(np.array(x) for x in ([0, 1, 0, 0, 1, 1], [5, 0, 0, 9, 3, 0], [9, 2, 3, 12, 7, 1])))
    assert [x.tolist() for x in got] == [[0, 0, 1, 1], [0, 5, 0, 3], [3, 12, 2, 7]]
