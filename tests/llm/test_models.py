import random

import numpy as np
import pytest
from pyspark.sql.functions import col as spark_col

from corvane.llm import ann, langid, quality, toxicity

rnd = random.Random(0)
EN = ["the", "house", "and", "with", "river", "water", "think", "thing"]
DE = ["der", "haus", "und", "mit", "schule", "wasser", "nicht", "zeit"]


def text(words, n):
    return " ".join(rnd.choice(words) for _ in range(n))


def test_language_held_out(docs):
    rows = [(i, text(EN if i % 2 else DE, 40), "en" if i % 2 else "de", "s") for i in range(200)]
    rows += [(900, None, "en", "s"), (901, "", "en", "s"), (902, "123 !? 4", "de", "s"), (903, text(EN, 5), None, None), (904, "日本", None, "s"), (905, text(DE, 20_000), None, "s")]
    table = docs(rows)
    got = {r["doc_id"]: r for r in langid.predicted(table, langid.train(table)).collect()}
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "de") for i in range(200))
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3
    assert got[903]["lang_pred"] == "en" and got[905]["lang_pred"] == "de" and got[904]["lang_pred"] in ("en", "de")
    assert all(0 <= r["score"] <= 1 for r in got.values()) and any(r["held_out"] for r in got.values())


def test_language_without_learning_rows(docs):
    table = docs([(1, "abc", None, None)])
    assert langid.predicted(table, langid.train(table)).first()["lang_pred"] == "und"
    assert langid.predicted(docs([]), langid.train(table)).count() == 0


def test_language_masks_beyond_64():
    names = [f"l{i:02d}" for i in range(70)]
    slices = np.zeros((2, langid.SLOTS), np.uint64)
    g = np.array([0x61626364], np.uint32)
    for at in langid.slots(g):
        slices[1][at] |= np.uint64(1) << np.uint64(5)
    model = langid.Model(names, slices, "l00")
    n, count = model.counts(g, np.zeros(1, np.int64), 1)
    assert n[0] == 1 and count[0].argmax() == 69


@pytest.fixture
def labelled(spark, docs):
    def make(bad, good, mark):
        rows = [(i, bad(i) if i % 3 == 0 else good(i)) for i in range(400)]
        labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 3 != 0)) for i in range(300)] + [(None, 1, 1), (5, None, None)], "doc_id long, toxic int, quality int")
        return docs([*rows, (900, None), (901, ""), (902, "?!" * 30_000)], {"label": 1}), labels

    return make


def test_toxicity_held_out(labelled):
    words = [a + b for a in "bcdfgl" for b in ("are", "ent", "ion", "ost", "ul")]
    table, labels = labelled(lambda i: text(words, 60) + f" vileword{i % 3} dreadful{i % 2}, " + text(words, 60), lambda i: text(words, 120), "toxic")
    model = toxicity.train(table, labels)
    got = {r["doc_id"]: r for r in toxicity.scored(table, model).collect()}
    assert np.mean([got[i]["predicted"] == (i % 3 == 0) for i in range(300, 400)]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[900]["score"] == got[901]["score"] < 0.5
    start, end = got[300]["passages"][0]["start"], got[300]["passages"][0]["end"]
    assert "vileword" in table.filter("doc_id = 300").first()["text"][start:end]


def test_toxicity_without_both_kinds(docs, spark):
    table = docs([(1, "a b"), (2, "c")])
    none = toxicity.train(table, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.scored(table, none).collect()} == {0.5}


def brute_segments(score):
    """Maximal scoring segments by definition: the best segment, then the same left and right of it."""

    def best(a, b):
        top = (0, 0, 0)
        for i in range(a, b):
            total = 0
            for j in range(i, b):
                total += score[j]
                if total > top[0] or (total == top[0] and total > 0 and j + 1 - i < top[2] - top[1]):
                    top = (total, i, j + 1)
        return [] if top[0] <= 0 else [*best(a, top[1]), (top[1], top[2], top[0]), *best(top[2], b)]

    return best(0, len(score))


def test_segments_are_all_maximal():
    draw = random.Random(4)
    for _ in range(200):
        score = np.array([draw.choice([-7, -5, -3, -2, 2, 3, 4, 5]) + draw.random() for _ in range(draw.randint(0, 25))])
        got = [(a, b, round(s, 6)) for a, b, s in toxicity.segments(score)]
        assert got == [(a, b, round(s, 6)) for a, b, s in brute_segments(score)]


def test_quality_held_out(labelled):
    words = [a + b for a in "bcdfgl" for b in ("are", "ent", "ion", "ost", "ul")]
    table, labels = labelled(lambda i: text([w.upper() + "!!" for w in words], 50) if i % 2 else "$$$ ".join(words), lambda i: text(words, 80) + ".", "quality")
    model = quality.train(table, labels)
    got = {r["doc_id"]: r for r in quality.scored(table, model).collect()}
    assert np.mean([got[i]["predicted"] == (i % 3 != 0) for i in range(300, 400)]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[900]["score"] == got[901]["score"]
    kept = quality.accepted_rows(table, model)
    assert kept.columns == table.columns and kept.count() == sum(r["predicted"] for r in got.values())


def test_quality_features_do_not_depend_on_the_block():
    from corvane.llm.common import flat

    import pyarrow as pa

    texts = ["", "One two, two!", "a|b\n$$$ ÉÈ 12", "x " * 500]
    every = quality.features(*flat(pa.array(texts)))
    alone = np.vstack([quality.features(*flat(pa.array([t]))) for t in texts])
    assert np.allclose(every, alone)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def exact(rows, k=10):
    good = {i: np.array(np.float32(v), float) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 8}
    out = {}
    for q in good:
        if q % 100 == 0:
            out[q] = sorted((float(np.sqrt(((good[q] - v) ** 2).sum())), i) for i, v in good.items() if i != q)[:k]
    return out


def test_neighbours(spark):
    draw = np.random.default_rng(1)
    rows = [(i, draw.normal(size=8).tolist(), 0) for i in range(600)] + [(i, [1.0] * 8, 1) for i in range(600, 950)]
    rows += [(1000, None, 0), (1100, [0.0] * 8, 0), (1200, [float("nan")] * 8, 0), (1300, [None] * 8, 0), (1400, [float("inf")] * 8, 0), (None, [1.0] * 8, 0), (1500, [1.0, 2.0], 0)]
    want, hits, total = exact(rows), 0, 0
    got = {}
    for r in ann.nearest(vectors(spark, rows)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    assert set(got) == set(want)
    for q, found in got.items():
        found = sorted(found)
        assert [f[0] for f in found] == list(range(1, 11))
        hits += len({f[2] for f in found} & {i for _, i in want[q]})
        total += 10
        truth = dict((i, s) for s, i in exact(rows, 10**6)[q])
        assert all(abs(truth[f[2]] - f[1]) < 1e-9 for f in found)
    assert hits / total >= 0.9


def test_neighbours_do_not_depend_on_the_codes(spark):
    draw = np.random.default_rng(5)
    x = np.concatenate([draw.normal(size=(2500, 8)), np.tile(draw.normal(size=8), (1000, 1)), draw.normal(size=(1500, 8))]).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    want, got = exact(rows), {}
    table = vectors(spark, rows).select("vec_id", spark_col("embedding").alias("v"))
    books = draw.normal(size=(2, 2, 8)).astype(np.float32)  # four codes for all rows
    for r in ann.search(table, table.filter("vec_id % 100 = 0"), books).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    assert {q: [i for _, _, i in sorted(f)] for q, f in got.items()} == {q: [i for _, i in f] for q, f in want.items()}
    assert all(abs(a[1] - b[0]) < 1e-9 for q in got for a, b in zip(sorted(got[q]), want[q], strict=True))


def test_neighbours_of_few_and_none(spark):
    assert ann.nearest(vectors(spark, [])).count() == 0
    got = ann.nearest(vectors(spark, [(100, [1.0, 0.0], 0), (1, [1.0, 1.0], 0), (2, [1.0, 1.0], 0)])).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(100, 1, 1, 1.0), (100, 2, 2, 1.0)]


def test_beam_search_beats_greedy():
    draw = np.random.default_rng(2)
    x = draw.normal(size=(500, 8)).astype(np.float32)
    books = ann.learn(x, books=4, words=16)
    error = [((x - ann.encode(x, books, beam)[1]) ** 2).sum() for beam in (1, 8)]
    assert error[1] <= error[0]
