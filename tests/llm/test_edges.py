"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, operator by operator."""

import hashlib

import pytest
from pyspark.sql import functions as F

from corvane.llm import ann, langid, mixing, ngram_join, packing, pii, quality, suffix_dedup, toxicity

CLASH = {"_row": 1, "_uid": 2, "_text": "t", "_key": "k", "node": 3, "sig": 4, "uid": 5, "y": 1, "size": 7, "score": 0.5, "label": 1}
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "same words here"), (4, "same words here"), (5, "same words here"), (None, "no id at all"), (6, "long " * 200_000)]


def thue_morse(n):
    out = "a"
    while len(out) < n:
        out += out.translate(str.maketrans("ab", "ba"))
    return out[:n]


def removed(texts, length=400):
    """Bytes that brute force removes from each text, and what is left."""
    at = {}
    raw = [t.encode() for t in texts]
    for i, x in enumerate(raw):
        for j in range(len(x) - length + 1):
            at.setdefault(x[j : j + length], []).append((i, j))
    gone = [set() for _ in raw]
    for places in at.values():
        if len(places) > 1:
            for i, j in places:
                gone[i].update(range(j, j + length))
    return [(len(g), hashlib.sha256(bytes(b for k, b in enumerate(x) if k not in g)).hexdigest()) for x, g in zip(raw, gone, strict=True)]


def test_words_that_collide_modulo_powers_of_two_are_told_apart(docs):
    a = thue_morse(1024)
    b = a.translate(str.maketrans("ab", "ba"))
    got = ngram_join.near_groups(docs([(1, a), (2, b), (3, a)]), 3, 90)
    assert sorted((r["doc_id"], r["component_id"]) for r in got.collect()) == [(1, 1), (2, 2), (3, 1)]
    texts = ["p" * 20 + a + "q" * 20, "r" * 20 + b + "s" * 20, thue_morse(390) + "z" * 30]
    rows = suffix_dedup.deduplicated(docs(list(enumerate(texts)))).orderBy("doc_id").collect()
    assert [(r["n_removed"], r["kept_sha256"]) for r in rows] == removed(texts)


def test_links_through_rows_without_an_id(docs):
    base = [f"w{i}" for i in range(100)]
    a, b, c = " ".join(base), " ".join([*base[4:], "x", "y"]), " ".join([*base[8:], "x", "y", "z", "u"])
    near = lambda rows: sorted(((r["doc_id"] or 0, r["component_id"]) for r in ngram_join.near_groups(docs(rows), 3, 90).collect()), key=repr)
    assert near([(1, a), (None, b), (2, c)]) == [(0, 1), (1, 1), (2, 1)]
    assert near([(1, a), (2, c)]) == [(1, 1), (2, 2)]
    assert near([(None, a), (None, b), (None, a), (7, "other words than those")]) == [(0, None), (0, None), (0, None), (7, 7)]


def test_spans_needn_t_come_from_files(spark):
    shared = " ".join(f"w{i}" for i in range(120))
    table = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.col("id").cast("string"), F.lit(" " + shared), F.rand().cast("string")).alias("text"))
    assert suffix_dedup.deduplicated(table).filter("n_removed >= 400").count() == 40


def test_odd_rows_everywhere(spark, docs):
    table = docs(ODD, CLASH)
    marks = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    n = len(ODD)
    assert toxicity.scored(table, toxicity.train(table, marks)).count() == n
    assert quality.scored(table, quality.train(table, marks)).count() == n
    assert {r["lang_pred"] for r in langid.predicted(table, langid.train(table)).collect()} == {"und"}
    near = ngram_join.near_groups(table, 3, 90).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["n_shingles"]) for r in near) == [(0, 0, 2), (1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 1), (4, 4, 1), (5, 4, 1), (6, 6, 1)]
    assert pii.pseudonymised(table, "k").count() == n
    assert suffix_dedup.deduplicated(table).agg(F.sum("n_removed")).first()[0] == 1_000_000
    assert mixing.mix(table).agg(F.count("*"), F.sum("size")).first()[:] == (n, 3 * 3 + 4 + 200_000)


def test_no_rows_everywhere(spark, docs):
    table, marks = docs([]), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.scored(table, toxicity.train(table, marks)).isEmpty() and quality.scored(table, quality.train(table, marks)).isEmpty()
    assert langid.predicted(table, langid.train(table)).isEmpty() and suffix_dedup.deduplicated(table).isEmpty() and mixing.mix(table).isEmpty()


def test_language_of_repeated_and_tied_rows(docs):
    rows = [(i, "der hund und die katze", "de") for i in range(8)] + [(10 + i, "the dog and the cat", "en") for i in range(8)] + [(50, "the dog"), (50, "the dog"), (51, "0123 !"), (52, "xq")]
    got = langid.predicted(docs(rows, CLASH), langid.train(docs(rows, CLASH)))
    assert sorted((r["doc_id"], r["lang_pred"]) for r in got.filter("doc_id >= 50").collect()) == [(50, "en"), (50, "en"), (51, "und"), (52, "de")]


def test_every_n_gram_of_a_language_is_in_its_filter(docs):
    model = langid.train(docs([(1, "the dog", "en"), (5, "the hund", "de")]))
    import numpy as np

    n, counts = model.counts(*langid.grams(np.frombuffer(b"the ", np.uint8), np.array([0, 4])), 1)
    assert (counts[0] > 0).all()  # both languages contain its n-grams


def test_quality_without_marks_keeps_every_row(spark, docs):
    table = docs([(1, "a"), (2, None), (3, "b c")], CLASH)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.accepted_rows(table, quality.train(table, none)).count() == 3


def test_nearest_with_clashing_columns_and_repeated_ids(spark):
    rows = [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [1.0, 0.1]), (3, None), (None, [1.0, 1.0]), (4, [0.0, 0.0])]
    table = spark.createDataFrame([(i, v, 1.0, 2, "x") for i, v in rows], "vec_id long, embedding array<double>, v double, rank int, approx string")
    got = ann.nearest(table).orderBy("query_id", "rank", "vec_id").collect()
    assert {(r["query_id"], r["vec_id"]) for r in got} == {(100, 1), (100, 2)}


def test_one_date_domain_and_only_valid_cards():
    key = b"k" * 32
    new = {shape: pii.pseudonymise(shape, key)[0] for shape in ("1999-12-31", "31.12.1999", "12/31/1999", "31/12/1999")}
    year, month, day = new["1999-12-31"].split("-")
    assert new["31.12.1999"] == f"{day}.{month}.{year}" and new["12/31/1999"] == f"{month}/{day}/{year}"
    assert new["31/12/1999"] == f"{day}/{month}/{year}"
    assert pii.pseudonymise("5234567890123456", key)[0] == "5234567890123456"
    assert pii.pseudonymise("4111111111111111", key)[0] != "4111111111111111"


def test_a_date_has_one_pseudonym_in_every_writing():
    import random
    import re
    from datetime import date

    key, months, draw = b"k" * 32, pii._MONTHS, random.Random(9)
    first, last = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
    seen = {}
    for d in [date.fromordinal(x) for x in (first, last, date(2000, 2, 29).toordinal(), *draw.sample(range(first, last), 3000))]:
        name = months[d.month - 1]
        writings = {"iso": f"{d.year}-{d.month:02d}-{d.day:02d}", "dotted": f"{d.day:02d}.{d.month:02d}.{d.year}", "us": f"{d.month:02d}/{d.day:02d}/{d.year}", "short": f"{d.day}.{d.month}.{d.year}", "name": f"{d.day} {name.title()} {d.year}", "abbr": f"{name[:3].upper()} {d.day}, {d.year}"}
        if d.day > 12:
            writings["slashed"] = f"{d.day}/{d.month:02d}/{d.year}"
        if d.month == 9:
            writings["sept"] = f"Sept {d.day}, {d.year}"
        read = set()
        for kind, text in writings.items():
            new, found = pii.pseudonymise(text, key)
            assert len(found) == 1 and pii.pseudonymise(new, key, back=True)[0] == text, (text, new)
            n = [int(x) for x in re.findall(r"\d+", new)]
            month = next((i for i, m in enumerate(months, 1) if m[:3] in new.lower()), None)
            read.add({"iso": lambda: (n[0], n[1], n[2]), "us": lambda: (n[2], n[0], n[1]), "name": lambda: (n[1], month, n[0]), "abbr": lambda: (n[1], month, n[0]), "sept": lambda: (n[1], month, n[0])}.get(kind, lambda: (n[2], n[1], n[0]))())
        assert len(read) == 1, (d, read)
        assert seen.setdefault(read.pop(), d) == d


@pytest.mark.parametrize("special_as_text", [True, False])
def test_packing_ids_are_the_library_s(docs, special_as_text):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    if special_as_text:  # as the vocabulary's description sets it
        plain.encode_special_tokens = True
    texts = ["a <|endoftext|> b", "<|endoftext|>", "plain words", "½ and  "]
    got = packing.pieces(docs(list(enumerate(texts))), path, with_ids=True, special_as_text=special_as_text).orderBy("doc_id", "start").collect()
    for i, text in enumerate(texts):
        ids = b"".join(r["ids"] for r in got if r["doc_id"] == i)
        assert [int.from_bytes(ids[k : k + 4], "little") for k in range(0, len(ids), 4)] == [*plain.encode(text, add_special_tokens=False).ids, 1]


def test_mixing_ranks_within_inner_bins(docs, monkeypatch):
    monkeypatch.setattr(mixing, "BINS", 4)
    table = docs([(i, "three words here", None, "a") for i in range(500)] + [(1000 + i, "one", None, "b") for i in range(5)])
    got = mixing.mix(table)
    for r in got.groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(r["taken"] - r["target"]) < 3
    assert got.count() == 505 and got.filter("taken > 3 * size").count() == 0


def test_mixing_takes_the_document_that_ends_nearer():
    import numpy as np

    assert mixing.nearest(np.array([60_000]), np.array([1]), 59_992).tolist() == [1]
    assert mixing.nearest(np.array([60_000]), np.array([1]), 29_992).tolist() == [0]
    assert mixing.nearest(np.array([7]), np.array([5]), 20).tolist() == [3]
    assert mixing.nearest(np.array([2, 7]), np.array([1, 5]), 16).tolist() == [1, 2]
