"""Periodic runs against a brute force that looks at every stretch and every period."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import periodic, queries


def brute(words, least=12):
    """Every run, from the definition: a stretch, its smallest period, and no neighbour that keeps it."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                part = words[i : j + q]
                if all(any(part[k] != part[k + p] for k in range(len(part) - p)) for p in range(1, q)):
                    out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute(words)
    dropped = {k for s, m, q in runs for k in range(s + q, s + m)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    longest = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc, len(runs), *longest, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()), sha(b" ".join(w for k, w in enumerate(words) if k not in dropped)))


def rows(frame):
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=repr)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 30), st.integers(1, 9)), max_size=6), st.integers(1, 14))
def test_scan_finds_every_run(parts, least):
    draw = random.Random(str(parts))
    words = [x for kind, period, times in parts for x in [draw.randrange(kind + 2) for _ in range(period)] * times]
    got = periodic.scan(np.array(words, np.int32), np.array([len(words)]), 1, len(words) // 2 + 1, least)
    assert sorted(map(tuple, got.tolist()), key=lambda r: (r[0], r[2])) == brute(words, least)


def test_sparse_places_find_long_lags():
    draw = random.Random(5)
    base = [draw.randrange(500) for _ in range(700)]
    words = [draw.randrange(500) for _ in range(311)] + base * 3 + base[:90] + [7] * 900 + base[:130] * 9
    got = periodic.scan(np.array(words, np.int32), np.array([len(words)]), 1, len(words) // 2 + 1)
    assert sorted(map(tuple, got.tolist()), key=lambda r: (r[0], r[2])) == brute(words)
    many = [x for i in range(90) for x in [*(f"{i}.{k}" for k in range(17))] * 2]  # more stretches at a lag than are looked at one by one
    code = {w: i for i, w in enumerate(many)}
    got = periodic.scan(np.array([code[w] for w in many], np.int32), np.array([len(many)]), 1, len(many) // 2 + 1)
    assert len(got) == 90 and (got[:, 2] == 17).all()


def corpus():
    draw = random.Random(3)
    out = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "a " * 11), (5, "a " * 12), (6, "x y " * 6), (6, "x y " * 6), (None, "b c " * 20), (None, None), (7, "go " * 3000)]
    for i in range(20, 120):  # ids whose crc32 is divisible by ten get planted periods
        words = [f"w{draw.randrange(4 if i % 3 else 4000)}" for _ in range(draw.randrange(1, 150))]
        out.append((i, draw.choice([" ", "\n", "  "]).join(words)))
    return out


@pytest.mark.parametrize("long,lags", [(1 << 16, 1 << 14), (200, 7)])
def test_query_is_brute_force(docs, long, lags):
    table = corpus()
    frame = docs(table, {"_row": 1, "start": 2, "runs": "r", "low": 3, "spans": 4})
    found = periodic.periodic_runs(frame, queries.planted_places, long=long, lags=lags)
    assert rows(periodic.digests(found)) == sorted((expected(*r) for r in table), key=repr)


def test_no_rows(docs):
    assert periodic.digests(periodic.periodic_runs(docs([]))).isEmpty()


def test_texts_as_they_are(docs):
    got = periodic.periodic_runs(docs([(1, "now " + "buy it " * 8 + "end")])).first()
    assert [tuple(r) for r in got["runs"]] == [(1, 16, 2)] and got["collapsed"] == "now buy it end" and got["n_words"] == 18
