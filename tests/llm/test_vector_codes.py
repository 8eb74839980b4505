"""Vector codes against plain integer arithmetic."""

import hashlib
import math

import numpy as np
import pytest

from corvane.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=4, words=256, rounds=4):
    """The contract by loops over Python integers."""
    good = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    d = len(good[0][1]) // parts
    cut = lambda v: [v[p * d : (p + 1) * d] for p in range(parts)]
    start = sorted((i, v) for i, v, _ in good if i is not None)[:words]
    books = [[cut(v)[p] for _, v in start] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min((far(v, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = {}
            for _, v, _ in good:
                own.setdefault(near(cut(v)[p], p)[1], []).append(cut(v)[p])
            new.append([[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if k in own else e for k, e in enumerate(books[p])])
        books = new
    out, total = [], {}
    for i, v, lab in good:
        hits = [near(cut(v)[p], p) for p in range(parts)]
        out.append((i, lab, "".join(f"{k:02x}" for _, k in hits), sum(e for e, _ in hits)))
        total[lab] = total.get(lab, 0) + out[-1][3]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    cap = (1 << 63) - 1
    return sorted(((i, c, min(e, cap), min(total[lab], cap), sha) for i, lab, c, e in out), key=repr)


def got(frame):
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in frame.collect()), key=repr)


def test_rows_are_those_of_plain_arithmetic(spark):
    draw = np.random.default_rng(1)
    coarse = draw.integers(-2, 3, (700, 8)) / 4  # many equal distances
    rows = [(int(i), [float(x) for x in v], int(i) % 3 if i % 7 else None) for i, v in enumerate(coarse)]
    rows += [(5, [0.5] * 8, 1), (5, [0.25] * 8, 1), (None, [0.1] * 8, 2), (800, None, 1), (801, [float("nan")] + [0.0] * 7, 1), (802, [float("inf")] + [0.0] * 7, 1), (803, [None] + [0.0] * 7, 1), (804, [], 1), (-4, [0.0] * 8, 0)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(vc.codes(table)) == plain(rows)


def test_huge_components(spark):
    rows = [(i, [float(np.float32(x)) for x in (1e38 * (i % 5), -3e38, 1e-3 * i, 2e20, 1.0, -1.0, 5e9 + i * 1e6, 0.5)], i % 2) for i in range(40)]
    rows += [(100 + i, [float(np.float32((-1) ** k * (i + 1) * 3.3e37)) for k in range(8)], None) for i in range(9)]
    assert got(vc.codes(spark.createDataFrame(rows, SCHEMA))) == plain(rows)
    more = [*rows, *((1000 + i, [1e38, -3e38, 2.0, 2e20, 1.5, -1.0, 4e9, 0.25], 1) for i in range(300))]
    assert got(vc.codes(spark.createDataFrame(more, SCHEMA))) == plain(more)


def test_other_dimensions_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    rows = [(i, [float(i)] * 6, 1) for i in range(9)] + [(50, [1.0, 2.0], 1)]
    table = spark.createDataFrame(rows, SCHEMA).withColumns({"v": F.lit(1), "code": F.lit("x"), "_label": F.lit(2), "part": F.lit(3)})
    found = vc.codes(table).collect()
    assert sorted(r["vec_id"] for r in found) == list(range(9)) and all(len(r["code"]) == 8 for r in found) and {r["error"] for r in found} == {0}


def test_only_null_ids(spark):
    rows = [(None, [float(i)] * 4, None) for i in range(3)]
    found = vc.codes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == 3 and {r["error"] for r in found} == {0}


@pytest.mark.parametrize("rows", [[], [(1, None, 1), (2, [], 2)]])
def test_no_rows(spark, rows):
    assert vc.codes(spark.createDataFrame(rows, SCHEMA)).isEmpty()


def test_tree_search_is_exhaustive_search():
    draw = np.random.default_rng(2)
    for dims in (1, 2, 16):
        entries, x = draw.integers(-9, 10, (256, dims)), draw.integers(-12, 13, (3000, dims))
        at, best = vc.nearest(x, vc.Tree(entries))
        far = ((x[:, None] - entries[None]) ** 2).sum(2)
        assert (best == far.min(1)).all() and (at == far.argmin(1)).all()
