import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corvane.llm import mixing, packing, pii
from corvane.llm.queries import tokenizer_path

KEY = pii._key("secret")


@pytest.mark.parametrize("size", [2, 3, 10, 17, 1000, 4097])
def test_permutation_is_one(size):
    image = [pii.permute(i, size, "t", KEY) for i in range(size)]
    assert sorted(image) == list(range(size)) and all(pii.permute(y, size, "t", KEY, True) == i for i, y in enumerate(image))


def test_pseudonyms_keep_formats_and_links():
    text = "Call +1 (743) 555-3824, again 743-555-3824; ip 227.5.221.1; ssn 123-45-6789; card 4111 1111 1111 1111 or 4111111111111111; IBAN GB82 WEST 1234 5698 7654 32; 2024-02-29, 31.12.1999, 12/31/1999; mail bosbt.42@mail8.example.com."
    new, done = pii.pseudonymise(text, KEY)
    kinds = Counter(d[0] for d in done)
    assert kinds == {"phone": 2, "ipv4": 1, "ssn": 1, "card": 2, "iban": 1, "date": 3, "email": 1}
    assert not any(d[1] in new for d in done)
    by = {k: [re.sub(r"\D", "", d[2])[-10:] for d in done if d[0] == k] for k in ("phone", "card")}
    assert len(set(by["phone"])) == 1 and len(set(by["card"])) == 1  # equal values stay linked however they are written
    assert pii.luhn(re.sub(r"\D", "", next(d[2] for d in done if d[0] == "card"))[:-1]) == int(next(d[2] for d in done if d[0] == "card")[-1])
    assert pii.reveal(new, "secret") == text and len(new) >= len(text) - 12
    assert pii.pseudonymise(text, KEY)[0] == new != pii.pseudonymise(text, pii._key("other"))[0]


def test_what_does_not_validate_stays():
    for text in ("", "no numbers", "2023-02-30", "999.1.1.1", "000-12-3456", "1234567890123", "v1.2.3.4.5", "4. 5. 6", "123456789012345678901234567890"):
        assert pii.pseudonymise(text, KEY) == (text, [])


def test_pseudonyms_round_trip_over_many():
    import random

    draw = random.Random(1)
    for _ in range(300):
        d = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
        card = "4" + d(14)
        text = f"a {draw.randint(2, 9)}{d(2)}-{draw.randint(2, 9)}{d(2)}-{d(4)} b {draw.randint(1, 255)}.{draw.randint(0, 255)}.0.9 c {card}{pii.luhn(card)} d {draw.randint(1900, 2099)}-{draw.randint(1, 12):02d}-{draw.randint(1, 28):02d} e x{d(3)}@a.org f {draw.randint(13, 28)}/0{draw.randint(1, 9)}/2001"
        new, done = pii.pseudonymise(text, KEY)
        assert len(done) == 6 and pii.reveal(new, "secret") == text


@pytest.mark.parametrize("text", [
    "4111 1111 1111 1111 12/27", "4111 1111 1111 1111 123", "4111-1111-1111-1111-123", "1234 4111 1111 1111 1111 x", "AT61 1904 3002 3457 3201 BIC", "BE68 5390 0754 7034 EUR 5", "NO93 8601 1117 947 AB CD12", "AB12 AT61 1904 3002 3457 3201 BKAUATWW XY",
    "1/5/2020", "15/5/2020", "5.1.2020", "2020-1-15", "2024-02-29T10:11:12Z", "3 March 2020", "March 3rd, 2020", "MAR. 3, 2020", "12-may-1999", "the 21st of Sept 2001", "Sep 01 2001",
])
def test_values_before_other_groups_and_other_dates(text):
    for i in range(40):  # among 40 keys some pseudonyms must walk on
        key = pii._key(f"k{i}")
        new, done = pii.pseudonymise(f"a {text} z", key)
        assert len(done) == 1 and new != f"a {text} z" and pii.pseudonymise(new, key, back=True)[0] == f"a {text} z"
        assert re.sub("[a-z]+", "a", re.sub(r"\d", "0", new.lower())) == re.sub("[a-z]+", "a", re.sub(r"\d", "0", f"a {text} z".lower()))


def test_groups_behind_a_value_round_trip():
    import random

    draw = random.Random(2)
    for _ in range(400):
        d = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
        card = draw.choice("23456") + d(14)
        card += str(pii.luhn(card))
        body = d(16)
        iban = f"AT{98 - int(body + '102900') % 97:02d}{body}"
        four = lambda x: " ".join(x[i : i + 4] for i in range(0, len(x), 4))
        text = f"{four(card)} {d(draw.randint(1, 3))} and {draw.choice(['', 'XY99 '])}{four(iban)} {draw.choice(['BIC', 'EUR 12', 'BKAUATWW', d(2)])}. {draw.randint(1, 31)}.{draw.randint(1, 9)}.2001"
        new, done = pii.pseudonymise(text, KEY)
        assert four(card) not in new and four(iban) not in new and pii.reveal(new, "secret") == text


def test_pii_table(docs):
    got = {r["doc_id"]: r for r in pii.pseudonymised(docs([(1, "212-555-1234"), (2, None), (3, ""), (4, "x " * 50_000 + "1.2.3.4")], {"n_found": 9}), "secret").collect()}
    assert got[1]["n_phone"] == 1 and got[2]["text"] is None and got[3]["text"] == "" and got[4]["n_ipv4"] == 1
    assert pii.pseudonymised(docs([]), "secret").count() == 0


# --- mixing ---


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    got = mixing.targets([10, 1000, 0], [5, 2, 1])
    assert got[0] == 30 and got[2] == 0 and abs(sum(got) - 1010) < 1e-9
    assert mixing.targets([], []) == []


def test_knapsack_is_optimal():
    import itertools
    import random

    draw = random.Random(3)
    for _ in range(60):
        lengths = sorted(draw.sample(range(1, 30), draw.randint(1, 4)))
        counts = [draw.randint(1, 3) for _ in lengths]
        budget = draw.randint(0, 60)
        best = max(s for c in itertools.product(*(range(n + 1) for n in counts)) if (s := sum(a * b for a, b in zip(c, lengths, strict=True))) <= budget)
        take = mixing.knapsack(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(take, counts, strict=True)) and sum(a * b for a, b in zip(take, lengths, strict=True)) == best


def test_fit_comes_near():
    draw = np.random.default_rng(0)
    sizes = draw.lognormal(6, 1.2, 20_000).astype(np.int64) + 1
    lengths, counts = np.unique(sizes, return_counts=True)
    for share in (0.01, 0.3, 0.99):
        budget = int(sizes.sum() * share)
        take = mixing.fit(lengths, counts, budget)
        assert (take <= counts).all() and 0 <= budget - int((take * lengths).sum()) <= 2


def test_fit_of_long_documents_and_of_many_lengths():
    for lengths, counts, budget, best in (
        ([40_000, 40_001], [1, 1], 48_000, 40_001), ([30_000, 50_000, 50_001], [1, 1, 1], 66_000, 50_001), ([20, 30_000, 50_000, 50_001], [1, 1, 1, 1], 66_000, 50_021),
        (sorted([*range(1000, 3000, 2), 1501]), [1] * 1001, 3001, 3001),
    ):
        take = mixing.fit(np.array(lengths), np.array(counts), budget)
        assert (take <= counts).all() and int((take * lengths).sum()) == best


def test_mix(docs):
    rows = [(i, " ".join(["w"] * (i % 40 + 1)), "en", f"s{i % 5}" if i % 7 else None) for i in range(700)]
    rows += [(900, None, None, "s0"), (901, "", None, "s1"), (902, "a b", None, "only"), (903, " ", None, "void"), (1, " ".join(["w"] * 2), "en", "s1")]
    table = docs(rows, {"size": 5, "_bin": 1})
    got = mixing.mix(table).collect()
    assert len(got) == len(rows)
    source = {}
    for r, (i, t, _, s) in zip(sorted(got, key=lambda r: r["doc_id"]), sorted(rows, key=lambda r: r[0]), strict=True):
        assert r["size"] == len((t or "").split()) and r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        x = source.setdefault(s, [r["target"], 0, r["source_size"]])
        x[1] += r["taken"]
    assert all(abs(t - k) <= max(2, 0.01 * t) for t, k, _ in source.values())
    names = sorted(source, key=lambda s: (s is None, s or ""))
    want = mixing.targets([source[s][2] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    assert np.allclose([source[s][0] for s in names], want)
    again = mixing.mix(table).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    mixed = mixing.mixed_rows(table)
    assert mixed.columns == table.columns and mixed.count() == sum(r["taken"] // r["size"] for r in got if r["size"])
    assert mixing.mix(docs([])).count() == 0


# --- packing ---


def test_cuts():
    for n in (1, 2, 3, 2047, 2048, 2049, 10_000):
        c = packing.cuts(n)
        assert sum(c) == n and all(x & (x - 1) == 0 and x <= 2048 for x in c) and c == sorted(c, reverse=True)


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    tok.encode_special_tokens = True
    texts = [(1, "Hello world, it's 42!"), (2, None), (3, ""), (4, "añb ² ½ 日本 \x1c x" * 50), (5, "word " * 30_000), (6, "<|endoftext|> a  b\n\n c"), (1, "Hello world, it's 42!")]
    got = packing.packed(docs(texts, {"start": 1}), tokenizer_path(), with_ids=True).collect()
    assert len({r["sequence_id"] for r in got}) == len(got) and all(r["offset"] == 0 for r in got)
    for i, t in dict(texts).items():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: (r["start"], r["sequence_id"]))[:: 2 if i == 1 else 1]
        assert np.concatenate([np.frombuffer(r["ids"], "<u4") for r in own]).tolist() == ids
        assert all(r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in own)
    assert packing.packed(docs([]), tokenizer_path()).count() == 0


def test_remembered_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    tok, memo = Tokenizer.from_file(tokenizer_path()), packing._memo(tokenizer_path())
    tok.encode_special_tokens = True
    chars = [chr(c) for c in range(1, 0x3000, 3)]
    for c in chars:
        t = f"a{c}1 {c}.{c} x {c}{c}"
        assert np.frombuffer(memo.ids(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, hex(ord(c))
