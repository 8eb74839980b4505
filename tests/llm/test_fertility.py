"""Fertility rules: the base counts, the measures and the bands against plain loops."""

import base64
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken

from corvane.llm import fertility as fe

PATHS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    pieces = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATHS[0], "rb"))}
    tokens = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def one(text):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        chars = sum(map(len, words))
        ids = [i for w in words for i in pieces.encode(w)]
        n_tokens = sum(len(tokens.encode_ordinary(" " + w)) for w in words)
        share = [c / len(ids) for c in Counter(ids).values()]
        measures = (chars / max(1, n_tokens), chars / max(1, len(ids)), sum(map(pieces.is_byte, ids)) / max(1, len(ids)), -sum(s * math.log2(s) for s in share))
        failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
        return (len(words), chars, len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed), measures

    return one


def corpus():
    draw = random.Random(4)
    en = ["the", "house", "with", "river", "water", "thinking", "measure", "and", "of", "is", "small", "question"]
    ru = ["река", "вода", "дом", "и", "на", "говорит", "большой"]
    rows = [(i, "\n".join(" ".join(draw.choice(en) for _ in range(9)) + "." for _ in range(12)), "en") for i in range(60)]
    rows += [(100 + i, " ".join(draw.choice(ru) + str(draw.randrange(9)) for _ in range(90)), None) for i in range(20)]
    rows += [(200, None, "en"), (201, "", "en"), (202, " \n\n\t", None), (None, "word " * 60, "en"), (203, "a b c " * 60, "en"), (203, "a b c " * 60, "en"), (204, "123 456 " * 9, None)]
    rows += [(300, " ".join("".join(draw.choice("qxzjkv#*$%") for _ in range(7)) for _ in range(80)), "en"), (301, " ".join(chr(0x12000 + draw.randrange(900)) * 3 for _ in range(80)), "en")]
    rows += [(400, "one line\n  \none line\r\none line\nother", "de"), (401, " ".join(f"w{i % 7000}" for i in range(30_000)), "de"), (402, "same line of words\n" * 30, "de")]
    return rows


def test_counts_measures_and_verdicts(docs, plain):
    table = corpus()
    got = fe.verdicts(docs([(*r, "s") for r in table], {"group": 1, "script": 2, "bin": 3, "_group": "g"}), *PATHS).collect()
    assert len(got) == len(table)
    found = sorted(((r["doc_id"], *(r[c] for c in fe.COUNTS), r["base_failed"]) for r in got), key=repr)
    assert found == sorted(((i, *plain(t)[0]) for i, t, _ in table), key=repr)
    by_id = {r["doc_id"]: r for r in got}
    groups = {}
    for i, text, lang in table:
        own = plain(text)
        assert np.allclose([by_id[i][m] for m in fe.MEASURES], own[1], atol=1e-9)
        if not own[0][-1]:
            groups.setdefault(lang or by_id[i]["group"], []).append([round(x * 1000) for x in own[1]])
    assert by_id[100]["group"] == "script CYRILLIC" and by_id[204]["group"] == "script "
    for i, text, lang in table:
        own, kept = plain(text), False
        if not own[0][-1]:
            kept = True
            for k, name in enumerate(fe.MEASURES):
                column = sorted(row[k] for row in groups[lang or by_id[i]["group"]])
                q1, q2, q3 = (column[math.ceil(q * len(column) / 4) - 1] / 1000 for q in (1, 2, 3))
                reach = 4 * max(q3 - q1, 0.01 * q2, 0.01 if name == "byte_share" else 0.001)
                kept &= own[1][k] <= q3 + reach + 1e-12 and (name == "byte_share" or own[1][k] >= q1 - reach - 1e-12)
        assert by_id[i]["kept"] == kept, i
    assert not by_id[300]["kept"] and not by_id[301]["kept"] and all(by_id[i]["kept"] for i in range(60))


def test_no_rows(docs):
    assert fe.verdicts(docs([]), *PATHS).isEmpty()


def test_many_distinct_words():
    ids = np.array([5, 6, 7, 1 << 22, 5, 6, 7, 5, 6], np.int32)
    of = np.array([0, 0, 0, 0, 0, 0, 0, 1, 1])
    assert fe.repeated(ids, of).tolist() == [True] * 3 + [False] + [True] * 3 + [False] * 2
    assert fe.repeated(np.array([5, 6, 7, 8, 5, 6, 7], np.int32), np.array([0, 0, 0, 0, 1, 1, 1])).any() == False  # noqa: E712  not across texts


def test_a_worker_forgets():
    known = fe.Words(*PATHS)
    first = fe.measure([b"some words to know", b""], known)
    known.forget()
    again = fe.measure([b"other words", b"some words to know"], known)
    assert (first[1][0] == again[1][1]).all() and np.allclose(first[2][0], again[2][1])


def test_words_encoded_together_are_those_encoded_alone():
    draw, known = random.Random(8), fe.Words(*PATHS)
    letters = ["a", "B", "é", "漢", "1", "-", "'", " ", " ", "\u0085", "​", "\x1c", "\x1f", "s", "#", "🙂", "ß"]
    words = sorted({"".join(draw.choice(letters) for _ in range(draw.randrange(1, 7))) for _ in range(4000)})
    assert known._byte_tokens(words) == [len(known.bytes.encode_ordinary(" " + w)) for w in words]
