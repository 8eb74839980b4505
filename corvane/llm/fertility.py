"""Quality rules by tokeniser fertility: what public vocabularies make of a text's words, against bands per language or script.

For every text: characters per token under a byte-level vocabulary and under one of pieces, the share of byte-fallback tokens
among the pieces, and the entropy of the text's piece distribution in bits. Words are tokenised one by one (a byte-level token
starts with the blank before its word), so a word's tokens are remembered in a bounded table per worker.

Bands come from all texts that pass the base rules: per group the quartiles of each measure, counted exactly over bins of
1/1000 (a sum per group and bin, so order and partitions don't matter), widened by `WIDTH` times the distance between them,
which counts as `LEAST` of the measure at least. A text is rejected if a measure lies outside its group's band; for the
byte-fallback share only above it. The group is the row's `lang`, or the script of most of its letters where that is null.

Base rules: at least 50 words, and at most half of the words in 3-word windows that occur twice or more.

Nulls: a null text has no words and fails the base rules, as an empty one does; a null doc_id stays null; a null or missing
lang is replaced by the script. Very long texts are measured whole. Ties: a measure on the edge of its band is inside it.
Repeated rows are measured one by one and each counts. No rows: no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import blocks, written

MIN_WORDS, REPEATED_PERCENT = 50, 50
WIDTH, LEAST, BINS = 4, 0.01, 1000
SYMBOLS = b"#*$%&|<>"
#: Words that a worker remembers at most (a block's words may come on top), and bytes of text measured together.
MEMO, TOGETHER = 400_000, 1 << 22
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = ("chars_per_token", "chars_per_piece", "byte_share", "token_entropy")
SCHEMA = "doc_id long, script string, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{m} double" for m in MEASURES)


_NO_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())


def script(word: str) -> tuple[str, int]:
    """The script of a word's first letter (as its Unicode name begins) and the number of its letters; ('', 0) without letters."""
    letters = [c for c in word if c.isalpha()]
    return (unicodedata.name(letters[0], "UNKNOWN").split()[0], len(letters)) if letters else ("", 0)


class Words(dict):
    """Word -> row of the growing tables of what is known about it."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(byte_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        self.scripts: dict[str, int] = {"": 0, "LATIN": 1}
        self.blank_first = np.zeros(max(ranks.values()) + 1, bool)
        self.blank_first[[i for token, i in ranks.items() if token[:1] == b" "]] = True
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[bytes] = []
        self.facts, self.flat = np.zeros((0, 6), np.int64), np.zeros(0, np.int32)

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at

    def _byte_tokens(self, words: list[str]) -> list[int]:
        """Byte-level tokens of each word behind a blank.

        The words are encoded as one text. A token never crosses the blank before a word, and no other token begins with
        one, so blanks tell where words begin. Words with white space of their own (beyond ASCII) could merge with a blank: those go one by one.
        """
        odd = [i for i, w in enumerate(words) if not w.isascii() and any(map(str.isspace, w)) or "\x1c" <= min(w) <= "\x1f"]
        own = set(odd)
        plain = [w for i, w in enumerate(words) if i not in own] if odd else words
        ids = np.array(self.bytes.encode_ordinary(" " + " ".join(plain)), np.int64) if plain else np.zeros(0, np.int64)
        counts = np.diff([*np.flatnonzero(self.blank_first[ids]), len(ids)]).tolist()
        if odd:
            rest = iter(counts)
            counts = [len(self.bytes.encode_ordinary(" " + w)) if i in own else next(rest) for i, w in enumerate(words)]
        return counts

    def learn(self) -> None:
        """Facts of the words met since: characters, symbols, script, letters, byte-level tokens, first piece; and their pieces."""
        words = [w.decode() for w in self.new]
        ids = self.pieces.encode(words, num_threads=1) if words else []
        tokens = self._byte_tokens(words)
        first = len(self.flat) + np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        rows = []
        for raw, word, n in zip(self.new, words, tokens, strict=True):
            if len(raw) == len(word):  # ASCII
                letters = len(raw.translate(None, _NO_LETTERS))
                name = "LATIN" if letters else ""
            else:
                name, letters = script(word)
            rows.append((len(word), len(raw) - len(raw.translate(None, SYMBOLS)), self.scripts.setdefault(name, len(self.scripts)), letters, n))
        facts = np.array(rows, np.int64).reshape(-1, 5)
        self.facts = np.concatenate([self.facts, np.column_stack([facts, first[:-1]])])
        self.flat = np.concatenate([self.flat, np.fromiter((i for x in ids for i in x), np.int32)])
        self.new = []


@lru_cache(maxsize=2)
def _known(byte_path: str, piece_path: str) -> Words:
    return Words(byte_path, piece_path)


def repeated(ids: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which words stand in a 3-word window that its text holds twice or more. ids: word numbers; of: their texts, ascending."""
    out = np.zeros(len(ids), bool)
    if len(ids) < 3:
        return out
    bits = 21
    if ids.max() >> bits:  # too many distinct words for one key: number the pairs first
        pair = np.unique(ids[:-1].astype(np.int64) << 31 | ids[1:], return_inverse=True)[1].astype(np.int64)
        key = pair[:-1] << 31 | ids[2:]
    else:
        wide = ids.astype(np.int64)
        key = wide[:-2] << 2 * bits | wide[1:-1] << bits | wide[2:]
    inside = np.flatnonzero(of[:-2] == of[2:])
    key, text = key[inside], of[inside]
    order = np.argsort(key, kind="stable")  # equal windows of a text stay together: texts ascend
    same = (key[order[1:]] == key[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    for k in range(3):
        out[inside[twice] + k] = True
    return out


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]  # a line with a word
    return len(lines) - len(set(lines))


def measure(texts: list[bytes], known: Words) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The script, the counts and the measures of each text."""
    if len(known) > MEMO:
        known.forget()
    words, n = [], len(texts)
    for text in texts:
        own = text.split()  # at exactly \x20 and \x09-\x0D
        words.append(np.fromiter(map(known.__getitem__, own), np.int32, len(own)))
    known.learn()
    sizes = np.array([len(x) for x in words], np.int64)
    ids, of = np.concatenate(words) if words else np.zeros(0, np.int32), np.repeat(np.arange(n), sizes)
    per = lambda values: np.bincount(of, values, n).astype(np.int64)  # noqa: E731  exact: far below 2**53
    chars, symbols, scripts, letters, tokens, first = known.facts[ids].T
    end = np.concatenate([known.facts[1:, 5], [len(known.flat)]])[ids] if len(ids) else first
    pieces = end - first
    counts = np.stack([sizes, per(chars), per(symbols), np.array([_dup_lines(t) for t in texts], np.int64), per(repeated(ids, of))], 1)
    total, n_pieces = per(tokens), per(pieces)
    token = known.flat[np.repeat(first - (np.cumsum(pieces) - pieces), pieces) + np.arange(pieces.sum())]
    text_of = np.repeat(of, pieces)
    fallback = np.bincount(text_of, known.is_byte[token], n)
    key, times = np.unique(text_of.astype(np.int64) << 32 | token, return_counts=True)
    at = key >> 32
    share = times / n_pieces[at]
    entropy = np.bincount(at, -share * np.log2(share), n)
    some = np.maximum(n_pieces, 1)
    measures = np.stack([counts[:, 1] / np.maximum(total, 1), counts[:, 1] / some, fallback / some, entropy], 1)
    names, most = list(known.scripts), np.zeros((n, len(known.scripts)), np.int64)
    np.add.at(most, (of, scripts), letters)
    return [names[i] for i in most.argmax(1)], counts, measures


def measured(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """The counts and measures of every row of `docs` (doc_id, text), written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(byte_path, piece_path)
        for part in blocks(batches, limit=TOGETHER):
            scripts, counts, measures = measure([(t or "").encode() for t in part.column("text").to_pylist()], known)
            numbers = [pa.array(np.ascontiguousarray(x)) for x in (*counts.T, *measures.T)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array(scripts, pa.string()), *numbers], names=["doc_id", "lang", "script", *COUNTS, *MEASURES])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", "text", lang.alias("lang")).mapInArrow(run, SCHEMA.replace("script", "lang string, script"))
    return written(rows.withColumn("group", F.coalesce("lang", F.concat(F.lit("script "), "script"))), "fertility")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))


def bands(rows: DataFrame, width: float = WIDTH) -> DataFrame:
    """(group, <measure>_low, <measure>_high) from the rows of `measured` that pass the base rules.

    Counted per group, measure and bin before anything meets, so a group with most rows is a few thousand counts.
    """
    each = rows.filter(~base_failed()).select("group", F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.round(F.col(m) * BINS).cast("long").alias("bin")) for m in MEASURES))).alias("_"))
    counts = each.groupBy("group", "_.measure", "_.bin").agg(F.count("*").alias("n"))
    of = Window.partitionBy("group", "measure")
    summed = counts.withColumns({"upto": F.sum("n").over(of.orderBy("bin")), "all": F.sum("n").over(of)})
    quartile = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("all"), F.col("bin"))) / BINS
    found = summed.groupBy("group", "measure").agg(quartile(1).alias("q1"), quartile(2).alias("q2"), quartile(3).alias("q3"))
    reach = width * F.greatest(F.col("q3") - F.col("q1"), LEAST * F.abs("q2"), F.when(F.col("measure") == "byte_share", F.lit(LEAST)).otherwise(F.lit(1 / BINS)))
    found = found.withColumns({"low": F.when(F.col("measure") != "byte_share", F.col("q1") - reach), "high": F.col("q3") + reach})
    return found.groupBy("group").agg(*(F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{m}_{side}") for m in MEASURES for side in ("low", "high")))


def verdicts(docs: DataFrame, byte_path: str, piece_path: str, width: float = WIDTH) -> DataFrame:
    """Every row of `docs` with its counts, measures, base_failed and kept."""
    rows = measured(docs, byte_path, piece_path)
    limits = bands(rows, width).withColumnRenamed("group", "_group")
    inside = F.lit(True)
    for m in MEASURES:
        inside &= (F.coalesce(F.col(m) >= F.col(f"{m}_low"), F.lit(True))) & (F.coalesce(F.col(m) <= F.col(f"{m}_high"), F.lit(True)))
    out = rows.join(limits, F.col("group") == F.col("_group"), "left")
    return out.select("doc_id", *COUNTS, base_failed().alias("base_failed"), (~base_failed() & inside).alias("kept"), "group", *MEASURES)
