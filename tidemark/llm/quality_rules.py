"""Quality rules with suffix-array repetition limits (operator 5).

Besides plain counts, every document gets a suffix array over its words. Adjacent suffixes' longest
common prefixes give, for each word, the longest repeated substring that starts there; the maximal
ones' spans are united, and a document fails if they cover too large a part of its words, if one
repeat is too long, or if a character-class rule fails.

Defined results: null text has no words and fails the base rule; an empty text likewise; rows are
judged one by one, so repeated rows and ties need no rule; extra columns are ignored; a null doc_id
stays null; an empty table gives no rows. A document is handled as a whole, whatever its length; memory is that of the longest
document or of `textkit.PIECE_BYTES` of text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import textkit as tk

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True


@dataclass(frozen=True)
class Limits:
    """Verdict thresholds; a clean document of prose is far below each."""

    min_words: int = 50
    base_repeat_percent: int = 50
    min_repeat: int = 6  # words in a repeat that counts
    max_covered: float = 0.35  # part of the words in such repeats
    max_longest: int = 400  # words in one repeat
    max_symbols: float = 0.12  # symbols for each word
    max_upper: float = 0.5  # upper-case ASCII letters in all word bytes


def suffix_array(codes: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array of all documents' words at once, by prefix doubling.

    `codes`: word codes; `doc`: document of each word; `ends`: where each word's document ends.
    Returns the suffixes whose first word repeats in their document, in suffix order; the longest
    common prefix of each with the one before it (0 across documents); and the class of each word's
    3-gram (negative where it does not repeat).
    """
    n = len(codes)
    rank = np.empty(n, np.int64)
    three = np.full(n, -1, np.int64)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), three
    order = np.argsort(doc * (codes.max() + 1) + codes, kind="stable")
    key = (doc * (codes.max() + 1) + codes)[order]
    head = np.r_[True, key[1:] != key[:-1]]
    rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
    single = head & np.r_[head[1:], True]
    act = order[~single]  # in suffix order; buckets are contiguous
    everyone = act
    levels = [rank.copy()]
    h = 1
    while len(act):
        later = act + h
        inside = later < ends[act]
        second = np.where(inside, rank[np.minimum(later, n - 1)] + 1, 0)  # a suffix that ends sorts first
        second[~inside] = -1 - act[~inside]  # and equals no other
        o = np.lexsort((second, rank[act]))
        act, second = act[o], second[o]
        first = rank[act]
        new = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
        at = np.arange(len(act))
        bucket = np.r_[True, first[1:] != first[:-1]]
        begin = np.maximum.accumulate(np.where(bucket, at, 0))
        part = np.maximum.accumulate(np.where(new, at, 0))
        rank[act] = first + (part - begin)
        levels.append(rank.copy())
        act = act[~(new & np.r_[new[1:], True])]
        h *= 2
    sa = everyone[np.argsort(rank[everyone], kind="stable")]
    lcp = np.zeros(len(sa), np.int64)
    a, b = sa[:-1].copy(), sa[1:].copy()
    got = np.zeros(len(a), np.int64)
    for j in range(len(levels) - 1, -1, -1):  # each level's identifiers compare 2^j words at once
        step = 1 << j
        x, y = a + got, b + got
        ok = (doc[a] == doc[b]) & (x + step <= ends[a]) & (y + step <= ends[b])
        same = ok & (levels[j][np.minimum(x, n - 1)] == levels[j][np.minimum(y, n - 1)])
        got += step * same
    lcp[1:] = got
    cut = np.r_[lcp[1:] < 3, True] if len(lcp) else np.zeros(0, bool)
    group = np.cumsum(np.r_[0, cut[:-1]]) if len(lcp) else np.zeros(0, np.int64)
    if len(sa):
        rep = np.maximum(lcp, np.r_[lcp[1:], 0]) >= 3
        three[sa[rep]] = group[rep]
    return sa, lcp, three


def cover(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in a span."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, starts + lengths, -1)
    return np.cumsum(d[:-1]) > 0


def _lines(p: tk.Piece, w: tk.Words) -> np.ndarray:
    """Per document, lines with a word that equal an earlier line."""
    cut = np.zeros(len(p.data) + 1, bool)
    cut[np.flatnonzero(p.data == 10)] = True
    starts = np.union1d(np.flatnonzero(cut[:-1]) + 1, p.offs[:-1])
    starts = starts[starts <= len(p.data)]
    doc = np.searchsorted(p.offs, starts, side="right") - 1
    keep = (starts < p.offs[-1]) & (doc < len(p))
    starts, doc = starts[keep], doc[keep]
    ends = np.r_[starts[1:], len(p.data)]
    ends = ends - (p.data[ends - 1] == 10) * (ends > starts) if len(ends) else ends
    has = np.searchsorted(w.start, ends) > np.searchsorted(w.start, starts)
    starts, ends, doc = starts[has], ends[has], doc[has]
    if not len(starts):
        return np.zeros(len(p), np.int64)
    text = p.data.tobytes()
    codes: dict = {}
    line = np.fromiter((codes.setdefault(text[a:b], len(codes)) for a, b in zip(starts.tolist(), ends.tolist())), np.int64, len(starts))
    _, first = np.unique(doc * len(codes) + line, return_index=True)
    return np.bincount(doc, minlength=len(p)) - np.bincount(doc[first], minlength=len(p))


def measure(p: tk.Piece, lim: Limits) -> dict[str, np.ndarray]:
    """All counts and verdicts for one piece."""
    w = tk.Words(p, tk.NOT_SPACE)
    n = len(w)
    counts, doc = w.counts, w.doc
    points = np.zeros(len(p.data) + 1, np.int64)
    np.cumsum((p.data & 0xC0) != 0x80, out=points[1:])
    chars = tk.per_doc_sum(points[w.end] - points[w.start], w.first) if n else np.zeros(len(p), np.int64)
    ends = w.first[1:][doc] if n else np.zeros(0, np.int64)
    codes, _ = w.encode()
    sa, lcp, three = suffix_array(codes, doc, ends)
    hit = np.flatnonzero(three >= 0)
    repeat = cover(hit, np.full(len(hit), 3), n) if n else np.zeros(0, bool)
    longest = np.maximum(lcp, np.r_[lcp[1:], 0]) if len(lcp) else lcp
    long = longest >= lim.min_repeat
    covered = cover(sa[long], longest[long], n) if n else np.zeros(0, bool)
    most = np.zeros(len(p), np.int64)
    if len(sa):
        np.maximum.at(most, doc[sa], longest)
    out = {
        "n_words": counts,
        "word_chars": chars,
        "n_symbols": tk.per_doc_sum(SYMBOLS[p.data], p.offs),
        "n_dup_lines": _lines(p, w),
        "n_repeat_words": tk.per_doc_sum(repeat, w.first),
        "n_covered_words": tk.per_doc_sum(covered, w.first),
        "longest_repeat": most,
    }
    upper = tk.per_doc_sum(UPPER[p.data], p.offs)
    out["base_failed"] = (counts < lim.min_words) | (100 * out["n_repeat_words"] > lim.base_repeat_percent * counts)
    one = np.maximum(counts, 1)
    bad = (out["n_covered_words"] > lim.max_covered * one) | (most > lim.max_longest) | (out["n_symbols"] > lim.max_symbols * one) | (upper > lim.max_upper * np.maximum(chars, 1))
    out["kept"] = ~out["base_failed"] & ~bad
    return out


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_covered_words long, longest_repeat long"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")[1:]]


def quality_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row of counts and verdicts for each row of `docs` (doc_id, text); no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in tk.pieces(batch):
                m = measure(p, limits)
                yield pa.RecordBatch.from_arrays([p.rows.column(0), *(pa.array(m[c]) for c in COLUMNS)], ["doc_id", *COLUMNS])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, SCHEMA)


def kept(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of `docs` that pass, with all their columns; no join and no shuffle."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in tk.pieces(batch):
                yield p.rows.select(names).filter(pa.array(measure(p, limits)["kept"]))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
