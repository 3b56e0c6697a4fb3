"""Runs of words that repeat with a period, by internal pattern matching (operator 12).

A run is a stretch of words with smallest period q and a length of at least max(6, 4 * q) that neither
neighbouring word extends. For each level k, a text's words are cut into blocks of h = 2^k words from its
start on. A run of a period from h to 2h - 1 holds a whole block b, which occurs again one period later, so:

1. Prefix doubling sorts the suffixes of all texts of a piece at once, each text by itself, and gives for
   every block the interval of the suffix array with its occurrences. It stops at blocks of a quarter of the
   longest text, as no run has a longer period.
2. A wavelet tree over the suffix array answers, for all blocks of a level together, which occurrences
   start in b+h .. b+2h-1: how many, the first two and the last, by range successor. Windows of one
   or two places are compared directly. So many occurrences within a window of h places are one arithmetic
   progression.
3. Up to two occurrences are candidate periods themselves. Three or more, d apart, mean that the block
   has period d; then one period leads from where that ends behind the block to where it ends behind the
   progression.
4. A candidate whose blocks agree is extended both ways, word by word with doubling strides; of equal
   stretches the smallest period stays. A run's length is four periods at least, so its first block is
   always found, and with it the run.

All is exact: words are compared by dictionary codes, never by hashes.

Defined results: null text, empty text and text of blanks have no words and no runs; a null doc_id stays null;
rows are judged one by one, so rows that repeat a doc_id or a text get results of their own; of
runs with equal greatest exponent the one of least start, then least period, is reported; an empty table
gives no rows; other columns are ignored. A text is handled whole in one task, whatever its length: about 200
bytes a word of the longest text, or of `textkit.PIECE_BYTES` of short ones. There is no shuffle.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import textkit as tk

LEAST, TIMES = 6, 4  # a run has so many words, and so many periods, at least


class Wavelet:
    """A wavelet tree (as a matrix of bits) over values below `limit`: counts and order of ranges' values."""

    def __init__(self, values: np.ndarray, limit: int):
        self.levels: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        for bit in reversed(range(max(int(limit - 1).bit_length(), 1))):
            one = (values >> bit & 1).astype(bool)
            raw = np.packbits(one, bitorder="little")
            words = np.zeros(len(one) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(raw)] = raw
            before = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            self.levels.append((bit, words, before, len(one) - int(one.sum())))
            values = np.concatenate([values[~one], values[one]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        w = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[w] + np.bitwise_count(words[w] & mask)

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of each range lo..hi-1 are less than x; x at most `limit`."""
        out, every = np.zeros(len(lo), np.int64), hi - lo
        beyond = x >> (self.levels[0][0] + 1) > 0  # all values
        for bit, words, before, zeros in self.levels:
            a, b = self._ones(words, before, lo), self._ones(words, before, hi)
            one = (x >> bit & 1).astype(bool)
            out += np.where(one, (hi - b) - (lo - a), 0)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return np.where(beyond, every, out)

    def nth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value, from 0, of each range, which has more than k."""
        out = np.zeros(len(lo), np.int64)
        for bit, words, before, zeros in self.levels:
            a, b = self._ones(words, before, lo), self._ones(words, before, hi)
            small = (hi - b) - (lo - a)
            one = k >= small
            out |= one.astype(np.int64) << bit
            k = np.where(one, k - small, k)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return out


def agree(codes: np.ndarray, x: np.ndarray, y: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
    """How many codes from x and y on are equal, at most `room`; step -1 goes back from those before them."""
    got, alive, width = np.zeros(len(x), np.int64), np.arange(len(x)), 4
    if step < 0:
        x, y = x - 1, y - 1
    while len(alive):
        alive = alive[got[alive] < room[alive]]
        if not len(alive):
            break
        w = np.minimum(width, room[alive] - got[alive])
        begin = np.cumsum(w) - w
        i = np.arange(int(w.sum())) - np.repeat(begin, w)
        shift = np.repeat(got[alive], w) + i
        equal = codes[np.repeat(x[alive], w) + step * shift] == codes[np.repeat(y[alive], w) + step * shift]
        same = np.minimum.reduceat(np.where(equal, np.int64(1) << 60, i), begin)
        got[alive] += np.minimum(same, w)
        alive = alive[same >= w]
        width *= 2
    return got


def _suffixes(codes: np.ndarray, doc: np.ndarray, begin: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list]:
    """The suffix array, as far as blocks need it (-1 for words that occur once in their text), and each
    level's (h, block, lo, hi): the blocks that occur again in their text, with their intervals.

    A name is the first place in suffix order of all suffixes of a text that share the next h words.
    """
    n = len(codes)
    rank = np.empty(n, np.int64)
    key = doc * (int(codes.max()) + 1) + codes
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.r_[True, key[1:] != key[:-1]]
    rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
    act = order[~(head & np.r_[head[1:], True])]
    everyone, levels, h = act, [], 1
    room = ends - begin
    while len(act):
        act = act[TIMES * h <= room[act]]  # in suffix order; of a text all or none
        if not len(act):
            break
        first = rank[act]
        cut = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
        size = np.diff(np.r_[cut, len(act)])
        block = (act - begin[act]) % h == 0
        levels.append((h, act[block], first[block], first[block] + np.repeat(size, size)[block]))
        later = act + h
        inside = later < ends[act]
        second = np.where(inside, rank[np.minimum(later, n - 1)], -1 - act)  # a suffix that ends equals no other
        o = np.lexsort((second, first))
        act, second, first = act[o], second[o], first[o]
        new = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
        at = np.arange(len(act))
        bucket = np.maximum.accumulate(np.where(np.r_[True, first[1:] != first[:-1]], at, 0))
        part = np.maximum.accumulate(np.where(new, at, 0))
        rank[act] = first + (part - bucket)
        act = act[~(new & np.r_[new[1:], True])]
        h *= 2
    sa = np.full(n, -1, np.int64)
    by_name = everyone[np.argsort(rank[everyone], kind="stable")]
    sa[_places(rank[by_name])] = by_name
    return sa, levels


def _places(names: np.ndarray) -> np.ndarray:
    """Places in suffix order of suffixes sorted by name; those that share one take the places from it on."""
    first = np.r_[True, names[1:] != names[:-1]] if len(names) else np.zeros(0, bool)
    at = np.arange(len(names))
    return names + at - np.maximum.accumulate(np.where(first, at, 0))


def candidates(codes: np.ndarray, doc: np.ndarray, begin: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period): all periods that occurrences of blocks in their neighbouring windows propose."""
    sa, levels = _suffixes(codes, doc, begin, ends)
    used = sa >= 0
    index = np.zeros(len(sa) + 1, np.int64)
    np.cumsum(used, out=index[1:])
    tree, places, periods = None, [], []
    for h, block, lo, hi in levels:
        if h <= 2:  # windows of one or two places
            found = [(block, np.full(len(block), p)) for p in range(h, 2 * h)]
        else:
            tree = tree or Wavelet(sa[used], len(sa))
            lo, hi = index[lo], index[hi]
            less = tree.below(lo, hi, np.minimum(block + h, len(sa)))
            upto = tree.below(lo, hi, np.minimum(block + 2 * h, len(sa)))
            some = np.flatnonzero(upto > less)
            block, lo, hi, less, upto = (v[some] for v in (block, lo, hi, less, upto))
            one = tree.nth(lo, hi, less)
            many = upto - less
            t = np.flatnonzero(many >= 2)
            two = tree.nth(lo[t], hi[t], less[t] + 1)
            few = many <= 2
            pair = many[t] == 2
            found = [(block[few], (one - block)[few]), (block[t][pair], (two - block[t])[pair])]
            r = np.flatnonzero(~pair)
            if len(r):
                s = t[r]
                b, d, last = block[s], two[r] - one[s], tree.nth(lo[s], hi[s], upto[s] - 1)
                e = ends[b]
                # a period ends behind the block within 2.5 h of it, and behind the last occurrence within 2 h more
                j0 = b + h + agree(codes, b + h - d, b + h, np.minimum(e - b - h, 2 * h), 1)
                j1 = last + h + agree(codes, last + h - d, last + h, np.minimum(e - last - h, 4 * h), 1)
                found.append((b, j1 - j0))
        b, p = (np.concatenate(x) for x in zip(*found))
        ok = (p >= h) & (b + p + h <= ends[b])
        b, p = b[ok], p[ok]
        same = agree(codes, b, b + p, np.full(len(b), h), 1) == h
        b, p = b[same], p[same]
        o = np.lexsort((b, p))
        b, p = b[o], p[o]
        chained = np.r_[False, (p[1:] == p[:-1]) & (b[1:] - b[:-1] == h) & (begin[b[1:]] == begin[b[:-1]])] if len(b) else np.zeros(0, bool)
        places.append(b[~chained])  # the others lie in the same stretch
        periods.append(p[~chained])
    none = np.zeros(0, np.int64)
    return np.concatenate(places or [none]), np.concatenate(periods or [none])


def runs(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs, by text, start and period; text d has the words
    `first[d]:first[d+1]`, and starts count from its first word."""
    counts = np.diff(first)
    if not len(codes):
        return (np.zeros(0, np.int64),) * 4
    doc = np.repeat(np.arange(len(counts)), counts)
    begin, ends = first[doc], first[doc + 1]
    b, p = candidates(codes, doc, begin, ends)
    back = agree(codes, b, b + p, b - begin[b], -1)
    on = agree(codes, b, b + p, ends[b] - b - p, 1)
    start, length = b - back, back + on + p
    ok = length >= np.maximum(LEAST, TIMES * p)
    start, length, p = start[ok], length[ok], p[ok]
    o = np.lexsort((p, length, start))
    start, length, p = start[o], length[o], p[o]
    new = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])] if len(o) else np.zeros(0, bool)
    start, length, p = start[new], length[new], p[new]
    o = np.lexsort((p, start))
    start, length, p = start[o], length[o], p[o]
    return doc[start], start - begin[start], length, p


Rewrite = Callable[[int | None, int], np.ndarray | None]

SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def measure(p: tk.Piece, rewrite: Rewrite | None = None) -> list[tuple]:
    """Rows of `SCHEMA` for the texts of a piece whose first column is doc_id."""
    w = tk.Words(p, tk.NOT_SPACE)
    codes, _ = w.encode()
    ids, counts = p.rows.column(0).to_pylist(), w.counts
    sources: dict[int, np.ndarray] = {}
    for d in np.flatnonzero(counts).tolist() if rewrite else ():
        if (source := rewrite(ids[d], int(counts[d]))) is not None:
            sources[d] = source
    if sources:
        at = np.arange(len(codes))
        for d, source in sources.items():
            at[w.first[d] : w.first[d + 1]] = w.first[d] + source
        codes = codes[at]
    doc, start, length, period = runs(codes, w.first)
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, w.first[doc] + start + period, 1)
    np.add.at(edge, w.first[doc] + start + length, -1)
    dropped = np.cumsum(edge[:-1]) > 0
    # quotients of whole numbers below 2^26 are equal as doubles only if they are equal
    best = np.lexsort((period, start, -(length / period), doc)) if len(doc) else doc
    head = best[np.r_[True, doc[best][1:] != doc[best][:-1]]] if len(doc) else doc
    chosen = dict(zip(doc[head].tolist(), zip(start[head].tolist(), length[head].tolist(), period[head].tolist())))
    cut = np.searchsorted(doc, np.arange(len(p) + 1))
    lines = [f"{a},{b},{c}\n" for a, b, c in zip(start.tolist(), length.tolist(), period.tolist())]
    raw, offs, out = p.data.tobytes(), p.offs.tolist(), []
    for d, key in enumerate(ids):
        words = raw[offs[d] : offs[d + 1]].split()
        if d in sources:
            words = [words[k] for k in sources[d].tolist()]
        mine = lines[cut[d] : cut[d + 1]]
        if mine:
            words = [words[k] for k in np.flatnonzero(~dropped[w.first[d] : w.first[d + 1]]).tolist()]
        a, b, c = chosen.get(d, (None, None, None))
        out.append((key, len(mine), a, b, c, 1000 * b // c if c else None, _digest("".join(mine).encode()), _digest(b" ".join(words))))
    return out


def periodic_runs(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """One row of `SCHEMA` for each row of `docs` (doc_id, text); no shuffle.

    rewrite: gives for a doc_id and a number of words which original word stands at each place, or None
    where the text stays as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        for batch in batches:
            for p in tk.pieces(batch):
                rows = measure(p, rewrite)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], NAMES)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, SCHEMA)


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The contract's rewriting: the words of a tenth of the documents repeat from a place on."""
    if doc_id is None:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at >= a, a + (at - a) % p, at)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), planted)
