"""Ranked lexical search by an Aho-Corasick scan of the documents, without a document index (operator 13).

1. Items are dealt to blocks of bounded size by the bytes of their distinct terms (`BLOCK_BYTES`): items are
   hashed to groups and packed into blocks by running sums within a group, so no task or broadcast sees more
   than a block; an item larger than that is a block of its own.
2. A block's terms become one Aho-Corasick automaton, each term guarded by a blank on both sides, and the
   automaton is broadcast. Texts are translated byte by byte (A-Z to lower case, whatever separates terms to
   a blank), so that a match is a whole term and the scan reads the text as it is: it yields every occurrence.
3. A first scan counts the documents that hold each term, and in all documents the terms.
4. A second scan counts tf, weighs each (document, term) once, and adds that to all items of the term by
   the automaton's outputs. A task keeps the best `k` documents of each item only, by score and doc_id, so at
   most k rows an item leave it; the best of these are the result.

Scores are whole numbers; sums are exact (as two halves below 2^53).

Defined results: null texts have no terms, count for no statistic and are never returned; a document row is
a document of its own, also if it repeats a doc_id or a text; a null doc_id comes last among equal scores;
rows that repeat an item_id are one item with the terms of all of them, so are rows without an
item_id; items without terms, or without a document that scores above 0, have no rows; of equal scores the lower
doc_id comes first; empty tables give no rows; other columns are ignored. A text is handled whole, whatever its
length: memory is that of the longest text or of `textkit.PIECE_BYTES`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import scratch
from tidemark.llm import textkit as tk
from tidemark.llm.decontaminate import LOWER, UPPER, words

TOP = 20
BLOCK_BYTES = 1 << 20  # bytes of distinct item terms in one automaton
ITEM_BYTES = 256  # what an item counts besides its terms
CELLS = 1 << 22  # scores of a chunk of documents that are held at once

#: A byte as the scan sees it: a letter, digit or byte of a non-ASCII character, else a blank.
SEEN = bytes(int(tk.LOWER[b]) if tk.ALNUM[tk.LOWER[b]] else 32 for b in range(256))


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times): how often each item holds each of its terms."""
    return items.select("item_id", F.explode(words("text")).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("times"))


def blocks(terms: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """`terms` with `block`, a string: items whose terms have `limit` bytes in all, or one larger item."""
    weight = terms.groupBy("item_id").agg((F.sum(F.octet_length("term") + 1) + ITEM_BYTES).alias("weight"))
    weight = scratch.stored(weight)
    total = weight.agg(F.sum("weight")).first()[0] or 0
    group = F.pmod(F.xxhash64("item_id"), F.lit(max(1, math.ceil(total / (4 * limit)))))
    before = F.sum("weight").over(Window.partitionBy("g").orderBy("weight", "item_id").rowsBetween(Window.unboundedPreceding, 0))
    placed = weight.withColumn("g", group).select("item_id", F.concat_ws(".", "g", F.floor((before - 1) / limit)).alias("block"))
    return terms.join(placed, F.equal_null(terms["item_id"], placed["item_id"])).select(terms["item_id"], "term", "times", "block")


class Scan:
    """What a task needs to find a block's terms in documents, and whose terms they are."""

    def __init__(self, rows: list):
        """rows: (item_id, term, times) of a block, which is of bounded size."""
        self.items = list(dict.fromkeys(r[0] for r in rows))
        self.terms = sorted({r[1] for r in rows})
        item, term = ({x: k for k, x in enumerate(xs)} for xs in (self.items, self.terms))
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, x in enumerate(self.terms):
            automaton.add_word(f" {x} ".encode().decode("latin-1"), k)
        if self.terms:
            automaton.make_automaton()
        self.automaton = automaton
        postings = sorted((term[t], item[i], n) for i, t, n in rows)
        self.item_of, self.times = (np.array([p[k] for p in postings], np.int64) for k in (1, 2))
        self.first = np.searchsorted(np.array([p[0] for p in postings], np.int64), np.arange(len(self.terms) + 1))
        self.weight = np.zeros(len(self.terms), np.int64)

    def counts(self, p: tk.Piece) -> tuple[np.ndarray, ...]:
        """(n, doc, term, tf): terms of each text of a piece, and the counts of the block's terms by text."""
        raw, offs = p.data.tobytes().translate(SEEN), p.offs.tolist()
        text = b" " + b" ".join(raw[a:b] for a, b in zip(offs[:-1], offs[1:])) + b" "
        letter = np.frombuffer(text, np.uint8) != 32
        ends = p.offs[1:] + np.arange(1, len(p) + 1)  # each text's closing blank
        begins = np.zeros(len(text) + 1, np.int64)
        np.cumsum(letter[1:] & ~letter[:-1], out=begins[1:-1])
        begins[-1] = begins[-2]
        n = np.diff(begins[np.r_[0, ends]])
        hits = np.fromiter(chain.from_iterable(self.automaton.iter(text.decode("latin-1"))), np.int64) if self.terms else np.zeros(0, np.int64)
        doc = np.searchsorted(ends, hits[::2])
        pair, tf = np.unique(doc * max(len(self.terms), 1) + hits[1::2], return_counts=True)
        return n, pair // max(len(self.terms), 1), pair % max(len(self.terms), 1), tf


class Best:
    """The k best documents of each item so far: by score, then doc_id, those without one last."""

    def __init__(self, n_items: int, k: int):
        self.k, self.least = k, np.ones(n_items, np.int64)
        self.rows = [np.zeros(0, np.int64) for _ in range(4)]  # item, score, no doc_id, doc_id

    def add(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        """scores: a row for each document, a column for each item."""
        d, item = np.nonzero(scores >= self.least)
        if not len(d):
            return
        new = (item, scores[d, item], missing[d].astype(np.int64), ids[d])
        rows = [np.r_[a, b] for a, b in zip(self.rows, new)]
        o = np.lexsort((rows[3], rows[2], -rows[1], rows[0]))
        item = rows[0][o]
        begin = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
        place = np.arange(len(o)) - np.repeat(begin, np.diff(np.r_[begin, len(o)]))
        o = o[place < self.k]
        self.rows = [r[o] for r in rows]
        last = np.flatnonzero(place[place < self.k] == self.k - 1)
        self.least[self.rows[0][last]] = self.rows[1][last]  # an equal score may still have a lower doc_id


def _statistics(docs: DataFrame, scan: Scan) -> tuple[int, int, dict[str, int]]:
    """N, L, and how many documents hold each of the block's terms."""
    shared = docs.sparkSession.sparkContext.broadcast(scan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, df, n_docs, n_terms = shared.value, None, 0, 0
        for batch in batches:
            for p in tk.pieces(batch):
                n, _, term, _ = scan.counts(p)
                df = (0 if df is None else df) + np.bincount(term, minlength=len(scan.terms))
                n_docs, n_terms = n_docs + int((n > 0).sum()), n_terms + int(n.sum())
        if df is not None:
            held = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[-2, -1, held]), pa.array(np.r_[n_docs, n_terms, df[held]])], ["term", "n"])

    found = docs.select("doc_id", "text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    n = {r["term"]: r["n"] for r in found.collect()}  # a row for each term of the block
    shared.unpersist()
    return n.pop(-2, 0), n.pop(-1, 0), {scan.terms[k]: v for k, v in n.items()}


def _best(docs: DataFrame, scan: Scan, n_docs: int, n_terms: int, k: int, kind: T.DataType) -> DataFrame:
    """(item_id, doc_id, score): each task's best documents of each item."""
    shared = docs.sparkSession.sparkContext.broadcast(scan)

    def scores(scan: Scan, rows: slice, doc, term, value) -> np.ndarray:
        """Of documents in `rows`, from values of (document, term)."""
        a, b = np.searchsorted(doc, [rows.start, rows.stop])
        doc, term, value = doc[a:b] - rows.start, term[a:b], value[a:b]
        size = scan.first[term + 1] - scan.first[term]
        at = np.repeat(scan.first[term] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        cell = np.repeat(doc, size) * len(scan.items) + scan.item_of[at]
        value = np.repeat(value, size)
        total = np.zeros((rows.stop - rows.start) * len(scan.items), np.int64)
        for shift, part in ((24, value >> 24), (0, value & 0xFFFFFF)):
            total += np.bincount(cell, part * scan.times[at], len(total)).astype(np.int64) << shift
        return total.reshape(-1, len(scan.items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = shared.value
        best = Best(len(scan.items), k)
        for batch in batches:
            for p in tk.pieces(batch):
                n, doc, term, tf = scan.counts(p)
                m = 75 + (25 * n * n_docs) // max(n_terms, 1)
                value = scan.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
                ids = p.rows.column(0)
                missing, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
                step = max(1, CELLS // max(len(scan.items), 1))
                for at in range(0, len(p), step):
                    rows = slice(at, min(at + step, len(p)))
                    best.add(scores(scan, rows, doc, term, value), ids[rows], missing[rows])
        item, score, none, ids = best.rows
        names = pa.array([scan.items[i] for i in item.tolist()], batch_type)
        yield pa.RecordBatch.from_arrays([names, pa.array(ids, mask=none > 0), pa.array(score)], ["item_id", "doc_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(kind)
    schema = T.StructType([T.StructField("item_id", kind), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP, limit: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    terms = scratch.stored(blocks(item_terms(items), limit))
    kind = terms.schema["item_id"].dataType
    found, totals = None, None
    for (block,) in terms.select("block").distinct().orderBy("block").collect():
        scan = Scan([tuple(r) for r in terms.where(F.col("block") == block).select("item_id", "term", "times").collect()])  # at most `limit` bytes of terms, or one item
        n_docs, n_terms, df = _statistics(docs, scan)
        scan.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in scan.terms], np.int64)
        part = _best(docs, scan, n_docs, n_terms, k, kind)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return terms.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("score")).limit(0)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = f"list_filter(regexp_split_to_array(translate(text, '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

#: DuckDB: terms of all documents joined to those of all items.
ORACLE = f"""
WITH d AS (SELECT doc_id, w, len(w)::BIGINT AS n FROM (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) > 0),
s AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS l FROM d),
i AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY ALL),
t AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
f AS (SELECT term, count(*)::BIGINT AS df FROM t GROUP BY term),
v AS (SELECT doc_id, term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // l))) AS value FROM t JOIN f USING (term), s),
c AS (SELECT item_id, doc_id, sum(times * value)::BIGINT AS score FROM v JOIN i USING (term) GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM c WHERE score > 0) WHERE rank <= 20
"""
