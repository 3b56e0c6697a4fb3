"""Language-model scores by a probabilistic suffix tree (operator 9).

Tokens are lower-cased words and one end per text. The base score is an add-one unigram model over
tokens. The model itself is a suffix tree over the text's bytes (words joined by one space, then the
end), in `CLASSES` byte classes: a context becomes a state if its next-symbol distribution diverges from
that of its suffix by more than a description-length penalty (and occurs `MIN_COUNT` times, a word start
`START_COUNT` times); next-symbol distributions are smoothed with
those of the longest retained shorter suffix; a symbol is scored in the longest suffix that is a state.
Contexts are the last symbols, up to `DEPTH`, across words, and a word's bytes from its start, of any
length over that. Every context that passes the test is a state.

All training texts are counted (counts are merged per task before the shuffle). Contexts of up to DEPTH
symbols are sent to the driver and broadcast; their number ends at 64**DEPTH. Word starts, as many as
the texts have, stay distributed: what they add to the score of a word depends on the word alone, so it
is summed for each distinct word. At most `max_common` words are broadcast with their counts and sums;
those of all other words meet the texts' rarer words in a shuffle join.

Defined results: null text is empty: one token (the end). A row with a null doc_id is scored but not
learned from. Rows are scored one by one, also when a doc_id repeats (each such row is learned from);
extra columns are ignored. Without training texts N and V are 0; an empty table gives no rows; ties need no rule;
texts are read whole, whatever their length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import scratch
from tidemark.llm import textkit as tk

DEPTH = 4
CLASSES = 64
SPACE, END = 26, 27
MIN_COUNT = 32  # for contexts of up to DEPTH symbols
START_COUNT = 8  # for word starts
COUNTED = ["kind", "key", "word", "n", "ends"]
#: For hashes of word starts: a value of each byte, and the base of the polynomial over places.
BYTE_VALUE = tk.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = np.uint64(0xC2B2AE3D27D4EB4F)


def _classes() -> np.ndarray:
    """Byte -> class: letters alone, digits together, punctuation and UTF-8 bytes in groups."""
    c = np.zeros(256, np.int64)
    for b in range(256):
        if 97 <= b <= 122:
            c[b] = b - 97
        elif b == 0x20:
            c[b] = SPACE
        elif b == 0x0A:
            c[b] = END
        elif 48 <= b <= 57:
            c[b] = 52
        elif 0x80 <= b <= 0xBF:
            c[b] = 28 + (b & 15)
        elif b >= 0xC0:
            c[b] = 44 + (b & 7)
        else:
            c[b] = 53 + b % 11
    return c


CLASS_OF = _classes()


def held_out() -> F.Column:
    return (F.crc32(F.col("doc_id").cast("string")) % 7) == 2


def stream(p: tk.Piece, w: tk.Words) -> tuple[np.ndarray, np.ndarray]:
    """Each text's words joined by one space and closed by a line feed, as bytes and offsets."""
    length = w.end - w.start
    upto = np.zeros(len(w) + 1, np.int64)
    np.cumsum(length, out=upto[1:])
    size = np.maximum(upto[w.first[1:]] - upto[w.first[:-1]] + w.counts, 1)
    offs = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offs[1:])
    out = np.full(offs[-1], 0x20, np.uint8)
    doc = w.doc
    begin = offs[doc] + upto[:-1] - upto[w.first[doc]] + np.arange(len(w)) - w.first[doc]
    out[np.repeat(begin - upto[:-1], length) + np.arange(upto[-1])] = w._flat
    out[offs[1:] - 1] = 0x0A
    return out, offs


def contexts(symbols: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The DEPTH symbols before each place, the latest in the low bits; END before a text's start."""
    at = np.arange(len(symbols)) - np.repeat(offs[:-1], np.diff(offs))
    code = np.zeros(len(symbols), np.int32)
    for k in range(1, DEPTH + 1):
        before = np.full(len(symbols), END, np.int32)
        before[k:] = symbols[:-k]
        before[at < k] = END
        code |= before << (6 * (k - 1))
    return code


def _merge(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    k, back = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(back, weights=np.concatenate(counts)).astype(np.int64)


def _vocabulary(p: tk.Piece, w: tk.Words, learn: bool) -> pa.RecordBatch:
    _, codes, by_code = w.hashes()
    k = len(by_code)
    n = np.bincount(codes, minlength=k) if learn else np.zeros(k, np.int64)
    ends = np.bincount(codes[w.first[1:][w.counts > 0] - 1], minlength=k) if learn else n
    return pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int32)), pa.array(by_code.view(np.int64)), w.encode()[1], pa.array(n), pa.array(ends)], COUNTED)


def statistics(docs: DataFrame) -> DataFrame:
    """(kind, key, word, n, ends) over the training texts: 0 words by hash, and how often they end a text,
    1 context and next symbol, 2 bytes, 3 texts. Words of other texts are there with n = 0."""

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in tk.pieces(batch):
                yield _vocabulary(p, tk.Words(p, tk.NOT_SPACE, lower=True), False)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: dict[int, tuple[list, list]] = {k: ([], []) for k in range(1, 4)}

            def add(kind, keys, n, got=got):
                got[kind][0].append(np.asarray(keys, np.int64))
                got[kind][1].append(np.asarray(n, np.int64))

            for p in tk.pieces(batch):
                w = tk.Words(p, tk.NOT_SPACE, lower=True)
                yield _vocabulary(p, w, True)
                data, offs = stream(p, w)
                symbols = CLASS_OF[data].astype(np.int32)
                grams = np.sort((contexts(symbols, offs) << 6) | symbols)
                head = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
                add(1, grams[head], np.diff(np.r_[head, len(grams)]))
                add(2, np.arange(256), np.bincount(data, minlength=256))
                add(3, [0], [len(p)])
            for kind, (keys, n) in got.items():
                if keys:
                    k, c = _merge(keys, n)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.nulls(len(k), pa.binary()), pa.array(c), pa.array(np.zeros(len(k), np.int64))], COUNTED)

    schema = "kind int, key long, word binary, n long, ends long"
    left_out = F.coalesce(held_out(), F.lit(True))
    rows = docs.where(~left_out).select("text").mapInArrow(count, schema).unionByName(docs.where(left_out).select("text").mapInArrow(others, schema))
    return rows.groupBy("kind", "key", "word").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")).where("n > 0 or kind = 0")


@dataclass(frozen=True)
class Tree:
    """States in depth order (state 0 is the empty context), log10 of their smoothed distributions,
    and log10 of a byte's share in its class."""

    depth: np.ndarray
    context: np.ndarray
    log_next: np.ndarray
    log_byte: np.ndarray

    def table(self) -> np.ndarray:
        """The longest suffix state of every DEPTH-symbol context."""
        t = np.zeros(1, np.uint16 if len(self.depth) <= 1 << 16 else np.uint32)
        for d in range(1, DEPTH + 1):
            t = np.tile(t, CLASSES)
            own = np.flatnonzero(self.depth == d)
            t[self.context[own]] = own
        return t


def grow(stats: DataFrame, min_count: int = MIN_COUNT) -> Tree:
    """Selects the states on the cluster and smooths their distributions on the driver.

    A context stays if the gain of its own distribution over its suffix's, in bits, exceeds half the
    logarithm of its count for each next symbol.
    """
    grams = stats.where("kind = 1").select(F.shiftright("key", 6).alias("c"), F.col("key").bitwiseAND(63).alias("x"), "n")
    deep = grams.select(F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.col("c").bitwiseAND((1 << 6 * d) - 1).alias("ctx")) for d in range(DEPTH + 1)])).alias("s"), "x", "n")
    nodes = deep.groupBy("s.d", "s.ctx", "x").agg(F.sum("n").alias("n"))
    total = nodes.groupBy("d", "ctx").agg(F.sum("n").alias("t"), F.count("*").alias("m"))
    nodes = scratch.stored(nodes.join(total, ["d", "ctx"]))
    parent = nodes.select((F.col("d") + 1).alias("d"), F.col("ctx").alias("up"), "x", (F.col("n") / F.col("t")).alias("q"))
    child = nodes.where(f"d > 0 and t >= {min_count}").withColumn("up", F.expr("ctx & (shiftleft(1L, 6 * (d - 1)) - 1)"))
    gain = (
        child.join(parent, ["d", "up", "x"])
        .groupBy("d", "ctx", "t", "m")
        .agg(F.sum(F.col("n") * F.log2(F.col("n") / F.col("t") / F.col("q"))).alias("gain"))
        .where(F.col("gain") > F.col("m") * F.log2("t") / 2)
    )
    kept = gain.select("d", "ctx")
    rows = nodes.join(kept, ["d", "ctx"], "left_semi").unionByName(nodes.where("d = 0")).select("d", "ctx", "x", "n").toPandas()
    rows = rows.sort_values(["d", "ctx", "x"])
    key = rows["d"].to_numpy(np.int64) << 32 | rows["ctx"].to_numpy(np.int64)
    keys, state = np.unique(np.r_[0, key], return_inverse=True)
    counts = np.zeros((len(keys), CLASSES))
    counts[state[1:], rows["x"].to_numpy(np.int64)] = rows["n"].to_numpy()
    depth, context = keys >> 32, keys & 0xFFFFFFFF
    share = np.empty_like(counts)
    share[0] = (counts[0] + 0.5) / (counts[0].sum() + 0.5 * CLASSES)
    table = np.zeros(1, np.int64)
    for d in range(1, DEPTH + 1):
        own = np.flatnonzero(depth == d)
        up = table[context[own] & (CLASSES ** (d - 1) - 1)]
        m = (counts[own] > 0).sum(1, keepdims=True)
        share[own] = (counts[own] + m * share[up]) / (counts[own].sum(1, keepdims=True) + m)
        table = np.tile(table, CLASSES)
        table[context[own]] = own
    n_byte = np.full(256, 0.5)
    for r in stats.where("kind = 2").collect():  # 256 rows at most
        n_byte[r["key"]] += r["n"]
    log_byte = np.log10(n_byte / np.bincount(CLASS_OF, weights=n_byte, minlength=CLASSES)[CLASS_OF])
    return Tree(depth, context, np.log10(share).astype(np.float32), log_byte.astype(np.float32))


PLACE = ["h", "p", "x", "last", "n", "s"]


def reaching(words: DataFrame, min_count: int = START_COUNT) -> DataFrame:
    """Adds `reach`, the bytes of a word's start that may be a state. A start is at most as frequent as a
    shorter one of it, so none that `starts` keeps is lost; it keeps the rarest starts out of the shuffle.
    Words that begin alike come to one place, where their starts are counted together first."""
    size = 2 * DEPTH - 1
    head = F.xxhash64(F.substring("word", 1, size))  # two that collide are only counted too high
    long = F.octet_length("word") >= size
    often = words.where(long & (F.col("n") > 0)).groupBy(head.alias("head")).agg(F.sum("n").alias("t")).where(F.col("t") >= min_count).select("head", F.lit(True).alias("often"))
    far = words.where(F.octet_length("word") >= DEPTH).select("key", "word", "n", "ends", head.alias("head")).join(often, "head", "left")
    reach = F.when(long & F.col("often").isNull(), F.lit(size - 1)).otherwise(F.octet_length("word"))
    return scratch.stored(far.select("key", "word", "n", "ends", reach.alias("reach")).repartition(F.substring("word", 1, DEPTH)))


def places(batch: pa.RecordBatch, tree: Tree, table: np.ndarray) -> pa.RecordBatch:
    """The symbol after each word start of DEPTH bytes or more (hash `p`), its count and its share `s` in
    the tree; last is 1 for the space after a word, 2 for the end in its place, else 0."""
    words = pc.cast(batch.column(1), pa.large_binary())
    offs = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    flat = np.frombuffer(words.buffers()[2], np.uint8)[offs[0] : offs[-1]]
    begin, length = offs[:-1] - offs[0], np.diff(offs)
    power = np.cumprod(np.r_[np.uint64(1), np.full(int(length.max()) - 1, BASE, np.uint64)], dtype=np.uint64)
    inside = np.arange(len(flat)) - np.repeat(begin, length)
    upto = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[flat] * power[inside], out=upto[1:])
    times = np.minimum(batch.column(4).to_numpy(), length) - DEPTH + 1
    row = np.repeat(np.arange(len(words)), times)
    place = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + DEPTH
    at = begin[row] + place
    symbols = CLASS_OF[flat]
    context = np.zeros(len(row), np.int64)
    for k in range(1, DEPTH + 1):
        context |= symbols[at - k] << (6 * (k - 1))
    last = (place == length[row]).astype(np.int32)
    x = np.where(last == 1, SPACE, symbols[np.minimum(at, len(flat) - 1)])
    p = tk.mix(upto[at] - upto[begin[row]]).view(np.int64)
    n, ends = batch.column(2).to_numpy(), batch.column(3).to_numpy()
    count = np.where(last == 1, (n - ends)[row], n[row])
    end = np.flatnonzero(last)
    state = table[context]
    row, p, state = np.r_[row, row[end]], np.r_[p, p[end]], np.r_[state, state[end]]
    x, last, count = np.r_[x, np.full(len(end), END)], np.r_[last, np.full(len(end), 2, np.int32)], np.r_[count, ends[row[: len(place)][end]]]
    share = 10.0 ** tree.log_next[state, x].astype(np.float64)
    return pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[row]), pa.array(p), pa.array(x.astype(np.int32)), pa.array(last), pa.array(count), pa.array(share)], PLACE)


def starts(found: DataFrame, min_count: int = START_COUNT) -> DataFrame:
    """(p, t, unseen, seen): the word starts that are states, by the test of `grow` against the tree, and the
    logarithms of what they multiply the tree's shares by: of symbols never seen there, and of each seen one."""
    n = found.where("n > 0").groupBy("p", "x").agg(F.sum("n").alias("n"), F.max("s").alias("s"))
    each = n.groupBy("p").agg(
        F.sum("n").alias("t"),
        F.count("*").alias("m"),
        F.sum(F.col("n") * F.log2(F.col("n") / F.col("s"))).alias("bits"),
        F.collect_list(F.struct("x", "n", "s")).alias("seen"),  # CLASSES entries at most
    )
    share = lambda e: (e["n"] + F.col("m") * e["s"]) / (F.col("t") + F.col("m"))
    seen = F.map_from_entries(F.transform("seen", lambda e: F.struct(e["x"], F.log10(share(e) / e["s"]))))
    return each.where(F.col("t") >= min_count).where(F.col("bits") - F.col("t") * F.log2("t") > F.col("m") * F.log2("t") / 2).select("p", "t", F.log10(F.col("m") / (F.col("t") + F.col("m"))).alias("unseen"), seen.alias("seen"))


def word_table(stats: DataFrame, sent) -> DataFrame:
    """(key, n, delta, extra): words, what word starts add to a word's score, and what more at a text's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(sent.value, sent.value)
        for batch in batches:
            if len(batch):
                yield places(batch, sent.value, table)

    words = stats.where("kind = 0")
    found = reaching(words).mapInArrow(run, "h long, p long, x int, last int, n long, s double")
    gain = found.select("h", "p", (F.col("x") * 4 + F.col("last")).cast("short").alias("y")).join(scratch.stored(starts(found)), "p")
    gain = gain.select("h", F.col("y").bitwiseAND(3).alias("last"), F.coalesce(F.col("seen")[F.shiftright("y", 2)], "unseen").alias("v"))
    sums = gain.groupBy(F.col("h").alias("key")).agg(F.sum(F.when(F.col("last") < 2, F.col("v")).otherwise(0.0)).alias("delta"), F.sum(F.when(F.col("last") == 2, F.col("v")).when(F.col("last") == 1, -F.col("v")).otherwise(0.0)).alias("extra"))
    return words.select("key", "n").join(sums, "key", "left").na.fill(0.0, ["delta", "extra"])


def common_words(words: DataFrame, max_common: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the commonest words (all of at least a count that max_common reach), and the other
    columns of the word table."""
    words = words.where("n > 0")
    size = F.floor(F.log2("n") * 16).cast("int")
    floor, have = None, 0
    for r in words.groupBy(size.alias("size")).agg(F.count("*").alias("k"), F.min("n").alias("least")).orderBy(F.desc("size")).collect():  # 1,024 rows at most
        have += r["k"]
        if have > max_common:
            break
        floor = r["least"]
    if floor is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    rows = words.where(F.col("n") >= floor).toPandas()
    key = rows["key"].to_numpy(np.int64).view(np.uint64)
    o = np.argsort(key)
    return key[o], rows["n"].to_numpy(np.int64)[o], rows["delta"].to_numpy()[o], rows["extra"].to_numpy()[o]


ROW = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, h long, tf long, tl long"


def lm_score(docs: DataFrame, max_common: int = 1 << 18) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of `docs`."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    stats = scratch.stored(statistics(docs))
    sums = {r["kind"]: (r["n"], r["k"]) for r in stats.where("kind in (0, 3)").groupBy("kind").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("k")).collect()}
    ends = sums.get(3, (0, 0))[0]
    n_all, n_kinds = sums.get(0, (0, 0))[0] + ends, sums.get(0, (0, 0))[1] + (ends > 0)
    broadcast = docs.sparkSession.sparkContext.broadcast
    sent = broadcast(grow(stats))
    words = scratch.stored(word_table(stats, sent))
    common = broadcast(common_words(words, max_common))
    under = n_all + n_kinds + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, (known, known_n, known_delta, known_extra) = sent.value, common.value
        table = _table(tree, tree)
        for batch in batches:
            for p in tk.pieces(batch):
                w = tk.Words(p, tk.NOT_SPACE, lower=True)
                _, codes, by_code = w.hashes()
                data, offs = stream(p, w)
                symbols = CLASS_OF[data]
                logs = tree.log_next[table[contexts(symbols.astype(np.int32), offs)], symbols] + tree.log_byte[data]
                score = np.add.reduceat(logs.astype(np.float64), offs[:-1])
                at = np.minimum(np.searchsorted(known, by_code), max(len(known) - 1, 0))
                hit = known[at] == by_code if len(known) else np.zeros(len(by_code), bool)
                c = np.where(hit, known_n[at], 0) if len(known) else np.zeros(len(by_code), np.int64)
                sure = hit[codes]
                base = np.bincount(w.doc, weights=np.where(sure, np.log10((c + 1) / under)[codes], 0.0), minlength=len(p)) + math.log10((ends + 1) / under)
                final = w.first[1:][w.counts > 0] - 1
                if len(known):
                    score += np.bincount(w.doc, weights=np.where(hit, known_delta[at], 0.0)[codes], minlength=len(p))
                    score[w.counts > 0] += np.where(hit, known_extra[at], 0.0)[codes[final]]
                n_known = tk.per_doc_sum(sure, w.first) + (ends > 0)
                rid = p.rows.column(3).to_numpy()
                n = len(p)
                spread = tk.mix(rid.astype(np.uint64)).view(np.int64)  # rows of their own meet no word: tf is 0
                yield pa.RecordBatch.from_arrays([pa.array(rid), p.rows.column(0), p.rows.column(2), pa.array(w.counts + 1), pa.array(n_known), pa.array(base), pa.array(score), pa.array(spread), pa.array(np.zeros(n, np.int64)), pa.array(np.zeros(n, np.int64))], NAMES)
                rare = ~sure
                if rare.any():
                    pairs, tf = np.unique(w.doc[rare] * len(by_code) + codes[rare], return_counts=True)
                    tl = np.isin(pairs, w.doc[final] * len(by_code) + codes[final]).astype(np.int64)
                    zero, none = np.zeros(len(pairs), np.int64), np.zeros(len(pairs))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rid[pairs // len(by_code)]), pa.nulls(len(pairs), pa.int64()), pa.nulls(len(pairs), pa.bool_()), pa.array(zero), pa.array(zero), pa.array(none), pa.array(none), pa.array(by_code[pairs % len(by_code)].view(np.int64)), pa.array(tf), pa.array(tl)],
                        NAMES,
                    )

    rows = docs.select("doc_id", "text", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.monotonically_increasing_id().alias("rid")).mapInArrow(run, ROW)
    joined = rows.join(words.withColumnsRenamed({"key": "h", "n": "c"}), "h", "left")
    c = F.coalesce("c", F.lit(0))
    return joined.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(c > 0, F.col("tf")).otherwise(0)).alias("n_known"),
        F.lit(n_all).cast("bigint").alias("train_tokens"),
        F.sum(F.col("base") + F.col("tf") * F.log10((c + 1) / F.lit(float(under)))).alias("base_score"),
        F.sum(F.col("score") + F.when(F.col("tf") > 0, F.col("tf") * F.coalesce("delta", F.lit(0.0)) + F.col("tl") * F.coalesce("extra", F.lit(0.0))).otherwise(0.0)).alias("score"),
    ).drop("rid")


NAMES = [c.split()[0] for c in ROW.split(", ")]
_LAST: list = [None, None]


def _table(value, tree: Tree) -> np.ndarray:
    """The tree's lookup table, built once in each worker for the latest model."""
    if _LAST[0] is not value:
        _LAST[:] = [value, tree.table()]
    return _LAST[1]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
