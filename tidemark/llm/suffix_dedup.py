"""Byte-level removal of repeated substrings by bucket-pointer refinement (operator 7).

A byte goes if a `length`-byte string that covers it also starts in a document of smaller doc_id.
Suffixes are sorted into buckets only as deep as that needs:

1. Initial buckets hold suffixes by their first `gram` bytes. Bucket identifiers come from doubling:
   a bucket of 2h bytes is named by the identifiers at offsets 0 and h, so each level reuses the last.
   Only anchors enter the shuffle: the least bucket identifier in every window of `length` bytes, a
   choice that depends on the window's bytes alone, so equal strings meet in equal anchors.
2. Buckets that lie in one document are final. For the others, each anchor stands for the range of
   strings that chose it. Buckets are refined by the identifiers at later offsets that name the whole
   range: of equal ranges the one in the smallest document goes on, the rest are covered. It goes on
   only if a different range of its bucket has the same bytes before or after the gram, as far as
   any shared string would need.
3. What goes on, the ends of repeats for the most part, is refined per string: each string of the
   range is named by its own identifiers, and its smallest document found.
4. Covered strings become spans, merged per document.

Buckets are streamed in sorted order; of a bucket that is read only its distinct ranges or strings are held.
Identifiers are 64 bits wide. Strings count as equal if they lie in one bucket and both of two identifiers agree:
of a range the name and its sides, of a string names from two tables of bytes. All texts take part
whole; a document shorter than `length` keeps all.

Defined results: null text is empty; a row with a null doc_id keeps its bytes and removes none elsewhere;
rows that repeat a doc_id are the same document for the rule (neither removes bytes of the other) and
are cut one by one, told apart by numbers that different texts of one doc_id get (2^20 at most; more
raise an error); other columns pass, whatever their names, but one named like a result is replaced by it; of
copies the least doc_id is the one that keeps its bytes; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import scratch
from tidemark.llm import textkit as tk
from tidemark.llm.streams import shared

GRAM = 16
LENGTH = 50
REACH = LENGTH - GRAM + 1  # grams in a string

_FIRST = tk.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_OTHER = tk.mix(_FIRST + np.uint64(0x2545F4914F6CDD1D))  # for second names of strings
_ODD = np.uint64(0x9FB21C651E98DF25)
_PLACE = np.uint64(34)  # bits for a place in a piece


_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def _pair(x: np.ndarray, apart: int) -> np.ndarray:
    """Identifiers of twice the content from those at two offsets. The shifted half and the product keep each
    level from being linear in the last one, so no exchange of bytes between offsets cancels out."""
    n = len(x) - apart
    if n <= 0:
        return x[:0]
    out = x[:n] * _ODD
    out += x[apart:]
    out ^= out >> np.uint64(32)
    out *= _SPREAD
    return out


def identifiers(data: np.ndarray, first: np.ndarray = _FIRST) -> tuple[np.ndarray, np.ndarray]:
    """Bucket identifiers of the GRAM and of the LENGTH bytes from each place on; `first` names single bytes."""
    x = first[data]
    for h in (1, 2, 4, 8):
        x = _pair(x, h)
    return x, _pair(_pair(x, 16), LENGTH - 32)


def anchors(gram: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, lo, hi): the anchor chosen by all strings that start in lo..hi, in text order."""
    n = len(gram)
    none = np.zeros(0, np.int64)
    if n < REACH:
        return none, none, none
    key = (tk.mix(gram) >> _PLACE) << _PLACE | np.arange(n, dtype=np.uint64)
    for h in (1, 2, 4, 8, 16):
        key = np.minimum(key[:-h], key[h:])
    key = np.minimum(key[: n - REACH + 1], key[REACH - 32 :][: n - REACH + 1])
    inside = np.zeros(len(key) + 1, np.int64)  # strings that lie in one document
    first, last = offs[:-1], offs[1:] - LENGTH + 1
    has = last > first
    np.add.at(inside, first[has], 1)
    np.add.at(inside, last[has], -1)
    at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(at):
        return none, none, none
    chosen = (key[at] & np.uint64((1 << 34) - 1)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    return chosen[new], at[new], at[np.r_[new[1:], len(at)] - 1]


#: Bits of a bucket identifier that the search for shared buckets leaves out: what it finds is a superset, of
#: buckets that share the others, and the shuffle of all anchors takes two bytes less for each.
_SPARED = np.uint64(16)


def _first_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for p in tk.pieces(batch, "text"):
            ids = p.rows.column(0)
            gram, _ = identifiers(p.data)
            at, _, _ = anchors(gram, p.offs)
            doc = np.searchsorted(p.offs, at, side="right") - 1
            ok = ids.is_valid().to_numpy(zero_copy_only=False)[doc]
            own = ids.fill_null(0).to_numpy()[doc]
            yield pa.RecordBatch.from_arrays([pa.array((gram[at[ok]] >> _SPARED).view(np.int64)), pa.array(own[ok])], ["g", "doc_id"])


def _runs(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merged [lo, hi) of each row; input sorted by (row, lo)."""
    if not len(row):
        return row, lo, hi
    base = row.astype(np.int64) << 36
    end = np.maximum.accumulate(base + hi)
    new = np.r_[True, base[1:] + lo[1:] > end[:-1]]
    at = np.flatnonzero(new)
    return row[at], lo[at], end[np.r_[at[1:], len(row)] - 1] - base[at]


#: A range: lo, hi - lo, anchor - lo and the text's number within its doc_id share 64 bits.
_HI, _X, _TAG = 32, 38, 44


def _pack(lo, n, x, tag) -> np.ndarray:
    return (lo.astype(np.uint64) | n.astype(np.uint64) << np.uint64(_HI) | x.astype(np.uint64) << np.uint64(_X) | tag.astype(np.uint64) << np.uint64(_TAG)).view(np.int64)


def _unpack(at: np.ndarray) -> tuple[np.ndarray, ...]:
    v = at.view(np.uint64)
    cut = lambda k, bits: ((v >> np.uint64(k)) & np.uint64((1 << bits) - 1)).astype(np.int64)
    return cut(0, 32), cut(_HI, 6), cut(_X, 6), cut(_TAG, 20)


RANGES = "g long, name long, doc_id long, at long, sides long"
RANGE_NAMES = [c.split()[0] for c in RANGES.split(", ")]
SETTLED = "doc_id long, at long, covered long"
HALF = (LENGTH - GRAM) // 2  # a string reaches so far from its anchor's gram on one side at least


def _emit(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ranges of anchors whose bucket several documents share.

    name: identifier of all the range's strings; sides: 32 bits of the identifier of the gram with the
    HALF bytes before it, and with those after it, each 0 if the range does not reach so far. A range
    that an earlier document of the batch has too is covered: such ranges are merged to spans, which go
    with name 0 and their length for sides.
    """
    for batch in batches:
        parts, base = [], 0
        all_ids = batch.column(0).fill_null(0).to_numpy()
        for p in tk.pieces(batch, "text"):
            shares, tags = p.rows.column(3), p.rows.column(2).to_numpy()
            gram, full = identifiers(p.data)
            wide = _pair(_pair(gram, 16), 1) if len(gram) > 16 else gram[:0]  # GRAM + HALF = 33 bytes: 32, then 1 on
            at, lo, hi = anchors(gram, p.offs)
            g = gram[at]
            cut = np.searchsorted(at, p.offs)
            keep = np.zeros(len(at), bool)
            for d in np.flatnonzero(shares.is_valid().to_numpy(zero_copy_only=False) & (cut[1:] > cut[:-1])).tolist():
                want = np.sort(shares[d].values.to_numpy(zero_copy_only=False).view(np.uint64))
                own = g[cut[d] : cut[d + 1]] >> _SPARED
                keep[cut[d] : cut[d + 1]] = want[np.minimum(np.searchsorted(want, own), len(want) - 1)] == own
            at, lo, hi, g = at[keep], lo[keep], hi[keep], g[keep]
            doc = np.searchsorted(p.offs, at, side="right") - 1
            name = tk.mix(full[lo] * _ODD + tk.mix(full[hi] + (at - lo).astype(np.uint64) * np.uint64(64) + (hi - at + LENGTH).astype(np.uint64)) + g)
            last = max(len(wide) - 1, 0)
            side = lambda ok, k: np.where(ok, tk.mix(wide[np.clip(k, 0, last)]) >> np.uint64(32) | np.uint64(1), np.uint64(0))  # noqa: B023, E731
            sides = side(lo <= at - HALF, at - HALF) << np.uint64(32) | side(hi >= at - HALF + 1, at) if len(wide) else np.zeros(len(at), np.uint64)
            parts.append((name | np.uint64(1), doc + base, lo - p.offs[doc], hi - lo, at - lo, g, tags[doc], sides))
            base += len(p)
        name, row, lo, n, x, g, tag, sides = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 8
        if not len(row):
            continue
        own = all_ids[row]
        order = np.lexsort((own, sides, name))
        head = np.r_[True, (name[order][1:] != name[order][:-1]) | (sides[order][1:] != sides[order][:-1])]
        least = np.empty(len(name), np.int64)
        least[order] = own[order][np.flatnonzero(head)][np.cumsum(head) - 1]
        done = own > least
        on = ~done
        yield _emit([g[on].view(np.int64), name[on].view(np.int64), own[on], _pack(lo[on], n[on], x[on], tag[on]), sides[on].view(np.int64)], RANGE_NAMES)
        r, a, b = _runs(row[done], lo[done], lo[done] + n[done] + LENGTH)  # in (row, lo) order already
        if len(r):
            zero, tag_of = np.zeros(len(r), np.int64), np.zeros(base, np.int64)
            tag_of[row] = tag
            own = all_ids[r]
            yield _emit([tk.mix(own.astype(np.uint64)).view(np.int64), zero, own, _pack(a, zero, zero, tag_of[r]), b - a], RANGE_NAMES)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered and open ranges, from ranges sorted by (g, name, sides, doc_id); `covered`: bytes, 0 if open.

    A range is covered if an earlier document has the same range. The earliest of each name stays open
    if another name of the bucket shares one of its sides; else no other document shares a string of it.
    Of a bucket being read only the earliest rows of each name are held, each once.
    """
    names = [c.split()[0] for c in SETTLED.split(", ")]
    held: list[list[np.ndarray]] = []  # earliest rows of the bucket being read
    last: tuple | None = None  # (g, name, sides) of the last row, and the earliest document that has it

    def open_ranges(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        """Of complete buckets' earliest rows, those with a shared side."""
        g, name, own, at, sides = (np.concatenate(c) for c in zip(*parts))
        first = np.r_[True, (g[1:] != g[:-1]) | (name[1:] != name[:-1]) | (sides[1:] != sides[:-1])]
        shared_side = np.zeros(len(g), bool)
        for shift in (32, 0):
            part = (sides.view(np.uint64) >> np.uint64(shift)) & np.uint64(0xFFFFFFFF)
            idx = np.flatnonzero(first & (part > 0))
            key = tk.mix(g[idx].view(np.uint64)) + part[idx]
            _, back, count = np.unique(key, return_inverse=True, return_counts=True)
            shared_side[idx] |= count[back] > 1
        group = np.cumsum(first) - 1
        keep = shared_side[np.flatnonzero(first)][group]
        return _emit([own[keep], at[keep], np.zeros(int(keep.sum()), np.int64)], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        g, name, own, at, sides = (batch.column(k).to_numpy() for k in range(5))
        begin = np.r_[True, (g[1:] != g[:-1]) | (name[1:] != name[:-1]) | (sides[1:] != sides[:-1])]
        least = own[np.flatnonzero(begin)][np.cumsum(begin) - 1]
        if last is not None and (g[0], name[0], sides[0]) == last[:3]:
            least[np.cumsum(begin) == 1] = last[3]
        last = (g[-1], name[-1], sides[-1], least[-1])
        out = (own > least) | (name == 0)
        if out.any():
            yield _emit([own[out], at[out], np.where(name[out] == 0, sides[out], _unpack(at[out])[1] + LENGTH)], names)
        rest = [v[~out] for v in (g, name, own, at, sides)]
        ended = int((rest[0] != g[-1]).sum())  # the bucket still read comes last
        if held and held[-1][0][-1] != g[-1] or ended:
            held.append([v[:ended] for v in rest])
            if sum(len(h[0]) for h in held):
                yield open_ranges(held)
            held = []
        if ended < len(rest[0]):
            held.append([v[ended:] for v in rest])
    if held:
        yield open_ranges(held)


STRINGS = "g long, doc_id long, tag long, lo long, hi long, bytes binary"
STRING_NAMES = [c.split()[0] for c in STRINGS.split(", ")]


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open ranges with their bytes, to be refined string by string; and the covered spans, merged."""
    for batch in batches:
        known, opened = [], []
        for p in tk.pieces(batch, "text"):
            found = p.rows.column(3)
            ids = p.rows.column(0).fill_null(0).to_numpy()
            has = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
            if not len(has):
                continue
            tags = p.rows.column(2).to_numpy()
            flat = found.filter(pa.array(found.is_valid().to_numpy(zero_copy_only=False)))
            size = flat.value_lengths().to_numpy()
            doc = np.repeat(has, size)
            at, covered = (f.to_numpy(zero_copy_only=False) for f in flat.flatten().flatten())
            lo, n, x, tag = _unpack(at)
            mine = tag == tags[doc]
            doc, lo, n, x, covered = doc[mine], lo[mine], n[mine], x[mine], covered[mine]
            o = np.flatnonzero(covered)
            o = o[np.lexsort((lo[o], doc[o]))]
            r, a, b = _runs(doc[o], lo[o], lo[o] + covered[o])
            if len(r):
                known.append((tk.mix(ids[r].astype(np.uint64)).view(np.int64), ids[r], tags[r], a, b))
            o = np.flatnonzero(covered == 0)
            if not len(o):
                continue
            place = p.offs[doc[o]] + lo[o]
            gram, _ = identifiers(p.data)
            span = n[o] + LENGTH
            ends = np.cumsum(span)
            src = np.repeat(place - (ends - span), span) + np.arange(ends[-1])
            held = pa.Array.from_buffers(pa.binary(), len(o), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(p.data[src]))])
            opened.append((gram[place + x[o]].view(np.int64), ids[doc[o]], tags[doc[o]], lo[o], lo[o] + n[o], held))
        for *cols, held in opened:
            yield pa.RecordBatch.from_arrays([*(pa.array(v) for v in cols), held], STRING_NAMES)
        for cols in known:
            yield pa.RecordBatch.from_arrays([*(pa.array(v) for v in cols), pa.nulls(len(cols[0]), pa.binary())], STRING_NAMES)


SPANS = "doc_id long, tag long, lo long, hi long"


def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered spans from ranges sorted by (g, doc_id): those whose strings a smaller document has too."""
    names = [c.split()[0] for c in SPANS.split(", ")]
    none = np.zeros(0, np.uint64)
    held_g, held_key, held_twin, held_own = None, none, none, np.zeros(0, np.int64)
    for batch in batches:
        known = batch.column(5).is_null().to_numpy(zero_copy_only=False)
        if known.any():
            part = batch.filter(pa.array(known))
            yield pa.RecordBatch.from_arrays([part.column(k) for k in (1, 2, 3, 4)], names)
        part = batch.filter(pa.array(~known))
        if not part.num_rows:
            continue
        g, own, tag, lo, hi = (part.column(k).to_numpy() for k in range(5))
        texts = part.column(5)
        offs = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        flat = np.frombuffer(texts.buffers()[2], np.uint8)[offs[0] : offs[-1]]
        offs = offs - offs[0]
        _, full = identifiers(flat)
        count = hi - lo + 1
        first = np.cumsum(count) - count
        row = np.repeat(np.arange(len(g)), count)
        k = np.arange(len(row)) - first[row]
        key = tk.mix(full[offs[row] + k] * _ODD + g.view(np.uint64)[row])
        twin = identifiers(flat, _OTHER)[1][offs[row] + k]
        doc = own[row]
        n = len(key)
        if held_g is not None and g[0] == held_g:
            key, twin, doc = np.r_[key, held_key], np.r_[twin, held_twin], np.r_[doc, held_own]
        order = np.lexsort((doc, twin, key))
        head = np.r_[True, (key[order][1:] != key[order][:-1]) | (twin[order][1:] != twin[order][:-1])]
        least = np.empty(len(key), np.int64)
        least[order] = doc[order][np.flatnonzero(head)][np.cumsum(head) - 1]
        covered = doc[:n] > least[:n]
        tail = np.flatnonzero(np.r_[g[row] == g[-1], np.full(len(key) - n, held_g is not None and g[-1] == held_g)])
        one = tail[np.lexsort((twin[tail], key[tail]))]
        one = one[np.r_[True, (key[one][1:] != key[one][:-1]) | (twin[one][1:] != twin[one][:-1])]]
        held_g, held_key, held_twin, held_own = g[-1], key[one], twin[one], least[one]
        hit = np.flatnonzero(covered)
        r, a, b = _runs(row[hit], lo[row[hit]] + k[hit], lo[row[hit]] + k[hit] + LENGTH)
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array(own[r]), pa.array(tag[r]), pa.array(a), pa.array(b)], names)


TEXTS = 1 << 20  # different texts of one doc_id that its numbers can tell apart


def numbered(docs: DataFrame) -> DataFrame:
    """`docs` with `tag`: which of its doc_id's different texts a row has; 0 where there is one."""
    digest = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(2), "text").alias("h2")]
    seen = docs.select("doc_id", *digest)
    many = seen.groupBy("doc_id").agg(*[f(c).alias(f"{n}{c}") for c in ("h1", "h2") for n, f in (("a", F.min), ("b", F.max))]).where("ah1 <> bh1 or ah2 <> bh2").select("doc_id")
    texts = seen.join(many, "doc_id", "left_semi").distinct()
    tags = scratch.stored(texts.withColumn("tag", F.row_number().over(Window.partitionBy("doc_id").orderBy("h1", "h2")).cast("bigint") - 1))
    most = tags.agg(F.max("tag")).first()[0]
    if most is None:
        return docs.withColumn("tag", F.lit(0).cast("bigint"))
    if most >= TEXTS:
        raise ValueError(f"a doc_id has {most + 1} different texts; {TEXTS} can be told apart")
    found = docs.select("*", *digest).join(tags, ["doc_id", "h1", "h2"], "left")
    return found.select(*docs.columns, F.coalesce("tag", F.lit(0)).alias("tag"))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, tag, rest) of the rows with a doc_id, dealt by it; one exchange serves all steps.
    `rest` holds the other columns, so that no name of theirs can clash."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*others) if others else F.struct(F.lit(0).alias("none"))
    typed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", rest.alias("rest")).where("doc_id is not null")
    return numbered(typed).repartition(scratch.partitions(docs.sparkSession), "doc_id")


def copies(docs: DataFrame) -> DataFrame:
    """(doc_id, same): digests of texts that a smaller doc_id has whole; all their bytes are covered, and
    none of their strings is the earliest, so the rest of the work leaves them out."""
    t = docs.where(F.octet_length("text") >= LENGTH).where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("same"), F.xxhash64(F.lit(1), "text").alias("twin"))
    first = t.groupBy("same", "twin").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    late = t.join(first, ["same", "twin"]).where("doc_id > first")
    return scratch.stored(late.groupBy("doc_id").agg(F.collect_set("same").alias("same")))


def _marked(dealt: DataFrame, marks: DataFrame) -> DataFrame:
    """`dealt` with `copy`: whether the row is such a copy."""
    j = dealt.join(marks.hint("shuffle_hash"), "doc_id", "left")
    return j.select(*dealt.columns, F.coalesce(F.array_contains("same", F.xxhash64("text")), F.lit(False)).alias("copy"))


def repeats(dealt: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc_id, spans): byte spans of documents other than whole copies (`marks`) that earlier documents
    hold; spans may overlap."""
    n = scratch.partitions(dealt.sparkSession)
    marked = _marked(dealt.select("doc_id", "text", "tag"), marks)
    texts = marked.select("doc_id", F.when(~F.col("copy"), F.col("text")).alias("text"), "tag")
    by_doc = lambda rows, *c: rows.repartition(n, "doc_id").groupBy("doc_id").agg(F.collect_list(c[0] if len(c) == 1 else F.struct(*c)).alias("found")).hint("shuffle_hash")
    fetch = lambda found: texts.join(found, "doc_id", "left").select("doc_id", "text", "tag", "found")
    first = texts.mapInArrow(_first_buckets, "g long, doc_id long")
    several = shared(first.repartition(n, "g").sortWithinPartitions("g", "doc_id")).select("doc_id", "g")
    ranges = fetch(by_doc(several, "g")).mapInArrow(_ranges, RANGES).repartition(n, "g").sortWithinPartitions("g", "name", "sides", "doc_id")
    settled = ranges.mapInArrow(_settle, SETTLED)
    strings = fetch(by_doc(settled, "at", "covered")).mapInArrow(_strings, STRINGS).repartition(n, "g").sortWithinPartitions("g", "doc_id")
    spans = strings.mapInArrow(_refine, SPANS)
    return spans.repartition(n, "doc_id").groupBy("doc_id").agg(F.collect_list(F.struct("tag", "lo", "hi")).alias("spans"))


MEASURES = ("n_bytes", "n_removed", "n_spans")


def cut(dealt: DataFrame, spans: DataFrame, marks: DataFrame, whole: bool = False) -> DataFrame:
    """(doc_id, text, rest) of `dealt`, with n_bytes, n_removed, n_spans and `kept`, the remaining bytes.

    whole: a character that loses some of its bytes loses all, so that `kept` is valid UTF-8."""
    own = ["doc_id", "text", "rest"]
    schema = T.StructType([*(dealt.schema[c] for c in own), *(T.StructField(c, T.LongType()) for c in MEASURES), T.StructField("kept", T.BinaryType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in tk.pieces(batch, "text"):
                found, tags = p.rows.column(4), p.rows.column(3).to_numpy()
                copy = p.rows.column(5).to_numpy(zero_copy_only=False)
                removed, n_spans, kept = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64), []
                raw = p.data.tobytes()
                for d, (a, b) in enumerate(zip(p.offs[:-1].tolist(), p.offs[1:].tolist(), strict=True)):
                    text, out, at = raw[a:b], [], 0
                    if copy[d]:
                        removed[d], n_spans[d] = b - a, 1
                        kept.append(b"")
                        continue
                    if found[d].is_valid:
                        flat = found[d].values.flatten()
                        mine = flat[0].to_numpy() == tags[d]
                        lo, hi = flat[1].to_numpy()[mine], flat[2].to_numpy()[mine]
                        o = np.argsort(lo, kind="stable")
                        _, lo, hi = _runs(np.zeros(len(o), np.int64), lo[o], hi[o])
                        removed[d], n_spans[d] = int((hi - lo).sum()), len(lo)
                        for x, y in zip(lo.tolist(), hi.tolist(), strict=True):
                            out.append(text[at:x])
                            at = y
                    out.append(text[at:])
                    rest = b"".join(out)
                    kept.append(b"".join(x.decode(errors="ignore").encode() for x in out) if whole and len(out) > 1 else rest)
                yield pa.RecordBatch.from_arrays([*(p.rows.column(k) for k in range(3)), pa.array(p.lengths), pa.array(removed), pa.array(n_spans), pa.array(kept, pa.binary())], names)

    return _marked(dealt, marks).join(spans.hint("shuffle_hash"), "doc_id", "left").select(*own, "tag", "spans", "copy").mapInArrow(run, schema)


def _measured(docs: DataFrame, whole: bool) -> DataFrame:
    """(doc_id, text, rest, n_bytes, n_removed, n_spans, kept) of all rows."""
    dealt, marks = keyed(docs), copies(docs)
    found = cut(dealt, repeats(dealt, marks), marks, whole)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*others) if others else F.struct(F.lit(0).alias("none"))
    text = F.coalesce("text", F.lit(""))
    without = docs.where("doc_id is null").select(F.lit(None).cast("bigint").alias("doc_id"), "text", rest.alias("rest"), F.octet_length(text).cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"), text.cast("binary").alias("kept"))
    return found.unionByName(without)


def suffix_dedup(docs: DataFrame, whole: bool = False) -> DataFrame:
    """`docs` (doc_id, text and any other columns) with n_bytes, n_removed, n_spans and kept bytes."""
    results = [*MEASURES, "kept"]
    columns = [c for c in docs.columns if c.lower() not in results]
    return _measured(docs, whole).select(*[F.col(c) if c in ("doc_id", "text") else F.col("rest")[c].alias(c) for c in columns], *results)


def shortened(docs: DataFrame) -> DataFrame:
    """`docs` with the remaining text (whole characters only) and its n_chars; emptied rows are left out."""
    found = _measured(docs, whole=True).where("n_removed = 0 or n_removed < n_bytes")
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept").cast("string")).otherwise(F.col("text"))
    columns = {c: F.col("rest")[c] for c in docs.columns if c not in ("doc_id", "text")} | {"text": text, "doc_id": F.col("doc_id")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(changed, F.char_length(text)).otherwise(columns["n_chars"])
    return found.select(*[columns[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
