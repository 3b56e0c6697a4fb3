"""Near-duplicate documents by an exact n-gram Jaccard join (operator 2).

Documents become sets of word shingles; documents with equal sets form a class and only classes are
joined. Shingles are put in one global order, estimated commonest last. For a threshold t, two sets
of at least that similarity share at least l shingles among the first n - ceil(t n) + l of each, for
every l. Each class picks its l by estimated candidate cost: in proportion to its size, as any two texts
may share a passage, and where its prefix holds common shingles, a longer prefix is taken and
correspondingly more shared shingles are asked for before a pair is verified (of two classes the smaller
l holds). Verification compares whole shingle sets. A class whose prefix shares fewer shingles with
anyone than its partners would ask for is left out.

Components need not every link, so rounds link components first: in a round each class meets, in each of
its lists, the head of another component (the two components whose heads have most in common with others
are kept for each list), and is verified against the one it shares most with. Rounds go on while they
link. Then all remaining candidate pairs between different components are taken, with one more exact
bound inside the join: a parity signature of each whole set. Two signatures differ in at most as many
bits as the sets differ in shingles, so a pair whose signatures differ in too many cannot be similar. No
link between different components can be lost, and neither a group of near copies that links nor one
that nearly links makes rows for all its pairs.

The estimate of common shingles only steers the order: counts of shingles frequent within a task's
batch, of which at most `max_common` of the commonest are broadcast. Wrong estimates cost time only.

Defined results: null or wordless texts have no shingles and link with nothing; with fewer words than
`size` the whole sequence is the one shingle. Rows that repeat a doc_id have their own sets, and their
components take the least doc_id. A row with a null doc_id links like any other; its component is that of
its near copies, null if all of them have null doc_ids. A similarity of exactly the threshold is a link.
Texts of any length take part whole; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import scratch
from tidemark.llm import textkit as tk
from tidemark.llm.components import components
from tidemark.llm.streams import shared

#: A shingle counts as frequent in a batch from so many of its classes on.
FREQUENT = 4
#: 64-bit words of a parity signature.
SIGNATURE = 16
SIGNS = [f"s{k}" for k in range(SIGNATURE)]


@dataclass(frozen=True)
class Rule:
    size: int = 5  # words in a shingle
    percent: int = 75  # 100 * intersection >= percent * union
    spread: int = 20  # one match for so many shingles at least: texts that share a passage only fail that
    max_match: int = 8  # how far the number of matches may grow past twice the least
    max_common: int = 1 << 19  # shingles with an estimated count
    block: int = 1024  # sets held at a time while verifying
    max_sent: int = 1 << 19  # rows of five numbers that may be broadcast to fetch texts
    yield_percent: int = 2  # rounds go on while at least so many of the pairs they verify are links

    def floor(self, n):
        """The least overlap of a set of n with any similar one: ceil(t n)."""
        return -(-self.percent * n // 100)


def sets(p: tk.Piece, size: int) -> list[np.ndarray]:
    """Each document's distinct shingle hashes, sorted."""
    h, offs = tk.shingle_hashes(tk.Words(p, tk.NOT_SPACE, lower=True), size)
    return [np.unique(h[offs[i] : offs[i + 1]]) for i in range(len(p))]


def class_of(s: np.ndarray, seed: int) -> tuple[int, int]:
    """Two 64-bit halves of a set's digest, as signed numbers; the first is the class key."""
    x = xxhash.xxh3_128_intdigest(s.tobytes(), seed)
    return int(np.uint64(x & 0xFFFFFFFFFFFFFFFF).view(np.int64)), int(np.uint64(x >> 64).view(np.int64))


def signature(s: np.ndarray) -> np.ndarray:
    """For each of 64 * SIGNATURE buckets, whether the set has an odd number of shingles in it."""
    odd = np.bincount((s >> np.uint64(32)).astype(np.int64) & (64 * SIGNATURE - 1), minlength=64 * SIGNATURE) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


FOUND = ["doc_id", "th", "n", "cls", "twin", *SIGNS]


def classes(docs: DataFrame, rule: Rule, seed: int) -> DataFrame:
    """Rows (doc_id, th, n, cls, twin, signature) of documents, and (cls=null, twin=shingle, n=count) of
    frequent shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, kept = set(), []
            for p in tk.pieces(batch):
                n, cls, twin, signs = [], [], [], []
                for s in sets(p, rule.size):
                    a, b = class_of(s, seed)
                    n.append(len(s)), cls.append(a), twin.append(b), signs.append(signature(s))
                    if len(s) and a not in seen:
                        seen.add(a)
                        kept.append(s)
                signs = np.stack(signs)
                yield pa.RecordBatch.from_arrays([p.rows.column(0), p.rows.column(2), *(pa.array(v, pa.int64()) for v in (n, cls, twin)), *(pa.array(np.ascontiguousarray(signs[:, k])) for k in range(SIGNATURE))], FOUND)
            if kept:
                token = np.sort(np.concatenate(kept))
                head = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
                count = np.diff(np.r_[head, len(token)])
                often = count >= FREQUENT
                none = pa.nulls(int(often.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(count[often]), none, pa.array(token[head][often].view(np.int64)), *[none] * SIGNATURE], FOUND)

    return docs.select("doc_id", "text", "th").mapInArrow(run, ", ".join(f"{c} long" for c in FOUND))


def common_shingles(found: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the commonest shingles and the logarithm of their counts; `most` at most."""
    counts = scratch.stored(found.where("cls is null").groupBy("twin").agg(F.sum("n").alias("n")))
    least, have = None, 0
    size = F.floor(F.log2("n") * 8)
    for r in counts.groupBy(size.alias("s")).agg(F.count("*").alias("k"), F.min("n").alias("n")).orderBy(F.desc("s")).collect():  # 512 rows at most
        have += r["k"]
        if have > most:
            break
        least = r["n"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = counts.where(F.col("n") >= least).toPandas()
    scratch.free(counts)
    key = rows["twin"].to_numpy(np.int64).view(np.uint64)
    o = np.argsort(key)
    return key[o], np.log2(rows["n"].to_numpy()).astype(np.int64)[o]


def prefix(s: np.ndarray, common: np.ndarray, weight: np.ndarray, rule: Rule) -> tuple[np.ndarray, int]:
    """The set's prefix in the global order, and how many matches it asks for."""
    n = len(s)
    w = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        w = np.where(common[at] == s, weight[at], 0)
    floor = int(rule.floor(n))
    least = min(1 + n // rule.spread, floor)
    if not w.any():
        return s[: n - floor + least], least
    order = np.lexsort((s, w))
    cost = np.cumsum(2.0 ** w[order] - 1)  # partners expected through the shingles so far
    tries = np.arange(least, min(2 * least + rule.max_match, floor) + 1)
    k = int(tries[np.argmin((cost[n - floor + tries - 1] + 1) / tries + tries)])
    return s[order[: n - floor + k]], k


def postings(docs: DataFrame, rule: Rule, seed: int, common: tuple) -> DataFrame:
    """(token, cls, n, l) of the prefixes, once for each class and batch."""
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set = set()
            for p in tk.pieces(batch):
                cls, n, match, tokens = [], [], [], []
                for s in sets(p, rule.size):
                    key = class_of(s, seed)[0] if len(s) else None
                    if key is None or key in seen:
                        continue
                    seen.add(key)
                    t, k = prefix(s, *sent.value, rule)
                    cls.append(key), n.append(len(s)), match.append(k), tokens.append(t)
                if tokens:
                    size = [len(t) for t in tokens]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), *(pa.array(np.repeat(np.array(v, np.int64), size)) for v in (cls, n, match))], ["token", "cls", "n", "l"])

    return docs.select("text").mapInArrow(run, "token long, cls long, n long, l long")


def verify(docs: DataFrame, pairs: DataFrame, reps: DataFrame, rule: Rule, seed: int) -> tuple[DataFrame, int]:
    """Of class pairs (x, y), those that are similar, as (a, b); and the number of pairs.

    The y's are dealt to blocks of about `rule.block` sets and as many pairs, a y with more pairs to
    several. An x goes once to each block that holds partners of it, after that block's own
    sets, and after the list of those partners.
    """
    pairs = scratch.stored(pairs)
    load = rule.block
    degree = pairs.groupBy("y").agg(F.count("*").alias("c"))
    many, n_pairs = degree.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    blocks = max(1, -(-many // rule.block), min(many, -(-n_pairs // load)))
    key = F.pmod(F.xxhash64("y"), F.lit(blocks)) * (1 << 24) + F.pmod(F.xxhash64("x", F.lit(1)), F.ceil(F.col("c") / load))
    dealt = scratch.stored(pairs.join(degree, "y").select("x", "y", key.alias("key")))
    own = dealt.select("key", F.lit(0).alias("late"), F.col("y").alias("cls")).distinct()
    late = dealt.select("key", F.lit(1).alias("late"), F.col("x").alias("cls")).distinct()
    want = scratch.stored(own.unionByName(late).join(reps.select("cls", *place(F.col("doc_id"), F.col("th"))), "cls"))
    sent = F.broadcast(want) if want.count() <= rule.max_sent else want
    there = docs.select("text", *place(F.col("doc_id"), F.col("th")))
    partners = dealt.groupBy("key", F.col("x").alias("cls")).agg(F.collect_list("y").alias("ys")).select("key", F.lit(1).alias("late"), "cls", F.lit(0).alias("text_row"), "ys", F.lit(None).cast("string").alias("text"))
    texts = there.join(sent, ["nil", "place"]).select("key", "late", "cls", F.lit(1).alias("text_row"), F.lit(None).cast("array<bigint>").alias("ys"), "text")
    both = texts.unionByName(partners).repartition(scratch.partitions(docs.sparkSession), "key").sortWithinPartitions("key", "late", "cls", "text_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, done, due = None, {}, None, []
        for batch in batches:
            for p in tk.pieces(batch):
                a, b = [], []
                cols = [p.rows.column(k).to_pylist() for k in range(5)]
                for (k, late, cls, text_row, ys), s in zip(zip(*cols, strict=True), sets(p, rule.size), strict=True):
                    if k != key:
                        key, held, done = k, {}, None
                    if not text_row:
                        due = ys
                        continue
                    if (late, cls) == done or class_of(s, seed)[0] != cls:  # there already, or another text of that doc_id
                        continue
                    done = (late, cls)
                    if not late:
                        held[cls] = s
                        continue
                    for y in due:
                        head = held.get(y)
                        if head is None:
                            continue
                        at = np.minimum(np.searchsorted(head, s), len(head) - 1)
                        same = int((head[at] == s).sum())
                        if 100 * same >= rule.percent * (len(head) + len(s) - same):
                            a.append(y), b.append(cls)
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    links = scratch.stored(both.mapInArrow(run, "a long, b long"))
    scratch.free(pairs, dealt, want)
    return links, n_pairs


def place(doc_id, th) -> list[F.Column]:
    """Where a text is found: by its doc_id, or where that is null by its hash."""
    return [doc_id.isNull().alias("nil"), F.coalesce(doc_id, th).alias("place")]


@dataclass(frozen=True)
class Lists:
    """Documents with their classes, and the posting lists of the classes' prefixes."""

    docs: DataFrame  # doc_id, text, th
    rows: DataFrame  # doc_id, n, cls
    reps: DataFrame  # cls, n, doc_id (the least), th, signature
    lists: DataFrame  # token, cls, n, l, part
    seed: int


def prepare(docs: DataFrame, rule: Rule) -> Lists:
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("th", F.when(F.col("doc_id").isNull(), F.xxhash64("text")))
    for seed in range(8):
        found = scratch.stored(classes(docs, rule, seed))
        rows = found.where("cls is not null")
        least = [F.min(c).alias(c) for c in ("doc_id", "th")] + [F.max(c).alias(c) for c in SIGNS]
        reps = scratch.stored(rows.where("n > 0").groupBy("cls", "n").agg(*least, F.min("twin").alias("t0"), F.max("twin").alias("t1")))
        if reps.where("t0 <> t1").isEmpty():  # else two sets met in 64 bits: take another seed
            break
    n_parts = scratch.partitions(docs.sparkSession)
    index = postings(docs, rule, seed, common_shingles(found, rule.max_common)).repartition(n_parts, "token").sortWithinPartitions("token", "cls")
    raw = scratch.stored(shared(index))
    own = raw.groupBy("cls").agg(F.count("*").alias("s"))
    part = F.col("s") / (F.col("n") - F.ceil(F.col("n") * rule.percent / 100) + F.col("l"))  # of the prefix, what others have too
    lists = scratch.stored(raw.join(own, "cls").where(F.col("s") >= _asked(rule)).select("token", "cls", "n", "l", part.alias("part")))
    scratch.free(raw)
    return Lists(docs, rows.select("doc_id", "n", "cls"), reps.drop("t0", "t1"), lists, seed)


def _similar_size(rule: Rule) -> F.Column:
    return F.least("n", "pn") * 100 >= F.greatest("n", "pn") * rule.percent


def _matched(pairs: DataFrame) -> DataFrame:
    """(cls, y, k): pairs that share as many prefix shingles as the less demanding of them asks for."""
    return pairs.groupBy("cls", "y").agg(F.count("*").alias("k"), F.min(F.least("l", "pl")).alias("l")).where("k >= l")


def _partners(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("token", F.col("cls").alias("y"), F.col("n").alias("pn"), F.col("l").alias("pl"), F.col("comp").alias("pc"), *[F.col(c).alias(f"p{c}") for c in more])


def _asked(rule: Rule) -> F.Column:
    """Of a class, the least number of matches that any partner asks for."""
    return F.least("l", F.floor(F.ceil(F.col("n") * rule.percent / 100) / rule.spread) + 1)


def _open(lists: DataFrame, rule: Rule) -> DataFrame:
    """The lists that more than one component takes part in, without classes that are in too few of them."""
    several = lists.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("token")
    rows = lists.join(several, "token")
    enough = rows.groupBy("cls").agg(F.count("*").alias("s"), F.min("n").alias("n"), F.min("l").alias("l")).where(F.col("s") >= _asked(rule)).select("cls")
    return rows.join(enough, "cls")


def heads_of(lists: DataFrame, rule: Rule) -> DataFrame:
    """(x, y): for each class the head of another component that it shares most prefix shingles with."""
    best = lists.groupBy("token", "comp").agg(F.max(F.struct("part", "cls", "n", "l")).alias("h")).select("token", "comp", "h.*")
    rank = F.row_number().over(Window.partitionBy("token").orderBy(F.desc("part"), "cls"))
    heads = best.withColumn("rank", rank).where("rank <= 2")
    near = _matched(lists.join(_partners(heads), "token").where("comp <> pc").where(_similar_size(rule)))
    return near.groupBy(F.col("cls").alias("x")).agg(F.max_by("y", F.struct("k", "y")).alias("y"))


def remaining(lists: DataFrame, reps: DataFrame, rule: Rule) -> DataFrame:
    """(x, y): all candidate pairs of classes in different components."""
    signed = scratch.stored(lists.join(reps.select("cls", *SIGNS), "cls"))
    differ = reduce(add, [F.bit_count(F.col(s).bitwiseXOR(F.col(f"p{s}"))) for s in SIGNS])
    able = (F.col("n") + F.col("pn")) * (100 - rule.percent) >= differ * (100 + rule.percent)
    pairs = signed.join(_partners(signed, *SIGNS), "token").where("cls < y and comp <> pc").where(_similar_size(rule)).where(able)
    return _matched(pairs).select(F.col("cls").alias("x"), "y")


def component_classes(found: Lists, rule: Rule) -> DataFrame:
    """(node, component) of linked classes."""
    lists = found.lists.withColumn("comp", F.col("cls"))
    links, group = [], None
    while True:
        new, tried = verify(found.docs, heads_of(lists, rule), found.reps, rule, found.seed)
        n = new.count()
        links.append(new)
        if n:
            whole = reduce(DataFrame.unionByName, links)
            group = scratch.stored(components(whole))
            comp = F.coalesce("component", "cls")
            lists = scratch.stored(_open(found.lists.join(group, found.lists["cls"] == group["node"], "left").select(*found.lists.columns, comp.alias("comp")), rule))
        if 100 * n <= rule.yield_percent * tried:
            break
    last, _ = verify(found.docs, remaining(lists, found.reps, rule), found.reps, rule, found.seed)
    return components(reduce(DataFrame.unionByName, [*links, last]))


def jaccard_components(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of `docs`."""
    found = prepare(docs, rule)
    group = component_classes(found, rule)
    named = found.reps.select("cls", "doc_id").join(group, F.col("cls") == F.col("node"), "left").select("cls", "doc_id", F.coalesce("component", "cls").alias("comp"))
    named = scratch.stored(named)
    least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    label = named.select("cls", "comp").join(least, "comp").select("cls", "component_id")
    rows = found.rows.join(label, "cls", "left")
    alone = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"))


def jaccard_links(docs: DataFrame, rule: Rule = Rule()) -> tuple[DataFrame, DataFrame]:
    """All links: (doc_id, n_shingles, class_id, n_links) for each row, and the pairs (a, b) of linked
    classes. A row links with all others of its class and of the classes linked with that; rows without
    shingles have a null class_id. Pairs grow with what is linked, as they are all listed."""
    found = prepare(docs, rule)
    lists = found.lists.withColumn("comp", F.col("cls"))
    pairs, _ = verify(found.docs, remaining(lists, found.reps, rule), found.reps, rule, found.seed)
    rows = found.rows.withColumn("class_id", F.when(F.col("n") > 0, F.col("cls")))
    size = rows.where("n > 0").groupBy("class_id").agg(F.count("*").alias("size"))
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    out = both.join(size, both["b"] == size["class_id"]).groupBy("a").agg(F.sum("size").alias("out"))
    counted = size.join(out, size["class_id"] == out["a"], "left").select("class_id", (F.col("size") - 1 + F.coalesce("out", F.lit(0))).alias("n_links"))
    rows = rows.join(counted, "class_id", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), pairs


def one_of_each(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The rows of `docs` whose doc_id is that of their component, all columns kept.

    Rows with a null doc_id stay; of rows that repeat a doc_id all stay or go together. The ids that go
    are broadcast only if there are at most `rule.max_sent`.
    """
    gone = jaccard_components(docs, rule).where("doc_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    gone = scratch.stored(gone)
    gone = F.broadcast(gone) if gone.count() <= rule.max_sent else gone
    return docs.join(gone, docs["doc_id"].cast("bigint") == gone["_gone"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
