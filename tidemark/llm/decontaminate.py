"""Benchmark decontamination with a distributed positional inverted index (operator 8).

Only DataFrame functions are used. Words of the training texts that occur in a benchmark are postings
(term, document, position). For every window of `size` consecutive item words the rarest terms are
taken by corpus frequency; their posting lists, stored once, are intersected after shifting each
by its offset in the item, from the rarest on. What remains are alignments of an item in a document;
the documents that have any are indexed in full, and an alignment's matched words that form runs of
at least a window are exact phrase matches. Rare terms of one window that stand close together without
being the phrase are proximity matches (`proximity`).

A document is keyed by its doc_id and a hash of its text, so rows that repeat a doc_id keep results
of their own, and identical rows get identical results. Null texts have no words; null doc_ids are
kept; items without words have no window; rows that repeat an item_id are further texts of that item.
Empty tables give no hits or no rows; ties need no rule, as all matches count; texts are read whole,
whatever their length. Extra columns are ignored. No list is collected beyond one
document's item ids; broadcast is left to Spark's own size check, with a shuffle join beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import scratch

#: What separates words: everything but `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after lower-casing A-Z.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text) -> F.Column:
    """Lower-cases A-Z only; an ASCII text takes the faster built-in."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def words(text) -> F.Column:
    """The words of a text column, in order."""
    return F.array_remove(F.split(lowered(text), BREAK), "")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)).alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))


def item_terms(benchmark: DataFrame) -> DataFrame:
    """(uid, item_id, j, term, m): the words of each item text with their positions and number."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null").distinct()
    w = items.select(F.xxhash64("item_id", "text").alias("uid"), "item_id", words("text").alias("w")).where("size(w) > 0")
    return w.select("uid", "item_id", F.size("w").alias("m"), F.posexplode("w").alias("j", "term"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(tid, d, th, pos) for the words of keyed docs that are in terms (term, tid)."""
    return docs.select("d", "th", F.posexplode(words("text")).alias("pos", "term")).join(terms, "term").select("tid", "d", "th", "pos")


def rare_terms(items: DataFrame, frequency: DataFrame, size: int) -> DataFrame:
    """(uid, j1, t1, j2, t2, j3, t3): places of each window's rarest terms, rarest first, each set once.

    Windows that hold a term the corpus lacks cannot occur and are left out."""
    known = items.join(frequency, "tid", "left").select("uid", "m", "j", "tid", F.coalesce("f", F.lit(0)).alias("f"))
    at = known.select("uid", "m", "j", "tid", "f", F.explode(F.sequence(F.greatest(F.col("j") - size + 1, F.lit(0)), F.least(F.col("j"), F.greatest(F.col("m") - size, F.lit(0))))).alias("s"))
    ranked = at.withColumn("r", F.row_number().over(Window.partitionBy("uid", "s").orderBy("f", "j"))).where("r <= 3")
    pick = lambda c, k: F.max(F.when(F.col("r") == k, F.col(c)))
    sets = ranked.groupBy("uid", "s").agg(F.min("f").alias("least"), *[pick("j", k).alias(f"j{k}") for k in (1, 2, 3)], *[pick("tid", k).alias(f"t{k}") for k in (1, 2, 3)])
    fill = [F.coalesce(f"{c}{k}", f"{c}1").alias(f"{c}{k}") for c in ("j", "t") for k in (1, 2, 3)]
    return sets.where("least > 0").select("uid", *fill).distinct()


def alignments(lists: DataFrame, rare: DataFrame) -> DataFrame:
    """(uid, d, th, delta): where the lists of a window's rarest terms meet after their shifts."""
    found = rare.join(lists.withColumnRenamed("tid", "t1"), "t1").withColumn("delta", F.col("pos") - F.col("j1")).drop("pos", "t1")
    for k in (2, 3):
        found = found.withColumn("at", F.col("delta") + F.col(f"j{k}")).join(lists.select(F.col("tid").alias(f"t{k}"), "d", "th", F.col("pos").alias("at")).distinct(), [f"t{k}", "d", "th", "at"], "left_semi")
    return found.select("uid", "d", "th", "delta").distinct()


class Index:
    """The stored lists of the test terms, and what is derived from them."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, size: int = 10):
        self.docs, self.size = keyed(docs), size
        terms = item_terms(benchmark).withColumn("tid", F.xxhash64("term"))
        self.items = scratch.stored(terms)
        self.vocabulary = scratch.stored(self.items.select("term", "tid").distinct())
        counted = self.docs.select(F.explode(words("text")).alias("term")).join(self.vocabulary, "term").groupBy("tid").agg(F.count("*").alias("f"))
        self.rare = scratch.stored(rare_terms(self.items, counted, size))
        needed = self.rare.select(F.explode(F.array("t1", "t2", "t3")).alias("tid")).distinct()
        needed = scratch.stored(self.vocabulary.join(needed, "tid", "left_semi"))
        self.lists = scratch.stored(postings(self.docs, needed))

    def phrases(self) -> DataFrame:
        """(uid, d, th, pos): words of documents inside an exact occurrence of a window."""
        found = scratch.stored(alignments(self.lists, self.rare))
        full = postings(self.docs.join(scratch.stored(found.select("d", "th").distinct()), ["d", "th"], "left_semi"), self.vocabulary).distinct()
        due = found.join(self.items.select("uid", "j", "tid", "m"), "uid").withColumn("pos", F.col("delta") + F.col("j"))
        met = due.join(full, ["d", "th", "pos", "tid"], "left_semi")
        own = Window.partitionBy("uid", "d", "th", "delta")
        runs = met.withColumn("run", F.col("j") - F.row_number().over(own.orderBy("j")))
        held = runs.withColumn("n", F.count("*").over(Window.partitionBy("uid", "d", "th", "delta", "run")))
        return held.where(F.col("n") >= F.least(F.lit(self.size), F.col("m"))).select("uid", "d", "th", "pos").distinct()

    def proximity(self, slop: int = 30) -> DataFrame:
        """(uid, d, th): the two rarest terms of a window at most `slop` words apart, but not at the
        window's own distance. Positions are met by blocks of slop words, not in all pairs."""
        two = self.rare.where("j1 <> j2").select("uid", "j1", "t1", "j2", "t2").distinct()
        block = lambda c: F.floor(F.col(c) / slop).cast("int")
        a = two.join(self.lists.select(F.col("tid").alias("t1"), "d", "th", F.col("pos").alias("p1")), "t1").withColumn("b", F.explode(F.array(*[block("p1") + k for k in (-1, 0, 1)])))
        b = self.lists.select(F.col("tid").alias("t2"), "d", "th", F.col("pos").alias("p2"), block("pos").alias("b"))
        gap = F.col("p2") - F.col("p1")
        return a.join(b, ["t2", "d", "th", "b"]).where((F.abs(gap) <= slop) & (gap != F.col("j2") - F.col("j1")) & (gap != 0)).select("uid", "d", "th").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of `docs`."""
    index = Index(docs, benchmark, size)
    hit = scratch.stored(index.phrases())
    n_hit = hit.groupBy("d", "th", "pos").agg(F.lit(1)).groupBy("d", "th").agg(F.count("*").alias("n_hit"))
    names = index.items.select("uid", "item_id").distinct()
    items = hit.select("uid", "d", "th").distinct().join(names, "uid").groupBy("d", "th").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    found = n_hit.join(items, ["d", "th"])
    rows = index.docs.select("doc_id", "d", "th", F.regexp_count(lowered("text"), F.lit(WORD)).cast("bigint").alias("n_words"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return rows.join(found, ["d", "th"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.size(ids).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The rows of `docs` without any exact window, all columns kept."""
    hit = Index(docs, benchmark, size).phrases().select("d", "th").distinct()
    hit = scratch.stored(hit).select(F.col("d").alias("_d"), F.col("th").alias("_th"))
    d, th = F.coalesce(docs["doc_id"].cast("bigint"), F.lit(-1)), F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(hit, (d == hit["_d"]) & (th == hit["_th"]), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: DuckDB: windows and documents' word sequences as space-framed strings, compared word by word.
ORACLE = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id::VARCHAR AS item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
iv AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda s: array_to_string(list_slice(w, s, s + 9), ' '))) AS g FROM iw WHERE len(w) > 0),
dv AS (SELECT doc_id, s, array_to_string(list_slice(w, s, s + 9), ' ') AS g, 10 AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 9, 0) + 1)) AS s FROM dw)
       UNION ALL SELECT doc_id, s, array_to_string(list_slice(w, s, s + k - 1), ' '), k FROM (SELECT doc_id, w, k, unnest(range(1, greatest(len(w) - k + 1, 0) + 1)) AS s FROM dw, (SELECT DISTINCT k FROM iv WHERE k < 10))),
m AS (SELECT dv.doc_id, dv.s, dv.k, iv.item_id FROM dv JOIN iv ON dv.g = iv.g AND dv.k = iv.k),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
