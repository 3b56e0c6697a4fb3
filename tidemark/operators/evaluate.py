"""Retrieval evaluation: quality per query, rule violations, latency, comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import shared_path


def per_query(found: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, mrr, ndcg) at k of each query with a relevant document (T-25).

    found: query_id, document_id, rank; relevant: query_id, document_id. Recall is over at most k.
    """
    m = relevant.join(found.where(F.col("rank") <= k).select("query_id", "document_id", "rank"), ["query_id", "document_id"], "left")
    g = m.groupBy("query_id").agg(F.count("*").alias("n"), F.count("rank").alias("hit"), F.max(1 / F.col("rank")).alias("rr"), F.sum(1 / F.log2(1 + F.col("rank"))).alias("dcg"))
    most = F.least("n", F.lit(k))
    ideal = F.aggregate(F.sequence(F.lit(1).cast("bigint"), most.cast("bigint")), F.lit(0.0), lambda s, i: s + 1 / F.log2(1 + i))
    zero = F.lit(0.0)
    return g.select("query_id", F.round(F.col("hit") / most, 6).alias("recall"), F.round(F.coalesce("rr", zero), 6).alias("mrr"), F.round(F.coalesce("dcg", zero) / ideal, 6).alias("ndcg"))


def violations(hits: DataFrame, index: DataFrame, spaces: list[str], owner: str) -> DataFrame:
    """Hits that present facts forbid, by rule (T-26)."""
    j = hits.join(index, "document_id")
    many = lambda bad, name: F.count(F.when(bad, 1)).alias(name)
    return j.agg(
        F.count("*").alias("n"),
        many(F.col("lifecycle") != "active", "lifecycle"),
        many(F.col("publication") != "published", "version"),
        many(~F.col("is_public") & ~F.col("owner_space_id").isin(spaces), "permission"),
        many(F.col("owner_subject_key") != owner, "owner"),
    )


def percentiles(samples: DataFrame, by: str, shares: dict[str, float], mode: str = "ceil", width: float = 1.0) -> DataFrame:
    """The values at rank ceil(p n), or floor(p n), 1 at least, of each source (A-15), without gathering them.

    Values are counted; counts by ranges of `width` tell in which range a rank lies, and only that range's
    distinct values are put in order.
    """
    v = samples.where("latency is not null").groupBy(by, "latency").agg(F.count("*").alias("c")).withColumn("range", F.floor(F.col("latency") / width))
    ranges = v.groupBy(by, "range").agg(F.sum("c").alias("size"))
    own = Window.partitionBy(by)
    ranges = ranges.withColumn("upto", F.sum("size").over(own.orderBy("range"))).withColumn("n", F.sum("size").over(own))
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(p).alias("p")) for name, p in shares.items()]))
    at = F.col("n") * F.col("a.p")
    place = F.greatest(F.ceil(at) if mode == "ceil" else F.floor(at), F.lit(1))
    wanted = ranges.withColumn("a", asked).withColumn("place", place).where("place <= upto and place > upto - size").select(by, "range", F.col("a.name").alias("name"), (F.col("place") - F.col("upto") + F.col("size")).alias("place"))
    inside = v.join(wanted, [by, "range"]).withColumn("upto", F.sum("c").over(Window.partitionBy(by, "range", "name").orderBy("latency"))).where("upto >= place")
    return inside.groupBy(by).agg(*[F.min(F.when(F.col("name") == name, F.col("latency"))).alias(name) for name in shares])


def latency(samples: DataFrame, by: str, timeout: float, mode: str = "ceil") -> DataFrame:
    """Counts, rank percentiles, mean, maximum and timeouts of evaluation runs by source (A-15, A-18)."""
    s = samples.groupBy(by).agg(F.count("latency").alias("n"), F.round(F.avg("latency"), 6).alias("mean"), F.max("latency").alias("most"), F.count(F.when(F.col("latency") > timeout, 1)).alias("timeouts"))
    return s.join(percentiles(samples, by, {"p50": 0.5, "p95": 0.95}, mode), by, "left").select(by, "n", "p50", "p95", "mean", "most", "timeouts")


def decide(limits: dict[str, float]) -> Column:
    """`switch` if no measure exceeds its limit, else `hold` (T-28)."""
    bad = F.lit(False)
    for name, limit in limits.items():
        bad = bad | (F.col(name) > limit)
    return F.when(bad, "hold").otherwise("switch")


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per query: documents only in one run, in both, and whether the lists are equal in order (U-06, U-07, T-27)."""
    listed = lambda x, name: x.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "document_id"))), lambda r: r["document_id"]).alias(name))
    j = listed(a, "a").join(listed(b, "b"), "query_id")
    size = lambda x: F.size(x).cast("bigint")
    return j.select("query_id", size(F.array_except("a", "b")).alias("only_left"), size(F.array_except("b", "a")).alias("only_right"), size(F.array_intersect("a", "b")).alias("common"), (F.col("a") == F.col("b")).alias("identical"))


#: Passages of fewer characters are compared with every text.
SHORT = 12
#: So many pairs of a passage and a document, 16 bytes each, may go to every task.
FEW_PAIRS = 500_000


def holding(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, document_id) of the documents whose body contains a passage, as `contains` says (T-25).

    A passage is anchored by the inner one of its whole words, between single characters that are none, that the
    fewest documents hold: an equi-join finds the documents with that word, and only those are compared. A
    passage without an inner word, or a short one, has no anchor and is compared with all. At most `FEW_PAIRS`
    pairs of anchored passages and documents go to the texts; more of them meet the texts in a shuffle.
    docs: document_id, body; passages: query_id, passage.
    """
    inner = F.regexp_extract_all("passage", F.lit(r"(?<=[^\p{L}\p{Nd}])[\p{L}\p{Nd}]+(?=[^\p{L}\p{Nd}])"), F.lit(0))
    p = passages.where("passage is not null").withColumn("words", F.array_distinct(inner))
    anchored = (F.size("words") > 0) & (F.char_length("passage") >= SHORT)
    words = p.where(anchored).select("query_id", "passage", F.explode("words").alias("word"))
    held = docs.where("body is not null").select("document_id", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"[A-Za-z0-9[\p{L}\p{Nd}]]+"), F.lit(0)))).alias("word"))
    spark, path = docs.sparkSession, shared_path(docs.sparkSession)
    held = held.join(words.select("word").distinct(), "word")
    held.write.parquet(f"{path}/held")  # counted, then joined: texts are split once
    held = spark.read.schema(held.schema).parquet(f"{path}/held")
    df = held.groupBy("word").agg(F.count("*").alias("df"))
    rare = words.join(df, "word").groupBy("query_id", "passage").agg(F.min(F.struct("df", "word")).alias("r"), F.count("*").alias("n"))
    all_known = words.groupBy("query_id", "passage").agg(F.count("*").alias("n"))  # a passage with a word that no document holds is in none
    anchors = rare.join(all_known, ["query_id", "passage", "n"]).select("query_id", F.col("r.word").alias("word"))
    near = held.join(anchors, "word").select("query_id", "document_id")
    near.write.parquet(f"{path}/near")
    near = spark.read.schema(near.schema).parquet(f"{path}/near")
    if near.count() <= FEW_PAIRS:
        near = F.broadcast(near)  # bounded above: the texts stay where they are
    found = docs.join(near, "document_id").join(passages, "query_id").where(F.contains("body", "passage")).select("query_id", "document_id")
    others = p.where(~anchored).select("query_id", "passage")
    if others.isEmpty():
        return found.distinct()
    return found.unionByName(docs.join(others, F.contains("body", "passage")).select("query_id", "document_id")).distinct()
