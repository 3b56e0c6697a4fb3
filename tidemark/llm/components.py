"""Connected components of links, without collecting links or labels anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import scratch


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable; nodes without links are left out.

    Alternates two steps until nothing changes: every node hands its larger neighbours, then its
    smaller ones, to the least node it knows. The number of rounds grows with the logarithm of the
    longest path; rows never exceed the links.
    """
    edges = scratch.stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        was, edges = edges, scratch.stored(small)
        scratch.free(was)
        now = _state(edges)
        if now == state:
            break
        state = now
    node = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return node.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
