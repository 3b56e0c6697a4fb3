"""The operators' input shapes, derived from the given tables; each with the same derivation as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def index(spark: SparkSession, d: str) -> DataFrame:
    """A searchable projection of the documents."""
    t = table(spark, d, "documents")
    k = F.col("doc_id")
    return t.select(
        k.alias("document_id"),
        F.col("text").alias("content"),
        F.substring("text", 1, 40).alias("title"),
        F.substring("text", 1, 100).alias("summary"),
        F.col("lang").alias("owner_space_id"),
        F.col("source").alias("owner_subject_key"),
        F.when(k % 5 == 0, F.array_distinct(F.array("lang", F.lit("en")))).otherwise(F.array("lang")).alias("allowed"),
        (k % 7 == 0).alias("is_public"),
        F.when(k % 11 == 0, "archived").otherwise("active").alias("lifecycle"),
        F.when(k % 13 == 0, "draft").otherwise("published").alias("publication"),
    )


IX = """ix AS (SELECT doc_id AS document_id, text AS content, substr(text, 1, 40) AS title, substr(text, 1, 100) AS summary, lang AS owner_space_id, source AS owner_subject_key,
 CASE WHEN doc_id % 5 = 0 AND lang <> 'en' THEN [lang, 'en'] ELSE [lang] END AS allowed, doc_id % 7 = 0 AS is_public,
 CASE WHEN doc_id % 11 = 0 THEN 'archived' ELSE 'active' END AS lifecycle, CASE WHEN doc_id % 13 = 0 THEN 'draft' ELSE 'published' END AS publication FROM documents)"""


def document_events(spark: SparkSession, d: str) -> DataFrame:
    """A change log with stale, equal and deleting events; every tenth event is delivered twice."""
    e = table(spark, d, "events")
    v, k = F.floor("value").cast("bigint"), F.get_json_object("props", "$.k").cast("bigint")
    i = F.col("event_id")
    rows = e.select(
        (i + 1).alias("sequence"),
        i.cast("string").alias("event_id"),
        F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("kind"),
        F.col("user_id").alias("document_id"),
        (F.floor(i / 200) + v % 5).alias("aggregate_revision"),
        (F.floor(i / 500) + k % 3).alias("access_revision"),
        (F.floor(i / 1000) + k % 2).alias("lifecycle_revision"),
        F.col("event_type").alias("content"),
        F.explode(F.when(i % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows


DE = """de AS (SELECT event_id + 1 AS sequence, event_id::VARCHAR AS event_id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS kind, user_id AS document_id,
 event_id // 200 + floor(value)::BIGINT % 5 AS aggregate_revision, event_id // 500 + (props::JSON->>'k')::BIGINT % 3 AS access_revision, event_id // 1000 + (props::JSON->>'k')::BIGINT % 2 AS lifecycle_revision, event_type AS content FROM events)"""


def record_events(spark: SparkSession, d: str) -> DataFrame:
    """Message revisions, with recalls, equal revisions and identity changes."""
    e = table(spark, d, "events")
    i, u = F.col("event_id"), F.col("user_id")
    group = u % 10 + F.when(i % 97 == 0, 1).otherwise(0)
    return e.select(
        i.alias("arrival"),
        u.alias("record_id"),
        (1 + F.floor(i / 200) + F.floor("value").cast("bigint") % 5).alias("revision"),
        F.concat(F.lit("qq:1:group:"), group.cast("string")).alias("conversation_id"),
        (F.col("event_type") == "error").alias("recall"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("payload"),
    )


RE = """re AS (SELECT event_id AS arrival, user_id AS record_id, 1 + event_id // 200 + floor(value)::BIGINT % 5 AS revision,
 'qq:1:group:' || (user_id % 10 + CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END)::VARCHAR AS conversation_id, event_type = 'error' AS recall,
 CASE WHEN event_type <> 'error' THEN event_type END AS payload FROM events)"""


def chat(spark: SparkSession, d: str) -> DataFrame:
    """Chat messages of the conversations."""
    t = table(spark, d, "conversations")
    return t.select(
        F.col("turn").cast("bigint").alias("message_id"),
        F.lit("group").alias("group_type"),
        F.col("role").alias("from_id"),
        F.col("conv_id").cast("bigint").alias("to_id"),
        F.col("text").alias("payload"),
        (F.col("conv_id") * 100000 + F.col("turn")).cast("bigint").alias("created_at"),
        ((F.col("conv_id") + F.col("turn")) % 9 == 0).alias("retracted"),
        (F.col("conv_id") % 4 != 0).alias("archived"),
        (F.col("turn") % 2 == 0).alias("acked"),
    )


CH = """ch AS (SELECT turn::BIGINT AS message_id, 'group' AS group_type, role AS from_id, conv_id::BIGINT AS to_id, text AS payload, (conv_id * 100000 + turn)::BIGINT AS created_at,
 (conv_id + turn) % 9 = 0 AS retracted, conv_id % 4 <> 0 AS archived, turn % 2 = 0 AS acked FROM conversations)"""


def access(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Facts: nations as spaces, customers as members and subjects, orders as documents, lineitem as grants."""
    customer, orders, line, supplier = (table(spark, d, n) for n in ("customer", "orders", "lineitem", "supplier"))
    key = lambda c: F.concat(F.lit("web:user:"), F.col(c).cast("string"))
    c = customer.select(F.col("c_custkey").alias("k"), key("c_custkey").alias("subject_key"), F.col("c_nationkey").cast("string").alias("space_id"), (F.col("c_acctbal") < 0).alias("revoked"), F.col("c_mktsegment").alias("segment"))
    docs = orders.join(c.select(F.col("k").alias("o_custkey"), "space_id"), "o_custkey").select(
        F.col("o_orderkey").alias("document_id"),
        key("o_custkey").alias("owner_subject_key"),
        F.col("space_id").alias("owner_space_id"),
        (F.col("o_orderkey") % 200 == 0).alias("is_public"),
        F.when(F.col("o_orderstatus") == "F", "archived").otherwise("active").alias("lifecycle"),
        F.col("o_orderdate").alias("created_at"),
    )
    s = supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("string").alias("grantee_space_id"))
    by_space = line.where("l_suppkey % 2 = 0").join(s, "l_suppkey").select(F.col("l_orderkey").alias("document_id"), F.lit(None).cast("string").alias("grantee_subject_key"), "grantee_space_id", (F.col("l_linenumber") % 3 == 0).alias("revoked"))
    by_subject = line.where("l_suppkey % 2 = 1").select(F.col("l_orderkey").alias("document_id"), F.concat(F.lit("web:user:"), F.col("l_suppkey").cast("string")).alias("grantee_subject_key"), F.lit(None).cast("string").alias("grantee_space_id"), (F.col("l_linenumber") % 3 == 0).alias("revoked"))
    return {
        "docs": docs,
        "members": c.select("space_id", "subject_key", "revoked"),
        "subjects": c.select("subject_key", (F.col("segment") != "MACHINERY").alias("active")),
        "grants": by_space.unionByName(by_subject),
    }


AC = """c AS (SELECT c_custkey AS k, 'web:user:' || c_custkey::VARCHAR AS subject_key, c_nationkey::VARCHAR AS space_id, c_acctbal < 0 AS revoked, c_mktsegment <> 'MACHINERY' AS active FROM customer),
ad AS (SELECT o_orderkey AS document_id, 'web:user:' || o_custkey::VARCHAR AS owner_subject_key, space_id AS owner_space_id, o_orderkey % 200 = 0 AS is_public, CASE WHEN o_orderstatus = 'F' THEN 'archived' ELSE 'active' END AS lifecycle, o_orderdate AS created_at FROM orders JOIN c ON o_custkey = k),
ag AS (SELECT l_orderkey AS document_id, CASE WHEN l_suppkey % 2 = 1 THEN 'web:user:' || l_suppkey::VARCHAR END AS grantee_subject_key, CASE WHEN l_suppkey % 2 = 0 THEN s_nationkey::VARCHAR END AS grantee_space_id, l_linenumber % 3 = 0 AS revoked FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey WHERE l_suppkey % 2 = 1 OR (l_suppkey % 2 = 0 AND s_suppkey IS NOT NULL))"""


def versions(spark: SparkSession, d: str) -> DataFrame:
    """Versions of orders: line numbers as revisions, with a full tiebreak."""
    t = table(spark, d, "lineitem")
    return t.select(
        F.col("l_orderkey").alias("document_id"),
        F.col("l_linenumber").cast("bigint").alias("revision"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
        F.col("l_extendedprice").alias("price"),
        F.when(F.col("l_linestatus") == "F", "published").otherwise("draft").alias("publication"),
        (F.col("l_returnflag") == "A").alias("is_active"),
    )


VE = """ve AS (SELECT l_orderkey AS document_id, l_linenumber::BIGINT AS revision, l_partkey AS part, l_suppkey AS supp, l_extendedprice AS price, CASE WHEN l_linestatus = 'F' THEN 'published' ELSE 'draft' END AS publication, l_returnflag = 'A' AS is_active FROM lineitem)"""
