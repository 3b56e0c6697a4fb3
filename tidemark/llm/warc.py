"""Resolution of not-modified revisits in web captures (operator 6).

A revisit record (a 304 answer) has no payload of its own. It is resolved by an as-of join on the
canonical URL to the latest earlier full response; its validators must agree with that response's;
then the response's headers are taken, updated by those headers that a 304 may change.

The as-of join works in two levels, so that a URL with very many captures is no single group: inside
blocks of time by a window, and between blocks by a window over one row for each block. Payloads are
not moved: a resolved record names the response that holds its payload.

Defined results: a URL without a scheme, an empty and a null one have a null canonical_url; a record
without a canonical URL or time is never matched (a revisit is then `no_earlier`), and takes no part in
windows or joins; of captures at one time, the smaller record_id counts as earlier; repeated rows are
resolved alike; null headers are empty; a revisit without validators is `unvalidated` but resolved; other
columns pass, whatever their names, but one named like a result is replaced by it; bodies and headers of any
length are carried whole; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Headers that a 304 answer may update (HTTP semantics, not-modified answers); fixed values.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that do not select content.
TRACKING = r"^(utm_[a-z]+|ref)="


def canonical_url(url) -> F.Column:
    """Host without www. and default port, lower-cased; path without a last slash; sorted query without
    tracking parameters; no scheme and no fragment. Null for what has no scheme and host."""
    bare = F.regexp_replace(F.col(url), r"#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[A-Za-z]+://([^/?]*)", 1)), r"^www\.|:(80|443)$", "")
    rest = F.regexp_extract(bare, r"^[A-Za-z]+://[^/?]*(.*)$", 1)
    path = F.regexp_replace(F.regexp_extract(rest, r"^([^?]*)", 1), r"/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    whole = F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))
    return F.when(host != "", whole)


def _etag(c) -> F.Column:
    return F.regexp_replace(c, r"^W/", "")


NEEDED = ("record_id", "url", "ts", "kind", "etag", "last_modified", "headers", "digest")
RESULTS = ("canonical_url", "outcome", "source_id", "source_digest")


def resolve_revisits(records: DataFrame, block_seconds: int = 3600) -> DataFrame:
    """Adds canonical_url, outcome, source_id, source_digest and merged headers to each record.

    `records`: record_id, url, ts (seconds), kind (response or revisit), etag, last_modified,
    headers map<string,string> (lower-case names), digest.
    """
    others = [c for c in records.columns if c not in NEEDED and c.lower() not in RESULTS]
    rest = F.struct(*others) if others else F.struct(F.lit(0).alias("none"))
    r = records.select(*NEEDED, rest.alias("rest")).withColumn("canonical_url", canonical_url("url"))
    r = r.withColumn("headers", F.coalesce("headers", F.create_map().cast("map<string,string>"))).withColumn("block", F.floor(F.col("ts") / block_seconds))
    placed = F.col("canonical_url").isNotNull() & F.col("ts").isNotNull()
    able, unable = r.where(placed), r.where(~placed)
    response = F.struct("ts", "record_id", "etag", "last_modified", "headers", "digest")
    within = Window.partitionBy("canonical_url", "block").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = able.withColumn("near", F.last(F.when(F.col("kind") == "response", response), ignorenulls=True).over(within))
    last = able.where("kind = 'response'").groupBy("canonical_url", "block").agg(F.max_by(response, F.struct("ts", "record_id")).alias("o"))
    blocks = able.select("canonical_url", "block").distinct().join(last, ["canonical_url", "block"], "left")
    before = Window.partitionBy("canonical_url").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("canonical_url", "block", F.last("o", ignorenulls=True).over(before).alias("far"))
    found = near.join(blocks, ["canonical_url", "block"], "left").withColumn("o", F.coalesce("near", "far")).select(*r.columns, "o")
    r = found.unionByName(unable.withColumn("o", F.lit(None).cast(found.schema["o"].dataType)))
    has_etag, has_date = F.col("etag").isNotNull(), F.col("last_modified").isNotNull()
    same = F.when(has_etag, F.coalesce(_etag(F.col("etag")) == _etag(F.col("o.etag")), F.lit(False))).when(has_date, F.coalesce(F.col("last_modified") == F.col("o.last_modified"), F.lit(False)))
    outcome = (
        F.when(F.col("kind") == "response", "full")
        .when(F.col("o").isNull(), "no_earlier")
        .when(same, "resolved")
        .when(same.isNull(), "unvalidated")
        .otherwise("validator_mismatch")
    )
    r = r.withColumn("outcome", outcome)
    joined = F.col("outcome").isin("resolved", "unvalidated")
    update = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    kept = F.map_filter(F.col("o.headers"), lambda k, _: ~F.array_contains(F.map_keys(update), k))
    results = {
        "headers": F.when(joined, F.map_concat(kept, update)).otherwise(F.col("headers")),
        "source_id": F.when(F.col("kind") == "response", F.col("record_id")).when(joined, F.col("o.record_id")),
        "source_digest": F.when(F.col("kind") == "response", F.col("digest")).when(joined, F.col("o.digest")),
    }
    passed = [F.col("rest")[c].alias(c) if c in others else results.get(c, F.col(c)).alias(c) for c in records.columns if c in others or c in NEEDED]
    return r.select(*passed, *[results.get(c, F.col(c)).alias(c) for c in RESULTS])


def captures(pages: DataFrame) -> DataFrame:
    """Four captures of each page as WARC records: a response, a revisit, then (by page_id) a changed
    response or a revisit, and a revisit with a stale validator for some, under varying spellings."""
    c = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("c")
    p = pages.select("page_id", "url", F.sha2(F.coalesce("html", F.lit("")), 256).alias("body"), c)
    changed = (F.col("c") == 2) & (F.col("page_id") % 3 == 0)
    digest = F.when(changed, F.sha2(F.concat("body", F.lit(":2")), 256)).otherwise(F.col("body"))
    current = F.when((F.col("c") >= 2) & (F.col("page_id") % 3 == 0), F.sha2(F.concat("body", F.lit(":2")), 256)).otherwise(F.col("body"))
    stale = (F.col("c") == 3) & (F.col("page_id") % 5 == 0)
    full = (F.col("c") == 0) | changed
    etag = F.when(F.col("page_id") % 7 != 0, F.concat(F.when(full, F.lit('"')).otherwise(F.lit('W/"')), F.when(stale, F.lit("old")).otherwise(F.substring(current, 1, 12)), F.lit('"')))
    stamp = F.when(F.col("page_id") % 2 == 0, F.col("page_id") * 100 + F.when((F.col("c") >= 2) & (F.col("page_id") % 3 == 0), 2).otherwise(0))
    return p.select(
        (F.col("page_id") * 4 + F.col("c")).alias("record_id"),
        F.when(F.col("c") == 1, F.concat("url", F.lit("#top"))).when(F.col("c") == 3, F.regexp_replace("url", "^http://", "https://")).otherwise(F.col("url")).alias("url"),
        (F.lit(1_700_000_000) + F.col("page_id") * 7 + F.col("c") * 500_000).cast("bigint").alias("ts"),
        F.when(full, "response").otherwise("revisit").alias("kind"),
        etag.alias("etag"),
        stamp.alias("last_modified"),
        F.map_from_arrays(F.array(F.lit("content-type"), F.lit("cache-control"), F.lit("server")), F.array(F.when(full, F.lit("text/html")).otherwise(F.lit("text/plain")), F.concat(F.lit("max-age="), (F.col("c") * 60).cast("string")), F.concat(F.lit("s"), F.col("c").cast("string")))).alias("headers"),
        F.when(full, digest).alias("digest"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = resolve_revisits(captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return r.select("record_id", "canonical_url", "ts", "kind", "outcome", "source_id", "source_digest", *[F.col("headers")[h].alias(h.replace("-", "_")) for h in ("content-type", "cache-control", "server")])


ORACLE = r"""
WITH p AS (SELECT page_id, url, sha256(coalesce(html, '')) AS body, unnest(range(0, 4)) AS c FROM pages),
e AS (SELECT *, (c = 0 OR (c = 2 AND page_id % 3 = 0)) AS is_full, CASE WHEN c >= 2 AND page_id % 3 = 0 THEN sha256(body || ':2') ELSE body END AS cur FROM p),
r AS (SELECT page_id * 4 + c AS record_id,
 CASE WHEN c = 1 THEN url || '#top' WHEN c = 3 THEN regexp_replace(url, '^http://', 'https://') ELSE url END AS url,
 (1700000000 + page_id * 7 + c * 500000)::BIGINT AS ts, CASE WHEN is_full THEN 'response' ELSE 'revisit' END AS kind,
 CASE WHEN page_id % 7 <> 0 THEN '"' || CASE WHEN c = 3 AND page_id % 5 = 0 THEN 'old' ELSE substr(cur, 1, 12) END || '"' END AS tag,
 CASE WHEN page_id % 2 = 0 THEN page_id * 100 + CASE WHEN c >= 2 AND page_id % 3 = 0 THEN 2 ELSE 0 END END AS lm,
 CASE WHEN is_full THEN 'text/html' ELSE 'text/plain' END AS ct, 'max-age=' || (c * 60)::VARCHAR AS cc, 's' || c::VARCHAR AS sv,
 CASE WHEN is_full THEN cur END AS digest FROM e),
u AS (SELECT *, regexp_replace(url, '#.*$', '') AS bare FROM r),
v AS (SELECT *, regexp_replace(lower(regexp_extract(bare, '^[A-Za-z]+://([^/?]*)', 1)), '^www\.|:(80|443)$', '', 'g') AS host, regexp_extract(bare, '^[A-Za-z]+://[^/?]*(.*)$', 1) AS rest FROM u),
w AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref)='))) AS q, regexp_replace(regexp_extract(rest, '^([^?]*)', 1), '/+$', '') AS path FROM v),
x AS (SELECT *, CASE WHEN host <> '' THEN host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS canonical_url FROM w),
y AS (SELECT *, CASE WHEN canonical_url IS NOT NULL THEN last_value(CASE WHEN kind = 'response' THEN record_id END IGNORE NULLS) OVER (PARTITION BY canonical_url ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS oid FROM x),
z AS (SELECT y.*, o.tag AS otag, o.lm AS olm, o.ct AS oct, o.cc AS occ, o.sv AS osv, o.digest AS odigest FROM y LEFT JOIN r o ON y.oid = o.record_id),
s AS (SELECT *, CASE WHEN kind = 'response' THEN 'full' WHEN oid IS NULL THEN 'no_earlier' WHEN tag IS NOT NULL THEN CASE WHEN tag = otag THEN 'resolved' ELSE 'validator_mismatch' END
 WHEN lm IS NOT NULL THEN CASE WHEN lm = olm THEN 'resolved' ELSE 'validator_mismatch' END ELSE 'unvalidated' END AS outcome FROM z)
SELECT record_id, canonical_url, ts, kind, outcome,
 CASE WHEN kind = 'response' THEN record_id WHEN outcome IN ('resolved', 'unvalidated') THEN oid END AS source_id,
 CASE WHEN kind = 'response' THEN digest WHEN outcome IN ('resolved', 'unvalidated') THEN odigest END AS source_digest,
 CASE WHEN outcome IN ('resolved', 'unvalidated') THEN oct ELSE ct END AS content_type, cc AS cache_control,
 CASE WHEN outcome IN ('resolved', 'unvalidated') THEN osv ELSE sv END AS server FROM s
"""
