"""Queries of access, listing, paging and quality checks (F, J, A, K, Q)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import checks as Q
from tidemark.operators import lifecycle as L
from tidemark.operators import scope
from tidemark.plans import fixtures as X
from tidemark.plans.registry import query
from tidemark.sources.tables import shared_path

PAIRS = f"""{X.AC}, mb AS (SELECT space_id, subject_key FROM c WHERE NOT revoked), g AS (SELECT * FROM ag WHERE NOT revoked),
rp AS (SELECT document_id, owner_subject_key AS subject_key FROM ad UNION SELECT document_id, grantee_subject_key FROM g WHERE grantee_subject_key IS NOT NULL UNION SELECT document_id, subject_key FROM g JOIN mb ON grantee_space_id = space_id UNION SELECT document_id, subject_key FROM ad JOIN mb ON owner_space_id = space_id UNION SELECT document_id, subject_key FROM ad, c WHERE is_public AND active)"""


@query("f14_j02_j05_readable_pairs", f"WITH {PAIRS} SELECT subject_key, count(*) AS n, min(document_id) AS first, max(document_id) AS last FROM rp GROUP BY subject_key")
def f14(spark, d):
    f = X.access(spark, d)
    return scope.readable_counts(f["docs"], f["grants"], f["members"], f["subjects"])


@query("f15_a02_readable_list", f"WITH {PAIRS} SELECT lifecycle, owner_space_id, count(*) AS n FROM ad WHERE document_id IN (SELECT document_id FROM rp WHERE subject_key = 'web:user:7') AND (owner_space_id IN ('3', '4') OR is_public) GROUP BY ALL")
def f15(spark, d):
    f = X.access(spark, d)
    asked = spark.createDataFrame([("web:user:7",)], "subject_key string")
    p = scope.readable_by(asked, f["docs"], f["grants"], f["members"], f["subjects"])
    return f["docs"].join(p, "document_id", "left_semi").where("owner_space_id in ('3', '4') or is_public").groupBy("lifecycle", "owner_space_id").agg(F.count("*").alias("n"))


@query("f16_access_facts", f"""WITH {X.AC}, mb AS (SELECT DISTINCT space_id, subject_key FROM c WHERE NOT revoked), g AS (SELECT * FROM ag WHERE NOT revoked), pr AS (SELECT document_id, 'web:user:' || (document_id % 150)::VARCHAR AS subject_key FROM ad),
z AS (SELECT document_id, pr.subject_key, owner_subject_key = pr.subject_key AS is_owner, EXISTS (SELECT 1 FROM g WHERE g.document_id = pr.document_id AND grantee_subject_key = pr.subject_key) AS has_grant, EXISTS (SELECT 1 FROM g JOIN mb ON grantee_space_id = space_id WHERE g.document_id = pr.document_id AND mb.subject_key = pr.subject_key) AS in_granted_space,
 EXISTS (SELECT 1 FROM mb WHERE mb.space_id = owner_space_id AND mb.subject_key = pr.subject_key) AS in_owner_space, is_public, coalesce(active, FALSE) AS is_active FROM pr JOIN ad USING (document_id) LEFT JOIN c ON c.subject_key = pr.subject_key)
SELECT *, is_owner OR has_grant OR in_granted_space OR in_owner_space OR (is_public AND is_active) AS may_read FROM z""")
def f16(spark, d):
    f = X.access(spark, d)
    pairs = f["docs"].select("document_id", F.concat(F.lit("web:user:"), (F.col("document_id") % 150).cast("string")).alias("subject_key"))
    return scope.access_facts(pairs, f["docs"], f["grants"], f["members"], f["subjects"])


@query("j06_w03_top_version", f"WITH {X.VE} SELECT document_id, revision, publication, is_active FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY is_active DESC, revision DESC, part, supp, price) AS k FROM ve) WHERE k = 1")
def j06(spark, d):
    return L.last_action(X.versions(spark, d), ["document_id"], F.desc("is_active"), F.desc("revision"), "part", "supp", "price").select("document_id", "revision", "publication", "is_active")


@query("j07_io04_envelopes", f"WITH {X.AC}, {X.VE}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY is_active DESC, revision DESC, part, supp, price) AS k FROM ve) WHERE k = 1), s AS (SELECT document_id, list_sort(list(DISTINCT grantee_space_id)) AS spaces FROM ag WHERE NOT revoked AND grantee_space_id IS NOT NULL GROUP BY 1) SELECT ad.document_id, CASE WHEN lifecycle = 'active' AND publication = 'published' THEN 'upsert' ELSE 'delete' END AS kind, coalesce(revision, 0) AS revision, coalesce(spaces, []) AS spaces, CASE WHEN lifecycle = 'active' AND publication = 'published' THEN price END AS content FROM ad LEFT JOIN t USING (document_id) LEFT JOIN s USING (document_id)")
def j07(spark, d):
    f = X.access(spark, d)
    top = L.last_action(X.versions(spark, d), ["document_id"], F.desc("is_active"), F.desc("revision"), "part", "supp", "price")
    spaces = f["grants"].where("not revoked and grantee_space_id is not null").groupBy("document_id").agg(F.array_sort(F.collect_set("grantee_space_id")).alias("spaces"))
    j = f["docs"].join(top, "document_id", "left").join(spaces, "document_id", "left")
    put = (F.col("lifecycle") == "active") & (F.coalesce("publication", F.lit("")) == "published")
    return j.select("document_id", F.when(put, "upsert").otherwise("delete").alias("kind"), F.coalesce("revision", F.lit(0)).alias("revision"), F.coalesce("spaces", F.array().cast("array<string>")).alias("spaces"), F.when(put, F.col("price")).alias("content"))


@query("j14_j15_a06_a13_scope_facts", "SELECT n_nationkey AS space_id, coalesce(members, []) AS members, coalesce(any_revoked, FALSE) AS any_revoked, coalesce(active_members, 0) AS active_members FROM nation LEFT JOIN (SELECT c_nationkey AS n_nationkey, list_sort(list_distinct(list(c_custkey) FILTER (c_acctbal >= 0))) AS members, bool_or(c_acctbal < 0) AS any_revoked, count(*) FILTER (c_acctbal >= 0) AS active_members FROM customer GROUP BY 1) USING (n_nationkey)")
def j14(spark, d):
    c = X.table(spark, d, "customer")
    live = F.col("c_acctbal") >= 0
    g = c.groupBy(F.col("c_nationkey").alias("space_id")).agg(F.array_sort(F.collect_set(F.when(live, F.col("c_custkey")))).alias("members"), F.max(~live).alias("any_revoked"), F.count(F.when(live, 1)).alias("active_members"))
    n = X.table(spark, d, "nation").select(F.col("n_nationkey").alias("space_id"))
    return n.join(g, "space_id", "left").select("space_id", F.coalesce("members", F.array().cast("array<bigint>")).alias("members"), F.coalesce("any_revoked", F.lit(False)).alias("any_revoked"), F.coalesce("active_members", F.lit(0)).alias("active_members"))


@query("k11_keyset_page", f"WITH {X.AC} SELECT document_id, created_at FROM ad WHERE (created_at, document_id) < (TIMESTAMP '1997-01-01 00:00:00', 5000) ORDER BY created_at DESC, document_id DESC LIMIT 50")
def k11(spark, d):
    at = F.to_timestamp(F.lit("1997-01-01 00:00:00"))
    docs = X.access(spark, d)["docs"]
    return docs.where(F.struct("created_at", "document_id") < F.struct(at.alias("created_at"), F.lit(5000).cast("bigint").alias("document_id"))).orderBy(F.desc("created_at"), F.desc("document_id")).limit(50).select("document_id", "created_at")


@query("k14_revoked_listing", "SELECT c_custkey, c_nationkey, place FROM (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY (CASE WHEN c_acctbal < 0 THEN c_acctbal END) ASC NULLS FIRST, c_custkey) AS place FROM customer) WHERE place <= 7")
def k14(spark, d):
    c = X.table(spark, d, "customer").withColumn("revoked", F.when(F.col("c_acctbal") < 0, F.col("c_acctbal")))
    w = Window.partitionBy("c_nationkey").orderBy(F.asc_nulls_first("revoked"), "c_custkey")
    return c.withColumn("place", F.row_number().over(w)).where("place <= 7").select("c_custkey", "c_nationkey", "place")


@query("k13_review_page", "SELECT c_custkey, c_name, total FROM (SELECT c_custkey, c_name, count(*) OVER () AS total, row_number() OVER (ORDER BY c_custkey DESC) AS k FROM customer WHERE c_mktsegment = 'MACHINERY') WHERE k BETWEEN 21 AND 40")
def k13_page(spark, d):
    """One offset page of a review queue, newest first, with the count of the whole queue."""
    queue = X.table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select("c_custkey", "c_name")
    return queue.orderBy(F.desc("c_custkey")).offset(20).limit(20).crossJoin(queue.agg(F.count("*").alias("total")))


@query("k16_subject_directory", f"WITH {X.AC} SELECT subject_key, active FROM c WHERE subject_key > 'web:user:2' ORDER BY subject_key LIMIT 50")
def k16(spark, d):
    """A page of the subject directory by key, after a cursor."""
    return X.access(spark, d)["subjects"].where("subject_key > 'web:user:2'").orderBy("subject_key").limit(50)


@query("k17_space_bindings", "SELECT o_custkey % 25 AS space_id, o_orderkey AS binding_id, row_number() OVER (PARTITION BY o_custkey % 25 ORDER BY o_orderdate, o_orderkey) AS place FROM orders WHERE o_orderstatus <> 'F'")
def k17(spark, d):
    """The active bindings of each space in creation order."""
    o = X.table(spark, d, "orders").where("o_orderstatus <> 'F'").select((F.col("o_custkey") % 25).alias("space_id"), F.col("o_orderkey").alias("binding_id"), "o_orderdate")
    return L.active_bindings(o.withColumnRenamed("o_orderdate", "created_at")).select("space_id", "binding_id", "place")


@query("w10_latest_binding", "SELECT o_custkey AS group_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS binding_id FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
def w10(spark, d):
    o = X.table(spark, d, "orders").where("o_orderstatus <> 'F'")
    return L.last_action(o, ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select(F.col("o_custkey").alias("group_id"), F.col("o_orderkey").alias("binding_id"))


REQ = """rq AS (SELECT c_custkey AS k, c_custkey % 10 <> 0 AS seen, c_custkey % 10 <> 1 AS active, c_custkey % 2 = 0 AS is_group, CASE WHEN c_custkey % 14 <> 0 THEN '1' ELSE ' ' END AS bot_id, c_custkey % 3 = 0 AS group_seen, c_custkey % 6 = 0 AS group_revoked, CASE WHEN c_custkey % 5 <> 2 THEN 't' || c_nationkey::VARCHAR END AS space, c_acctbal >= 0 AS member, ['p' || c_custkey::VARCHAR] AS private, ['t' || c_nationkey::VARCHAR, 't1'] AS teams FROM customer)"""


def requests(spark, d):
    k, t = F.col("c_custkey"), F.concat(F.lit("t"), F.col("c_nationkey").cast("string"))
    return X.table(spark, d, "customer").select(
        k.alias("k"),
        (k % 10 != 0).alias("subject_seen"),
        (k % 10 != 1).alias("subject_active"),
        (k % 2 == 0).alias("is_group"),
        F.when(k % 14 != 0, "1").otherwise(" ").alias("bot_id"),
        (k % 3 == 0).alias("group_seen"),
        (k % 6 == 0).alias("group_revoked"),
        F.when(k % 5 != 2, t).alias("active_group_space"),
        (F.col("c_acctbal") >= 0).alias("is_active_member"),
        F.array(F.concat(F.lit("p"), k.cast("string"))).alias("private_space_ids"),
        F.array_distinct(F.array(t, F.lit("t1"))).alias("team_space_ids"),
        F.array().cast("array<string>").alias("document_ids"),
    )


SCOPES = f"""{REQ}, sc AS (SELECT *, CASE WHEN NOT seen THEN 'subject_unknown' WHEN NOT active THEN 'subject_inactive' WHEN is_group AND (trim(bot_id) = '' OR space IS NULL) AND group_seen AND group_revoked THEN 'group_binding_revoked' WHEN is_group AND (trim(bot_id) = '' OR space IS NULL) THEN 'group_unbound' WHEN is_group AND NOT member THEN 'not_space_member' END AS reason FROM rq)"""


@query("e16_resolve_scopes", f"WITH {SCOPES} SELECT k, reason, CASE WHEN reason IS NULL AND is_group THEN space END AS current_team, CASE WHEN reason IS NOT NULL THEN [] WHEN is_group THEN list_sort(list_filter(list_distinct(teams), lambda x: x <> space)) ELSE list_sort(list_distinct(teams)) END AS other_teams, CASE WHEN reason IS NULL THEN private ELSE [] END AS private_spaces FROM sc")
def e16(spark, d):
    return scope.resolve_scopes(requests(spark, d)).select("k", "reason", "current_team", "other_teams", "private_spaces")


@query("e17_narrow_capabilities", f"WITH {SCOPES}, r AS (SELECT k, CASE WHEN reason IS NULL THEN private ELSE [] END AS p, CASE WHEN reason IS NULL THEN list_distinct(teams) ELSE [] END AS t, CASE WHEN k % 3 = 0 THEN ['t1'] WHEN k % 3 = 1 THEN [] ELSE ['t1', 'x'] END AS q FROM sc WHERE NOT is_group), z AS (SELECT *, len(q) > 0 AND NOT list_has_all(list_concat(p, t), q) AS refused FROM r) SELECT k, refused, CASE WHEN refused THEN [] WHEN len(q) > 0 THEN list_sort(list_intersect(p, q)) ELSE p END AS private_spaces, CASE WHEN refused THEN [] WHEN len(q) > 0 THEN list_sort(list_intersect(t, q)) ELSE list_sort(t) END AS other_teams FROM z")
def e17(spark, d):
    none = F.array().cast("array<string>")
    asked = F.when(F.col("k") % 3 == 0, F.array(F.lit("t1"))).when(F.col("k") % 3 == 1, none).otherwise(F.array(F.lit("t1"), F.lit("x")))
    s = scope.resolve_scopes(requests(spark, d).where("not is_group")).withColumn("asked", asked)
    out = scope.narrow_capabilities(s, ("private_spaces", "other_teams"), "asked")
    return out.select("k", "refused", "private_spaces", F.array_sort("other_teams").alias("other_teams"))


@query("q01_q02_space_rules", "SELECT 'owner' AS rule, n_nationkey::VARCHAR AS space_id, 'web:user:' || n_nationkey::VARCHAR AS who FROM nation WHERE n_nationkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0 AND c_custkey = c_nationkey) UNION ALL SELECT 'private', c_nationkey::VARCHAR, 'web:user:' || c_custkey::VARCHAR FROM customer WHERE c_acctbal >= 0 AND c_nationkey % 12 = 0 AND c_custkey <> c_nationkey")
def q01(spark, d):
    key = lambda c: F.concat(F.lit("web:user:"), F.col(c).cast("string"))
    spaces = X.table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("space_id"), key("n_nationkey").alias("owner_subject_key"), (F.col("n_nationkey") % 12 == 0).alias("private"))
    members = X.access(spark, d)["members"]
    a = Q.owner_not_member(spaces, members).select(F.lit("owner").alias("rule"), "space_id", F.col("owner_subject_key").alias("who"))
    return a.unionByName(Q.strangers_in_private(spaces, members).select(F.lit("private").alias("rule"), "space_id", F.col("subject_key").alias("who")))


@query("q03_active_version", f"WITH {X.VE} SELECT o_orderkey AS document_id, o_custkey % 7 + 1 AS active_version FROM orders WHERE (o_orderkey, o_custkey % 7 + 1) NOT IN (SELECT (document_id, revision) FROM ve WHERE publication = 'published')")
def q03(spark, d):
    docs = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), (F.col("o_custkey") % 7 + 1).alias("active_version"))
    return Q.active_version_broken(docs, X.versions(spark, d))


@query("q_observed_snapshots", f"""WITH {X.VE}, o AS (SELECT *, (o_orderkey, o_custkey % 7 + 1) IN (SELECT (document_id, revision) FROM ve WHERE publication = 'published') AS q03, o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 0) AS q15 FROM orders),
l AS (SELECT *, l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 20 <> 0) AS q15, l_returnflag = 'N' OR count(*) FILTER (l_returnflag <> 'N') OVER (PARTITION BY l_orderkey, l_linenumber) = 1 AS q06 FROM lineitem)
SELECT 'orders' AS snapshot, unnest(['rows', 'q03', 'q12', 'q15']) AS rule, unnest([count(*), count(*) FILTER (NOT q03), count(*) FILTER (o_totalprice < 50000), count(*) FILTER (NOT q15)]) AS n FROM o
UNION ALL SELECT 'lineitem', unnest(['rows', 'q06', 'q08', 'q12', 'q15']), unnest([count(*), count(*) FILTER (NOT q06), count(*) FILTER (l_tax > l_discount), count(*) FILTER (l_quantity > 40), count(*) FILTER (NOT q15)]) FROM l""")
def q_observed(spark, d):
    """All rules of a table counted by the one job that writes its snapshot."""
    versions = X.versions(spark, d).where("publication = 'published'").select("document_id", F.col("revision").alias("active_version"))
    o = X.table(spark, d, "orders").withColumn("document_id", F.col("o_orderkey")).withColumn("active_version", F.col("o_custkey") % 7 + 1).withColumn("c_custkey", F.col("o_custkey"))
    o = Q.has_parent(Q.has_parent(o, versions, ["document_id", "active_version"], "has_version"), X.table(spark, d, "customer").where("c_custkey % 50 <> 0"), ["c_custkey"], "has_customer")
    i = X.table(spark, d, "lineitem").withColumn("s_suppkey", F.col("l_suppkey"))
    i = Q.is_unique(i, ["l_orderkey", "l_linenumber"], "once", F.col("l_returnflag") != "N")
    i = Q.has_parent(i, X.table(spark, d, "supplier").where("s_suppkey % 20 <> 0"), ["s_suppkey"], "has_supplier")
    counts = {
        "orders": Q.write_snapshot(o, {"q03": F.col("has_version"), "q12": F.col("o_totalprice") >= 50000, "q15": F.col("has_customer")}, shared_path(spark), ["o_orderkey", "o_custkey", "o_totalprice"]),
        "lineitem": Q.write_snapshot(i, {"q06": F.col("once"), "q08": F.col("l_tax") <= F.col("l_discount"), "q12": F.col("l_quantity") <= 40, "q15": F.col("has_supplier")}, shared_path(spark), ["l_orderkey", "l_linenumber", "l_suppkey"]),
    }
    return spark.createDataFrame([(t, rule, n) for t, c in counts.items() for rule, n in c.items()], "snapshot string, rule string, n long")


@query("q04_q09_immutable_snapshots", "SELECT event_id FROM events WHERE event_id % 37 = 0 OR event_id % 41 = 0")
def q04(spark, d):
    e = X.table(spark, d, "events").select("event_id", "event_type", "value")
    new = e.where("event_id % 37 <> 0").withColumn("value", F.when(F.col("event_id") % 41 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return Q.changed_rows(e, new, ["event_id"], ["event_type", "value"])


@query("q05_q15_references", "SELECT 'customer' AS parent, o_orderkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 0) UNION ALL SELECT 'supplier', ps FROM (SELECT l_orderkey AS ps FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 20 <> 0))")
def q05(spark, d):
    o = X.table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    i = X.table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "s_suppkey")
    a = Q.missing_parent(o, X.table(spark, d, "customer").where("c_custkey % 50 <> 0"), ["c_custkey"]).select(F.lit("customer").alias("parent"), F.col("o_orderkey").alias("id"))
    return a.unionByName(Q.missing_parent(i, X.table(spark, d, "supplier").where("s_suppkey % 20 <> 0"), ["s_suppkey"]).select(F.lit("supplier").alias("parent"), F.col("l_orderkey").alias("id")))


@query("q06_q10_uniqueness", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2 HAVING count(*) > 1")
def q06(spark, d):
    return Q.duplicates(X.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], F.col("l_returnflag") != "N")


@query("q07_q08_q12_value_rules", "SELECT event_id, unnest(list_filter([CASE WHEN NOT (value >= 1) THEN 'non_negative' END, CASE WHEN event_type NOT IN ('click', 'view', 'error', 'purchase') THEN 'domain' END, CASE WHEN NOT ((event_type = 'error') = (value < 400)) THEN 'pairing' END], lambda x: x IS NOT NULL)) AS rule FROM events")
def q07(spark, d):
    e = X.table(spark, d, "events")
    return Q.bad_values(e, "event_id", {"non_negative": F.col("value") >= 1, "domain": F.col("event_type").isin("click", "view", "error", "purchase"), "pairing": (F.col("event_type") == "error") == (F.col("value") < 400)})


@query("q11_domain_overlap", "SELECT DISTINCT a.source, a.lang FROM documents a JOIN (SELECT DISTINCT source FROM documents WHERE lang = 'es') b USING (source) WHERE a.lang = 'fr'")
def q11(spark, d):
    t = X.table(spark, d, "documents").select("source", "lang")
    return t.where("lang = 'fr'").distinct().join(t.where("lang = 'es'").select("source").distinct(), "source")


@query("q13_scope_consistency", f"""WITH {SCOPES}, r AS (SELECT k, reason, CASE WHEN reason IS NULL THEN private ELSE [] END AS p, CASE WHEN reason IS NOT NULL THEN [] WHEN is_group THEN list_filter(list_distinct(teams), lambda x: x <> space) ELSE list_distinct(teams) END AS o, CASE WHEN reason IS NULL AND is_group THEN [space] ELSE [] END AS t FROM sc),
u AS (SELECT k, reason, list_distinct(list_concat(p, o, t)) AS u FROM r), m AS (SELECT *, list_concat(u, CASE WHEN reason IS NULL AND k % 9 = 0 THEN ['zz'] ELSE [] END) AS members FROM u) SELECT k FROM m WHERE (reason IS NOT NULL AND len(u) > 0) OR (reason IS NULL AND list_sort(members) <> list_sort(u))""")
def q13(spark, d):
    s = scope.resolve_scopes(requests(spark, d))
    team = F.when(F.col("current_team").isNotNull(), F.array("current_team")).otherwise(F.array().cast("array<string>"))
    members = F.array_distinct(F.concat("private_spaces", "other_teams", team))
    extra = F.when(F.col("reason").isNull() & (F.col("k") % 9 == 0), F.array(F.lit("zz"))).otherwise(F.array().cast("array<string>"))
    return Q.scope_inconsistent(s.withColumn("members", F.concat(members, extra))).select("k")


@query("q14_revision_triggers", "WITH o AS (SELECT event_id, 1 AS revision, event_type AS content FROM events), n AS (SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN 1 WHEN event_id % 3 <> 0 THEN 2 ELSE 3 END AS revision, CASE WHEN event_id % 10 = 0 THEN 'x' ELSE event_type END AS content FROM events) SELECT event_id FROM o JOIN n USING (event_id) WHERE o.content IS DISTINCT FROM n.content AND n.revision <> o.revision + 1")
def q14(spark, d):
    old = X.table(spark, d, "events").select("event_id", F.lit(1).alias("revision"), F.col("event_type").alias("content"))
    i = F.col("event_id")
    new = old.withColumn("content", F.when(i % 10 == 0, "x").otherwise(F.col("content"))).withColumn("revision", F.when((i % 10 == 0) & (i % 3 != 0), 2).when(i % 10 == 0, 3).otherwise(1))
    return Q.revision_jumps(old, new, "event_id", "revision")
