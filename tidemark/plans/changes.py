"""Queries of change logs and reducers (IO, E, J, A, W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import corpus as V8
from tidemark.operators import events as EV
from tidemark.operators import lifecycle as L
from tidemark.plans import fixtures as X
from tidemark.plans.registry import query
from tidemark.sources.tables import BatchTable, shared_path

FOLD = f"""WITH RECURSIVE {X.DE}, o AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY sequence) AS i FROM de),
f AS (SELECT document_id, 0::BIGINT AS i, 0::BIGINT AS sequence, NULL::VARCHAR AS outcome, FALSE AS live, 0::BIGINT AS agg, 0::BIGINT AS acc, 0::BIGINT AS life, FALSE AS dead, 0::BIGINT AS t_agg, 0::BIGINT AS t_acc, 0::BIGINT AS t_life, 0::BIGINT AS last FROM (SELECT DISTINCT document_id FROM de)
 UNION ALL SELECT document_id, i, sequence, r, CASE WHEN r = 'applied' THEN kind = 'upsert' ELSE live END, CASE WHEN r <> 'applied' THEN agg WHEN kind = 'upsert' THEN ea ELSE 0 END, CASE WHEN r <> 'applied' THEN acc WHEN kind = 'upsert' THEN ec ELSE 0 END, CASE WHEN r <> 'applied' THEN life WHEN kind = 'upsert' THEN el ELSE 0 END,
 CASE WHEN r = 'applied' THEN kind = 'delete' ELSE dead END, CASE WHEN r <> 'applied' THEN t_agg WHEN kind = 'delete' THEN greatest(ea, t_agg) ELSE 0 END, CASE WHEN r <> 'applied' THEN t_acc WHEN kind = 'delete' THEN greatest(ec, t_acc) ELSE 0 END, CASE WHEN r <> 'applied' THEN t_life WHEN kind = 'delete' THEN greatest(el, t_life) ELSE 0 END, CASE WHEN r = 'applied' THEN sequence ELSE last END
 FROM (SELECT f.*, o.i AS ni, o.sequence AS ns, o.kind, o.aggregate_revision AS ea, o.access_revision AS ec, o.lifecycle_revision AS el,
  CASE WHEN dead AND t_life >= o.lifecycle_revision THEN 'stale_lifecycle' WHEN NOT live THEN 'applied' WHEN o.kind = 'delete' AND o.aggregate_revision > 0 AND o.aggregate_revision < agg THEN 'stale_revision' WHEN o.kind = 'upsert' AND o.aggregate_revision < agg THEN 'stale_revision' WHEN o.kind = 'upsert' AND o.access_revision < acc THEN 'stale_access' WHEN o.lifecycle_revision < life THEN 'stale_lifecycle' ELSE 'applied' END AS r
  FROM f JOIN o ON o.document_id = f.document_id AND o.i = f.i + 1) AS z(document_id, oi, os, oo, live, agg, acc, life, dead, t_agg, t_acc, t_life, last, i, sequence, kind, ea, ec, el, r))"""


def log(spark, d):
    return EV.dedupe(X.document_events(spark, d), "event_id", "sequence", "copy").drop("copy")


@query("e01_document_event_outcomes", f"{FOLD} SELECT document_id, sequence, outcome FROM f WHERE i > 0")
def e01(spark, d):
    return EV.apply_document_events(log(spark, d))[2]


@query("e01_io12_document_state", f"{FOLD} SELECT document_id, last AS sequence, agg AS aggregate_revision, acc AS access_revision, life AS lifecycle_revision, event_type AS content FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY i DESC) AS k FROM f) JOIN events ON event_id + 1 = last WHERE k = 1 AND live")
def e01_state(spark, d):
    """Live documents with the content of their winning event, joined by sequence."""
    state, _, _ = EV.apply_document_events(log(spark, d))
    return state.join(log(spark, d).select("sequence", "content"), "sequence")


@query("e01_io13_tombstones", f"{FOLD} SELECT document_id, t_agg AS aggregate_revision, t_acc AS access_revision, t_life AS lifecycle_revision FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY i DESC) AS k FROM f) WHERE k = 1 AND dead")
def e01_tombs(spark, d):
    return EV.apply_document_events(log(spark, d))[1]


@query("io12_io13_merged_state", f"{FOLD} SELECT document_id, live, agg, acc, life, dead, t_agg, t_acc, t_life, last, CASE WHEN live THEN event_type END AS content FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY i DESC) AS k FROM f) JOIN events ON event_id + 1 = last WHERE k = 1")
def io12(spark, d):
    """The log in five slices, each merged into a stored state table; the third is delivered twice, once under
    its old number and once under a new one."""
    table = BatchTable(spark, shared_path(spark), EV.STATE, "document_id", buckets=16)
    low, high = log(spark, d).agg(F.min("sequence"), F.max("sequence")).first()
    step = F.floor((F.col("sequence") - (low or 0)) * 5 / ((high or 0) - (low or 0) + 1))
    for number, piece in enumerate((0, 1, 2, 3, 2, 4)):
        EV.merge_batch(table, number, log(spark, d).where(step == piece))
    EV.merge_batch(table, 2, log(spark, d).where(step == 2))
    table.sweep()
    return table.current().drop("seen")


@query("e06_a05_rebuild_counts", f"{FOLD} SELECT count(DISTINCT document_id) FILTER (outcome = 'applied') AS rebuilt, count(*) FILTER (outcome <> 'applied') AS skipped, count(*) FILTER (outcome IS NULL) AS failed, max(sequence) AS cursor FROM f WHERE i > 0")
def e06(spark, d):
    o = EV.apply_document_events(log(spark, d))[2]
    return o.agg(F.countDistinct(F.when(F.col("outcome") == "applied", F.col("document_id"))).alias("rebuilt"), F.count(F.when(F.col("outcome") != "applied", 1)).alias("skipped"), F.count(F.when(F.col("outcome").isNull(), 1)).alias("failed"), F.coalesce(F.max("sequence"), F.lit(0)).alias("cursor"))


@query("j17_index_status", f"{FOLD}, z AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY i DESC) AS k FROM f), q AS (SELECT unnest(range(0, 300)) AS document_id) SELECT document_id, CASE WHEN live THEN 'indexed' WHEN dead THEN 'deleted' ELSE 'unknown' END AS status, coalesce(CASE WHEN live THEN life ELSE t_life END, 0) AS lifecycle_revision FROM q LEFT JOIN (SELECT * FROM z WHERE k = 1) USING (document_id)")
def j17(spark, d):
    state, tombs, _ = EV.apply_document_events(log(spark, d))
    s = state.select("document_id", F.lit("indexed").alias("s1"), F.col("lifecycle_revision").alias("l1"))
    t = tombs.select("document_id", F.lit("deleted").alias("s2"), F.col("lifecycle_revision").alias("l2"))
    q = spark.range(300).withColumnRenamed("id", "document_id")
    j = q.join(s.join(t, "document_id", "full_outer"), "document_id", "left")
    return j.select("document_id", F.coalesce("s1", "s2", F.lit("unknown")).alias("status"), F.coalesce("l1", "l2", F.lit(0)).alias("lifecycle_revision"))


DEC = f"""WITH {X.RE}, a AS (SELECT *, conversation_id = first_value(conversation_id) OVER (PARTITION BY record_id ORDER BY arrival) AS same FROM re), b AS (SELECT *, max(CASE WHEN same THEN revision END) OVER (PARTITION BY record_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM a),
c AS (SELECT *, same AND (prev IS NULL OR revision > prev) AS applied FROM b), e AS (SELECT *, last_value(CASE WHEN applied THEN recall END IGNORE NULLS) OVER w AS was_recalled, last_value(CASE WHEN applied AND NOT recall THEN payload END IGNORE NULLS) OVER w AS was FROM c WINDOW w AS (PARTITION BY record_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
dc AS (SELECT record_id, arrival, revision, conversation_id, recall, payload, CASE WHEN NOT same THEN 'conflict' WHEN applied THEN 'apply' WHEN revision < prev THEN 'stale_revision' WHEN (recall AND was_recalled) OR (NOT recall AND NOT was_recalled AND payload IS NOT DISTINCT FROM was) THEN 'duplicate_revision' ELSE 'conflict' END AS decision FROM e)"""


@query("e02_w04_w05_record_decisions", f"{DEC} SELECT record_id, arrival, decision FROM dc")
def e02(spark, d):
    return EV.decide_record_events(X.record_events(spark, d)).select("record_id", "arrival", "decision")


REC = f"{DEC}, rs AS (SELECT record_id, max(revision) AS revision, arg_max(conversation_id, arrival) AS conversation_id, arg_max(recall, arrival) AS recalled, arg_max(payload, arrival) FILTER (NOT recall) AS payload FROM dc WHERE decision = 'apply' GROUP BY record_id)"


@query("e02_record_state", f"{REC} SELECT * FROM rs")
def e02_state(spark, d):
    return EV.record_state(EV.decide_record_events(X.record_events(spark, d)))


@query("a03_a04_status_scalars", f"{REC} SELECT (SELECT count(*) FILTER (NOT recalled) FROM rs) AS indexed, (SELECT count(*) FILTER (recalled) FROM rs) AS recalled, (SELECT count(*) FROM re) AS events, (SELECT coalesce(max(arrival), 0) FROM re) AS cursor")
def a03(spark, d):
    s = EV.record_state(EV.decide_record_events(X.record_events(spark, d)))
    one = s.agg(F.count(F.when(~F.col("recalled"), 1)).alias("indexed"), F.count(F.when(F.col("recalled"), 1)).alias("recalled"))
    return one.crossJoin(X.record_events(spark, d).agg(F.count("*").alias("events"), F.coalesce(F.max("arrival"), F.lit(0)).alias("cursor")))


@query("w01_latest_per_record", f"WITH {X.RE} SELECT record_id, revision, arrival FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY revision DESC, arrival) AS k FROM re) WHERE k = 1")
def w01(spark, d):
    return L.last_action(X.record_events(spark, d), ["record_id"], F.desc("revision"), "arrival").select("record_id", "revision", "arrival")


@query("e07_j12_j13_a17_record_rebuild", f"{REC}, rw AS (SELECT record_id, revision + CASE WHEN record_id % 3 = 0 THEN 1 ELSE -1 END AS revision FROM rs WHERE record_id % 10 <> 0 UNION ALL SELECT 100000 + record_id, 1 FROM rs WHERE record_id % 20 = 0) SELECT (SELECT count(*) FROM rw JOIN rs USING (record_id) WHERE rw.revision <= rs.revision) AS refreshed, (SELECT count(*) FROM rw WHERE record_id NOT IN (SELECT record_id FROM rs)) AS orphans, (SELECT count(*) FROM rs WHERE record_id NOT IN (SELECT record_id FROM rw)) AS missing")
def e07(spark, d):
    """Rows against the ledger: brought forward, without a ledger entry, and missing."""
    s = EV.record_state(EV.decide_record_events(X.record_events(spark, d))).select("record_id", "revision")
    rows = s.where("record_id % 10 <> 0").select("record_id", F.expr("revision + if(record_id % 3 = 0, 1, -1)").alias("revision")).unionByName(s.where("record_id % 20 = 0").select((F.col("record_id") + 100000).alias("record_id"), F.lit(1).cast("bigint").alias("revision")))
    fresh = EV.refresh_records(rows, s).where("refreshed").agg(F.count("*").alias("refreshed"))
    return fresh.crossJoin(rows.join(s, "record_id", "left_anti").agg(F.count("*").alias("orphans"))).crossJoin(s.join(rows, "record_id", "left_anti").agg(F.count("*").alias("missing")))


@query("io01_a07_log_scan", f"WITH {X.DE} SELECT sequence, document_id, kind FROM de WHERE sequence > 500 ORDER BY sequence LIMIT 100")
def io01(spark, d):
    return EV.scan(log(spark, d), 500).select("sequence", "document_id", "kind")


@query("io03_io05_append_events", f"WITH {X.DE}, k AS (SELECT *, kind || ':' || document_id::VARCHAR || ':' || aggregate_revision::VARCHAR AS dedupe_key FROM de) SELECT DISTINCT dedupe_key FROM k WHERE sequence % 2 = 0 AND dedupe_key NOT IN (SELECT dedupe_key FROM k WHERE sequence % 2 = 1)")
def io03(spark, d):
    k = log(spark, d).withColumn("dedupe_key", F.concat_ws(":", "kind", F.col("document_id").cast("string"), F.col("aggregate_revision").cast("string")))
    return EV.append_new(k.where("sequence % 2 = 1"), k.where("sequence % 2 = 0")).select("dedupe_key")


@query("e03_dedupe", f"WITH {X.DE} SELECT event_id, sequence FROM de")
def e03(spark, d):
    return log(spark, d).select("event_id", "sequence")


@query("e04_sequence_conflicts", "SELECT event_id // 3 AS sequence, count(*) AS ids FROM events WHERE event_id % 3 <> 1 OR event_id % 2 = 0 GROUP BY 1 HAVING count(*) > 1")
def e04(spark, d):
    e = X.table(spark, d, "events").where("event_id % 3 <> 1 or event_id % 2 = 0")
    return EV.sequence_conflicts(e.select(F.floor(F.col("event_id") / 3).alias("sequence"), "event_id"))


@query("e10_idempotent_replay", "SELECT event_id, CASE WHEN k = 1 THEN 'first' WHEN event_type = f THEN 'replayed' ELSE 'conflict' END AS result FROM (SELECT *, row_number() OVER w AS k, first_value(event_type) OVER w AS f FROM events WINDOW w AS (PARTITION BY event_id // 4 ORDER BY event_id))")
def e10(spark, d):
    e = X.table(spark, d, "events").select("event_id", F.floor(F.col("event_id") / 4).alias("operation_id"), F.col("event_id").alias("arrival"), F.col("event_type").alias("fingerprint"))
    return EV.replay(e).select("event_id", "result")


@query("e11_w06_a16_ledger_retention", "SELECT event_id AS operation_id, r AS recorded_at FROM (SELECT *, row_number() OVER (ORDER BY r DESC, event_id DESC) AS k FROM (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 0 ELSE event_id // 7 END AS r FROM events) WHERE r = 0 OR r >= 1300 - 900) WHERE k <= 3000")
def e11(spark, d):
    e = X.table(spark, d, "events").select(F.col("event_id").alias("operation_id"), F.when(F.col("event_id") % 50 == 0, 0).otherwise(F.floor(F.col("event_id") / 7)).alias("recorded_at"))
    return EV.prune_ledger(e, now=1300, ttl=900, cap=3000)


CMD = """cm AS (SELECT user_id AS document_id, event_id AS seq, CASE WHEN event_id % 211 = 0 THEN 'trash' WHEN event_id % 97 = 0 THEN 'archive' WHEN event_type = 'view' THEN 'access' WHEN event_type = 'click' THEN 'draft' WHEN event_type = 'error' THEN 'withdraw' ELSE 'publish' END AS op, event_id % 5 AS version, event_id % 2 = 0 AS flag, CASE WHEN event_id % 13 = 0 THEN 5 ELSE 0 END AS expected FROM events)"""


def commands(spark, d):
    i, t = F.col("event_id"), F.col("event_type")
    op = F.when(i % 211 == 0, "trash").when(i % 97 == 0, "archive").when(t == "view", "access").when(t == "click", "draft").when(t == "error", "withdraw").otherwise("publish")
    return X.table(spark, d, "events").select(F.col("user_id").alias("document_id"), i.alias("seq"), op.alias("op"), (i % 5).alias("version"), (i % 2 == 0).alias("flag"), F.when(i % 13 == 0, 5).otherwise(0).alias("expected"))


LIFE = f"""WITH RECURSIVE {CMD}, o AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY seq) AS i FROM cm),
f AS (SELECT document_id, 0::BIGINT AS i, 0::BIGINT AS seq, NULL::VARCHAR AS result, 'active' AS status, 0::BIGINT AS active, 1::BIGINT AS agg, 0::BIGINT AS act, 1::BIGINT AS acc, 1::BIGINT AS life, FALSE AS public FROM (SELECT DISTINCT document_id FROM cm)
 UNION ALL SELECT document_id, i, seq, r, CASE WHEN r = 'applied' AND op = 'archive' THEN 'archived' WHEN r = 'applied' AND op = 'trash' THEN 'trashed' ELSE status END, CASE WHEN r = 'applied' AND op = 'publish' THEN version WHEN r = 'applied' AND op = 'withdraw' THEN 0 ELSE active END,
 agg + (r = 'applied')::BIGINT, act + (r = 'applied' AND op IN ('publish', 'withdraw'))::BIGINT, acc + (r = 'applied' AND op = 'access')::BIGINT, life + (r = 'applied' AND op IN ('archive', 'trash'))::BIGINT, CASE WHEN r = 'applied' AND op = 'access' THEN flag ELSE public END
 FROM (SELECT f.document_id, o.i, o.seq, f.status, f.active, f.agg, f.act, f.acc, f.life, f.public, o.op, o.version, o.flag, CASE WHEN NOT (o.expected = 0 OR o.expected = agg) THEN 'revision_conflict' WHEN NOT CASE WHEN o.op = 'trash' THEN status <> 'trashed' WHEN o.op = 'withdraw' THEN status = 'active' AND active = o.version ELSE status = 'active' END THEN 'precondition' WHEN o.op = 'access' AND public = o.flag THEN 'unchanged' ELSE 'applied' END AS r FROM f JOIN o ON o.document_id = f.document_id AND o.i = f.i + 1))"""


@query("e12_e13_document_lifecycle", f"{LIFE} SELECT document_id, status, active, agg, act, acc, life, public FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY i DESC) AS k FROM f) WHERE k = 1")
def e12(spark, d):
    return L.reduce_documents(commands(spark, d)).where("seq is null").drop("seq", "result")


@query("e12_command_results", f"{LIFE} SELECT document_id, seq, result FROM f WHERE i > 0")
def e12_results(spark, d):
    return L.reduce_documents(commands(spark, d)).where("seq is not null").select("document_id", "seq", "result")


SAVES = """sv AS (SELECT user_id AS document_id, event_id AS seq, CASE WHEN event_id % 6 = 0 THEN '' ELSE 'r' || (event_id % 11)::VARCHAR END AS request_id, CASE WHEN event_id % 19 = 0 THEN 'other' ELSE 'web:user:' || (user_id % 3)::VARCHAR END AS subject_key, event_type AS content,
 CASE WHEN event_id % 4 < 2 THEN NULL ELSE event_id % 4 = 2 END AS public, CASE WHEN event_id % 13 = 0 THEN 7 ELSE 0 END AS expected, CASE WHEN user_id % 23 <> 0 THEN 'web:user:' || (user_id % 3)::VARCHAR END AS owner, CASE WHEN user_id % 17 = 0 THEN 'archived' ELSE 'active' END AS status FROM events),
fp AS (SELECT *, sha256(strlen(document_id::VARCHAR)::VARCHAR || ':' || document_id::VARCHAR || '1:t' || strlen(content)::VARCHAR || ':' || content || '8:markdown' || CASE WHEN public IS NULL THEN '27:authenticated_public:absent' WHEN public THEN '25:authenticated_public:true' ELSE '26:authenticated_public:false' END) AS f FROM sv)"""


@query("e14_saves", f"""WITH RECURSIVE {SAVES}, o AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY seq) AS i FROM fp),
w AS (SELECT document_id, 0::BIGINT AS i, 0::BIGINT AS seq, NULL::VARCHAR AS outcome, NULL::BIGINT AS version, 1::BIGINT AS aggregate, 0::BIGINT AS activation, 1::BIGINT AS access, 3::BIGINT AS latest, NULL::BOOLEAN AS public, []::VARCHAR[] AS ids, []::VARCHAR[] AS fs, []::BIGINT[] AS vs FROM (SELECT DISTINCT document_id FROM sv)
 UNION ALL SELECT document_id, ni, ns, r, CASE WHEN r = 'applied' THEN latest + 1 WHEN r = 'replayed' THEN vs[place] END, aggregate + ok * (2 + moved), activation + ok, access + ok * moved, latest + ok, CASE WHEN ok * moved = 1 THEN np ELSE public END,
  CASE WHEN ok = 1 AND rid <> '' THEN list_append(ids, rid) ELSE ids END, CASE WHEN ok = 1 AND rid <> '' THEN list_append(fs, nf) ELSE fs END, CASE WHEN ok = 1 AND rid <> '' THEN list_append(vs, latest + 1) ELSE vs END
 FROM (SELECT *, (r = 'applied')::BIGINT AS ok, (np IS NOT NULL AND np IS DISTINCT FROM public)::BIGINT AS moved FROM (SELECT w.*, o.i AS ni, o.seq AS ns, o.request_id AS rid, o.f AS nf, o.public AS np, list_position(w.ids, o.request_id) AS place,
  CASE WHEN o.owner IS NULL THEN 'not_found' WHEN o.owner <> o.subject_key THEN 'not_owner' WHEN o.request_id <> '' AND list_contains(w.ids, o.request_id) THEN CASE WHEN w.fs[list_position(w.ids, o.request_id)] = o.f THEN 'replayed' ELSE 'conflict' END WHEN o.expected NOT IN (0, w.aggregate) THEN 'revision_conflict' WHEN o.status <> 'active' THEN 'precondition' ELSE 'applied' END AS r
  FROM w JOIN o ON o.document_id = w.document_id AND o.i = w.i + 1)))
SELECT document_id, seq, outcome, version, CASE WHEN version IS NOT NULL THEN aggregate END AS aggregate, CASE WHEN version IS NOT NULL THEN activation END AS activation, CASE WHEN version IS NOT NULL THEN access END AS access, CASE WHEN version IS NOT NULL THEN coalesce(public, FALSE) END AS public FROM w WHERE i > 0""")
def e14(spark, d):
    e = X.table(spark, d, "events")
    i, u = F.col("event_id"), F.col("user_id")
    owner = F.concat(F.lit("web:user:"), (u % 3).cast("string"))
    saves = e.select(u.alias("document_id"), i.alias("seq"), F.when(i % 6 == 0, "").otherwise(F.concat(F.lit("r"), (i % 11).cast("string"))).alias("request_id"), F.when(i % 19 == 0, "other").otherwise(owner).alias("subject_key"), F.lit("t").alias("title"), F.col("event_type").alias("content"), F.lit("markdown").alias("format"), F.when(i % 4 >= 2, i % 4 == 2).alias("public"), F.when(i % 13 == 0, 7).otherwise(0).alias("expected"))
    one = F.lit(1).cast("bigint")
    documents = e.where(u % 23 != 0).select(u.alias("document_id"), owner.alias("owner_subject_key"), F.when(u % 17 == 0, "archived").otherwise("active").alias("status")).distinct().select("*", one.alias("aggregate"), (one - 1).alias("activation"), one.alias("access"), (one + 2).alias("latest"))
    return L.save_documents(saves, documents)


@query("e15_membership_intervals", "SELECT space_id, subject, created_at, revoked_at FROM (SELECT *, lead(event_id) OVER (PARTITION BY space_id, subject ORDER BY event_id) AS revoked_at, event_id AS created_at FROM (SELECT *, lag(a) OVER (PARTITION BY space_id, subject ORDER BY event_id) AS b FROM (SELECT event_id, user_id % 10 AS space_id, user_id AS subject, CASE WHEN event_type = 'error' THEN 'revoke' ELSE 'grant' END AS a FROM events)) WHERE b IS NULL OR b <> a) WHERE a = 'grant'")
def e15(spark, d):
    a = X.table(spark, d, "events").select((F.col("user_id") % 10).alias("space_id"), F.col("user_id").alias("subject"), F.when(F.col("event_type") == "error", "revoke").otherwise("grant").alias("action"), F.col("event_id").alias("ts"), F.col("event_id").alias("seq"))
    return L.effective_intervals(a, ["space_id", "subject"])


@query("e22_group_members", "SELECT user_id % 10 AS group_id, count(*) AS members FROM (SELECT user_id, arg_max(event_type, event_id) AS t FROM events GROUP BY user_id) WHERE t <> 'error' GROUP BY 1")
def e22(spark, d):
    e = X.table(spark, d, "events").select((F.col("user_id") % 10).alias("group_id"), "user_id", "event_id", "event_type")
    return L.last_action(e, ["group_id", "user_id"], F.desc("event_id")).where("event_type <> 'error'").groupBy("group_id").agg(F.count("*").alias("members"))


@query("e23_reviews", "SELECT request_id, username, CASE WHEN d = 'approve' AND row_number() OVER (PARTITION BY username, d ORDER BY seq) > 1 THEN 'username_taken' WHEN d = 'approve' THEN 'approved' ELSE 'rejected' END AS status FROM (SELECT event_id // 3 AS request_id, event_id AS seq, 'u' || ((event_id // 3) % 1500)::VARCHAR AS username, CASE WHEN event_type = 'error' THEN 'reject' ELSE 'approve' END AS d, row_number() OVER (PARTITION BY event_id // 3 ORDER BY event_id) AS k FROM events) WHERE k = 1")
def e23(spark, d):
    r = F.floor(F.col("event_id") / 3)
    e = X.table(spark, d, "events").select(r.alias("request_id"), F.col("event_id").alias("seq"), F.concat(F.lit("u"), (r % 1500).cast("string")).alias("username"), F.when(F.col("event_type") == "error", "reject").otherwise("approve").alias("decision"))
    return L.reduce_reviews(e).select("request_id", "username", "status")


@query("io14_io15_io16_chunk_store", "WITH s AS (SELECT vec_id, vec_id % 100 AS document_id, label AS v FROM embeddings), n AS (SELECT vec_id, document_id, v + 100 AS v FROM s WHERE document_id < 20 AND vec_id % 3 = 0), x AS (SELECT * FROM s WHERE document_id >= 20 UNION ALL SELECT * FROM n) SELECT vec_id, document_id, v, document_id % 3 AS access FROM x WHERE v NOT IN (3, 4)")
def io14(spark, d):
    s = X.table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 100).alias("document_id"), F.col("label").alias("v"))
    new = s.where("document_id < 20 and vec_id % 3 = 0").withColumn("v", F.col("v") + 100)
    held = EV.sync_controls(EV.replace_chunks(s, new), s.select("document_id", (F.col("document_id") % 3).alias("access")).distinct())
    stale = spark.createDataFrame([(3,), (4,)], "generation int")
    return EV.prune_generations(held.withColumn("generation", F.col("v")), stale).drop("generation")


@query("e05_consumer_cursors", "SELECT consumer, max(position) AS position FROM (SELECT event_type AS consumer, 500 AS position FROM events UNION ALL SELECT event_type, event_id + 1 FROM events WHERE event_type <> 'click') GROUP BY 1")
def e05(spark, d):
    e = X.table(spark, d, "events").select(F.col("event_type").alias("consumer"), (F.col("event_id") + 1).alias("sequence"))
    return EV.advance_cursors(e.select("consumer", F.lit(500).cast("bigint").alias("position")).distinct(), e.where("consumer <> 'click'"))


@query("e08_corpus_commands", None)
def e08(spark, d):
    """Commands of the events: five versions a user, with late and equal revisions and repeated operations."""
    e = X.table(spark, d, "events")
    i, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("bigint")
    kinds = F.array(*[F.lit(x) for x in ("index", "index", "activate", "activate", "share", "share", "index", "activate", "drop", "delete")])
    kind = F.get(kinds, (F.floor("value").cast("int") + k.cast("int")) % 10)
    version = F.concat(F.lit("v"), (k % 5).cast("string"))
    log = e.select(
        F.col("user_id").alias("document_id"), i.alias("seq"), F.concat(F.lit("op"), F.when(i % 50 == 7, i - 1).otherwise(i).cast("string")).alias("operation_id"), kind.alias("kind"), version.alias("version_id"),
        F.lit("s1").alias("owner_space"), F.sha2(F.concat(version, (i % 40 == 3).cast("string")), 256).alias("digest"), F.floor(i / 400).alias("lifecycle"), (1 + F.floor(i / 150) + k % 2).alias("revision"),
        F.when(i % 30 == 1, version).alias("expected_version"), (k % 2 == 0).alias("is_public"), F.array(F.concat(F.lit("s"), (k % 3).cast("string"))).alias("spaces"),
    )
    return V8.apply_corpus_commands(log)


@query("e09_chat_commands", None)
def e09(spark, d):
    """Commands of the events: messages of a user's conversation indexed, archived, shared, retracted, deleted."""
    e = X.table(spark, d, "events")
    i, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("bigint")
    kinds = F.array(*[F.lit(x) for x in ("index", "index", "index", "index", "archive", "share", "share", "retract", "retract", "delete")])
    message = F.concat(F.lit("m"), (k % 9).cast("string"))
    log = e.select(
        F.col("user_id").alias("conversation_id"), i.alias("seq"), F.concat(F.lit("op"), F.when(i % 50 == 7, i - 1).otherwise(i).cast("string")).alias("operation_id"),
        F.get(kinds, (F.floor("value").cast("int") + k.cast("int")) % 10).alias("kind"), F.array(message).alias("message_ids"), F.array(F.sha2(F.concat(message, (i % 40 == 3).cast("string")), 256)).alias("digests"),
        F.lit("s1").alias("owner_scope"), F.floor(i / 400).alias("lifecycle"), (1 + F.floor(i / 150) + k % 2).alias("revision"), F.array(F.concat(F.lit("s"), (k % 3).cast("string"))).alias("scopes"),
    )
    return V8.apply_chat_commands(log)
