"""Queries of chat history, delivery and chat search (J, E, K, A, F, T)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import storage_key
from tidemark.functions.vectors import l2
from tidemark.operators import chunking as C
from tidemark.operators import delivery as D
from tidemark.plans import fixtures as X
from tidemark.plans.registry import query
from tidemark.sources.history import History
from tidemark.sources.tables import shared_path

FAN = f"{X.CH}, mem AS (SELECT DISTINCT to_id, from_id AS member_id FROM ch WHERE NOT (from_id = 'user' AND to_id % 10 = 0)), fo AS (SELECT ch.to_id, message_id, created_at, m.member_id AS recipient_id FROM ch JOIN mem s ON s.to_id = ch.to_id AND s.member_id = ch.from_id JOIN mem m ON m.to_id = ch.to_id)"


def members(spark, d):
    c = X.chat(spark, d).where("not (from_id = 'user' and to_id % 10 = 0)")
    return c.select(F.col("to_id").alias("group_id"), F.col("from_id").alias("member_id")).distinct()


@query("j16_fan_out", f"WITH {FAN} SELECT * FROM fo")
def j16(spark, d):
    return D.fan_out(X.chat(spark, d), members(spark, d))


@query("e18_k12_pending_deliveries", f"WITH {FAN} SELECT to_id, message_id, recipient_id, created_at FROM fo WHERE (to_id, message_id, recipient_id) NOT IN (SELECT (to_id, message_id, from_id) FROM ch WHERE acked) AND (created_at, message_id) > (300000, 0) ORDER BY created_at, message_id, recipient_id LIMIT 100")
def e18(spark, d):
    acks = X.chat(spark, d).where("acked").select("to_id", "message_id", F.col("from_id").alias("recipient_id"))
    p = D.pending(D.fan_out(X.chat(spark, d), members(spark, d)), acks, ["to_id", "message_id", "recipient_id"])
    return p.where(D.after("created_at", "message_id", cursor=(300000, 0))).orderBy("created_at", "message_id", "recipient_id").limit(100)


@query("j08_delivery_messages", f"WITH {FAN} SELECT fo.message_id, fo.created_at, recipient_id, length(payload) AS size FROM fo JOIN ch ON fo.message_id = ch.message_id AND fo.created_at = ch.created_at")
def j08(spark, d):
    m = X.chat(spark, d).select("message_id", "created_at", F.char_length("payload").cast("bigint").alias("size"))
    return D.fan_out(X.chat(spark, d), members(spark, d)).join(m, ["message_id", "created_at"]).select("message_id", "created_at", "recipient_id", "size")


@query("k09_history", f"WITH {X.CH} SELECT to_id, message_id, row_number() OVER (PARTITION BY to_id ORDER BY created_at, message_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY to_id ORDER BY created_at DESC, message_id DESC) AS n FROM ch) WHERE n <= 3")
def k09(spark, d):
    return D.history(X.chat(spark, d), 3).select("to_id", "message_id", "place")


@query("k10_f19_backlog", f"WITH {X.CH} SELECT to_id, message_id, place FROM (SELECT *, row_number() OVER (PARTITION BY to_id ORDER BY created_at, message_id) AS place FROM ch WHERE NOT retracted AND created_at >= 1000001) WHERE place <= 2")
def k10(spark, d):
    return D.backlog(X.chat(spark, d).where("not retracted"), 1000001, 2).select("to_id", "message_id", "place")


@query("a14_bucket_counts", f"WITH {X.CH} SELECT created_at // 300000 * 300000 AS bucket, to_id, group_type, count(*) AS n FROM ch GROUP BY ALL")
def a14(spark, d):
    return D.bucket_counts(X.chat(spark, d), 300000)


@query("a08_conversation_counts", f"WITH {X.CH} SELECT to_id, count(*) AS indexed, count(*) FILTER (retracted) AS retracted FROM ch GROUP BY to_id")
def a08(spark, d):
    return X.chat(spark, d).groupBy("to_id").agg(F.count("*").alias("indexed"), F.count(F.when(F.col("retracted"), 1)).alias("retracted"))


@query("io17_io18_io19_history_layout", "SELECT to_id, message_id, created_at, length(payload) AS size, row_number() OVER (PARTITION BY to_id ORDER BY created_at DESC, message_id DESC) AS place FROM (SELECT conv_id::BIGINT AS to_id, turn::BIGINT AS message_id, (turn * 40000 + conv_id % 997)::BIGINT AS created_at, text AS payload FROM conversations) WHERE to_id % 50 = 7 AND created_at BETWEEN 40000 AND 250000")
def io17(spark, d):
    """Messages appended in three batches and compacted but for the last days; then some recipients' messages of a
    range of time, newest first."""
    c = X.chat(spark, d).withColumn("created_at", (F.col("message_id") * 40000 + F.col("to_id") % 997).cast("bigint"))
    names = ["to_id", "group_type", "message_id", "created_at", "payload"]
    table = History(spark, shared_path(spark), "to_id long, group_type string, message_id long, created_at long, payload string")
    for n in range(3):
        table.write(n, c.where((F.col("message_id") + F.col("to_id")) % 3 == n).select(names))
    table.compact(3, before_day=max(table.days(), default=0) - 1)
    found = table.between(40000, 250000).where("to_id % 50 = 7")
    newest = Window.partitionBy("to_id").orderBy(F.desc("created_at"), F.desc("message_id"))
    return found.select("to_id", "message_id", "created_at", F.char_length("payload").cast("bigint").alias("size"), F.row_number().over(newest).alias("place"))


CONTROLS = f"{X.CH}, st AS (SELECT *, strlen(to_id::VARCHAR)::VARCHAR || ':' || to_id::VARCHAR || strlen(message_id::VARCHAR)::VARCHAR || ':' || message_id::VARCHAR AS storage_id FROM ch), lv AS (SELECT storage_id, archived, retracted, FALSE AS dead FROM st WHERE message_id % 5 <> 0), ct AS (SELECT * FROM lv UNION ALL SELECT storage_id, FALSE, FALSE, TRUE FROM st WHERE message_id % 5 = 0 AND to_id % 2 = 0)"


def controls(spark, d):
    s = X.chat(spark, d).withColumn("storage_id", storage_key("to_id", "message_id"))
    live = s.where("message_id % 5 <> 0").select("storage_id", "to_id", "retracted")
    conversations = s.select("to_id", "archived").distinct()
    return D.controls(live, conversations, s.where("to_id % 2 = 0").select("storage_id"))


@query("f21_e21_message_controls", f"WITH {CONTROLS} SELECT * FROM ct")
def f21(spark, d):
    return controls(spark, d)


@query("t22_f10_f20_chat_search", f"""WITH {CONTROLS}, qs AS (SELECT vec_id AS query_id, ['the of der', 'tion', 'ering und la'][1 + vec_id // 100 % 3] AS text, list_transform(embedding, lambda x: x::DOUBLE) AS q, [3, 10, 60, 20][1 + vec_id // 100 % 4] AS k, CASE WHEN vec_id % 500 = 0 THEN 0 ELSE 200000 END AS start, CASE WHEN vec_id % 700 = 0 THEN 5000000 ELSE 0 END AS stop, [59, 5, 100000, 20][1 + vec_id // 100 % 4] AS upto FROM embeddings WHERE vec_id % 100 = 0),
t AS (SELECT storage_id, regexp_extract_all(lower(payload), '\\p{{Han}}|[\\p{{L}}\\p{{Nd}}]+') AS t FROM st), n AS (SELECT count(*) AS n, avg(len(t)) AS a FROM t), qt AS (SELECT query_id, unnest(string_split(text, ' ')) AS term FROM qs), tf AS (SELECT storage_id, len(t) AS len, term, count(*) AS tf FROM (SELECT storage_id, t, unnest(t) AS term FROM t) WHERE term IN (SELECT term FROM qt) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT query_id, storage_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))), 6) AS score FROM tf JOIN df USING (term) JOIN qt USING (term), n GROUP BY ALL), vi AS (SELECT storage_id FROM ct WHERE archived AND NOT retracted AND NOT dead),
en AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), ds AS (SELECT query_id, storage_id, round(list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))), 6) AS score FROM st JOIN en ON vec_id = to_id * 8 + message_id, qs WHERE storage_id IN (SELECT storage_id FROM vi)),
ar AS (SELECT arm, query_id, storage_id, score, row_number() OVER (PARTITION BY arm, query_id ORDER BY score DESC, storage_id) AS rank FROM (SELECT 's' AS arm, * FROM s WHERE storage_id IN (SELECT storage_id FROM vi) UNION ALL SELECT 'd', * FROM ds)),
lm AS (SELECT query_id, k, least(greatest(2 * k, 16) * 2 ** i, least(greatest(16 * k, 128), 800))::INT AS l FROM qs, range(0, 8) r(i) GROUP BY ALL),
fu AS (SELECT query_id, l, k, storage_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fused, max(rank) FILTER (arm = 's') AS sparse_rank, max(score) FILTER (arm = 's') AS sparse_score, max(rank) FILTER (arm = 'd') AS dense_rank, max(score) FILTER (arm = 'd') AS dense_score FROM ar JOIN lm USING (query_id) WHERE rank <= l GROUP BY ALL),
ca AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, l ORDER BY fused DESC, storage_id) AS place FROM fu) WHERE place <= l),
ok AS (SELECT ca.*, row_number() OVER (PARTITION BY query_id, l ORDER BY place) AS rank FROM ca JOIN st USING (storage_id) JOIN qs USING (query_id) WHERE created_at >= start AND (stop = 0 OR created_at <= stop) AND to_id BETWEEN 1 AND upto),
ro AS (SELECT lm.query_id, lm.l, lm.k, (SELECT count(*) FROM ca WHERE ca.query_id = lm.query_id AND ca.l = lm.l) AS n, (SELECT count(*) FROM ok WHERE ok.query_id = lm.query_id AND ok.l = lm.l) AS m FROM lm),
ch2 AS (SELECT query_id, k, min(l) AS candidates, arg_min(m < k AND n >= l, l) AS truncated FROM ro WHERE m >= k OR n < l OR l = least(greatest(16 * k, 128), 800) GROUP BY ALL)
SELECT query_id, candidates, truncated, storage_id, fused, sparse_rank, sparse_score, dense_rank, dense_score, rank FROM ch2 LEFT JOIN (SELECT * FROM ok) o USING (query_id) WHERE (o.l = candidates AND rank <= ch2.k) OR (o.l IS NULL) UNION ALL SELECT query_id, candidates, truncated, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM ch2 WHERE query_id IN (SELECT query_id FROM ok) AND NOT EXISTS (SELECT 1 FROM ok WHERE ok.query_id = ch2.query_id AND ok.l = candidates)""")
def t22(spark, d):
    """Searches with every vector whose id is divisible by 100, each with a text, a page size, a time range and
    conversations of its own; some find their page among the first candidates, others widen or stay open. A
    message's vector is one of the given ones, by number; some messages have none."""
    s = X.chat(spark, d).withColumn("storage_id", storage_key("to_id", "message_id")).withColumn("vec_id", F.col("to_id") * 8 + F.col("message_id"))
    v = X.table(spark, d, "embeddings").select("vec_id", l2(F.transform("embedding", lambda x: x.cast("double"))).alias("vector"))
    chunks = s.join(v, "vec_id", "left").select(F.col("storage_id").alias("chunk_id"), "storage_id", F.col("payload").alias("text"), "vector", "to_id", "created_at")
    n = F.floor(F.col("vec_id") / 100).cast("int")
    one_of = lambda *xs: F.get(F.array(*[F.lit(x) for x in xs]), n % len(xs))
    asked = v.where("vec_id % 100 = 0").select(
        F.col("vec_id").alias("query_id"), one_of("the of der", "tion", "ering und la").alias("text"), "vector", one_of(3, 10, 60, 20).alias("k"),
        F.when(F.col("vec_id") % 500 == 0, 0).otherwise(200000).alias("start"), F.when(F.col("vec_id") % 700 == 0, 5000000).otherwise(0).alias("stop"), one_of(59, 5, 100000, 20).alias("upto"),
    )
    scopes = F.col("to_id").between(1, F.col("upto"))
    rule = D.authorised(F.col("start"), F.col("stop"), F.array("to_id")) & scopes
    return D.search_chat(chunks, controls(spark, d), asked, rule)


MATCHED = f"{X.CH}, m AS (SELECT *, regexp_extract_all(lower(payload), '\\p{{Han}}|[\\p{{L}}\\p{{Nd}}]+') AS t FROM ch WHERE to_id % 3 <> 0 AND NOT retracted)"


@query("t23_channel_search", f"""WITH {MATCHED}, h AS (SELECT to_id, message_id, created_at, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM m WHERE list_contains(t, 'the') AND list_contains(t, 'of')),
w AS (SELECT *, lag(term) OVER o AS pt, lag(pos) OVER o AS pp FROM h WHERE term IN ('the', 'of') WINDOW o AS (PARTITION BY to_id, message_id ORDER BY pos)),
s AS (SELECT to_id * 1000 + message_id AS record_id, any_value(created_at) AS sent_at, round(coalesce(sum(CASE WHEN term <> pt THEN 0.1::DOUBLE / (pos - pp) END), 0), 6) AS score FROM w GROUP BY to_id, message_id),
r AS (SELECT record_id, score, row_number() OVER (ORDER BY score DESC, CASE WHEN record_id % 4 <> 0 THEN sent_at END DESC NULLS LAST, record_id) AS rank, count(*) OVER () > 20 AS more FROM s) SELECT * FROM r WHERE rank <= 20""")
def t23(spark, d):
    """Some messages have no time, which puts them last among equal scores."""
    record = F.col("to_id") * 1000 + F.col("message_id")
    m = X.chat(spark, d).select(record.alias("record_id"), F.col("payload").alias("text"), F.when(record % 4 != 0, F.col("created_at")).alias("sent_at"), "to_id", "retracted")
    return D.search_channel_messages(m, "the of", (F.col("to_id") % 3 != 0) & ~F.col("retracted"), 20).select("record_id", "score", "rank", "more")


GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: x <> ''), lambda w: list_transform(range(1, length('  ' || w || ' ') - 1), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query("t24_t05_k08_file_search", f"""WITH f AS (SELECT p_partkey AS record_id, p_name AS file_name, p_type AS mime, CASE WHEN p_partkey % 5 <> 0 THEN p_size END AS uploaded_at FROM part WHERE p_partkey % 7 <> 0),
m AS (SELECT *, regexp_extract_all(lower(file_name || ' ' || mime), '[\\p{{L}}\\p{{Nd}}]+') AS t, {GRAMS.format('file_name')} AS a, {GRAMS.format("'ring'")} AS b FROM f),
s AS (SELECT record_id, uploaded_at, round(greatest(0.1::DOUBLE * len(list_filter(t, lambda x: x = 'ring')), len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE), 6) AS score FROM m WHERE list_contains(t, 'ring') OR contains(lower(file_name), 'ring'))
SELECT record_id, score, rank, more FROM (SELECT *, row_number() OVER (ORDER BY score DESC, uploaded_at DESC NULLS LAST, record_id) AS rank, count(*) OVER () > 30 AS more FROM s) WHERE rank <= 30""")
def t24(spark, d):
    k = F.col("p_partkey")
    files = X.table(spark, d, "part").select(k.alias("record_id"), F.col("p_name").alias("file_name"), F.col("p_type").alias("mime"), F.when(k % 5 != 0, F.col("p_size")).alias("uploaded_at"))
    return D.search_channel_files(files, "ring", F.col("record_id") % 7 != 0, 30).select("record_id", "score", "rank", "more")


@query("x04_message_blocks", "SELECT conv_id * 1000 + turn AS document_id, 0 AS position, 'paragraph' AS kind, '' AS section, trim(text) AS text FROM conversations WHERE trim(text) <> ''")
def x04(spark, d):
    m = X.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("document_id"), "text")
    return C.message_blocks(m)
