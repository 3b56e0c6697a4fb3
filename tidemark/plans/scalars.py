"""Queries of scalar functions and set algebra (S, U, F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions import vectors as V
from tidemark.operators import scope
from tidemark.plans import fixtures as X
from tidemark.plans.registry import query


@query("s01_canonical_uuid", """SELECT doc_id, raw, CASE WHEN regexp_matches(lower(trim(raw)), '^[0-9a-f]{32}$') THEN substr(lower(trim(raw)), 1, 8) || '-' || substr(lower(trim(raw)), 9, 4) || '-' || substr(lower(trim(raw)), 13, 4) || '-' || substr(lower(trim(raw)), 17, 4) || '-' || substr(lower(trim(raw)), 21, 12) WHEN regexp_matches(lower(trim(raw)), '^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$') THEN lower(trim(raw)) END AS id
 FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN upper(substr(h, 1, 32)) WHEN 1 THEN ' ' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) WHEN 2 THEN substr(h, 1, 31) ELSE 'z' || substr(h, 2, 31) END AS raw FROM (SELECT doc_id, sha256(text) AS h FROM documents))""")
def s01(spark, d):
    t = X.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    dashed = F.concat(F.lit(" "), F.regexp_replace(F.substring("h", 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
    k = F.col("doc_id") % 4
    raw = F.when(k == 0, F.upper(F.substring("h", 1, 32))).when(k == 1, dashed).when(k == 2, F.substring("h", 1, 31)).otherwise(F.concat(F.lit("z"), F.substring("h", 2, 31)))
    return t.select("doc_id", raw.alias("raw")).withColumn("id", S.canonical_uuid("raw"))


@query("s02_s08_s09_text_shaping", r"""SELECT doc_id, substr(text, 1, 17) AS cut, trim(regexp_replace(text, '\s+', ' ', 'g')) AS line, substr(regexp_replace(text, '^\s+|\s+$', '', 'g'), 1, 100) AS summary FROM documents""")
def s02(spark, d):
    return X.table(spark, d, "documents").select("doc_id", S.truncate("text", 17).alias("cut"), S.one_line("text").alias("line"), S.summary("text").alias("summary"))


@query("s03_status", """SELECT status AS raw, CASE WHEN v IN ('', 'unspecified') THEN 'draft' ELSE v END AS status, count(*) AS n FROM (SELECT status, replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(status)), '^content_format_', ''), '^lifecycle_status_', ''), '^publication_status_', ''), '_status', '') AS v
 FROM (SELECT CASE event_id % 5 WHEN 0 THEN 'PUBLICATION_STATUS_' || upper(event_type) WHEN 1 THEN ' ' || event_type || '_status' WHEN 2 THEN 'lifecycle_status_unspecified' WHEN 3 THEN '' ELSE event_type END AS status FROM events)) GROUP BY ALL""")
def s03(spark, d):
    k, t = F.col("event_id") % 5, F.col("event_type")
    raw = F.when(k == 0, F.concat(F.lit("PUBLICATION_STATUS_"), F.upper(t))).when(k == 1, F.concat(F.lit(" "), t, F.lit("_status"))).when(k == 2, "lifecycle_status_unspecified").when(k == 3, "").otherwise(t)
    e = X.table(spark, d, "events").select(raw.alias("raw"))
    return e.groupBy("raw", S.status("raw", "draft").alias("status")).agg(F.count("*").alias("n"))


@query("s04_s05_instants", """SELECT event_id, raw, CASE event_id % 4 WHEN 0 THEN epoch_us(ts) // 1000000 WHEN 1 THEN epoch_us(ts) // 1000000 - 7200 END AS seconds, CASE WHEN event_id % 4 = 2 THEN 'bad_instant' END AS problem
 FROM (SELECT event_id, ts, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S+02') WHEN 2 THEN 'soon' ELSE '  ' END AS raw FROM events)""")
def s04(spark, d):
    k, t = F.col("event_id") % 4, F.col("ts")
    raw = F.when(k == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.concat(F.date_format(t, "yyyy-MM-dd HH:mm:ss"), F.lit("+02"))).when(k == 2, "soon").otherwise("  ")
    e = X.table(spark, d, "events").select("event_id", raw.alias("raw"))
    return e.withColumn("seconds", F.unix_seconds(S.instant("raw"))).withColumn("problem", S.instant_problem("raw"))


@query("s06_s07_digests", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN sha256(lang) ELSE sha256(text) END AS digest, doc_id % 3 <> 0 AS agrees
 FROM documents""")
def s06(spark, d):
    t = X.table(spark, d, "documents")
    given = F.when(F.col("doc_id") % 3 == 0, F.upper(F.sha2("lang", 256))).when(F.col("doc_id") % 3 == 1, F.sha2("text", 256)).otherwise("none")
    right = F.when(F.col("doc_id") % 3 == 2, F.sha2("text", 256)).otherwise(given)
    return t.select("doc_id", S.content_digest(given, "text").alias("digest"), S.digest_agrees(right, "text").alias("agrees"))


SNIP = r"""SELECT doc_id, CASE WHEN hit > 0 THEN CASE WHEN st > 0 THEN '…' ELSE '' END || trim(regexp_replace(substr(body, st + 1, 240), '\s+', ' ', 'g')) || CASE WHEN st + 240 < length(body) THEN '…' ELSE '' END
 ELSE trim(regexp_replace(substr(body, 1, 240), '\s+', ' ', 'g')) || CASE WHEN length(body) > 240 THEN '…' ELSE '' END END AS snippet FROM (SELECT *, greatest(hit - 81, 0)::BIGINT AS st FROM (SELECT doc_id, body,
 CASE WHEN strpos(lower(body), 'tion the zzz') > 0 THEN strpos(lower(body), 'tion the zzz') WHEN strpos(lower(body), 'tion') > 0 THEN strpos(lower(body), 'tion') WHEN strpos(lower(body), 'the') > 0 THEN strpos(lower(body), 'the') WHEN strpos(lower(body), 'zzz') > 0 THEN strpos(lower(body), 'zzz') ELSE 0 END AS hit
 FROM (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM documents)))"""


@query("s10_snippet", SNIP)
def s10(spark, d):
    return X.table(spark, d, "documents").select("doc_id", S.snippet(F.substring("text", 1, 100), "text", F.lit("Tion the zzz ")).alias("snippet"))


@query("s11_trigram_similarity", r"""WITH t AS (SELECT event_id, 'report_' || event_type || '.' || (user_id % 7)::VARCHAR || '.md' AS name FROM events), g AS (SELECT DISTINCT name, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda x: x <> ''), lambda w: list_transform(range(1, length('  ' || w || ' ') - 1), lambda i: substr('  ' || w || ' ', i, 3))))) AS a,
 list_distinct(flatten(list_transform(['purchase', 'report'], lambda w: list_transform(range(1, length('  ' || w || ' ') - 1), lambda i: substr('  ' || w || ' ', i, 3))))) AS b FROM t)
SELECT name, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 6) AS similarity FROM g""")
def s11(spark, d):
    name = F.concat(F.lit("report_"), "event_type", F.lit("."), (F.col("user_id") % 7).cast("string"), F.lit(".md"))
    return X.table(spark, d, "events").select(name.alias("name")).distinct().select("name", F.round(S.trigram_similarity("name", F.lit("purchase report")), 6).alias("similarity"))


def _conversations(spark, d):
    e = X.table(spark, d, "events")
    u = F.col("user_id").cast("string")
    group = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("g"), (F.col("user_id") % 10).cast("string"))).otherwise("")
    return e.select("event_id", F.lit("1").alias("bot"), u.alias("user"), group.alias("group")).withColumn("conversation", S.conversation_id("bot", "user", "group"))


@query("s12_s13_conversation_ids", """SELECT event_id, conversation, CASE WHEN event_id % 3 = 0 THEN 'group' ELSE 'private' END AS kind, CASE WHEN event_id % 11 = 0 THEN 'bot_mismatch' WHEN event_id % 13 = 0 AND event_id % 3 = 0 THEN 'group_missing' WHEN event_id % 17 = 0 AND event_id % 3 <> 0 THEN 'user_mismatch' END AS problem FROM
 (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'qq:1:group:g' || (user_id % 10)::VARCHAR ELSE 'qq:1:private:' || user_id::VARCHAR END AS conversation FROM events)""")
def s13(spark, d):
    i = F.col("event_id")
    bot = F.when(i % 11 == 0, "2").otherwise(F.col("bot"))
    group = F.when(i % 13 == 0, "").otherwise(F.col("group"))
    user = F.when(i % 17 == 0, "x").otherwise(F.col("user"))
    return _conversations(spark, d).select("event_id", "conversation", S.conversation_kind("group").alias("kind"), S.conversation_problem("conversation", S.conversation_kind("group"), bot, user, group).alias("problem"))


def uuid_sql(h):
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr({h}, 17, 1))::INT, 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


@query("s14_s15_s16_event_ids", f"SELECT doc_id, {uuid_sql('h')} AS ledger_id, {uuid_sql('p')} AS point_id, sha256('qq:1:private:7:message:' || doc_id::VARCHAR) AS derived FROM (SELECT doc_id, sha256(unhex('{S.LEDGER_NAMESPACE}') || doc_id::VARCHAR::BLOB) AS h, sha256(doc_id::VARCHAR || '#3') AS p FROM documents)")
def s14(spark, d):
    k = F.col("doc_id").cast("string")
    return X.table(spark, d, "documents").select("doc_id", S.ledger_event_id(k).alias("ledger_id"), S.chunk_point_id(k, F.lit(3)).alias("point_id"), S.derived_event_id(F.lit("qq:1:private:7"), "message", k).alias("derived"))


@query("s17_s18_s19_s21_keys", """SELECT doc_id, strlen(lang)::VARCHAR || ':' || lang || strlen(source)::VARCHAR || ':' || source AS storage_key, sha256(strlen(lang)::VARCHAR || ':' || lang || strlen(text)::VARCHAR || ':' || text || CASE doc_id % 3 WHEN 0 THEN '27:authenticated_public:absent' WHEN 1 THEN '25:authenticated_public:true' ELSE '26:authenticated_public:false' END) AS payload, sha256('{"doc_id":' || doc_id::VARCHAR || ',"lang":"' || lang || '"}') AS operation, source || '@' || lang || '#' || lpad((doc_id % 250)::VARCHAR, 3, '0') AS label FROM documents""")
def s17(spark, d):
    t = X.table(spark, d, "documents").withColumn("opt", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 3 == 1))
    return t.select("doc_id", S.storage_key("lang", "source").alias("storage_key"), S.payload_fingerprint("lang", "text", public="opt").alias("payload"), S.operation_fingerprint("doc_id", "lang").alias("operation"), S.chunk_label("source", "lang", F.col("doc_id") % 250).alias("label"))


@query("s20_s30_subject_keys", """SELECT c_custkey, raw, CASE c_custkey % 6 WHEN 2 THEN 'origin' WHEN 3 THEN 'type' WHEN 4 THEN 'bot' WHEN 5 THEN 'shape' END AS problem, CASE WHEN c_custkey % 6 = 0 THEN c_custkey END AS number FROM (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'web:user:' || k WHEN 1 THEN 'qq:user:1/' || k WHEN 2 THEN 'irc:user:' || k WHEN 3 THEN 'web:robot:' || k WHEN 4 THEN 'qq:user:' || k ELSE 'web' || k END AS raw FROM (SELECT c_custkey, c_custkey::VARCHAR AS k FROM customer))""")
def s20(spark, d):
    n, k = F.col("c_custkey") % 6, F.col("c_custkey").cast("string")
    heads = ("web:user:", "qq:user:1/", "irc:user:", "web:robot:", "qq:user:", "web")
    raw = F.concat(F.element_at(F.array(*[F.lit(h) for h in heads]), (n + 1).cast("int")), k)
    return X.table(spark, d, "customer").select("c_custkey", raw.alias("raw")).withColumn("problem", S.subject_problem("raw")).withColumn("number", S.user_number("raw"))


@query("s23_metadata_budget", """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'entries' WHEN doc_id % 5 = 1 THEN 'key_bytes' WHEN doc_id % 5 = 2 THEN 'value_bytes' WHEN doc_id % 5 = 3 THEN 'total_bytes' END AS problem FROM documents""")
def s23(spark, d):
    n = F.col("doc_id") % 5
    many = F.map_from_arrays(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: i.cast("string")), F.array_repeat(F.lit("v"), 9))
    one = lambda k, v: F.create_map(k, v)
    m = F.when(n == 0, many).when(n == 1, one(F.repeat(F.lit("k"), 33), F.lit(""))).when(n == 2, one(F.lit("k"), F.repeat(F.lit("é"), 33))).when(n == 3, F.create_map(F.lit("a"), F.repeat(F.lit("x"), 40), F.lit("b"), F.repeat(F.lit("y"), 40))).otherwise(one(F.lit("lang"), F.col("lang")))
    return X.table(spark, d, "documents").select("doc_id", S.metadata_problem(m).alias("problem"))


@query("s24_s25_vector_math", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings) SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 4) AS norm, round(list_dot_product(v, (SELECT v FROM e WHERE vec_id = 0)), 4) AS dot FROM e""")
def s24(spark, d):
    e = X.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    q = e.where("vec_id = 0").select(F.col("v").alias("q"))
    unit = V.l2("v")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return e.crossJoin(q).select("vec_id", F.round(norm, 4).alias("norm"), F.round(V.dot(unit, "q") * norm, 4).alias("dot"))


@query("s26_fnv", """WITH w AS (SELECT DISTINCT lang || source AS w FROM documents) SELECT w, list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(w, ''), lambda x: ascii(x)::HUGEINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295)::BIGINT AS h32,
 (list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split(w, ''), lambda x: ascii(x)::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) & 18446744073709551615::HUGEINT) >> 32)::BIGINT AS hi FROM w""")
def s26(spark, d):
    w = X.table(spark, d, "documents").select(F.concat("lang", "source").alias("w")).distinct()
    return w.select("w", V.fnv32("w").alias("h32"), V.fnv64("w")["hi"].alias("hi"))


@query("s27_validators", """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'blank' WHEN doc_id % 4 = 1 THEN 'too_long' WHEN doc_id % 4 = 2 THEN 'character' END AS id_problem, CASE WHEN doc_id % 3 = 0 THEN 'blank' WHEN doc_id % 3 = 1 AND length(trim(text)) > 255 THEN 'too_long' END AS title, CASE doc_id % 3 WHEN 0 THEN 'member' WHEN 1 THEN 'owner' END AS role, CASE doc_id % 3 WHEN 0 THEN 'markdown' WHEN 1 THEN 'docx' END AS format FROM documents""")
def s27(spark, d):
    i = F.col("doc_id")
    pick = lambda *v: F.element_at(F.array(*[x if not isinstance(x, str) else F.lit(x) for x in v]), (i % len(v) + 1).cast("int"))
    return X.table(spark, d, "documents").select("doc_id", S.identifier_problem(pick(" ", "x" * 65, "a b", "ok")).alias("id_problem"), S.title_problem(pick("", F.col("text"), "fine")).alias("title"), S.role(pick("", " OWNER", "guest")).alias("role"), S.content_format(pick("", "DOCX", "pdf")).alias("format"))


@query("s28_s29_event_validation", """SELECT problem, profile, count(*) AS n FROM (SELECT CASE WHEN event_type = 'click' THEN 'kind' WHEN event_id % 7 = 0 THEN 'document_id' WHEN event_id % 11 = 0 THEN 'event_id' WHEN event_id % 13 = 0 THEN 'sequence' WHEN event_type <> 'error' AND event_id % 17 = 0 THEN 'version_id' END AS problem, CASE WHEN event_id % 2 = 0 THEN 'markdown-v1' ELSE 'p' || (event_id % 3)::VARCHAR END AS profile FROM events) GROUP BY ALL""")
def s28(spark, d):
    i, t = F.col("event_id"), F.col("event_type")
    s = i.cast("string")
    kind = F.when(t == "click", "move").when(t == "error", " DELETE").otherwise("upsert")
    p = S.event_problem(kind, F.when(i % 7 == 0, " ").otherwise(s), F.when(i % 11 == 0, F.lit(None)).otherwise(s), F.when(i % 13 == 0, 0).otherwise(i + 1), F.when(i % 17 == 0, "").otherwise(s), F.lit("s"))
    profile = S.index_profile(F.when(i % 2 == 1, F.concat(F.lit("p"), (i % 3).cast("string"))).otherwise(" "), F.lit(""))
    return X.table(spark, d, "events").groupBy(p.alias("problem"), profile.alias("profile")).agg(F.count("*").alias("n"))


@query("t01_tokenize", r"SELECT doc_id, len(t) AS n, t[1] AS first, t[-1] AS last, sha256(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(lower(text), '\p{Han}|[\p{L}\p{Nd}]+') AS t FROM documents)")
def t01(spark, d):
    t = X.table(spark, d, "documents").select("doc_id", V.tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n"), F.try_element_at("t", F.lit(1)).alias("first"), F.try_element_at("t", F.lit(-1)).alias("last"), F.sha2(F.array_join("t", " "), 256).alias("digest"))


@query("u01_u05_id_sets", """SELECT doc_id, list_sort(list_distinct(list_filter([lower(trim(x)) FOR x IN [' ' || upper(lang), source, '', lang]], lambda x: x <> ''))) AS ids, list_sort([x FOR x IN [lang, 'en', 'fr'] IF x IN ('fr', 'en', 'zz')]) AS common, [x FOR x IN [lang, source] IF x <> 'en'] AS without, list_sort(list_distinct([lang, source, 'en'])) AS joined, lang IN ('en', 'de') AS within, (SELECT 1) = 2 AS overlap FROM documents""")
def u01(spark, d):
    a = lambda *x: F.array(*[F.col(v) if v in ("lang", "source") else F.lit(v) for v in x])
    return X.table(spark, d, "documents").select(
        "doc_id",
        S.canonical_ids(F.array(F.concat(F.lit(" "), F.upper("lang")), "source", F.lit(""), "lang")).alias("ids"),
        F.array_sort(F.filter(a("lang", "en", "fr"), lambda x: x.isin("fr", "en", "zz"))).alias("common"),
        F.array_remove(a("lang", "source"), "en").alias("without"),
        F.array_sort(F.array_union(a("lang", "source"), a("en"))).alias("joined"),
        S.contains_all(a("en", "de"), F.array("lang")).alias("within"),
        F.arrays_overlap(a("lang"), a("source")).alias("overlap"),
    )


@query("f01_f02_f03_scoped_index", f"WITH {X.IX} SELECT document_id, title, owner_space_id FROM ix WHERE lifecycle = 'active' AND publication = 'published' AND ((FALSE AND is_public) OR document_id IN (22, 35) OR owner_space_id IN ('fr') OR list_has_any(allowed, ['fr'])) AND owner_subject_key = 'src3'")
def f01(spark, d):
    return X.index(spark, d).where(scope.live() & scope.in_scope(["fr"], ["22", "35"]) & scope.owned_by(F.lit("src3"))).select("document_id", "title", "owner_space_id")


@query("f04_f05_f06_effective_scope", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ['en'] ELSE list_sort(list_distinct([lang, source, 'team'])) END AS ids, doc_id % 3 <> 0 AS floor, doc_id % 3 <> 0 OR lang = 'en' AS allowed FROM documents")
def f04(spark, d):
    t = X.table(spark, d, "documents")
    asked = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("en"))).otherwise(F.array().cast("array<string>"))
    granted = scope.granted_spaces(F.array("lang"), F.array("source"), F.array(F.lit("team"), F.col("lang")))
    ids, floor = scope.effective_scope(asked, granted)
    return t.select("doc_id", F.array_sort(ids).alias("ids"), floor.alias("floor"), S.contains_all(granted, asked).alias("allowed"))


@query("f08_vector_scope", f"WITH {X.IX} SELECT document_id FROM ix WHERE lifecycle = 'active' AND (is_public OR document_id IN (22) OR owner_space_id IN ('es') OR list_has_any(allowed, ['es']))")
def f08(spark, d):
    return X.index(spark, d).where((F.col("lifecycle") == "active") & scope.in_scope(["es"], ["22"], public=True)).select("document_id")


@query("f11_f12_channel_scope", "SELECT message_id, from_id FROM (SELECT turn::BIGINT AS message_id, role AS from_id, conv_id FROM conversations) WHERE conv_id IN (1, 2, 3) AND from_id IN ('user')")
def f11(spark, d):
    c = X.chat(spark, d).withColumn("conversation", F.col("to_id").cast("string"))
    ids = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    families = {"conversation": scope.narrow(ids("1", "2", "3", "4"), ids("1", "2", "3")), "from_id": ids("user"), "group_type": ids()}
    return c.where(scope.in_channel(families)).select("message_id", "from_id")


@query("f13_f24_state_lookup", f"WITH {X.IX}, q AS (SELECT unnest(range(0, 2000, 37)) AS document_id) SELECT q.document_id, ix.document_id IS NOT NULL AS found, CASE WHEN ix.document_id IS NULL THEN 'absent' WHEN publication = 'published' THEN 'active' ELSE 'indexed' END AS state FROM q LEFT JOIN (SELECT * FROM ix WHERE owner_space_id = 'en') ix USING (document_id)")
def f13(spark, d):
    ids = spark.range(0, 2000, 37).withColumnRenamed("id", "document_id")
    inside = X.index(spark, d).where(scope.in_scope(["en"]) & (F.col("owner_space_id") == "en")).select("document_id", "publication")
    j = ids.join(inside, "document_id", "left")
    return j.select("document_id", F.col("publication").isNotNull().alias("found"), F.when(F.col("publication").isNull(), "absent").when(F.col("publication") == "published", "active").otherwise("indexed").alias("state"))


@query("f17_f18_like_escape", r"SELECT doc_id, replace(replace(replace(raw, '\', '\\'), '%', '\%'), '_', '\_') AS pattern, contains(lower(text), raw) AS hit FROM (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN '%%%' ELSE 'th_' END AS raw FROM documents)")
def f17(spark, d):
    raw = F.when(F.col("doc_id") % 2 == 0, "%%%").otherwise("th_")
    t = X.table(spark, d, "documents").select("doc_id", "text", S.escape_like(raw).alias("pattern"))
    return t.select("doc_id", "pattern", F.expr(r"text ilike concat('%', pattern, '%')").alias("hit"))


@query("f22_review_queue", "SELECT doc_id, 'pending' AS status FROM labels WHERE quality <> 1 AND toxic <> 1 ORDER BY doc_id LIMIT 20 OFFSET 5")
def f22(spark, d):
    t = X.table(spark, d, "labels")
    status = F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "approved").otherwise("pending")
    return t.select("doc_id", status.alias("status")).where(F.col("status") == F.coalesce(F.lit(None), F.lit("pending"))).orderBy("doc_id").offset(5).limit(20)
