"""Queries of ingest: inbound transcripts and Markdown documents (IO, T-10, X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import LEDGER_NAMESPACE
from tidemark.plans import fixtures as X
from tidemark.plans.registry import query
from tidemark.plans.scalars import uuid_sql
from tidemark.sources import files, logs


@query("io06_io07_inbound_events", f"""WITH e AS (SELECT conv_id, '1' AS bot_id, CASE WHEN turn % 4 = 3 THEN '' ELSE role END AS user_id, turn::VARCHAR AS message_id, text, CASE WHEN conv_id % 3 = 0 THEN 'g' || (conv_id % 10)::VARCHAR END AS group_id, FALSE AS mentioned FROM conversations
 UNION ALL SELECT conv_id, '1', 'bot', 'r' || turn::VARCHAR, 'ok', CASE WHEN conv_id % 3 = 0 THEN 'g' || (conv_id % 10)::VARCHAR END, TRUE FROM conversations),
k AS (SELECT *, CASE WHEN group_id IS NULL THEN 'private' ELSE 'group' END AS conversation_kind, 'qq:1:' || CASE WHEN group_id IS NULL THEN 'private:' || user_id ELSE 'group:' || group_id END AS conversation_id FROM e),
i AS (SELECT *, sha256(conversation_id || ':message:' || message_id) AS event_id FROM k), h AS (SELECT *, sha256(unhex('{LEDGER_NAMESPACE}') || event_id::BLOB) AS h FROM i)
SELECT bot_id, user_id, message_id, text, group_id, mentioned, conversation_id, conversation_kind, event_id, {uuid_sql('h')} AS ledger_id, CASE WHEN group_id IS NULL AND user_id = '' THEN 'shape' END AS problem FROM h""")
def io06(spark, d):
    """A transcript for each message, with the bot's answer; private messages without a user are rejected."""
    group = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("g"), (F.col("conv_id") % 10).cast("string")))
    turn = F.col("turn").cast("string")

    def event(user, message, text, mentioned):
        return F.struct(F.lit("1").alias("bot_id"), user.alias("user_id"), message.alias("message_id"), text.alias("text"), group.alias("group_id"), F.lit(mentioned).alias("mentioned"))

    said = event(F.when(F.col("turn") % 4 == 3, "").otherwise(F.col("role")), turn, F.col("text"), False)
    answer = event(F.lit("bot"), F.concat(F.lit("r"), turn), F.lit("ok"), True)
    return logs.flatten_inbound(X.table(spark, d, "conversations").select(F.array(said, answer).alias("events")))


MARKDOWN = r"""md AS (SELECT doc_id::VARCHAR AS document_id, coalesce(lang, 'none') AS l, coalesce(source, 'none') AS s, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 \n]', '', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ps FROM documents),
bk AS (SELECT document_id, [{'k': 'heading', 's': l, 't': l}, {'k': 'heading', 's': l || ' / ' || s, 't': s}, {'k': 'list', 's': l || ' / ' || s, 't': 'item ' || document_id}] || list_transform(ps, lambda p: {'k': 'paragraph', 's': l || ' / ' || s, 't': p}) || [{'k': 'code', 's': l || ' / ' || s, 't': '  x = ' || document_id}] AS b, l FROM md)"""


def markdown(spark, d):
    """Each document as a Markdown file: front matter, two headings, a list item, its lines as paragraphs, and code."""
    t = X.table(spark, d, "documents")
    k, none = F.col("doc_id").cast("string"), F.lit("none")
    lines = F.replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^A-Za-z0-9 \n]", ""), F.lit("\n"), F.lit("\n\n"))
    content = F.concat(F.lit("---\nid: 1\n---\n# "), F.coalesce("lang", none), F.lit("\n## "), F.coalesce("source", none), F.lit(" ##\n* **item** ["), k, F.lit("](http://x/y)\n"), lines, F.lit("\n```\n  x = "), k, F.lit("\n```\n"))
    return t.select(F.concat(F.lit("corpus/"), k, F.lit(".md")).alias("path"), content.alias("content"))


@query("t10_markdown_blocks", f"WITH {MARKDOWN} SELECT document_id, (i - 1)::INT AS position, b[i].k AS kind, b[i].s AS section, sha256(b[i].t) AS digest FROM (SELECT document_id, b, unnest(range(1, len(b) + 1)) AS i FROM bk)")
def t10(spark, d):
    return files.markdown_blocks(markdown(spark, d)).select("document_id", "position", "kind", "section", F.sha2("text", 256).alias("digest"))


@query("io10_assembled_documents", f"WITH {MARKDOWN} SELECT document_id, CASE WHEN document_id::BIGINT % 3 = 0 THEN 'Given ' || document_id ELSE l END AS title, sha256(array_to_string(list_transform(b, lambda x: x.t), chr(10) || chr(10))) AS digest FROM bk")
def io10(spark, d):
    """Every third document has a title of its own, or a blank one that does not count."""
    k = F.col("doc_id")
    titles = X.table(spark, d, "documents").select(k.cast("string").alias("document_id"), F.when(k % 3 == 0, F.concat(F.lit("Given "), k.cast("string"))).otherwise("").alias("given"))
    return files.assemble_documents(files.markdown_blocks(markdown(spark, d)), titles).select("document_id", "title", F.sha2("content", 256).alias("digest"))
