"""Contract tables, properties and sources; the driver's SQL oracle covers the registered queries."""

import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions import vectors as V
from tidemark.operators import chunking as C
from tidemark.operators import events as EV
from tidemark.operators import evaluate as E
from tidemark.operators import lifecycle as L
from tidemark.operators import retrieval as R
from tidemark.sources import files, logs
from tidemark.streaming import apply as A

EVENT = "sequence long, event_id string, kind string, document_id long, aggregate_revision long, access_revision long, lifecycle_revision long, content string"


def events(n, seed, documents=4):
    r = random.Random(seed)
    return [(k + 1, str(k), r.choice(["upsert", "upsert", "delete"]), r.randrange(documents), r.randrange(6), r.randrange(4), r.randrange(4), "c") for k in range(n)]


def sequential(rows):
    """The fold, one event at a time."""
    state, tomb, out = {}, {}, {}
    for seq, _, kind, doc, agg, acc, life, _ in sorted(rows):
        row, t = state.get(doc), tomb.get(doc)
        if t and t[2] >= life:
            o = "stale_lifecycle"
        elif not row:
            o = "applied"
        elif kind == "delete" and 0 < agg < row[0] or kind == "upsert" and agg < row[0]:
            o = "stale_revision"
        elif kind == "upsert" and acc < row[1]:
            o = "stale_access"
        elif life < row[2]:
            o = "stale_lifecycle"
        else:
            o = "applied"
        if o == "applied" and kind == "upsert":
            state[doc] = (agg, acc, life)
            tomb.pop(doc, None)
        elif o == "applied":
            state.pop(doc, None)
            tomb[doc] = tuple(map(max, (agg, acc, life), t or (0, 0, 0)))
        out[seq] = o
    return state, tomb, out


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_equals_sequential_application(spark, seed):
    rows = events(200, seed)
    random.Random(seed).shuffle(shuffled := list(rows))  # physical order never matters
    state, tombs, outcomes = EV.apply_document_events(spark.createDataFrame(shuffled, EVENT).repartition(3))
    want = sequential(rows)
    assert {r[0]: tuple(r[2:]) for r in state.collect()} == want[0]
    assert {r[0]: tuple(r[1:]) for r in tombs.collect()} == want[1]
    assert {r["sequence"]: r["outcome"] for r in outcomes.collect()} == want[2]


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    rows = events(120, 5)
    for k in (0, 60):
        spark.createDataFrame(rows[k : k + 60], EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        stream = A.apply_document_events(logs.log_stream(spark, str(tmp_path / "log"), 1))
        A.run_available(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    got = {r["sequence"]: r["outcome"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == sequential(rows)[2]


def test_record_events_table(spark):
    rows = [(1, 1, 3, "c1", False, "a"), (2, 1, 2, "c1", False, "b"), (3, 1, 3, "c1", False, "a"), (4, 1, 3, "c1", False, "z"), (5, 1, 4, "c2", False, "a"), (6, 1, 4, "c1", True, None), (7, 1, 4, "c1", True, None), (8, 1, 4, "c1", False, "a"), (9, 1, 5, "c1", False, "n")]
    d = EV.decide_record_events(spark.createDataFrame(rows, "arrival long, record_id long, revision long, conversation_id string, recall boolean, payload string"))
    assert [r["decision"] for r in d.orderBy("arrival").collect()] == ["apply", "stale_revision", "duplicate_revision", "conflict", "conflict", "apply", "duplicate_revision", "conflict", "apply"]
    assert EV.record_state(d).collect()[0].asDict() == {"record_id": 1, "revision": 5, "conversation_id": "c1", "recalled": False, "payload": "n"}


def test_lifecycle_rejections(spark):
    rows = [(1, 1, "publish", 7, False, 0), (1, 2, "access", 0, False, 0), (1, 3, "access", 0, True, 9), (1, 4, "archive", 0, False, 2), (1, 5, "publish", 8, False, 0), (1, 6, "trash", 0, False, 0), (1, 7, "trash", 0, False, 0)]
    r = L.reduce_documents(spark.createDataFrame(rows, "document_id long, seq long, op string, version long, flag boolean, expected long")).orderBy("seq").collect()
    assert [o["result"] for o in r[1:]] == ["applied", "unchanged", "revision_conflict", "applied", "precondition", "applied", "precondition"]
    assert (r[0]["status"], r[0]["active"], r[0]["agg"], r[0]["act"], r[0]["life"]) == ("trashed", 7, 4, 1, 3)


def test_combined_saves(spark):
    """A replay reports the first attempt's version and the present revisions; a refused save leaves nothing."""
    rows = [(1, 1, "a", "me", "x", None, 0), (1, 2, "b", "me", "y", True, 3), (1, 3, "a", "me", "x", None, 9), (1, 4, "a", "me", "z", None, 0), (1, 5, "c", "you", "x", None, 0), (1, 6, "d", "me", "x", True, 9), (1, 7, "d", "me", "x", True, 0), (1, 8, "", "me", "x", False, 0), (1, 9, "", "me", "x", False, 0), (2, 1, "a", "me", "x", None, 0), (3, 1, "a", "me", "x", None, 0)]
    c = spark.createDataFrame(rows, "document_id long, seq long, request_id string, subject_key string, content string, public boolean, expected long").withColumns({"title": F.lit("t"), "format": F.lit("plain")})
    docs = spark.createDataFrame([(1, "me", "active", 1, 0, 1, 0), (2, "me", "trashed", 1, 0, 1, 0)], "document_id long, owner_subject_key string, status string, aggregate long, activation long, access long, latest long")
    got = [tuple(r)[2:] for r in L.save_documents(c, docs).orderBy("document_id", "seq").collect()]
    no = (None,) * 5
    assert got == [("applied", 1, 3, 1, 1, False), ("applied", 2, 6, 2, 2, True), ("replayed", 1, 6, 2, 2, True), ("conflict", *no), ("not_owner", *no), ("revision_conflict", *no), ("applied", 3, 8, 3, 2, True), ("applied", 4, 11, 4, 3, False), ("applied", 5, 13, 5, 3, False), ("precondition", *no), ("not_found", *no)]


def test_tokens_and_embedding(spark):
    d = spark.createDataFrame([("Ab 12,漢字x É",), ("",), (None,)], "t string")
    assert [r[0] for r in d.select(V.tokens("t")).collect()] == [["ab", "12", "漢", "字", "x", "é"], [], []]
    rows = d.select(V.embed("t").alias("a"), V.embed_fast("t").alias("b")).collect()
    assert rows[0]["a"] == pytest.approx(rows[0]["b"]) and sum(x * x for x in rows[0]["a"]) == pytest.approx(1)
    assert rows[1]["a"] == [0.0] * 64
    h = spark.range(1).select(V.fnv64(F.lit("foobar")).alias("h"), V.fnv32(F.lit("foobar")).alias("s")).first()
    assert (h["h"]["hi"] << 32 | h["h"]["lo"], h["s"]) == (0x85944171F73967E8, 0xBF9CF968)  # published test values


def test_tokens_of_every_character(spark):
    """As the plain definition has them, for each code point between and beside other characters."""
    d = spark.range(1, 0x110000).where("id < 55296 or id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    plain = lambda x: F.regexp_extract_all(F.lower(x), F.lit(r"\p{IsHan}|[\p{L}\p{Nd}&&[^\p{IsHan}]]+"), F.lit(0))
    x = F.concat(F.lit("a"), "c", F.lit("é漢"), "c", "c", F.lit("1 "), "c", F.lit("ж"), "c")
    assert d.select(x.alias("x")).where(~plain(F.col("x")).eqNullSafe(V.tokens("x"))).count() == 0 and d.count() == 0x110000 - 2049


def test_snippet_and_similarity(spark):
    d = spark.createDataFrame([("s", "x" * 100 + " Needle " + "y" * 400, "needle"), ("only  summary", " ", "q"), ("", "", "q")], "summary string, content string, q string")
    got = [r[0] for r in d.select(S.snippet("summary", "content", "q")).collect()]
    assert got[0].startswith("…") and "Needle" in got[0] and got[0].endswith("…") and got[1:] == ["only summary", ""]


def test_snippet_reads_a_text_once(spark):
    """The plan strips and lower-cases a text once, and the results are those of the definition."""

    line = lambda x: re.sub(f"[{S.SPACES}]+", " ", x).strip(" ")

    def model(summary, content, query, n=S.SNIPPET):
        body = content.strip(S.SPACES) or summary.strip(S.SPACES)
        low, need = body.lower(), query.strip(S.SPACES).lower()
        at = low.find(need) if need else -1
        if at < 0:
            at = next((low.find(w) for w in need.split() if len(w) >= 2 and w in low), -1)
        if at < 0 or len(low) != len(body):
            return line(body[:n]) + ("…" if len(body) > n else "")
        start = max(at - n // 3, 0)
        return ("…" if start else "") + line(body[start : start + n]) + ("…" if start + n < len(body) else "")

    r = random.Random(8)
    words = ["one", "Two", "x", "ÉTÉ", "İ", "中文", "needle", " ", "\n\t", "a" * 90]
    text = lambda: " ".join(r.choice(words) for _ in range(r.choice([0, 1, 5, 60])))
    rows = [(text(), text(), r.choice(["Needle", " x two", "", "zz été  needle", "İ", "zz"])) for _ in range(300)] + [("s", "end \u2028", "end"), ("s", "\x0b\f", "q")]
    d = spark.createDataFrame(rows, "summary string, content string, q string").select(S.snippet("summary", "content", "q").alias("s"))
    assert [x.s for x in d.collect()] == [model(*x) for x in rows]
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") <= 2 and plan.count("content#") <= 2


def test_pages_join_up(spark):
    fused = spark.createDataFrame([(0, k, 1.0 / k) for k in range(1, 8)], "query_id int, document_id int, fused double")
    keyword = spark.createDataFrame([(0, k, float(k)) for k in range(5, 16)], "query_id int, document_id int, score double")
    whole = [r["document_id"] for r in R.fused_page(fused, keyword, 0, 100).orderBy("position").collect()]
    assert len(whole) == len(set(whole)) == 15
    parts = [r["document_id"] for o in range(0, 15, 4) for r in R.fused_page(fused, keyword, o, 4).orderBy("position").collect()]
    assert parts == whole


def test_published_metric_value(spark):
    found = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (0, "c", 3)], "query_id int, document_id string, rank int")
    r = E.per_query(found, spark.createDataFrame([(0, "c")], "query_id int, document_id string"), 5).collect()[0]
    assert (r["recall"], r["mrr"], r["ndcg"]) == (1.0, pytest.approx(0.333333), 0.5)


def test_chunks_pack_and_cut(spark):
    text = "a" * 300 + "\n\n" + "b" * 450 + "\n\n" + "c" * 1700 + "\n\n \n\nd"
    d = spark.createDataFrame([(1, text), (2, " "), (3, None)], "document_id int, content string")
    rows = C.chunk_paragraphs(d).orderBy("document_id", "position").collect()
    assert [(r["position"], len(r["chunk"])) for r in rows] == [(0, 752), (1, 800), (2, 800), (3, 103)]
    assert [len(x) for x in d.select(C.windows("content")).where("document_id = 1").first()[0]][:2] == [180, 180]


def test_files(spark, tmp_path):
    (tmp_path / "guide.md").write_text("---\na: b\n---\n# Top\nSome *text*\nmore\n## Sub\n- item [x](y)\n> quote\n```\ncode  here\n```\n")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    with zipfile.ZipFile(tmp_path / "memo.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{p("Head", "Heading1")}{p("Body")}<w:tbl><w:tr><w:tc>{p("a")}</w:tc><w:tc>{p("b")}</w:tc></w:tr></w:tbl></w:body></w:document>')
    b = files.read_blocks(spark, str(tmp_path)).orderBy("document_id", "position").collect()
    assert [(r["kind"], r["section"], r["text"]) for r in b if r["document_id"] == "guide"] == [("heading", "Top", "Top"), ("paragraph", "Top", "Some text more"), ("heading", "Top / Sub", "Sub"), ("list", "Top / Sub", "item x"), ("paragraph", "Top / Sub", "quote"), ("code", "Top / Sub", "code  here")]
    assert [(r["kind"], r["text"]) for r in b if r["document_id"] == "memo"] == [("heading", "Head"), ("paragraph", "Body"), ("table", "a | b")]
    t = {r["document_id"]: r["title"] for r in files.assemble_documents(files.read_blocks(spark, str(tmp_path))).collect()}
    assert t == {"guide": "Top", "memo": "Head"}


def test_inbound(spark, tmp_path):
    (tmp_path / "in.json").write_text('{"comment": "c", "events": [{"bot_id": "1", "user_id": "u", "message_id": "m1", "text": "t", "group_id": null, "mentioned": false}, {"bot_id": "1", "user_id": "u", "message_id": "m2", "text": "t", "group_id": "g", "mentioned": true}]}')
    r = logs.ingest_inbound(spark, str(tmp_path / "in.json")).collect()
    assert [x["conversation_id"] for x in r] == ["qq:1:private:u", "qq:1:group:g"] and all(x["problem"] is None for x in r) and r[0]["ledger_id"][14] == "5"


def test_registered_queries_have_names_and_sql():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 90


def test_document_vectors_cover_whole_texts(spark, tmp_path):
    from tidemark.functions import vectors as V
    from tidemark.plans import search

    first, later, tail = "a " * 300, "bee " * 150, "cat. dog " * 100
    rows = [(0, "\n".join([first, later, tail])), (1, "short. text"), (2, None)]
    spark.createDataFrame([(k, t, "en", "s") for k, t in rows], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["document_id"], r["position"]): r["vector"] for r in search.t13(spark, str(tmp_path)).collect()}
    texts = {(0, 0): "\n".join([first[:40], first[:100], first.strip()]), (0, 1): later.strip(), (0, 2): tail.strip()[:800], (0, 3): tail.strip()[800:], (1, 0): "\n".join([rows[1][1]] * 3)}
    want = spark.createDataFrame([(*k, t) for k, t in texts.items()], "d long, p int, t string").select("d", "p", V.embed("t").alias("v"))
    assert got == {(r["d"], r["p"]): [round(x, 6) for x in r["v"]] for r in want.collect()}
    whole = {r["doc_id"]: r for r in search.t12(spark, str(tmp_path)).collect()}
    text = spark.createDataFrame([(rows[0][1],)], "t string").select(V.embed("t").alias("v")).first()["v"]
    assert whole[0]["vector"] == [round(x, 6) for x in text] and whole[0]["same"] == 1


def _commands(spark, columns, types, rows):
    full = [{**dict.fromkeys(columns), "operation_id": f"op{n}", "seq": n, **r} for n, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[c] for c in columns) for r in full], ", ".join(f"{c} {t}" for c, t in zip(columns, types, strict=True))).repartition(3)


def test_versioned_corpus_fold(spark):
    from tidemark.operators import corpus as V

    def one(kind, version=None, life=0, rev=0, **more):
        return {"document_id": 1, "kind": kind, "version_id": version, "owner_space": "s", "digest": f"d{version}", "lifecycle": life, "revision": rev, "is_public": False, "spaces": []} | more

    rows = [
        (one("index", "a", 1), "indexed"),
        (one("index", "a", 1, operation_id="op0"), "replayed_indexed"),
        (one("index", "b", 1, operation_id="op0"), "conflict"),
        (one("index", "a", 2), "unchanged"),
        (one("index", "a", 2, digest="other"), "conflict"),
        (one("index", "b", 2, owner_space="t"), "conflict"),
        (one("index", "b", 1), "stale_lifecycle"),
        (one("activate", "c", 2, 5), "not_found"),
        (one("activate", "a", 2, 5), "activated"),
        (one("activate", "a", 2, 4), "stale_activation"),
        (one("activate", "a", 2, 5), "unchanged"),
        (one("index", "b", 2), "indexed"),
        (one("activate", "b", 2, 5), "conflict"),
        (one("activate", "b", 2, 6, expected_version="x"), "conflict"),
        (one("activate", "b", 2, 6, expected_version="a"), "activated"),
        (one("share", None, 2, 3, is_public=True, spaces=["y", " x", "y"]), "shared"),
        (one("share", None, 2, 3, is_public=True, spaces=["x", "y"]), "unchanged"),
        (one("share", None, 2, 3, spaces=["x"]), "conflict"),
        (one("share", None, 2, 2, spaces=["x"]), "stale_access"),
        (one("drop", "b", 2), "dropped_active"),
        (one("drop", "b", 2), "dropped_active"),
        (one("drop", "z", 3), "absent"),
        (one("delete", None, 3), "conflict"),
        (one("delete", None, 2), "stale_lifecycle"),
        (one("delete", None, 4), "deleted"),
        (one("index", "c", 4), "stale_lifecycle"),
        (one("index", "c", 5), "indexed"),
        (one("activate", "c", 5, 7), "activated"),
        (one("delete", None, 4), "deleted"),
        ({**one("index", "q", 1), "document_id": 2}, "indexed"),
    ]
    types = ["long", "long", "string", "string", "string", "string", "string", "long", "long", "string", "boolean", "array<string>"]
    got = V.apply_corpus_commands(_commands(spark, V.COMMANDS, types, [r for r, _ in rows])).collect()
    assert [r["outcome"] for r in sorted((r for r in got if r["seq"] is not None), key=lambda r: r["seq"])] == [x for _, x in rows]
    state = {(r["document_id"], r["version_id"]): r for r in got if r["seq"] is None}
    assert set(state) == {(1, None), (1, "c"), (2, None), (2, "q")}
    r = state[1, "c"]
    assert (r["is_active"], r["activation"], r["access"], r["lifecycle"], r["tombstone"], r["dead"], r["is_public"], r["spaces"]) == (True, 7, 3, 5, 4, False, True, ["x", "y"])
    assert V.apply_corpus_commands(_commands(spark, V.COMMANDS, types, [])).count() == 0


def test_chat_corpus_fold(spark):
    from tidemark.operators import corpus as V

    def one(kind, ids=(), life=0, rev=0, **more):
        return {"conversation_id": 1, "kind": kind, "message_ids": list(ids), "digests": [f"d{x}" for x in ids], "owner_scope": "s", "lifecycle": life, "revision": rev, "scopes": []} | more

    rows = [
        (one("archive", (), 1, 1), "not_found"),
        (one("index", "ab", 1), "indexed"),
        (one("index", "aa", 1), "invalid"),
        (one("index", "bc", 1), "indexed"),
        (one("index", "cd", 1, digests=["x", "dd"]), "conflict"),
        (one("index", "e", 1, owner_scope="t"), "conflict"),
        (one("archive", (), 1, 2), "archived"),
        (one("archive", (), 1, 1), "stale_archive"),
        (one("share", (), 1, 2, scopes=["q", "p"]), "shared"),
        (one("share", (), 1, 2, scopes=["q"]), "conflict"),
        (one("share", (), 1, 1, scopes=["q"]), "stale_access"),
        (one("retract", "a", 2, 3), "retracted"),
        (one("retract", "a", 2, 2), "stale_retract"),
        (one("retract", "z", 2, 2), "not_found"),
        (one("retract", "b", 1, 2), "stale_lifecycle"),
        (one("delete", (), 2), "conflict"),
        (one("delete", (), 3), "deleted"),
        (one("delete", (), 3), "deleted"),
        (one("index", "a", 3), "stale_lifecycle"),
        (one("index", "a", 4), "indexed"),
        (one("delete", (), 3), "stale_lifecycle"),
        (one("archive", (), 4, 5), "archived"),
    ]
    types = ["long", "long", "string", "string", "array<string>", "array<string>", "string", "long", "long", "array<string>"]
    got = V.apply_chat_commands(_commands(spark, V.CHAT_COMMANDS, types, [r for r, _ in rows])).collect()
    assert [r["outcome"] for r in sorted((r for r in got if r["seq"] is not None), key=lambda r: r["seq"])] == [x for _, x in rows]
    state = {r["message_id"]: r for r in got if r["seq"] is None}
    assert set(state) == {None, "a"} and not state["a"]["retracted"]
    assert (state["a"]["archived"], state["a"]["archive"], state["a"]["access"], state["a"]["lifecycle"], state["a"]["tombstone"], state["a"]["dead"], state["a"]["scopes"]) == (True, 5, 2, 4, 3, False, ["p", "q"])


def test_search_total_counts_matches_beyond_the_window(spark):
    """50 matches and a window of 10: the page is full, the total exact, and pages neither skip nor repeat."""
    from tidemark.operators import retrieval as R

    ix = spark.createDataFrame([(k, "t", "s", "found " + "x " * k) for k in range(50)], "document_id long, title string, summary string, content string")
    points = spark.createDataFrame([(k, 0, [1.0, k / 10]) for k in range(45, 50)], "document_id long, position int, vector array<double>")
    pages = [R.search_documents(ix, points, "found", [1.0, 0.0], F.lit(True), offset=o, limit=10, window=10).collect() for o in (0, 8, 18, 28, 38, 48)]
    assert [len(p) for p in pages] == [10, 10, 10, 10, 10, 2] and {r["total"] for p in pages for r in p} == {50}
    assert [p[0]["truncated"] for p in pages] == [True, True, True, True, True, False]
    assert sorted({r["document_id"] for p in pages for r in p}) == list(range(50))


def test_windows_percentiles_profiles(spark):
    from tidemark.functions import vectors as V
    from tidemark.operators import chunking as C
    from tidemark.operators import evaluate as E

    texts = ["", "  ", "a", "x" * 180, "x" * 181, "äb\n" * 200, "\U0001f600y " * 150, None]
    d = spark.createDataFrame(list(enumerate(texts)), "document_id long, content string")
    got = {r["document_id"]: r["w"] for r in d.select("document_id", C.windows("content").alias("w")).collect()}
    for k, t in enumerate(texts):
        x = (t or "").strip()
        n = max(0, -(-(len(x) - 180) // 160)) + 1 if x else 0
        assert (got[k] or []) == [x[i * 160 : i * 160 + 180] for i in range(n)], k
    samples = [("a", v / 7) for v in [3, 1, 2, 2, 2, 9, 100, 45]] + [("b", 5.0)] + [("c", None)]
    rows = {r["k"]: r for r in E.latency(spark.createDataFrame(samples, "k string, latency double"), "k", 1.0).collect()}
    v = sorted(x for k, x in samples if k == "a")
    assert (rows["a"]["n"], rows["a"]["p50"], rows["a"]["p95"], rows["b"]["p95"], rows["c"]["n"], rows["c"]["p50"]) == (8, v[3], v[7], 5.0, 0, None)
    with pytest.raises(ValueError):
        V.embed_with("other", "text")
    assert len(spark.range(1).select(V.embed_with("local-hash-v1", F.lit("a b")).alias("v")).first()["v"]) > 0


def test_payload_fingerprint_bytes(spark):
    import hashlib

    rows = [("d1", "tïtle", "text", "md", None), ("d1", "", "text", "md", True), ("d1", "t", "", "md", False)]
    d = spark.createDataFrame(rows, "a string, b string, c string, d string, p boolean")
    got = [r["f"] for r in d.select(S.payload_fingerprint("a", "b", "c", "d", public="p").alias("f")).collect()]
    flag = {None: "absent", True: "true", False: "false"}
    assert got == [hashlib.sha256(b"".join(f"{len(x.encode())}:{x}".encode() for x in [*r[:4], f"authenticated_public:{flag[r[4]]}"])).hexdigest() for r in rows]


def widened_by_hand(ranked, k):
    """One query's page by rounds, one after the other: ranked {arm: [(key, may)]} best first."""
    limit, most = max(2 * k, 16), min(max(16 * k, 128), 800)
    while True:
        score = {}
        for rows in ranked.values():
            for r, (key, may) in enumerate(rows[:limit], 1):
                score[key, may] = score.get((key, may), 0) + 1 / (60 + r)
        raw = sorted(score, key=lambda x: (-round(score[x], 9), x[0]))[:limit]
        hits, exhausted = [key for key, may in raw if may][:k], len(raw) < limit
        if len(hits) == k or exhausted or limit >= most:
            return limit, len(hits) < k and not exhausted, hits
        limit = min(2 * limit, most)


def test_widening_rounds(spark):
    """Each query stops at a limit of its own; the first round of some is all forbidden, others stay open."""
    import random

    from tidemark.operators.delivery import candidate_limits, widened

    r, rows, want, ks = random.Random(1), [], {}, {}
    for q in range(60):
        k = r.choice([1, 3, 8, 10, 40, 60, 100])
        n = r.choice([0, 5, 15, 16, 17, 60, 300, 900])
        share = r.choice([0, 0.005, 0.05, 0.5, 1])
        first = r.choice([0, 0, 20, 100])  # forbidden at the head
        keys = [f"m{i:04d}" for i in range(n)]
        may = {x: i >= first and r.random() < share for i, x in enumerate(keys)}
        arms = {"sparse": keys[: r.randrange(n + 1)], "dense": sorted(keys, key=lambda x: (r.random() < 0.3, x))}
        ranked = {a: [(x, may[x]) for x in xs] for a, xs in arms.items()}
        want[q], ks[q] = widened_by_hand(ranked, k), k
        rows += [(q, k, a, x, i, 1.0 / i, m) for a, xs in ranked.items() for i, (x, m) in enumerate(xs[:800], 1)]
    queries = spark.createDataFrame(list(ks.items()), "query_id int, k int")
    ranked = spark.createDataFrame(rows, "query_id int, k int, arm string, storage_id string, rank int, score double, may boolean").repartition(5)
    got = {}
    for x in widened(ranked, queries).orderBy("query_id", "rank").collect():
        limit, open_, hits = got.setdefault(x.query_id, (x.candidates, x.truncated, []))
        assert (limit, open_) == (x.candidates, x.truncated)
        hits += [x.storage_id] if x.storage_id else []
    assert got == want
    assert len({w[0] for w in want.values()}) > 8 and sum(w[1] for w in want.values()) > 3
    limits = {x.k: x.c for x in queries.select("k", candidate_limits("k").alias("c")).distinct().collect()}
    assert limits[3] == [16, 32, 64, 128] and limits[60] == [120, 240, 480, 800] and limits[100] == [200, 400, 800]
