"""Secret scan, periodic runs and ranked search against brute force; odd rows, ties, empty tables."""

import base64
import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_llm import ALNUM, DOCS, WORD, by_id, corpus, docs, lower, none  # noqa: F401
from tidemark.llm import periodic_runs, ranked_search, secret_scan
from tidemark.llm import textkit as tk

# ---- operator 12


def runs_by_hand(c):
    """(start, length, period) of all runs of a sequence, by start and period."""
    out = set()
    for q in range(1, len(c) // 4 + 1):
        i = 0
        while i + q < len(c):
            j = i
            while j + q < len(c) and c[j] == c[j + q]:
                j += 1
            seg = c[i : j + q]
            if j > i and len(seg) >= max(6, 4 * q) and not any(seg[r:] == seg[:-r] for r in range(1, q)):
                out.add((i, len(seg), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(c, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return [x for i, x in enumerate(c) if i not in gone]


def reported(doc_id, c):
    runs = runs_by_hand(c)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    from fractions import Fraction

    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{a},{b},{p}\n" for a, b, p in runs)), digest(" ".join(collapsed(c, runs))))


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    rnd = random.Random(seed)
    for _ in range(500):
        texts = []
        for _ in range(rnd.randint(0, 4)):
            k = rnd.choice([1, 2, 2, 3])
            c = [rnd.randrange(k) for _ in range(rnd.randint(0, 90))]
            if c and rnd.random() < 0.7:
                p, a = rnd.randint(1, 20), rnd.randrange(len(c))
                c = c[:a] + [c[a + (i - a) % p] if a + (i - a) % p < len(c) else 0 for i in range(a, len(c) + 40)]
                c += [rnd.randrange(k) for _ in range(rnd.choice([0, 0, 20]))]
                c += c if rnd.random() < 0.3 else []
            texts.append(c)
        flat, first = np.array(sum(texts, []), np.int64), np.r_[0, np.cumsum([len(c) for c in texts], dtype=np.int64)]
        got = list(zip(*(x.tolist() for x in periodic_runs.runs(flat, first))))
        assert got == [(d, *r) for d, c in enumerate(texts) for r in runs_by_hand(c)]


def test_wavelet_counts_and_orders_ranges():
    rnd = np.random.default_rng(0)
    for n in (1, 2, 64, 65, 128, 500):
        v = rnd.permutation(n)
        tree = periodic_runs.Wavelet(v, n)
        lo = rnd.integers(0, n, 50)
        hi = lo + 1 + (rnd.random(50) * (n - lo)).astype(np.int64)
        hi, x = np.minimum(hi, n), rnd.integers(0, n + 1, 50)
        assert tree.below(lo, hi, x).tolist() == [int((v[a:b] < c).sum()) for a, b, c in zip(lo, hi, x)]
        k = (rnd.random(50) * (hi - lo)).astype(np.int64)
        assert tree.nth(lo, hi, k).tolist() == [int(np.sort(v[a:b])[c]) for a, b, c in zip(lo, hi, k)]


def rewritten(doc_id, c):
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not c:
        return c
    g = h // 10
    a = g % len(c)
    p = 1 + (len(c) - a) // (3 + g % 8)
    return [x if i < a else c[a + (i - a) % p] for i, x in enumerate(c)]


def test_periodic_runs(spark, docs, none):  # noqa: F811
    rows = [(k, t) for k, t, *_ in corpus()]
    rows += [(100 + k, t) for k, t in enumerate(["a " * 5, "a " * 6, "a\tb\x0b" * 4, "x a b a b a b a b y", "é é é é é é", "a b c " * 700 + "d", None, "", " \n", "a a a a a a b b b b b b"])]
    rows += [(k, " ".join(random.Random(k).choice("abcdefgh") * 2 for _ in range(200))) for k in range(1000, 1060)]
    rows += [(101, "a a a a a a")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_runs string").repartition(3)
    for made, source in ((periodic_runs.periodic_runs(table, periodic_runs.planted), rewritten), (periodic_runs.periodic_runs(table), lambda _, c: c)):
        got = sorted(map(tuple, made.collect()))
        want = sorted(reported(k, source(k, WORD.findall(t or ""))) for k, t in rows)
        assert [tuple("" if x is None else x for x in r) for r in got] == [tuple("" if x is None else x for x in r) for r in want]
    assert sum(zlib.crc32(str(k).encode()) % 10 == 0 for k, _ in rows) > 5
    odd = periodic_runs.periodic_runs(spark.createDataFrame([(None, "a a a a a a a")], "doc_id long, text string")).first()
    assert (odd.doc_id, odd.n_runs, odd.length, odd.exponent_milli) == (None, 1, 7, 7000)
    assert periodic_runs.periodic_runs(none).count() == 0


# ---- operator 11


def der(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else (lambda b: bytes([0x80 | len(b)]) + b)(n.to_bytes((n.bit_length() + 7) // 8, "big"))
    return bytes([tag]) + size + body


def number(n):
    return der(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))


def keys():
    r = random.Random(5)
    big = lambda bits: r.getrandbits(bits) | 1 << bits - 1 | 1
    p, q = big(512), big(512)
    rsa = der(0x30, b"".join(map(number, (0, p * q, 65537, big(1000), p, q, big(500), big(500), big(500)))))
    oid = der(6, bytes.fromhex("2a864886f70d010101"))
    curve = der(6, bytes.fromhex("2a8648ce3d030107"))
    ec = der(0x30, number(1) + der(4, r.randbytes(32)) + der(0xA0, curve) + der(0xA1, der(3, b"\0" + r.randbytes(65))))
    pkcs8 = der(0x30, number(0) + der(0x30, oid + der(5, b"")) + der(4, rsa))
    ed = der(0x30, number(0) + der(0x30, der(6, bytes.fromhex("2b6570"))) + der(4, der(4, r.randbytes(32))))
    sealed = der(0x30, der(0x30, der(6, bytes.fromhex("2a864886f70d01050d")) + der(0x30, oid)) + der(4, r.randbytes(64)))
    string = lambda b: len(b).to_bytes(4, "big") + b
    ssh = b"openssh-key-v1\0" + string(b"none") + string(b"none") + string(b"") + (1).to_bytes(4, "big") + string(r.randbytes(51)) + string(r.randbytes(136))
    public = der(0x30, der(0x30, oid + der(5, b"")) + der(3, b"\0" + rsa))
    return {"rsa": rsa, "ec": ec, "pkcs8": pkcs8, "ed": ed, "sealed": sealed, "ssh": ssh}, public


def armour(name, data, sep="\n"):
    body = base64.b64encode(data).decode()
    return f"-----BEGIN {name}PRIVATE KEY-----{sep}" + sep.join(body[k : k + 64] for k in range(0, len(body), 64)) + f"{sep}-----END {name}PRIVATE KEY-----"


def url64(x):
    return base64.urlsafe_b64encode(x if isinstance(x, bytes) else json.dumps(x).encode()).decode().rstrip("=")


def base_by_hand(t):
    out = []
    for m in re.finditer(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.ASCII):
        out += [(m.start(), 0, m.end())] if len(m[2]) >= 8 else []
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


def test_secret_scan_base(spark, docs, none):  # noqa: F811
    r = random.Random(2)
    parts = ["password", "PassWd", "secret", "ToKen", "api_key", "apikey", "=", ":", " ", "  ", '"', "'", "abc", "abcdefgh", "x" * 9, "AKIA", "AKIAABCDEFGHIJKL", "AKIA1234", "deadbeef" * 4, "0f" * 15, "é", "ſecret", "toKen", "\n", "-", "."]
    rows = [(k, "".join(r.choice(parts) for _ in range(r.randrange(40)))) for k in range(300)]
    rows += [(k, t) for k, t, *_ in corpus()] + [(900, None), (901, ""), (902, 'password="token:abcdefgh'), (902, 'password="token:abcdefgh'), (None, "token = abcdefgh1")]
    table = spark.createDataFrame([(*x, "e") for x in rows], "doc_id long, text string, spans string").repartition(3)
    got = secret_scan.secret_scan(table).collect()
    want = []
    for k, t in rows:
        spans = base_by_hand(t or "")
        said = ",".join(f"{secret_scan.BASE[kind]}:{a}:{b}" for a, kind, b in spans)
        want.append((k, *(sum(s[1] == x for s in spans) for x in range(3)), hashlib.sha256(said.encode()).hexdigest(), said))
    assert sorted(tuple(x)[:6] for x in got if x[0] is not None) == sorted(w for w in want if w[0] is not None)
    assert [tuple(x)[:6] for x in got if x[0] is None] == want[-1:]
    assert secret_scan.secret_scan(none).count() == 0


def spans_of(text):
    p = next(tk.pieces(pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text]})))
    return [x.split(":") for x in secret_scan.measure(p)[0][5].split(",") if x]


def test_secret_scan_keys():
    good, public = keys()
    for name, data in good.items():
        for form in (base64.b64encode(data).decode(), base64.urlsafe_b64encode(data).decode().rstrip("="), data.hex(), data.hex().upper()):
            text = f"é before {form} after"
            assert ["key", "9", str(9 + len(form))] in spans_of(text), (name, form[:20])
        for sep in ("\n", "\r\n", "\\n"):
            block = armour("", data, sep)
            assert [x for x in spans_of(f"see {block}, end") if x[0] == "key"] == [["key", "4", str(4 + len(block))]], (name, sep)
        for broken in (data[:-1], data + b"\0", data[:20] + data[21:]):
            assert not [x for x in spans_of(f"x {base64.b64encode(broken).decode()} y") if x[0] == "key"], name
    assert not [x for x in spans_of(base64.b64encode(public).decode()) if x[0] == "key"]
    assert not [x for x in spans_of(armour("", public)) if x[0] == "key"]
    assert not [x for x in spans_of("-----BEGIN PRIVATE KEY-----\n" + "word " * 50 + "-----END PRIVATE KEY-----") if x[0] == "key"]
    legacy = armour("RSA ", random.Random(1).randbytes(64)).replace("KEY-----\n", "KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00\n\n", 1)
    assert [x[0] for x in spans_of(legacy)] == ["key"]
    two = armour("EC ", good["ec"]) + "\n" + armour("RSA ", good["rsa"])
    assert [x[0] for x in spans_of(two)] == ["key", "key"]


def test_secret_scan_signed_tokens():
    head, claims, mark = {"alg": "HS256", "typ": "JWT"}, {"sub": "é", "exp": 1}, bytes(range(32))
    token = f"{url64(head)}.{url64(claims)}.{url64(mark)}"
    assert spans_of(f"ü Bearer {token} z") == [["signed", "9", str(9 + len(token))]]
    assert [x[0] for x in spans_of(f"at /path/{token}")] == ["signed"]
    assert [x[0] for x in spans_of(f"token={token}")] == ["assign", "signed"]
    assert [x[0] for x in spans_of(f"{url64({'alg': 'none'})}.{url64(claims)}.")] == ["signed"]
    for bad in (f"{url64({'typ': 'JWT', 'x': 'yyyyyy'})}.{url64(claims)}.{url64(mark)}", f"{url64(head)}.{url64(b'no json here')}.{url64(mark)}", f"{url64(head)}.{url64(claims)}.", f"{url64(head)}.{url64(claims)}", f"{url64([1] * 9)}.{url64(claims)}.{url64(mark)}"):
        assert not spans_of(f"a {bad} b"), bad


def test_secret_scan_long_text():
    good, _ = keys()
    text = "word " * 400_000 + armour("", good["rsa"]) + " x" * 100_000 + " " + "Q" * 500_000
    assert [x[0] for x in spans_of(text)] == ["key"]


# ---- operator 13


def ranked_by_hand(rows, items, k=20):
    texts = [(d, ALNUM.findall(lower(t)) if t is not None else []) for d, t in rows]
    texts = [(d, Counter(w), len(w)) for d, w in texts if w]
    n_docs, n_terms = len(texts), sum(n for _, _, n in texts)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(ALNUM.findall(lower(t or "")))
    df = Counter(w for _, c, _ in texts for w in c)
    out = []
    for i, terms in asked.items():
        found = []
        for d, c, n in texts:
            m = 75 + (25 * n * n_docs) // n_terms
            s = sum(x * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 12 * m)) for w, x in terms.items() if w in c)
            found += [(-s, d is None, d or 0, d)] if s > 0 else []
        out += [(i, r, x[3], -x[0]) for r, x in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def search_rows():
    rows = [(k, t) for k, t, *_ in corpus()]
    rows += [(300 + k, "same words here") for k in range(30)] + [(None, "same words here"), (7, "words words words")]
    items = [(k, " ".join((rows[k][1] or "").split()[:8])) for k in range(40)]
    return rows, [*items, (50, None), (51, ""), (52, "absentword"), (53, "SAME same words"), (53, "here"), (54, "it's x Y y one"), (55, "É" * 120)]


@pytest.mark.parametrize(("k", "limit"), [(20, 1 << 20), (3, 1500)])
def test_ranked_search(spark, k, limit):
    rows, items = search_rows()
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string").repartition(4)
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")
    got = ranked_search.ranked_search(d, b, k, limit)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == ranked_by_hand(rows, items, k)
    if limit < 2000:
        assert ranked_search.blocks(ranked_search.item_terms(b), limit).select("block").distinct().count() > 2


def test_ranked_search_few_cells_at_once(spark, monkeypatch):
    rows, items = search_rows()
    monkeypatch.setattr(ranked_search, "CELLS", 100)
    scan = ranked_search.Scan([(i, w, 1) for i, t in items[:3] for w in set(ALNUM.findall(lower(t)))])
    p = next(tk.pieces(pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": [None, "a a b", rows[0][1]]})))
    n, doc, term, tf = scan.counts(p)
    want = [Counter(w for w in ALNUM.findall(lower(t)) if w in scan.terms) for t in ("", "a a b", rows[0][1])]
    assert n.tolist() == [0, 3, len(ALNUM.findall(lower(rows[0][1])))]
    assert {(a, scan.terms[b]): c for a, b, c in zip(doc.tolist(), term.tolist(), tf.tolist())} == {(k, w): x for k, c in enumerate(want) for w, x in c.items()}


def test_ranked_search_empty(spark, none):  # noqa: F811
    b = spark.createDataFrame([(1, "one word")], "item_id long, text string")
    assert ranked_search.ranked_search(none, b).count() == 0
    empty = ranked_search.ranked_search(spark.createDataFrame([(1, "one")], "doc_id long, text string"), b.limit(0))
    assert empty.count() == 0 and empty.columns == ["item_id", "rank", "doc_id", "score"]


def test_best_keeps_ties_with_lower_ids():
    best = ranked_search.Best(1, 2)
    for ids, scores in (([9, 8, 7], [5, 5, 5]), ([1, 6], [5, 4]), ([3], [6]), ([0], [0])):
        best.add(np.array(scores, np.int64)[:, None], np.array(ids, np.int64), np.zeros(len(ids), bool))
    assert best.rows[3].tolist() == [3, 1] and best.rows[1].tolist() == [6, 5]
    assert by_id is not None and DOCS
