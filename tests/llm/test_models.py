"""Language id and quality scorer against the same models computed by hand, word by word and kernel by kernel."""

import random

import numpy as np
import xxhash

from tests.llm.test_llm import WORD, by_id, lower
from tidemark.llm import language_id, quality_model
from tidemark.llm import textkit as tk

M32 = 0xFFFFFFFF


def grams(text):
    """The buckets of a text's n-grams, by the kernel's definition, one after the other."""
    x = [(b + 1) * 0x9E3779B1 & M32 for b in lower(text).encode()]
    out, base = set(), 0
    for n, bits in language_id.SPECTRUM:
        for i in range(len(x) - n + 1):
            g = x[i]
            for k in range(1, n):
                g = (g * 0x85EBCA77 + x[i + k]) & M32
            out.add(base + ((g * 0xC2B2AE3D & M32) >> (32 - bits)))
        base += 1 << bits
    return out


def shared(a, b):
    return len(a & b) / np.sqrt(max(len(a), 1) * max(len(b), 1))


def test_language_id_equals_kernel_ridge_by_hand(spark):
    r = random.Random(7)
    letters = {"aa": "abcdé", "bb": "cdefg", "cc": "efghü"}
    text = lambda k: " ".join("".join(r.choice(letters[k]) for _ in range(r.randrange(2, 7))) for _ in range(r.randrange(1, 25)))
    rows = [(i, text(k), k) for i in range(150) for k in [r.choice(list(letters))]] + [(900, None, "aa"), (901, "12 34", "bb"), (902, text("aa"), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    per, marks, ridge = 1000, 24, 1e-2
    model = language_id.fit(docs, per, marks, ridge)
    got = by_id(language_id.predict(docs, model))
    taken = sorted((x.lang, x.doc_id, x.text, x.k) for x in language_id.sample(docs, per, 20_000).collect())
    langs = sorted({x[0] for x in taken})
    first = marks // len(langs)
    landmarks = [grams(t) for _, _, t, k in taken if k <= first]
    train = sorted(taken, key=lambda x: (x[1], x[0]))
    k_mm = np.array([[shared(a, b) for b in landmarks] for a in landmarks])
    k_nm = np.array([[shared(grams(t), b) for b in landmarks] for _, _, t, _ in train])
    values, vectors = np.linalg.eigh(k_mm)
    root = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])
    z = k_nm @ root
    y = np.array([[1.0 if x[0] == m else -1.0 for m in langs] for x in train])
    size = {m: sum(x[0] == m for x in train) for m in langs}
    w = np.diag([1 / size[x[0]] for x in train])
    beta = np.linalg.inv(z.T @ w @ z + ridge / z.shape[1] * np.eye(z.shape[1])) @ z.T @ w @ y
    for i, t, _ in rows:
        x = got[i]
        if t is None or not any(c.isalpha() for c in t):
            assert (x["lang_pred"], x["score"]) == ("und", 0)
            continue
        margin = np.array([shared(grams(t), b) for b in landmarks]) @ root @ beta
        e = np.exp(3 * (margin - margin.max()))
        close = np.sort(margin)[-1] - np.sort(margin)[-2] < 1e-3
        assert x["lang_pred"] == langs[int(margin.argmax())] or close
        assert abs(x["score"] - 1 / e.sum()) < 2e-3


def test_quality_scores_equal_the_scorer_by_hand(spark):
    r = random.Random(3)
    prose = lambda: ". ".join("The " + " ".join("".join(r.choice("abcdeoé") for _ in range(5)) for _ in range(9)) for _ in range(8)) + "."
    rows = [(k, prose().upper() + "!!" if k % 10 == 0 else "spam " * 60 if k % 10 == 1 else prose()) for k in range(200)]
    rows += [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "a b a a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    beta, bias = quality_model.fit(docs, 100)
    got = by_id(quality_model.quality_scores(docs, 100))
    shape = lambda b: 65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b
    width = quality_model.WIDTH

    def of(word):
        h = xxhash.xxh3_64_intdigest
        parts = bytes(shape(b) for b in word[:2] + word[-3:]) + bytes([min(len(word), 15)])
        return float(beta[h(word, 0) % width]) + float(beta[(h(word[-2:], 1) >> 1) % width]) + float(beta[(h(parts, 2) >> 1) % width])

    for k, t in rows:
        w = [x.encode() for x in WORD.findall(t or "")]
        if not w:
            assert got[k]["score"] == 0 and not got[k]["kept"]
            continue
        again = sum(a == b for a, b in zip(w[1:], w)) / len(w)
        near = sum(any(i >= j and w[i] == w[i - j] for j in range(2, 9)) for i in range(len(w))) / len(w)
        z = sum(map(of, w)) / len(w) + again * float(beta[width]) + near * float(beta[width + 1]) + bias
        assert abs(got[k]["score"] - 1 / (1 + np.exp(-z))) < 1e-4
    assert tk.PIECE_BYTES


def test_quality_model_learns_nothing_from_wordless_texts(spark):
    r = random.Random(5)
    rows = [(k, ("SPAM " * 50 if k % 7 == 0 else " ".join("".join(r.choice("abcde") for _ in range(4)) for _ in range(40)) + ".")) for k in range(120)]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    more = plain.unionByName(spark.createDataFrame([(1000 + k, [None, "", " \n "][k % 3]) for k in range(300)], "doc_id long, text string"))
    a, b = (quality_model.fit(x, 1000) for x in (plain, more))
    assert np.allclose(a[0], b[0], atol=1e-5) and abs(a[1] - b[1]) < 1e-5
