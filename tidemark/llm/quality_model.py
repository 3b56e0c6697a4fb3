"""Quality classifier from weak labels (operator 10).

Heuristic labellers vote good, bad or nothing on every text. Expectation-maximisation over the counts
of vote patterns (at most 3 to the number of labellers) estimates, without true labels, how often each
labeller votes good, bad or nothing on good and on bad texts; the posterior of a text's pattern is its soft
label. A hashed linear scorer over words, word ends, word shapes and words that return at once, which does not
see the votes, is
trained on the soft labels of a bounded sample and scores every whole text.

The sample is the `fit_rows` rows of least hash of doc_id and text; repeated rows count against the bound.

Defined results: a null or wordless text has score 0 and is not kept, and is not learned from, neither its votes
nor its words; rows are scored one by one, so ties and repeated rows need no rule; texts are read whole, whatever
their length; a null doc_id is kept as null; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import textkit as tk

WIDTH = 1 << 12
FINE = 1 << 40
#: Priors of how often a labeller votes (bad, nothing, good): on good texts, on the kind of bad text that it
#: is there for, and on other kinds. They are worth PRIOR_SHARE of all texts, and so is each class. That
#: good texts seldom get a bad vote is worth GOOD_SHARE times all texts: a kind that one labeller alone objects
#: to could as well be good texts on which it errs, which votes cannot tell.
ON_GOOD, ON_OWN, ON_OTHER = (0.002, 0.1, 0.898), (0.8, 0.1, 0.1), (0.1, 0.2, 0.7)
PRIOR_SHARE, GOOD_SHARE = 0.005, 3.0
LABELLERS = ("strings", "symbols", "upper", "variety", "stutter", "shouts", "pipes", "endings")


def _class(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


SYMBOL, UPPER, PIPE, BANG, STOP = _class(b"#*$%&<>"), _class(bytes(range(65, 91))), _class(b"|"), _class(b"!"), _class(b".!?")


def votes(p: tk.Piece, w: tk.Words) -> np.ndarray:
    """Documents x labellers: 1 good, -1 bad, 0 no vote."""
    n = np.maximum(w.counts, 1)
    codes, names = w.encode()
    doc = w.doc
    _, first = np.unique(doc * max(1, len(names)) + codes, return_index=True)
    distinct = np.bincount(doc[first], minlength=len(p))
    again = np.zeros(len(codes), bool)
    again[1:] = (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])
    per = lambda t: tk.per_doc_sum(t[p.data], p.offs)
    chars = np.maximum(tk.per_doc_sum(w.end - w.start, w.first), 1)
    last = p.data[w.end - 1] if len(codes) else p.data[:0]
    line_end = np.r_[np.searchsorted(w.start, np.flatnonzero(p.data == 10)), w.first[1:]] - 1
    line_end = np.unique(line_end[line_end >= 0])
    lines = np.bincount(doc[line_end], minlength=len(p)) if len(codes) else np.zeros(len(p), np.int64)
    stops = np.bincount(doc[line_end][STOP[last[line_end]]], minlength=len(p)) if len(codes) else lines
    ask = lambda x, good, bad: np.where(x <= good, 1, np.where(x >= bad, -1, 0))
    return np.stack(
        [
            ask(chars / n, 12, 18),
            ask(per(SYMBOL) / n, 0.02, 0.1),
            ask(per(UPPER) / chars, 0.1, 0.4),
            ask(-distinct / np.minimum(n, 400), -0.35, -0.15),
            ask(tk.per_doc_sum(again, w.first) / n, 0.05, 0.15),
            ask(per(BANG) / n, -1, 0.2),
            ask(per(PIPE) / n, -1, 0.08),
            ask(-stops / np.maximum(lines, 1), -0.7, -0.3),
        ],
        axis=1,
    )


def pattern(v: np.ndarray) -> np.ndarray:
    return ((v + 1) * 3 ** np.arange(v.shape[1])).sum(1)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(class, labeller, vote) rates of (bad, nothing, good) votes on (bad, good) texts, and each pattern's
    posterior of good.

    Kinds of bad text differ, and most labellers do not object to most of them, so labellers are not
    independent on bad texts as a whole. Bad is therefore a mixture of one latent kind for each labeller, in
    each of which votes are independent; a labeller's rates on bad texts are those over all kinds.
    """
    n = len(LABELLERS)
    vote = (patterns[:, None] // 3 ** np.arange(n)) % 3
    is_vote = np.stack([vote == v for v in range(3)], 2).astype(float)  # pattern, labeller, vote
    prior = np.tile(np.array(ON_OTHER), (n + 1, n, 1))
    prior[0] = ON_GOOD
    prior[np.arange(n) + 1, np.arange(n)] = ON_OWN
    weight = PRIOR_SHARE * counts.sum()
    objects = (vote == 0).astype(float)
    bad = 0.95 * objects / np.maximum(objects.sum(1, keepdims=True), 1)
    post = np.c_[1 - bad.sum(1), bad].T  # class (good, kinds of bad), pattern
    for _ in range(rounds):
        share = post * counts
        size = share.sum(1) + weight
        rates = np.einsum("cp,plv->clv", share, is_vote) + weight * prior
        rates /= rates.sum(2, keepdims=True)
        seldom = (share[0] @ objects + GOOD_SHARE * counts.sum() * ON_GOOD[0]) / (share[0].sum() + GOOD_SHARE * counts.sum())
        rates[0] = np.c_[seldom, rates[0, :, 1:] / rates[0, :, 1:].sum(1, keepdims=True) * (1 - seldom)[:, None]]
        log = np.log(size / size.sum())[:, None] + np.einsum("clv,plv->cp", np.log(rates), is_vote)
        post = np.exp(log - log.max(0))
        post /= post.sum(0)
    return np.stack([np.einsum("c,clv->lv", size[1:] / size[1:].sum(), rates[1:]), rates[0]]), post[0]


def features(w: tk.Words) -> tuple[np.ndarray, np.ndarray]:
    """Word codes, and for each code its hashed features (word, end, shape)."""
    h, codes, by_code = w.hashes()
    names = w.encode()[1].to_pylist()
    end = np.array([hash_bytes(x[-2:], 1) for x in names], np.int64)
    shape = np.array([hash_bytes(bytes(_SHAPE[b] for b in x[:2] + x[-3:]) + bytes([min(len(x), 15)]), 2) for x in names], np.int64)
    return codes, np.stack([(by_code % np.uint64(WIDTH)).astype(np.int64), end % WIDTH, shape % WIDTH], 1) if len(names) else np.zeros((0, 3), np.int64)


def echoes(w: tk.Words) -> np.ndarray:
    """Documents x 2: the shares of words that equal the word before, and one of the seven before that."""
    codes, _ = w.encode()
    doc, out = w.doc, []
    for backs in ((1,), range(2, 9)):
        hit = np.zeros(len(codes), bool)
        for k in backs:
            hit[k:] |= (codes[k:] == codes[:-k]) & (doc[k:] == doc[:-k])
        out.append(tk.per_doc_sum(hit, w.first) / np.maximum(w.counts, 1))
    return np.stack(out, 1)


def hash_bytes(x: bytes, seed: int) -> int:
    return tk.xxhash.xxh3_64_intdigest(x, seed) >> 1


_SHAPE = [65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256)]


def fit(docs: DataFrame, fit_rows: int) -> tuple[np.ndarray, float] | None:
    """Weights and bias: EM over all texts' vote patterns, then a linear scorer on the sample."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in tk.pieces(batch):
                w = tk.Words(p, tk.NOT_SPACE)
                k, n = np.unique(pattern(votes(p, w))[w.counts > 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["pattern", "n"])

    rows = docs.select("text").mapInArrow(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toPandas().sort_values("pattern")
    if not len(rows):
        return None
    _, good = expectation_maximisation(rows["pattern"].to_numpy(np.int64), rows["n"].to_numpy(np.float64))
    label = dict(zip(rows["pattern"].tolist(), good.tolist(), strict=True))
    n_texts = int(rows["n"].sum())
    cut = FINE if n_texts <= 4 * fit_rows else int((2 * fit_rows + 20) / n_texts * FINE)
    hashed = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(FINE)).alias("h")).where(F.col("h") < cut)
    picked = hashed.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).orderBy("h", "doc_id").limit(fit_rows).select("doc_id", "text")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in tk.pieces(batch):
                w = tk.Words(p, tk.NOT_SPACE)
                codes, f = features(w)
                v = votes(p, w)
                v, again = pattern(v), echoes(w)
                at, n = [], []
                for d in range(len(p)):
                    k, c = np.unique(f[codes[w.first[d] : w.first[d + 1]]], return_counts=True)
                    at.append(np.r_[k, WIDTH, WIDTH + 1].astype(np.int32)), n.append(np.r_[c / max(1, w.counts[d]), again[d]].astype(np.float32))
                yield pa.RecordBatch.from_arrays([p.rows.column(0), pa.array(v), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.float32()))], ["doc_id", "pattern", "at", "n"])

    sample = picked.mapInArrow(describe, "doc_id long, pattern long, at array<int>, n array<float>").toPandas().sort_values(["doc_id", "pattern"])
    if not len(sample):
        return None
    x = np.zeros((len(sample), WIDTH + 2), np.float32)
    for i, (at, n) in enumerate(zip(sample["at"], sample["n"], strict=True)):
        x[i, at] = n
    y = np.array([label.get(k, 0.5) for k in sample["pattern"]], np.float32)
    weight = np.where(y > 0.5, 0.5 / max(1, (y > 0.5).sum()), 0.5 / max(1, (y <= 0.5).sum())).astype(np.float32)
    beta, bias, speed, was = np.zeros(WIDTH + 2, np.float32), np.float32(0), np.zeros(WIDTH + 2, np.float32), 0.0
    for _ in range(1500):  # momentum descent of the weighted logistic loss
        g = weight * (1 / (1 + np.exp(-np.clip(x @ beta + bias, -50, 50))) - y)
        speed = 0.9 * speed - 40.0 * (x.T @ g + 1e-6 * beta)
        was = 0.9 * was - 0.5 * float(g.sum())
        beta, bias = beta + speed, bias + np.float32(was)
    return beta, float(bias)


def quality_scores(docs: DataFrame, fit_rows: int = 2000, threshold: float = 0.5) -> DataFrame:
    """doc_id, score (0 to 1), kept for each row of `docs`."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    model = fit(docs, fit_rows)
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(False).alias("kept"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beta, bias = sent.value
        for batch in batches:
            for p in tk.pieces(batch):
                w = tk.Words(p, tk.NOT_SPACE)
                codes, f = features(w)
                each = beta[f].sum(1, dtype=np.float64)[codes] if len(codes) else np.zeros(0)
                z = np.bincount(w.doc, weights=each, minlength=len(p)) / np.maximum(w.counts, 1) + echoes(w) @ beta[WIDTH:] + bias
                score = np.where(w.counts > 0, 1 / (1 + np.exp(-np.clip(z, -50, 50))), 0.0)
                yield pa.RecordBatch.from_arrays([p.rows.column(0), pa.array(score), pa.array(score >= threshold)], ["doc_id", "score", "kept"])

    return docs.mapInArrow(run, "doc_id long, score double, kept boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
