"""Language identification with a string kernel (operator 1).

The kernel is a blended spectrum over byte n-grams: two texts are as similar as the n-grams present in
both (presence, not counts), cosine-normalised by the number of n-grams of each. A few landmark texts
(Nystroem) turn it into a feature map, on which one-versus-rest kernel ridge regression is solved in closed
form. Scoring multiplies a batch's presence matrix with the landmarks' presence matrix and the folded weights.

Training reads a bounded sample of labelled texts, those of least hash: at most `per_lang` of each language
and, with very many languages, so many fewer that they are at most `most` together (but one of each);
`landmarks` of them are landmarks. What is sent to the driver is that sample's kernel values and the
landmarks' n-gram buckets. Every text is scored whole.

Defined results: a null text or one without a letter is `und` with score 0, and is not learned from; a null
lang or doc_id is never learned from; without any labelled text all rows are `und`; rows that repeat a doc_id
are scored row by row and count against the bounds of the sample; of equal margins the language first in
alphabetical order is taken; an empty table gives no rows; texts are read whole, whatever their length (the
presence spaces are bounded, so a text of very many n-grams fills them up and its score falls); extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import scratch
from tidemark.llm import textkit as tk

#: n-gram lengths and the bits of their hashed presence spaces; part of the kernel's definition.
SPECTRUM = ((2, 12), (3, 14), (4, 15))
WIDTH = sum(1 << bits for _, bits in SPECTRUM)


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    used: np.ndarray  # buckets that a landmark has; the landmark matrix has a row for each
    landmarks: np.ndarray  # columns x landmarks, each column normalised
    weights: np.ndarray  # landmarks x languages


def buckets(data: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, bucket) of every n-gram that lies in one document, for each n."""
    x = (data.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    g, base, have = x, 0, 1
    for n, bits in SPECTRUM:
        while have < n:
            g = g[:-1] * np.uint32(0x85EBCA77) + x[have:]
            have += 1
        if len(g) and len(data) >= n:
            b = ((g * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - bits)).astype(np.int32) + base
            own = doc[: len(g)]
            same = own == doc[n - 1 :]
            yield own[same], b[same]
        base += 1 << bits


def presence(p: tk.Piece) -> np.ndarray:
    """Documents x buckets: which n-grams are present."""
    doc = np.repeat(np.arange(len(p), dtype=np.int64), p.lengths)
    seen = np.zeros(len(p) * WIDTH, bool)
    for own, b in buckets(tk.LOWER[p.data], doc):
        seen[own * WIDTH + b] = True
    return seen.reshape(len(p), WIDTH)


def kernel(p: tk.Piece, model: Model) -> np.ndarray:
    """Documents x landmarks kernel values: shared n-grams over the root of both numbers of n-grams."""
    out = []
    for at in range(0, len(p), 64):
        to = min(len(p), at + 64)
        part = tk.Piece(p.data[p.offs[at] : p.offs[to]], p.offs[at : to + 1] - p.offs[at], p.rows)
        seen = presence(part)
        norm = np.sqrt(np.maximum(np.count_nonzero(seen, axis=1), 1)).astype(np.float32)
        out.append((seen[:, model.used].astype(np.float32) @ model.landmarks) / norm[:, None])
    return np.concatenate(out) if out else np.zeros((0, model.landmarks.shape[1]), np.float32)


def held_out() -> F.Column:
    return (F.crc32(F.col("doc_id").cast("string")) % 3) == 1


FINE = 1 << 40


def sample(docs: DataFrame, per_lang: int, most: int) -> DataFrame:
    """The labelled training sample (doc_id, lang, text, k): of each language the rows of least hash.

    A first pass counts each language, which tells below what hash about twice the rows wanted lie; only
    those go into the shuffle that ranks them, however many rows a language has."""
    able = F.col("lang").isNotNull() & ~F.coalesce(held_out(), F.lit(True)) & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.where(able).select("doc_id", "lang", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(FINE)).alias("h"))
    counts = scratch.stored(rows.groupBy("lang").agg(F.count("*").alias("n")))
    n_langs = counts.count()
    wanted = max(1, min(per_lang, most // max(1, n_langs)))
    cut = counts.select("lang", F.when(F.col("n") <= 4 * wanted, F.lit(FINE)).otherwise((2 * wanted + 20) / F.col("n") * FINE).cast("bigint").alias("cut"))
    near = rows.join(F.broadcast(cut) if n_langs <= most else cut, "lang").where("h < cut")
    ranked = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id")))
    return scratch.stored(ranked.where(F.col("k") <= wanted).select("doc_id", "lang", "text", "k"))


def fit(docs: DataFrame, per_lang: int = 400, landmarks: int = 120, ridge: float = 1e-2, most: int = 20_000) -> Model | None:
    """Fits on a bounded sample: `per_lang` rows of each language at most, and `most` rows in all."""
    taken = sample(docs, per_lang, most)
    first = max(1, landmarks // max(1, taken.select("lang").distinct().count()))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in tk.pieces(batch, limit=1 << 20):
                doc = np.repeat(np.arange(len(p), dtype=np.int64), p.lengths)
                own, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (list(z) for z in zip(*buckets(tk.LOWER[p.data], doc), strict=True)) or ([], []))
                pairs = np.unique(own * WIDTH + b)
                cut = np.searchsorted(pairs, np.arange(len(p) + 1) * WIDTH)
                sets = [(pairs[cut[i] : cut[i + 1]] % WIDTH).astype(np.int32) for i in range(len(p))]
                yield pa.RecordBatch.from_arrays([p.rows.column(0), p.rows.column(1), pa.array(sets, pa.list_(pa.int32()))], ["doc_id", "lang", "grams"])

    marks = taken.where(F.col("k") <= first).select("doc_id", "lang", "text").mapInArrow(spell, "doc_id long, lang string, grams array<int>").toPandas().sort_values(["lang", "doc_id"])
    marks = [np.asarray(g) for g in marks["grams"] if len(g)]
    if not marks:
        return None
    used = np.unique(np.concatenate(marks))
    basis = np.zeros((len(used), len(marks)), np.float32)
    for j, g in enumerate(marks):
        basis[np.searchsorted(used, g), j] = 1 / np.sqrt(len(g))
    blank = Model((), used, basis, np.zeros((len(marks), 0), np.float32))
    at = docs.sparkSession.sparkContext.broadcast(blank)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in tk.pieces(batch):
                yield pa.RecordBatch.from_arrays([p.rows.column(0), p.rows.column(1), pa.array(list(kernel(p, at.value)), pa.list_(pa.float32()))], ["doc_id", "lang", "k"])

    rows = taken.select("doc_id", "lang", "text").mapInArrow(measure, "doc_id long, lang string, k array<float>").toPandas().sort_values(["doc_id", "lang"])
    langs = tuple(sorted(rows["lang"].unique()))
    k_nm = np.stack(rows["k"].to_numpy()).astype(np.float64)
    values, vectors = np.linalg.eigh((basis.T @ basis).astype(np.float64))
    good = values > 1e-6
    root = vectors[:, good] / np.sqrt(values[good])
    z = k_nm @ root
    y = np.where(rows["lang"].to_numpy()[:, None] == np.array(langs)[None, :], 1.0, -1.0)
    weight = 1 / np.bincount(np.argmax(y, 1), minlength=len(langs))[np.argmax(y, 1)]  # languages count alike
    zw = z * weight[:, None]
    beta = np.linalg.solve(z.T @ zw + ridge * np.eye(z.shape[1]) / max(1, z.shape[1]), zw.T @ y)
    return Model(langs, used, basis, (root @ beta).astype(np.float32))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row; one pass, no shuffle."""
    rows = docs.select("doc_id", "text", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("spoken"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = np.array([*m.langs, "und"], object)
        for batch in batches:
            for p in tk.pieces(batch):
                margin = kernel(p, m) @ m.weights
                e = np.exp(3 * (margin - margin.max(1, keepdims=True)))
                spoken = p.rows.column(3).to_numpy(zero_copy_only=False)
                best = np.where(spoken, margin.argmax(1), len(m.langs))
                score = np.where(spoken, e.max(1) / e.sum(1), 0.0).astype(np.float64)
                yield pa.RecordBatch.from_arrays([p.rows.column(0), p.rows.column(2), pa.array(names[best], pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("bigint"), "text", "lang")
    return predict(docs, fit(docs))
