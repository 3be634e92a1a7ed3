"""Language identification by nearest centroid.

Texts become normalised TF-IDF vectors of hashed byte 2- and 3-grams; digits, signs and white space count as one space. Each learned language has several centroids, found by
spherical k-means; a text gets the language of the centroid with the greatest cosine. A text farther from it than nearly all
the learned texts of that language is marked `rejected`, and callers may read that as no language.

Learned rows are a bounded sample: SAMPLE rows at most, shared out evenly over the languages, those of smallest hash of doc_id; a
repeated doc_id gives one row, that of the least text. Document frequencies are counted over all learnable rows. Ties of hashes go
by doc_id, ties of cosines to the first language. Very long texts are counted whole.
Prediction covers all rows. Null text, or text without a letter, is `und` with score 0. Without any row to learn from all
rows are `und`. Repeated rows each get a row. Other columns than doc_id, text (and lang, to learn) are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import textarrays as ta
from .common import in_batches

DIMS, CENTROIDS, SAMPLE, ROUNDS = 4096, 4, 1600, 12
RUN = 256
#: Of a language's learned texts, the share that may lie beyond its rejection distance.
BEYOND = 0.005


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def counted(docs: DataFrame, label: str) -> DataFrame:
    """label, key, counts of hashed n-grams of each row: what a bounded sample sends to the driver, whatever its texts' length."""

    def run(batches):
        for b in batches:
            for first, buf, offs in ta.text_chunks(b.column(1)):
                for i, part, at in ta.small_runs(buf, offs, RUN):
                    m = ta.ngram_counts(*ta.letters_only(part, at), DIMS)
                    flat = pa.FixedSizeListArray.from_arrays(pa.array(m.reshape(-1)), DIMS).cast(pa.list_(pa.float32()))
                    own = [b.column(c).slice(first + i, len(at) - 1) for c in (0, 2)]
                    yield pa.RecordBatch.from_arrays([*own, flat], ["label", "key", "counts"])

    return docs.select(F.col(label).cast("string").alias("label"), "text", "_key").transform(in_batches, run, "label string, key long, counts array<float>")


def frequencies(docs: DataFrame) -> tuple:
    """(rows, rows with each hashed n-gram) over all rows of docs: each task adds up its own, so a task sends DIMS numbers."""

    def run(batches):
        total, seen = 0, np.zeros(DIMS, dtype=np.int64)
        for b in batches:
            for _, buf, offs in ta.text_chunks(b.column(0)):
                for _, part, at in ta.small_runs(buf, offs, RUN):
                    seen += (ta.ngram_counts(*ta.letters_only(part, at), DIMS) > 0).sum(axis=0)
                    total += len(at) - 1
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, DIMS), pa.int32()), pa.array([total, *seen.tolist()], pa.int64())], ["i", "n"])

    got = docs.select("text").transform(in_batches, run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    n = {r["i"]: r["n"] for r in got}
    return n.get(-1, 0), np.array([n.get(i, 0) for i in range(DIMS)])


def k_means(v: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means; seeds are farthest points, so the result depends on the rows only."""
    centre = v.mean(axis=0)
    seeds = [int(np.argmax(v @ centre))]
    near = v @ v[seeds[0]]
    while len(seeds) < min(k, len(v)):
        seeds.append(int(np.argmin(near)))
        near = np.maximum(near, v @ v[seeds[-1]])
    c = v[seeds]
    for _ in range(rounds):
        own = np.argmax(v @ c.T, axis=1)
        c = np.stack([v[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(docs: DataFrame, learn: Column, lang: str = "lang") -> dict:
    """A model from the rows of docs for which `learn` holds and the language is known."""
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col("text").rlike("\\p{L}")).select("doc_id", "text", F.col(lang).alias("_lang"))
    # documents, not rows: one repeated doc_id may hold many (the estimate is within a few hundredths)
    sizes = rows.groupBy("_lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("count")).orderBy(F.desc("count"), "_lang").limit(SAMPLE).collect()
    if not sizes:
        return {"langs": []}
    each = max(1, SAMPLE // len(sizes))
    # Of a language's n documents, those of the lowest (2 each + 100) / n of all hashes: enough, and few, so no task ranks many.
    below = [(r["_lang"], min(2**63 - 1, -(2**63) + 2**64 * (2 * each + 100) // max(1, r["count"]))) for r in sizes]
    low = F.broadcast(docs.sparkSession.createDataFrame(below, "_l string, _below long"))  # SAMPLE rows at most
    key = F.xxhash64(F.col("doc_id"))
    few = rows.select("doc_id", "_lang").join(low, F.col("_lang") == F.col("_l")).where(key <= F.col("_below")).distinct()
    first = Window.partitionBy("_lang").orderBy(key, "doc_id")
    ids = few.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= each)
    chosen = F.broadcast(ids.select(F.col("doc_id").alias("_id"), F.col("_lang").alias("_l")))  # SAMPLE rows at most
    sample = rows.join(chosen, (F.col("doc_id") == F.col("_id")) & (F.col("_lang") == F.col("_l")))
    sample = sample.groupBy("doc_id", "_lang").agg(F.min("text").alias("text"))  # a repeated doc_id counts once
    got = counted(sample.withColumn("_key", key), "_lang").toArrow().combine_chunks()
    labels = np.array(got.column("label").to_pylist())
    counts = got.column("counts").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMS).astype(np.float32)
    order = np.lexsort((got.column("key").to_numpy(), labels))  # the same order, however the rows arrive
    labels, counts = labels[order], counts[order]
    n_rows, with_gram = frequencies(rows)
    idf = (np.log((1 + n_rows) / (1 + with_gram)) + 1).astype(np.float32)
    v = vectors(counts, idf)
    centroids, owner, least = [], [], []
    for name in sorted(set(labels)):
        own = v[labels == name]
        c = k_means(own, CENTROIDS)
        centroids.append(c)
        owner += [name] * len(c)
        least.append(float(np.quantile((own @ c.T).max(axis=1), BEYOND)))
    return {"langs": sorted(set(labels)), "idf": idf, "centroids": np.concatenate(centroids).astype(np.float32), "owner": owner, "least": dict(zip(sorted(set(labels)), least))}


def predict(docs: DataFrame, model: dict, keep_column: str | None = None) -> DataFrame:
    """doc_id, (keep_column,) lang_pred, score, rejected for each row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = held.value
        for b in batches:
            n = b.num_rows
            pred, score, far = ["und"] * n, np.zeros(n), np.ones(n, dtype=bool)
            letter = b.column(2).to_numpy(zero_copy_only=False)
            if model["langs"]:
                for first, buf, offs in ta.text_chunks(b.column(1)):
                    for i, part, at in ta.small_runs(buf, offs, RUN):
                        cos = vectors(ta.ngram_counts(*ta.letters_only(part, at), DIMS), model["idf"]) @ model["centroids"].T
                        for k, best in enumerate(np.argmax(cos, axis=1)):
                            row = first + i + k
                            if letter[row]:
                                pred[row] = model["owner"][best]
                                score[row] = min(1.0, max(0.0, float(cos[k, best])))
                                far[row] = score[row] < model["least"][pred[row]]
            rest = [b.column(3)] if keep_column else []
            yield pa.RecordBatch.from_arrays([b.column(0), *rest, pa.array(pred, pa.string()), pa.array(score), pa.array(far)], ["doc_id", *([keep_column] if keep_column else []), "lang_pred", "score", "rejected"])

    letter = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("_letter")
    rest = [F.col(keep_column)] if keep_column else []
    kind = f"{keep_column} {docs.schema[keep_column].dataType.simpleString()}, " if keep_column else ""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", letter, *rest)
    return rows.transform(in_batches, run, f"doc_id long, {kind}lang_pred string, score double, rejected boolean")


def held_out(doc_id: Column) -> Column:
    """Whether a document is for testing only: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(4)) == 2, F.lit(False))
