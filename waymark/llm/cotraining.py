"""Quality classification by co-training of two views.

One logistic model sees the text (hashed byte n-grams and a few shares of characters and repeats), the other only metadata
(source, language, length column). In each round every view scores all documents outside the labelled sample and gives its most
confident pseudo-labels, the share GIVE of all of them more at each end than in the round before, to the other. Both are then
calibrated on held-out labels and combined; all documents get the combined score.

The labels are a bounded sample (LABELLED labels of smallest hash of doc_id). Pseudo-labelled documents are not collected: a view
learns from their mean features in groups of like confidence and length, each weighing as its documents do, all together half as
much as the labels at most. Scoring covers all rows and whole texts, very long ones like others. Null text counts as empty, null
metadata as a value of its own. Without labels of both classes every score is the share of good labels (0.5 if none). Repeated
rows each get a row; to learn from, a repeated doc_id counts once (its rows by parts). Ties in confidence are given in equal
parts, and learned rows stand in the order of their doc_id's hash, so equal inputs give equal models. An empty table gets no
rows. Other columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textarrays as ta
from .common import few, in_batches, stored, working

DIMS, META, LABELLED, ROUNDS, GIVE = 2048, 256, 3000, 3, 0.05
#: Groups of pseudo-labelled documents: steps of a quarter in the logit beyond 1, and kinds of length in each.
STEPS, KINDS = 32, 4
RUN = 256
_EXTRA = 7


def text_view(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    counts = ta.ngram_counts(buf, offs, DIMS)
    v = np.log1p(counts)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    n = np.maximum(np.diff(offs), 1)
    before = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    share = lambda mask: (lambda c: (c[offs[1:]] - c[offs[:-1]]) / n)(before(mask))
    words, at = ta.word_hashes(buf, offs)
    shingles, s_at = ta.shingle_hashes(words, at)
    kinds = lambda x, a: np.array([len(np.unique(x[i:j])) / max(1, j - i) for i, j in zip(a[:-1], a[1:])])
    more = np.stack([
        share((buf >= 65) & (buf <= 90)), share(ta.IS_PUNCT[buf]), share((buf >= 48) & (buf <= 57)), share(buf == 10),
        kinds(words, at), kinds(shingles, s_at), np.minimum(np.log1p(np.diff(at)) / 10, 1),
    ], axis=1)
    return np.hstack([v, more]).astype(np.float32)


def meta_view(places: np.ndarray) -> np.ndarray:
    """One place each for source, language and length, which _inputs has hashed."""
    out = np.zeros((len(places), META), dtype=np.float32)
    out[np.arange(len(places))[:, None], places] = 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-4, steps: int = 300) -> np.ndarray:
    """Weights (the last is the bias) of a regularised logistic model, by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)
    w = np.zeros(x.shape[1], dtype=np.float64)
    weight = weight / weight.sum()
    rate = 1.0 / (0.25 * float((weight[:, None] * x * x).sum()) + l2)
    z, t = w.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ z.astype(np.float32), -30, 30)))
        g = x.T @ (weight * (p - y)).astype(np.float32) + l2 * z
        w_new = z - rate * g
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = w_new + (t - 1) / t_new * (w_new - w)
        w, t = w_new, t_new
    return w


def logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1].astype(x.dtype) + w[-1]


def _places(batch: pa.RecordBatch, rows: slice) -> np.ndarray:
    return np.stack([batch.column(c).slice(rows.start, rows.stop - rows.start).to_numpy() for c in (2, 3, 4)], axis=1)


def features(docs: DataFrame) -> DataFrame:
    """label, key, both views of each row: a bounded sample's way to the driver."""

    def run(batches):
        for b in batches:
            for first, buf, offs in ta.text_chunks(b.column(1)):
                for i, part, at in ta.small_runs(buf, offs, RUN):
                    k = slice(first + i, first + i + len(at) - 1)
                    t = text_view(part, at)
                    m = meta_view(_places(b, k))
                    lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float32())) for x in (t, m)]
                    own = [b.column(c).slice(k.start, k.stop - k.start) for c in (0, 5)]
                    yield pa.RecordBatch.from_arrays([*own, *lists], ["label", "key", "t", "m"])

    return docs.transform(in_batches, run, "label int, key long, t array<float>, m array<float>")


def _views(docs: DataFrame):
    got = features(docs).toArrow().combine_chunks()
    if not got.num_rows:
        return np.zeros(0), np.zeros((0, DIMS + _EXTRA), np.float32), np.zeros((0, META), np.float32)
    mat = lambda c, d: got.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    t, m = mat("t", DIMS + _EXTRA), mat("m", META)
    y = np.array([-1 if v is None else v for v in got.column("label").to_pylist()])
    order = np.lexsort((y, got.column("key").to_numpy()))  # the same rows in the same order, however they arrive
    return y[order], t[order], m[order]


def _inputs(docs: DataFrame, label) -> list:
    """label, the text, and the places of source, language and length in the metadata view. A null, or a column that is missing, is
    a value of its own."""
    has = lambda c, kind: (F.col(c) if c in docs.columns else F.lit(None)).cast(kind)
    place = lambda part, c, at, size: (F.pmod(F.xxhash64(F.lit(part), c), F.lit(size)) + at).cast("int").alias(f"_{part}")
    length = F.floor(F.log2(F.greatest(F.lit(1), has("n_chars", "long"))))
    length = F.when(has("n_chars", "long").isNotNull(), length.cast("long"))
    return [label, F.coalesce("text", F.lit("")).alias("_text"), place("s", has("source", "string"), 0, 160), place("l", has("lang", "string"), 160, 64), place("n", length, 224, 32)]


def _rows_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The inputs of the documents of ids (_id, label _y: a bounded sample), and a key. A repeated doc_id gives one row, the least."""
    rows = docs.select(*_inputs(docs, F.col("doc_id").alias("_doc"))).join(F.broadcast(ids), F.col("_doc") == F.col("_id"))
    least = rows.groupBy("_id", "_y").agg(F.min(F.struct("_text", "_s", "_l", "_n")).alias("_f"))
    return least.select("_y", "_f.*", F.xxhash64("_id").alias("_key"))


def _unlabelled(docs: DataFrame, ids: DataFrame, store=stored) -> DataFrame:
    """The inputs of the documents that are not in ids (_id), and the part of its doc_id that each row is."""
    named = docs.where("doc_id IS NOT NULL").select(*_inputs(docs, F.col("doc_id").alias("_doc")))
    twice = store(named.groupBy("_doc").count().where("count > 1").select(F.col("_doc").alias("_twice"), (1 / F.col("count")).alias("_part")), "repeated")
    rows = named.join(F.broadcast(ids), F.col("_doc") == F.col("_id"), "left_anti").join(few(twice), F.col("_doc") == F.col("_twice"), "left")
    return rows.select(F.coalesce("_part", F.lit(1.0)).alias("_part"), "_text", "_s", "_l", "_n")


def gathered(rows: DataFrame, models: dict) -> dict:
    """By receiving view: (label, step, documents, mean features) of each group of documents that the other view is confident of;
    and under "all" the number of documents. Sums are added up by the tasks and by group; the driver gets one row a group."""
    held = rows.sparkSession.sparkContext.broadcast(models)
    sizes = {"t": DIMS + _EXTRA, "m": META}

    def run(batches):
        models, total = held.value, 0.0
        sums = {v: np.zeros((2 * STEPS * KINDS, 1 + d)) for v, d in sizes.items()}
        for b in batches:
            part = b.column(0).to_numpy(zero_copy_only=False)
            total += part.sum()
            for first, buf, offs in ta.text_chunks(b.column(1)):
                for i, some, at in ta.small_runs(buf, offs, RUN):
                    k = slice(first + i, first + i + len(at) - 1)
                    x = {"t": text_view(some, at), "m": meta_view(_places(b, k))}
                    for v, other in (("t", "m"), ("m", "t")):
                        z = logits(x[other], models[other])
                        step = np.minimum((np.abs(z) - 1) * 4, STEPS - 1).astype(np.int64)
                        group = ((z > 0) * STEPS + step) * KINDS + np.diff(at) % KINDS
                        group[np.abs(z) <= 1] = -1
                        for g in np.unique(group[group >= 0]):
                            own = group == g
                            w = part[k][own]
                            sums[v][g, 0] += w.sum()
                            sums[v][g, 1:] += w @ x[v][own]
        out = [("all", 0, np.array([total]))] + [(v, int(g), s[g]) for v, s in sums.items() for g in np.flatnonzero(s[:, 0])]
        views, groups, lists = zip(*out)
        yield pa.RecordBatch.from_arrays([pa.array(views), pa.array(groups, pa.int32()), pa.array(lists, pa.list_(pa.float64()))], ["view", "group", "sums"])

    def add(table):
        total = np.sum(np.stack([x.values.to_numpy() for x in table.column("sums").combine_chunks()]), axis=0)
        return pa.table({"view": table.column("view")[:1], "group": table.column("group")[:1], "sums": pa.array([total], pa.list_(pa.float64()))})

    schema = "view string, group int, sums array<double>"
    got = rows.transform(in_batches, run, schema).groupBy("view", "group").applyInArrow(add, schema).collect()  # a row a group
    out: dict = {"all": 0.0, "t": [], "m": []}
    for r in sorted(got, key=lambda r: (r["view"], r["group"])):
        if r["view"] == "all":
            out["all"] = r["sums"][0]
        else:
            s = np.array(r["sums"])
            out[r["view"]].append((r["group"] // (STEPS * KINDS), r["group"] // KINDS % STEPS, s[0], (s[1:] / s[0]).astype(np.float32)))
    return out


def most_confident(groups: list, enough: float) -> list:
    """(label, documents, mean features) of the groups of most confidence, at each end up to so many documents. Of the step that
    holds the last of them each group counts in part."""
    out = []
    for label in (0, 1):
        left = enough
        for step in range(STEPS - 1, -1, -1):
            own = [g for g in groups if g[0] == label and g[1] == step]
            n = sum(g[2] for g in own)
            if n and left > 0:
                out += [(label, g[2] * min(1.0, left / n), g[3]) for g in own]
                left -= n
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> dict:
    """The two models, their scales and their mix. A tenth of the sample fits the scales, another tenth the mix; no view has learned
    from either."""
    with working() as brief:
        known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).distinct()
        some = brief(known.orderBy(F.xxhash64("_id"), "_id", "_y").limit(LABELLED), "labelled")  # a bounded sample
        y, t, m = _views(_rows_of(docs, some))
        if len(set(y.tolist())) < 2:
            return {"prior": float(np.mean(y)) if len(y) else 0.5}
        rest = _unlabelled(docs, some.select("_id").distinct(), brief)
        return trained(y, {"t": t, "m": m}, lambda models: gathered(rest, models))


def trained(y: np.ndarray, views: dict, gather) -> dict:
    """Co-training on labelled rows in a fixed order; gather(models) gives the groups of pseudo-labelled documents."""
    turn = np.arange(len(y)) % 10
    for_scale, for_mix = turn == 0, turn == 5
    own_rows = ~(for_scale | for_mix)
    if len(y) < 50:  # too few to spare any
        for_scale = for_mix = own_rows = np.ones(len(y), dtype=bool)
    given: dict = {v: [] for v in views}  # pseudo-labelled groups that each view got from the other

    def train(v):
        own, n = given[v], int(own_rows.sum())
        x = np.vstack([views[v][own_rows], *(g[2][None, :] for g in own)])
        target = np.concatenate([y[own_rows], np.array([g[0] for g in own])])
        pseudo = np.array([g[1] for g in own])
        each = np.concatenate([np.ones(n), pseudo * min(0.5, 0.5 * n / max(pseudo.sum(), 1e-9))])
        share = (each @ target) / each.sum()
        balance = np.where(target == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
        return logistic(x, target, balance * each)

    models = {v: train(v) for v in views}
    for k in range(ROUNDS):
        got = gather(models)
        given = {v: most_confident(got[v], (k + 1) * GIVE * got["all"]) for v in views}
        models = {v: train(v) for v in views}
    scale = {}
    for v in views:  # Platt scaling
        z = logits(views[v][for_scale], models[v])[:, None].astype(np.float32)
        scale[v] = logistic(z, y[for_scale], np.ones(for_scale.sum()), 1e-3, 500)
    both = np.stack([scale[v][0] * logits(views[v][for_mix], models[v]) + scale[v][1] for v in views], axis=1).astype(np.float32)
    return {"w": models, "scale": scale, "mix": logistic(both, y[for_mix], np.ones(for_mix.sum()), 1e-2, 500), "prior": float(y.mean())}


def score(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """doc_id, text_score, meta_score, quality (probabilities), kept (quality of the threshold or more) for each row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = held.value
        squash = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        for b in batches:
            n = b.num_rows
            out = np.full((3, n), model["prior"])
            if "w" in model:
                for first, buf, offs in ta.text_chunks(b.column(1)):
                    for i, part, at in ta.small_runs(buf, offs, RUN):
                        k = slice(first + i, first + i + len(at) - 1)
                        views = {"t": text_view(part, at), "m": meta_view(_places(b, k))}
                        z = np.stack([model["scale"][v][0] * logits(x, model["w"][v]) + model["scale"][v][1] for v, x in views.items()], axis=1)
                        out[0, k], out[1, k] = squash(z[:, 0]), squash(z[:, 1])
                        out[2, k] = squash(logits(z, model["mix"]))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, out), pa.array(out[2] >= threshold)], ["doc_id", "text_score", "meta_score", "quality", "kept"])

    rows = docs.select(*_inputs(docs, F.col("doc_id").cast("long").alias("doc_id")))
    return rows.transform(in_batches, run, "doc_id long, text_score double, meta_score double, quality double, kept boolean")
