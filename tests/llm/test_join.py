"""The Jaccard join on crowded regions, and stored results under derived frames."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import common, components, jaccard_join, sharding

from test_llm import DOCS, brute_components

WORDS = [f"v{i}" for i in range(5000)]


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS).repartition(4)


def check(spark, texts, region):
    got = jaccard_join.jaccard_components(table(spark, texts), region).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(list(enumerate(texts)))


def test_a_long_common_passage_makes_no_blocks(spark, monkeypatch):
    """Documents that are mostly one notice are told apart by their own words, without blocks of all against all."""
    monkeypatch.setattr(jaccard_join, "_block_links", None)
    rng = random.Random(21)
    notice = " ".join(rng.choices(WORDS, k=200))
    texts = [" ".join(rng.choices(WORDS, k=100)) + " " + notice + " " + " ".join(rng.choices(WORDS, k=30)) for _ in range(150)]
    texts += [t + " more" for t in texts[:20]]
    check(spark, texts, 16)


def test_crowds_that_rarity_does_not_part(spark, monkeypatch):
    """Many texts made of the same sentences: what the rounds by rarity leave meets in blocks."""
    used, block_links = [], jaccard_join._block_links
    monkeypatch.setattr(jaccard_join, "_block_links", lambda *a: used.append(1) or block_links(*a))
    rng = random.Random(22)
    parts = [" ".join(rng.choices(WORDS, k=12)) for _ in range(24)]
    texts = []
    for _ in range(160):
        chosen = sorted(rng.sample(range(24), 16))
        texts.append(" . ".join(parts[k] for k in chosen))
    check(spark, texts, 4)
    assert used


def near_copies(rng, n, changed):
    base = rng.choices(WORDS, k=80)
    texts = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(changed)):
            w[rng.randrange(80)] = rng.choice(WORDS)
        texts.append(" ".join(w))
    return texts


def test_a_small_crowd_meets_at_once(spark, monkeypatch):
    """One group of near copies in a larger table costs no rounds of small jobs."""
    monkeypatch.setattr(jaccard_join, "rare_regions", None)
    used, block_links = [], jaccard_join._block_links
    monkeypatch.setattr(jaccard_join, "_block_links", lambda *a: used.append(1) or block_links(*a))
    rng = random.Random(24)
    check(spark, near_copies(rng, 24, 9) + [" ".join(rng.choices(WORDS, k=80)) for _ in range(300)], 4)
    assert used


@pytest.mark.parametrize("run, most", [(20_000, 2), (4, 99)])
def test_few_edges_are_settled_without_steps(spark, monkeypatch, run, most):
    made, stored = [], components.stored
    monkeypatch.setattr(components, "stored", lambda df, name: made.append(name) or stored(df, name))
    monkeypatch.setattr(components, "RUN", run, raising=False)
    edges = [(i, i + 1) for i in range(0, 40)] + [(200 - i, 90) for i in range(30)] + [(7, 7), (300, 301), (301, 300), (190, 300)]
    random.Random(25).shuffle(edges)
    got = components.components(spark.createDataFrame(edges, "u long, v long").repartition(5), stored)
    want = {i: 0 for i in range(41)} | {k: 90 for k in (90, *range(171, 201), 300, 301)}
    assert {r.node: r.root for r in got.collect()} == want
    assert made.count("edges") <= most


@pytest.mark.parametrize("columns", [4096, 5])
def test_common_shingles_of_a_block(monkeypatch, columns):
    monkeypatch.setattr(jaccard_join, "COLUMNS", columns)
    rng = random.Random(26)
    sets = [np.array(sorted(rng.sample(range(60), rng.randrange(1, 50))), dtype=np.uint64) for _ in range(30)]
    rows, cols = np.arange(3, 20), np.arange(10, 30)
    want = [[len(np.intersect1d(sets[i], sets[j])) for j in cols] for i in rows]
    assert jaccard_join._commons(sets, rows, cols).tolist() == want


def test_sets_of_a_document_with_many_places(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PLACES", 3)
    rng = random.Random(23)
    base = rng.choices(WORDS, k=80)
    texts = []
    for _ in range(120):
        w = list(base)
        for _ in range(rng.randrange(8)):
            w[rng.randrange(80)] = rng.choice(WORDS)
        texts.append(" ".join(w))
    check(spark, texts, 4)


def test_results_outlive_their_frames(spark):
    docs = table(spark, [" ".join(random.Random(k % 7).choices(WORDS, k=30)) for k in range(40)])
    joined = jaccard_join.jaccard_components(docs).select("doc_id", "component_id").where("doc_id < 20")
    dealt = sharding.shard(docs, 4).select("doc_id", "shard")
    import gc

    gc.collect()
    assert joined.count() == 20 and dealt.count() == 40 and joined.join(dealt, "doc_id").count() == 20
    again = sharding.shard(docs, 4).groupBy("shard").agg(F.sum("size").alias("n"))
    gc.collect()
    assert again.agg(F.sum("n")).first()[0] == sum(len(r.text) + 8 for r in docs.collect())


def test_working_tables_end_with_their_block(spark):
    def files():
        top = common.shared_folder(spark).removeprefix("file:")
        return set(os.listdir(top))

    before = files()
    with common.working() as store:
        store(spark.range(3), "x")
        assert len(files() - before) == 1
    docs = table(spark, ["a b c d e f", "a b c d e f g"])
    jaccard_join.jaccard_components(docs)
    left = files() - before
    assert len(left) == 1 and left.pop().startswith("joined")


def test_cluster_without_a_shared_folder(spark):
    class NoCluster:
        conf = type("C", (), {"get": staticmethod(lambda key, default: None)})
        sparkContext = type("S", (), {"_jsc": type("J", (), {"sc": staticmethod(lambda: type("X", (), {"isLocal": staticmethod(lambda: False)}))})})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(NoCluster)


def test_one_row_repeated_many_times(spark):
    """A third of all rows may be one row: its slots are dealt over the blocks like others'."""
    docs = spark.createDataFrame([(1, "same", None, None, None)] * 300 + [(i, f"t{i}", None, None, None) for i in range(600)], DOCS).repartition(5)
    rows = sharding.shard(docs, 3).collect()
    for s in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert len({r.shard for r in rows if r.doc_id == 1 and r["size"] == 12}) == 1
