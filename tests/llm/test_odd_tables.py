"""Every text operator on tables with clashing column names, nulls, repeated rows and very long texts, and on empty tables."""

import pytest
from pyspark.sql import functions as F

from waymark.llm import bpe, cotraining, decontaminate, html_text, jaccard_join, language_id, license_scan, pii, quality_rules, sharding

public_tokenizers = pytest.importorskip("public_tokenizers")

#: Names that operators use inside or return, as extra columns of their inputs.
CLASHING = ("_id", "_y", "_l", "_lang", "_letter", "_k", "_text", "_source", "_below", "_drop_id", "_r", "_q", "_z", "label", "t", "m", "n", "h", "s", "p", "a", "b", "d", "df", "cells", "rep",
            "count", "size", "bytes", "text_crc32", "law", "shard", "slot", "grown_shard", "k1", "k2", "digest", "licence", "line_licences", "held_out", "score", "lang_pred", "rejected", "quality",
            "kept", "fail_bits", "n_words", "base_failed", "n_tokens", "ids", "ids_sha256", "spans", "n_email", "component_id", "n_shingles", "item_id", "similarity", "places", "set", "words")
LONG = " ".join(f"word{i % 977} of{i % 13}" for i in range(40_000))
PLAIN = "The quick brown fox jumps over the lazy dog while seven grey geese fly across a quiet lake at dawn, and nobody sees them go."


def odd(df):
    return df.withColumns({c: F.lit("x") if i % 2 else F.lit(None).cast("int") for i, c in enumerate(CLASHING) if c not in df.columns})


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, PLAIN, "en", "s", 120), (1, PLAIN, "en", "s", 120), (2, PLAIN, "en", None, None), (3, None, None, None, None), (4, "", "en", "s", 0), (None, PLAIN, "en", "s", 1), (None, None, None, None, None),
            (5, LONG, "yy", "s", len(LONG)), (6, " \t\n", None, "s", 3), (7, "日本語 текст é", "yy", "t", 9), (1, "another text of the same id", "en", "s", 27)]
    return odd(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).repartition(2)


def model(docs):
    return language_id.fit(docs, F.lit(True))


def labelled(docs):
    spark = docs.sparkSession
    return odd(spark.createDataFrame([(1, 1), (1, 1), (4, 0), (5, 0), (7, 1), (None, 1), (2, None)], "doc_id long, quality int"))


def vocabulary():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read()


#: Operators that return one row for each row of docs.
ROWWISE = {
    "jaccard": jaccard_join.jaccard_components,
    "language": lambda d: language_id.predict(d, model(d)),
    "sharding": lambda d: sharding.shard(d, 4),
    "cotraining": lambda d: cotraining.score(d, cotraining.fit(d, labelled(d))),
    "licences": license_scan.scan,
    "pii": pii.find,
    "redact": pii.redact,
    "rules": lambda d: quality_rules.apply_policy(quality_rules.ledger(d)),
    "bpe": lambda d: bpe.token_rows(d, vocabulary(), public_tokenizers.PATTERN),
}


@pytest.mark.parametrize("name", ROWWISE)
def test_every_row_gets_its_own(docs, name):
    out = ROWWISE[name](docs)
    count = lambda df: sorted((r.doc_id is not None, r.doc_id or 0) for r in df.select("doc_id").collect())
    assert count(out) == count(docs)


@pytest.mark.parametrize("name", ROWWISE)
def test_empty_table(docs, name):
    assert ROWWISE[name](docs.where("false")).collect() == []


def test_values_of_null_and_empty_text(docs):
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    assert got[3].spans == got[4].spans == "" and got[3].n_email == 0
    got = {r.doc_id: r for r in ROWWISE["rules"](docs).collect()}
    assert got[3].n_words == got[4].n_words == got[6].n_words == 0 and got[3].base_failed and not got[3].kept
    got = {r.doc_id: r for r in ROWWISE["bpe"](docs).collect()}
    assert got[3].n_tokens == got[4].n_tokens == 0 and got[5].n_tokens > 80_000
    got = {r.doc_id: r for r in ROWWISE["language"](docs).collect()}
    assert got[3].lang_pred == got[4].lang_pred == got[6].lang_pred == "und" and got[5].lang_pred == "yy"
    got = {(r.doc_id, r["size"]) for r in ROWWISE["sharding"](docs).collect()}
    assert {(3, 8), (4, 8), (5, 8 + len(LONG)), (7, 8 + len("日本語 текст é".encode()))} <= got


def test_redaction_keeps_all_columns(docs):
    assert pii.redact(docs).columns == docs.columns


def test_decontamination_of_odd_tables(spark, docs):
    items = odd(spark.createDataFrame([(1, PLAIN), (1, PLAIN), (2, None), (3, ""), (None, "one two three four five six seven eight")], "item_id long, text string").drop("x"))
    assert {r.doc_id for r in decontaminate.contaminated(docs, items).collect()} - {None} == {1, 2}
    assert decontaminate.contaminated(docs.where("false"), items).collect() == []
    assert decontaminate.contaminated(docs, items.where("false")).collect() == []


def test_extraction_of_odd_tables(spark):
    rows = [(1, "u", f"<html><body><nav><a href=x>Home</a></nav><p>{PLAIN}</p><p>{PLAIN}</p></body></html>"), (2, None, None), (3, "u", ""), (None, "u", "<p>"), (1, "u", "<<<>>>&amp;&#x0;&bogus;"), (4, "u", f"<article><p>{LONG}</p></article>")]
    pages = odd(spark.createDataFrame(rows, "page_id long, url string, html string")).drop("n_chars")
    got = html_text.extract(pages).collect()
    assert len(got) == len(rows) and all(r.text is not None and r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r for r in got if r.page_id != 1}
    assert by[2].text == by[3].text == "" and by[4].text == LONG
    assert html_text.extract(pages.where("false")).collect() == []


def test_pipeline_stages_keep_all_columns(spark, docs, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, LONG[:300])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, rows, str(tmp_path)).columns == docs.columns, name
    kept = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"](spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept) == [(False, 0)] * 2 + [(True, k) for k in (1, 3, 4, 5, 6, 7)]


def test_windows_of_a_long_text_in_runs():
    import numpy as np

    starts = np.array([0, 1, 5, 20_000, 20_001, *range(60_000, 66_000)])
    runs = list(decontaminate.Items._runs(starts))
    assert np.concatenate(runs).tolist() == starts.tolist()
    assert all(len(r) <= decontaminate.RUN and r[-1] - r[0] < decontaminate.SPAN for r in runs)
