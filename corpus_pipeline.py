"""The corpus pipeline: documents through quality rules, near-duplicate removal, decontamination, redaction and tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet to the shared folder and
reads it as the next stage's docs. All stages but the last return the columns that they got."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from waymark.llm import bpe, decontaminate, jaccard_join, pii, quality_rules
from waymark.llm.common import few, removed, stored, unused, without_ids, working
from waymark.llm.queries import pattern, read, vocabulary

#: SQL cannot express the stages for documents of this size; tests/llm compares them with brute force.
ORACLE_SQL = None


def by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules keep. The verdict is computed beside the row, so nothing is shuffled. Rows without text are rejected,
    as they have too few words; repeated rows are judged alike; an empty table stays empty."""
    return docs.where(quality_rules.verdict(F.col("text")))


def _row_key(names: list) -> Column:
    """A hash of a whole row; nulls count with their place."""
    return F.xxhash64(*names, *[F.col(f"`{c}`").isNull() for c in names])


def _first(rows: DataFrame, key: Column, names: list) -> DataFrame:
    """One row of each key."""
    held = F.min_by(F.struct(*names), F.xxhash64(*names)).alias("_r")
    return rows.groupBy(key).agg(held).select(*[F.col(f"_r.`{c}`").alias(c) for c in names])


def _without_id(docs: DataFrame) -> DataFrame:
    """Of rows with a null doc_id, one of each component of near duplicates among them; of rows without words, one of each."""
    key = _row_key(docs.columns)
    found = jaccard_join.jaccard_components(docs.select(key.alias("doc_id"), "text"))
    out = without_ids(docs, found.where("doc_id <> component_id").select("doc_id").distinct(), of=key)
    return _first(out, key, docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest doc_id, of each component of near duplicates; one row of each doc_id.

    Of a repeated doc_id the texts are looked at one by one: those that are later near copies go, the others leave one row, of
    the largest component. Where that takes a component's first document, the next one whose doc_id is its own stays instead.
    Rows with a null doc_id are near duplicates of each other only. Rows without words are near no other. An empty table stays
    empty; columns that clash with names used here don't matter."""
    found = jaccard_join.jaccard_components(docs, handles=True)
    drop = found.where("doc_id <> component_id").select("doc_id").distinct()
    named = docs.where("doc_id IS NOT NULL")
    repeated = stored(found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        removed(repeated)
        out = without_ids(named, drop)
    else:
        with working() as brief:
            names, text_key = docs.columns, F.xxhash64("text")
            twice = without_ids(named, repeated, "left_semi")
            sizes = found.where("root <> -1").groupBy("root").agg(F.count(F.lit(1)).alias("size"))
            own = without_ids(found.where("doc_id = component_id"), repeated, "left_semi").select("doc_id", "h", "root").distinct()
            own = brief(own.join(sizes, "root", "left").select("doc_id", "h", "root", F.coalesce("size", F.lit(0)).alias("size")), "own")
            best = own.groupBy("doc_id").agg(F.max_by("root", F.struct("size", "root")).alias("best"))
            own = brief(own.join(best, "doc_id"), "own")
            lost = own.where("root <> best AND root <> -1").select("root", F.col("doc_id").alias("gone")).distinct()
            single = without_ids(found, repeated).join(few(lost), "root").where("doc_id <> gone")
            heirs = stored(single.groupBy("root").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct(), "heirs")
            handles = jaccard_join.signatures(twice.select(text_key.alias("doc_id"), "text")).select(F.col("doc_id").alias("x"), "h").distinct()
            a, b = unused(docs), unused(docs) + "_"
            stay = own.where("root = best").select("doc_id", "h").join(handles, "h").select(F.col("doc_id").alias(a), F.col("x").alias(b))
            stay = stored(stay, "stay")
        first = _first(twice.join(few(stay), (twice["doc_id"] == F.col(a)) & (text_key == F.col(b)), "left_semi"), F.col("doc_id"), names)
        out = without_ids(without_ids(named, repeated), drop.join(heirs, "doc_id", "left_anti")).unionByName(first)
    if not found.where("doc_id IS NULL").isEmpty():
        out = out.unionByName(_without_id(docs.where("doc_id IS NULL")))
    return out


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item. Rows are told by their text, whatever their doc_id, so repeated rows go or
    stay together; rows without text stay. An empty table or an empty benchmark takes nothing away."""
    key = F.xxhash64("text")
    found = decontaminate.contaminated(docs.select(key.alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"))
    return without_ids(docs, stored(found.select("doc_id").distinct(), "contaminated"), of=key)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked: every row, each by itself; rows without text as they are."""
    return pii.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and the digests of each row, repeated ones too; a null text has no ids. Other columns end here."""
    return bpe.token_rows(docs, vocabulary(), pattern())


STAGES = [
    ("quality rules", by_rules),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("PII", redacted),
    ("byte-level BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each from the stored result of the one before."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if k:
            removed(before)
    return docs
