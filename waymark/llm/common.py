"""What the text operators share: stored intermediate tables and row filters by id."""

from __future__ import annotations

import ctypes
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.shared import removed, shared_folder, stored  # noqa: F401  part of what the operators share

#: Words are runs of anything but these six characters: space, tab, LF, VT, FF, CR.
SPACES = " \t\n\x0b\x0c\r"
#: Rows of eight-byte ids that a broadcast may hold (about 64 MB as a hashed relation); more are shuffled.
BROADCAST_IDS = 1_000_000
#: Rows of one Arrow batch, and the setting of Spark with its default.
BATCH_ROWS, _BATCH, _DEFAULT = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def give_all_back() -> None:
    """Gives this process's freed memory back to the system, where the C library has a call for that."""
    getattr(ctypes.CDLL(None), "malloc_trim", int)(0)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    """The words of a text as an array; empty for null."""
    one_space = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.filter(F.split(one_space, " "), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with value worked out once, however often the body's own lambdas refer to it."""
    return F.get(F.transform(F.array(value), body), 0)


def in_batches(rows: DataFrame, run, schema) -> DataFrame:
    """rows.mapInArrow(run, schema) in small batches, with Arrow's freed memory given back after each, and all freed memory at
    the end: a worker lives on, idle or in other stages. A session that has Spark's default of rows a batch gets BATCH_ROWS, as rows with whole texts are wide."""
    conf = rows.sparkSession.conf
    if conf.get(_BATCH, _DEFAULT) == _DEFAULT:
        conf.set(_BATCH, str(BATCH_ROWS))

    def each(batches):
        give_back = pa.default_memory_pool().release_unused
        for out in run(batches):
            yield out
            del out
            give_back()
        give_back()
        give_all_back()

    return rows.mapInArrow(each, schema)


@contextmanager
def working():
    """A stored() whose tables end with the block: for what an operator needs on its way to its own result."""
    made: list = []

    def store(df: DataFrame, name: str) -> DataFrame:
        made.append(stored(df, name))
        return made[-1]

    try:
        yield store
    finally:
        removed(*made)


def unused(df: DataFrame) -> str:
    """A name that no column of df has."""
    return "_" * (1 + max(map(len, df.columns)))


def few(ids: DataFrame) -> DataFrame:
    """ids, broadcast if its counted rows are at most BROADCAST_IDS."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def without_ids(docs: DataFrame, ids: DataFrame, how: str = "left_anti", of: Column | None = None) -> DataFrame:
    """docs without (or with "left_semi": only) the rows whose doc_id (or the key `of`) is in ids, which has one bigint column of
    distinct ids.

    ids is broadcast if its counted rows are at most BROADCAST_IDS, else both sides are shuffled."""
    key = ids.columns[0]
    own = unused(docs)
    right = few(ids.select(F.col(key).alias(own)))
    return docs.join(right, (docs["doc_id"] if of is None else of) == F.col(own), how)
