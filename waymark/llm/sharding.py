"""Shards of equal bytes: a minimax contiguous partition of ordered atomic groups.

Groups are equal texts (null is one group, the empty text another); they are ordered by the hash of the text and never
split. The smallest feasible capacity is found by binary search with a greedy check. The order's prefix sums are held in
buckets of the hash; only buckets in which a cut may fall are refined, so the driver holds a bounded table at every size.
Repeated rows are rows of one group. A very long text is one group like others, and if it is larger than an even share, the
capacity is its size. Equal hashes of different texts would make one group; ties in size change nothing, as the order is that of
the hash. An empty table gives an empty result. Rows with a null doc_id are placed like others.
Columns besides doc_id and text are ignored."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, Window, functions as F

from .common import removed, stored

#: The driver first holds 2**FIRST_BITS ranges of the order; a range in which a cut may fall is split into 2**MORE_BITS.
FIRST_BITS, MORE_BITS, KEY_BITS = 12, 6, 60
#: Rows that one task numbers, about.
SLOT_ROWS = 200_000


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the place of the text in the order: two 63-bit halves of its hash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.when(F.col("text").isNull(), F.lit("null")).otherwise(F.md5(F.encode(F.col("text"), "UTF-8")))
    half = lambda at: F.conv(F.substring(F.md5(digest), at, 15), 16, 10).cast("long")  # noqa: E731  60 bits
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        half(1).alias("k1"),
        half(16).alias("k2"),
    )


def reach(pieces: list, capacity: int, n_shards: int, split: bool) -> list:
    """The greedy check: where each shard ends, in bytes, if every shard takes as much as fits.

    pieces: (end in bytes, whether it may be split). A piece of several groups counts as whole, which is pessimistic, or
    with split as divisible, which is optimistic. The last end is the total if and only if the capacity is enough."""
    ends, at, out = [e for e, _ in pieces], 0, []
    for _ in range(n_shards):
        stop = at + capacity
        i = bisect_right(ends, stop)
        if i == len(ends):
            stop = ends[-1]
        elif not (split and pieces[i][1]):
            stop = max(at, ends[i - 1] if i else 0)
        out.append(stop)
        at = stop
    return out


def smallest(pieces: list, n_shards: int, split: bool) -> int:
    """Binary search for the smallest capacity that the greedy check finds enough."""
    total = pieces[-1][0]
    lo, hi = -(-total // n_shards), total
    while lo < hi:
        mid = (lo + hi) // 2
        if reach(pieces, mid, n_shards, split)[-1] == total:
            hi = mid
        else:
            lo = mid + 1
    return lo


def even_cuts(ends: list, capacity: int, n_shards: int) -> list:
    """Indexes of the last piece of each shard but the last: of the cuts that keep to the capacity, the most even ones.

    Greedy from the right gives the earliest place of each cut from which the rest still fits; from the left each cut goes
    to the piece nearest to its even share between that place and the capacity."""
    total, earliest = ends[-1], [0] * (n_shards + 1)
    earliest[n_shards] = total
    for s in range(n_shards - 1, 0, -1):
        need = earliest[s + 1] - capacity
        earliest[s] = ends[bisect_left(ends, need)] if need > 0 else 0
    cuts, at = [], 0
    for s in range(1, n_shards):
        share = total * s // n_shards
        top = bisect_right(ends, min(at + capacity, total)) - 1
        i = min(max(bisect_left(ends, max(earliest[s], at)), 0), top)
        j = bisect_left(ends, share)
        best = min((k for k in (j - 1, j) if i <= k <= top), key=lambda k: abs(ends[k] - share), default=i if ends[i] > share else top)
        if best < 0 or ends[best] <= at and earliest[s] <= at:
            continue
        cuts.append(best)
        at = ends[best]
    return [c for c in dict.fromkeys(cuts) if c < len(ends) - 1]


def plan_cuts(groups: DataFrame, n_shards: int, first_bits: int = FIRST_BITS, more_bits: int = MORE_BITS) -> tuple:
    """The minimax capacity over all groups (k1, k2, bytes), and for each shard but the last the key of its last group.

    A first table has the bytes of 2**first_bits ranges of the hash. The optimistic and the pessimistic check bound the
    capacity from below and above; only ranges in which a cut of such a capacity can fall are split by more bits, until both
    bounds meet. The cuts of the pessimistic check then end at groups and need no more than the smallest capacity."""
    table, bits, inside = {}, first_bits, None
    while True:
        shift = max(0, KEY_BITS - bits)
        whole = bits > KEY_BITS  # beyond the first half of the key: group by group
        rows = groups
        if inside is not None:
            rows = rows.where(F.shiftright("k1", max(0, KEY_BITS - bits + more_bits)).isin(inside))
        by = rows.groupBy("k1", "k2") if whole else rows.groupBy(F.shiftright("k1", shift).alias("p"))
        for r in by.agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("g"), F.max(F.struct("k1", "k2")).alias("last")).collect():
            table[tuple(r["last"])] = (r["b"], r["g"])
        if not table:
            return 0, []
        keys, pieces, total = sorted(table), [], 0
        for k in keys:
            total += table[k][0]
            pieces.append((total, table[k][1] > 1))
        low, high = smallest(pieces, n_shards, True), smallest(pieces, n_shards, False)
        if low == high:
            return high, [keys[i] for i in even_cuts([e for e, _ in pieces], high, n_shards)]
        large = [k for k in keys if table[k][1] > 1 and table[k][0] > low]
        if not large:
            ends = [e for e, _ in pieces]
            spans = zip(reach(pieces, low, n_shards, False), reach(pieces, high, n_shards, True))
            near = {i for a, b in spans for i in range(bisect_right(ends, a), min(len(ends) - 1, bisect_right(ends, b)) + 1)}
            large = [keys[i] for i in sorted(near) if pieces[i][1]]
        inside = [k[0] >> shift for k in large]
        for k in large:
            del table[k]
        bits += more_bits


def shard(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """Every row's shard and its slot in it: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: law `bytes`)."""
    rows = stored(sized(docs).withColumn("row", F.monotonically_increasing_id()), "sized")
    groups = stored(rows.groupBy("k1", "k2").agg(F.sum("size").alias("bytes")), "groups")
    _, lasts = plan_cuts(groups, n_shards)
    removed(groups)
    n = rows.count()
    number = F.lit(0)
    for k1, k2 in lasts:
        number = number + F.when((F.col("k1") > k1) | ((F.col("k1") == k1) & (F.col("k2") > k2)), 1).otherwise(0)
    # slots: rows of a shard are dealt over small blocks by their stored number, so copies and repeated rows spread alike; a
    # block's first slot is the rows in blocks before it
    blocks = max(1, -(-n // (SLOT_ROWS * n_shards)) * 8)
    placed = rows.withColumn("shard", number.cast("int")).withColumn("_block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    counts = placed.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("shard", "_block").orderBy("row")
    out = placed.withColumn("_at", F.row_number().over(within) - 1).join(first, ["shard", "_block"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_first") + F.col("_at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
