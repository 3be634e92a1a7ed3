"""N-gram Jaccard join: all links of similarity 0.8 or more between sets of 5-word shingles, and their components.

The metric is the Jaccard distance d = 1 - J, the radius R = 0.2. The join runs in levels of regions.

1. Single shingles are the pivots. d(x, {s}) is 1 - 1/|x| if s is in x, else 1, so a document lies in the Voronoi regions of
   its own shingles; hash order, then rarity, says which come first. By the triangle inequality a document y within R of x
   lacks at most |x| - ceil(0.8 |x|) of x's shingles, so x is replicated to a window of that many regions and one more:
   among them is one that y shares. The window is widened by L - 1 regions, whose sizes are then counted, and each document
   leaves its L' - 1 most crowded ones (L' is the L of the smallest possible partner): linked documents share L regions and
   each leaves only the more crowded of them, so at least one is left. Passages that many documents share thus make no pairs.
2. In each shingle's region the smallest member is the document pivot. Members that are with the same pivot form a region,
   in which distances to the pivot are computed exactly. Members within R of it are one component; others meet the members
   that the window |d(x,p) - d(y,p)| <= R leaves, until they are linked. Larger regions than REGION are dealt out in parts,
   each of which has the pivot.
3. Of regions in several parts, the members that no link so far connects with the pivot, and the boundary of its component
   (the window again), are crowded. If the blocks of 4 send at most AT_ONCE times the shingles of the corpus, they meet there
   at once, as a round costs some fifty small jobs. Else they are joined anew by the rules of 1 and 2, with the shingles now in
   order of rarity among them: of x's shingles the |x| - ceil(0.8 |x|) + 1 rarest are its regions. What the members of a region
   have in common is the commonest of their shingles and gives no region, so a long notice on many pages costs each page its
   own shingles once. This repeats while the crowd shrinks to less than HALVED of what it was.
4. What is left then are documents most of whose shingles most of the others have, unlinked all the same. They meet in blocks,
   dealt by bands of the distance to their pivot, of which the window leaves only neighbours. A block's common shingles are
   counted at once, as products of tables of its sets.

Each computed similarity is exact on sets of 64-bit shingle hashes. Whole documents as the only pivots would be of no use:
nearly all distances in a corpus of texts are 1, and a window of 2R then holds all documents.

Null and empty texts and texts without words have no shingles and link with nothing; texts of fewer than five words are one
shingle. Equal sets form one class, so copies are linked through it and not as pairs. A very long text is one set like others; a
task holds one region's part at a time. Ties in rarity go by the shingle's hash, which changes no result. A row with a null
doc_id takes part in nothing: its component_id is null. Repeated rows each get a row. An empty table gives an empty result.
Other columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import textarrays as ta
from .common import BROADCAST_IDS, in_batches, stored, working
from .components import Union as _Union, components

#: Documents that one task compares with each other at most (a part of a region with its pivot).
REGION = 128
#: A crowd is joined anew by rarity while that makes it less than this share of what it was.
HALVED = 0.5
#: A crowd meets in blocks at once if that sends at most this many times the shingles of all sets.
AT_ONCE = 2
#: Distinct shingles that a table of a block's sets holds at a time.
COLUMNS = 4096
#: Places of one document that travel to its text in one row.
PLACES = 256
#: Rows of shingle regions that one task holds, about.
CELL_ROWS = 1_000_000


def at_least(n):
    """ceil(0.8 n): how many shingles a partner shares at least, and has at least."""
    return (4 * n + 4) // 5


def linked(common, a, b):
    return 100 * common >= 80 * (a + b - common)


def extra(n):
    """L: the regions that linked documents of n shingles or more share; never falls with n. Short documents have more for
    their size, as a passage that many share is a greater part of them."""
    return 1 + min(n // 5, 16 + n // 20)


def _sets(batches, emit):
    """emit(doc ids, list of sorted distinct shingle hashes) for runs of rows (column 0: id, 1: text)."""
    for batch in batches:
        ids = batch.column(0)
        for first, buf, offs in ta.text_chunks(batch.column(1)):
            shingles, at = ta.shingle_hashes(*ta.word_hashes(buf, offs))
            yield emit(ids.slice(first, len(offs) - 1), [np.unique(shingles[a:b]) for a, b in zip(at[:-1], at[1:])])


def _lists(arrays) -> pa.Array:
    offs = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=offs[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(flat.view(np.int64)))


def _handle(s: np.ndarray) -> int:
    """A 63-bit handle of a set."""
    return int(ta.mix(np.array([np.sum(ta.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)))], dtype=np.uint64))[0] >> np.uint64(1)) if len(s) else -1


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), h (handle of the set), cells (the shingles of its window). Copies met before in the same task
    have no cells, so that a large group of copies is small before any shuffle."""

    def run(batches):
        seen = set()

        def emit(ids, sets):
            handles, cells = [], []
            for s in sets:
                h = _handle(s)
                handles.append(h)
                if h in seen or not len(s):
                    cells.append(s[:0])
                else:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(h)
                    cells.append(s[: len(s) - at_least(len(s)) + extra(len(s))])
            sizes = pa.array([len(s) for s in sets], pa.int64())
            return pa.RecordBatch.from_arrays([ids, sizes, pa.array(handles, pa.int64()), _lists(cells)], ["doc_id", "n", "h", "cells"])

        yield from _sets(batches, emit)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(in_batches, run, "doc_id long, n long, h long, cells array<long>")


def _shared_cells(batches):
    """Of (s, h) rows with all rows of each s: distinct rows of shingles that two sets or more have, and how many."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    s, h = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in got]) for k in range(2))
    order = np.lexsort((h, s))
    s, h = s[order], h[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (s[1:] != s[:-1]) | (h[1:] != h[:-1])
    s, h = s[new], h[new]
    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    size = np.diff(np.append(starts, len(s)))
    df = np.repeat(size, size)
    live = df >= 2
    yield pa.RecordBatch.from_arrays([pa.array(x[live]) for x in (s, h)] + [pa.array(df[live].astype(np.int64))], ["s", "h", "df"])


def _counted(rows: DataFrame, n_rows: int) -> DataFrame:
    """(s, h, df) of (h, s) rows: those of shingles that two sets or more have, with the number of these sets.

    Shingles with more than a 2000th of all rows are at most 2000; a sample finds them, whatever the size. They are counted
    with map-side combining and joined by broadcast; all others are dealt out by shingle."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // CELL_ROWS))
    rate = min(1.0, 1e6 / max(1, n_rows))
    found = rows.sample(rate, 7).groupBy("s").count().where(F.col("count") > F.lit(max(1000.0, rate * n_rows / 2000)))
    hot = [r["s"] for r in found.collect()]
    cold = rows if not hot else rows.where(~F.col("s").isin(hot))
    shared = cold.select("s", "h").repartition(parts, "s").transform(in_batches, _shared_cells, "s long, h long, df long")
    if hot:
        warm = rows.where(F.col("s").isin(hot)).distinct()
        crowd = warm.groupBy("s").agg(F.count(F.lit(1)).alias("df"))
        shared = shared.unionByName(warm.join(F.broadcast(crowd), "s").select("s", "h", "df"))
    return shared


def _around_pivots(cells: DataFrame) -> DataFrame:
    """(p, m) of (s, h) rows: sets that share a shingle's region, with its smallest member p."""
    pivots = cells.groupBy("s").agg(F.min("h").alias("p"), F.max("h").alias("_q")).where("p <> _q").select("s", "p")
    return cells.join(pivots, "s").where("p <> h").select("p", F.col("h").alias("m")).distinct()


def document_regions(sigs: DataFrame, store=stored) -> DataFrame:
    """(p, m): sets that lie in a shingle's region, with the region's smallest member p. All linked sets are together in one."""
    rows = sigs.where(F.size("cells") > 0).select("h", F.explode("cells").alias("s"))
    sizes = sigs.groupBy("h").agg(F.min("n").alias("n"))
    shared = _counted(rows, sigs.agg(F.sum(F.size("cells").cast("long"))).first()[0] or 0).join(sizes, "h")
    n = F.col("n")
    partner = F.floor((4 * n + 4) / 5).cast("long")  # the smallest partner's size
    leave = F.least(F.floor(partner / 5), 16 + F.floor(partner / 20)).cast("long")
    crowded = Window.partitionBy("h").orderBy(F.col("df").desc(), "s")
    with working() as brief:
        left = brief(shared.withColumn("_k", F.row_number().over(crowded)).where(F.col("_k") > leave).select("s", "h"), "cells")
        return store(_around_pivots(left), "regions")


def rare_regions(sets: DataFrame, store=stored) -> DataFrame:
    """(p, m) of (m, set) rows, by the rarest shingles of each set: of a set of n the n - ceil(0.8 n) + 1 rarest among all rows.

    Of two linked sets the rarest common shingle is one of these on both sides, as each lacks at most n - ceil(0.8 n) of its own."""
    with working() as brief:
        rows = brief(sets.select(F.col("m").alias("h"), F.explode("set").alias("s")), "shingles")
        shared = _counted(rows, rows.count())
        sizes = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
        n, all_shared = F.col("n"), Window.partitionBy("h")
        ranked = shared.join(sizes, "h").withColumn("_k", F.row_number().over(all_shared.orderBy("df", "s"))).withColumn("_c", F.count(F.lit(1)).over(all_shared))
        # shingles that no other set has are the rarest, so they take their places before the shared ones
        left = ranked.where(n - F.col("_c") + F.col("_k") <= n - F.floor((4 * n + 4) / 5) + 1)
        return store(_around_pivots(brief(left.select("s", "h"), "cells")), "regions")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int(np.count_nonzero(b[at] == a))


def _commons(sets: list, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """How many shingles each of sets[rows] has in common with each of sets[cols]."""
    flat, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, own = flat[order], own[order]
    starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    size = np.diff(np.append(starts, len(flat)))
    own = own[np.repeat(size, size) >= 2]
    size = size[size >= 2]
    column, ends = np.repeat(np.arange(len(size)), size), np.append(0, np.cumsum(size))
    out = np.zeros((len(rows), len(cols)), dtype=np.float32)
    for first in range(0, len(size), COLUMNS):
        a, b = ends[first], ends[min(first + COLUMNS, len(size))]
        has = np.zeros((len(sets), min(COLUMNS, len(size) - first)), dtype=np.float32)
        has[own[a:b], column[a:b] - first] = 1
        out += has[rows] @ has[cols].T
    return out.astype(np.int64)


def _linked_pairs(sets: dict, outer: list, inner: list, dist: dict):
    """Linked pairs of an outer and an inner member, of those that the window leaves."""
    names = sorted({*outer, *inner})
    at, size, d = {m: k for k, m in enumerate(names)}, np.array([len(sets[m]) for m in names]), np.array([dist[m] for m in names])
    rows, cols = (np.array([at[m] for m in side], dtype=np.int64) for side in (outer, inner))
    near = np.abs(d[rows][:, None] - d[cols][None, :]) <= 0.2 + 1e-9
    rows, cols = rows[near.any(axis=1)], cols[near.any(axis=0)]
    near = near[near.any(axis=1)][:, near.any(axis=0)]
    if not near.size:
        return
    common = _commons([sets[m] for m in names], rows, cols)
    near &= linked(common, size[rows][:, None], size[cols][None, :])
    for i, j in zip(*np.nonzero(near)):
        yield names[rows[i]], names[cols[j]]


def join_region(p: int, sets: dict, outer=None, inner=None, known=None, joined=()):
    """Spanning links of the sets of a region around p, exactly; and each member's distance to p.

    outer, inner: if given, only links between the two are sought, with known distances to p; joined are one component."""
    union, links = _Union(), []
    if known is None:
        dist, pivot = {}, sets[p]
        for m, s in sets.items():
            c = _common(s, pivot)
            dist[m] = 1 - c / (len(s) + len(pivot) - c)
            if m != p and linked(c, len(s), len(pivot)):
                union.join(m, p)
                links.append((p, m))
        outer = sorted(m for m in sets if m != p and union.root(m) != union.root(p))
        inner = sorted(sets)
    else:
        dist = known
        for m in joined:
            union.join(m, joined[0])
    if not outer:
        return links, dist
    for x, y in _linked_pairs(sets, outer, [m for m in inner if m != p], dist):
        if union.root(x) != union.root(y):
            union.join(x, y)
            links.append((x, y))
    return links, dist


def _grouped(batches, n_keys: int):
    """Rows of consecutive equal keys (the first n_keys columns), gathered over batches: (key, list of row tuples)."""
    key, rows = None, []
    for b in batches:
        cols = [b.column(k).to_pylist() for k in range(b.num_columns - 1)]
        lists = b.column(b.num_columns - 1)
        for i in range(b.num_rows):
            k = tuple(c[i] for c in cols[:n_keys])
            if k != key:
                if rows:
                    yield key, rows
                key, rows = k, []
            rows.append((*(c[i] for c in cols[n_keys:]), lists[i].values.to_numpy().view(np.uint64)))
    if rows:
        yield key, rows


_LINKS = "kind int, p long, a long, b long, d double"


def _emit(rows):
    if rows:
        kind, p, a, b, d = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), *(pa.array(x, pa.int64()) for x in (p, a, b)), pa.array(d, pa.float64())], ["kind", "p", "a", "b", "d"])


def _first_join(batches):
    """Rows (p, part, parts, m, set) sorted by p and part. Links (kind 0), and members of dealt-out regions (kind 1) with d."""
    out = []
    for (p, _, parts), rows in _grouped(batches, 3):
        sets = {m: s for m, s in rows}
        if p not in sets:
            continue
        links, dist = join_region(p, sets)
        out += [(0, p, a, b, 0.0) for a, b in links]
        if parts > 1:
            out += [(1, p, m, m, d) for m, d in dist.items() if m != p]
        if len(out) > 50_000:
            yield from _emit(out)
            out = []
    yield from _emit(out)


def _second_join(batches):
    """Rows (p, block, m, d, o, outer, set): a block of those outside the pivot's component (o) against a block of all that are
    left. Members that are not outer are one component."""
    out = []
    for (p, _), rows in _grouped(batches, 2):
        sets, known = {r[0]: r[-1] for r in rows}, {r[0]: r[1] for r in rows}
        outer, inner = sorted({r[0] for r in rows if r[2]}), sorted({r[0] for r in rows if not r[2]})
        links, _ = join_region(p, sets, outer, inner, known, [r[0] for r in rows if not r[3]])
        out += [(0, p, a, b, 0.0) for a, b in links]
    yield from _emit(out)


def _placed_sets(docs: DataFrame, placed: DataFrame, classes: DataFrame, fields: str, brief) -> DataFrame:
    """The rows of placed (m and the given fields), each with the set of m, which is worked out beside its text.

    The places of a document travel as lists of PLACES at most to its text, by broadcast if there are few; only the sets are
    then dealt out. Documents with several lists are dealt out by list first, so no task emits all sets of one document."""
    names = [f.split()[0] for f in fields.split(", ")]
    by_rep = brief(placed.join(classes, placed["m"] == classes["h"]).select(*names, "rep"), "placed")
    counts = by_rep.groupBy("rep").agg(F.count(F.lit(1)).alias("_n"))
    n_places, n_many = counts.agg(F.sum("_n"), F.count_if(F.col("_n") > PLACES)).first()
    small = (n_places or 0) <= BROADCAST_IDS // 2
    places = F.collect_list(F.struct(*names)).alias("places")
    if n_many:
        many = counts.where(F.col("_n") > PLACES).select(F.col("rep").alias("_many"), F.ceil(F.col("_n") / PLACES).cast("long").alias("_lists"))
        spread = by_rep.join(F.broadcast(many) if n_many <= BROADCAST_IDS else many, F.col("rep") == F.col("_many"), "left")
        spread = spread.withColumn("_list", F.coalesce(F.pmod(F.xxhash64(*names), "_lists"), F.lit(0)))
        lists = brief(spread.groupBy("rep", "_list", F.col("_many").isNotNull().alias("_far")).agg(places), "places")
    else:
        lists = by_rep.groupBy("rep").agg(places).withColumns({"_list": F.lit(0), "_far": F.lit(False)})
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def beside(own):
        return texts.join(F.broadcast(own) if small else own, texts["doc_id"] == own["rep"]).select("doc_id", "text", "places", "_list")

    rows = beside(lists.where("NOT _far"))
    if n_many:
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.unionByName(beside(lists.where("_far")).repartition(parts, "doc_id", "_list"))
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    types = [kinds[f.split()[1]] for f in fields.split(", ")]

    def run(batches):
        for batch in batches:
            for first, buf, offs in ta.text_chunks(batch.column(1)):
                shingles, at = ta.shingle_hashes(*ta.word_hashes(buf, offs))
                places = batch.column(2).slice(first, len(offs) - 1)
                rows, sets, held = [], [], 0
                for k, (a, b) in enumerate(zip(at[:-1], at[1:])):
                    s = np.unique(shingles[a:b])
                    h = _handle(s)
                    for place in places[k].as_py():
                        if place["m"] == h:  # else another text of a repeated doc_id
                            rows.append([place[x] for x in names])
                            sets.append(s)
                            held += len(s)
                    if held > 1 << 20 or k == len(at) - 2 and rows:
                        cols = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                        yield pa.RecordBatch.from_arrays([*cols, _lists(sets)], [*names, "set"])
                        rows, sets, held = [], [], 0

    return rows.select("doc_id", "text", "places").transform(in_batches, run, f"{fields}, set array<long>")


def _pivot_links(docs: DataFrame, regions: DataFrame, classes: DataFrame, region: int, store) -> DataFrame:
    """The links within each part of the regions, and the members of regions in several parts with their distance (_LINKS)."""
    pivots = regions.groupBy("p").agg(F.count(F.lit(1)).alias("size"))
    pivots = pivots.select("p", F.ceil(F.col("size") / region).cast("int").alias("parts"))
    members = regions.join(pivots, "p").select("p", F.pmod(F.xxhash64("m"), "parts").cast("int").alias("part"), "parts", "m")
    own = pivots.select("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "parts", F.col("p").alias("m"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with working() as brief:
        placed = _placed_sets(docs, members.unionByName(own), classes, "p long, part int, parts int, m long", brief)
        dealt = placed.repartition(n, "p", "part").sortWithinPartitions("p", "part")
        return store(dealt.transform(in_batches, _first_join, _LINKS), "links")


def _unresolved(found: DataFrame, seen: DataFrame, store) -> DataFrame:
    """(p, m, d, outer) of regions in several parts (seen: p, a, d): members that the links found don't connect with the pivot
    (outer), and those of its component that the window leaves beside them. None of a region without outer members."""
    with working() as brief:
        roots = components(found.select(F.col("a").alias("u"), F.col("b").alias("v")), brief)
        rooted = seen.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left")
        rooted = rooted.join(roots.select(F.col("node").alias("p"), F.col("root").alias("rp")), "p", "left")
        rooted = brief(rooted.select("p", F.col("a").alias("m"), "d", (F.coalesce("ra", "a") != F.coalesce("rp", "p")).alias("outer")), "rooted")
        near = rooted.where("outer").groupBy("p").agg(F.min("d").alias("least"))
        return store(rooted.join(near, "p").where("outer OR d >= least - 0.2 - 1e-9").select("p", "m", "d", "outer"), "unresolved")


def _sent_in_blocks(left: DataFrame, classes: DataFrame, region: int) -> int:
    """The shingles of all sets that _block_links sends at most, without regard to bands; 0 if there is nothing to join."""
    n, own = F.col("n").cast("decimal(38,0)"), left.join(classes, left["m"] == classes["h"])
    sums = own.groupBy("p").agg(*(f.alias(k) for side, k in (("outer", "o"), ("NOT outer", "i")) for f, k in (
        (F.ceil(F.count_if(F.expr(side)) / region).cast("decimal(20,0)"), f"{k}_blocks"), (F.coalesce(F.sum(F.when(F.expr(side), n)), F.lit(0)), f"{k}_n"))))
    return int(sums.agg(F.sum(F.expr("o_blocks * (o_n + i_n) + i_blocks * o_n").cast("double"))).first()[0] or 0)


def _block_links(docs: DataFrame, left: DataFrame, classes: DataFrame, region: int, store, brief) -> DataFrame:
    """(a, b): links between outer members and all others of their region, in blocks. Bands of distance to the pivot are as wide
    as the window, so a block meets only blocks of its own band and the two beside it; two outer blocks meet once."""
    rows = left.withColumn("band", F.floor(F.col("d") * 5).cast("int"))
    blocks = rows.groupBy("p", "band", "outer").agg(F.ceil(F.count(F.lit(1)) / region).cast("int").alias("n"))
    blocks = brief(blocks.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1))), "blocks")
    one = blocks.where("outer").select(F.col("p").alias("bp"), F.col("band").alias("rb"), F.col("n").alias("rows"), F.col("k").alias("i"))
    two = blocks.select(F.col("p").alias("cp"), F.col("band").alias("cb"), F.col("outer").alias("co"), F.col("n").alias("cols"), F.col("k").alias("j"))
    once = F.expr("bp = cp AND abs(rb - cb) <= 1 AND (NOT co OR cb > rb OR cb = rb AND j >= i)")
    pairs = one.join(two, once).select("*", F.xxhash64("bp", "rb", "i", "cb", "co", "j").alias("block"))  # of blocks, not documents
    pairs = brief(pairs, "pairs")
    own = lambda band, n, at: (F.col("p") == F.col("bp")) & (F.col("band") == F.col(band)) & (F.pmod(F.xxhash64("m"), n) == F.col(at))
    fields = lambda o: ("p", "block", "m", "d", F.lit(o).alias("o"), "outer")
    sides = rows.where("outer").join(pairs, own("rb", "rows", "i")).select(*fields(True))
    sides = sides.unionByName(rows.join(pairs, own("cb", "cols", "j") & (F.col("outer") == F.col("co"))).select(*fields(False)))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocked = _placed_sets(docs, sides, classes, "p long, block long, m long, d double, o boolean, outer boolean", brief)
    joined = blocked.repartition(n, "p", "block").sortWithinPartitions("p", "block").transform(in_batches, _second_join, _LINKS)
    return store(joined.select("a", "b"), "links")


def links(docs: DataFrame, sigs: DataFrame, classes: DataFrame, region: int = REGION, store=stored) -> DataFrame:
    """(a, b): links that span each component of sets."""
    with working() as brief:
        all_sent = classes.agg(F.sum("n")).first()[0] or 0
        first = _pivot_links(docs, document_regions(sigs, brief), classes, region, store)
        found, seen, crowd_before = first.where("kind = 0").select("a", "b"), first.where("kind = 1"), None
        while not seen.where("d > 0.2").isEmpty():
            left = _unresolved(found, seen.select("p", "a", "d"), brief)
            sent = _sent_in_blocks(left, classes, region)
            if not sent:
                break
            crowd, size = None, 0
            if sent > AT_ONCE * all_sent:
                crowd = brief(left.select("m").distinct(), "crowd")  # pivots have met all of their region
                size = crowd.count()
            if crowd is None or crowd_before is not None and size > HALVED * crowd_before:
                return found.unionByName(_block_links(docs, left, classes, region, store, brief))
            sets = _placed_sets(docs, crowd, classes, "m long", brief)
            more = _pivot_links(docs, rare_regions(sets, brief), classes, region, store)
            found, seen, crowd_before = found.unionByName(more.where("kind = 0").select("a", "b")), more.where("kind = 1"), size
        return found


def jaccard_components(docs: DataFrame, region: int = REGION, handles: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) for every row of docs.

    handles: also h, the handle of the row's set, and root, that of its component; both -1 where it takes part in nothing."""
    with working() as brief:
        all_sigs = brief(signatures(docs), "signatures")
        sigs = all_sigs.where("doc_id IS NOT NULL AND n > 0")
        classes = brief(sigs.groupBy("h").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n")), "classes")
        found = links(docs, sigs, classes, region, brief)
        roots = components(found.select(F.col("a").alias("u"), F.col("b").alias("v")), brief)
        tree = roots.join(classes, roots["node"] == classes["h"])
        smallest = tree.groupBy("root").agg(F.min("rep").alias("least"))
        more = ["root"] if handles else []
        merged = roots.join(smallest, "root").select(F.col("node").alias("h"), "least", *more)
        own_root = [F.coalesce("root", "h").alias("root")] if handles else []
        ids = classes.join(merged, "h", "left").select("h", F.coalesce("least", "rep").alias("component_id"), *own_root)
        out = all_sigs.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("h")).alias("h")).join(ids, "h", "left")
        alone = F.coalesce("component_id", "doc_id")
        marks = [F.when(F.col("doc_id").isNotNull(), F.coalesce(c, F.lit(-1).cast("long"))).otherwise(-1).alias(c) for c in ("h", "root")] if handles else []
        return stored(out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), alone).alias("component_id"), *marks), "joined")
