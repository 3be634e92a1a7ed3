"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact weighted-shingle similarity.

Texts are lower-cased (A-Z), ASCII punctuation is removed, words are what white space separates. A window has as many words as
the item; a text of fewer words is one window. Shingles have five words; an item of fewer is one shingle of its own length, and its
windows are that long, so it is found wherever its very words stand.

A window of similarity 0.8 has at least 8/9 as many of the item's shingles as the item (counted where they stand in the text), so
only windows with that many are fingerprinted: every one of them, wherever edits have moved it. Fingerprints (64 bits) are looked
up in 8 blocks of 8 bits; two that differ in at most RADIUS = 23 bits differ in at most 2 bits in some block, so all items within
the radius are found. Weighted Jaccard similarity over counted shingles decides. SimHash puts a window of similarity 0.8 about
10 bits from its item (deviation 3), so one in 100,000 such windows would lie beyond the radius. Blocks that many bits wide pass
most fingerprints; what keeps the candidates few is that a window is only held against items whose shingles it has.

Documents and items without words match nothing. Null doc_id and null item_id are kept in the result as null. Repeated rows each
count. Of windows of equal similarity the first is given. Very long texts are searched whole, in runs of windows. Empty tables give
an empty result; columns that clash don't matter, as only ids and texts are read. Items travel in blocks of BLOCK_BYTES of text;
the documents are read once a block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textarrays as ta
from .common import in_batches

SIMILARITY, RADIUS, BLOCK_BYTES = 0.8, 23, 32 << 20
#: Windows fingerprinted at once, and words that they may span.
RUN, SPAN = 2048, 16_384
_NEAR = np.array([[bin(a ^ b).count("1") <= RADIUS // 8 for b in range(256)] for a in range(256)])
_ONES = np.array([bin(x).count("1") for x in range(256)], dtype=np.int64)


def _signs(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each hash."""
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1)  # 8 bytes a row


class Items:
    """Items with their shingles, fingerprints and index."""

    def __init__(self, ids: list, texts: list):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        buf = np.frombuffer(b"".join(raw), dtype=np.uint8)
        offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        words, w_at = ta.word_hashes(buf, offs, True)
        sh, at = ta.shingle_hashes(words, w_at)
        stay = np.flatnonzero(np.diff(w_at) > 0)
        self.ids = [ids[i] for i in stay]
        self.words = np.diff(w_at)[stay]
        self.short = sorted({int(n) for n in self.words if n < 5})
        self.shingles = [sh[at[i] : at[i + 1]] for i in stay]
        self.counted = [np.unique(s, return_counts=True) for s in self.shingles]
        fps = [_fingerprints(_signs(s).sum(axis=0)[None, :]) for s in self.shingles]
        self.fps = np.concatenate(fps) if fps else np.zeros((0, 8), np.uint8)
        flat = np.concatenate([c for c, _ in self.counted]) if self.counted else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(self.ids)), [len(c) for c, _ in self.counted])
        order = np.argsort(flat, kind="stable")
        self.sorted, self.owner = flat[order], owner[order]
        self.bitmap = np.zeros(1 << 20, dtype=bool)
        self.bitmap[(flat >> np.uint64(44)).astype(np.int64)] = True

    def seeds(self, shingles: np.ndarray) -> np.ndarray:
        """Places of shingles that some item has."""
        at = np.flatnonzero(self.bitmap[(shingles >> np.uint64(44)).astype(np.int64)])
        if not len(at) or not len(self.sorted):
            return at[:0]
        pos = np.minimum(np.searchsorted(self.sorted, shingles[at]), len(self.sorted) - 1)
        return at[self.sorted[pos] == shingles[at]]

    def candidates(self, fps: np.ndarray, items: np.ndarray) -> tuple:
        """(window, item) pairs, of windows and some items, whose fingerprints differ in at most RADIUS bits."""
        maybe = np.zeros((len(fps), len(items)), dtype=bool)
        for b in range(8):
            maybe |= _NEAR[fps[:, b][:, None], self.fps[items, b][None, :]]
        w, i = np.nonzero(maybe)
        apart = _ONES[fps[w] ^ self.fps[items[i]]].sum(axis=1)
        ok = apart <= RADIUS
        return w[ok], items[i[ok]], apart[ok]

    def similarity(self, window: np.ndarray, item: int) -> float:
        a, na = np.unique(window, return_counts=True)
        b, nb = self.counted[item]
        at = np.minimum(np.searchsorted(b, a), len(b) - 1)
        same = b[at] == a
        both = int(np.minimum(na[same], nb[at[same]]).sum())
        return both / (len(window) + int(nb.sum()) - both)

    @staticmethod
    def _runs(starts: np.ndarray):
        """The starts in runs of RUN at most that lie at most SPAN apart, so that memory doesn't grow with the text."""
        at = 0
        while at < len(starts):
            stop = min(at + RUN, int(np.searchsorted(starts, starts[at] + SPAN)))
            yield starts[at:stop]
            at = stop

    def _owned(self, shingles: np.ndarray, seeds: np.ndarray):
        """(item, places of its shingles) for the items that have any of them."""
        lo, hi = (np.searchsorted(self.sorted, shingles[seeds], side=s) for s in ("left", "right"))
        n = hi - lo
        rows = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item, place = self.owner[rows], np.repeat(seeds, n)
        order = np.lexsort((place, item))
        item, place = item[order], place[order]
        cuts = np.flatnonzero(np.diff(item)) + 1
        return zip(item[np.concatenate([[0], cuts])], np.split(place, cuts)) if len(item) else ()

    def _starts(self, item: int, places: np.ndarray, n_shingles: int) -> np.ndarray:
        """Starts of all windows with enough of the item's shingles for similarity 0.8; n_shingles: those of the text."""
        per, own = min(len(self.shingles[item]), n_shingles), len(self.shingles[item])
        need = -(-4 * (per + own) // 9)  # c / (per + own - c) >= 4/5, exactly
        if len(places) < need:
            return places[:0]
        # a window holds places k to k + need - 1 for some k: its start lies between the last's reach and the first
        first, last = places[: len(places) - need + 1], places[need - 1 :]
        lo, hi = np.maximum(last - per + 1, 0), np.minimum(first, n_shingles - per)
        good = lo <= hi
        lo, hi = lo[good], hi[good]
        n = hi - lo + 1
        return np.unique(np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))

    def matches(self, shingles: np.ndarray, n_words: int, seeds: np.ndarray, per_word: int = 5) -> list:
        """Best window of each item in one text: (item, similarity, bits apart, first word, words). The shingles are of per_word words
        each (of all words, if the text has fewer)."""
        by_length: dict = {}
        for item, places in self._owned(shingles, seeds):
            if (self.words[item] < 5) != (per_word < 5) and n_words >= 5 or per_word < 5 and self.words[item] != per_word:
                continue
            starts = self._starts(int(item), places, len(shingles))
            if len(starts):
                by_length.setdefault(min(len(self.shingles[item]), len(shingles)), []).append((int(item), starts))
        best: dict = {}
        for per, group in by_length.items():
            items = np.array([i for i, _ in group])
            for at in self._runs(np.unique(np.concatenate([s for _, s in group]))):
                lo, hi = int(at[0]), min(int(at[-1]) + per, len(shingles))
                sums = np.zeros((hi - lo + 1, 64), dtype=np.int32)
                np.cumsum(_signs(shingles[lo:hi]), axis=0, out=sums[1:])
                fps = _fingerprints(sums[at + per - lo] - sums[at - lo])
                for w, i, apart in zip(*self.candidates(fps, items)):
                    first = int(at[w])
                    sim = self.similarity(shingles[first : first + per], int(i))
                    if sim >= SIMILARITY and (sim, -first) > best.get(int(i), (0, 0))[:2]:
                        best[int(i)] = (sim, -first, int(apart), min(int(self.words[i]), n_words))
        return [(self.ids[i], sim, apart, -first, length) for i, (sim, first, apart, length) in sorted(best.items())]

    def of_text(self, words: np.ndarray, shingles: np.ndarray) -> list:
        """matches() of one text, given its words and shingles."""
        out = self.matches(shingles, len(words), self.seeds(shingles)) if len(shingles) else []
        for n in self.short if len(words) >= 5 else [n for n in self.short if n < len(words)]:
            runs = ta.run_hashes(words, n)
            out += self.matches(runs, len(words), self.seeds(runs), n)
        return out


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item that it has a window of: doc_id, item_id, similarity, bits_apart, first_word, n_words."""
    spark = docs.sparkSession
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    schema = "doc_id long, item_id long, similarity double, bits_apart int, first_word long, n_words long"
    names = [x.split()[0] for x in schema.split(", ")]
    out = None
    blocks = 1 if total <= BLOCK_BYTES else -(-2 * total // BLOCK_BYTES)
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = part.collect()  # a block of a stated query set, about BLOCK_BYTES
        held = spark.sparkContext.broadcast(([r["item_id"] for r in rows], [r["text"] for r in rows]))

        def run(batches, held=held):
            index = Items(*held.value)
            for batch in batches:
                ids, found = batch.column(0), []
                for first, buf, offs in ta.text_chunks(batch.column(1)):
                    words, w_at = ta.word_hashes(buf, offs, True)
                    shingles, at = ta.shingle_hashes(words, w_at)
                    seeds = index.seeds(shingles)
                    look = np.arange(len(at) - 1) if index.short else np.unique(np.searchsorted(at, seeds, side="right") - 1)
                    for d in look:
                        got = index.of_text(words[w_at[d] : w_at[d + 1]], shingles[at[d] : at[d + 1]])
                        if got:
                            doc = ids[first + int(d)].as_py()
                            found += [(doc, *m) for m in got]
                if found:
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)

        rows_of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(in_batches, run, schema)
        out = rows_of if out is None else out.unionByName(rows_of)
    return out
