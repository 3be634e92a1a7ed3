"""Byte-level BPE: encoding and decoding by a vocabulary of ranked byte strings.

Each match of the pattern is encoded by itself. A chunk of texts is cut into pieces; pieces that the worker has not met before
are put into length buckets, each a padded numpy matrix of token ids. In each round every row looks up all its adjacent pairs in
an open-addressed hash table, merges its leftmost pair of the least rank, and is compacted; finished rows leave the matrix. A
text's ids are then gathered from those of its pieces, and its bytes from those of its ids. A worker keeps the vocabulary and at
most REMEMBER pieces from task to task; a lost worker only costs their making.

Null text counts as empty; empty text has no tokens; an empty table gets no rows. Of pairs of equal rank the leftmost is merged.
Very long pieces (over LONG bytes) are merged one by one with a heap to the same rule, so that the matrices stay small. Repeated
rows each get a row. Columns besides doc_id and text are ignored."""

from __future__ import annotations

import base64
import hashlib
import heapq
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import in_batches

#: Widths of the matrices; pieces longer than the last are merged with a heap.
BUCKETS = (4, 8, 12, 16, 24, 32, 48, 64, 128, 256)
LONG = BUCKETS[-1]
#: Characters of text that are taken apart at once, and pieces that a worker remembers.
CHUNK, REMEMBER = 1 << 17, 150_000
NONE = np.int32(2**31 - 1)


def _starts(lens) -> np.ndarray:
    """Where each of some runs of the given lengths begins, and the end of the last."""
    out = np.zeros(len(lens) + 1, dtype=np.int64)
    np.cumsum(lens, out=out[1:])
    return out


def _gathered(flat: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple:
    """(the runs of flat that begin at `at`, in the order of which; where each begins)."""
    starts = _starts(at[which + 1] - at[which])
    return flat[np.arange(starts[-1]) + np.repeat(at[which] - starts[:-1], np.diff(starts))], starts


class Vocabulary:
    """Ranks of byte strings, and the hashed table of pairs: (left id, right id) to the merged id, which is its rank."""

    def __init__(self, data: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.bytes, self.byte_at = np.frombuffer(b"".join(self.tokens), dtype=np.uint8), _starts(list(map(len, self.tokens)))
        if lost := [b for b in range(256) if bytes([b]) not in self.ranks]:
            raise ValueError(f"the vocabulary has no token for the bytes {lost}")
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        get, keys, values = self.ranks.get, [], []
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = get(token[:k]), get(token[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self._build(np.array(keys, dtype=np.uint64), np.array(values, dtype=np.int32))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _build(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift = np.uint64(64 - bits)
        size = (1 << bits) + 64
        self.keys = np.full(size, np.uint64(2**64 - 1))
        self.values = np.full(size, NONE)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] == np.uint64(2**64 - 1)
            took, first = np.unique(slot[free], return_index=True)
            rows = np.flatnonzero(free)[first]
            self.keys[took], self.values[took] = keys[left[rows]], values[left[rows]]
            stay = np.ones(len(left), dtype=bool)
            stay[rows] = False
            left, slot = left[stay], slot[stay] + 1

    def merge_rows(self, pieces: list) -> list:
        """Token ids of pieces of bytes (each within one bucket's width)."""
        width = max(map(len, pieces))
        lens = np.array([len(p) for p in pieces])
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(len(pieces), width)
        ids = np.where(np.arange(width) < lens[:, None], self.single[flat], np.int32(-1))
        out: list = [None] * len(pieces)
        who = np.arange(len(pieces))
        ranks = self.lookup(ids[:, :-1], ids[:, 1:]) if width > 1 else np.full((len(pieces), 0), NONE)
        while len(who):
            best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(who), dtype=np.int64)
            row = np.arange(len(who))
            least = ranks[row, best] if ranks.shape[1] else np.full(len(who), NONE)
            done = least == NONE
            if done.any():
                ended = ids[done]
                ends, flat = np.cumsum((ended >= 0).sum(axis=1)).tolist(), ended[ended >= 0].tolist()
                for i, a, b in zip(who[done].tolist(), [0, *ends], ends):
                    out[i] = flat[a:b]
                go = ~done
                ids, ranks, who, best, least = ids[go], ranks[go], who[go], best[go], least[go]
                row = np.arange(len(who))
                if not len(who):
                    break
            # compaction: the pair's left place takes the merged id, all places right of it move one to the left
            place = np.arange(ids.shape[1] - 1)
            ids = np.where(place[None, :] <= best[:, None], ids[:, :-1], ids[:, 1:])
            ids[row, best] = least
            if ids.shape[1] == 1:
                ranks = np.full((len(who), 0), NONE)
                continue
            place = place[:-1]
            ranks = np.where(place[None, :] <= best[:, None], ranks[:, :-1], ranks[:, 1:])
            at = np.minimum(best, ids.shape[1] - 2)
            ranks[row, at] = self.lookup(ids[row, at], ids[row, at + 1])
            at = np.maximum(best - 1, 0)
            ranks[row, at] = self.lookup(ids[row, at], ids[row, at + 1])
        return out

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each merged pair; NONE where there is none or an id is negative, which is padding."""
        keys = (a.astype(np.int64).astype(np.uint64) << np.uint64(32)) | b.astype(np.int64).astype(np.uint64)
        keys[(a < 0) | (b < 0)] = np.uint64(2**64 - 2)
        shape, keys = keys.shape, keys.reshape(-1)
        slot = self._slot(keys)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.values[slot], NONE)
        open_ = np.flatnonzero((seen != keys) & (seen != np.uint64(2**64 - 1)))
        while len(open_):
            slot[open_] += 1
            seen = self.keys[slot[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (seen != np.uint64(2**64 - 1))]
        return out.reshape(shape)

    def merge_long(self, piece: bytes) -> list:
        """The same rule for one long piece: a heap of (rank, place) over linked places."""
        ids, n = [self.ranks[bytes([b])] for b in piece], len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tokens, ranks = self.tokens, self.ranks
        rank = lambda i: ranks.get(tokens[ids[i]] + tokens[ids[after[i]]]) if after[i] < n else None
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] is not None else n
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n and (s := rank(x)) is not None:
                    heapq.heappush(heap, (s, x, ids[x], ids[after[x]]))
        return [x for x in ids if x is not None]

    def encode_pieces(self, pieces: list) -> dict:
        """The ids of each of some distinct pieces of text."""
        raws = [t.encode("utf-8", "surrogatepass") for t in pieces]
        out = [None if r is None else [r] for r in map(self.ranks.get, raws)]
        open_ = np.array([i for i, x in enumerate(out) if x is None], dtype=np.int64)
        bucket = np.searchsorted(BUCKETS, [len(raws[i]) for i in open_.tolist()])
        for k in np.unique(bucket).tolist():
            group = open_[bucket == k].tolist()
            for i in range(0, len(group), 20_000):
                part = [raws[j] for j in group[i : i + 20_000]]
                ids = map(self.merge_long, part) if k == len(BUCKETS) else self.merge_rows(part)
                for j, x in zip(group[i : i + 20_000], ids):
                    out[j] = x
        return dict(zip(pieces, out))

    def decode(self, ids: np.ndarray) -> tuple:
        """(the bytes of all ids, where each id's begin)."""
        return _gathered(self.bytes, self.byte_at, ids)


class Pieces:
    """The pieces that a worker remembers: their ids in one array, where each piece's begin, and the ids as written."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.numerals = vocab, list(map(str, range(len(vocab.tokens))))
        self.forget()

    def forget(self) -> None:
        self.place, self.written = {}, []
        self.ids, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def places(self, pieces: list) -> np.ndarray:
        """The place of each piece; those not met before are encoded first."""
        out = np.fromiter(map(self.place.get, pieces, repeat(-1)), np.int64, len(pieces))
        unmet = np.flatnonzero(out < 0).tolist()
        new = dict.fromkeys(pieces[i] for i in unmet)
        if self.place and len(self.place) + len(new) > REMEMBER:
            self.forget()
            return self.places(pieces)
        if new:
            encoded = self.vocab.encode_pieces(list(new))
            for piece, ids in encoded.items():
                self.place[piece] = len(self.written)
                self.written.append(" ".join(map(self.numerals.__getitem__, ids)))
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(encoded.values()), np.int32)])
            self.at = np.concatenate([self.at, self.at[-1] + _starts(list(map(len, encoded.values())))[1:]])
            out[unmet] = [self.place[pieces[i]] for i in unmet]
        return out


#: The pieces of the vocabulary that this Python process used last, by the digest of its file.
_HELD: dict = {}


def _pieces(data: bytes) -> Pieces:
    key = hashlib.sha256(data).digest()
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Pieces(Vocabulary(data))
    return _HELD[key]


def token_rows(docs: DataFrame, vocabulary: bytes, pattern: str, digests_only: bool = False) -> DataFrame:
    """doc_id, ids array<int> (null if digests_only), n_tokens, ids_sha256, decoded_sha256 for each row of docs.

    vocabulary: the content of a file of `base64 rank` lines. It is sent to the tasks once, by broadcast; its size is fixed."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        import regex

        known, find = _pieces(held.value), regex.compile(pattern).findall
        sha = lambda parts: [hashlib.sha256(x).hexdigest() for x in parts]

        def some(doc_ids, texts):
            cut = [find(t) for t in texts]
            rows = _starts(list(map(len, cut)))
            places = known.places(list(chain.from_iterable(cut)))
            del cut
            ids, at = _gathered(known.ids, known.at, places)
            at = at[rows]  # where each text's ids begin
            raw, byte_at = known.vocab.decode(ids)
            byte_at = byte_at[at]
            places, written = places.tolist(), known.written.__getitem__
            left = sha(" ".join(map(written, places[a:b])).encode() for a, b in zip(rows[:-1], rows[1:]))
            back = sha(raw[a:b] for a, b in zip(byte_at[:-1], byte_at[1:]))
            lists = pa.nulls(len(texts), pa.list_(pa.int32())) if digests_only else pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))
            return pa.RecordBatch.from_arrays([doc_ids, lists, pa.array(np.diff(at), pa.int64()), pa.array(left, pa.string()), pa.array(back, pa.string())], ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"])

        for batch in batches:
            ids, texts, first, size, run_ = batch.column(0), batch.column(1), 0, 0, []
            for i in range(batch.num_rows):
                t = texts[i].as_py() or ""
                run_.append(t)
                size += len(t)
                if size >= CHUNK:
                    yield some(ids.slice(first, len(run_)), run_)
                    first, size, run_ = i + 1, 0, []
            if run_:
                yield some(ids.slice(first, len(run_)), run_)

    schema = "doc_id long, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(in_batches, run, schema)


def decode_rows(rows: DataFrame, vocabulary: bytes) -> DataFrame:
    """doc_id, text of rows (doc_id, ids): the inverse of token_rows. Null ids give null."""
    held = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        tokens = _pieces(held.value).vocab.tokens
        for b in batches:
            texts = [None if x is None else b"".join(map(tokens.__getitem__, x)).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").transform(in_batches, run, "doc_id long, text string")
