"""Whole batches of texts as numpy arrays: words, word hashes, shingle hashes, byte n-grams.

A batch is cut into runs of rows of about CHUNK bytes of text, so memory follows CHUNK or the longest text, not the batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_MULT = (0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x589965CC75374CC3)
_POWERS: dict = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finalizer of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _powers(n: int):
    """Powers of the odd base and of its inverse, modulo 2**64."""
    if _POWERS.get("n", 0) < n:
        size = max(n, CHUNK + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, b in (("p", _BASE), ("i", inverse)):
            a = np.full(size, np.uint64(b), dtype=np.uint64)
            a[0] = 1
            _POWERS[name] = np.multiply.accumulate(a)
        _POWERS["n"] = size
    return _POWERS["p"], _POWERS["i"]


def table(fill, *pairs) -> np.ndarray:
    out = np.full(256, fill)
    for keys, value in pairs:
        out[list(keys)] = value
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LETTERS = LOWER.copy()
_LETTERS[[c for c in range(128) if not chr(c).isalpha()]] = 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
IS_PUNCT = np.zeros(256, dtype=bool)
IS_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def text_chunks(column: pa.Array):
    """(first row, bytes, offsets) for runs of rows; null counts as empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    at = np.frombuffer(offs, dtype=kind, count=n + 1, offset=column.offset * kind().itemsize).astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, side="right")) - 1)
        j = min(j, n)
        yield i, whole[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def word_hashes(buf: np.ndarray, offs: np.ndarray, strip_punctuation: bool = False):
    """(hashes of all words, for each text the index of its first word, with the total at the end). ASCII is lower-cased."""
    if strip_punctuation and len(buf):
        stay = ~IS_PUNCT[buf]
        before = np.zeros(len(buf) + 1, dtype=np.int64)
        np.cumsum(stay, out=before[1:])
        buf, offs = buf[stay], before[offs]
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    solid = ~IS_SPACE[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[offs] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((LOWER[buf].astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=sums[1:])
    hashes = mix((sums[stops] - sums[starts]) * down[starts])
    return hashes, np.searchsorted(starts, offs)


def shingle_hashes(words: np.ndarray, at: np.ndarray, size: int = 5):
    """(hashes of all windows of `size` words, index of each text's first one). A text of fewer words is one shingle."""
    n_docs = len(at) - 1
    lens = np.diff(at)
    counts = np.where(lens >= size, lens - size + 1, (lens > 0).astype(np.int64))
    out_at = np.zeros(n_docs + 1, dtype=np.int64)
    np.cumsum(counts, out=out_at[1:])
    out = np.empty(out_at[-1], dtype=np.uint64)
    if len(words) >= size:
        m = len(words) - size + 1
        total = words[:m] * np.uint64(_MULT[0])
        for k in range(1, size):
            total += words[k : k + m] * np.uint64(_MULT[k])
        full = mix(total)
        doc = np.repeat(np.arange(n_docs), lens)
        inside = doc[:m] == doc[size - 1 :]
        long = np.repeat(lens >= size, counts)
        out[long] = full[inside]
    for d in np.flatnonzero((lens > 0) & (lens < size)):
        w = words[at[d] : at[d + 1]]
        total = np.uint64(len(w))
        with np.errstate(over="ignore"):
            for k, x in enumerate(w):
                total = total + x * np.uint64(_MULT[k])
        out[out_at[d]] = mix(np.array([total], dtype=np.uint64))[0]
    return out, out_at


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """The hash of each run of `length` words, which is that of a text of these words if they are fewer than a shingle has."""
    m = max(0, len(words) - length + 1)
    total = np.full(m, np.uint64(length))
    for k in range(length):
        total += words[k : k + m] * np.uint64(_MULT[k])
    return mix(total)


def ngram_counts(buf: np.ndarray, offs: np.ndarray, dims: int, rows: slice | None = None) -> np.ndarray:
    """A float32 matrix: for each text its counts of byte 2- and 3-grams, lower-cased, hashed to `dims` (a power of two)."""
    n_docs = len(offs) - 1
    low = LOWER[buf].astype(np.uint32)
    doc = np.repeat(np.arange(n_docs, dtype=np.int64), np.diff(offs))
    out = np.zeros(n_docs * dims, dtype=np.float32)
    shift = np.uint32(32 - (dims.bit_length() - 1))
    for k in (2, 3):
        if len(low) < k:
            continue
        m = len(low) - k + 1
        code = low[:m].copy()
        for j in range(1, k):
            code |= low[j : j + m] << np.uint32(8 * j)
        code = ((code + np.uint32(k)) * np.uint32(2654435761)) >> shift
        inside = doc[:m] == doc[k - 1 :]
        out += np.bincount((doc[:m] * dims + code)[inside], minlength=n_docs * dims).astype(np.float32)
    return out.reshape(n_docs, dims)


def letters_only(buf: np.ndarray, offs: np.ndarray):
    """The same texts with every run of ASCII characters that are no letters made one space."""
    low = _LETTERS[buf]
    stay = np.ones(len(low), dtype=bool)
    stay[1:] = (low[1:] != 32) | (low[:-1] != 32)
    before = np.zeros(len(low) + 1, dtype=np.int64)
    np.cumsum(stay, out=before[1:])
    return low[stay], before[offs]


def small_runs(buf: np.ndarray, offs: np.ndarray, most: int):
    """A chunk cut into runs of at most `most` texts: (first text, bytes, offsets)."""
    for i in range(0, len(offs) - 1, most):
        part = offs[i : i + most + 1]
        yield i, buf[part[0] : part[-1]], part - part[0]
