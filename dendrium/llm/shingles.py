"""Sets of word shingles, vectorized over slices of texts."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Base of the rolling sum over a word's bytes, and its inverse modulo 2**64.
_BASE = 0xA0761D6478BD642F
_BACK = pow(_BASE, -1, 1 << 64)
#: Bytes that are looked at together; a word may cross blocks, so memory does not grow with a text.
BLOCK = 1 << 20
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _ODD
    return h ^ (h >> np.uint64(32))


def _byte_values() -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit value for each byte (A-Z as a-z), and which bytes separate words."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
    values[65:91] = values[97:123]
    gap = np.zeros(256, bool)
    gap[[9, 10, 11, 12, 13, 32]] = True
    return values, gap


VALUES, GAP = _byte_values()


def _power(name: str, base: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64, for a block."""
    if len(_powers.get(name, ())) != BLOCK:
        have = np.full(BLOCK, base, np.uint64)
        have[0] = 1
        _powers[name] = np.cumprod(have, dtype=np.uint64)
    return _powers[name]


def _block(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and sums of the words (or parts of words) in a block; texts begin at edges."""
    solid = ~GAP[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    begins[edges] = solid[edges]  # a word ends with its text
    start = np.flatnonzero(begins)
    last = solid
    last[:-1] &= ~last[1:] | begins[1:]
    stop = np.flatnonzero(last) + 1
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(VALUES[raw] * _power("on", _BASE)[: len(raw)], out=sums[1:])
    return start, stop, (sums[stop] - sums[start]) * _power("back", _BACK)[start]


def word_hashes(texts) -> tuple[np.ndarray, np.ndarray]:
    """For an Arrow string array (null: empty): the hashes of all words, A-Z lower-cased, and how many each text has."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "").cast(pa.large_string()).take(pa.array(np.arange(len(texts))))
    n = len(texts)
    ends = np.cumsum(np.asarray(pc.binary_length(texts), np.int64))
    total = int(ends[-1]) if n else 0
    if not total:
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[:total]
    starts, lengths, hashes = [], [], []
    for p in range(0, total, BLOCK):
        q = min(p + BLOCK, total)
        edges = ends[np.searchsorted(ends, p) : np.searchsorted(ends, q)] - p
        start, stop, h = _block(raw[p:q], edges)
        length = stop - start
        crosses = p and len(start) and start[0] == 0 and not GAP[raw[p - 1]] and not (len(edges) and edges[0] == 0)
        if crosses:  # the word goes on from the block before
            so_far = int(lengths[-1][-1])
            hashes[-1][-1:] += np.uint64(pow(_BASE, so_far, 1 << 64)) * h[:1]
            lengths[-1][-1] += length[0]
            start, length, h = start[1:], length[1:], h[1:]
        if len(start):
            starts.append(start + p), lengths.append(length), hashes.append(h)
    if not starts:
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    counts = np.bincount(np.searchsorted(ends, np.concatenate(starts), side="right"), minlength=n)
    with np.errstate(over="ignore"):
        return mix(np.concatenate(hashes) + np.concatenate(lengths).astype(np.uint64) * _ODD), counts


def shingle_sets(texts, words: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of so many words; a shorter text is one shingle, an empty one
    has none."""
    h, counts = word_hashes(texts)
    m = len(h) - words + 1
    s = np.full(max(m, 0), words, np.uint64)
    for i in range(words):
        s = mix((s ^ h[i : i + max(m, 0)]) * _ODD)
    out, at = [], 0
    for n in counts.tolist():
        if n >= words:
            out.append(np.unique(s[at : at + n - words + 1]))
        elif n:
            one = np.full(1, n, np.uint64)
            for i in range(n):
                one = mix((one ^ h[at + i]) * _ODD)
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out
