"""Simple-8b word-aligned integer coding, encoded and decoded a whole array at a time.

A 64-bit word holds a selector in its top 4 bits and equally wide values in the other 60, the first one lowest. Values
that need more than 60 bits escape: selector 0 holds an index into a list of whole 64-bit values. Values are coded in
blocks of BLOCK; each block starts at a word of its own, whose offset is stored, so all blocks decode at once.

Layout, little-endian: b"S8B1", u32 block size, u64 values, u32 blocks, u32 escapes, u64 offsets of blocks + 1,
u64 escapes, u64 words.
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 1024
MAGIC = b"S8B1"
#: How many values a word holds, and of how many bits, for selectors 1 to 14; selector 0 escapes.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
_HEAD = struct.Struct("<4sIQII")


def _widths(v: np.ndarray) -> np.ndarray:
    """The narrowest width of BITS that each value fits in; 64: none."""
    if v.max(initial=0) < len(_NARROW):
        return _NARROW[v]
    return _width(v)


def _width(v: np.ndarray) -> np.ndarray:
    w = np.ones(v.shape, np.uint8)
    classes = [int(b) for b in np.unique(BITS[1:])]
    for low, b in zip(classes, [*classes[1:], 64]):
        w[v >= np.uint64(1) << np.uint64(low)] = b
    return w


_NARROW = _width(np.arange(1 << 17, dtype=np.uint64))


def _choices(w: np.ndarray) -> np.ndarray:
    """For each place of each block (a row), the selector that takes most values from there."""
    rows, n = w.shape
    runs = {1: w}
    best = np.zeros((rows, n), np.uint8)
    for s in range(len(COUNTS) - 1, 0, -1):
        c = int(COUNTS[s])
        p = 1 << (c.bit_length() - 1)
        if p not in runs:  # maxima of p values from each place; past the end a block counts as empty
            prev = runs[p // 2]
            runs[p] = prev.copy()
            np.maximum(prev[:, : n - p // 2], prev[:, p // 2 :], out=runs[p][:, : n - p // 2])
        top = runs[p]
        if c > p and n > c - p:
            top = top.copy()
            np.maximum(top[:, : n - (c - p)], runs[p][:, c - p :], out=top[:, : n - (c - p)])
        fits = top <= BITS[s]
        if not fits.any():  # then no longer run of narrower values fits either
            break
        best[fits] = s
    return best


def encode(values: np.ndarray) -> bytes:
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    blocks = -(-n // BLOCK)
    if not n:
        return _HEAD.pack(MAGIC, BLOCK, 0, 0, 0) + struct.pack("<Q", 0)
    v = np.zeros(blocks * BLOCK + 64, np.uint64)
    v[:n] = values
    best = _choices(_widths(v[: blocks * BLOCK].reshape(blocks, BLOCK)))
    ends = np.minimum(np.arange(1, blocks + 1) * BLOCK, n) - np.arange(blocks) * BLOCK
    at, steps = np.zeros(blocks, np.int64), []
    rows = np.arange(blocks)
    while True:  # all blocks step together, one word each
        live = at < ends
        if not live.any():
            break
        steps.append(np.where(live, at, -1))
        at = np.where(live, at + COUNTS[best[rows, np.minimum(at, BLOCK - 1)]], at)
    places = np.stack(steps, 1)
    used = places >= 0
    offsets = np.concatenate([[0], np.cumsum(used.sum(1))]).astype("<u8")
    pos = (places + rows[:, None] * BLOCK)[used]
    sel = best.reshape(-1)[pos]
    words = np.zeros(len(pos), np.uint64)
    escapes = np.zeros(0, np.uint64)
    for s in np.unique(sel):
        here = np.flatnonzero(sel == s)
        p = pos[here]
        if s == 0:
            escapes = v[p]
            words[here] = np.arange(len(p), dtype=np.uint64)
            continue
        limit = (p // BLOCK + 1) * BLOCK
        acc = np.full(len(p), np.uint64(int(s)) << np.uint64(60))
        for j in range(COUNTS[s]):
            x = v[p + j]
            acc |= np.where(p + j < limit, x, np.uint64(0)) << np.uint64(BITS[s] * j)
        words[here] = acc
    return _HEAD.pack(MAGIC, BLOCK, n, blocks, len(escapes)) + offsets.tobytes() + escapes.astype("<u8").tobytes() + words.astype("<u8").tobytes()


def decode(data: bytes) -> np.ndarray:
    magic, block, n, blocks, n_esc = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b segment")
    at = _HEAD.size
    offsets = np.frombuffer(data, "<u8", blocks + 1, at).astype(np.int64)
    at += 8 * (blocks + 1)
    escapes = np.frombuffer(data, "<u8", n_esc, at)
    words = np.frombuffer(data, "<u8", -1, at + 8 * n_esc) if n else np.zeros(0, np.uint64)
    if not n:
        return np.zeros(0, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[sel]
    total = np.cumsum(counts) - counts
    first = total[offsets[:-1]]
    of = np.repeat(np.arange(blocks), np.diff(offsets))
    start = total - first[of] + of * block
    limit = np.minimum((of + 1) * block, n)
    out = np.zeros(n, np.uint64)
    for s in np.unique(sel):
        here = np.flatnonzero(sel == s)
        w, p, e = words[here], start[here], limit[here]
        if s == 0:
            out[p] = escapes[w.astype(np.int64)]
            continue
        mask = (np.uint64(1) << np.uint64(BITS[s])) - np.uint64(1)
        for j in range(COUNTS[s]):
            ok = p + j < e
            out[p[ok] + j] = (w[ok] >> np.uint64(BITS[s] * j)) & mask
    return out
