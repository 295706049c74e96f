"""Two-stage suffix sorting of byte arrays in numpy.

A suffix is of type B if it is smaller than its successor, else of type A.  Only
the B suffixes are sorted directly: the stretches from one B position to the next
get order-keeping names, and the string of names is sorted by prefix doubling, of
which only unresolved groups take part.  One scan over the buckets of first bytes
then induces the A suffixes: within a bucket they stand before the B suffixes and in
the order in which the scan meets their successors.
"""

from __future__ import annotations

import numpy as np

#: Symbols (9 bits each) of a stretch that one sort key holds.
PACK = 7


def types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; the empty suffix is the smallest."""
    ends = np.append(np.flatnonzero(t[1:] != t[:-1]), len(t) - 1)
    rising = np.append(t[ends[:-1]] < t[ends[:-1] + 1], False)
    return np.repeat(rising, np.diff(ends, prepend=-1))


def _regroup(rank: np.ndarray, idx: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """``idx``: members of tied groups in their new order; ``fresh``: where a new group begins.  Returns those still tied."""
    pos = np.arange(len(idx))
    old = rank[idx]
    begins = np.append(True, old[1:] != old[:-1])
    start = np.maximum.accumulate(np.where(begins, pos, 0))
    new = np.maximum.accumulate(np.where(fresh | begins, pos, 0))
    rank[idx] = old + new - start
    size = np.bincount(new, minlength=len(idx))
    return idx[size[new] > 1]


def _sorted_b(t: np.ndarray, is_b: np.ndarray, depth: int) -> np.ndarray:
    """B positions in the order of their suffixes, compared to ``depth`` bytes at least."""
    b = np.flatnonzero(is_b)
    m = len(b)
    if m < 2:
        return b
    sym = np.zeros(len(t) + PACK, np.uint64)
    sym[: len(t)] = t.astype(np.uint64) * 2 + is_b + 1
    length = np.append(np.diff(b) + 1, len(t) - b[-1])

    def key(idx: np.ndarray, word: int) -> np.ndarray:
        out = np.zeros(len(idx), np.uint64)
        for k in range(PACK):
            off = word * PACK + k
            inside = off < length[idx]
            s = np.where(inside, sym[np.minimum(b[idx] + off, len(sym) - 1)], np.uint64(0))
            out = (out << np.uint64(9)) | s
        return out

    first = key(np.arange(m), 0)
    order = np.argsort(first)
    first = first[order]
    fresh = np.append(True, first[1:] != first[:-1])
    rank = np.zeros(m, np.int64)
    tied = _regroup(rank, order, fresh)
    word = 1
    # stretches longer than one key; equal keys mean that both go on or both end
    while len(tied) and (longer := length[tied] > word * PACK).any():
        idx = tied[longer]
        k = key(idx, word)
        o = np.lexsort((k, rank[idx]))
        idx, k = idx[o], k[o]
        _regroup(rank, idx, np.append(True, k[1:] != k[:-1]))
        tied = tied[np.argsort(rank[tied], kind="stable")]
        _, at, size = np.unique(rank[tied], return_inverse=True, return_counts=True)
        tied = tied[size[at] > 1]
        word += 1
    padded = np.zeros(m + 2 * depth + 2, np.int64)  # beyond the end: smaller than any rank
    reach = 1
    while len(tied) and reach < depth:
        padded[:m] = rank + 1
        k = (rank[tied] << 32) | padded[tied + reach]
        o = np.argsort(k)
        k = k[o]
        tied = _regroup(rank, tied[o], np.append(True, k[1:] != k[:-1]))
        reach *= 2
    return b[np.argsort(rank, kind="stable")]


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``t`` (uint8, no byte above 254) by suffix, exact to ``depth`` bytes; deeper ties in any order."""
    n = len(t)
    if n == 0:
        return np.empty(0, np.int64)
    is_b = types(t)
    direct = _sorted_b(t, is_b, depth)
    cut = np.searchsorted(t[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[t[n - 1]].append(np.array([n - 1]))  # successor of the last position: the empty suffix
    out = []
    for c in range(256):
        parts = waiting[c]
        if not parts and cut[c] == cut[c + 1]:
            continue
        here = np.concatenate(parts) if parts else np.empty(0, np.int64)
        parts = [here]
        while len(here):  # a run of this byte: induced inside the bucket
            here = here[here > 0] - 1
            here = here[t[here] == c]
            parts.append(here)
        parts.append(direct[cut[c] : cut[c + 1]])
        bucket = np.concatenate(parts)
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        byte = t[before]
        up = byte > c
        before, byte = before[up], byte[up]
        o = np.argsort(byte, kind="stable")
        before, byte = before[o], byte[o]
        edges = [0, *(np.flatnonzero(byte[1:] != byte[:-1]) + 1).tolist(), len(byte)] if len(byte) else [0]
        for a, z in zip(edges, edges[1:], strict=False):
            waiting[byte[a]].append(before[a:z])
    return np.concatenate(out)


def common_prefixes(t: np.ndarray, sa: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of each listed suffix with the next one, at most ``cap`` (a multiple of 8)."""
    padded = np.concatenate([t, np.arange(cap, dtype=np.int64).astype(np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, cap)
    out = np.empty(max(0, len(sa) - 1), np.int64)
    for at in range(0, len(out), 4096):
        here = sa[at : min(at + 4096, len(out)) + 1]
        words = np.ascontiguousarray(rows[here])
        x, y = words[:-1].view(np.uint64), words[1:].view(np.uint64)
        differ = x != y
        word = differ.argmax(1)
        i = np.arange(len(word))
        w = x[i, word] ^ y[i, word]  # little-endian: the first differing byte is the lowest
        low = w & (~w + np.uint64(1))
        byte = (np.frexp(low.astype(np.float64))[1] - 1) // 8
        n = np.minimum(word * 8 + byte, np.maximum(len(t) - np.maximum(here[:-1], here[1:]), 0))
        out[at : at + len(n)] = np.where(differ.any(1), n, np.minimum(cap, len(t) - np.maximum(here[:-1], here[1:])))
    return out
