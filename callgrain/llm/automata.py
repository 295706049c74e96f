"""Minimal acyclic automata of sorted words over one-byte characters, built and walked as numpy arrays.

The trie of the sorted words is read off their common prefixes.  Equal states are then
merged from the ends of the words upwards: states of one height (longest way to an end)
are equal if their edges lead by equal characters to equal states, which is decided
edge by edge, last edge first, on exact triples of numbers.

Each edge holds how many words end before those behind it, so that the sum along a word's
path is the word's place in the sorted order: a perfect hash without gaps.
"""

from __future__ import annotations

import numpy as np


def matrix(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of bytes, padded with 0, and their lengths."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    width = int(lengths.max(initial=1))
    return np.array(words, f"S{width}").view(np.uint8).reshape(len(words), width), lengths


def backwards(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The same words read from their ends."""
    at = lengths[:, None] - 1 - np.arange(rows.shape[1])
    return np.where(at >= 0, np.take_along_axis(rows, np.maximum(at, 0), 1), 0).astype(np.uint8)


def order(rows: np.ndarray) -> np.ndarray:
    """Places of the rows in the order of their bytes."""
    return np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal bytes at the start of each row of both."""
    differ = a != b
    return np.where(differ.any(1), differ.argmax(1), a.shape[1])


class Automaton:
    """Minimal acyclic automaton of different words, sorted by their bytes (rows padded with 0).

    ``first`` and ``count`` give a state's edges; ``char``, ``target`` and ``output`` are
    those of the edges; ``end`` tells states where a word ends.
    """

    def __init__(self, rows: np.ndarray, lengths: np.ndarray):
        n, width = rows.shape
        shared = np.zeros(n, np.int64)
        if n > 1:
            shared[1:] = np.minimum(common_prefix(rows[1:], rows[:-1]), np.minimum(lengths[1:], lengths[:-1]))
        parent, char, height, end = [np.array([-1])], [np.array([0])], [np.array([lengths.max(initial=0)])], [np.array([bool(n) and int(lengths[0]) == 0])]
        node = np.zeros(n, np.int64)  # each word's trie node at the last depth
        total = 1
        for depth in range(1, width + 1):
            new = (shared < depth) & (lengths >= depth)
            if n:
                new[0] = lengths[0] >= depth
            at = np.flatnonzero(new)
            if not len(at):
                break
            parent.append(node[at])
            char.append(rows[at, depth - 1].astype(np.int64))
            height.append(np.maximum.reduceat(np.where(lengths >= depth, lengths, 0), at) - depth)
            node = np.where(lengths >= depth, total + np.cumsum(new) - 1, node)
            ends = np.zeros(len(at), bool)
            ends[node[lengths == depth] - total] = True
            end.append(ends)
            total += len(at)
        self._merge(*(np.concatenate(x) for x in (parent, char, height, end)))

    def _merge(self, parent: np.ndarray, char: np.ndarray, height: np.ndarray, end: np.ndarray) -> None:
        total = len(parent)
        by = np.lexsort((char[1:], parent[1:])) + 1  # edges, named by the node they lead to
        count = np.bincount(parent[1:], minlength=total)
        first = np.cumsum(count) - count
        merged = np.full(total, -1, np.int64)
        counts, chars, targets, behind, ends, words = [], [], [], [], [], []
        states = 0
        for nodes in np.split(np.argsort(height, kind="stable"), np.cumsum(np.bincount(height))[:-1]):
            kind, lists = np.zeros(len(nodes), np.int64), 1  # the list of the edges seen so far, last ones first
            for k in range(int(count[nodes].max(initial=0))):
                at = np.flatnonzero(count[nodes] > k)
                edge = by[first[nodes[at]] + count[nodes[at]] - 1 - k]
                triple = np.stack([kind[at], merged[edge], char[edge]], 1)
                o = np.lexsort(triple.T)
                fresh = np.append(True, (triple[o][1:] != triple[o][:-1]).any(1))
                kind[at[o]] = lists + np.cumsum(fresh) - 1
                lists += int(fresh.sum())
            _, one, merged_here = np.unique(kind * 2 + end[nodes], return_index=True, return_inverse=True)
            merged[nodes] = states + merged_here
            states += len(one)
            one = nodes[one]
            n = count[one]
            edge = by[np.repeat(first[one], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            targets.append(merged[edge])
            chars.append(char[edge])
            counts.append(n)
            done = np.concatenate(words) if words else np.zeros(0, np.int64)
            passed = np.append(0, np.cumsum(done[targets[-1]] if len(edge) else np.zeros(0, np.int64)))
            start = np.cumsum(n) - n
            behind.append(passed[:-1] - np.repeat(passed[start], n) + np.repeat(end[one], n))
            words.append(passed[start + n] - passed[start] + end[one])
            ends.append(end[one])
        self.count, self.char = np.concatenate(counts), np.concatenate(chars)
        self.first = np.cumsum(self.count) - self.count
        self.target, self.output, self.end = np.concatenate(targets), np.concatenate(behind), np.concatenate(ends)
        self.words = int(words[-1][merged[0] - (states - len(words[-1]))]) if total else 0
        self.start = int(merged[0])
        self.keys = np.repeat(np.arange(states), self.count) << 8 | self.char

    def step(self, state: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edge of each state by a character, and whether there is one."""
        key = state << 8 | char
        edge = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        return edge, self.keys[edge] == key if len(self.keys) else np.zeros(len(key), bool)

    def edges(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All edges of the states: which of them has it, and the edge."""
        n = self.count[state]
        row = np.repeat(np.arange(len(state)), n)
        return row, self.first[state[row]] + np.arange(len(row)) - (np.cumsum(n) - n)[row]

    def number(self, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each word's place in the sorted order, -1 if the automaton does not hold it."""
        n = len(rows)
        out, state, passed, at = np.full(n, -1, np.int64), np.full(n, self.start), np.zeros(n, np.int64), np.arange(n)
        for depth in range(rows.shape[1] + 1):
            over = lengths[at] == depth
            done = over & self.end[state]
            out[at[done]] = passed[done]
            at, state, passed = at[~over], state[~over], passed[~over]
            if not len(at):
                break
            edge, there = self.step(state, rows[at, depth].astype(np.int64))
            at, edge, passed = at[there], edge[there], passed[there]
            state, passed = self.target[edge], passed + self.output[edge]
        return out

    def near(self, rows: np.ndarray, lengths: np.ndarray, exact: np.ndarray, last: np.ndarray, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words one error away: ``exact`` characters match, the error stands at a place from there to ``last``.

        A row with ``longer`` loses a character; any other has one replaced or gets one more.
        The place of the error is the first at which both words differ, so that no word is
        found twice for a row.  Gives rows and the numbers of the words found.
        """
        n, width = rows.shape
        chars = np.concatenate([rows, np.zeros((n, 2), np.uint8)], 1).astype(np.int64)  # 0 is no character
        at, state, passed = np.arange(n), np.full(n, self.start), np.zeros(n, np.int64)
        empty = np.zeros(0, np.int64)
        wrong = (empty, empty, empty)  # row, state and number behind an error
        found, numbers = [], []

        def join(a, b):
            return tuple(np.concatenate(x) for x in zip(a, b, strict=True))

        for depth in range(width + 2):
            ahead = (empty, empty, empty)  # those that have read the character at this depth already
            open_ = (exact[at] <= depth) & (depth <= last[at]) & (depth <= lengths[at])
            who, from_, base = at[open_], state[open_], passed[open_]
            if len(who):
                here, after = chars[who, min(depth, width)], chars[who, min(depth + 1, width + 1)]
                less = longer[who] & (here != 0) & (after != here)
                ahead = join(ahead, (who[less], from_[less], base[less]))
                more = np.flatnonzero(~longer[who])
                row, edge = self.edges(from_[more])
                row = more[row]
                other = self.char[edge] != here[row]
                row, edge = row[other], edge[other]
                put = (who[row], self.target[edge], base[row] + self.output[edge])
                wrong = join(wrong, put)
                inside = here[row] != 0
                ahead = join(ahead, tuple(x[inside] for x in put))
            over = lengths[wrong[0]] == depth
            done = over & self.end[wrong[1]]
            found.append(wrong[0][done])
            numbers.append(wrong[2][done])
            row, from_, base = (x[~over] for x in wrong)
            edge, there = self.step(from_, chars[row, min(depth, width)])
            wrong = join((row[there], self.target[edge[there]], base[there] + self.output[edge[there]]), ahead)
            on = depth < np.minimum(lengths[at], last[at])
            at, state, passed = at[on], state[on], passed[on]
            edge, there = self.step(state, chars[at, min(depth, width)])
            at, edge, passed = at[there], edge[there], passed[there]
            state, passed = self.target[edge], passed + self.output[edge]
            if not len(at) and not len(wrong[0]):
                break
        return np.concatenate(found), np.concatenate(numbers)
