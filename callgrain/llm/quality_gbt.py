"""Quality rules by gradient-boosted trees over document statistics.

Statistics of every whole text are counted once.  Trees are boosted on log loss with
binned splits; features of junk (symbols, repeated lines, repeated words) may only
lower the score, which each split is held to.  The fitted trees are flattened into
numpy arrays of nodes and all rows of a batch walk all trees together.

The classifier is fitted on a bounded sample of labelled rows: at most ``SAMPLE`` rows,
in hash order of their ids.  Everything else covers every row.

Edge cases: a null or empty text has no words and fails the base rule; a doc_id with
several labels has the least of them; null labels are left out; without rows of both
classes the verdict is the base rule alone; rows that repeat are judged alike; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrain.llm.common import slices, staged, table

SAMPLE = 20_000
TREES, DEPTH, RATE, BINS, LEAST_ROWS, RIDGE = 60, 3, 0.2, 64, 20, 1.0
MEMO = 150_000
WIDTH = 5

#: The symbols and the white space of the base statistics.
SYMBOLS = b"#*$%&|<>"
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_stops", "n_distinct"]
#: Feature -> its direction: -1 may only lower the score, 1 only raise it, 0 either.
FEATURES = {"log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": 0, "stop_share": 0, "words_per_line": 0, "distinct_share": 0}


class Counter:
    """Statistics of a text, in the order of COUNTS."""

    def __init__(self):
        self.memo: dict[bytes, int] = {}

    def repeated(self, words: list[bytes]) -> int:
        """Words in windows of five that occur twice or more."""
        if len(words) < WIDTH + 1:
            return 0
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        n = len(h) - WIDTH + 1
        total = np.zeros(n, np.uint64)
        for j in range(WIDTH):
            total = total * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
            total ^= total >> np.uint64(32)
        order = np.argsort(total)
        same = total[order][1:] == total[order][:-1]
        if not same.any():
            return 0
        again = np.zeros(n + 1, bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        # a word is covered by a window that starts at it or up to four words before
        covered = np.zeros(len(h), bool)
        for j in range(WIDTH):
            covered[j : j + n] |= again[:n]
        return int(covered.sum())

    def __call__(self, text: str | None) -> tuple[int, ...]:
        if not text:
            return (0,) * len(COUNTS)
        raw = text.encode()
        words = raw.split()
        spaces = len(raw) - len(raw.translate(None, SPACE))
        lines = [x for x in raw.split(b"\n") if x.strip()]
        upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        stops = sum(w[-1] in b".!?" for w in words)
        return len(words), len(text) - spaces, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), self.repeated(words), len(lines), upper, stops, len(set(words))


def _count(batches):
    count = Counter()
    for batch in slices(batches):
        rows = [count(t) for t in batch.column(1).to_pylist()]
        columns = zip(*rows, strict=True) if rows else [[]] * len(COUNTS)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *COUNTS])


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and COUNTS for every row; one pass."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_count, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """Rows of FEATURES from arrays of COUNTS."""
    c = {k: v.astype(float) for k, v in c.items()}
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.stack([np.log1p(c["n_words"]), chars / words, c["n_symbols"] / chars, c["n_dup_lines"] / lines, c["n_repeat_words"] / words, c["n_upper"] / chars, c["n_stops"] / words, words / lines, c["n_distinct"] / words], axis=1)


def _grow(binned: np.ndarray, grad: np.ndarray, hess: np.ndarray, edges: list[np.ndarray], direction: list[int], tree: list) -> None:
    """Append one tree's nodes ``(feature, threshold, left, right, value)``; a node is split into values within its bounds."""

    def value(g: float, h: float, lo: float, hi: float) -> float:
        return float(np.clip(-g / (h + RIDGE), lo, hi))

    def node(rows: np.ndarray, depth: int, lo: float, hi: float) -> int:
        me = len(tree)
        g, h = grad[rows].sum(), hess[rows].sum()
        tree.append([-1, 0.0, me, me, value(g, h, lo, hi)])
        if depth == DEPTH or len(rows) < 2 * LEAST_ROWS:
            return me
        best = (1e-6, None)
        gain_of = lambda g, h, v: -(g * v + 0.5 * (h + RIDGE) * v * v)
        base = gain_of(g, h, tree[me][4])
        for f in range(binned.shape[1]):
            b = binned[rows, f]
            gs, hs, ns = (np.bincount(b, w, minlength=len(edges[f]) + 1).cumsum() for w in (grad[rows], hess[rows], np.ones(len(rows))))
            for k in range(len(edges[f])):
                if min(ns[k], len(rows) - ns[k]) < LEAST_ROWS:
                    continue
                vl, vr = value(gs[k], hs[k], lo, hi), value(g - gs[k], h - hs[k], lo, hi)
                if direction[f] * (vr - vl) < 0:
                    continue
                gain = gain_of(gs[k], hs[k], vl) + gain_of(g - gs[k], h - hs[k], vr) - base
                if gain > best[0]:
                    best = (gain, (f, k, vl, vr))
        if best[1] is None:
            return me
        f, k, vl, vr = best[1]
        left, mid = binned[rows, f] <= k, (vl + vr) / 2
        bounds = {0: ((lo, hi), (lo, hi)), 1: ((lo, mid), (mid, hi)), -1: ((mid, hi), (lo, mid))}[direction[f]]
        tree[me][:2] = [f, float(edges[f][k])]
        tree[me][2] = node(rows[left], depth + 1, *bounds[0])
        tree[me][3] = node(rows[~left], depth + 1, *bounds[1])
        return me

    node(np.arange(len(grad)), 0, -np.inf, np.inf)


class Forest:
    """Trees as flat node arrays."""

    def __init__(self, trees: list[list], base: float):
        self.base = base
        self.roots = np.cumsum([0, *(len(t) for t in trees)])[:-1]
        shift = np.repeat(self.roots, [len(t) for t in trees]) if trees else np.empty(0, int)
        flat = [n for t in trees for n in t]
        self.feature = np.array([n[0] for n in flat], np.int32)
        self.threshold = np.array([n[1] for n in flat])
        self.left = np.array([n[2] for n in flat], np.int64) + shift
        self.right = np.array([n[3] for n in flat], np.int64) + shift
        self.value = np.array([n[4] for n in flat])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality for each row; all rows and trees step together."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            f = self.feature[at]
            low = x[row, np.maximum(f, 0)] <= self.threshold[at]
            at = np.where(f < 0, at, np.where(low, self.left[at], self.right[at]))
        return 1 / (1 + np.exp(-(self.base + RATE * self.value[at].sum(1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Forest | None:
    """Boosted trees for labels 0 and 1; None without both."""
    if not 0 < y.sum() < len(y):
        return None
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    direction = list(FEATURES.values())
    base = float(np.log(y.mean() / (1 - y.mean())))
    total, grown = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        tree: list = []
        _grow(binned, p - y, p * (1 - p), edges, direction, tree)
        grown.append(tree)
        one = Forest([tree], 0.0)
        at = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            f = one.feature[at]
            low = x[np.arange(len(x)), np.maximum(f, 0)] <= one.threshold[at]
            at = np.where(f < 0, at, np.where(low, one.left[at], one.right[at]))
        total = total + RATE * one.value[at]
    return Forest(grown, base)


def _verdict(shared):
    def run(batches):
        forest = shared.value
        for batch in batches:
            c = {k: batch.column(k).to_numpy() for k in COUNTS}
            failed = (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])
            score = forest.score(features(c)) if forest and batch.num_rows else np.ones(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", *COUNTS[:5])), pa.array(failed), pa.array(score), pa.array(~failed & (score >= 0.5))], ["doc_id", *COUNTS[:5], "base_failed", "score", "kept"])

    return run


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept`` for every row."""
    counted = staged(statistics(docs), "statistics")
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    taught = counted.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), *COUNTS).limit(sample).toArrow()  # at most SAMPLE rows
    y = taught.column("quality").to_numpy().astype(float)
    forest = fit(features({k: taught.column(k).to_numpy() for k in COUNTS}), y) if len(y) else None
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(forest)  # TREES trees of at most 2 ** (DEPTH + 1) nodes
    return counted.mapInArrow(_verdict(shared), f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS[:5]) + ", base_failed boolean, score double, kept boolean")


def op5_quality_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op5_quality_gbt": op5_quality_gbt}
ORACLE_SQL: dict[str, str] = {}
