"""Toxicity by class-conditional Kneser-Ney bigram models.

Each class (toxic, ordinary) has a model of the words of its texts, in three orders.

* Order 2, raw counts: ``n_c(v w)`` texts of the class hold word ``w`` after ``v``; a text
  counts a pair once, so that lines repeated inside it are one piece of evidence.
* Order 1, continuation counts: ``k_c(w)`` different words stand before ``w`` in the class.
* Order 0, shared by both classes: ``S(w)``, the number of classes that have ``w``.

With absolute discount ``D``, ``[x] = max(x - D, 0)`` and sums over what stands for the dot,

    P_c(w)     = [k_c(w)] / k_c(.)  +  D types_c / k_c(.) * S(w)
    P_c(w | v) = (1 - l(v)) [n_c(v w)] / [n_c(v .)]  +  l(v) P(w | v) P_c(w) / P(w)

where ``P(w | v)`` is the Kneser-Ney model of both classes together, ``l(v)`` its backoff
weight and ``P(w)`` the mean of both ``P_c(w)``.  A word's evidence is the log ratio of both
``P_c(w)``, drawn towards 0 by ``WORD_ERRORS`` standard errors; a pair's evidence is what the
log ratio of both ``P_c(w | v)`` adds to that of ``w``, drawn by ``PAIR_ERRORS``.  No word or
pair is pooled or left out for being rare.

A text has four statistics: its evidence per word (the length-normalised difference of both
log-likelihoods), the 2-norm and the 4-norm of the evidence for class 1 over its different
words and pairs, and the logarithm of its number of different words.  The norms say how strong the
strongest evidence is, and the last one what a text of that length shows by chance; so texts
of one language are not above those of another because its words are seen more or less often.
A logistic function of the four, learnt on other labelled rows, is the score.  All of them
are sums over words, so parts of a model add up.

The model stays a table.  Its ``HEAD`` most frequent entries are broadcast; all others are
joined with the texts' words and pairs, of which a fixed bitmap lets those pass that may be
in the table.  The split changes nothing in the scores.

Rows with ``crc32(doc_id) % 5 == 0`` teach nothing.  Folds 1 to 3 are counted, all
rows of them; fold 4 calibrates, at most ``CALIBRATION`` rows in hash order.

Edge cases: a null or empty text has statistics of 0; a doc_id with several labels
is toxic if one says so; null labels and ids of labels are left out; a null doc_id
counts as held out; without rows of both classes every score is 0 (and without both among those that
calibrate, all learnt rows do); rows that repeat
are scored alike; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrain.llm.common import mark, release, sized_broadcast, slices, staged, sweep, table

DISCOUNT = 0.75
#: Standard errors by which the evidence of words, and of pairs beyond their words, is drawn to 0
#: (cross-validated over folds 1 to 4 of sf0.1, 3,155 rows: 53 errors; 1.5 and 3.0 have 42 there, but
#: lets words through by chance where a table has a few hundred texts).
WORD_ERRORS, PAIR_ERRORS = 2.0, 3.0
#: Entries of the model that are broadcast (12 bytes each); the others are joined.
HEAD = 1_000_000
#: Bits of the bitmap of the joined entries (16 MB), as a power of two; 2^15 are one row.
BITMAP, BITMAP_ROW = 27, 15
CALIBRATION = 50_000
MEMO = 150_000
#: Ridge of the calibration by row, on standardised statistics, and its most Newton steps.
RIDGE, STEPS = 1e-4, 50

_STRIP = ".,;:!?()[]\"'|*#$%&<>"
#: Stand before the first and after the last word.
_START, _END = 0, 1
#: What is summed over a text: evidence, powers of positive evidence, words, different words.
SUMS = ("total", "second", "fourth", "words", "types")


class Words:
    """Chunks to 40-bit word hashes."""

    def __init__(self):
        self.memo: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        chunks = text.split() if text else []
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        for c in set(chunks).difference(memo):
            memo[c] = xxhash.xxh3_64_intdigest((c.strip(_STRIP) or c).lower().encode()) >> 24
        return np.fromiter(map(memo.__getitem__, chunks), np.uint64, len(chunks))


def pairs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's predecessor, and the words, both ends marked."""
    return np.concatenate([np.array([_START], np.uint64), words]), np.concatenate([words, np.array([_END], np.uint64)])


def pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """64-bit keys of pairs; the top bit tells them from words."""
    h = v * np.uint64(0x9E3779B97F4A7C15) + w * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32)) | np.uint64(1 << 63)


def _pairs(batches):
    """Rows ``vw, w, n0, n1``: 40 bits of v and the upper 24 of w, the lower 16 of w, texts of either class."""
    words = Words()
    for batch in slices(batches):
        found = ([], [])
        for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if len(h := words(t)):
                v, w = pairs(h)
                _, at = np.unique(pair_keys(v, w), return_index=True)
                found[y].append(np.stack([v[at] << np.uint64(24) | w[at] >> np.uint64(16), w[at] & np.uint64(0xFFFF)]))
        for y, part in enumerate(found):
            if part:
                vw, w = np.concatenate(part, axis=1)
                n = [pa.array(np.full(len(w), y == k, np.int64)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(vw.view(np.int64)), pa.array(w.astype(np.int32)), *n], ["vw", "w", "n0", "n1"])


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, text, toxic, fold`` of labelled rows outside the held-out fold."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.withColumn("fold", F.crc32(F.col("doc_id").cast("string")) % 5).filter("fold <> 0")
    return docs.select("doc_id", "text").join(sized_broadcast(known, 32), "doc_id")


def pair_counts(rows: DataFrame) -> DataFrame:
    """``v, w, n0, n1``: texts of either class that hold w after v."""
    n = rows.select("text", "toxic").mapInArrow(_pairs, "vw long, w int, n0 long, n1 long").groupBy("vw", "w").agg(F.sum("n0").cast("int").alias("n0"), F.sum("n1").cast("int").alias("n1"))
    w = F.shiftleft(F.col("vw").bitwiseAND((1 << 24) - 1), 16).bitwiseOR(F.col("w").cast("long"))
    return n.select(F.shiftrightunsigned("vw", 24).alias("v"), w.alias("w"), "n0", "n1")


def _less(n: Column, d: float) -> Column:
    return F.greatest(n - F.lit(d), F.lit(0.0))


def _drawn(ratio: Column, errors: float, a: Column, b: Column) -> Column:
    return F.signum(ratio) * F.greatest(F.lit(0.0), F.abs(ratio) - errors * F.sqrt(1 / (a + 1.0) + 1 / (b + 1.0)))


def evidence(counts: DataFrame, since: int, d: float = DISCOUNT) -> DataFrame | None:
    """``key, value, n``: what words and pairs add to a text's score, where it is not 0, and how often they were seen; None without both classes.

    Tables staged since the mark are removed once they are used, ``counts`` among them.
    """
    n = F.col("n0") + F.col("n1")
    k = staged(counts.groupBy("w").agg(F.count_if(F.col("n0") > 0).cast("int").alias("k0"), F.count_if(F.col("n1") > 0).cast("int").alias("k1")), "toxic-words")
    all_ = k.agg(F.sum("k0"), F.sum("k1"), F.count_if(F.col("k0") > 0), F.count_if(F.col("k1") > 0)).first()
    if not all_[0] or not all_[1]:
        return None
    shared = ((F.col("k0") > 0).cast("double") + (F.col("k1") > 0).cast("double")) / float(all_[2] + all_[3])
    model = [(total, types) for total, types in ((all_[0], all_[2]), (all_[1], all_[3]))]
    p0, p1 = (_less(F.col(c), d) / float(total) + d * types / total * shared for c, (total, types) in zip(("k0", "k1"), model, strict=True))
    own = k.filter(F.col("w") != _END).select(F.col("w").alias("key"), _drawn(F.ln(p1 / p0), WORD_ERRORS, F.col("k0"), F.col("k1")).alias("value"), (F.col("k0").cast("long") + F.col("k1")).alias("n"))
    histories = staged(counts.groupBy("v").agg(F.sum(n).alias("nv"), F.sum(F.least(n.cast("double"), F.lit(d))).alias("dv"), F.sum(_less(F.col("n0"), d)).alias("x0"), F.sum(_less(F.col("n1"), d)).alias("x1")), "toxic-histories")
    release(counts.sparkSession)
    rows = staged(counts.join(k, "w"), "toxic-joined")
    sweep(counts.sparkSession, since, k, histories, rows)
    rows = rows.join(histories, "v").select("v", "w", "n0", "n1", "k0", "k1", "nv", "dv", "x0", "x1")
    return own.filter("value <> 0").unionByName(rows.mapInArrow(_beyond(model, d), "key long, value double, n long"))


def _beyond(model: list[tuple[int, int]], d: float):
    """Evidence of pairs beyond that of their last words, where it is not 0; model: continuations and types of either class."""

    def run(batches):
        for batch in batches:
            v, w = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.uint64) for i in (0, 1))
            n0, n1, k0, k1, nv, dv, x0, x1 = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(2, 10))
            shared = ((k0 > 0).astype(float) + (k1 > 0)) / sum(types for _, types in model)
            p = [(np.maximum(k - d, 0) + d * types * shared) / total for k, (total, types) in zip((k0, k1), model, strict=True)]
            mean = sum(q * total for q, (total, _) in zip(p, model, strict=True)) / sum(total for total, _ in model)
            back = dv / nv
            both = np.maximum(n0 + n1 - d, 0) / nv + back * mean
            after = []
            for n, x, q in ((n0, x0, p[0]), (n1, x1, p[1])):
                below = both * q / mean
                after.append(np.where(x > 0, (1 - back) * np.maximum(n - d, 0) / np.where(x > 0, x, 1) + back * below, below))
            ratio = np.log(after[1] / after[0]) - np.log(p[1] / p[0])
            value = np.copysign(np.maximum(0, np.abs(ratio) - PAIR_ERRORS * np.sqrt(1 / (n0 + 1) + 1 / (n1 + 1))), ratio)
            at = value != 0
            yield pa.RecordBatch.from_arrays([pa.array(pair_keys(v[at], w[at]).view(np.int64)), pa.array(value[at]), pa.array((n0 + n1)[at].astype(np.int64))], ["key", "value", "n"])

    return run


def _digest() -> tuple[Column, Column]:
    """128 bits of a text."""
    return F.xxhash64("text"), F.xxhash64(F.lit("second"), "text")


def _place(key: np.ndarray) -> np.ndarray:
    """Bits of keys in the bitmap; :func:`_bit` is the same on columns."""
    return ((key ^ key >> np.uint64(31)) & np.uint64((1 << BITMAP) - 1)).astype(np.int64)


def _bit(key: Column) -> Column:
    return key.bitwiseXOR(F.shiftrightunsigned(key, 31)).bitwiseAND((1 << BITMAP) - 1)


class Model:
    """The evidence as a broadcast head, and the table of the others with its bitmap (None if the head holds all)."""

    def __init__(self, spark: SparkSession, table: DataFrame, head: int = HEAD):
        rows = table.count()
        first = table
        self.tail, bitmap = None, None
        if rows > head:
            ranked = table.orderBy(F.desc("n"), "key").limit(head)
            first = staged(ranked, "toxic-head")
            self.tail = staged(table.join(first.select("key"), "key", "left_anti").select("key", "value"), "toxic-tail")
            bit = _bit(F.col("key"))
            parts = self.tail.select(F.shiftright(bit, BITMAP_ROW).alias("row"), bit.bitwiseAND((1 << BITMAP_ROW) - 1).alias("bit")).distinct().groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits"))
            bitmap = np.zeros((1 << BITMAP - BITMAP_ROW, 1 << BITMAP_ROW - 3), np.uint8)
            for r in parts.toLocalIterator():  # at most 4,096 rows of 4 KB
                bitmap[r.row] = np.frombuffer(r.bits, np.uint8)
            bitmap = bitmap.ravel()
        got = first.select("key", "value").toArrow()  # at most HEAD rows of 16 bytes
        key, value = got.column("key").to_numpy().view(np.uint64), got.column("value").to_numpy()
        o = np.argsort(key)
        self.shared = spark.sparkContext.broadcast((key[o], value[o].astype(np.float32), bitmap))

    def statistics(self, docs: DataFrame, *columns: str) -> DataFrame:
        """``columns, total, second, fourth, words, types`` of rows with a text; see :func:`linear`."""
        kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
        sums = "total double, second double, fourth double, words long, types long"
        if self.tail is None:
            return docs.select(*columns, "text").mapInArrow(_score(self.shared), f"{kinds}, {sums}")
        docs = docs.withColumns(dict(zip(("d1", "d2"), _digest(), strict=True)))
        head = docs.select(*columns, "d1", "d2", "text").mapInArrow(_score(self.shared), f"{kinds}, d1 long, d2 long, {sums}")
        hits = docs.select("d1", "d2", "text").mapInArrow(_hits(self.shared), "d1 long, d2 long, key long, times int").dropDuplicates(["d1", "d2", "key"])
        value = F.col("value").cast("float").cast("double")
        square = F.pow(F.greatest(value, F.lit(0.0)), F.lit(2))
        more = hits.join(self.tail, "key").groupBy("d1", "d2").agg(F.sum(F.col("times") * value).alias("_total"), F.sum(square).alias("_second"), F.sum(square * square).alias("_fourth"))
        both = head.join(more, ["d1", "d2"], "left")
        return both.select(*columns, *((F.col(c) + F.coalesce(f"_{c}", F.lit(0.0))).alias(c) for c in SUMS[:3]), *SUMS[3:])


class Scorer:
    """Evidence of texts by the head of a model; remembers word hashes up to a bound."""

    def __init__(self, key: np.ndarray, value: np.ndarray, bitmap: np.ndarray | None):
        self.key, self.value, self.bitmap, self.words = key, value, bitmap, Words()

    def look(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
        """Keys of the text's words and pairs, where they stand in the head, whether they do; the number of words and of different ones."""
        h = self.words(text)
        keys = np.concatenate([h, pair_keys(*pairs(h))]) if len(h) else h
        at = np.minimum(np.searchsorted(self.key, keys), max(0, len(self.key) - 1))
        return keys, at, self.key[at] == keys if len(self.key) else np.zeros(len(keys), bool), len(h), len(np.unique(h))

    def __call__(self, text: str | None) -> tuple[float, float, float, int, int]:
        """Sum of the evidence, sums of the 2nd and 4th powers of what is positive of it (each key once), number of words and of different ones."""
        _, at, there, words, types = self.look(text)
        at, times = np.unique(at[there], return_counts=True)
        value = self.value[at].astype(float)
        square = np.maximum(value, 0) ** 2
        return math.fsum((value * times).tolist()), math.fsum(square.tolist()), math.fsum((square * square).tolist()), words, types

    def others(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Keys that may be in the table beside the head, and how often the text has them."""
        keys, _, there, _, _ = self.look(text)
        keys = keys[~there]
        bit = _place(keys)
        return np.unique(keys[self.bitmap[bit >> 3] >> (bit & 7) & 1 == 1], return_counts=True)


def _score(shared):
    def run(batches):
        score = Scorer(*shared.value)
        for batch in slices(batches):
            got = [score(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            sums = [pa.array([x[i] for x in got], pa.float64() if i < 3 else pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *sums], [*batch.schema.names[:-1], *SUMS])

    return run


def _hits(shared):
    def run(batches):
        score = Scorer(*shared.value)
        for batch in slices(batches):
            got = [score.others(t) for t in batch.column(2).to_pylist()]
            rows = pa.array(np.repeat(np.arange(len(got)), [len(k) for k, _ in got]))
            if len(rows):
                keys, times = (np.concatenate(x) for x in zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(keys.view(np.int64)), pa.array(times.astype(np.int32))], ["d1", "d2", "key", "times"])

    return run


def _clean(shared, weights: list[float], column: int):
    def run(batches):
        score = Scorer(*shared.value)
        for batch in slices(batches):
            got = np.array([score(t) for t in batch.column(column).to_pylist()], float).reshape(-1, len(SUMS))
            yield batch.filter(pa.array(statistics(got) @ weights[1:] + weights[0] < 0))

    return run


def ratios(n0: np.ndarray, n1: np.ndarray, d: float = DISCOUNT) -> np.ndarray:
    """Evidence of words by their counts, as :func:`evidence` has it (for tests)."""
    shared = ((n0 > 0).astype(float) + (n1 > 0)) / ((n0 > 0).sum() + (n1 > 0).sum())
    p = [np.maximum(n - d, 0) / n.sum() + np.minimum(n, d).sum() / n.sum() * shared for n in (n0, n1)]
    ratio = np.log(p[1] / p[0])
    return np.copysign(np.maximum(0, np.abs(ratio) - WORD_ERRORS * np.sqrt(1 / (n0 + 1) + 1 / (n1 + 1))), ratio)


def statistics(sums: np.ndarray) -> np.ndarray:
    """Rows of ``SUMS`` as the four statistics; :func:`linear` is the same on columns."""
    total, second, fourth, words, types = sums.T
    return np.stack([total / np.maximum(words, 1), np.sqrt(second), np.sqrt(np.sqrt(fourth)), np.log1p(types)], axis=1)


def linear(weights: list[float]) -> Column:
    """The argument of the logistic function, on the columns of :meth:`Model.statistics`."""
    each = [F.col("total") / F.greatest("words", F.lit(1)), F.sqrt("second"), F.sqrt(F.sqrt("fourth")), F.log1p("types")]
    out = F.lit(weights[0])
    for w, x in zip(weights[1:], each, strict=True):
        out = out + F.lit(w) * x
    return out


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> list[float]:
    """Intercept and weights of the logistic function of most likelihood, by Newton steps; ``ridge`` keeps weights of standardised columns finite."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    penalty = ridge * len(x) * np.append(0, np.ones(x.shape[1]))
    b = np.zeros(z.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -500, 500)))
        slope = z.T @ (z * (p * (1 - p))[:, None]) + np.diag(penalty + 1e-9)
        step = np.linalg.solve(slope, z.T @ (y - p) - penalty * b)
        b += step
        if np.abs(step).max() < 1e-10:
            break
    w = b[1:] / spread
    return [float(b[0] - w @ mean), *map(float, w)]


def fit(docs: DataFrame, labels: DataFrame, head: int = HEAD):
    """``(model, weights)``; None without rows of both classes."""
    spark, since = docs.sparkSession, mark()
    rows = labelled(docs, labels)
    counts = staged(pair_counts(rows.filter("fold < 4")), "toxic-pairs")
    release(spark)
    found = evidence(counts, since)
    if found is None:
        return None
    found = staged(found, "toxic-model")
    sweep(spark, since, found)
    found = Model(spark, found, head)
    weights = [-1.0, 0.0, 0.0, 0.0, 0.0]
    for fold in ("fold = 4", "fold > 0"):  # a tiny table may have nothing in the fourth
        scored = found.statistics(rows.filter(fold), "doc_id", "toxic")
        got = scored.orderBy(F.xxhash64("doc_id"), "total", "words").limit(CALIBRATION).drop("doc_id").toArrow()
        y = got.column("toxic").to_numpy()
        if 0 < y.sum() < len(y):
            sums = np.column_stack([got.column(c).to_numpy().astype(float) for c in SUMS])
            weights = calibrate(statistics(sums), y)
            break
    return found, weights


def toxicity(docs: DataFrame, labels: DataFrame, head: int = HEAD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True)).alias("held_out")
    fitted = fit(docs, labels, head)
    if fitted is None:
        return docs.select("doc_id", held, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    found, weights = fitted
    score = 1 / (1 + F.exp(-linear(weights)))
    return found.statistics(docs.select("doc_id", "text"), "doc_id").select("doc_id", held, score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, head: int = HEAD) -> DataFrame:
    """The rows of ``docs`` that :func:`toxicity` does not predict toxic, all columns kept; no shuffle of texts while the toxic ones are few."""
    fitted = fit(docs, labels, head)
    if fitted is None:
        return docs
    found, weights = fitted
    if found.tail is None:
        return docs.mapInArrow(_clean(found.shared, weights, docs.columns.index("text")), docs.schema)
    d1, d2 = _digest()
    bad = found.statistics(docs.select("text").withColumns({"_d1": d1, "_d2": d2}), "_d1", "_d2").filter(linear(weights) >= 0).select("_d1", "_d2").distinct()
    bad = sized_broadcast(staged(bad, "toxic-texts"), 32)
    return docs.join(bad, (d1 == bad["_d1"]) & (d2 == bad["_d2"]), "left_anti")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLE_SQL: dict[str, str] = {}
