"""MinHash near-duplicates with HyperMinHash registers.

Each text's set of distinct five-word shingles becomes 256 registers.  A register keeps of
the least hash that falls into it the number of leading zeros (6 bits) and the next 10 bits.
A large set is dealt once into 256 registers; a smaller one several times, by other hashes,
into 64, 16 or 4 registers each, so that registers are rarely empty and a band of 4 is as
telling for a short text as for a long one.  These are *levels*; a set near the border of two
levels is sketched at both, so that sets that may be similar share a level.  Texts with equal
sets are one *class*; classes are compared where a band of 4 registers of a level is equal.

1. Star round: in each band bucket every class is paired with the one that meets most others.
2. Pairs pass a size bound and the collision-corrected Jaccard estimate with a margin of
   6.5 standard errors; what passes is verified on full shingle sets.  Verified links
   give components.
3. In buckets that still hold several components, each is one row.  Components of one
   class are compared on registers.  A larger component has the range of each register over
   its classes: where the ranges of two components overlap in too few registers, no two of
   their classes can pass the estimate; else the two are noted.  The classes of the smaller
   component are then compared, on registers and full sets, with those of the larger one,
   which are dealt in blocks; one verified link for each block is enough.

So any two classes that share a bucket are linked, or known to be connected, or
compared.  Rows come out for noted components only, not for the pairs of a bucket or of a
component.  With 64 bands, two sets at a similarity of exactly 0.75 share no bucket with a
probability of 3e-11 (2e-9 for unions of 8 to 16 shingles).

Edge cases: texts without words have an empty set, are linked with nothing and kept;
equal texts are linked; a null doc_id takes no part, its component is null and it is
kept; rows that repeat a doc_id are linked by their own texts; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrain.llm.common import mark, sized_broadcast, slices, staged, sweep, table
from callgrain.llm.components import components

WIDTH = 5
SIMILARITY = 75  # per cent
REGISTERS, ROWS = 256, 4
#: Least set size and registers of a dealing (a power of two) of each level.
LEVELS = ((0, 2), (32, 4), (128, 6), (512, 8))
MANTISSA = 10
EMPTY = 0xFFFF
MARGIN = 6.5
BLOCK = 512
#: Rows of a leader that one verification task compares at most.
DEAL = 200
MEMO = 150_000
#: Components whose register ranges a task gathers before it hands them on (1 KB each).
RANGES = 20_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to sorted distinct shingle hashes; remembers word hashes up to a bound."""

    def __init__(self, width: int = WIDTH):
        self.width, self.memo = width, {}
        #: An odd factor for each place in a shingle.
        self.place = mix64(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode().translate(_LOWER).split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        k = min(self.width, len(h))
        n = len(h) - k + 1
        total = np.full(n, k, np.uint64)
        for j in range(k):
            total += h[j : j + n] * self.place[j]
        return np.unique(mix64(total))


def level_of(n: int) -> int:
    return max(bits for least, bits in LEVELS if n >= least)


def levels(n: int, similarity: int = SIMILARITY) -> list[int]:
    """Levels of a set of ``n`` that a similar set may have: one or two."""
    return sorted({level_of(-(-n * similarity // 100)), level_of(n * 100 // similarity)})


def registers(shingles: np.ndarray, level: int) -> np.ndarray:
    """256 registers of 16 bits: 6 bits of leading zeros, 10 bits after the first one."""
    out = np.full(REGISTERS, EMPTY, np.uint16)
    if not len(shingles):
        return out
    times = REGISTERS >> level
    if times > 1:
        h = np.sort(mix64(shingles[None, :] + mix64(np.arange(1, times + 1, dtype=np.uint64))[:, None]), axis=1)
    else:
        h = shingles[None, :]
    bucket = ((h >> np.uint64(64 - level)).astype(np.int64) + (np.arange(times) << level)[:, None]).ravel()
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    rest = h.ravel()[first] << np.uint64(level)  # sorted hashes: the first of a bucket is its least
    zeros = np.minimum(64 - np.frexp(rest.astype(np.float64))[1], 62).astype(np.uint64)
    mantissa = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    out[bucket[first]] = (zeros << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    return out


def chance(na: np.ndarray, nb: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Probability that registers of different least hashes are equal, by set sizes."""
    edge = np.minimum(0.5 ** np.arange(57), 1 - 1e-12)

    def cells(n):
        m = np.maximum(n / 2.0**level, 1e-9)[:, None]
        return -np.diff(1 - (1 - edge) ** m, axis=1)

    return (cells(na) * cells(nb)).sum(1) / 2**MANTISSA


def possible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, level: np.ndarray, similarity: int = SIMILARITY) -> np.ndarray:
    """Whether pairs of register rows of a level may reach the similarity; ``na, nb``: set sizes."""
    t = similarity / 100
    either = np.maximum(((a != EMPTY) | (b != EMPTY)).sum(1), 1)
    equal = ((a == b) & (a != EMPTY)).sum(1)
    p = chance(na, nb, level)
    estimate = (equal / either - p) / (1 - p)
    sizes = 100 * np.minimum(na, nb) >= similarity * np.maximum(na, nb)
    return sizes & (estimate + MARGIN * np.sqrt(t * (1 - t) / either) >= t)


def _sketch(width: int, similarity: int):
    """The text is the last column; the others pass through."""

    def run(batches):
        shingle = Shingler(width)
        for batch in slices(batches):
            n, lo, hi, regs = [], [], [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                s = shingle(text)
                d = xxhash.xxh3_128_digest(s.tobytes())
                n.append(len(s))
                lo.append(int.from_bytes(d[:8], "little", signed=True))
                hi.append(int.from_bytes(d[8:], "little", signed=True))
                regs.append([{"level": x, "regs": registers(s, x).tobytes()} for x in levels(len(s), similarity)] if len(s) else [])
            kind = pa.list_(pa.struct([("level", pa.int32()), ("regs", pa.binary())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(regs, kind)], [*batch.schema.names[:-1], "n", "s1", "s2", "regs"])

    return run


def band_keys(level, regs):
    """``key, band`` of the buckets of a register row (native): its bands that are not all empty."""
    band = F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // ROWS - 1)), lambda i: F.struct(i.alias("i"), F.substring(regs, i * 2 * ROWS + 1, F.lit(2 * ROWS)).alias("v")))
    band = F.filter(band, lambda x: x["v"] != F.lit(b"\xff" * (2 * ROWS)))
    return F.transform(band, lambda x: F.struct(F.xxhash64(level, x["i"], x["v"]).alias("key"), x["i"].alias("band")))


def _estimate(similarity: int):
    def run(batches):
        for batch in slices(batches):
            if batch.num_rows:
                na, nb, level = (batch.column(c).to_numpy() for c in ("na", "nb", "level"))
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
                keep = pa.array(possible(a, b, na, nb, level, similarity))
                yield batch.select(["a", "b"]).filter(keep)

    return run


def _sets(width: int):
    """Rows ``doc, shingles``: each text's sorted set."""

    def run(batches):
        shingle = Shingler(width)
        for batch in slices(batches, 256):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["doc", "shingles"])

    return run


def _ranges(batches):
    """Least and greatest registers by ``label, level``; partial, or whole where the rows of a key lie together."""
    held: dict = {}

    def out():
        keys, low, high = zip(*((k, lo, hi) for k, (lo, hi) in held.items()), strict=True) if held else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int32()), pa.array([x.tobytes() for x in low], pa.binary()), pa.array([x.tobytes() for x in high], pa.binary())], ["label", "level", "lo", "hi"])

    for batch in slices(batches):
        for label, level, lo, hi in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            lo, hi = np.frombuffer(lo, np.uint16), np.frombuffer(hi, np.uint16)
            key = label, level
            if key in held:
                held[key] = np.minimum(held[key][0], lo), np.maximum(held[key][1], hi)
            else:
                if len(held) >= RANGES:
                    yield out()
                    held.clear()
                held[key] = lo, hi
    yield out()


def _verify(similarity: int):
    """Streams rows sorted by ``left, salt, role``; holds one leader's set at a time."""

    def run(batches):
        at, leader = None, None
        for batch in slices(batches):
            a, b = [], []
            for left, salt, role, doc, raw in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if role == 0:
                    at, leader = (left, salt), np.frombuffer(raw, np.uint64)
                elif (left, salt) == at:
                    s = np.frombuffer(raw, np.uint64)
                    common = common_count(s, leader)
                    if 100 * common >= similarity * (len(s) + len(leader) - common):
                        a.append(left)
                        b.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def text_key() -> tuple:
    """Two native 64-bit hashes of the text that tell apart the rows of one doc_id."""
    return F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), F.col("text")).alias("t2")


class _Linker:
    def __init__(self, docs: DataFrame, width: int, similarity: int):
        self.width, self.similarity = width, similarity
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
        keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(), "text")
        self.rows = staged(keyed.mapInArrow(_sketch(width, similarity), "doc_id long, t1 long, t2 long, n long, s1 long, s2 long, regs array<struct<level: int, regs: binary>>"), "sketch")
        full = self.rows.filter("n > 0 AND doc_id IS NOT NULL")
        classes = full.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "n", "regs")).alias("c"))
        self.table = classes = staged(classes.select("s1", "s2", "c.*"), "classes")
        self.classes = classes.select("s1", "s2", F.col("doc_id").alias("rep"), "n")
        #: One row for each class and level.
        self.sketches = classes.select(F.col("doc_id").alias("rep"), "n", F.explode("regs").alias("r")).select("rep", "n", "r.*")

    def buckets(self) -> DataFrame:
        """``key, band, rep, level, size, lead``: buckets of at least two classes.

        The lead is the class that meets most others over all its buckets: the text that
        a group of edited copies comes from, if it is there.
        """
        rows = self.sketches.select("rep", "level", F.explode(band_keys(F.col("level"), F.col("regs"))).alias("b")).select("rep", "level", "b.*")
        many = rows.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
        rows = staged(rows.join(many, "key"), "sized")
        met = rows.groupBy("rep").agg(F.sum("size").alias("met"))
        lead = rows.join(met, "rep").groupBy("key").agg(F.max(F.struct("met", (-F.col("rep")).alias("rep"))).alias("l")).select("key", (-F.col("l.rep")).alias("lead"))
        return rows.join(lead, "key")

    def estimated(self, pairs: DataFrame) -> DataFrame:
        """Of the pairs ``a, b, level`` those that sizes and registers allow."""
        side = lambda x: self.sketches.select(F.col("rep").alias(x), "level", F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))
        p = pairs.join(side("a"), ["a", "level"]).join(side("b"), ["b", "level"])
        return p.select("a", "b", "level", "na", "nb", "ra", "rb").mapInArrow(_estimate(self.similarity), "a long, b long").distinct()

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of the staged pairs ``a, b`` those whose full sets are similar; the leader of a pair is ``a``."""
        per = pairs.groupBy("a").agg(F.count("*").alias("_n")).select("a", F.ceil(F.col("_n") / DEAL).cast("int").alias("salts"))
        lead = per.select(F.col("a").alias("doc"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).select("doc", F.col("doc").alias("left"), "salt", F.lit(0).alias("role"))
        follow = pairs.join(per, "a").select(F.col("b").alias("doc"), F.col("a").alias("left"), F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"))
        return self._compared(lead.union(follow), _verify(self.similarity))

    def ranges(self, labels: DataFrame) -> DataFrame:
        """``label, level, lo, hi``: least and greatest registers of the larger components, combined before the shuffle."""
        kind = "label long, level int, lo binary, hi binary"
        own = self.sketches.join(labels, F.col("rep") == F.col("node")).select(F.col("component").alias("label"), "level", F.col("regs").alias("lo"), F.col("regs").alias("hi"))
        part = own.mapInArrow(_ranges, kind).repartition("label", "level").sortWithinPartitions("label", "level")
        return part.mapInArrow(_ranges, kind)

    def across(self, buckets: DataFrame, labels: DataFrame) -> DataFrame:
        """``a, b``: components that may be linked, the smaller one first.

        A bucket holds one row for each component in it, with the set sizes of its classes
        there and its registers or their ranges; two components are looked at on the lowest
        level that similar classes of theirs share.
        """
        rows = buckets.filter("size > 2")  # two members: the star round has compared them
        rows = rows.join(labels, F.col("rep") == F.col("node"), "left").select("key", "band", "rep", "level", "lead", F.coalesce("component", "rep").alias("label"))
        rows = rows.join(self.classes.select(F.col("rep").alias("_r"), F.col("n").alias("_n")), F.col("rep") == F.col("_r"))
        rows = rows.groupBy("key", "band", "level", "lead", "label").agg(F.min("rep").alias("rep"), F.min("_n").alias("n"), F.max("_n").alias("most"))
        mixed = rows.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
        members = labels.groupBy("component").agg(F.count("*").alias("members"))
        rows = rows.join(mixed, "key").join(members, F.col("label") == F.col("component"), "left").withColumn("members", F.coalesce("members", F.lit(1))).drop("component")
        nb = F.ceil(F.col("size") / BLOCK).cast("int")
        rows = rows.withColumn("nb", nb).withColumn("block", F.pmod(F.xxhash64("label"), F.col("nb")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        rows = rows.select("key", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), (F.col("block") > F.col("other")).alias("second"), "rep", "level", "band", "label", "lead", "members", "n", "most")
        single = rows.filter("members = 1").join(self.sketches.select("rep", "level", F.col("regs").alias("lo"), F.lit(None).cast("binary").alias("hi")), ["rep", "level"])
        more = rows.filter("members > 1").join(staged(self.ranges(labels), "ranges"), ["label", "level"])
        dealt = single.unionByName(more).repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "second", "label")
        met = dealt.select("key", "bi", "bj", "second", "rep", "n", "label", "lead", "members", "level", "lo", "hi", "band", "most").mapInArrow(_across(self.similarity), "a long, b long")
        return met.distinct()

    def joined(self, noted: DataFrame, labels: DataFrame) -> DataFrame:
        """Verified links ``a, b`` between classes of the noted components."""
        own = labels.select(F.col("node").alias("doc"), F.col("component").alias("label"))
        # a component of one class has no row in labels
        named = noted.select(F.col("a").alias("_g")).union(noted.select("b")).distinct()
        own = own.union(named.join(labels, F.col("_g") == F.col("node"), "left_anti").select(F.col("_g").alias("doc"), F.col("_g").alias("label")))
        # the classes of the larger component in nb blocks, those that come to it in nc chunks: a task has one of either
        per = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")
        sizes = own.groupBy(F.col("label").alias("_s")).agg(F.count("*").alias("_k"))
        come = noted.join(sizes, F.col("a") == F.col("_s")).groupBy(F.col("b").alias("_l")).agg(per(F.sum("_k")).alias("nc"))
        parts = come.join(sizes, F.col("_l") == F.col("_s")).select("_l", "nc", per(F.col("_k")).alias("nb"))
        block, chunk = (F.pmod(F.xxhash64("doc"), F.col(n)).cast("int") for n in ("nb", "nc"))
        salt = F.col("block") * F.col("nc") + F.col("chunk")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        hosts = own.join(parts, F.col("label") == F.col("_l")).withColumns({"block": block, "chunk": each("nc")})
        hosts = hosts.select("doc", F.col("label").alias("left"), salt.alias("salt"), F.lit(0).alias("role"))
        guests = noted.join(parts, F.col("b") == F.col("_l")).join(own, F.col("a") == F.col("label"))
        guests = guests.withColumns({"chunk": chunk, "block": each("nb")}).select("doc", F.col("b").alias("left"), salt.alias("salt"), F.lit(1).alias("role"))
        return self._compared(hosts.union(guests), _verify_blocks(self.similarity))

    def _compared(self, jobs: DataFrame, verify) -> DataFrame:
        """Deal the sets of ``doc`` by ``left, salt``, role 0 first, and run ``verify`` on them; each set is made once."""
        jobs = staged(jobs.select("doc", "left", "salt", "role"), "jobs")
        wanted = staged(jobs.select("doc").distinct(), "wanted")
        text = self.docs.join(sized_broadcast(wanted, 16), F.col("doc_id") == F.col("doc"), "left_semi").select("doc_id", "text")
        sets = staged(text.mapInArrow(_sets(self.width), "doc long, shingles binary"), "sets")
        dealt = sets.join(sized_broadcast(jobs, 32), "doc").select("left", "salt", "role", "doc", "shingles")
        return dealt.repartition("left", "salt").sortWithinPartitions("left", "salt", "role").mapInArrow(verify, "a long, b long")


def overlapping(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray, similarity: int = SIMILARITY) -> np.ndarray:
    """Whether any register rows within the ranges of ``a`` and of each row of ``b`` may be :func:`possible`.

    At most the registers whose ranges overlap are equal, at least those that no row leaves
    empty count; without the correction for collisions the estimate only gets larger.
    """
    t = similarity / 100
    equal = ((lo_a <= hi_b) & (lo_b <= hi_a) & (lo_a != EMPTY) & (lo_b != EMPTY)).sum(1)
    either = np.maximum(((hi_a != EMPTY) | (hi_b != EMPTY)).sum(1), 4)  # what is asked for grows from there on, and is nothing before
    return equal / either + MARGIN * np.sqrt(t * (1 - t) / either) >= t


def _across(similarity: int):
    """Groups (key, bi, bj) of at most two blocks arrive in a row."""

    def flush(rows):
        if len(rows) < 2:
            return [], []
        second = np.array([r[0] for r in rows])
        rep, n, label, members = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3, 5))
        lead, band = rows[0][4], rows[0][9]
        regs = np.frombuffer(b"".join(r[7] for r in rows), np.uint16).reshape(-1, REGISTERS)
        high = np.frombuffer(b"".join(r[8] or r[7] for r in rows), np.uint16).reshape(-1, REGISTERS)
        words, empty = regs.view(np.uint64), np.uint64(2**64 - 1)
        level = np.full(len(rows), rows[0][6])
        two = second.any()
        single = members == 1
        most = np.array([r[10] for r in rows], np.int64)
        lowest, highest = (np.array([levels(x, similarity)[0] for x in y.tolist()]) for y in (n, most))
        a, b = [], []

        def note(i: int, k: int) -> None:
            x, y = (i, k) if (members[i], label[i]) < (members[k], label[k]) else (k, i)
            a.append(int(label[x]))
            b.append(int(label[y]))

        for i in range(len(rows) - 1):
            if two and second[i]:
                break
            j = np.flatnonzero(second) if two else np.arange(i + 1, len(rows))
            # classes of either may be similar, and this is the lowest level that they share
            near = (similarity * n[j] <= 100 * most[i]) & (similarity * n[i] <= 100 * most[j])
            near &= (np.maximum(lowest[i], lowest[j]) <= level[i]) & (np.maximum(highest[i], highest[j]) >= level[i])
            wide = j[near & ~(single[j] & single[i])]
            if len(wide):
                for k in wide[overlapping(regs[i], high[i], regs[wide], high[wide], similarity)].tolist():
                    note(i, k)
            if not single[i] or rep[i] == lead:
                continue
            small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            # a pair with two common levels is looked at on the lower one
            j = j[single[j] & (100 * small >= similarity * large) & (rep[j] != lead) & (np.maximum(lowest[j], lowest[i]) == level[i])]
            if len(j):
                j = j[possible(np.broadcast_to(regs[i], (len(j), REGISTERS)), regs[j], np.full(len(j), n[i]), n[j], level[j], similarity)]
                # only in the first band that the two share; that its bucket is left out means they were compared
                shared = (words[i] == words[j]) & (words[i] != empty)
                j = j[shared.argmax(1) == band]
            for k in j.tolist():
                note(i, k)
        return a, b

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in flush(rows)], ["a", "b"])

    def run(batches):
        at, rows = None, []
        for batch in slices(batches):
            cols = [batch.column(i).to_pylist() for i in range(14)]
            for key, bi, bj, *row in zip(*cols, strict=True):
                if (key, bi, bj) != at:
                    if len(rows) > 1:
                        yield batch_of(rows)
                    at, rows = (key, bi, bj), []
                rows.append(row)
        yield batch_of(rows)

    return run


def common_count(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    pos = np.searchsorted(large, small)
    return int((large[np.minimum(pos, len(large) - 1)] == small).sum())


def _verify_blocks(similarity: int):
    """Streams rows sorted by ``left, salt, role``; holds the sets of one block of a component."""

    def run(batches):
        at, docs, sets, sizes = None, [], [], None
        at_level: dict = {}
        for batch in slices(batches):
            a, b = [], []
            for left, salt, role, doc, raw in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (left, salt) != at:
                    at, docs, sets, sizes = (left, salt), [], [], None
                    at_level = {}
                s = np.frombuffer(raw, np.uint64)
                if role == 0:
                    docs.append(doc)
                    sets.append(s)
                    continue
                if not sets:
                    continue
                if sizes is None:
                    sizes = np.array([len(x) for x in sets])
                like = np.zeros(len(sets), bool)
                for level in levels(len(s), similarity):
                    if level not in at_level:
                        mine = np.array([i for i, x in enumerate(sets) if level in levels(len(x), similarity)], np.int64)
                        at_level[level] = mine, np.stack([registers(sets[i], level) for i in mine]) if len(mine) else None
                    mine, regs = at_level[level]
                    if len(mine):
                        like[mine] |= possible(np.broadcast_to(registers(s, level), regs.shape), regs, np.full(len(mine), len(s)), sizes[mine], np.full(len(mine), level), similarity)
                for k in np.flatnonzero(like).tolist():
                    common = common_count(s, sets[k])
                    if 100 * common >= similarity * (len(s) + len(sets[k]) - common):
                        a.append(docs[k])
                        b.append(doc)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _classified(docs: DataFrame, width: int, similarity: int) -> DataFrame:
    """``doc_id, t1, t2, n, comp`` for every row; comp is null for a null doc_id."""
    k = _Linker(docs, width, similarity)
    spark, at = docs.sparkSession, mark()
    buckets = staged(k.buckets(), "buckets")
    sweep(spark, at, buckets)
    star = buckets.filter("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b"), "level").distinct()
    links = staged(k.verified(staged(k.estimated(star), "star")), "verified")
    labels = staged(components(links), "labels")
    sweep(spark, at, buckets, labels)
    noted = staged(k.across(buckets, labels), "across")
    # without a pair of components to compare, or a link between two, the labels stand
    if noted.limit(1).count():
        more = staged(k.joined(noted, labels), "joined")
        if more.limit(1).count():
            links = labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)
            labels = staged(components(links), "labels")
    sweep(spark, at, labels)
    own = k.classes.select("s1", "s2", "rep").join(labels, F.col("rep") == F.col("node"), "left").select("s1", "s2", F.coalesce("component", "rep").alias("comp"))
    # sets without shingles are one value for many rows: they keep out of the join
    full = k.rows.filter("n > 0 AND doc_id IS NOT NULL").join(own, ["s1", "s2"]).select("doc_id", "t1", "t2", "n", "comp")
    rest = k.rows.filter("n = 0 OR doc_id IS NULL").select("doc_id", "t1", "t2", "n", F.col("doc_id").alias("comp"))
    return full.unionByName(rest)


def near_duplicates(docs: DataFrame, width: int = WIDTH, similarity: int = SIMILARITY) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``."""
    rows = _classified(docs, width, similarity)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("comp"), F.lit(True)).alias("kept"))


def without_copies(docs: DataFrame, width: int = WIDTH, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` of which one stands for each component, all columns kept.

    That is the row of the least doc_id; where rows share it, the one of the least text
    hashes; of rows that repeat id and text the one of the least hash over all columns.
    Rows without shingles stay unless they repeat id and text, rows without a doc_id all stay.
    """
    spark, at = docs.sparkSession, mark()
    found = staged(_classified(docs, width, similarity).filter("doc_id IS NOT NULL"), "classified")
    row = F.struct("doc_id", "t1", "t2")
    # a component is its least doc_id, so only rows of that id can stay; those without shingles are told apart by text
    alone = F.when(F.col("n") == 0, F.col("t1")).otherwise(F.lit(0))
    rows = found.groupBy("doc_id", "t1", "t2", "comp", alone.alias("alone")).agg(F.count("*").alias("times"))
    own = rows.filter("doc_id = comp")
    least = own.groupBy("doc_id", "alone").agg(F.min(row).alias("m"))
    own = own.join(least, ["doc_id", "alone"]).select("doc_id", "t1", "t2", "times", (row == F.col("m")).alias("stays"))
    rows = own.union(rows.filter("doc_id <> comp").select("doc_id", "t1", "t2", "times", F.lit(False)))
    rows = staged(rows.filter("NOT stays OR times > 1").withColumnsRenamed({"doc_id": "_id", "t1": "_t1", "t2": "_t2"}), "gone")
    sweep(spark, at, rows)
    t1, t2 = text_key()
    gone = sized_broadcast(rows)
    same = (F.col("doc_id").cast("long") == F.col("_id")) & (t1 == F.col("_t1")) & (t2 == F.col("_t2"))
    kept = docs.join(gone, same, "left_anti")
    again = rows.filter("stays")
    if again.limit(1).count():
        # the least row of each, combined before the shuffle
        row = F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_row")
        first = docs.join(sized_broadcast(again), same).groupBy("_id", "_t1", "_t2").agg(row)
        kept = kept.unionByName(first.select("_row.*"))
    return kept


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op9_near_duplicates": op9_near_duplicates}
ORACLE_SQL: dict[str, str] = {}
