"""Suffix-array removal of long repeated byte strings.

A byte goes if a 400-byte string that covers it also starts anywhere else in the
corpus.  Suffix arrays sort what can match, not the whole corpus in one place:

1. Every 400-byte string (*window*) has an anchor, the 64-byte string in it with the
   least hash.  Equal windows have equal anchors, so consecutive windows of one anchor
   form a *segment*, and only segments of one anchor can share a window.
2. Segments are counted by content.  Each content is one entry with a multiplicity; above
   one, all of its windows repeat.  An anchor that has one entry only, without a repeat of
   the anchor in it, is done: an array of it has no neighbours.
3. The entries of the other anchors are cut from the texts and dealt by anchor; blocks of
   whole anchors are suffix-sorted in two stages (:mod:`callgrain.llm.two_stage`), and windows
   whose common prefix with a neighbour in the array is 400 bytes repeat.
4. An anchor whose entries exceed ``HOT`` bytes (a passage shorter than 400 bytes in very
   many documents) is not gathered in one array: its entries are divided anew by a longer
   anchor (300 bytes), with steps 2 and 3 for the parts.  What is still above ``HOT`` - a
   passage of 300 to 399 bytes, with other bytes around it each time - has its windows
   counted by their 128-bit digests, which is exact as well and spreads over all tasks.

Passages (``removals`` with ``passages``) are runs of 50 words or more that repeated strings of
200 bytes cover; they are reported, not removed.  A 400-byte string that repeats lies in a
run of 200-byte strings that repeat, in each place it stands, so only texts with a run of
400 bytes or more are searched for it.

Texts are known by a digest of their bytes, so copies of a text are handled once, and the
texts are shuffled only where the list of wanted segments is too long to broadcast.

Edge cases: a null text is an empty one; texts under 400 bytes lose nothing; rows that
repeat a text, even with the same doc_id, count as repeats of each other; removal works
on bytes and may cut a UTF-8 character, whose stray bytes ``deduplicated`` drops from the
text; an empty table gives no rows; further columns are ignored (kept by ``deduplicated``).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrain.llm.common import mark, sized_broadcast, slices, staged, sweep, table
from callgrain.llm.two_stage import common_prefixes, suffix_array

LENGTH = 400
ANCHOR = 64
#: A passage is a repeated run of this many words or more.  Strings of four bytes a word
#: find its runs, and an anchor is a fifth of a string.
PASSAGE_WORDS = 50
PASSAGE_BYTES = 4 * PASSAGE_WORDS
PASSAGE_ANCHOR = PASSAGE_BYTES // 5
#: The longer anchor of hot anchors, as a share of the length.
SECOND = 0.75
#: Bytes of one anchor's segments that a task sorts at most, and bytes of a block of anchors.
HOT = 2_000_000
BLOCK = 1_000_000
#: Windows of a text that are hashed at once.
CHUNK = 1 << 18
#: Ends a segment in a block; no UTF-8 text holds this byte.
END = b"\xfe"

_POS = np.uint64((1 << 30) - 1)


class Anchors:
    """Cuts a text's windows into segments of one anchor value."""

    def __init__(self, length: int, anchor: int):
        self.length, self.k = length, anchor
        p = np.uint64(0xD6E8FEB86659FD93)
        n = CHUNK + length + 1
        self.power = np.multiply.accumulate(np.full(n, p, np.uint64))
        self.inverse = np.multiply.accumulate(np.full(n, pow(int(p), -1, 1 << 64), np.uint64))

    def hashes(self, b: np.ndarray) -> np.ndarray:
        h = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(b.astype(np.uint64) * self.power[: len(b)], out=h[1:])
        g = (h[self.k :] - h[: -self.k]) * self.inverse[: len(b) - self.k + 1]
        g = (g ^ (g >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return g ^ (g >> np.uint64(29))

    def segments(self, text: bytes):
        """``anchor, first window, windows, whether the anchor repeats`` for each segment in order."""
        windows = len(text) - self.length + 1
        whole = np.frombuffer(text, np.uint8)
        for at in range(0, windows, CHUNK):
            n = min(CHUNK, windows - at)
            g = self.hashes(whole[at : at + n + self.length - 1])
            # least hash, then leftmost place: the place rides in the low bits
            v = (g & ~_POS) | np.arange(len(g), dtype=np.uint64)
            w = self.length - self.k + 1
            tiled = np.concatenate([v, np.full(-len(v) % w, ~np.uint64(0))]).reshape(-1, w)
            ahead = np.minimum.accumulate(tiled[:, ::-1], axis=1)[:, ::-1].ravel()
            behind = np.minimum.accumulate(tiled, axis=1).ravel()
            place = (np.minimum(ahead[:n], behind[w - 1 : w - 1 + n]) & _POS).astype(np.int64)
            value = g[place]
            starts = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
            ends = np.append(starts[1:], n)
            again = place[starts] != place[ends - 1]
            yield from zip(value[starts].view(np.int64).tolist(), (starts + at).tolist(), (ends - starts).tolist(), again.tolist(), strict=True)


def text_key(text):
    """Two native 64-bit hashes of the text that stand for it in joins."""
    return F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")


OCCURRENCE = "anchor long, digest long, h1 long, h2 long, row long, lo int, n int, again boolean"


def _occurrences(length: int, anchor: int):
    def run(batches):
        find = Anchors(length, anchor)
        for batch in slices(batches):
            out = [[] for _ in range(8)]
            for h1, h2, row, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                raw = text.encode()
                for value, lo, n, again in find.segments(raw):
                    digest = xxhash.xxh3_64_intdigest(raw[lo : lo + n + length - 1]) - (1 << 63)
                    for column, x in zip(out, (value, digest, h1, h2, row, lo, n, again), strict=True):
                        column.append(x)
                if len(out[0]) > 20_000:
                    yield _batch(out)
                    out = [[] for _ in range(8)]
            yield _batch(out)

    kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.bool_()]

    def _batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["anchor", "digest", "h1", "h2", "row", "lo", "n", "again"])

    return run


SEGMENT = "anchor long, hot boolean, h1 long, h2 long, lo int, n int, bytes binary"


def _cut(length: int):
    def run(batches):
        for batch in slices(batches):
            out = [[] for _ in range(7)]
            for h1, h2, text, jobs in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                raw = text.encode()
                for j in jobs:
                    for column, x in zip(out, (j["anchor"], j["hot"], h1, h2, j["lo"], j["n"], raw[j["lo"] : j["lo"] + j["n"] + length - 1]), strict=True):
                        column.append(x)
                if len(out[0]) > 5000:
                    yield _batch(out)
                    out = [[] for _ in range(7)]
            yield _batch(out)

    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def _batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["anchor", "hot", "h1", "h2", "lo", "n", "bytes"])

    return run


SPAN = "h1 long, h2 long, s int, e int"


def _spans(h1, h2, s, e):
    return pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(s, pa.int32()), pa.array(e, pa.int32())], ["h1", "h2", "s", "e"])


def repeated_windows(segments: list[bytes], counts: list[int], length: int) -> list[np.ndarray]:
    """For each segment of a block, which of its windows repeat in the block: suffix array, then adjacent common prefixes."""
    joined = np.frombuffer(END.join(segments) + END, np.uint8)
    start = np.cumsum([0, *(len(s) + 1 for s in segments[:-1])])
    valid = np.zeros(len(joined), bool)
    for s, n in zip(start.tolist(), counts, strict=True):
        valid[s : s + n] = True
    sa = suffix_array(joined, length)
    sa = sa[valid[sa]]
    same = common_prefixes(joined, sa, length) >= length
    again = np.zeros(len(joined), bool)
    again[sa[:-1][same]] = True
    again[sa[1:][same]] = True
    return [again[s : s + n] for s, n in zip(start.tolist(), counts, strict=True)]


def _sort_blocks(length: int):
    """Rows arrive sorted by anchor; blocks of whole anchors are sorted, one at a time."""

    def flush(rows):
        h1s, h2s, ss, es = [], [], [], []
        found = repeated_windows([r[4] for r in rows], [r[3] for r in rows], length) if rows else []
        for (h1, h2, lo, _, _), again in zip(rows, found, strict=True):
            edge = np.flatnonzero(np.diff(again.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
            for s, e in (edge + lo).tolist():
                h1s.append(h1)
                h2s.append(h2)
                ss.append(s)
                es.append(e + length - 1)
        return _spans(h1s, h2s, ss, es)

    def run(batches):
        at, rows, size = None, [], 0
        for batch in slices(batches):
            for anchor, *row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if anchor != at and size > BLOCK:
                    yield flush(rows)
                    rows, size = [], 0
                at = anchor
                rows.append(row)
                size += len(row[4]) + 1
        yield flush(rows)

    return run


def _window_digests(length: int):
    def run(batches):
        for batch in slices(batches):
            for h1, h2, lo, n, raw in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                view = memoryview(raw)
                for a in range(0, n, 10_000):
                    d = np.frombuffer(b"".join(xxhash.xxh3_128_digest(view[i : i + length]) for i in range(a, min(n, a + 10_000))), np.int64).reshape(-1, 2)
                    m = len(d)
                    yield pa.RecordBatch.from_arrays([pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(np.full(m, h1)), pa.array(np.full(m, h2)), pa.array(np.arange(lo + a, lo + a + m, dtype=np.int32))], ["d1", "d2", "h1", "h2", "at"])

    return run


PART = "anchor long, digest long, h1 long, h2 long, lo int, n int, again boolean, bytes binary"


def _divided(length: int, anchor: int):
    """Segments ``anchor, h1, h2, lo, bytes`` into parts by a longer anchor; the anchor of a part stands for both."""

    def run(batches):
        find = Anchors(length, anchor)
        for batch in slices(batches):
            rows = []
            for first, h1, h2, lo, raw in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                for value, at, n, again in find.segments(raw):
                    part = raw[at : at + n + length - 1]
                    key = xxhash.xxh3_64_intdigest(value.to_bytes(8, "little", signed=True), seed=first & 0xFFFFFFFFFFFFFFFF) - (1 << 63)
                    rows.append((key, xxhash.xxh3_64_intdigest(part) - (1 << 63), h1, h2, lo + at, n, again, part))
                if len(rows) > 2000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.bool_(), pa.binary()]

    def _batch(rows):
        columns = list(zip(*rows, strict=True)) if rows else [()] * 8
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in PART.split(", ")])

    return run


def _several(contents: DataFrame) -> DataFrame:
    """``anchor, _bytes`` of anchors of several entries, or with a repeat of their own; contents: ``anchor, n, length, again`` a row."""
    found = contents.groupBy("anchor").agg(F.count("*").alias("_k"), F.sum(F.col("n").cast("long") + F.col("length")).alias("_bytes"), F.max("again").alias("_again"))
    return found.filter("_k > 1 OR _again").select(F.col("anchor").alias("_a"), "_bytes")


def _in_blocks(cut: DataFrame, length: int) -> DataFrame:
    """Spans of the entries ``anchor, h1, h2, lo, n, bytes`` by suffix arrays over blocks of whole anchors."""
    dealt = cut.repartition("anchor").sortWithinPartitions("anchor").select("anchor", "h1", "h2", "lo", "n", "bytes")
    return dealt.mapInArrow(_sort_blocks(length), SPAN)


def _of_hot(cut: DataFrame, length: int) -> DataFrame:
    """Spans of the entries of hot anchors: in blocks by a longer anchor, by window digests beyond that."""
    parts = staged(cut.select("anchor", "h1", "h2", "lo", "bytes").mapInArrow(_divided(length, int(length * SECOND)), PART), "parts")
    contents = staged(parts.groupBy("anchor", "digest").agg(F.count("*").alias("copies"), F.min("n").alias("n"), F.max("again").alias("again")).withColumn("length", F.lit(length)), "part-contents")
    equal = _whole(parts, contents, length)
    entries = parts.dropDuplicates(["anchor", "digest"]).join(_several(contents), F.col("anchor") == F.col("_a"))
    entries = staged(entries.select("anchor", "h1", "h2", "lo", "n", "bytes", (F.col("_bytes") > HOT).alias("hot")), "part-entries")
    windows = entries.filter("hot").select("h1", "h2", "lo", "n", "bytes").mapInArrow(_window_digests(length), "d1 long, d2 long, h1 long, h2 long, at int")
    many = windows.groupBy("d1", "d2").agg(F.count("*").alias("_c")).filter("_c > 1").select("d1", "d2")
    rest = windows.join(many, ["d1", "d2"], "left_semi").select("h1", "h2", F.col("at").alias("s"), (F.col("at") + length).alias("e"))
    return equal.union(_in_blocks(entries.filter("NOT hot"), length)).union(rest)


def _whole(rows: DataFrame, contents: DataFrame, length: int) -> DataFrame:
    """Spans of the occurrences whose content repeats."""
    twice = sized_broadcast(contents.filter("copies > 1").select("anchor", "digest"), 32)
    return rows.join(twice, ["anchor", "digest"], "left_semi").select("h1", "h2", F.col("lo").alias("s"), (F.col("lo") + F.col("n") + (length - 1)).alias("e"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """``h1, h2, spans``: for each text with repeats (by its key) the byte spans that repeats cover; spans may touch or overlap."""
    texts = docs.select(*text_key(F.col("text")), F.xxhash64("doc_id").alias("row"), "text").filter(F.octet_length("text") >= length)
    found = staged(texts.mapInArrow(_occurrences(length, anchor), OCCURRENCE), "segments")
    # by content; a hot anchor spreads over its contents, and equal contents are combined before the shuffle
    contents = found.groupBy("anchor", "digest").agg(F.count("*").alias("copies"), F.min(F.struct("h1", "h2", "row", "lo", "n")).alias("one"), F.max("again").alias("again"))
    contents = staged(contents.select("anchor", "digest", "copies", "one.*", "again", F.lit(length).alias("length")), "contents")
    equal = _whole(found, contents, length)
    # different entries of one anchor, cut from one row of each text
    several = sized_broadcast(staged(_several(contents), "several"), 24)
    wanted = contents.join(several, F.col("anchor") == F.col("_a"))
    wanted = wanted.groupBy("h1", "h2").agg(F.min("row").alias("_row"), F.collect_list(F.struct("anchor", (F.col("_bytes") > HOT).alias("hot"), "lo", "n")).alias("jobs"))
    # the jobs of one text: bounded by its length
    wanted = sized_broadcast(staged(wanted, "wanted"), 64 + 24 * F.size("jobs"))
    # of the copies of a text one row is cut; rows that repeat its doc_id as well are dropped after
    cut = texts.join(wanted, ["h1", "h2"]).filter("row = _row").select("h1", "h2", "text", "jobs").mapInArrow(_cut(length), SEGMENT)
    cut = staged(cut.dropDuplicates(["h1", "h2", "lo"]), "cut")
    spans = equal.union(_in_blocks(cut.filter("NOT hot"), length))
    if cut.filter("hot").limit(1).count():
        spans = spans.union(_of_hot(cut.filter("hot"), length))
    # the spans of one text: bounded by its length
    return spans.groupBy("h1", "h2").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of spans that overlap or touch."""
    out: list = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def split_at(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """What is left of ``raw`` without the merged spans."""
    at, left = 0, []
    for s, e in spans:
        left.append(raw[at:s])
        at = e
    return b"".join([*left, raw[at:]])


def long_enough(raw: bytes, spans, least_words: int = 0) -> list[tuple[int, int]]:
    """Merged spans of so many words (split at white space, cut words at the ends counted)."""
    return [(s, e) for s, e in merged([(x["s"], x["e"]) for x in spans]) if not least_words or len(raw[s:e].split()) >= least_words]


def _longest(spans):
    """Bytes of the longest run of spans that overlap or touch."""

    def step(a, x):
        joins = x["s"] <= a["e"]
        s, e = F.when(joins, a["s"]).otherwise(x["s"]), F.when(joins, F.greatest(a["e"], x["e"])).otherwise(x["e"])
        return F.struct(s.alias("s"), e.alias("e"), F.greatest(a["n"], e - s).alias("n"))

    return F.aggregate(F.array_sort(spans), F.struct(F.lit(-1).alias("s"), F.lit(-1).alias("e"), F.lit(0).alias("n")), step, lambda a: a["n"])


def _by_text(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """``docs`` joined with ``found`` by the key of the text; the other columns of ``found`` begin with ``_sa_``."""
    h1, h2 = text_key(F.col("text"))
    keyed = docs.withColumns({"_sa_h1": h1, "_sa_h2": h2})
    found = found.withColumnsRenamed({"h1": "_sa_k1", "h2": "_sa_k2", "spans": "_sa_spans", "short": "_sa_short"})
    return keyed.join(found, (F.col("_sa_h1") == F.col("_sa_k1")) & (F.col("_sa_h2") == F.col("_sa_k2")), how)


def _with_spans(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    at = mark()
    spans = staged(repeated_spans(docs, length, anchor), "spans")
    sweep(docs.sparkSession, at, spans)
    return _by_text(docs, sized_broadcast(spans, 64 + 16 * F.size("spans")), "left")


def _with_both(docs: DataFrame, length: int, anchor: int, short_length: int, short_anchor: int) -> DataFrame:
    """``docs`` with ``_sa_spans`` of strings of ``length`` bytes and ``_sa_short`` of shorter ones."""
    at = mark()
    short = staged(repeated_spans(docs, short_length, short_anchor).withColumnRenamed("spans", "short"), "short-spans")
    sweep(docs.sparkSession, at, short)
    # a string of the full length that repeats lies in a run of shorter ones wherever it stands
    some = sized_broadcast(short.filter(_longest(F.col("short")) >= length).select("h1", "h2"), 16)
    texts = staged(_by_text(docs, some, "left_semi").select(*docs.columns), "long-runs")
    both = staged(short.join(repeated_spans(texts, length, anchor), ["h1", "h2"], "left"), "spans")
    sweep(docs.sparkSession, at, both)
    both = sized_broadcast(both, 64 + 16 * (F.size("short") + F.coalesce(F.size("spans"), F.lit(0))))
    return _by_text(docs, both, "left")


CONTENTS = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
PASSAGES = "n_passages long, n_passage_bytes long"


def _digest(least_words: int | None):
    """Rows ``doc_id, text, spans`` to digests; with ``least_words`` a column of shorter spans follows, and its passages are counted."""

    def run(batches):
        for batch in slices(batches):
            n, gone, runs, sha, passages, covered = [], [], [], [], [], []
            spans, short = batch.column(2).to_pylist(), batch.column(2 if least_words is None else 3).to_pylist()
            for text, cut, few in zip(batch.column(1).to_pylist(), spans, short, strict=True):
                raw = (text or "").encode()
                cut = long_enough(raw, cut or ())
                left = split_at(raw, cut)
                n.append(len(raw))
                gone.append(len(raw) - len(left))
                runs.append(len(cut))
                sha.append(hashlib.sha256(left).hexdigest())
                if least_words is not None:
                    found = long_enough(raw, few or (), least_words)
                    passages.append(len(found))
                    covered.append(sum(e - s for s, e in found))
            out = {"n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
            if least_words is not None:
                out |= {"n_passages": pa.array(passages, pa.int64()), "n_passage_bytes": pa.array(covered, pa.int64())}
            yield pa.RecordBatch.from_arrays([batch.column(0), *out.values()], ["doc_id", *out])

    return run


def removals(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, passages: tuple[int, int, int] | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs``.

    With ``passages`` (bytes of a string, at most ``length``, its anchor, least words) the
    columns ``n_passages, n_passage_bytes`` follow: runs of so many words or more that
    repeated strings of so many bytes cover.  They are counted only; nothing more is removed.
    """
    docs = docs.select("doc_id", "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {CONTENTS}"
    if passages is None:
        return _with_spans(docs, length, anchor).select("doc_id", "text", "_sa_spans").mapInArrow(_digest(None), schema)
    short_length, short_anchor, least_words = passages
    if short_length > length:
        raise ValueError("strings of passages are at most as long as those that are removed")
    rows = _with_both(docs, length, anchor, short_length, short_anchor)
    return rows.select("doc_id", "text", "_sa_spans", "_sa_short").mapInArrow(_digest(least_words), f"{schema}, {PASSAGES}")


def deduplicated(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, least_words: int = 0) -> DataFrame:
    """``docs`` with the repeats removed from ``text``; ``n_chars``, if there, follows.

    With ``least_words`` only removed runs of so many words (split at white space, cut
    words at the ends counted) go; shorter runs stay as they are.
    """
    rows = _with_spans(docs, length, anchor)

    @F.pandas_udf("string")
    def left(text, spans):
        import pandas as pd

        def cut(t, raw, s):
            gone = long_enough(raw, s, least_words)
            return split_at(raw, gone).decode("utf-8", "ignore") if gone else t

        return pd.Series([t if s is None or t is None else cut(t, t.encode(), s) for t, s in zip(text, spans, strict=True)])

    # rows without repeats do not pass through Python
    rows = rows.withColumn("text", F.when(F.col("_sa_spans").isNull(), F.col("text")).otherwise(left("text", "_sa_spans")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("_sa_spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return rows.select(*docs.columns)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(table(spark, sf_dir, "documents"), passages=(PASSAGE_BYTES, PASSAGE_ANCHOR, PASSAGE_WORDS))


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
ORACLE_SQL: dict[str, str] = {}
