"""Spelling variants: words one error apart, each with its commonest neighbour and the end of that chain.

Two words are near if one inserted, deleted or replaced character makes them equal.  The
first place at which they differ lies in the first half of the shorter one, and then all
behind it is equal, or in the second half, and then all before it is.  So each word is
dealt twice for each length of the shorter word, its own and one less: once by what is
outside its first half, once by what is outside its second half.  Words that are dealt
alike are compiled into minimal acyclic automata (:mod:`callgrain.llm.automata`), forward
where the first half is to match, over reversed words where the second is.  A word walks
its half exactly and goes on with one error; the perfect-hash number at a final state names
the word found there.  The first differing place tells which half a pair belongs to, so a
pair found in both is counted once, and each pair is found from both of its words.

A key that holds more than ``LETTERS`` letters of words is halved again: its words are
dealt by what is outside the first and the second part of the open half, and so on down to
one open place, where the alphabet bounds the words of a key.  So no task gathers a group
that grows with the vocabulary, and no pair is lost.  Keys are hashes: a collision puts
more words into one automaton and changes no result.

A word's form has ``FACTOR`` times its count, so chains are as long as the logarithm of the
largest count; they are followed by joins that double the steps.

Edge cases: null and empty texts have no words; a null doc_id counts as an empty string in
the hash; repeated rows count again; runs of any length are words, as are letters of À to ÿ
in either case; ties of the form go to the word of the smaller code points; an empty table,
or one without two near words, gives words without forms or no rows; further columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrain.llm.automata import Automaton, backwards, common_prefix, matrix, order
from callgrain.llm.common import sized_broadcast, staged, table

#: Least code points and occurrences of a word, and how much more often a form is seen.
LEAST, TIMES, FACTOR = 7, 2, 10
#: One run in so many loses a character.
SPOILT = 31
#: Most letters of the words of one key before it is halved again; also of one automaton's words.
LETTERS = 400_000
#: Rows that walk an automaton at once.
WALK = 8192

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BYTES = "ISO-8859-1"
_DEALT = ["bucket", "back", "key", "word", "n", "size", "shorter", "low", "high"]


def spelled(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``word``: every run of ``least`` or more letters of the texts in lower case, some with one letter lost."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"([A-Za-z\\u00C0-\\u00FF]{{{least},}})"), 1)).alias("run"))
    runs = runs.select("doc_id", F.translate("run", _UPPER, _UPPER.lower()).alias("run"))
    runs = runs.withColumn("hash", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))))
    less = F.expr("concat(substring(run, 1, cast(hash % length(run) as int)), substring(run, cast(hash % length(run) as int) + 2))")
    word = F.when(F.col("hash") % SPOILT == 0, less).otherwise(F.col("run"))
    return runs.select(word.alias("word")).filter(F.length("word") >= least)


def counted(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``word, n`` of words seen ``times`` times or more."""
    return spelled(docs, least).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= times)


def _region(low: Column, high: Column) -> Column:
    return F.struct(F.col("shorter"), low.cast("int").alias("low"), high.cast("int").alias("high"))


def _with_key(rows: DataFrame) -> DataFrame:
    """The hash of what is outside the open places ``low`` to ``high``."""
    outside = F.xxhash64("shorter", "low", "high", F.expr("substring(word, 1, low)"), F.expr("right(word, shorter - high)"))
    return rows.withColumn("key", outside)


def dealt(words: DataFrame, letters: int = LETTERS) -> DataFrame:
    """Rows of ``words`` once for each key, with the open places of the error.

    ``shorter`` is the length of the shorter word of a pair, ``low`` and ``high`` bound the
    place at which its words first differ; behind the last character counts as the last place.
    """
    size = F.length("word").cast("int")
    rows = words.select("word", "n", size.alias("size"), F.explode(F.array(size, size - 1)).alias("shorter"))
    half = F.floor(F.col("shorter") / 2)
    rows = rows.select("word", "n", "size", F.explode(F.array(_region(F.lit(0), half), _region(half, F.col("shorter")))).alias("r"))
    rows = _with_key(rows.select("word", "n", "size", "r.*"))
    while True:
        hot = staged(rows.filter("high - low > 1").groupBy("key").agg(F.sum("size").alias("letters")).filter(F.col("letters") > letters).select("key", F.lit(True).alias("hot")), "spelling-hot")
        if hot.isEmpty():
            break
        middle = F.floor((F.col("low") + F.col("high")) / 2)
        whole = _region(F.col("low"), F.col("high"))
        parts = F.array(_region(F.col("low"), middle), _region(middle, F.col("high")))
        rows = rows.join(sized_broadcast(hot, 16), "key", "left")
        rows = _with_key(rows.select("word", "n", "size", F.explode(F.when(F.col("hot") & (F.col("high") - F.col("low") > 1), parts).otherwise(F.array(whole))).alias("r")).select("word", "n", "size", "r.*"))
    back = (F.col("low") == 0) & (F.col("high") < F.col("shorter"))
    return rows.withColumns({"back": back, "bucket": F.floor(F.log2("shorter")).cast("int"), "word": F.encode("word", _BYTES)}).select(*_DEALT)


def _whole_keys(batches, letters: int):
    """Tables of one bucket and direction each, with all rows of their keys, of few more letters than ``letters``."""

    def runs(rows: pa.Table) -> np.ndarray:
        """Where a key begins."""
        columns = [rows.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("bucket", "back", "key")]
        return np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0)))

    def pieces(rows: pa.Table):
        if rows.num_rows:
            kind = rows.column("bucket").to_numpy() * 2 + rows.column("back").to_numpy()
            cuts = [0, *(np.flatnonzero(kind[1:] != kind[:-1]) + 1), len(kind)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield rows.slice(a, b - a)

    held, many, limit = [], 0, letters
    for batch in batches:
        held.append(batch)
        many += int(batch.column(_DEALT.index("size")).to_numpy().sum())
        if many >= limit:
            rows = pa.Table.from_batches(held).combine_chunks()
            last = int(runs(rows)[-1])
            yield from pieces(rows.slice(0, last))
            held = rows.slice(last).to_batches()
            many = int(rows.slice(last).column("size").to_numpy().sum())
            limit = letters + many
    if held:
        yield from pieces(pa.Table.from_batches(held).combine_chunks())


def near_in(words: list[bytes], n: np.ndarray, key: np.ndarray, size: np.ndarray, shorter: np.ndarray, low: np.ndarray, high: np.ndarray, back: bool):
    """Rows that have near words under their key, the number of those, and the commonest one's count and bytes."""
    _, which, rows_of_key = np.unique(key, return_inverse=True, return_counts=True)
    some = np.flatnonzero(rows_of_key[which] > 1)  # a word alone under its key has nothing near
    if not len(some):
        return some, some, some, []
    words = [words[i] for i in some]
    n, size, shorter, low, high = n[some], size[some], shorter[some], low[some], high[some]
    plain, lengths = matrix(words)
    shown = backwards(plain, lengths) if back else plain
    o = order(shown)
    fresh = np.append(True, (shown[o][1:] != shown[o][:-1]).any(1))
    held = o[fresh]  # each different word once, in the automaton's order
    rank = np.empty(len(held), np.int64)
    rank[order(plain[held])] = np.arange(len(held))
    automaton = Automaton(shown[held], lengths[held])
    exact, last = (shorter - high, shorter) if back else (low, np.where(high == shorter, shorter, high - 1))
    out = []
    for at in range(0, len(words), WALK):
        part = slice(at, at + WALK)
        row, number = automaton.near(shown[part], lengths[part], exact[part], last[part], size[part] > shorter[part])
        row, other = row + at, held[number]
        if back:  # found by its end; it counts here only if the words differ in the first half
            here = common_prefix(plain[row], plain[other]) < high[row]
            row, other, number = row[here], other[here], number[here]
        first = np.lexsort((rank[number], -n[other], row))
        row, other = row[first], other[first]
        head, many = np.unique(row, return_index=True, return_counts=True)[1:]
        out.append((row[head], many, other[head]))
    row, many, best = (np.concatenate(x) for x in zip(*out, strict=True))
    return some[row], many, n[best], [words[i] for i in best]


def _near(letters: int):
    def run(batches):
        for rows in _whole_keys(batches, letters):
            words = rows.column("word").to_pylist()
            numbers = {c: rows.column(c).to_numpy().astype(np.int64) for c in ("n", "key", "size", "shorter", "low", "high")}
            row, many, best_n, best = near_in(words, **numbers, back=rows.column("back")[0].as_py())
            if len(row):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([words[i] for i in row], pa.binary()), pa.array(many), pa.array(best_n), pa.array(best, pa.binary())],
                    ["word", "n_near", "best_n", "best"],
                )

    return run


def forms(words: DataFrame, factor: int = FACTOR, letters: int = LETTERS) -> DataFrame:
    """``word, n, n_near, form, form_n`` of a table of different words and their counts."""
    rows = dealt(words, letters)
    # the key alone says where a row goes: a word has a key for each half, and keys are bounded
    found = rows.repartition("key").sortWithinPartitions("bucket", "back", "key").mapInArrow(_near(letters), "word binary, n_near long, best_n long, best binary")
    found = found.select(F.decode("word", _BYTES).alias("word"), F.lit(None).cast("long").alias("n"), "n_near", F.struct((-F.col("best_n")).alias("less"), F.decode("best", _BYTES).alias("form")).alias("best"))
    plain = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast(found.schema["best"].dataType).alias("best"))
    out = plain.unionByName(found).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    has = -F.col("best.less") >= F.lit(factor) * F.col("n")
    return out.select("word", "n", "n_near", F.when(has, F.col("best.form")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n"))


def roots(found: DataFrame, factor: int = FACTOR, times: int = TIMES) -> DataFrame:
    """``word, root`` of words that have a form: the end of the chain of forms."""
    most = found.agg(F.max("form_n")).first()[0] or 0
    steps = max(1, math.floor(math.log(max(most, 1) / times, factor) + 1e-9)) if most else 1
    jump = found.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps))):  # each round doubles the steps that are behind
        after = jump.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jump = staged(jump.join(after, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
    return jump


def variants(docs: DataFrame, least: int = LEAST, times: int = TIMES, factor: int = FACTOR, letters: int = LETTERS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the texts."""
    words = staged(counted(docs, least, times), "spelling-words")
    found = staged(forms(words, factor, letters), "spelling-forms")
    out = found.join(roots(found, factor, times), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


#: crc32 by half bytes over a table of 16 values, which its polynomial gives; near words by the words that both give when a character is left out.
SQL = r"""
WITH RECURSIVE half AS MATERIALIZED (
  SELECT list(list_reduce([i] || range(4), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY i) AS t FROM range(16) r(i)),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
         translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
bytes AS (SELECT run, hex(encode(id || ':' || run)) AS h FROM runs),
hashed AS (
  SELECT run, xor(list_reduce([4294967295] || flatten(list_transform(range(0, length(h) // 2), lambda i:
           [instr('0123456789ABCDEF', h[2 * i + 2]) - 1, instr('0123456789ABCDEF', h[2 * i + 1]) - 1])),
         lambda c, d: xor(c >> 4, t[1 + (xor(c, d) & 15)])), 4294967295) AS h
  FROM bytes, half),
words AS (
  SELECT word, count(*) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
less AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, max(n) AS m, min(other) FILTER (n = top) AS other
  FROM (SELECT *, max(n) OVER (PARTITION BY word) AS top FROM near) GROUP BY word),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 10 * w.n THEN b.other END AS form, CASE WHEN b.m >= 10 * w.n THEN b.m END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
chain(word, reached, step) AS (
  SELECT word, word, 0 FROM forms
  UNION ALL SELECT c.word, f.form, c.step + 1 FROM chain c JOIN forms f ON f.word = c.reached WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, CAST(f.n AS BIGINT) AS n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM forms f JOIN (SELECT word, max_by(reached, step) AS root FROM chain GROUP BY word) c USING (word)
"""

QUERIES = {"op11_spelling_variants": op11_spelling_variants}
ORACLE_SQL = {"op11_spelling_variants": SQL}
