"""Mixing sources to target weights by hash-random range cuts (native).

Every document gets a hash-random key of its source, id and text.  Inside its source the
keys are sorted by range - first into ``BUCKETS`` slices of the key space, then inside a
slice - and a distributed prefix sum (slice totals, then a running sum inside a slice)
gives the words that lie before each document.  A source with budget ``B`` and
``Z`` words takes ``B // Z`` whole epochs and cuts the next one exactly at
``B % Z`` words, so the cut document gives only its first words.

Rows that repeat id, source and text have one key.  They are counted before the sort, so a
key is one row there however often it repeats, and lie one after the other: only where the
cut falls among them do they take different amounts, and only those are numbered (by the
hash of their other columns).  So the order is total, and reruns agree for any layout.

No task sees a whole source: a slice holds 1/4096 of it, and the window over
slice totals has at most 4096 rows a source, however large the corpus is.  The windows
that share out the words see one row a source.

Edge cases: a null or empty text has size 0 and takes 0; a null source is a
source of its own, last in weight order; null and repeated ids are told apart by their
texts, repeated rows each take their own part; an empty table gives no rows; further
columns are ignored by ``mix`` and kept by ``materialise``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callgrain.llm.common import WORD, sized_broadcast, staged, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
SEED = "mix-1"
#: Hex digits of the key that name its slice.
SLICE_DIGITS = 3
#: Copies of one row beyond which its key is broadcast.
HOT = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(seed: str, *, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> Column:
    """The hash-random key of a row: equal only for rows of one id, source and text."""
    of = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))  # noqa: E731  null and empty differ
    return F.md5(F.concat_ws(":", F.lit(seed), of(F.col(doc_id).cast("string")), F.coalesce(F.md5(F.col(text)), F.lit("")), of(F.col(source))))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST_EPOCHS) -> DataFrame:
    """One row a source: ``source, source_size, target``.

    Water filling in closed form.  With sources in order of ``cap / weight``,
    those below the level stop at their cap ``most * size`` and the others get
    ``level * weight``; the level is the first for which no later source is
    above its cap.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row a source from here on; windows without a key see only those
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per = per.withColumn("level", (F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # the first source that the level leaves below its cap fixes the level for all after it
    open_ = F.col("level") * F.col("weight") <= F.col("cap")
    level = F.first(F.when(open_, F.col("level")), ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, 0))
    return per.select("source", "source_size", F.coalesce(level * F.col("weight"), F.col("cap")).alias("target"))


def sliced(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a key of ``source, _key, size``: with ``copies``, ``source_size, target, epochs`` and ``open``, the words that the cut leaves from its first copy on."""
    one = rows.groupBy("_key").agg(F.first("source").alias("source"), F.first("size").alias("size"), F.count("*").alias("copies"))
    one = one.withColumn("_slice", F.substring("_key", 1, SLICE_DIGITS)).withColumn("_all", F.col("size") * F.col("copies"))
    slices = one.groupBy("source", "_slice").agg(F.sum("_all").alias("_in_slice"))
    slices = slices.withColumn("_offset", F.sum("_in_slice").over(Window.partitionBy("source").orderBy("_slice")) - F.col("_in_slice"))
    # targets: a row a source; slices: at most 4096 rows a source; both sides of the joins stay shuffle joins
    slices = slices.join(targets, slices["source"].eqNullSafe(targets["source"])).select(slices["source"].alias("_source"), F.col("_slice").alias("_s"), "_offset", "source_size", "target")
    one = one.join(slices, one["source"].eqNullSafe(F.col("_source")) & (F.col("_slice") == F.col("_s")))
    order = Window.partitionBy("source", "_slice").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)
    before = F.col("_offset") + F.sum("_all").over(order) - F.col("_all")
    budget = F.floor("target").cast("long")
    epochs = F.floor(F.when(F.col("source_size") > 0, F.expr("floor(target)") / F.col("source_size")).otherwise(0)).cast("long")
    one = one.withColumns({"epochs": epochs, "_before": before}).withColumn("open", budget - F.col("epochs") * F.col("source_size") - F.col("_before"))
    return one.select(F.col("_key").alias("_k"), F.col("size").alias("_size"), "copies", "source_size", "target", "epochs", "open")


def numbered(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with ``_nth``: 0, 1, ... inside each ``_key``, by the hash of ``columns``.

    The rows of a key may be any share of the table, and all alike.  So a number is added up
    from counts: of the slices of the hash before the row's, of the hashes before its own in
    the slice, of the blocks before its own that hold its hash (a block is a task's part of the
    rows as they are written here, so that a rerun of a later task finds the same), and of the
    rows before it in its block.  Which of two rows alike in all columns comes first is no
    matter.
    """
    rows = rows.withColumns({"_hash": F.xxhash64(*columns), "_block": F.spark_partition_id(), "_line": F.monotonically_increasing_id()})
    rows = staged(rows.withColumn("_part", F.shiftright("_hash", 64 - 12)), "mix-cut")
    per = rows.groupBy("_key", "_part", "_hash", "_block").agg(F.count("*").alias("_c"))

    def before(counts: DataFrame, within: list[str], by: str) -> Column:
        return F.sum("_c").over(Window.partitionBy(*within).orderBy(by)) - F.col("_c")

    parts = per.groupBy("_key", "_part").agg(F.sum("_c").alias("_c"))  # at most 4,096 a key
    parts = parts.select("_key", "_part", before(parts, ["_key"], "_part").alias("_a"))
    hashes = per.groupBy("_key", "_part", "_hash").agg(F.sum("_c").alias("_c"))
    hashes = hashes.select("_key", "_part", "_hash", before(hashes, ["_key", "_part"], "_hash").alias("_b"))
    blocks = per.select("_key", "_part", "_hash", "_block", before(per, ["_key", "_hash"], "_block").alias("_d"))
    start = blocks.join(hashes, ["_key", "_part", "_hash"]).join(parts, ["_key", "_part"]).select("_key", "_hash", "_block", (F.col("_a") + F.col("_b") + F.col("_d")).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_key", "_hash", "_block").orderBy("_line")) - 1
    return rows.withColumn("_own", own).join(start, ["_key", "_hash", "_block"]).withColumn("_nth", F.col("_own") + F.col("_start")).drop("_hash", "_block", "_line", "_part", "_own", "_start")


def with_taken(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` (with ``_key``, of any columns) with ``_size, source_size, target, taken`` by the staged table of :func:`sliced`.

    The keys at a cut among copies are one a source at most; their rows are numbered apart
    from the others, which all take alike.  Those keys, and keys of more than ``HOT`` copies,
    come to the rows by a broadcast, so that no task gathers a key's copies.
    """
    among = (F.col("copies") > 1) & (F.col("_size") > 0) & (F.col("open") > 0) & (F.col("open") < F.col("copies") * F.col("_size"))
    apart = among | (F.col("copies") > HOT)
    nth = F.lit(0).cast("long")
    if keys.filter(apart).isEmpty():
        ready = rows.join(keys, F.col("_key") == F.col("_k")).withColumn("_nth", nth)
    else:
        few = keys.filter(apart)
        few_rows = rows.join(sized_broadcast(few, 64), F.col("_key") == F.col("_k"))
        others = rows.join(sized_broadcast(few.select("_k"), 48), F.col("_key") == F.col("_k"), "left_anti").join(keys.filter(~apart), F.col("_key") == F.col("_k"))
        ready = others.unionByName(few_rows.filter(~among)).withColumn("_nth", nth).unionByName(numbered(few_rows.filter(among), rows.columns))
    # copies that do not meet the cut lie before it (all of their words) or after it (none)
    rest = F.when(among, F.col("open") - F.col("_nth") * F.col("_size")).when(F.col("copies") > 1, F.when(F.col("open") > 0, F.col("_size")).otherwise(F.lit(0))).otherwise(F.col("open"))
    taken = F.col("epochs") * F.col("_size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("_size"), rest))
    return ready.withColumn("taken", taken.cast("long")).drop("_k", "copies", "epochs", "open", "_nth")


def _keys(docs: DataFrame, weights, share, most, seed: str) -> tuple[DataFrame, DataFrame]:
    """Staged rows ``doc_id, source, size, _key`` (the texts are read once for them), and staged keys."""
    rows = staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), order_key(seed).alias("_key")), "mix")
    return rows, staged(sliced(rows, source_targets(rows, weights, share, most)), "mix-keys")


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST_EPOCHS, seed: str = SEED) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for every row of ``docs``."""
    rows, keys = _keys(docs, weights, share, most, seed)
    return with_taken(rows, keys).select("doc_id", "source", "size", "source_size", "target", "taken")


def materialise(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mixed documents themselves, with the columns of ``docs``.

    A document comes once for each whole epoch; where a cut falls inside it, one
    more copy holds its first words, white space kept.  A document without words
    has nothing to take and is left out.  Copies keep their doc_id.  The words of the
    result are those that :func:`mix` takes, also where ids or rows repeat.
    """
    _, keys = _keys(docs, weights, share, most, seed)
    own = docs.select(F.struct(*docs.columns).alias("_row"), order_key(seed).alias("_key"))
    rows = with_taken(own, keys).filter("taken > 0")
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("_size")).cast("int"))))
    left = (F.col("taken") - (F.col("_copy") - 1) * F.col("_size")).cast("int")
    whole = F.col("_row.text")
    part = F.array_join(F.slice(F.regexp_extract_all(whole, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), 1), 1, left), "")
    rows = rows.withColumn("_text", F.when(left >= F.col("_size"), whole).otherwise(part))
    out = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[out.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op8_mixing": op8_mixing}

ORACLE_SQL = {
    "op8_mixing": r"""
WITH s AS (
  SELECT doc_id, source, md5('mix-1:' || coalesce('=' || CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '') || ':' || coalesce('=' || source, '')) AS key,
    CAST(coalesce(length(regexp_replace(regexp_replace(text, '[^\x20\x09-\x0D]+', 'w', 'g'), '[\x20\x09-\x0D]+', '', 'g')), 0) AS BIGINT) AS size
  FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
w AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight,
        CAST(source_size * 2 AS DOUBLE) AS cap FROM p),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, coalesce(first_value(CASE WHEN level * weight <= cap THEN level END IGNORE NULLS)
        OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * weight, cap) AS target FROM l),
r AS (SELECT s.doc_id, s.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
        CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - s.size AS before
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST((CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END) * size
    + greatest(0, least(size, (CASE WHEN source_size > 0 THEN budget % source_size ELSE 0 END) - before)) AS BIGINT) AS taken
FROM r
"""
}
