"""The dataset build: raw rows to verified, split and rendered examples, every row accounted for."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from callgrain.operators.normalize import normalize, strict_only
from callgrain.operators.render import example
from callgrain.operators.split import exact_split, hash_split
from callgrain.operators.verify import all_valid, no_malformed, verdicts
from callgrain.sources.scratch import folder
from callgrain.sources.writers import write_splits

COUNTS = ("total", "normalize_failures", "quarantined", "kept", "train", "dev", "test")


def classify(raw: DataFrame) -> DataFrame:
    """Rows with ``status``: ``normalize_failure``, ``quarantined`` or ``kept``; other errors and malformed schemas fail the job."""
    rows = strict_only(normalize(raw)).withColumn("verdicts", verdicts(F.col("gold"), F.col("tools")))
    rows = rows.withColumn("verdicts", no_malformed(F.col("verdicts"), F.col("id")))
    status = F.when(F.col("error").isNotNull(), "normalize_failure").when(all_valid(F.col("verdicts")), "kept").otherwise("quarantined")
    return rows.withColumn("status", status)


def build(raw: DataFrame, seed: int = 0, mode: str = "exact", staging: str | None = None) -> DataFrame:
    """``classify`` with ``split`` of the kept rows (null for others) and their ``example`` text.

    The exact split reads its rows twice, so they are written first, to ``staging`` or a
    scratch folder that all executors share; normalising and verifying run once.
    """
    rows = classify(raw)
    if mode == "exact":
        staging = staging or folder(raw.sparkSession, "build")
        rows.write.mode("overwrite").parquet(staging)
        rows = raw.sparkSession.read.schema(rows.schema).parquet(staging)
    kept = F.col("status") == "kept"
    rows = (exact_split if mode == "exact" else hash_split)(rows, "id", seed, kept)
    return rows.withColumn("example", F.when(kept, example(F.col("query"), F.col("tools"), F.col("gold"))))


def _counts() -> list[Column]:
    of = lambda c, v: F.count_if(F.col(c) == v).alias(v)
    return [F.count("*").alias("total"), F.count_if(F.col("status") == "normalize_failure").alias("normalize_failures"), of("status", "quarantined"), of("status", "kept"), of("split", "train"), of("split", "dev"), of("split", "test")]


def build_report(built: DataFrame) -> DataFrame:
    """One row of counts and the quarantine rate (0 where nothing was verified), in one pass."""
    r = built.agg(*_counts())
    return r.withColumn("quarantine_rate", F.coalesce(F.try_divide("quarantined", F.col("quarantined") + F.col("kept")), F.lit(0.0)))


def export_build(built: DataFrame, path: str) -> dict[str, int]:
    """Write the examples of all splits below ``path``; the counts of :data:`COUNTS` come from the rows as they pass to the files."""
    seen = Observation()
    write_splits(built.observe(seen, *_counts()), path)
    try:
        return {c: seen.get[c] for c in COUNTS}
    except Py4JJavaError:  # Spark found while it ran that no rows come, and dropped the counting
        return dict.fromkeys(COUNTS, 0)
