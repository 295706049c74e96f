"""Benchmark score tables and latency statistics."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgrain.operators.quantiles import quantiles


def percent(text: Column) -> Column:
    """A percent or number text as a double; null where it is none (``N/A``)."""
    return F.try_cast(F.replace(text, F.lit("%"), F.lit("")), "double") if hasattr(F, "try_cast") else F.replace(text, F.lit("%"), F.lit("")).try_cast("double")


def _sections(categories: DataFrame) -> DataFrame:
    """``section, score, measured`` of rows ``section, category, score``."""
    return categories.groupBy("section").agg(F.avg("score").alias("score"), F.count("score").alias("measured"))


def _overall(sections: DataFrame, weights: dict[str, float]) -> DataFrame:
    """One row ``score, measured``: the weighted sum, what is not measured counting as 0."""
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return sections.agg(F.sum(F.coalesce(F.try_element_at(w, F.col("section")), F.lit(0.0)) * F.coalesce("score", F.lit(0.0))).alias("score"), F.count("score").alias("measured"))


def roll_up(scores: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``section, score, measured`` of rows ``section, category, part, score`` (null: not measured).

    A category is the plain mean of its parts, a section that of its categories.  With
    ``weights`` (by section) a row ``overall`` follows: the weighted sum, what is not
    measured counting as 0.
    """
    out = _sections(scores.groupBy("section", "category").agg(F.avg("score").alias("score")))
    if weights is None:
        return out
    return out.union(_overall(out, weights).select(F.lit("overall").alias("section"), "score", "measured"))


#: Levels of :func:`roll_up_samples` by the grouping id of their keys.
LEVELS = {7: "overall", 3: "section", 1: "category", 0: "part"}


def roll_up_samples(samples: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``level, section, category, part, n, measured, n_right, share, score`` of sample results, at all four levels.

    ``samples``: rows ``section, category, part, correct``; a null ``correct`` is a sample that was
    not measured.  ``share`` is that of the right ones among the measured, null where none was;
    ``score`` is the plain mean of the level below (a part's is its share), over what was measured
    there, and :func:`roll_up`'s weighted sum for the whole.  The samples are counted once, by part;
    all else sees a row a part.
    """
    keys = ["section", "category", "part"]
    parts = samples.groupBy(*keys).agg(F.count("*").alias("n"), F.count("correct").alias("measured"), F.count_if("correct").alias("n_right"))
    sums = parts.rollup(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "measured", "n_right")], F.grouping_id().alias("_id"))
    sums = sums.withColumn("share", F.try_divide("n_right", "measured"))
    scored = parts.withColumn("score", F.try_divide("n_right", "measured"))
    categories = scored.groupBy("section", "category").agg(F.avg("score").alias("score"))
    sections = _sections(categories)

    def own(df: DataFrame, level: int) -> DataFrame:
        return df.select(F.lit(level).alias("_l"), *[(F.col(k) if k in df.columns else F.lit(None).cast("string")).alias(f"_{k}") for k in keys], "score")

    means = own(scored, 0).union(own(categories, 1)).union(own(sections, 3)).union(own(_overall(sections, weights), 7))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.col("_id") == F.col("_l"))
    name = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])
    return sums.join(means, same).select(F.element_at(name, F.col("_id").cast("int")).alias("level"), *keys, "n", "measured", "n_right", "share", "score")


def latency(df: DataFrame, column: str, *by: str, sample: bool = False) -> DataFrame:
    """``mean, stddev, p50, p95`` of a column, percentiles exact by selection; population deviation unless ``sample``."""
    dev = F.stddev_samp if sample else F.stddev_pop
    moments = df.groupBy(*by).agg(F.avg(column).alias("mean"), dev(column).alias("stddev"))
    found = quantiles(df, column, [0.5, 0.95], *by).select(*(F.col(c).alias(f"_{c}") for c in by), F.col("q0").alias("p50"), F.col("q1").alias("p95"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by] or [F.lit(True)]  # without groups one row each
    return moments.join(found, reduce(and_, same), "left").select(*by, "mean", "stddev", "p50", "p95")


def throughput(df: DataFrame, units: str, seconds: str, *by: str) -> DataFrame:
    """``units, seconds, per_second`` of requests; null where no time was spent."""
    sums = df.groupBy(*by).agg(F.sum(units).alias("units"), F.sum(seconds).alias("seconds"))
    return sums.withColumn("per_second", F.try_divide("units", "seconds"))
