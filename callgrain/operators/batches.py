"""Heads of tables, batches of consecutive rows, and texts generated for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_n(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows in an order (a sort of n rows a task); 0 is no limit."""
    if n < 0:
        raise ValueError("a limit is 0 (all rows) or more")
    return df.orderBy(*order).limit(n) if n else df


def batch_of(index: Column, size: int) -> Column:
    """The batch of a row by its place, counted from 0; the last batch may be shorter."""
    return F.floor(index / F.lit(size)).cast("long")


def with_texts(batches: DataFrame, texts: DataFrame, keys: tuple[str, ...] = ("batch", "place")) -> DataFrame:
    """Rows of ``batches`` with the ``text`` generated for them, by batch and place in it.

    The job fails where one side has a row that the other lacks, as batches and texts of
    different lengths belong to different runs; so it does for a place that repeats.
    """
    own = texts.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("text").alias("_text"))
    own = own.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    rows = batches.withColumn("_row", F.lit(True)).join(own, same, "full")
    where = F.concat_ws("/", *[F.coalesce(F.col(k), F.col(f"_{k}")).cast("string") for k in keys])
    bad = F.when(F.col("_row").isNull(), "a text without a row").when(F.col("_n").isNull(), "a row without a text").when(F.col("_n") > 1, "several texts for a row")
    text = F.when(bad.isNotNull(), F.raise_error(F.concat(bad, F.lit(" at "), where)).cast("string")).otherwise(F.col("_text"))
    return rows.select(*batches.columns, text.alias("text"))
