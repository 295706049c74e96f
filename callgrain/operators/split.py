"""Deterministic train / dev / test splits that do not depend on the layout of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TEST, DEV = 0.1, 0.111


def split_key(key: Column, seed: int) -> Column:
    """Hash-random hexadecimal key of a row."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def bucket(key: Column, seed: int, n: int = 1000) -> Column:
    """Bucket 0 to n - 1 of a row, from 32 bits of its key."""
    return F.conv(F.substring(split_key(key, seed), 1, 8), 16, 10).cast("long") % n


def hash_split(df: DataFrame, key: str = "id", seed: int = 0, where: Column | None = None) -> DataFrame:
    """``df`` with ``split`` (null where ``where`` does not hold); no shuffle, sizes hold in expectation."""
    b = bucket(F.col(key), seed)
    named = F.when(b < 100, "test").when(b < 200, "dev").otherwise("train")
    return df.withColumn("split", named if where is None else F.when(where, named))


def exact_split(df: DataFrame, key: str = "id", seed: int = 0, where: Column | None = None) -> DataFrame:
    """``df`` with ``split`` (null where ``where`` does not hold); ceil(10 %) test, then ceil(11.1 %) of the rest dev, in order of the hash key.

    The order is counted by slices of the key space: a window inside a slice gives a row's
    place there, a window over the 4096 slice counts gives what lies before the slice.
    ``df`` is read twice, for the counts and for the rows.
    """
    counted = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    keyed = df.withColumn("_w", counted).withColumn("_k", split_key(F.col(key), seed)).withColumn("_s", F.substring("_k", 1, 3))
    slices = keyed.filter("_w").groupBy("_s").agg(F.count("*").alias("_in"))
    slices = slices.withColumn("_off", F.sum("_in").over(Window.orderBy("_s")) - F.col("_in")).withColumn("_n", F.sum("_in").over(Window.partitionBy())).drop("_in").withColumnRenamed("_s", "_slice")
    place = F.row_number().over(Window.partitionBy("_s", "_w").orderBy("_k", key)) + F.col("_off")
    test = F.ceil(F.col("_n") * TEST)
    dev = F.ceil((F.col("_n") - test) * DEV)
    rows = keyed.join(slices, F.col("_s") == F.col("_slice"), "left").withColumn("_p", place)  # at most 4096 slices
    named = F.when(F.col("_p") <= test, "test").when(F.col("_p") <= test + dev, "dev").otherwise("train")
    return rows.withColumn("split", F.when(F.col("_w"), named)).select(*df.columns, "split")


def leakage(split: DataFrame, key: str = "id") -> DataFrame:
    """One row: keys in more than one split, rows without a split, rows."""
    per = split.groupBy(key).agg(F.count_distinct("split").alias("k"), F.count("*").alias("n"), F.count_if(F.col("split").isNull()).alias("lost"))
    return per.agg(F.count_if(F.col("k") > 1).alias("n_leaked"), F.coalesce(F.sum("lost"), F.lit(0)).alias("n_lost"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
