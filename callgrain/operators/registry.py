"""Model names to weights and tokenizers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def basename(path):
    """What follows the last slash; a trailing slash is no name."""
    return F.element_at(F.split(F.regexp_replace(path, r"/+$", ""), "/"), -1)


def resolve_models(args: DataFrame, known: DataFrame, fallback_tokenizer: str) -> DataFrame:
    """``arg, name, weights, tokenizer``: the registered model, or a path with the fallback tokenizer."""
    k = known.withColumnRenamed("name", "_n")
    rows = args.join(k, F.col("arg") == F.col("_n"), "left")
    return rows.select("arg", F.coalesce("_n", basename(F.col("arg"))).alias("name"), F.coalesce("weights", "arg").alias("weights"), F.coalesce("tokenizer", F.lit(fallback_tokenizer)).alias("tokenizer"))


def resolve_aliases(args: DataFrame, aliases: DataFrame) -> DataFrame:
    """``arg, weights``: the target of the alias (``alias, weights``), or the argument itself."""
    rows = args.join(aliases.select(F.col("alias").alias("_a"), "weights"), F.col("arg") == F.col("_a"), "left")
    return rows.select("arg", F.coalesce("weights", "arg").alias("weights"))


def missing(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is left to do."""
    return todo.join(done.select(key), key, "left_anti")
