"""Profiles of a corpus and of generations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgrain.operators.quantiles import quantiles


def parameters_of(tools: Column) -> Column:
    """Raw parameter specifications of a tools text: array of ``name -> spec text`` maps, one a tool."""
    parsed = F.from_json(tools, "array<struct<parameters: map<string, map<string, string>>>>")
    return F.transform(parsed, lambda t: t["parameters"])


def exploded_parameters(raw: DataFrame) -> DataFrame:
    """``id, param, spec`` of raw rows."""
    maps = raw.select("id", F.explode(parameters_of(F.col("tools"))).alias("m"))
    return maps.select("id", F.explode("m").alias("param", "spec"))


def type_histogram(raw: DataFrame) -> DataFrame:
    """``value, n``: raw type texts."""
    return exploded_parameters(raw).groupBy(F.col("spec").getItem("type").alias("value")).agg(F.count("*").alias("n"))


def key_histogram(raw: DataFrame) -> DataFrame:
    """``value, n``: keys of parameter specifications."""
    return exploded_parameters(raw).select(F.explode(F.map_keys("spec")).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def words(text: Column) -> Column:
    """Number of words; an offline stand-in for a tokenizer's length, not a token count."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))


def length_profile(df: DataFrame, column: str, shares=(0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """One row: ``n, p50, ... , longest``; exact percentiles interpolate, then drop their fraction; nulls without rows."""
    found = quantiles(df, column, list(shares))
    names = [f"p{round(s * 100)}" for s in shares]
    row = found.select("n", *(F.floor(f"q{k}").cast("long").alias(p) for k, p in enumerate(names)), F.col("most").cast("long").alias("longest"))
    # a global aggregate has a row for no rows, too
    return row.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), *(F.max(c).alias(c) for c in (*names, "longest")))


def over_cuts(df: DataFrame, column: str, cuts) -> DataFrame:
    """``cut, n, rate``: rows longer than each cut; one pass for all cuts."""
    one = df.agg(F.count(column).alias("_n"), *[F.count_if(F.col(column) > c).alias(f"_{c}") for c in cuts])
    rows = F.explode(F.array(*[F.struct(F.lit(c).cast("long").alias("cut"), F.col(f"_{c}").alias("n"), F.try_divide(f"_{c}", "_n").alias("rate")) for c in cuts]))
    return one.select(rows.alias("r")).select("r.*")


def probe_rates(generations: DataFrame, eos: int, close: str = "</tool_call>", strict: bool = False) -> DataFrame:
    """One row: share of ``token_ids`` without the end token, share of ``text`` with the closing tag, rows.

    No rows: null rates, or with ``strict`` an error.
    """
    hit, closed = ~F.array_contains("token_ids", eos), F.contains(F.col("text"), F.lit(close))
    one = generations.agg(F.avg(hit.cast("double")).alias("hit_cap_rate"), F.avg(closed.cast("double")).alias("closed_rate"), F.count("*").alias("n"))
    if strict:
        one = one.withColumn("n", F.when(F.col("n") == 0, F.raise_error(F.lit("no generations")).cast("long")).otherwise(F.col("n")))
    return one


def best_checkpoint(losses: DataFrame) -> DataFrame:
    """One row: the checkpoint of the least ``eval_loss``, the earliest of equal ones."""
    return losses.agg(F.min(F.struct("eval_loss", "checkpoint")).alias("b")).select("b.checkpoint", "b.eval_loss")


def field_types(df: DataFrame) -> DataFrame:
    """``field, type`` of a frame's columns."""
    return df.sparkSession.createDataFrame(df.dtypes, "field string, type string")
