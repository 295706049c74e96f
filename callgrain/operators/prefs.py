"""Preference data from scored samples.  Design-level operators: their constants are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reject_reason(scores: dict[str, Column]) -> Column:
    """Why a sample that is not strict is rejected, from its flags and ``n_calls``: the worst of what is wrong with it."""
    s = scores
    return (
        F.when(s["hallucinated"], "UNKNOWN_TOOL")
        .when(s["n_calls"] == 0, "NO_CALL")
        .when(~s["schema_valid"], "SCHEMA_VIOLATION")
        .when(~s["tool_name"], "WRONG_TOOL")
        .when(~s["name_and_args"], "WRONG_ARGUMENTS")
        .otherwise("PROTOCOL")
    )


def preference_pairs(samples: DataFrame) -> DataFrame:
    """``prompt_id, chosen, rejected, reason``: each sample that is not strict beside the prompt's first strict one.

    ``samples``: prompt_id, sample_id, strict, reason (looked at where not strict).
    One pair a rejected sample, so pairs grow with the samples, not with their square.
    """
    chosen = samples.filter("strict").groupBy("prompt_id").agg(F.min("sample_id").alias("chosen"))
    failed = samples.filter("NOT strict").select("prompt_id", F.col("sample_id").alias("rejected"), "reason")
    return failed.join(chosen, "prompt_id").select("prompt_id", "chosen", "rejected", "reason")


def reward(strict: Column, schema_valid: Column, emits_json: Column, hallucinated: Column, partial: float = 0.5) -> Column:
    """1 for a correct row, ``partial`` for valid calls with other content, -1 for none or an undeclared tool, else 0."""
    return F.when(strict, 1.0).when(~emits_json | hallucinated, -1.0).when(schema_valid, partial).otherwise(0.0)


def group_advantage(rewards: DataFrame, sample: bool = False) -> DataFrame:
    """``rewards`` (prompt_id, sample_id, reward) with ``advantage``: distance from the group's mean in deviations; null without spread."""
    dev = F.stddev_samp if sample else F.stddev_pop
    of = rewards.groupBy("prompt_id").agg(F.avg("reward").alias("_m"), dev("reward").alias("_d"))
    rows = rewards.join(of.withColumnRenamed("prompt_id", "_p"), F.col("prompt_id") == F.col("_p"))
    return rows.select(*rewards.columns, F.try_divide(F.col("reward") - F.col("_m"), F.nullif(F.col("_d"), F.lit(0.0))).alias("advantage"))


def format_metrics(calls: DataFrame) -> DataFrame:
    """One row over ``emits_json, outcome, exact`` of each call: rates of JSON, of schema compliance among it, of undeclared tools, of exact calls."""
    json = F.col("emits_json")
    return calls.agg(
        F.avg(json.cast("double")).alias("json_validity"),
        F.try_divide(F.count_if(json & (F.col("outcome") == "VALID")), F.count_if(json)).alias("schema_compliance"),
        F.avg((F.col("outcome") == "UNKNOWN_TOOL").cast("double")).alias("hallucinated_rate"),
        F.avg(F.col("exact").cast("double")).alias("exact_call_accuracy"),
    )
