"""Predicted calls against gold calls: seven flags a row and their means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callgrain.operators.parse import parse_calls
from callgrain.operators.verify import all_valid, no_malformed, verdicts
from callgrain.schemas import FLAGS, UNKNOWN_TOOL


def same_calls(pred: Column, gold: Column) -> Column:
    """Equal names and arguments in equal order; argument key order and 1 / 1.0 / true do not matter."""
    key = lambda calls: F.transform(calls, lambda c: F.struct(c["name"], c["canon"]))
    return key(pred) == key(gold)


def same_names(pred: Column, gold: Column) -> Column:
    """Equal multisets of names."""
    key = lambda calls: F.array_sort(F.transform(calls, lambda c: c["name"]))
    return key(pred) == key(gold)


def flags(parsed: Column, gold: Column, v: Column) -> list[Column]:
    """The seven flags of a row, native, from its parsed output, gold calls and verdicts."""
    calls = parsed["calls"]
    content = same_calls(calls, gold)
    return [
        parsed["emits_json"].alias("emits_json"),
        same_names(calls, gold).alias("tool_name"),
        content.alias("name_and_args"),
        ((F.size(calls) > 0) & all_valid(v)).alias("schema_valid"),
        parsed["wrapped"].alias("protocol"),
        (parsed["wrapped"] & content).alias("strict"),
        F.exists(v, lambda x: x["outcome"] == UNKNOWN_TOOL).alias("hallucinated"),
    ]


def score_rows(rows: DataFrame, *keep: str, schemas: list[str] | None = None) -> DataFrame:
    """``i`` and the flags for rows of ``i, completion, tools, gold``, the columns to keep and ``n_calls``, the calls read.

    Parsing and verification run once a row each; everything else stays in the JVM, and
    verification, too, if ``schemas`` names all schemas of the registries and they compile.
    """
    parsed = rows.withColumn("p", parse_calls(F.col("completion")))
    verified = parsed.withColumn("v", verdicts(F.col("p.calls"), F.col("tools"), schemas))
    checked = verified.withColumn("v", no_malformed(F.col("v"), F.col("i")))
    return checked.select("i", *keep, *flags(F.col("p"), F.col("gold"), F.col("v")), F.size("p.calls").cast("long").alias("n_calls"))


def metric_means(scores: DataFrame) -> DataFrame:
    """One row of means of the flags; no row for no scores."""
    means = scores.agg(F.count("*").alias("_n"), *[F.avg(F.col(f).cast("double")).alias(f) for f in FLAGS])
    return means.filter("_n > 0").drop("_n")


def running_means(scores: DataFrame, batch_size: int) -> DataFrame:
    """``batch, content, strict``: means of all rows up to the end of each batch of consecutive ``i``.

    Batches are summed before the running window, which sees a row a batch.
    """
    per = scores.groupBy(F.floor(F.col("i") / batch_size).alias("batch")).agg(F.count("*").alias("n"), F.count_if("name_and_args").alias("c"), F.count_if("strict").alias("s"))
    w = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    share = lambda x: (F.sum(x).over(w) / F.sum("n").over(w)).alias({"c": "content", "s": "strict"}[x])
    return per.select("batch", share("c"), share("s"))


def last_of_dump(dump: DataFrame) -> DataFrame:
    """One row for each ``i`` of ``line_no, i, completion``: the last line wins (a maximum, combined before its shuffle)."""
    last = dump.groupBy("i").agg(F.max(F.struct("line_no", "completion")).alias("d"))
    return last.select("i", F.col("d.completion").alias("completion"))


def join_dump(dump: DataFrame, gold: DataFrame, strict: bool = True) -> DataFrame:
    """Covered rows of ``gold`` (``i, tools, gold``) with their completions.

    An ``i`` that gold does not have - a negative one, too - fails the job, or with
    ``strict=False`` is left out.
    """
    last = last_of_dump(dump)
    g = gold.withColumnRenamed("i", "_i")
    if not strict:
        return last.join(g, F.col("i") == F.col("_i")).drop("_i")
    rows = last.join(g, F.col("i") == F.col("_i"), "left")
    i = F.when(F.col("_i").isNull(), F.raise_error(F.concat(F.lit("no gold row for i = "), F.col("i").cast("string"))).cast("long")).otherwise(F.col("i"))
    return rows.withColumn("i", i).drop("_i")


def score_completions(gold: DataFrame, dump: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Flags a row, and their means."""
    scores = score_rows(join_dump(dump, gold, strict))
    return scores.drop("n_calls"), metric_means(scores)
