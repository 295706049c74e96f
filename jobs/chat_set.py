"""Job: a fine-tuning set from logged conversations, in train, dev and test, every pair accounted for.

    python -m jobs.chat_set --conversations PATH --out PATH [--config PATH]

Reads Parquet rows ``conv_id, turn, role, text``.  A user's turn and the assistant's turn
that follows it are a pair; where a turn stands there several times, its least text counts.
A pair has a status:

* ``empty``: one of both texts is null or has no word;
* ``long``: both have more than ``most_words`` words together;
* ``copy``: an earlier pair (by conversation, then turn) has the same two texts;
* ``kept``: all others.  They get a split by a hash of the prompt, so that a prompt that
  comes again in another conversation never stands in two splits, and their rendered text.

Writes

* ``pairs/status=.../split=...``: JSON lines ``conv_id, turn, prompt, completion, text, n_words``
  (``split=none`` but for kept ones); rows that a pair cannot hold (other roles, null keys,
  turns without their other half) are only counted in the log;
* ``lengths/split=...``: for each split its pairs and the exact percentiles ``shares`` of their
  words, from which a user takes the length to cut at.

Scale: one scan and one shuffle make the pairs, keyed by conversation and turn, so a
conversation of any length is dealt evenly.  Copies are found by the least place of each
text pair, combined before its shuffle, and marked by a join on that place.  Files are
sized by a rebalance of the written folders.  Percentiles are selected by counts of value
ranges, not gathered.  A rerun overwrites the output with the same rows.
"""

from __future__ import annotations

import json
import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from callgrain.operators.profile import words
from callgrain.operators.quantiles import quantiles
from callgrain.operators.render import Template
from callgrain.operators.split import hash_split
from callgrain.schemas import TOOL
from jobs.common import main, observed

log = logging.getLogger("jobs.chat_set")
ROWS = "conv_id long, turn long, role string, text string"
WRITTEN = "conv_id long, turn long, prompt string, completion string, text string, n_words long, status string, split string"

LENGTHS = "share double, n_words double, pairs long, split string"


def pairs(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, prompt, completion`` of each user's turn and the assistant's turn that follows."""
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    turn = F.when(assistant, F.col("turn") - 1).otherwise(F.col("turn"))
    keyed = rows.filter((user | assistant) & F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).withColumn("turn", turn)
    both = keyed.groupBy("conv_id", "turn").agg(
        F.min(F.when(user, F.col("text"))).alias("prompt"), F.min(F.when(assistant, F.col("text"))).alias("completion"), F.count_if(user).alias("_u"), F.count_if(assistant).alias("_a")
    )
    return both.filter("_u > 0 AND _a > 0").select("conv_id", "turn", "prompt", "completion")


def classified(found: DataFrame, config: dict) -> DataFrame:
    """Pairs with ``n_words, status, split, text``."""
    size = lambda c: F.coalesce(words(F.col(c)), F.lit(0)).cast("long")
    rows = found.withColumns({"n_words": size("prompt") + size("completion"), "_empty": (size("prompt") == 0) | (size("completion") == 0)})
    texts = [F.xxhash64("prompt", "completion"), F.xxhash64(F.lit("second"), "completion", "prompt")]
    first = rows.groupBy(*texts).agg(F.min(F.struct("conv_id", "turn")).alias("first")).select(F.col("first.conv_id").alias("_c"), F.col("first.turn").alias("_t"))
    rows = rows.join(first, (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_t")), "left")
    status = F.when(F.col("_empty"), "empty").when(F.col("n_words") > config["most_words"], "long").when(F.col("_c").isNull(), "copy").otherwise("kept")
    rows = hash_split(rows.withColumn("status", status), "prompt", config["seed"], F.col("status") == "kept")
    template = Template()
    tools = F.from_json(F.lit(_tools(config)), f"array<{TOOL.simpleString()}>")
    text = F.concat(template.prompt(F.col("prompt"), tools), "completion", F.lit(f"{template.end}\n"))
    rows = rows.withColumns({"text": F.when(F.col("status") == "kept", text), "split": F.coalesce("split", F.lit("none"))})
    return rows.select(*(c.split()[0] for c in WRITTEN.split(", ")))


def _tools(config: dict) -> str:
    return json.dumps([{"name": t["name"], "description": t.get("description", ""), "parameters": json.dumps(t["parameters"])} for t in config["tools"]])


def run(spark: SparkSession, config: dict, conversations: str, out: str) -> DataFrame:
    """Build the set of ``conversations`` in ``out``; gives the written rows."""
    read, wrote = Observation(), Observation()
    rows = spark.read.schema(ROWS).parquet(conversations).observe(read, F.count(F.lit(1)).alias("rows"))
    done = classified(pairs(rows), config)
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("kept", "empty", "long", "copy")] + [F.count_if(F.col("split") == s).alias(s) for s in ("train", "dev", "test")]
    files = done.hint("rebalance", "status", "split").observe(wrote, F.count(F.lit(1)).alias("pairs"), *counts)
    files.write.mode("overwrite").option("maxRecordsPerFile", config["rows_per_file"]).option("ignoreNullFields", "false").partitionBy("status", "split").json(f"{out}/pairs")
    log.info("read %s: %s", conversations, observed(read))
    log.info("wrote %s/pairs: %s", out, observed(wrote))
    found = lengths(written(spark, out), config["shares"])
    found.coalesce(1).write.mode("overwrite").partitionBy("split").json(f"{out}/lengths")  # a row a split and share
    log.info("wrote %s/lengths", out)
    return written(spark, out)


def lengths(rows: DataFrame, shares: list[float]) -> DataFrame:
    """``split, share, n_words, pairs`` of kept pairs."""
    found = quantiles(rows.filter("status = 'kept'").select("split", "n_words"), "n_words", shares, "split")
    each = F.explode(F.array(*[F.struct(F.lit(float(x)).alias("share"), F.col(f"q{k}").alias("n_words")) for k, x in enumerate(shares)]))
    return found.select("split", F.col("n").alias("pairs"), each.alias("e")).select("split", "e.share", "e.n_words", "pairs")


def written(spark: SparkSession, out: str) -> DataFrame:
    """The pairs of an output folder."""
    return spark.read.schema(WRITTEN).json(f"{out}/pairs")


def read_lengths(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(LENGTHS).json(f"{out}/lengths")


if __name__ == "__main__":
    main("chat_set", run, {"conversations": "Parquet rows conv_id, turn, role, text", "out": "folder to write"}, "chat_set.json")
