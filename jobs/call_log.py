"""Job: verify a growing log of tool calls against the declared tools, and keep each day's outcomes.

    python -m jobs.call_log --calls PATH --out PATH --checkpoint PATH [--config PATH]

Reads Parquet files ``event_id, ts, event_type, props`` (a call's id, time, tool and JSON
arguments) as they arrive; a run takes what is new since the checkpoint and ends.  Each call
is verified against the schema of its tool.  Writes

* ``calls/batch=.../day=...``: every call read, with ``outcome`` and ``detail``;
* ``daily/day=...``: calls by tool and outcome, of the days that had new calls anew.

A call is known by its day and id.  A later line of it corrects the earlier ones, whatever
run brought them: of the same batch the later ``ts`` counts (then the greater content), of
different batches the later batch.

Reruns: the stream's checkpoint says which files a batch has.  A batch that failed comes
again with the same number and files; it overwrites its own folder of calls, and its days
are worked out from the calls, so nothing counts twice.  Without new files nothing changes.

Scale: a batch is ``files_per_batch`` files; only the days it touches are read again, by
partition.  Corrections are one maximum a call, combined before the shuffle.  The days of a
batch are the only rows the driver sees.
"""

from __future__ import annotations

import json
import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from callgrain.operators.verify import verify_calls
from callgrain.schemas import TOOL
from jobs.common import main, observed

log = logging.getLogger("jobs.call_log")
ROWS = "event_id long, ts timestamp_ntz, event_type string, props string"
CALLS = "event_id long, ts timestamp_ntz, name string, arguments string, outcome string, detail string, batch long, day date"
DAILY = "name string, outcome string, n long, day date"
_CALL = ("ts", "name", "arguments", "outcome", "detail")


def verified(rows: DataFrame, tools: list[dict]) -> DataFrame:
    """``event_id, ts, name, arguments, outcome, detail, day`` of log rows."""
    spark = rows.sparkSession
    declared = [(t["name"], t.get("description", ""), json.dumps(t["parameters"])) for t in tools]
    registry = spark.createDataFrame(declared, TOOL).withColumn("conv_id", F.lit(0).cast("long"))
    calls = rows.select(F.lit(0).cast("long").alias("conv_id"), "event_id", "ts", F.col("event_type").alias("name"), F.coalesce("props", F.lit("{}")).alias("arguments"))
    done = verify_calls(calls, F.broadcast(registry))  # the tools of the config file
    return done.select("event_id", *_CALL, F.to_date("ts").alias("day"))


def current(calls: DataFrame) -> DataFrame:
    """The last line of each call: ``day, event_id, ts, name, arguments, outcome, detail``."""
    last = calls.groupBy("day", "event_id").agg(F.max(F.struct("batch", *_CALL)).alias("c"))
    return last.select("day", "event_id", *(f"c.{c}" for c in _CALL))


def daily(calls: DataFrame) -> DataFrame:
    """``day, name, outcome, n`` of the last lines."""
    return current(calls).groupBy("day", "name", "outcome").agg(F.count("*").alias("n"))


def read_calls(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(CALLS).parquet(f"{out}/calls")


def read_daily(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(DAILY).parquet(f"{out}/daily")


def take(rows: DataFrame, number: int, config: dict, out: str) -> None:
    """Verify one batch of the stream and work out its days; doing it again changes nothing."""
    spark = rows.sparkSession
    seen = Observation()
    outcomes = [F.count_if(F.col("outcome") == o).alias(o) for o in ("VALID", "UNKNOWN_TOOL", "SCHEMA_VIOLATION")]
    done = verified(rows, config["tools"]).hint("rebalance", "day").observe(seen, F.count(F.lit(1)).alias("calls"), *outcomes)
    done.write.mode("overwrite").partitionBy("day").parquet(f"{out}/calls/batch={number}")
    calls = read_calls(spark, out)
    days = [r.day for r in calls.filter(F.col("batch") == number).select("day").distinct().collect()]  # days, not rows
    touched = F.col("day").isin([d for d in days if d is not None]) | (F.col("day").isNull() if None in days else F.lit(False))
    if days:
        daily(calls.filter(touched)).hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{out}/daily")
    log.info("batch %s: read %s, wrote %s days", number, observed(seen), len(days))


def run(spark: SparkSession, config: dict, calls: str, out: str, checkpoint: str) -> None:
    """Take the new files of ``calls`` into ``out``; ends when they are done."""
    log.info("reading new files of %s", calls)
    rows = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(calls)
    stream = rows.writeStream.foreachBatch(lambda batch, number: take(batch, number, config, out)).option("checkpointLocation", checkpoint)
    query = stream.trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("wrote %s: %s new batches", out, len([p for p in query.recentProgress if p["numInputRows"]]))


if __name__ == "__main__":
    main("call_log", run, {"calls": "Parquet files event_id, ts, event_type, props", "out": "folder to write", "checkpoint": "folder of the stream's checkpoint"}, "call_log.json")
