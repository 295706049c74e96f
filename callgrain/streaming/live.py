"""Scoring a stream of completions: flags a row, means that are updated with every batch, or scores that later lines correct."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from callgrain.operators.score import join_dump, score_rows
from callgrain.schemas import DUMP, FLAGS


#: How long a repeated line is looked for after the first one.
DELAY = "1 day"


def read_completions(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Completion files as they arrive: ``i, completion``, and ``at``, the time of their file."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    return lines.select(F.from_json("value", DUMP).alias("d"), F.col("_metadata.file_modification_time").alias("at")).select("d.*", "at")


def live_scores(completions: DataFrame, gold: DataFrame, delay: str = DELAY) -> DataFrame:
    """Flags of streamed rows, joined with the static gold rows; the first of a repeated ``i`` counts.

    The state holds the ids of the last ``delay`` only; a repeat that comes later counts again.
    """
    rows = completions.withWatermark("at", delay).dropDuplicatesWithinWatermark(["i"])
    return score_rows(rows.join(gold.withColumnRenamed("i", "_i"), F.col("i") == F.col("_i")).drop("_i"))


def live_means(scores: DataFrame) -> DataFrame:
    """Running means; the state is a count and a sum a flag."""
    return scores.agg(F.count("*").alias("n"), *[F.avg(F.col(f).cast("double")).alias(f) for f in FLAGS])


def start(means: DataFrame, name: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write all means anew with every batch; the checkpoint lets a restarted query go on; ``once`` ends with what is there.

    The table ``name`` lives in the driver: it is for results of one row, as :func:`live_means` gives.
    """
    out = means.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


# Scores that later lines correct: the last line of an ``i`` counts, as in a batch.


def read_lines(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Lines of completion files as they arrive, with what orders them: time, name and block of their file."""
    m = F.col("_metadata")
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).option("lineSep", "\n").text(path)
    return lines.select("value", m["file_modification_time"].alias("at"), m["file_path"].alias("file"), m["file_block_start"].alias("block"))


def take_lines(lines: DataFrame, number: int, gold: DataFrame, out: str) -> None:
    """Score one batch of :func:`read_lines` into its own folder; doing it again changes nothing.

    Of the lines of an ``i`` the last one counts: by file time, file name, place in the file.
    """
    dump = lines.select(F.struct("at", "file", "block", F.monotonically_increasing_id()).alias("line_no"), F.from_json("value", DUMP).alias("d")).select("line_no", "d.*")
    scores = score_rows(join_dump(dump.filter("i IS NOT NULL"), gold, strict=False))
    scores.write.mode("overwrite").parquet(f"{out}/batch={number}")


def score_new_files(spark: SparkSession, path: str, gold: DataFrame, out: str, checkpoint: str, max_files: int = 100) -> None:
    """Score the files that came since the checkpoint, and end.

    A run that was killed goes on with the batch it was in: the checkpoint says which files
    that has, and its folder is written anew.  So ``out`` always holds the rows of one run.
    """
    stream = read_lines(spark, path, max_files).writeStream.foreachBatch(lambda lines, number: take_lines(lines, number, gold, out))
    stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current_scores(spark: SparkSession, out: str) -> DataFrame:
    """``i`` and flags by the last batch that had a line of ``i``: a maximum, combined before its shuffle."""
    columns = [*FLAGS, "n_calls"]
    kind = f"i long, {', '.join(f'{c} boolean' for c in FLAGS)}, n_calls long, batch long"
    rows = spark.read.schema(kind).parquet(out)
    last = rows.groupBy("i").agg(F.max(F.struct("batch", *columns)).alias("s"))
    return last.select("i", *(f"s.{c}" for c in columns))
