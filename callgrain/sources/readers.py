"""Sources: JSON lines with explicit line numbers, completion dumps, benchmark files, score tables."""

from __future__ import annotations

import json
import subprocess
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from callgrain import schemas
from callgrain.operators.benchmarks import percent
from callgrain.operators.parse import gold_row


def read_raw(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Raw corpus rows by an explicit schema."""
    return spark.read.schema(schemas.RAW).format(kind).load(path)


@F.arrow_udf(BooleanType())
def _is_json(line: pa.Array) -> pa.Array:
    def one(text):
        try:
            json.loads(text)
        except (ValueError, RecursionError):
            return False
        return True

    return pa.array([one(x) for x in line.to_pylist()], pa.bool_())


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, i, line`` of text files, which may be split between tasks.

    ``line_no`` counts from 0 in each file, ``i`` over all files, which follow each other by
    name.  A line lies in a block of its file and comes in order inside it; the lines of the
    blocks before it are added (windows over one row a block; the sums, one a block of some MB,
    are broadcast, so that no line is shuffled).
    """
    block, start = F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    # only line feeds end a line; a task reads the blocks of its files in order
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), block.alias("_block"), start.alias("_at"), F.col("value").alias("line"))
    blocks = lines.groupBy("file", "_block").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = lambda w: F.sum("_n").over(w) - F.col("_n") - F.col("_first")
    in_file, in_all = Window.partitionBy("file").orderBy("_block"), Window.orderBy("file", "_block")
    blocks = blocks.select(F.col("file").alias("_f"), F.col("_block").alias("_b"), before(in_file).alias("_in_file"), before(in_all).alias("_in_all"))
    rows = lines.join(F.broadcast(blocks), (F.col("file") == F.col("_f")) & (F.col("_block") == F.col("_b")))
    return rows.select("file", (F.col("_at") + F.col("_in_file")).alias("line_no"), (F.col("_at") + F.col("_in_all")).alias("i"), "line")


def read_jsonl(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """``file, line_no, i, line`` of JSON-line files, numbered as by :func:`numbered_lines`.

    Strict: a blank or malformed line fails the job; else it is left out (its number stays).
    """
    lines = numbered_lines(spark, path)
    ok = _is_json.asNondeterministic()("line")
    if not strict:
        return lines.withColumn("_ok", ok).filter("_ok").drop("_ok")
    message = F.concat(F.lit("not JSON: "), "file", F.lit(" line "), F.col("line_no").cast("string"))
    return lines.select("file", F.when(~ok, F.raise_error(message).cast("long")).otherwise(F.col("line_no")).alias("line_no"), "i", "line")


def first_record(lines: DataFrame) -> DataFrame:
    """The first line by file and number."""
    return lines.orderBy("file", "line_no").limit(1)


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, i, completion`` of a completion dump; lines are numbered over all of its files."""
    # the check of a line is that of its number; both are kept
    lines = read_jsonl(spark, path).filter("line_no >= 0")
    return lines.select(F.col("i").alias("line_no"), F.from_json("line", schemas.DUMP).alias("d")).select("line_no", "d.*")


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """``i, tools, gold`` of exported examples; i is a row's place over all files."""
    # a line that is no JSON fails in gold_row
    lines = numbered_lines(spark, path).withColumn("g", gold_row(F.col("line")))
    return lines.select("i", "g.tools", "g.gold")


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """``file, id, question, function`` of benchmark files: JSON lines whatever their extension; the last two stay JSON text."""
    kind = "id string, question string, function string"
    return read_jsonl(spark, path).select("file", F.from_json("line", kind).alias("b")).select("file", "b.*")


def list_files(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """``path, length`` of the files under a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length")


def read_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object that spans lines."""
    return spark.read.option("multiLine", True).json(path)


def read_scores(spark: SparkSession, path: str, keys: tuple[str, ...] = ("Model",)) -> DataFrame:
    """A score table: percent texts as doubles, ``N/A`` as null; key columns stay text."""
    raw = spark.read.csv(path, header=True)
    return raw.select(*[F.col(f"`{c}`") if c in keys else percent(F.col(f"`{c}`")).alias(c) for c in raw.columns])


def lineage(cwd: str) -> str:
    """Commit of a checkout; fails where there is none."""
    return subprocess.run(["git", "rev-parse", "HEAD"], cwd=cwd, check=True, capture_output=True, text=True).stdout.strip()


def run_id(spark: SparkSession, path: str, resume: bool) -> str:
    """The id kept in a file beside a run's output; a new run writes a new one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    if resume and fs.exists(p):
        return spark.read.text(path).first()[0]
    fresh = uuid.uuid4().hex[:8]
    out = fs.create(p, True)
    out.write(bytearray(fresh.encode()))
    out.close()
    return fresh
