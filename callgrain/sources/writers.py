"""Sinks: JSON lines by split, single-object sidecars, versioned artifacts, console reports."""

from __future__ import annotations

import json
import re

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, text: str | Column = "example", order: str = "id", single_file: bool = False) -> None:
    """One JSON text a line, in order inside each file; ``single_file`` gathers a small result in one.

    A ``text`` that is an expression is worked out after the sort, which then moves only what it is made of.
    """
    rows = df.orderBy(order) if not single_file else df.coalesce(1).sortWithinPartitions(order)
    rows.select(text).write.mode("overwrite").text(path)


def write_splits(built: DataFrame, path: str, order: str = "id") -> None:
    """Examples of all splits in one pass, a folder a split."""
    kept = built.filter("split IS NOT NULL").repartition("split", F.pmod(F.xxhash64(order), F.lit(64)))
    kept.sortWithinPartitions("split", order).select("split", "example").write.mode("overwrite").partitionBy("split").text(path)


def write_object(spark: SparkSession, path: str, row: dict) -> None:
    """One JSON object, indented, with a closing line end."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(conf).create(p, True)
    out.write(bytearray((json.dumps(row, indent=2, ensure_ascii=False) + "\n").encode()))
    out.close()


def write_report(df: DataFrame, path: str, **more: object) -> None:
    """A one-row frame and further fields as a JSON object."""
    write_object(df.sparkSession, path, {**more, **df.first().asDict()})


def metrics_path(dump: str) -> str:
    """Default place of a dump's metrics: its name without ``.jsonl`` and then ``.gen``, beside it."""
    return re.sub(r"(\.gen)?(\.jsonl)?$", "", dump, count=1) + ".metrics.json"


def write_dump(df: DataFrame, path: str) -> None:
    """Rows ``i, completion`` as a completion dump."""
    df.orderBy("i").select(F.to_json(F.struct("i", "completion")).alias("line")).write.mode("overwrite").text(path)


def _claimed(fs, jvm, path: str, version: int) -> bool:
    """Take a version number; false if another writer has it.  The file system creates the file for one of them only."""
    try:
        fs.create(jvm.org.apache.hadoop.fs.Path(f"{path}/version={version}/_claim"), False).close()
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName() or "already exists" in str(e.java_exception.getMessage()):
            return False
        raise
    return True


def write_version(frames: dict[str, DataFrame], path: str, meta: dict) -> int:
    """Frames as the next version of an artifact, with its metadata; returns the version.

    Writers at the same time get different numbers, where the file system creates a file
    exclusively (HDFS and local ones do).  ``meta.json`` comes last: a version without it is not
    whole, and :func:`read_version` does not take it.
    """
    spark = next(iter(frames.values())).sparkSession
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    version = max([-1, *_versions(fs, root)]) + 1
    while not _claimed(fs, jvm, path, version):
        version += 1
    for name, df in frames.items():
        df.write.parquet(f"{path}/version={version}/{name}")
    write_object(spark, f"{path}/version={version}/meta.json", {"version": version, **meta})
    return version


def _versions(fs, root) -> list[int]:
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    return [int(n[8:]) for n in names if re.fullmatch(r"version=\d+", n)]


def read_version(spark: SparkSession, path: str, name: str, version: int | None = None) -> DataFrame:
    """A frame of a version, by default of the last one that is whole."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    whole = [v for v in _versions(fs, root) if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/version={v}/meta.json"))]
    if version is None and whole:
        version = max(whole)
    if version not in whole:
        raise ValueError(f"{path} has no whole version{'' if version is None else f' {version}'}")
    return spark.read.parquet(f"{path}/version={version}/{name}")


def report_lines(metrics: DataFrame) -> DataFrame:
    """``line``: fixed-width percent lines of a one-row frame of means."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("double").alias("v")) for c in metrics.columns]))
    return metrics.select(pairs.alias("p")).select(F.format_string("%13s: %6.2f%%", F.col("p.k"), F.col("p.v") * 100).alias("line"))


def summary_line(report: DataFrame) -> DataFrame:
    """``line``: ``key=value`` of a one-row frame, rates with four places."""
    said = [F.concat(F.lit(f"{c}="), F.format_string("%.4f", F.col(c)) if kind == "double" else F.col(c).cast("string")) for c, kind in report.dtypes]
    return report.select(F.concat_ws(" ", *said).alias("line"))
