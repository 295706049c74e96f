"""What the jobs' command lines share."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Observation, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def read_config(spark: SparkSession, path: str) -> dict:
    """A JSON object, read with Spark: the path may be remote."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def shipped_config(name: str) -> dict:
    """The settings that lie beside the jobs, a part of the code: executors need not see that folder."""
    with open(os.path.join(ROOT, "jobs", name), encoding="utf-8") as f:
        return json.load(f)


def observed(counts: Observation) -> dict:
    """What was counted; nothing where Spark found while it ran that no rows come and dropped the counting."""
    try:
        return counts.get
    except Py4JJavaError:
        return {}


def main(name: str, run: Callable, arguments: dict[str, str], config: str) -> None:
    """Start a session, call ``run(spark, config, **arguments)``, stop the session."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=run.__doc__)
    for argument, text in arguments.items():
        parser.add_argument("--" + argument, required=True, help=text)
    parser.add_argument("--config", help=f"JSON file of settings (default: the shipped {config})")
    given = vars(parser.parse_args())
    path = given.pop("config")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s", stream=sys.stderr)
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, read_config(spark, path) if path else shipped_config(config), **given)
    finally:
        spark.stop()
