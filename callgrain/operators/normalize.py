"""Raw corpus rows to conversations: tool registries with JSON Schemas and ordered gold calls.

Fallible steps return their error as a column; a policy is applied afterwards, as a filter.
"""

from __future__ import annotations

import json
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgrain.functions.jsonkit import call_of, encode
from callgrain.functions.type_exprs import described, object_schema
from callgrain.operators.parse import TOOL_LISTS
from callgrain.schemas import CALL, NORMALISED, OBJECT, TYPE

CALL_LISTS = pa.list_(pa.struct([(k, pa.string()) for k in CALL.names]))

#: Errors of a row that a build counts and skips; any other ends it.
TOLERATED = ("KeyError", "NotImplementedError")


@F.pandas_udf(TYPE)
def _described(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([described(t) if t is not None else (None, False, None) for t in text], columns=["schema", "optional", "error"])


def type_dictionary(types: DataFrame, column: str = "type") -> DataFrame:
    """``type, schema, optional, error``: every distinct type text, worked out once."""
    told = types.select(F.col(column).alias("type")).distinct().withColumn("d", _described.asNondeterministic()("type"))
    return told.select("type", "d.schema", "d.optional", "d.error")


def with_types(rows: DataFrame, column: str = "type") -> DataFrame:
    """``rows`` with ``schema, optional, error`` of their type text, by a join with the dictionary."""
    told = type_dictionary(rows, column).withColumnRenamed("type", "_type")
    return rows.join(told, rows[column].eqNullSafe(told["_type"]), "left").drop("_type")


@F.pandas_udf(OBJECT)
def _object(text: pd.Series) -> pd.DataFrame:
    def one(t):
        try:
            return encode(object_schema(json.loads(t))), None
        except Exception as e:  # noqa: BLE001  the class is the result
            return None, type(e).__name__

    return pd.DataFrame([one(t) if t is not None else (None, None) for t in text], columns=["schema", "error"])


def object_schemas(params: Column) -> Column:
    """Struct ``schema, error`` of a column of raw parameters (JSON text)."""
    return _object.asNondeterministic()(params)


@lru_cache(maxsize=10_000)
def registry_of(tools: str) -> tuple[dict, ...]:
    """The tools of a text; a repeated name keeps its first place and its last specification."""
    registry: dict[str, dict] = {}
    for t in json.loads(tools):
        registry[t["name"]] = {"name": t["name"], "description": t["description"], "parameters": encode(object_schema(t["parameters"]))}
    return tuple(registry.values())


def normalised(tools: str, answers: str) -> dict:
    """One row's registry and gold calls, or its error; a tools text is worked out once a worker."""
    try:
        registry = registry_of(tools)
        gold = []
        for c in json.loads(answers):
            call = call_of({"name": c["name"], "arguments": c["arguments"]})
            if call is None:
                raise ValueError("a gold call needs a string name and an argument object")
            gold.append(call)
        return {"error": None, "message": None, "tools": list(registry), "gold": gold}
    except Exception as e:  # noqa: BLE001  the class decides what a build does
        return {"error": type(e).__name__, "message": str(e)[:200], "tools": None, "gold": None}


@F.arrow_udf(NORMALISED)
def _normalised(tools: pa.Array, answers: pa.Array) -> pa.Array:
    rows = [normalised(t, a) for t, a in zip(tools.to_pylist(), answers.to_pylist(), strict=True)]
    kinds = (pa.string(), pa.string(), TOOL_LISTS, CALL_LISTS)
    return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in zip(NORMALISED.names, kinds, strict=True)], NORMALISED.names)


def normalize(raw: DataFrame) -> DataFrame:
    """``id, query, error, message, tools, gold`` for every raw row."""
    return raw.withColumn("n", _normalised.asNondeterministic()("tools", "answers")).select("id", "query", "n.*")


def strict_only(rows: DataFrame) -> DataFrame:
    """Rows as they are; the job fails if one has an error that is not tolerated."""
    fatal = F.col("error").isNotNull() & ~F.col("error").isin(*TOLERATED)
    error = F.when(fatal, F.raise_error(F.concat(F.lit("row "), F.col("id").cast("string"), F.lit(": "), "error", F.lit(" "), F.coalesce("message", F.lit(""))))).otherwise(F.col("error"))
    return rows.withColumn("error", error)


def error_counts(rows: DataFrame) -> DataFrame:
    """``error, n``: normalised rows by the class of their error, of any class; rows without one are left out."""
    return rows.filter("error IS NOT NULL").groupBy("error").agg(F.count("*").alias("n"))
