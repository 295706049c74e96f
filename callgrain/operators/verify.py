"""Calls against tool registries."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from callgrain.functions.json_schema import SchemaError, check_schema, violation
from callgrain.functions.schema_columns import NotCompiled, compiled
from callgrain.schemas import CALLS, MALFORMED_SPEC, SCHEMA_VIOLATION, TOOL, UNKNOWN_TOOL, VALID, VERDICT, VERDICTS


#: Most different schemas that are compiled to one expression.
COMPILED = 64


@lru_cache(maxsize=10_000)
def _schema(text: str):
    """A decoded schema, checked once a worker; or its error."""
    try:
        schema = json.loads(text)
        check_schema(schema)
        return schema, None
    except (SchemaError, ValueError) as e:
        return None, str(e)


def verdict(parameters: str | None, arguments: str) -> tuple[str, str | None]:
    """Outcome and detail of arguments against a tool's schema; no schema: an unknown tool."""
    if parameters is None:
        return UNKNOWN_TOOL, "no such tool"
    schema, bad = _schema(parameters)
    if bad is not None:
        return MALFORMED_SPEC, bad
    found = violation(json.loads(arguments), schema)
    return (SCHEMA_VIOLATION, found) if found else (VALID, None)


def _outcomes(parameters: pa.Array, arguments: pa.Array) -> pa.StructArray:
    """Verdicts of two columns; each distinct pair of a batch is worked out once."""
    codes = []
    for column in (parameters, arguments):
        d = column.dictionary_encode(null_encoding="encode")
        codes.append((d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()))
    (p, schemas), (a, texts) = codes
    pairs, place = np.unique(p * max(1, len(texts)) + a, return_inverse=True)
    found = [verdict(schemas[k // len(texts)], texts[k % len(texts)]) for k in pairs.tolist()]
    columns = [pa.array([v[i] for v in found], pa.string()).take(pa.array(place)) for i in (0, 1)]
    return pa.StructArray.from_arrays(columns, VERDICT.names)


@F.arrow_udf(VERDICT)
def _verdict(parameters: pa.Array, arguments: pa.Array) -> pa.Array:
    return _outcomes(parameters, arguments)


@F.arrow_udf(VERDICTS)
def _verdicts(parameters: pa.Array, arguments: pa.Array) -> pa.Array:
    ends = np.cumsum([0, *(n or 0 for n in pc.list_value_length(arguments).to_pylist())])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _outcomes(parameters.flatten(), arguments.flatten()))


#: NaN and infinite numbers as Python writes them, where a value may stand.
_ODD_NUMBERS = r"(?<=[:,\[]\s?)-?(?:NaN|Infinity)(?=\s?[,\]}])"


def _native(texts: list[str], parameters: Column, arguments: Column) -> tuple[Column, bool]:
    """Verdict by the schemas ``texts``, compiled to expressions, null for other schemas; and whether all of them compiled.

    NaN counts as an infinite number, which fits the same types.  An argument text with a key
    twice in an object ends the job, as one that is no JSON does.
    """
    verdict_of = lambda outcome, detail: F.struct(outcome.alias("outcome"), detail.cast("string").alias("detail"))
    out = F.when(parameters.isNull(), verdict_of(F.lit(UNKNOWN_TOOL), F.lit("no such tool")))
    plain = F.coalesce(F.try_parse_json(arguments), F.try_parse_json(F.regexp_replace(arguments, _ODD_NUMBERS, "1e400")))
    value = F.coalesce(plain, F.raise_error(F.concat(F.lit("arguments that are no plain JSON: "), arguments)).cast("variant"))
    whole = True
    for text in sorted(set(texts)):
        try:
            check = compiled(json.loads(text))
        except NotCompiled:
            whole = False
            continue
        except ValueError as e:
            out = out.when(parameters == text, verdict_of(F.lit(MALFORMED_SPEC), F.lit(str(e))))
            continue
        found = F.get(F.transform(F.array(check(value)), lambda v: verdict_of(F.when(v.isNull(), VALID).otherwise(SCHEMA_VIOLATION), v)), F.lit(0))
        out = out.when(parameters == text, found)
    return out, whole


def few_schemas(tools: DataFrame) -> list[str]:
    """The different schemas of a table of tools; none where there are more than ``COMPILED``: an expression of all would be evaluated for every row."""
    texts = [r.parameters for r in tools.select("parameters").filter("parameters IS NOT NULL").distinct().limit(COMPILED + 1).collect()]
    return texts if len(texts) <= COMPILED else []


def verify_calls(calls: DataFrame, tools: DataFrame, on_malformed: str = "fail", native: bool = False) -> DataFrame:
    """``calls`` (conv_id, name, arguments, ...) with ``outcome, detail``, by a left join with ``tools`` (conv_id, name, parameters).

    Only the schemas of called tools are looked at.  A malformed one ends the job, or
    with ``on_malformed="count"`` is an outcome of its own.  ``native`` verifies in the JVM where
    the tools have few different schemas (no Python evaluation is in the plan if all compile); there
    an argument text with a key twice in an object ends the job as one that is no JSON does.
    """
    t = tools.select(F.col("conv_id").alias("_c"), F.col("name").alias("_n"), "parameters")
    rows = calls.join(t, (F.col("conv_id") == F.col("_c")) & (F.col("name") == F.col("_n")), "left")
    one = _verdict.asNondeterministic()("parameters", "arguments")
    if native and (texts := few_schemas(tools)):
        by_schema, whole = _native(texts, F.col("parameters"), F.col("arguments"))
        one = by_schema if whole else F.coalesce(by_schema, one)
    rows = rows.withColumn("_v", one)
    return checked(rows.select(*calls.columns, "_v.outcome", "_v.detail"), on_malformed)


def checked(rows: DataFrame, on_malformed: str) -> DataFrame:
    if on_malformed == "count":
        return rows
    fail = F.raise_error(F.concat(F.lit("malformed specification of tool "), "name", F.lit(": "), "detail"))
    return rows.withColumn("outcome", F.when(F.col("outcome") == MALFORMED_SPEC, fail).otherwise(F.col("outcome")))


def verdicts(calls: Column, tools: Column, schemas: list[str] | None = None) -> Column:
    """Verdicts of a row's own calls against its own registry, in order; no calls, no verdicts.

    Names are looked up in the JVM (of a name that repeats the last tool counts): a call takes
    the schema of its own tool to Python, not the registry.  With ``schemas``, all texts that the
    registries have, calls are verified in the JVM if each of them compiles.
    """
    calls, tools = (F.coalesce(x, F.array().cast(kind)) for x, kind in ((calls, CALLS), (tools, ArrayType(TOOL))))
    names, texts = F.reverse(tools["name"]), F.reverse(tools["parameters"])  # a lambda inside a lambda can't be an argument of a Python function
    of = lambda c: F.get(texts, F.array_position(names, c["name"]) - 1)
    if schemas is not None and _native(schemas, F.lit(None).cast("string"), F.lit("{}"))[1]:
        other = F.raise_error(F.lit("a schema that was not named")).cast(VERDICT)
        return F.transform(calls, lambda c: F.coalesce(_native(schemas, of(c), c["arguments"])[0], other))
    return _verdicts.asNondeterministic()(F.transform(calls, of), F.transform(calls, lambda c: c["arguments"]))


def all_valid(v: Column) -> Column:
    """Whether every verdict is VALID; so it is for no calls."""
    return F.forall(v, lambda x: x["outcome"] == VALID)


def no_malformed(v: Column, label: Column) -> Column:
    """``v`` unchanged; the job fails where a called tool's schema is malformed."""
    bad = F.exists(v, lambda x: x["outcome"] == MALFORMED_SPEC)
    return F.when(bad, F.raise_error(F.concat(F.lit("malformed tool specification in row "), label.cast("string")))).otherwise(v)


def keep_valid(convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Survivors and quarantined of conversations with ``verdicts``; one bad call quarantines the row."""
    return convs.filter(all_valid(F.col("verdicts"))), convs.filter(~all_valid(F.col("verdicts")))


def outcome_counts(verdict_rows: DataFrame) -> DataFrame:
    """``outcome, n, rate``: calls by outcome, and their share."""
    n = verdict_rows.groupBy("outcome").agg(F.count("*").alias("n"))
    return n.withColumn("rate", F.try_divide("n", F.sum("n").over(Window.partitionBy())))  # a row an outcome
