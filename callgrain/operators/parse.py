"""Model output to tool calls."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from callgrain.functions.jsonkit import call_of, leading_objects
from callgrain.schemas import CALL, CALLS, GOLD_ROW, PARSED, TOOL

#: Objects between the tags of the protocol; the white space is Unicode's.
BLOCK = r"(?sU)<tool_call>\s*(\{.*?\})\s*</tool_call>"


#: Lists of tools in Arrow.
TOOL_LISTS = pa.list_(pa.struct([(k, pa.string()) for k in TOOL.names]))


def blocks(text: Column) -> Column:
    """Texts between the tags, in order (native); an unclosed tag spills into the next closed block."""
    return F.regexp_extract_all(text, F.lit(BLOCK), 1)


def read_calls(found: list[str], text: str) -> dict:
    """Calls of tagged blocks if there are any, else of the objects at the head of the text."""
    if found:
        values = []
        for b in found:
            try:
                values.append(json.loads(b))
            except (ValueError, RecursionError):
                values.append(None)
    else:
        values = leading_objects(text)
    calls = [call_of(v) for v in values]
    good = [c for c in calls if c is not None]
    return {"calls": good, "emits_json": bool(calls) and len(good) == len(calls), "wrapped": bool(found)}


def call_lists(rows: list[list[dict]]) -> pa.Array:
    """Lists of calls as an Arrow array, built column by column."""
    ends = np.cumsum([0, *map(len, rows)])
    flat = [c for r in rows for c in r]
    calls = pa.StructArray.from_arrays([pa.array([c[k] for c in flat], pa.string()) for k in CALL.names], CALL.names)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), calls)


@F.arrow_udf(PARSED)
def _parsed(found: pa.Array, text: pa.Array) -> pa.Array:
    """A batch of outputs; a text that repeats in it is read once."""
    known: dict[str, dict] = {}
    rows = []
    for f, t in zip(found.to_pylist(), text.to_pylist(), strict=True):
        if t not in known:
            known[t] = read_calls(f, t)
        rows.append(known[t])
    flag = lambda k: pa.array([r[k] for r in rows], pa.bool_())
    return pa.StructArray.from_arrays([call_lists([r["calls"] for r in rows]), flag("emits_json"), flag("wrapped")], PARSED.names)


@F.arrow_udf(CALLS)
def _calls(text: pa.Array) -> pa.Array:
    return call_lists([[c for c in map(call_of, json.loads(t)) if c is not None] if t is not None else [] for t in text.to_pylist()])


def parse_calls(text: Column) -> Column:
    """Struct ``calls, emits_json, wrapped`` of an output; texts without a brace never reach Python."""
    nothing = F.struct(F.array().cast(CALLS).alias("calls"), F.lit(False).alias("emits_json"), F.lit(False).alias("wrapped"))
    return F.when(F.contains(text, F.lit("{")), _parsed.asNondeterministic()(blocks(text), text)).otherwise(nothing)


def call_list(text: Column) -> Column:
    """Calls of a JSON array text."""
    return _calls(text)


def read_gold(line: str) -> dict:
    """Registry and gold calls of one exported example; unknown keys of a function, or a call that is none, are errors."""
    row = json.loads(line)
    tools: dict[str, dict] = {}
    for t in row["tools"]:
        f = t["function"]
        if extra := set(f) - {"name", "description", "parameters"}:
            raise ValueError(f"unknown keys {sorted(extra)}")
        tools[f["name"]] = {"name": f["name"], "description": f["description"], "parameters": json.dumps(f["parameters"], ensure_ascii=False)}
    gold = [call_of(c["function"]) for c in row["messages"][1]["tool_calls"]]
    if None in gold:
        raise ValueError("a gold call needs a string name and an argument object")
    return {"tools": list(tools.values()), "gold": gold}


@F.arrow_udf(GOLD_ROW)
def _gold(line: pa.Array) -> pa.Array:
    rows = [read_gold(x) for x in line.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([r["tools"] for r in rows], TOOL_LISTS), call_lists([r["gold"] for r in rows])], GOLD_ROW.names)


def gold_row(line: Column) -> Column:
    """Struct ``tools, gold`` of an exported example."""
    return _gold.asNondeterministic()(line)
