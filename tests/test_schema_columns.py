"""Schemas compiled to expressions against the general validator."""

import json
import random

import pytest
from pyspark.sql import functions as F

from callgrain.functions.json_schema import SchemaError, violation
from callgrain.functions.schema_columns import NotCompiled, compiled
from callgrain.operators.verify import outcome_counts, verdicts, verify_calls
from callgrain.schemas import CALLS, TOOL

SCALARS = [None, True, False, 0, 1, -7, 1.0, 2.5, 1e3, 1e400, 9007199254740993, 12345678901234567890123, "", "a", "1", "é\n", "null"]
KEYS = ["a", "b", "é x", "a.b"]


def value(rng, depth=3):
    kind = rng.random()
    if depth and kind < 0.3:
        return [value(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    if depth and kind < 0.65:
        return {k: value(rng, depth - 1) for k in rng.sample(KEYS, rng.randint(0, 3))}
    return rng.choice(SCALARS)


def schema(rng, depth=3):
    if not depth or rng.random() < 0.08:
        return rng.choice([True, False, {}, {"type": "integer"}, {"type": "string"}])
    s = {}
    if rng.random() < 0.6:
        names = ["string", "integer", "number", "boolean", "array", "object", "null"]
        s["type"] = rng.choice(names) if rng.random() < 0.6 else rng.sample(names, rng.randint(1, 4))
    if rng.random() < 0.5:
        s["properties"] = {k: schema(rng, depth - 1) for k in rng.sample(KEYS, rng.randint(0, 3))}
    if rng.random() < 0.3:
        s["required"] = rng.sample(KEYS, rng.randint(0, 2))
    if rng.random() < 0.3:
        s["additionalProperties"] = schema(rng, depth - 1)
    if rng.random() < 0.3:
        s["items"] = schema(rng, depth - 1)
    if rng.random() < 0.2:
        s["prefixItems"] = [schema(rng, depth - 1) for _ in range(rng.randint(1, 2))]
    if rng.random() < 0.2:
        s["minItems"], s["maxItems"] = 1, rng.randint(1, 3)
    if rng.random() < 0.15:
        s["anyOf"] = [schema(rng, depth - 1) for _ in range(rng.randint(1, 2))]
    if rng.random() < 0.15:
        s["enum"] = rng.sample([x for x in SCALARS if x != 1e400 and not (isinstance(x, int) and x > 2**53)], rng.randint(1, 5))
    return s


def test_compiled_schemas_say_what_the_validator_says(spark):
    rng = random.Random(3)
    values = [value(rng) for _ in range(250)] + SCALARS
    texts = [json.dumps(v).replace("Infinity", "1e400") for v in values]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").withColumn("v", F.parse_json("t")).repartition(2).cache()
    schemas = []
    while len(schemas) < 60:
        s = schema(rng)
        try:
            schemas.append((s, compiled(s)))
        except NotCompiled:
            pass
    said = 0
    for at in range(0, len(schemas), 10):
        part = schemas[at : at + 10]
        for r in df.select("i", *[f(F.col("v")).alias(f"s{k}") for k, (_, f) in enumerate(part)]).collect():
            for k, (s, _) in enumerate(part):
                want = violation(values[r.i], s)
                assert r[f"s{k}"] == want, (s, texts[r.i])
                said += want is not None
    assert 0.2 < said / (len(schemas) * len(values)) < 0.9


def test_what_is_not_compiled():
    for s in ({"uniqueItems": True}, {"properties": {"a": {"enum": [[1]]}}}, {"items": {"enum": [2**60]}}):
        with pytest.raises(NotCompiled):
            compiled(s)
    with pytest.raises(SchemaError):
        compiled({"pattern": "x"})


def test_both_routes_agree(spark):
    rng = random.Random(4)
    tools = [(0, f"t{k}", json.dumps(schema(rng))) for k in range(20)] + [(0, "unique", '{"properties": {"x": {"type": "array", "uniqueItems": true}}}'), (0, "bad", '{"pattern": "x"}')]
    calls = [(0, i, rng.choice(tools)[1] if rng.random() < 0.9 else "nosuch", json.dumps({k: value(rng, 2) for k in ["a", "x"]}).replace("Infinity", "2")) for i in range(400)]
    calls = spark.createDataFrame(calls, "conv_id long, i long, name string, arguments string")
    tools = spark.createDataFrame(tools, "conv_id long, name string, parameters string")
    a, b = (sorted(verify_calls(calls, tools, "count", native=n).collect()) for n in (False, True))
    assert a == b and len({r.outcome for r in a}) == 4
    with pytest.raises(Exception, match="malformed specification"):
        outcome_counts(verify_calls(calls, tools, native=True)).collect()
    plan = verify_calls(calls, tools.filter("name <> 'unique'"), "count", native=True)._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan and "PythonUDF" not in plan
    odd = spark.createDataFrame([(0, 1, "t1", '{"a": 1, "a": 2}')], calls.schema)
    with pytest.raises(Exception, match="no plain JSON"):
        verify_calls(odd, tools.filter("name = 't1'"), native=True).collect()


def test_rows_of_calls(spark):
    """Verdicts of whole rows, NaN and infinite numbers among the arguments, by both routes."""
    rng = random.Random(6)
    schemas = [{"properties": {"x": {"type": t}}, "required": ["x"]} for t in ("number", "integer", "string")] + [{"properties": {"x": {"enum": [1, "NaN", None]}}}]
    texts = [json.dumps(s) for s in schemas]
    tools = [(f"t{k}", "", t) for k, t in enumerate(texts)]
    values = ["NaN", "-Infinity", "Infinity", "1", "2.5", '"NaN"', '"a: NaN, b"', "null", "[NaN]", "true"]
    calls = lambda: [(rng.choice(["t0", "t1", "t2", "t3", "no"]), '{"x": %s, "y": %s}' % (rng.choice(values), rng.choice(values)), "") for _ in range(rng.randint(0, 4))]
    rows = [(i, tools + tools[:1], calls()) for i in range(300)] + [(300, None, [("t0", "{}", "")]), (301, tools, None)]
    df = spark.createDataFrame(rows, f"i long, tools array<{TOOL.simpleString()}>, calls {CALLS.simpleString()}")
    a, b = (df.select("i", verdicts(F.col("calls"), F.col("tools"), s).alias("v")) for s in (None, texts))
    assert sorted(a.collect()) == sorted(b.collect())
    assert "PythonUDF" not in b._jdf.queryExecution().toString() and "ArrowEvalPython" not in b._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="not named"):
        df.select(verdicts(F.col("calls"), F.col("tools"), texts[:1])).collect()
    # one that does not compile sends all to the general validator
    general = df.select("i", verdicts(F.col("calls"), F.col("tools"), [*texts, '{"uniqueItems": true}']).alias("v"))
    assert sorted(general.collect()) == sorted(a.collect())
