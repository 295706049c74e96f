"""DataFrame operators on small frames: edge cases, errors, partition invariance."""

import re

import pytest
from pyspark.sql import functions as F

from callgrain import schemas
from callgrain.functions.jsonkit import call_of, encode
from callgrain.operators import batches, benchmarks, prefs, profile
from callgrain.operators.build import build, build_report
from callgrain.operators.normalize import normalize
from callgrain.operators.parse import gold_row, parse_calls
from callgrain.operators.render import example, prompt_completion
from callgrain.operators.score import join_dump, metric_means, score_completions, score_rows
from callgrain.operators.split import exact_split, hash_split, leakage
from callgrain.operators.verify import verify_calls
from callgrain.schemas import CALLS, TOOL
from pyspark.sql.types import ArrayType

WEATHER = ("weather", "the weather", encode({"type": "object", "properties": {"place": {"type": "string"}, "unit": {"enum": ["c", "f"]}}, "required": ["place"], "additionalProperties": False}))


def call(name, **arguments):
    c = call_of({"name": name, "arguments": arguments})
    return (c["name"], c["arguments"], c["canon"])


def scored(spark, completion, gold, tools=(WEATHER,)):
    kind = schemas.struct(i=schemas.LONG, completion=schemas.TEXT, tools=ArrayType(TOOL), gold=CALLS)
    df = spark.createDataFrame([(0, completion, list(tools), gold)], kind)
    return {k: v for k, v in score_rows(df).first().asDict().items() if k not in ("i", "n_calls")}


def tagged(*texts):
    return "\n".join(f"<tool_call>\n{t}\n</tool_call>" for t in texts)


PARIS = '{"name": "weather", "arguments": {"place": "Paris"}}'
ROME = '{"name": "weather", "arguments": {"place": "Rome"}}'


@pytest.mark.parametrize(
    ("text", "gold", "true"),
    [
        (tagged(PARIS), [call("weather", place="Paris")], {"emits_json", "tool_name", "name_and_args", "schema_valid", "protocol", "strict"}),
        (PARIS, [call("weather", place="Paris")], {"emits_json", "tool_name", "name_and_args", "schema_valid"}),
        (tagged(ROME), [call("weather", place="Paris")], {"emits_json", "tool_name", "schema_valid", "protocol"}),
        (tagged('{"name": "news", "arguments": {}}'), [call("weather", place="Paris")], {"emits_json", "protocol", "hallucinated"}),
        (tagged('{"name": "weather", "arguments": {"place": 1}}'), [call("weather", place="Paris")], {"emits_json", "tool_name", "protocol"}),
        (tagged(ROME, PARIS), [call("weather", place="Paris"), call("weather", place="Rome")], {"emits_json", "tool_name", "schema_valid", "protocol"}),
        (tagged(PARIS, "{junk}"), [call("weather", place="Paris")], {"tool_name", "name_and_args", "schema_valid", "protocol", "strict"}),
        ("none", [], {"tool_name", "name_and_args"}),
        ("<tool_call>\n" + PARIS, [call("weather", place="Paris")], {"emits_json", "tool_name", "name_and_args", "schema_valid"}),
        ("<tool_call>\n" + PARIS + "\n" + tagged(PARIS), [call("weather", place="Paris")], {"protocol"}),
        ("<tool_call> " + PARIS + " </tool_call>", [call("weather", place="Paris")], {"emits_json", "tool_name", "name_and_args", "schema_valid", "protocol", "strict"}),
    ],
)
def test_ladder(spark, text, gold, true):
    got = scored(spark, text, gold)
    assert {k for k, v in got.items() if v} == true


def test_no_scores_no_means(spark):
    kind = schemas.struct(i=schemas.LONG, **{f: schemas.FLAG for f in schemas.FLAGS})
    assert metric_means(spark.createDataFrame([], kind)).count() == 0


def test_dump_join(spark):
    gold = spark.createDataFrame([(0, [WEATHER], [call("weather", place="Paris")])], schemas.struct(i=schemas.LONG, tools=ArrayType(TOOL), gold=CALLS))
    dump = spark.createDataFrame([(0, 0, "x"), (1, 0, PARIS)], "line_no long, i long, completion string")
    scores, means = score_completions(gold, dump)
    assert scores.count() == 1 and means.first()["name_and_args"] == 1.0
    for bad in (5, -1):
        more = dump.union(spark.createDataFrame([(2, bad, "x")], dump.schema))
        with pytest.raises(Exception, match="no gold row"):
            join_dump(more, gold).collect()
        assert join_dump(more, gold, strict=False).count() == 1


def test_verify_fails_on_malformed_called_schema_only(spark):
    tools = spark.createDataFrame([(1, "bad", '{"type": "nope"}'), (1, "ok", "{}")], "conv_id long, name string, parameters string")
    calls = spark.createDataFrame([(1, "ok", "{}"), (1, "none", "{}")], "conv_id long, name string, arguments string")
    assert {r.name: r.outcome for r in verify_calls(calls, tools).collect()} == {"ok": "VALID", "none": "UNKNOWN_TOOL"}
    more = calls.union(spark.createDataFrame([(1, "bad", "{}")], calls.schema))
    with pytest.raises(Exception, match="tool bad"):
        verify_calls(more, tools).collect()
    assert verify_calls(more, tools, "count").filter("outcome = 'MALFORMED_SPEC'").count() == 1


@pytest.mark.parametrize("parts", [1, 7])
def test_split_ignores_layout(spark, parts):
    ids = spark.range(1000).withColumnRenamed("id", "id")
    for f in (exact_split, hash_split):
        want = {r.id: r.split for r in f(ids, "id", 42).collect()}
        assert {r.id: r.split for r in f(ids.repartition(parts), "id", 42).collect()} == want
    sizes = {r.split: r["count"] for r in exact_split(ids, "id", 42).groupBy("split").count().collect()}
    assert sizes == {"train": 800, "dev": 100, "test": 100}
    assert leakage(exact_split(ids)).first() == (0, 0, 1000)


def raw(spark, *rows):
    return spark.createDataFrame([(i, "q", *r) for i, r in enumerate(rows)], schemas.RAW)


TOOLS = '[{"name": "f", "description": "d", "parameters": {"x": {"type": "int", "description": "é"}}}]'


def test_staged_build_is_the_same(spark, tmp_path):
    rows = raw(spark, *[(TOOLS, "[]")] * 40)
    key = lambda df: sorted((r.id, r.split, r.example) for r in df.collect())
    assert key(build(rows)) == key(build(rows, staging=str(tmp_path / "s")))


def test_build_accounts_for_every_row(spark):
    rows = raw(spark, (TOOLS, '[{"name": "f", "arguments": {"x": 1}}]'), (TOOLS, "[]"), (TOOLS, '[{"name": "f", "arguments": {}}]'), (TOOLS.replace("int", "Dict[a]"), "[]"))
    r = build_report(build(rows)).first()
    assert r.total == 4 == r.normalize_failures + r.quarantined + r.kept
    assert r.kept == 2 == r.train + r.dev + r.test
    assert r.quarantine_rate == pytest.approx(1 / 3)
    assert build_report(build(rows.filter("id < 0"))).first().quarantine_rate == 0.0


def test_build_fails_on_other_errors(spark):
    with pytest.raises(Exception, match="ValueError"):
        build_report(build(raw(spark, (TOOLS.replace("int", "List[int"), "[]")))).collect()


def test_example_round_trip(spark):
    rows = spark.createDataFrame([('say "é"\n', [WEATHER], [call("weather", place="Paris"), call("weather", place="Rome")])], schemas.struct(query=schemas.TEXT, tools=ArrayType(TOOL), gold=CALLS))
    back = rows.select(gold_row(example(F.col("query"), F.col("tools"), F.col("gold"))).alias("g"), F.get_json_object(example(F.col("query"), F.col("tools"), F.col("gold")), "$.messages[0].content").alias("q")).first()
    assert [c.arguments for c in back.g.gold] == ['{"place": "Paris"}', '{"place": "Rome"}'] and back.g.tools[0].name == "weather"
    assert back.q == 'say "é"\n'
    out = prompt_completion(rows).first()
    assert out.prompt.endswith("<|im_start|>assistant\n") and out.completion.endswith("</tool_call>") and out.completion.count("<tool_call>") == 2
    assert rows.select(parse_calls(F.lit(out.completion)).alias("p")).first().p.emits_json


def test_profiles(spark):
    df = spark.createDataFrame([(1,), (2,), (10,)], "n int")
    assert profile.length_profile(df, "n").first().asDict() == {"n": 3, "p50": 2, "p90": 8, "p95": 9, "p99": 9, "longest": 10}
    assert [tuple(r) for r in profile.over_cuts(df, "n", (2,)).collect()] == [(2, 1, pytest.approx(1 / 3))]
    g = spark.createDataFrame([([1, 2], "x</tool_call>"), ([1], "x")], "token_ids array<int>, text string")
    assert profile.probe_rates(g, 2).first() == (0.5, 0.5, 2)
    with pytest.raises(Exception, match="no generations"):
        profile.probe_rates(g.limit(0), 2, strict=True).collect()
    assert dict(profile.field_types(df).collect()) == {"n": "int"}


def test_percent(spark):
    df = spark.createDataFrame([("12.5%",), ("N/A",), (None,), ("3",)], "t string")
    assert [r[0] for r in df.select(benchmarks.percent(F.col("t"))).collect()] == [12.5, None, None, 3.0]


def test_advantage_without_spread(spark):
    r = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5), (2, 3, 0.0), (2, 4, 1.0)], "prompt_id long, sample_id long, reward double")
    assert {x.sample_id: x.advantage for x in prefs.group_advantage(r).collect()} == {1: None, 2: None, 3: -1.0, 4: 1.0}


def python_calls(df):
    """Python functions in the executed plan, by name."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sorted(x for line in plan.split("\n") if "EvalPython" in line for x in re.findall(r"\b(_[a-z]+)\(", line.split("], [")[0]))


def test_each_udf_runs_once(spark):
    rows = raw(spark, (TOOLS, "[]"))
    assert python_calls(normalize(rows).filter("error IS NULL")) == ["_normalised"]
    assert python_calls(build(rows, mode="hash")) == ["_normalised", "_verdicts"]
    kind = schemas.struct(i=schemas.LONG, completion=schemas.TEXT, tools=ArrayType(TOOL), gold=CALLS)
    scored_rows = score_rows(spark.createDataFrame([(0, PARIS, [WEATHER], [])], kind))
    assert python_calls(metric_means(scored_rows)) == ["_parsed", "_verdicts"]
    assert python_calls(scored_rows.filter("strict")) == ["_parsed", "_verdicts"]


def test_first_n(spark):
    df = spark.range(10).repartition(4)
    assert [r.id for r in batches.first_n(df, 3, "id").collect()] == [0, 1, 2]
    assert batches.first_n(df, 0, "id").count() == 10
    with pytest.raises(ValueError):
        batches.first_n(df, -1, "id")


def test_texts_must_fit_batches(spark):
    rows = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (1, 0, "c")], "batch long, place long, name string")
    texts = spark.createDataFrame([(0, 0, "x"), (0, 1, None), (1, 0, "z")], "batch long, place long, text string")
    assert {r.name: r.text for r in batches.with_texts(rows, texts).collect()} == {"a": "x", "b": None, "c": "z"}
    for bad in (texts.filter("batch = 0"), texts.union(texts.limit(1)), texts.union(spark.createDataFrame([(1, 1, "w")], texts.schema))):
        with pytest.raises(Exception, match="a row without a text|several texts|a text without a row"):
            batches.with_texts(rows, bad).collect()


def test_repeated_tool_names(spark):
    """The last of a row's tools of a name counts, as in a registry; a row without tools knows none."""
    strict = ("f", "", encode({"type": "object", "required": ["a"]}))
    loose = ("f", "", "{}")
    text = '{"name": "f", "arguments": {}}'
    assert scored(spark, text, [], (strict, loose))["schema_valid"] and not scored(spark, text, [], (loose, strict))["schema_valid"]
    assert scored(spark, text, [], ())["hallucinated"]


def test_reject_reasons(spark):
    names = ["hallucinated", "n_calls", "schema_valid", "tool_name", "name_and_args"]
    rows = [(True, 1, False, False, False), (False, 0, False, False, False), (False, 1, False, True, True), (False, 1, True, False, False), (False, 1, True, True, False), (False, 1, True, True, True)]
    df = spark.createDataFrame(rows, "hallucinated boolean, n_calls long, schema_valid boolean, tool_name boolean, name_and_args boolean")
    got = [r[0] for r in df.coalesce(1).select(prefs.reject_reason({c: F.col(c) for c in names})).collect()]
    assert got == ["UNKNOWN_TOOL", "NO_CALL", "SCHEMA_VIOLATION", "WRONG_TOOL", "WRONG_ARGUMENTS", "PROTOCOL"]


def test_sample_roll_up_tells_unmeasured_from_wrong(spark):
    rows = [("s", "a", "x", True), ("s", "a", "x", False), ("s", "a", "y", None), ("s", "b", "z", False), ("overall", "c", "w", None), (None, "d", "v", True), ("s", "a", "x", None)]
    df = spark.createDataFrame(rows, "section string, category string, part string, correct boolean")
    got = {(r.level, r.section, r.category, r.part): (r.n, r.measured, r.n_right, r.share, r.score) for r in benchmarks.roll_up_samples(df, {"s": 0.5, "overall": 0.3}).collect()}
    assert got["part", "s", "a", "x"] == (3, 2, 1, 0.5, 0.5)
    assert got["part", "s", "a", "y"] == (1, 0, 0, None, None)  # not measured is not 0
    assert got["category", "s", "a", None] == (4, 2, 1, 0.5, 0.5) and got["category", "s", "b", None] == (1, 1, 0, 0.0, 0.0)
    assert got["section", "s", None, None][3:] == (1 / 3, 0.25)  # the mean of categories, not of samples
    assert got["section", "overall", None, None] == (1, 0, 0, None, None) and got["section", None, None, None][4] == 1.0
    assert got["overall", None, None, None] == (7, 4, 2, 0.5, 0.125)
    assert len(got) == 5 + 4 + 3 + 1
