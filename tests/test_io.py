"""Sources, sinks and the stream."""

import json
import subprocess
from concurrent.futures import ThreadPoolExecutor

import pytest

from callgrain import schemas
from callgrain.functions.jsonkit import call_of
from callgrain.operators.build import build, build_report, export_build
from callgrain.operators.score import score_completions
from callgrain.sources import readers, writers
from callgrain.streaming import live
from pyspark.sql.types import ArrayType


def test_jsonl(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text('{"a": "é"}\n{"a": 2}\n', encoding="utf-8")
    rows = readers.read_jsonl(spark, str(f)).orderBy("line_no").collect()
    assert [(r.line_no, json.loads(r.line)["a"]) for r in rows] == [(0, "é"), (1, 2)]
    assert readers.first_record(readers.read_jsonl(spark, str(f))).first().line_no == 0
    for bad in ('{"a": 1}\n\n{"a": 2}\n', '{"a": 1} x\n'):
        f.write_text(bad)
        with pytest.raises(Exception, match="not JSON"):
            readers.read_jsonl(spark, str(f)).collect()
    assert readers.read_jsonl(spark, str(f), strict=False).count() == 0


def test_lines_of_split_files(spark, tmp_path):
    """Numbers are exact where a file is read by several tasks, and over several files."""
    for k in range(3):
        (tmp_path / f"{k}.jsonl").write_text("".join(json.dumps({"k": k, "n": n, "x": "é" * (n % 50)}, ensure_ascii=False) + "\n" for n in range(400)), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        lines = readers.read_jsonl(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 1
        rows = lines.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 1200 and all(r.line_no == json.loads(r.line)["n"] and r.i == 400 * json.loads(r.line)["k"] + r.line_no for r in rows)


def test_lines_are_not_shuffled(spark, tmp_path):
    """Numbers come to the lines; no shuffle holds the texts of a file, whatever the optimiser broadcasts on its own."""
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n' * 5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = readers.numbered_lines(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_text_is_written_after_the_sort(spark, tmp_path):
    """An expression for the text gives the lines that a column gives."""
    from pyspark.sql import functions as F

    rows = spark.range(50).select((F.lit(49) - F.col("id")).alias("id"))
    text = F.to_json(F.struct("id"))
    writers.write_jsonl(rows, str(tmp_path / "x"), text)
    writers.write_jsonl(rows.withColumn("example", text), str(tmp_path / "y"))
    got = [[r.value for r in readers.numbered_lines(spark, str(tmp_path / k)).orderBy("i").selectExpr("line AS value").collect()] for k in "xy"]
    assert got[0] == got[1] == [json.dumps({"id": k}, separators=(",", ":")) for k in range(50)]


def test_benchmark_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "x_1", "question": [[{"role": "user"}]], "function": [{"name": "f"}]}\n{"id": "x_2", "question": []}\n')
    got = {r.id: (r.question, r.function) for r in readers.read_benchmark(spark, str(tmp_path / "a.json")).collect()}
    assert json.loads(got["x_1"][1]) == [{"name": "f"}] and got["x_2"] == ("[]", None)


def test_build_to_files(spark, tmp_path):
    tools = '[{"name": "f", "description": "d", "parameters": {"x": {"type": "int", "description": "é"}}}]'
    rows = spark.createDataFrame([(i, f"q{i}", tools, '[{"name": "f", "arguments": {"x": 1}}]') for i in range(50)], schemas.RAW)
    built = build(rows)
    writers.write_splits(built, str(tmp_path / "out"))
    lines = [x for p in (tmp_path / "out").glob("split=*/part-*") for x in p.read_text(encoding="utf-8").splitlines()]
    assert len(lines) == 50 and all("é" in x and json.loads(x)["messages"][0]["role"] == "user" for x in lines)
    writers.write_jsonl(built, str(tmp_path / "one"), single_file=True)
    assert [json.loads(x)["messages"][0]["content"] for p in (tmp_path / "one").glob("part-*") for x in p.read_text().splitlines()] == [f"q{i}" for i in range(50)]
    writers.write_report(build_report(built), str(tmp_path / "meta.json"), seed=0)
    assert json.loads((tmp_path / "meta.json").read_text())["kept"] == 50
    assert readers.read_sidecar(spark, str(tmp_path / "meta.json")).first().seed == 0
    assert [writers.write_version({"rows": rows}, str(tmp_path / "art"), {"a": 1}) for _ in range(2)] == [0, 1]
    assert {x.path.rsplit("/", 1)[1] for x in readers.list_files(spark, str(tmp_path / "art")).collect()} == {"meta.json"}


def test_dump_and_paths(spark, tmp_path):
    df = spark.createDataFrame([(1, "b"), (0, "a")], schemas.DUMP)
    writers.write_dump(df, str(tmp_path / "d"))
    assert {(r.i, r.completion) for r in readers.read_dump(spark, str(tmp_path / "d")).collect()} == {(0, "a"), (1, "b")}
    assert writers.metrics_path("x/run.gen.jsonl") == "x/run.metrics.json" and writers.metrics_path("x/run.jsonl") == "x/run.metrics.json" and writers.metrics_path("run") == "run.metrics.json"
    first = readers.run_id(spark, str(tmp_path / "id"), resume=True)
    assert readers.run_id(spark, str(tmp_path / "id"), resume=True) == first != readers.run_id(spark, str(tmp_path / "id"), resume=False)


def test_score_table(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Model,Acc,Web\nm,12.5%,N/A\n")
    assert readers.read_scores(spark, str(tmp_path / "s.csv")).first() == ("m", 12.5, None)


def test_stream(spark, tmp_path):
    c = call_of({"name": "f", "arguments": {"x": 1}})
    gold = spark.createDataFrame([(i, [("f", "d", "{}")], [tuple(c.values())]) for i in range(2)], schemas.struct(i=schemas.LONG, tools=ArrayType(schemas.TOOL), gold=schemas.CALLS))
    text = '{"name": "f", "arguments": {"x": 1}}'
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.jsonl").write_text(json.dumps({"i": 0, "completion": text}) + "\n" + json.dumps({"i": 0, "completion": "late"}) + "\n")
    q = live.start(live.live_means(live.live_scores(live.read_completions(spark, str(tmp_path / "in")), gold)), "means", str(tmp_path / "cp"))
    try:
        q.processAllAvailable()
        (tmp_path / "in" / "2.jsonl").write_text(json.dumps({"i": 1, "completion": "none"}) + "\n")
        q.processAllAvailable()
        r = spark.table("means").first()
        assert r.n == 2 and r.name_and_args == 0.5
    finally:
        q.stop()
    dump = spark.createDataFrame([(0, 0, text), (1, 1, "none")], "line_no long, i long, completion string")
    assert score_completions(gold, dump)[1].first().name_and_args == 0.5


def test_raw_rows_by_their_schema(spark, tmp_path):
    rows = [(1, "q", "[]", "[]"), (2, None, "[{}]", None)]
    df = spark.createDataFrame(rows, "id long, query string, tools string, answers string")
    for kind in ("parquet", "json", "orc"):
        df.withColumn("more", df.id).write.format(kind).save(str(tmp_path / kind))
        got = readers.read_raw(spark, str(tmp_path / kind), kind)
        assert got.columns == df.columns and sorted(got.collect()) == sorted(df.collect())


def test_lineage_is_the_commit(tmp_path):
    run = lambda *a: subprocess.run(["git", "-c", "user.name=x", "-c", "user.email=x@example.com", *a], cwd=tmp_path, check=True, capture_output=True, text=True).stdout.strip()
    run("init", "-q")
    with pytest.raises(subprocess.CalledProcessError):
        readers.lineage(str(tmp_path))
    run("commit", "-q", "--allow-empty", "-m", "one")
    assert readers.lineage(str(tmp_path)) == run("rev-parse", "HEAD") and len(readers.lineage(str(tmp_path))) == 40


def test_counts_on_the_way(spark, tmp_path):
    rows = [(i, "q", '[{"name": "f", "description": "d", "parameters": {"x": {"type": "int", "description": "d"}}}]', f'[{{"name": "{"f" if i % 3 else "g"}", "arguments": {{"x": {i}}}}}]') for i in range(40)]
    built = build(spark.createDataFrame(rows, "id long, query string, tools string, answers string"))
    counts = export_build(built, str(tmp_path / "out"))
    assert counts == {c: build_report(built).first()[c] for c in counts} and counts["kept"] == 26
    assert {r.split: r["count"] for r in spark.read.text(str(tmp_path / "out")).groupBy("split").count().collect()} == {s: counts[s] for s in ("train", "dev", "test") if counts[s]}
    none = build(spark.createDataFrame([], "id long, query string, tools string, answers string"))
    assert set(export_build(none, str(tmp_path / "none")).values()) == {0}


def test_writers_at_the_same_time_get_their_own_versions(spark, tmp_path):
    path = str(tmp_path / "artifact")
    with ThreadPoolExecutor(6) as pool:
        got = list(pool.map(lambda k: (k, writers.write_version({"rows": spark.range(k, k + 3)}, path, {"k": k})), range(12)))
    assert sorted(v for _, v in got) == list(range(12))
    for k, v in got:
        assert sorted(r.id for r in writers.read_version(spark, path, "rows", v).collect()) == [k, k + 1, k + 2]
        assert readers.read_sidecar(spark, f"{path}/version={v}/meta.json").first().asDict() == {"version": v, "k": k}


def test_a_version_that_is_not_whole_is_not_read(spark, tmp_path):
    path = str(tmp_path / "artifact")
    with pytest.raises(ValueError, match="no whole version"):
        writers.read_version(spark, path, "rows")
    assert writers.write_version({"rows": spark.range(2)}, path, {}) == 0
    with pytest.raises(Exception, match="broken"):
        writers.write_version({"rows": spark.range(5), "more": spark.range(1).selectExpr("raise_error('broken') AS x")}, path, {})
    assert writers.read_version(spark, path, "rows").count() == 2  # the last whole one
    with pytest.raises(ValueError, match="no whole version 1"):
        writers.read_version(spark, path, "rows", 1)
    assert writers.write_version({"rows": spark.range(7)}, path, {}) == 2 and writers.read_version(spark, path, "rows").count() == 7
