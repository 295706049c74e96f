"""Scores of arriving files: the last line of an id counts, runs go on where they were."""

import json
import os
import shutil

import pytest

from callgrain.functions.jsonkit import canonical
from callgrain.operators.score import metric_means
from callgrain.schemas import CALLS, TOOL
from callgrain.streaming import live

RIGHT = '<tool_call>{"name": "f", "arguments": {"k": %d}}</tool_call>'


@pytest.fixture
def gold(spark):
    rows = [(i, [("f", "", "{}")], [("f", json.dumps({"k": i}), canonical({"k": i}))]) for i in range(12)]
    return spark.createDataFrame(rows, f"i long, tools array<{TOOL.simpleString()}>, gold {CALLS.simpleString()}")


def arrive(path, name, lines, when):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name}", "w") as f:
        f.write("".join(json.dumps({"i": i, "completion": RIGHT % (i or 0) if right else "no"}) + "\n" for i, right in lines))
    os.utime(f"{path}/{name}", (when, when))


def strict(spark, out):
    return {r.i: r.strict for r in live.current_scores(spark, out).collect()}


@pytest.mark.parametrize("max_files", [1, 100])
def test_last_line_counts(spark, gold, tmp_path, max_files):
    path, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    arrive(path, "b", [(0, False), (1, True), (1, False), (2, False), (2, True), (3, True), (99, True), (None, True)], 1000)
    arrive(path, "a", [(3, False), (4, True)], 2000)  # later, though its name is less
    live.score_new_files(spark, path, gold, out, mark, max_files)
    want = {0: False, 1: False, 2: True, 3: False, 4: True}  # 99 has no gold row
    assert strict(spark, out) == want
    before = sorted(os.listdir(out))
    live.score_new_files(spark, path, gold, out, mark, max_files)
    assert sorted(os.listdir(out)) == before and strict(spark, out) == want
    arrive(path, "c", [(0, True), (4, False), (5, True)], 3000)
    live.score_new_files(spark, path, gold, out, mark, max_files)
    want |= {0: True, 4: False, 5: True}
    assert strict(spark, out) == want
    assert metric_means(live.current_scores(spark, out)).first().strict == pytest.approx(sum(want.values()) / len(want))


def test_a_killed_run_gives_the_rows_of_one_run(spark, gold, tmp_path, monkeypatch):
    path, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for k in range(4):
        arrive(path, f"f{k}", [(i, (i + k) % 3 == 0) for i in range(k, 12, 2)], 1000 + k)
    real, taken = live.take_lines, []

    def fail(lines, number, gold, out):
        real(lines, number, gold, out)
        taken.append(number)
        if number == 2:
            # the batch's folder is half written
            shutil.rmtree(f"{out}/batch=2")
            os.makedirs(f"{out}/batch=2")
            raise ZeroDivisionError("killed")

    with monkeypatch.context() as m:
        m.setattr(live, "take_lines", fail)
        with pytest.raises(Exception, match="killed"):
            live.score_new_files(spark, path, gold, out, mark, 1)
    assert taken == [0, 1, 2]
    live.score_new_files(spark, path, gold, out, mark, 1)
    whole = str(tmp_path / "whole")
    live.score_new_files(spark, path, gold, whole, str(tmp_path / "mark2"), 1)
    assert strict(spark, out) == strict(spark, whole) and len(strict(spark, out)) == 12
    last = {}
    for k in range(4):
        last |= {i: (i + k) % 3 == 0 for i in range(k, 12, 2)}
    assert strict(spark, out) == last
