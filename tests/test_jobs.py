"""The jobs: whole results against plain Python, growing input, failures half-way, reruns."""

import collections
import datetime
import hashlib
import json
import os
import statistics
import subprocess
import sys
from pathlib import Path

import pytest
from oracle import check

from callgrain.plans import job_queries
from jobs import call_log, chat_set

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"
CHAT = {"seed": 7, "most_words": 6, "rows_per_file": 1000, "shares": [0.0, 0.5, 1.0], "tools": [{"name": "f", "parameters": {"type": "object"}}]}
LOG = json.loads((ROOT / "jobs" / "call_log.json").read_text())


@pytest.mark.parametrize("name", sorted(job_queries.QUERIES))
def test_query_matches_sql(spark, name):
    check(spark, job_queries.QUERIES[name], job_queries.ORACLE_SQL[name], SF)


def chats(spark, path, rows):
    spark.createDataFrame(rows, chat_set.ROWS).repartition(3).write.mode("overwrite").parquet(path)


def by_hand(rows, config):
    """Status and split of each pair, in plain Python."""
    said = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None and turn is not None and role in ("user", "assistant"):
            said[conv, turn - (role == "assistant"), role].append(text)
    least = lambda texts: min((t for t in texts if t is not None), default=None)
    pairs = sorted((c, t, least(said[c, t, "user"]), least(said[c, t, "assistant"])) for c, t, r in list(said) if r == "user" and (c, t, "assistant") in said)
    out, seen = {}, set()
    for conv, turn, prompt, completion in pairs:
        a, b = (len((x or "").split()) for x in (prompt, completion))
        status = "empty" if not a or not b else "long" if a + b > config["most_words"] else "copy" if (prompt, completion) in seen else "kept"
        seen.add((prompt, completion))
        place = int(hashlib.md5(f"{config['seed']}:{prompt}".encode()).hexdigest()[:8], 16) % 1000
        out[conv, turn] = (status, "none" if status != "kept" else "test" if place < 100 else "dev" if place < 200 else "train")
    return out


def test_chat_set_accounts_for_every_pair(spark, tmp_path):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "user", "hello\nthere"), (1, 2, "assistant", 'say "hi" é'), (1, 3, "user", "and?"), (1, 5, "assistant", "late"),
        (2, 0, "user", "hello\nthere"), (2, 1, "assistant", 'say "hi" é'), (3, 0, "user", None), (3, 1, "assistant", "x"), (4, 0, "user", " \t"), (4, 1, "assistant", "x"),
        (5, 0, "user", "one two three four"), (5, 1, "assistant", "five six seven"), (6, 0, "user", "b"), (6, 0, "user", "a"), (6, 0, "user", None), (6, 1, "assistant", "y"),
        (None, 0, "user", "n"), (None, 1, "assistant", "n"), (7, None, "user", "n"), (8, 0, None, "n"), (9, 0, "user", "hello\nthere"), (9, 1, "assistant", "another"),
    ]
    rows += [(100 + i, t, r, f"{r} {i % 70}") for i in range(300) for t, r in ((0, "user"), (1, "assistant"))]
    rows += [(99, 2 * i + t, r, f"{r} of the long one {i}") for i in range(500) for t, r in ((0, "user"), (1, "assistant"))]
    path, out = str(tmp_path / "c"), str(tmp_path / "out")
    chats(spark, path, rows)
    got = chat_set.run(spark, CHAT, path, out).collect()
    want = by_hand(rows, CHAT)
    assert {(r.conv_id, r.turn): (r.status, r.split) for r in got} == want and len(got) == len(want)
    assert {s for s, _ in want.values()} == {"kept", "empty", "long", "copy"}
    # a prompt stands in one split only
    splits = collections.defaultdict(set)
    for r in got:
        if r.status == "kept":
            splits[r.prompt].add(r.split)
            assert r.text.endswith(f"{r.prompt}<|im_end|>\n<|im_start|>assistant\n{r.completion}<|im_end|>\n") and '"name": "f"' in r.text
        else:
            assert r.text is None
    assert all(len(s) == 1 for s in splits.values())
    # the lengths of each split, exactly
    lengths = {(r.split, r.share): (r.n_words, r.pairs) for r in chat_set.read_lengths(spark, out).collect()}
    for split in ("train", "dev", "test"):
        n = sorted(r.n_words for r in got if r.split == split)
        assert [lengths[split, x] for x in CHAT["shares"]] == [(v, len(n)) for v in (n[0], statistics.median(n), n[-1])]
    # again, over other input, back to the first: always the rows of the input
    assert sorted(chat_set.run(spark, CHAT, path, out).collect()) == sorted(got)
    other = str(tmp_path / "d")
    chats(spark, other, rows[:3])
    assert chat_set.run(spark, CHAT, other, out).count() == 1
    assert sorted(chat_set.run(spark, CHAT, path, out).collect()) == sorted(got)


def test_chat_set_without_pairs(spark, tmp_path):
    chats(spark, str(tmp_path / "c"), [(1, 0, "system", "x")])
    assert chat_set.run(spark, CHAT, str(tmp_path / "c"), str(tmp_path / "out")).count() == 0


def events(spark, path, rows, name):
    """One more file of the log; the folder grows by it."""
    part = f"{path}-{name}"
    spark.createDataFrame(rows, call_log.ROWS).coalesce(1).write.mode("overwrite").parquet(part)
    os.makedirs(path, exist_ok=True)
    for f in Path(part).glob("*.parquet"):
        os.rename(f, f"{path}/{name}.parquet")


def at(day, hour=0):
    return datetime.datetime(2024, 1, day, hour)


OUTCOME = {"click": "VALID", "view": "VALID", "signup": "SCHEMA_VIOLATION", "nosuch": "UNKNOWN_TOOL", None: "UNKNOWN_TOOL"}
FIRST = [(i, at(1 + i % 4), ("click", "view", "signup", "nosuch")[i % 4 if i % 3 else 0], '{"k": 1}') for i in range(200)] + [(500, at(1, 1), "click", '{"k": 1}'), (500, at(1, 5), "signup", '{"k": 1}'), (None, at(2), "view", '{"k": 2}'), (501, None, "click", '{"k": 3}'), (502, at(2), None, None)]
#: New calls of a new day, corrections of old days, a line that repeats.
SECOND = [(600 + i, at(5), "view", '{"k": 1}') for i in range(10)] + [(500, at(1, 2), "nosuch", "{}"), (0, at(1), "signup", '{"k": 1}'), (1, at(2), "view", '{"k": 1}'), (1, at(2), "view", '{"k": 1}')]


def state(spark, out):
    last = {(r.day, r.event_id): (r.name, r.outcome) for r in call_log.current(call_log.read_calls(spark, out)).collect()}
    daily = {(r.day, r.name, r.outcome): r.n for r in call_log.read_daily(spark, out).collect()}
    return last, daily


def wanted(*batches):
    last = {}
    for rows in batches:  # in a batch the later ts counts, then the later batch
        for i, ts, name, _ in sorted(rows, key=lambda r: (r[1] or at(1), r[2] or "")):
            last[ts and ts.date(), i] = (name, OUTCOME[name])
    return last, dict(collections.Counter((day, *v) for (day, _), v in last.items()))


def test_call_log_takes_only_what_is_new(spark, tmp_path):
    path, out, mark = (str(tmp_path / x) for x in ("log", "out", "mark"))
    events(spark, path, FIRST, "a")
    call_log.run(spark, LOG, path, out, mark)
    assert state(spark, out) == wanted(FIRST)
    files = {str(f): f.stat().st_mtime_ns for f in Path(out).rglob("*.parquet")}
    call_log.run(spark, LOG, path, out, mark)  # nothing new, nothing written
    assert {str(f): f.stat().st_mtime_ns for f in Path(out).rglob("*.parquet")} == files
    events(spark, path, SECOND, "b")
    call_log.run(spark, LOG, path, out, mark)
    assert state(spark, out) == wanted(FIRST, SECOND)
    assert call_log.read_calls(spark, out).groupBy("batch").count().count() == 2
    assert call_log.read_calls(spark, out).count() == len(FIRST) + len(SECOND)
    # days that had nothing new are left as they were
    now = {str(f): f.stat().st_mtime_ns for f in Path(out).rglob("daily/day=2024-01-03/*.parquet")}
    assert now and all(files[f] == t for f, t in now.items())


@pytest.mark.parametrize("step", ["read_calls", "daily"])
def test_call_log_goes_on_after_a_failure(spark, tmp_path, monkeypatch, step):
    path, out, mark = (str(tmp_path / x) for x in ("log", "out", "mark"))
    events(spark, path, FIRST, "a")
    call_log.run(spark, LOG, path, out, mark)
    events(spark, path, SECOND, "b")
    with monkeypatch.context() as m:
        m.setattr(call_log, step, lambda *a: 1 / 0)  # the calls are written, their days are not
        with pytest.raises(Exception, match="division"):
            call_log.run(spark, LOG, path, out, mark)
    events(spark, path, [(900, at(6), "click", '{"k": 1}')], "c")
    call_log.run(spark, LOG, path, out, mark)
    assert state(spark, out) == wanted(FIRST, SECOND, [(900, at(6), "click", "")])


def test_call_log_in_small_batches(spark, tmp_path):
    path, out, mark = (str(tmp_path / x) for x in ("log", "out", "mark"))
    for k in range(5):
        events(spark, path, FIRST[k::5], f"part{k}")
    call_log.run(spark, LOG | {"files_per_batch": 2}, path, out, mark)
    assert call_log.read_calls(spark, out).select("batch").distinct().count() == 3
    assert sum(state(spark, out)[1].values()) == len(wanted(FIRST)[0])


def test_call_log_over_a_growing_copy_of_the_table(spark, tmp_path):
    """The events of the test tables in two halves, the second with corrections of the first, against one batch of SQL."""
    e = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts", "event_type", "props")
    path, out, mark = (str(tmp_path / x) for x in ("log", "out", "mark"))
    first = e.filter("event_id % 2 = 0").selectExpr("event_id", "ts", "IF(event_id % 10 = 0, 'nosuch', event_type) AS event_type", "props")
    first.repartition(3).write.parquet(f"{path}/load=1")
    call_log.run(spark, LOG, f"{path}/load=*", out, mark)
    once = call_log.read_daily(spark, out).agg({"n": "sum"}).first()[0]
    e.filter("event_id % 2 = 1 OR event_id % 10 = 0").repartition(2).write.parquet(f"{path}/load=2")
    call_log.run(spark, LOG, f"{path}/load=*", out, mark)
    assert once == first.count() and call_log.read_calls(spark, out).count() == once + e.filter("event_id % 2 = 1 OR event_id % 10 = 0").count()
    want = call_log.verified(e, LOG["tools"]).groupBy("day", "name", "outcome").count().collect()
    assert {(r.day, r.name, r.outcome): r.n for r in call_log.read_daily(spark, out).collect()} == {(r.day, r.name, r.outcome): r["count"] for r in want}


def test_chat_set_over_a_growing_copy_of_the_table(spark, tmp_path):
    """A rerun over more conversations keeps the split of every prompt that was there."""
    c = spark.read.parquet(f"{SF}/conversations.parquet")
    path, out = str(tmp_path / "c"), str(tmp_path / "out")
    config = json.loads((ROOT / "jobs" / "chat_set.json").read_text())
    c.filter("conv_id % 3 <> 0").write.parquet(path)
    first = {(r.conv_id, r.turn): (r.status, r.split) for r in chat_set.run(spark, config, path, out).collect()}
    c.filter("conv_id % 3 = 0").write.mode("append").parquet(path)
    both = {(r.conv_id, r.turn): (r.status, r.split) for r in chat_set.run(spark, config, path, out).collect()}
    rows = [tuple(r) for r in c.select("conv_id", "turn", "role", "text").collect()]
    assert both == by_hand(rows, config) and len(both) > len(first) > 0
    assert all(both[k] == v for k, v in first.items() if "copy" not in (both[k][0], v[0]))


def test_command_lines(spark, tmp_path):
    path = str(tmp_path / "c")
    chats(spark, path, [(1, 0, "user", "a b"), (1, 1, "assistant", "c")])
    run = lambda *a: subprocess.run([sys.executable, "-m", *a], cwd=ROOT, capture_output=True, text=True, timeout=300)
    done = run("jobs.chat_set", "--conversations", path, "--out", str(tmp_path / "out"))
    assert done.returncode == 0 and "'rows': 2" in done.stderr and "'kept': 1" in done.stderr, done.stderr[-2000:]
    assert chat_set.written(spark, str(tmp_path / "out")).count() == 1
    events(spark, str(tmp_path / "log"), FIRST, "a")
    (tmp_path / "own.json").write_text(json.dumps(LOG | {"files_per_batch": 5}))
    done = run("jobs.call_log", "--calls", str(tmp_path / "log"), "--out", str(tmp_path / "o2"), "--checkpoint", str(tmp_path / "m2"), "--config", f"file://{tmp_path}/own.json")
    assert done.returncode == 0 and "1 new batches" in done.stderr, done.stderr[-2000:]
    assert state(spark, str(tmp_path / "o2")) == wanted(FIRST)
