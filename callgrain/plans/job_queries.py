"""The runnable jobs as registered queries: each runs twice into one new folder, whose rows are read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrain.sources.scratch import shared_root
from jobs import call_log, chat_set
from jobs.common import shipped_config


def _fresh(spark: SparkSession, label: str) -> str:
    """A new folder that stays."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def job1_chat_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the conversations with their status, split and rendered text, and each split's lengths (``conv_id`` null), after two runs."""
    out = _fresh(spark, "job1")
    for _ in range(2):
        rows = chat_set.run(spark, shipped_config("chat_set.json"), f"{sf_dir}/conversations.parquet", out)
    none = lambda kind: F.lit(None).cast(kind)
    pairs = rows.select("conv_id", "turn", "prompt", "completion", "text", "n_words", "status", "split", none("double").alias("share"), none("double").alias("length"))
    lengths = chat_set.read_lengths(spark, out).select(*(none(k).alias(c) for c, k in (("conv_id", "long"), ("turn", "long"), ("prompt", "string"), ("completion", "string"), ("text", "string"))), F.col("pairs").alias("n_words"), F.lit("lengths").alias("status"), "split", "share", F.round("n_words", 6).alias("length"))
    return pairs.unionByName(lengths)


def job2_call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with their verdicts, and each day's outcomes (``event_id`` null), after two runs with one checkpoint."""
    out = _fresh(spark, "job2")
    for _ in range(2):
        # a pattern, as a stream takes no single file by its plain path and the table may be one
        call_log.run(spark, shipped_config("call_log.json"), f"{sf_dir}/events.parque[t]", out, f"{out}-checkpoint")
    day, none = F.col("day").cast("string").alias("day"), lambda kind: F.lit(None).cast(kind)
    calls = call_log.current(call_log.read_calls(spark, out)).select(day, "event_id", "name", "outcome", "detail", F.lit(1).cast("long").alias("n"))
    return calls.unionByName(call_log.read_daily(spark, out).select(day, none("long").alias("event_id"), "name", "outcome", none("string").alias("detail"), "n"))


_CHAT_SQL = r"""
WITH k AS (
  SELECT conv_id, CASE WHEN role = 'assistant' THEN turn - 1 ELSE turn END AS turn, role, text FROM conversations WHERE role IN ('user', 'assistant') AND conv_id IS NOT NULL AND turn IS NOT NULL),
p AS (
  SELECT conv_id, turn, min(text) FILTER (role = 'user') AS prompt, min(text) FILTER (role = 'assistant') AS completion FROM k GROUP BY ALL HAVING bool_or(role = 'user') AND bool_or(role = 'assistant')),
w AS (
  SELECT *, CAST(coalesce(len(list_filter(string_split_regex(prompt, '\s+'), lambda x: x <> '')), 0) AS BIGINT) AS a, CAST(coalesce(len(list_filter(string_split_regex(completion, '\s+'), lambda x: x <> '')), 0) AS BIGINT) AS b,
    row_number() OVER (PARTITION BY prompt, completion ORDER BY conv_id, turn) AS place FROM p),
s AS (
  SELECT *, a + b AS n_words, CASE WHEN a = 0 OR b = 0 THEN 'empty' WHEN a + b > 250 THEN 'long' WHEN place > 1 THEN 'copy' ELSE 'kept' END AS status, CAST('0x' || substr(md5('7:' || prompt), 1, 8) AS BIGINT) % 1000 AS h FROM w),
r AS (
  SELECT conv_id, turn, prompt, completion, n_words, status, CASE WHEN status <> 'kept' THEN 'none' WHEN h < 100 THEN 'test' WHEN h < 200 THEN 'dev' ELSE 'train' END AS split,
    CASE WHEN status = 'kept' THEN '<|im_start|>system' || chr(10) || '[]<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || prompt || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || completion || '<|im_end|>' || chr(10) END AS text
  FROM s),
l AS (
  SELECT split, share, quantile_cont(n_words, [0.5, 0.9, 0.95, 0.99])[k] AS length, count(*) AS n FROM r, (VALUES (1, 0.5::DOUBLE), (2, 0.9::DOUBLE), (3, 0.95::DOUBLE), (4, 0.99::DOUBLE)) v(k, share) WHERE status = 'kept' GROUP BY split, share, k)
SELECT conv_id, turn, prompt, completion, text, n_words, status, split, CAST(NULL AS DOUBLE) AS share, CAST(NULL AS DOUBLE) AS length FROM r
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, n, 'lengths', split, share, round(CAST(length AS DOUBLE), 6) FROM l
"""
_LOG_SQL = """
WITH v AS (
  SELECT CAST(ts AS DATE) AS day, event_id, event_type AS name,
    CASE WHEN event_type IN ('click', 'view') THEN 'VALID' WHEN event_type IN ('signup', 'purchase') THEN 'SCHEMA_VIOLATION' ELSE 'UNKNOWN_TOOL' END AS outcome,
    CASE event_type WHEN 'signup' THEN '$.k: not of type string' WHEN 'purchase' THEN '$: amount is required' WHEN 'error' THEN 'no such tool' END AS detail FROM events)
SELECT CAST(day AS VARCHAR) AS day, event_id, name, outcome, detail, CAST(1 AS BIGINT) AS n FROM v
UNION ALL SELECT CAST(day AS VARCHAR), NULL, name, outcome, NULL, count(*) FROM v GROUP BY day, name, outcome
"""

QUERIES = {"job1_chat_set": job1_chat_set, "job2_call_log": job2_call_log}
ORACLE_SQL = {"job1_chat_set": _CHAT_SQL, "job2_call_log": _LOG_SQL}
