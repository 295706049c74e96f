"""Registered queries of the engine's own operators, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrain.functions.jsonkit import encode
from callgrain.operators import batches, benchmarks, prefs, profile, registry, render
from callgrain.operators.build import build, build_report, classify, export_build
from callgrain.operators.normalize import error_counts, normalize, object_schemas, with_types
from callgrain.operators.parse import gold_row, parse_calls
from callgrain.operators.score import join_dump, last_of_dump, metric_means, running_means, score_completions, score_rows
from callgrain.operators.split import exact_split, hash_split, leakage
from callgrain.operators.verify import keep_valid, outcome_counts, verdicts, verify_calls
from callgrain.plans import corpora
from callgrain.plans.corpora import SQL_EVENTS, SQL_RAW, table
from callgrain.sources.readers import first_record, read_benchmark, read_dump, read_examples, read_jsonl, read_raw, read_scores, read_sidecar
from callgrain.sources.scratch import folder
from callgrain.sources.writers import report_lines, summary_line, write_dump, write_jsonl, write_object, write_splits, write_version
from callgrain.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

MODELS = [("base", "lab/small-base", "lab/small-base"), ("tuned", "lab/small-tuned", "lab/small-base")]
WEIGHTS = {"non_live": 0.1, "multi_turn": 0.3, "agentic": 0.4}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_rows(corpora.scored_input(spark, sf_dir))


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.lit(0).cast("long").alias("conv_id"), "event_id", "user_id", F.col("event_type").alias("name"), F.col("props").alias("arguments"))


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify_calls(_calls(spark, sf_dir), corpora.tools(spark).withColumn("conv_id", F.lit(0).cast("long")))


MEANS = ", ".join(f"avg(CAST({f} AS DOUBLE)) AS {f}" for f in ("emits_json", "tool_name", "name_and_args", "schema_valid", "protocol", "strict", "hallucinated"))


@query(f"WITH {SQL_EVENTS} SELECT {MEANS} FROM s HAVING count(*) > 0")
def score_ladder(spark, sf_dir):
    return metric_means(_scores(spark, sf_dir))


@query(f"WITH {SQL_EVENTS} SELECT i, emits_json, tool_name, name_and_args, schema_valid, protocol, strict, hallucinated FROM s")
def score_flags(spark, sf_dir):
    return _scores(spark, sf_dir).drop("n_calls")


@query(ORACLE_SQL["score_flags"])
def score_native(spark, sf_dir):
    """The same flags with calls verified in the JVM: parsing is the only Python evaluation."""
    schemas = [encode(p) for _, p in corpora.REGISTRY.values()]
    return score_rows(corpora.scored_input(spark, sf_dir), schemas=schemas).drop("n_calls")


@query(f"WITH {SQL_EVENTS} SELECT i, emits_json, wrapped, CAST(has_call AS BIGINT) AS n_calls, CASE WHEN has_call THEN said END AS first_name FROM c")
def parse_outputs(spark, sf_dir):
    p = corpora.completions(spark, sf_dir).withColumn("p", parse_calls(F.col("completion")))
    return p.select("i", "p.emits_json", "p.wrapped", F.size("p.calls").cast("long").alias("n_calls"), F.try_element_at("p.calls", F.lit(1))["name"].alias("first_name"))


@query("""
WITH o AS (SELECT CASE WHEN event_type IN ('click', 'view') THEN 'VALID' WHEN event_type IN ('signup', 'purchase') THEN 'SCHEMA_VIOLATION' ELSE 'UNKNOWN_TOOL' END AS outcome FROM events)
SELECT outcome, count(*) AS n, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS rate FROM o GROUP BY outcome""")
def verify_outcomes(spark, sf_dir):
    return outcome_counts(_verified(spark, sf_dir))


@query("""
SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'VALID' WHEN event_type IN ('signup', 'purchase') THEN 'SCHEMA_VIOLATION' ELSE 'UNKNOWN_TOOL' END AS outcome,
  CASE event_type WHEN 'signup' THEN '$.k: not of type string' WHEN 'purchase' THEN '$: amount is required' WHEN 'error' THEN 'no such tool' END AS detail FROM events""")
def verify_details(spark, sf_dir):
    return _verified(spark, sf_dir).select("event_id", "outcome", "detail")


@query(ORACLE_SQL["verify_details"])
def verify_native(spark, sf_dir):
    """The same verdicts by schemas compiled to expressions: no Python in the plan."""
    v = verify_calls(_calls(spark, sf_dir), corpora.tools(spark).withColumn("conv_id", F.lit(0).cast("long")), native=True)
    return v.select("event_id", "outcome", "detail")


def _user_turns(spark, sf_dir):
    """Conversations of one user's events within ten consecutive ids, with their calls in order."""
    e = table(spark, sf_dir, "events")
    key = F.floor(F.col("event_id") / 3).cast("long").alias("id")
    call = F.struct("event_id", F.col("event_type").alias("name"), F.col("props").alias("arguments"), F.col("props").alias("canon"))
    convs = e.groupBy(key).agg(F.array_sort(F.collect_list(call)).alias("c"))
    convs = convs.select("id", F.transform("c", lambda x: F.struct(x["name"].alias("name"), x["arguments"].alias("arguments"), x["canon"].alias("canon"))).alias("gold"), corpora.registry_column().alias("tools"))
    return convs.withColumn("verdicts", verdicts(F.col("gold"), F.col("tools")))


@query("SELECT event_id // 3 AS id, count(*) AS n_calls FROM events GROUP BY 1 HAVING bool_and(event_type IN ('click', 'view'))")
def keep_valid_rows(spark, sf_dir):
    return keep_valid(_user_turns(spark, sf_dir))[0].select("id", F.size("gold").cast("long").alias("n_calls"))


@query("SELECT event_id // 3 AS id, count(*) FILTER (event_type NOT IN ('click', 'view')) AS n_bad FROM events GROUP BY 1 HAVING NOT bool_and(event_type IN ('click', 'view'))")
def quarantine(spark, sf_dir):
    bad = F.size(F.filter("verdicts", lambda v: v["outcome"] != "VALID"))
    return keep_valid(_user_turns(spark, sf_dir))[1].select("id", bad.cast("long").alias("n_bad"))


SQL_TYPES = """t(k, type, schema, optional, error) AS (VALUES
  (0, 'str', '{"type": "string"}', false, NULL), (1, 'int, optional', '{"type": "integer"}', true, NULL), (2, 'List[int]', '{"type": "array", "items": {"type": "integer"}}', false, NULL),
  (3, 'Tuple[int, str]', '{"type": "array", "prefixItems": [{"type": "integer"}, {"type": "string"}], "minItems": 2, "maxItems": 2}', false, NULL),
  (4, 'Union[int, str]', '{"anyOf": [{"type": "integer"}, {"type": "string"}]}', false, NULL), (5, 'Callable[[int], str]', '{}', false, NULL), (6, 'set', '{"type": "array", "uniqueItems": true}', false, NULL),
  (7, 'Dict[str, int]', NULL, false, 'NotImplementedError'), (8, 'unknown_t', NULL, false, 'KeyError'), (9, 'float, default=1.5', '{"type": "number"}', true, NULL),
  (10, 'List[List[str]], optional', '{"type": "array", "items": {"type": "array", "items": {"type": "string"}}}', true, NULL), (11, 'bool', '{"type": "boolean"}', false, NULL))"""


def _typed(spark, sf_dir):
    of = F.element_at(F.array(*[F.lit(t) for t, _ in corpora.RAW_TYPES]), (F.col("p_partkey") % 12 + 1).cast("int"))
    return with_types(table(spark, sf_dir, "part").select("p_partkey", of.alias("type")))


@query(f"WITH {SQL_TYPES} SELECT p_partkey, type, schema, error FROM part JOIN t ON p_partkey % 12 = k")
def convert_type(spark, sf_dir):
    return _typed(spark, sf_dir).select("p_partkey", "type", "schema", "error")


@query(f"WITH {SQL_TYPES} SELECT p_partkey, optional FROM part JOIN t ON p_partkey % 12 = k")
def strip_modifiers(spark, sf_dir):
    return _typed(spark, sf_dir).select("p_partkey", "optional")


@query("""
SELECT p_partkey, '{"type": "object", "properties": {"size": {"description": "size of ' || p_brand || '", "type": "integer"}, "note": {"description": "by default none", "type": "string"}, "tags": {"description": "tags", "type": "array", "items": {"type": "string"}}}, "required": ["size"]}' AS schema FROM part""")
def object_schema(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    text = F.concat(F.lit('{"size": {"type": "int", "description": "size of '), "p_brand", F.lit('"}, "note": {"type": "str", "description": "by default none"}, "tags": {"type": "List[str], optional", "description": "tags"}}'))
    return p.select("p_partkey", object_schemas(text)["schema"].alias("schema"))


@query("""
SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN p_brand || ',' || p_type WHEN p_size % 3 = 1 THEN p_brand || ',' || p_type || ',' || p_name ELSE p_brand || ',' || p_type || ',' || p_name || ',' || p_size END AS names,
  CASE WHEN p_size % 3 = 0 THEN 'last of ' || p_name ELSE 'first of ' || p_name END AS first_description, CAST(p_partkey % 4 AS BIGINT) AS n_calls FROM part""")
def normalize_registry(spark, sf_dir):
    """A repeated tool name keeps its first place and its last specification; names, repeats and calls come from the row's columns."""
    p = table(spark, sf_dir, "part")
    tool = lambda n, d: F.concat(F.lit('{"name": '), render.quoted(n), F.lit(', "description": '), render.quoted(d), F.lit(', "parameters": {}}'))
    third = F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).otherwise(F.col("p_name"))
    tools = [tool(F.col("p_brand"), F.concat(F.lit("first of "), "p_name")), tool(F.col("p_type"), F.lit("other")), tool(third, F.concat(F.lit("last of "), "p_name"))]
    fourth = F.when(F.col("p_size") % 3 == 2, F.array(tool(F.col("p_size").cast("string"), F.lit("size")))).otherwise(F.array().cast("array<string>"))
    call = F.concat(F.lit('{"name": '), render.quoted(F.col("p_brand")), F.lit(', "arguments": {}}'))
    rows = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("query"), render.listed(F.concat(F.array(*tools), fourth)).alias("tools"), render.listed(F.array_repeat(call, (F.col("p_partkey") % 4).cast("int"))).alias("answers"))
    n = normalize(rows)
    return n.select("id", F.array_join(F.transform("tools", lambda t: t["name"]), ",").alias("names"), F.col("tools")[0]["description"].alias("first_description"), F.size("gold").cast("long").alias("n_calls"))


@query("""
WITH r AS (SELECT p_partkey AS id, p_partkey % 12 AS k FROM part)
SELECT id, CASE k WHEN 7 THEN 'NotImplementedError' WHEN 8 THEN 'KeyError' END AS error FROM r""")
def normalize_errors(spark, sf_dir):
    return normalize(corpora.raw(spark, sf_dir)).select("id", "error")


SPLIT_SQL = """
WITH k AS (SELECT c_custkey AS id, md5('7:' || CAST(c_custkey AS VARCHAR)) AS h FROM customer)
SELECT id, CASE WHEN b < 100 THEN 'test' WHEN b < 200 THEN 'dev' ELSE 'train' END AS split FROM (SELECT id, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 1000 AS b FROM k)"""
EXACT_SQL = """
WITH k AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY md5('7:' || CAST(c_custkey AS VARCHAR)), c_custkey) AS p, count(*) OVER () AS n FROM customer)
SELECT id, CASE WHEN p <= ceil(n * 0.1::DOUBLE) THEN 'test' WHEN p <= ceil(n * 0.1::DOUBLE) + ceil((n - ceil(n * 0.1::DOUBLE)) * 0.111::DOUBLE) THEN 'dev' ELSE 'train' END AS split FROM k"""


def _ids(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))


@query(SPLIT_SQL)
def split_hash(spark, sf_dir):
    return hash_split(_ids(spark, sf_dir), "id", 7)


@query(EXACT_SQL)
def split_exact(spark, sf_dir):
    return exact_split(_ids(spark, sf_dir), "id", 7)


LEAK_SQL = """
WITH k AS (SELECT o_custkey, o_orderkey % 7 = 0 AS out, CAST('0x' || substr(md5('7:' || CAST({key} AS VARCHAR)), 1, 8) AS BIGINT) % 1000 AS b FROM orders),
s AS (SELECT o_custkey, CASE WHEN out THEN NULL WHEN b < 100 THEN 'test' WHEN b < 200 THEN 'dev' ELSE 'train' END AS split FROM k),
g AS (SELECT o_custkey, count(DISTINCT split) AS k, count(*) AS n, count(*) FILTER (split IS NULL) AS lost FROM s GROUP BY o_custkey)
SELECT count(*) FILTER (k > 1) AS n_leaked, CAST(sum(lost) AS BIGINT) AS n_lost, CAST(sum(n) AS BIGINT) AS n_rows FROM g"""


def _leakage(spark, sf_dir, key):
    """Customers whose orders stand in several splits; each seventh order gets none."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return leakage(hash_split(orders, key, 7, F.col("o_orderkey") % 7 != 0), "o_custkey")


@query(LEAK_SQL.format(key="o_custkey"))
def split_leakage(spark, sf_dir):
    """Split by the customer: none leaks."""
    return _leakage(spark, sf_dir, "o_custkey")


@query(LEAK_SQL.format(key="o_orderkey"))
def split_leaks(spark, sf_dir):
    """Split by the order: customers leak, and are counted."""
    return _leakage(spark, sf_dir, "o_orderkey")


@query(f"""
WITH {SQL_RAW}, k AS (SELECT row_number() OVER (ORDER BY md5('0:' || CAST(id AS VARCHAR)), id) AS p, count(*) OVER () AS n FROM st WHERE status = 'kept'),
x AS (SELECT count(*) AS kept, max(ceil(n * 0.1::DOUBLE)) AS test, max(ceil((n - ceil(n * 0.1::DOUBLE)) * 0.111::DOUBLE)) AS dev FROM k)
SELECT count(*) AS total, count(*) FILTER (status = 'normalize_failure') AS normalize_failures, count(*) FILTER (status = 'quarantined') AS quarantined, count(*) FILTER (status = 'kept') AS kept,
  CAST(max(x.kept - x.test - x.dev) AS BIGINT) AS train, CAST(max(x.dev) AS BIGINT) AS dev, CAST(max(x.test) AS BIGINT) AS test,
  count(*) FILTER (status = 'quarantined') / CAST(count(*) FILTER (status IN ('quarantined', 'kept')) AS DOUBLE) AS quarantine_rate FROM st CROSS JOIN x""")
def build_counts(spark, sf_dir):
    return build_report(build(corpora.raw(spark, sf_dir)))


@query(f"WITH {SQL_RAW} SELECT id, status FROM st")
def build_status(spark, sf_dir):
    return classify(corpora.raw(spark, sf_dir)).select("id", "status")


EXAMPLE_SQL = """'{"messages": [{"role": "user", "content": "' || CAST(event_id AS VARCHAR) || ' \\"now\\""}, {"role": "assistant", "tool_calls": [{"type": "function", "function": {"name": "' || event_type || '", "arguments": ' || props || '}}]}], "tools": [{"type": "function", "function": {"name": "click", "description": "a click", "parameters": {"type": "object", "properties": {"k": {"type": "integer"}}, "required": ["k"]}}}]}'"""


def _conversations(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    tools = F.slice(corpora.registry_column(), 1, 1)
    return e.select(F.col("event_id").alias("id"), F.concat(F.col("event_id").cast("string"), F.lit(' "now"')).alias("query"), tools.alias("tools"), F.array(F.struct(F.col("event_type").alias("name"), F.col("props").alias("arguments"))).alias("gold"))


@query(f"SELECT event_id AS id, {EXAMPLE_SQL} AS example FROM events")
def format_examples(spark, sf_dir):
    c = _conversations(spark, sf_dir)
    return c.select("id", render.example(F.col("query"), F.col("tools"), F.col("gold")).alias("example"))


@query("""
SELECT event_id AS id, '<|im_start|>system' || chr(10) || '[{"type": "function", "function": {"name": "click", "description": "a click", "parameters": {"type": "object", "properties": {"k": {"type": "integer"}}, "required": ["k"]}}}]<|im_end|>' || chr(10)
  || '<|im_start|>user' || chr(10) || CAST(event_id AS VARCHAR) || ' "now"<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt,
  '<tool_call>' || chr(10) || '{"name": "' || event_type || '", "arguments": ' || props || '}' || chr(10) || '</tool_call>' AS completion FROM events""")
def prompt_completion(spark, sf_dir):
    return render.prompt_completion(_conversations(spark, sf_dir)).select("id", "prompt", "completion")


#: Two chat templates as a user would bring them: one with marks around turns, one with headings.
TEXT_TEMPLATES = {
    "marks": ("""<|im_start|>system
{{ tools | tojson }}<|im_end|>
{% for m in messages %}
<|im_start|>{{ m.role }}
{% for c in m.tool_calls %}
<tool_call>
{"name": {{ c.function.name | tojson }}, "arguments": {{ c.function.arguments }}}
</tool_call>
{%- if not loop.last %}

{% endif %}
{% endfor %}
{{- m.content }}<|im_end|>
{% endfor %}
{% if add_generation_prompt %}
<|im_start|>assistant
{% endif %}""", "<|im_end|>"),
    "headings": ("""{% if tools %}
# Tools
{% for t in tools %}
{{ loop.index0 }}. {{ t.function.name }}: {{ t.function.description }}
{% endfor %}
{% endif %}
{% for m in messages %}
{% if m.role == 'user' %}
# Question
{{ m.content | trim }}
{% else %}
# Calls
{% for c in m.tool_calls %}
- {{ c.function | tojson }}
{% endfor %}
{% endif %}
{% endfor %}
{% if add_generation_prompt %}
# Calls
{% endif %}""", ""),
}


@query(f"""
WITH m AS ({ORACLE_SQL["prompt_completion"]})
SELECT 'marks' AS template, id, prompt, completion FROM m
UNION ALL SELECT 'headings', event_id, '# Tools' || chr(10) || '0. click: a click' || chr(10) || '# Question' || chr(10) || CAST(event_id AS VARCHAR) || ' "now"' || chr(10) || '# Calls' || chr(10),
  '- {{"name": "' || event_type || '", "arguments": ' || props || '}}' FROM events""")
def text_templates(spark, sf_dir):
    """Prompt and completion by two templates given as text."""
    c = _conversations(spark, sf_dir)
    parts = [render.prompt_completion(c, render.TextTemplate(text, end)).select(F.lit(name).alias("template"), "id", "prompt", "completion") for name, (text, end) in TEXT_TEMPLATES.items()]
    return parts[0].union(parts[1])


@query(f"WITH {SQL_TYPES} SELECT type AS value, count(*) AS n FROM part JOIN t ON p_partkey % 12 = k GROUP BY type")
def type_histogram(spark, sf_dir):
    return profile.type_histogram(corpora.raw(spark, sf_dir))


@query("SELECT value, count(*) AS n FROM part, (VALUES ('type'), ('description')) v(value) GROUP BY value")
def key_histogram(spark, sf_dir):
    return profile.key_histogram(corpora.raw(spark, sf_dir))


@query("""
SELECT count(*) AS n, CAST(floor(quantile_cont(w, 0.5)) AS BIGINT) AS p50, CAST(floor(quantile_cont(w, 0.9)) AS BIGINT) AS p90, CAST(floor(quantile_cont(w, 0.95)) AS BIGINT) AS p95,
  CAST(floor(quantile_cont(w, 0.99)) AS BIGINT) AS p99, CAST(max(w) AS BIGINT) AS longest FROM (SELECT len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS w FROM conversations)""")
def length_percentiles(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(profile.words(F.col("text")).alias("w"))
    return profile.length_profile(c, "w")


@query("""
WITH w AS (SELECT length(text) AS w FROM conversations)
SELECT CAST(cut AS BIGINT) AS cut, count(*) FILTER (w > cut) AS n, avg(CAST(w > cut AS DOUBLE)) AS rate FROM w, (VALUES (100), (400), (1600)) c(cut) GROUP BY cut""")
def truncation(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.length("text").alias("w"))
    return profile.over_cuts(c, "w", (100, 400, 1600))


@query(f"""
WITH {SQL_EVENTS}, b AS (SELECT i // 256 AS batch, count(*) AS n, sum(CAST(name_and_args AS INT)) AS c, sum(CAST(strict AS INT)) AS s FROM s GROUP BY 1)
SELECT batch, CAST(sum(c) OVER w AS DOUBLE) / sum(n) OVER w AS content, CAST(sum(s) OVER w AS DOUBLE) / sum(n) OVER w AS strict FROM b WINDOW w AS (ORDER BY batch)""")
def running_strict(spark, sf_dir):
    return running_means(_scores(spark, sf_dir), 256)


@query("""
SELECT user_id AS i, arg_max(event_type, event_id) AS completion FROM events GROUP BY user_id""")
def dump_last_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return last_of_dump(e.select(F.col("event_id").alias("line_no"), F.col("user_id").alias("i"), F.col("event_type").alias("completion")))


@query("""
WITH a AS (SELECT DISTINCT CASE WHEN n_nationkey % 3 = 0 THEN 'base' WHEN n_nationkey % 3 = 1 THEN 'tuned' ELSE 'runs/' || n_name || '/step_' || n_nationkey END AS arg FROM nation)
SELECT arg, CASE WHEN arg IN ('base', 'tuned') THEN arg ELSE string_split(arg, '/')[-1] END AS name,
  CASE arg WHEN 'base' THEN 'lab/small-base' WHEN 'tuned' THEN 'lab/small-tuned' ELSE arg END AS weights, 'lab/small-base' AS tokenizer FROM a""")
def resolve_model(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey") % 3
    args = n.select(F.when(k == 0, "base").when(k == 1, "tuned").otherwise(F.concat(F.lit("runs/"), "n_name", F.lit("/step_"), F.col("n_nationkey").cast("string"))).alias("arg")).distinct()
    return registry.resolve_models(args, spark.createDataFrame(MODELS, "name string, weights string, tokenizer string"), "lab/small-base")


@query("SELECT n_name AS arg, CASE n_nationkey WHEN 0 THEN 'lab/zero' ELSE n_name END AS weights FROM nation")
def resolve_alias(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    known = n.filter("n_nationkey = 0").select(F.col("n_name").alias("alias"), F.lit("lab/zero").alias("weights"))
    return registry.resolve_aliases(n.select(F.col("n_name").alias("arg")), known)


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def resume_missing(spark, sf_dir):
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return registry.missing(table(spark, sf_dir, "customer").select("c_custkey"), done, "c_custkey")


@query(f"""
WITH {SQL_EVENTS} SELECT avg(CAST(name <> 'click' AS DOUBLE)) AS hit_cap_rate, avg(CAST(wrapped AS DOUBLE)) AS closed_rate, count(*) AS n FROM c""")
def probe_rates(spark, sf_dir):
    ends = F.when(F.col("event_type") == "click", F.array(F.lit(5), F.lit(2))).otherwise(F.array(F.lit(5), F.lit(7)))
    g = table(spark, sf_dir, "events").select(F.col("event_id").alias("i"), ends.alias("token_ids"))
    return profile.probe_rates(corpora.completions(spark, sf_dir).withColumnRenamed("completion", "text").join(g, "i"), eos=2)


@query("SELECT p_partkey, CASE p_size % 2 WHEN 0 THEN p_partkey || ',' || p_size ELSE CAST(p_size AS VARCHAR) END AS kept FROM part")
def label_mask(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    ids = F.array(F.col("p_partkey"), F.col("p_size").cast("long"))
    labels = F.array(F.when(F.col("p_size") % 2 == 0, F.col("p_partkey")).otherwise(F.lit(-100)), F.col("p_size").cast("long"))
    return p.select("p_partkey", F.array_join(render.kept_labels(ids, labels).cast("array<string>"), ",").alias("kept"))


@query("SELECT o_orderkey AS checkpoint, o_totalprice AS eval_loss FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1")
def best_checkpoint(spark, sf_dir):
    return profile.best_checkpoint(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("checkpoint"), F.col("o_totalprice").alias("eval_loss")))


#: Benchmark samples of the scored events: a section by the shape of the output, a category by its variant; nothing of the agentic section was measured.
SQL_SAMPLE_RESULTS = f"""{SQL_EVENTS}, x AS (
  SELECT CASE WHEN shape IN (3, 4) THEN 'agentic' WHEN shape IN (5, 7) THEN 'multi_turn' ELSE 'non_live' END AS section, 'variant_' || variant AS category, name AS part,
    CASE WHEN shape IN (3, 4) THEN NULL ELSE name_and_args END AS correct FROM s)"""


def _sample_results(spark, sf_dir):
    e = corpora.events(spark, sf_dir).select(F.col("i").alias("_i"), "name", "shape", "variant")
    rows = _scores(spark, sf_dir).join(e, F.col("i") == F.col("_i"))
    section = F.when(F.col("shape").isin(3, 4), "agentic").when(F.col("shape").isin(5, 7), "multi_turn").otherwise("non_live")
    return rows.select(section.alias("section"), F.concat(F.lit("variant_"), F.col("variant").cast("string")).alias("category"), F.col("name").alias("part"), F.when(section != "agentic", F.col("name_and_args")).alias("correct"))


@query(f"""
WITH {SQL_SAMPLE_RESULTS}, p AS (SELECT section, category, part, avg(CAST(correct AS DOUBLE)) AS score FROM x GROUP BY ALL),
cat AS (SELECT section, category, avg(score) AS score FROM p GROUP BY ALL), s2 AS (SELECT section, avg(score) AS score, count(score) AS measured FROM cat GROUP BY section)
SELECT section, round(score, 9) AS score, measured FROM s2 UNION ALL
SELECT 'overall', round(sum(coalesce(score, 0) * CASE section WHEN 'non_live' THEN 0.1::DOUBLE WHEN 'multi_turn' THEN 0.3::DOUBLE ELSE 0.4::DOUBLE END), 9), count(score) FROM s2""")
def bfcl_rollup(spark, sf_dir):
    """Part scores of the events' samples, rolled up to sections and the weighted whole."""
    scores = _sample_results(spark, sf_dir).groupBy("section", "category", "part").agg(F.avg(F.col("correct").cast("double")).alias("score"))
    return benchmarks.roll_up(scores, WEIGHTS).withColumn("score", F.round("score", 9))


@query(f"""
WITH {SQL_SAMPLE_RESULTS}, p AS (SELECT section, category, part, count(*) AS n, count(correct) AS measured, count(*) FILTER (correct) AS n_right, avg(CAST(correct AS DOUBLE)) AS score FROM x GROUP BY ALL),
cat AS (SELECT section, category, avg(score) AS score, sum(n) AS n, sum(measured) AS measured, sum(n_right) AS n_right FROM p GROUP BY ALL),
sec AS (SELECT section, avg(score) AS score, sum(n) AS n, sum(measured) AS measured, sum(n_right) AS n_right FROM cat GROUP BY ALL),
whole AS (SELECT sum(coalesce(score, 0) * CASE section WHEN 'non_live' THEN 0.1::DOUBLE WHEN 'multi_turn' THEN 0.3::DOUBLE ELSE 0.4::DOUBLE END) AS score, sum(n) AS n, sum(measured) AS measured, sum(n_right) AS n_right FROM sec),
u AS (
  SELECT 'part' AS level, section, category, part, n, measured, n_right, score FROM p UNION ALL SELECT 'category', section, category, NULL, n, measured, n_right, score FROM cat
  UNION ALL SELECT 'section', section, NULL, NULL, n, measured, n_right, score FROM sec UNION ALL SELECT 'overall', NULL, NULL, NULL, n, measured, n_right, score FROM whole)
SELECT level, section, category, part, CAST(n AS BIGINT) AS n, CAST(measured AS BIGINT) AS measured, CAST(n_right AS BIGINT) AS n_right, round(n_right::DOUBLE / nullif(measured, 0), 9) AS share, round(score, 9) AS score FROM u""")
def sample_rollup(spark, sf_dir):
    """The same samples at all four levels: counts, shares of the measured ones and plain means, what was not measured apart from 0."""
    r = benchmarks.roll_up_samples(_sample_results(spark, sf_dir), WEIGHTS)
    return r.withColumns({c: F.round(c, 9) for c in ("share", "score")})


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS stddev, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def latency_stats(spark, sf_dir):
    r = benchmarks.latency(table(spark, sf_dir, "events"), "value", "event_type")
    return r.select("event_type", *[F.round(c, 6).alias(c) for c in ("mean", "stddev", "p50", "p95")])


@query("SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS units, round(sum(l_quantity), 3) AS seconds, round(sum(l_linenumber) / sum(l_quantity), 9) AS per_second FROM lineitem GROUP BY l_returnflag")
def serving_throughput(spark, sf_dir):
    r = benchmarks.throughput(table(spark, sf_dir, "lineitem"), "l_linenumber", "l_quantity", "l_returnflag")
    return r.select("l_returnflag", "units", F.round("seconds", 3).alias("seconds"), F.round("per_second", 9).alias("per_second"))


@query("""
WITH g AS (SELECT o_orderkey AS i, o_orderpriority AS gold FROM orders), d AS (SELECT l_orderkey AS i, l_linenumber, l_returnflag FROM lineitem)
SELECT g.i, max(struct_pack(n := l_linenumber, f := l_returnflag)).f AS completion, any_value(gold) AS gold FROM d JOIN g USING (i) GROUP BY g.i""")
def dump_join(spark, sf_dir):
    """A dump drives the join with its gold rows; the last line of an index wins, uncovered gold rows are left out."""
    dump = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("line_no"), F.col("l_orderkey").alias("i"), F.col("l_returnflag").alias("completion"))
    return join_dump(dump, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), F.col("o_orderpriority").alias("gold")))


@query("SELECT i, len(x) AS n FROM (SELECT event_id AS i, [s FOR s IN string_split(props, '}') IF s <> ''] AS x FROM events)")
def leading_run(spark, sf_dir):
    """Objects at the head of an output: two in a row, then a broken one."""
    e = table(spark, sf_dir, "events")
    call = F.concat(F.lit('{"name": "f", "arguments": '), "props", F.lit("}"))
    text = F.concat(F.lit("so: "), call, F.lit(" {broken"))
    return e.select(F.col("event_id").alias("i"), F.size(parse_calls(text)["calls"]).cast("long").alias("n"))


def _samples(spark, sf_dir):
    """Scored samples by prompt: a user's events are samples of one prompt."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("_e"), "user_id")
    rows = corpora.scored_input(spark, sf_dir).join(e, F.col("i") == F.col("_e")).drop("_e")
    return score_rows(rows, "user_id")


SQL_SAMPLES = f"{SQL_EVENTS}, p AS (SELECT s.*, user_id FROM s JOIN events ON event_id = i)"


@query(f"""
WITH {SQL_SAMPLES}, o AS (SELECT *, CASE WHEN hallucinated THEN 'UNKNOWN_TOOL' WHEN NOT has_call THEN 'NO_CALL' WHEN NOT schema_valid THEN 'SCHEMA_VIOLATION' WHEN NOT tool_name THEN 'WRONG_TOOL'
  WHEN NOT name_and_args THEN 'WRONG_ARGUMENTS' ELSE 'PROTOCOL' END AS reason FROM p),
g AS (SELECT user_id, min(i) AS chosen FROM o WHERE strict GROUP BY user_id)
SELECT user_id AS prompt_id, chosen, i AS rejected, reason FROM o JOIN g USING (user_id) WHERE NOT strict""")
def preference_pairs(spark, sf_dir):
    s = _samples(spark, sf_dir)
    return prefs.preference_pairs(s.select(F.col("user_id").alias("prompt_id"), F.col("i").alias("sample_id"), "strict", prefs.reject_reason({c: F.col(c) for c in s.columns}).alias("reason")))


REWARD_SQL = "CASE WHEN strict THEN 1.0 WHEN NOT emits_json OR hallucinated THEN -1.0 WHEN schema_valid THEN 0.5 ELSE 0.0 END"


@query(f"WITH {SQL_EVENTS} SELECT i, CAST({REWARD_SQL} AS DOUBLE) AS reward FROM s")
def reward(spark, sf_dir):
    return _scores(spark, sf_dir).select("i", prefs.reward(F.col("strict"), F.col("schema_valid"), F.col("emits_json"), F.col("hallucinated")).alias("reward"))


@query(f"""
WITH {SQL_SAMPLES}, r AS (SELECT user_id AS prompt_id, i AS sample_id, CAST({REWARD_SQL} AS DOUBLE) AS reward FROM p)
SELECT prompt_id, sample_id, reward, round((reward - avg(reward) OVER g) / nullif(stddev_pop(reward) OVER g, 0), 6) AS advantage FROM r WINDOW g AS (PARTITION BY prompt_id)""")
def group_advantage(spark, sf_dir):
    s = _samples(spark, sf_dir)
    r = s.select(F.col("user_id").alias("prompt_id"), F.col("i").alias("sample_id"), prefs.reward(F.col("strict"), F.col("schema_valid"), F.col("emits_json"), F.col("hallucinated")).alias("reward"))
    return prefs.group_advantage(r).withColumn("advantage", F.round("advantage", 6))


@query(f"""
WITH {SQL_EVENTS}, k AS (SELECT emits_json, name_and_args, CASE WHEN said IN ('click', 'view') THEN 'VALID' WHEN said IN ('signup', 'purchase') THEN 'SCHEMA_VIOLATION' ELSE 'UNKNOWN_TOOL' END AS outcome FROM s WHERE has_call)
SELECT avg(CAST(emits_json AS DOUBLE)) AS json_validity, CAST(count(*) FILTER (emits_json AND outcome = 'VALID') AS DOUBLE) / count(*) FILTER (emits_json) AS schema_compliance,
  avg(CAST(outcome = 'UNKNOWN_TOOL' AS DOUBLE)) AS hallucinated_rate, avg(CAST(name_and_args AS DOUBLE)) AS exact_call_accuracy FROM k""")
def format_metrics(spark, sf_dir):
    rows = corpora.scored_input(spark, sf_dir).withColumn("p", parse_calls(F.col("completion"))).withColumn("v", verdicts(F.col("p.calls"), F.col("tools")))
    call = F.explode(F.arrays_zip(F.col("p.calls").alias("c"), F.col("v").alias("v"), F.col("gold").alias("g")))
    calls = rows.select("p.emits_json", call.alias("z")).filter("z.c IS NOT NULL")
    exact = F.coalesce((F.col("z.c.name") == F.col("z.g.name")) & (F.col("z.c.canon") == F.col("z.g.canon")), F.lit(False))
    return prefs.format_metrics(calls.select("emits_json", F.col("z.v.outcome").alias("outcome"), exact.alias("exact")))


@query(f"""
WITH {SQL_EVENTS}, m AS (SELECT {MEANS} FROM s), u AS (UNPIVOT m ON COLUMNS(*) INTO NAME k VALUE v)
SELECT format('{{:>13}}: {{:6.2f}}%', k, v * 100) AS line FROM u""")
def console_report(spark, sf_dir):
    return report_lines(metric_means(_scores(spark, sf_dir)))


@query("SELECT o_orderkey AS i, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000")
def first_rows(spark, sf_dir):
    """The head of a table in an order: the limit is the feature."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), "o_totalprice")
    return batches.first_n(o, 1000, "i")


@query("""
SELECT n AS "limit", c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS place FROM customer), (VALUES (0), (25)) l(n) WHERE n = 0 OR place <= n""")
def limit_zero(spark, sf_dir):
    """A limit of 0 is none; any other is one."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return batches.first_n(c, 0, "c_custkey").select(F.lit(0).alias("limit"), "c_custkey").union(batches.first_n(c, 25, "c_custkey").select(F.lit(25), "c_custkey"))


@query("SELECT event_id // 32 AS batch, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 1")
def batch_bounds(spark, sf_dir):
    """All rows of a numbered table in consecutive batches."""
    e = table(spark, sf_dir, "events").select("event_id", batches.batch_of(F.col("event_id"), 32).alias("batch"))
    return e.groupBy("batch").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query(f"WITH {SQL_EVENTS} SELECT i // 32 AS batch, i % 32 AS place, i, has_call, emits_json FROM c")
def batch_texts(spark, sf_dir):
    """Batches beside the texts generated for them; lengths must agree."""
    key = lambda c: (batches.batch_of(c, 32).alias("batch"), (c % 32).alias("place"))
    e = table(spark, sf_dir, "events").select(*key(F.col("event_id")), F.col("event_id").alias("i"))
    t = corpora.completions(spark, sf_dir).select(*key(F.col("i")), F.col("completion").alias("text"))
    p = batches.with_texts(e, t).withColumn("p", parse_calls(F.col("text")))
    return p.select("batch", "place", "i", (F.size("p.calls") > 0).alias("has_call"), "p.emits_json")


def _gold_file(spark, sf_dir) -> str:
    """Every event as an exported example, in the order of its id."""
    path = folder(spark, "gold")
    write_jsonl(corpora.gold(spark, sf_dir), path, render.example(F.concat(F.lit("event "), F.col("i").cast("string")), F.col("tools"), F.col("gold")), "i")
    return path


def _dump_file(spark, sf_dir) -> str:
    """A completion dump of seven rows in eight; every fifth row has an older line that does not count."""
    path = folder(spark, "dump")
    c = corpora.completions(spark, sf_dir).filter("i % 8 <> 3").select((F.col("i") * 2 + 1).alias("id"), "i", "completion")
    older = c.filter("i % 5 = 0").select((F.col("id") - 1).alias("id"), "i", F.lit("older").alias("completion"))
    write_jsonl(c.union(older), path, F.to_json(F.struct("i", "completion")), "id")
    return path


@query("SELECT event_id AS i, CAST(4 AS BIGINT) AS n_tools, event_type AS name, props AS arguments, replace(props, ' ', '') AS canon FROM events")
def gold_rows(spark, sf_dir):
    """Registry and gold calls of exported examples, read back from JSON lines."""
    g = read_examples(spark, _gold_file(spark, sf_dir))
    return g.select("i", F.size("tools").cast("long").alias("n_tools"), F.col("gold")[0]["name"].alias("name"), F.col("gold")[0]["arguments"].alias("arguments"), F.col("gold")[0]["canon"].alias("canon"))


#: Gold arguments, nested and with decimals, and ways to write them; ``{k}`` is the event's number.
NESTED = '{"z": {"list": [1, {k}, {"q": "a b", "p": null}], "flag": true}, "a": {k}.5}'
WRITTEN = [
    ('{"a": {k}.5, "z": {"flag": true, "list": [1, {k}, {"p": null, "q": "a b"}]}}', True),  # keys in another order
    ('{"a":{k}.50,"z":{"flag":1,"list":[1.0,{k}.0,{"p":null,"q":"a b"}]}}', True),  # other numbers for the same values
    ('{"a": {k}.5, "z": {"flag": true, "list": [{k}, 1, {"p": null, "q": "a b"}]}}', False),  # lists keep their order
    ('{"a": {k}.5, "z": {"flag": true, "list": [1, {k}, {"p": null, "q": "ab"}]}}', False),  # white space in a string counts
    ('{"a": {k}.5, "z": {"flag": true, "list": [1, {k}, {"q": "a b"}]}}', False),  # null is not missing
    ('{"a": "{k}.5", "z": {"flag": true, "list": [1, {k}, {"p": null, "q": "a b"}]}}', False),  # a string is no number
]


@query("""
WITH e AS (SELECT event_id AS i, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id % 6 AS way FROM events)
SELECT i, way < 2 OR (way = 2 AND k = 1) AS name_and_args FROM e""")
def canonical_calls(spark, sf_dir):
    """Nested arguments of exported examples against calls that write them in other ways."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    way = F.element_at(F.array(*[F.lit(t) for t, _ in WRITTEN]), (F.col("event_id") % len(WRITTEN) + 1).cast("int"))
    call = F.array(F.struct(F.lit("f").alias("name"), F.replace(F.lit(NESTED), F.lit("{k}"), k).alias("arguments")))
    tools = F.from_json(F.lit('[{"name": "f", "description": "", "parameters": "{}"}]'), "array<struct<name: string, description: string, parameters: string>>")
    gold = gold_row(render.example(F.lit("q"), tools, call))
    said = F.concat(F.lit('<tool_call>{"name": "f", "arguments": '), F.replace(way, F.lit("{k}"), k), F.lit("}</tool_call>"))
    rows = e.select(F.col("event_id").alias("i"), said.alias("completion"), gold.alias("g")).select("i", "completion", "g.tools", "g.gold")
    return score_rows(rows).select("i", "name_and_args")


@query(f"WITH {SQL_EVENTS} SELECT i, emits_json, tool_name, name_and_args, schema_valid, protocol, strict, hallucinated FROM s WHERE i % 8 <> 3")
def score_files(spark, sf_dir):
    """A completion dump scored against exported examples, both read from JSON lines; what the dump lacks is left out."""
    return score_completions(read_examples(spark, _gold_file(spark, sf_dir)), read_dump(spark, _dump_file(spark, sf_dir)))[0]


@query(f"WITH {SQL_EVENTS} SELECT {MEANS} FROM s WHERE i % 8 <> 3 HAVING count(*) > 0")
def score_files_means(spark, sf_dir):
    return score_completions(read_examples(spark, _gold_file(spark, sf_dir)), read_dump(spark, _dump_file(spark, sf_dir)))[1]


@query(f"""
WITH b AS ({ORACLE_SQL["build_counts"]}) SELECT unnest(['total', 'normalize_failures', 'quarantined', 'kept', 'train', 'dev', 'test']) AS name,
  unnest([total, normalize_failures, quarantined, kept, train, dev, test]) AS counted, unnest([NULL, NULL, NULL, NULL, train, dev, test]) AS written FROM b""")
def build_export(spark, sf_dir):
    """Counts taken while the examples are written, beside the lines that stand in the files, read back from a sidecar."""
    path, side = folder(spark, "export"), folder(spark, "sidecar")
    counts = export_build(build(corpora.raw(spark, sf_dir)), path)
    write_object(spark, f"{side}/counts.json", counts)
    lines = spark.read.text(path).groupBy("split").agg(F.count("*").alias("written"))
    one = read_sidecar(spark, f"{side}/counts.json")
    named = one.select(F.explode(F.create_map(*[x for c in counts for x in (F.lit(c), F.col(c))])).alias("name", "counted"))
    return named.join(lines, F.col("name") == F.col("split"), "left").select("name", "counted", "written")


@query(f"WITH {SQL_RAW} SELECT id, query, status <> 'normalize_failure' AS fine FROM st")
def raw_rows(spark, sf_dir):
    """Raw rows as JSON files, read by their schema and normalised."""
    path = folder(spark, "raw")
    corpora.raw(spark, sf_dir).write.json(path)
    return normalize(read_raw(spark, path, "json")).select("id", "query", F.col("error").isNull().alias("fine"))


@query("SELECT event_id AS i, CAST(event_id AS VARCHAR) || ' ' || event_type AS completion, event_id AS line_no FROM events")
def dump_lines(spark, sf_dir):
    """A completion dump as the writer orders it, read back with its line numbers."""
    path = folder(spark, "written-dump")
    e = table(spark, sf_dir, "events")
    write_dump(e.select(F.col("event_id").alias("i"), F.concat_ws(" ", F.col("event_id").cast("string"), "event_type").alias("completion")), path)
    return read_dump(spark, path)


@query("SELECT min(event_id) AS line_no, min_by(event_type, event_id) AS first FROM events")
def first_line(spark, sf_dir):
    """The first record of a dump: its line number (ids are places) and what it says."""
    path = folder(spark, "first")
    write_dump(table(spark, sf_dir, "events").select(F.col("event_id").alias("i"), F.col("event_type").alias("completion")), path)
    return first_record(read_jsonl(spark, path)).select(F.col("i").alias("line_no"), F.get_json_object("line", "$.completion").alias("first"))


@query("""
SELECT l_returnflag AS Model, round(100 * avg(l_discount), 2) AS Discount, CASE l_returnflag WHEN 'N' THEN NULL ELSE round(100 * avg(l_tax), 2) END AS Tax, CAST(count(*) AS DOUBLE) AS Rows FROM lineitem GROUP BY l_returnflag""")
def score_table(spark, sf_dir):
    """A score table as CSV: percent texts and plain numbers become doubles, ``N/A`` null, the key stays text."""
    path = folder(spark, "scores-csv")
    shown = lambda c: F.format_string("%.2f%%", 100 * F.avg(c))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("Model")).agg(shown("l_discount").alias("Discount"), shown("l_tax").alias("Tax"), F.count("*").cast("string").alias("Rows"))
    rows.withColumn("Tax", F.when(F.col("Model") == "N", "N/A").otherwise(F.col("Tax"))).write.option("header", True).csv(path)
    return read_scores(spark, path)


@query("""
SELECT CAST(v AS BIGINT) AS version, o_orderpriority AS priority, CAST(count(*) AS BIGINT) AS n, CAST(v AS BIGINT) AS said FROM orders, (VALUES (0), (1)) t(v) WHERE v = 0 OR o_orderstatus = 'O' GROUP BY ALL""")
def versions(spark, sf_dir):
    """Two versions of an artifact, each with its metadata, read back together."""
    path = folder(spark, "artifact")
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus")
    for rows in (o, o.filter("o_orderstatus = 'O'")):
        write_version({"orders": rows}, path, {"table": "orders"})
    meta = spark.read.option("multiLine", True).option("basePath", path).json(f"{path}/version=*/meta.json").select("version", F.col("table"))
    rows = spark.read.option("basePath", path).parquet(f"{path}/version=*/orders")
    return rows.groupBy("version", F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n")).join(meta.select(F.col("version").cast("long").alias("said")), F.col("version") == F.col("said")).select(F.col("version").cast("long").alias("version"), "priority", "n", "said")


@query("""
SELECT column_name AS field, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' ELSE lower(data_type) END AS type FROM information_schema.columns WHERE table_name = 'part'""")
def field_types(spark, sf_dir):
    """Fields of a table and their types."""
    return profile.field_types(table(spark, sf_dir, "part"))


@query(f"""
WITH b AS ({ORACLE_SQL["build_counts"]}) SELECT split, n, n AS n_calls FROM (SELECT unnest(['train', 'dev', 'test']) AS split, unnest([train, dev, test]) AS n FROM b)""")
def round_trip(spark, sf_dir):
    """Build, export by split, load again: examples and gold calls of each split."""
    path = folder(spark, "splits")
    write_splits(build(corpora.raw(spark, sf_dir)), path)
    of = lambda s: read_examples(spark, f"{path}/split={s}").agg(F.count("*").alias("n"), F.sum(F.size("gold")).cast("long").alias("n_calls")).select(F.lit(s).alias("split"), "n", "n_calls")
    return of("train").union(of("dev")).union(of("test"))


@query(f"""
WITH b AS ({ORACLE_SQL["build_counts"]})
SELECT concat_ws(' ', 'total=' || total, 'normalize_failures=' || normalize_failures, 'quarantined=' || quarantined, 'kept=' || kept, 'train=' || train, 'dev=' || dev, 'test=' || test,
  'quarantine_rate=' || format('{{:.4f}}', quarantine_rate)) AS line FROM b""")
def build_summary(spark, sf_dir):
    return summary_line(build_report(build(corpora.raw(spark, sf_dir))))


@query("SELECT CASE p_partkey % 12 WHEN 7 THEN 'NotImplementedError' ELSE 'KeyError' END AS error, count(*) AS n FROM part WHERE p_partkey % 12 IN (7, 8) GROUP BY 1")
def error_classes(spark, sf_dir):
    """Rows that do not normalise, by the class of their error."""
    return error_counts(normalize(corpora.raw(spark, sf_dir)))


@query("""
WITH o AS (SELECT CASE WHEN event_type IN ('click', 'view') THEN 'VALID' WHEN event_type IN ('signup', 'purchase') THEN 'SCHEMA_VIOLATION' ELSE 'MALFORMED_SPEC' END AS outcome FROM events)
SELECT outcome, count(*) AS n, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS rate FROM o GROUP BY outcome""")
def malformed_outcomes(spark, sf_dir):
    """Calls by outcome where the specification of one called tool is no schema."""
    bad = spark.createDataFrame([("error", "an error", '{"type": "anything"}')], corpora.schemas.TOOL)
    tools = corpora.tools(spark).union(bad).withColumn("conv_id", F.lit(0).cast("long"))
    return outcome_counts(verify_calls(_calls(spark, sf_dir), tools, on_malformed="count"))


@query("SELECT item_id, CAST(text AS VARCHAR) AS question, CAST(item_id % 3 AS BIGINT) AS n_functions FROM benchmark")
def benchmark_items(spark, sf_dir):
    """Benchmark files of JSON lines: their questions and how many functions each offers."""
    path = folder(spark, "benchmark")
    b = table(spark, sf_dir, "benchmark")
    functions = F.array_repeat(F.struct(F.lit("f").alias("name")), (F.col("item_id") % 3).cast("int"))
    item = F.to_json(F.struct(F.concat(F.lit("item_"), F.col("item_id").cast("string")).alias("id"), F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("question"), functions.alias("function")))
    write_jsonl(b.select(F.col("item_id").alias("id"), item.alias("example")), path)
    r = read_benchmark(spark, path)
    return r.select(F.substring_index("id", "_", -1).cast("long").alias("item_id"), F.get_json_object("question", "$[0].content").alias("question"), F.json_array_length("function").cast("long").alias("n_functions"))


@query(f"WITH {SQL_EVENTS} SELECT count(*) AS n, {MEANS} FROM s WHERE i % 8 <> 3")
def stream_means(spark, sf_dir):
    """The dump's lines as a stream of files, to its end: first lines count."""
    path = folder(spark, "stream")
    c = corpora.completions(spark, sf_dir).filter("i % 8 <> 3")
    c.repartition(3, "i").select(F.to_json(F.struct("i", "completion")).alias("line")).write.text(path)
    name = "means_" + path[-8:]
    q = live.start(live.live_means(live.live_scores(live.read_completions(spark, path, max_files=2), corpora.gold(spark, sf_dir))), name, folder(spark, "stream-state"), once=True)
    q.awaitTermination()
    return spark.table(name)


@query(f"WITH {SQL_EVENTS} SELECT count(*) AS n, {MEANS} FROM s WHERE i % 8 <> 3")
def stream_last_wins(spark, sf_dir):
    """A dump's lines as files that arrive one after the other, every fifth row first with an older line: the last line counts, over two runs."""
    path, out, mark = (folder(spark, label) for label in ("arriving", "scores", "scores-state"))
    c = corpora.completions(spark, sf_dir).filter("i % 8 <> 3")
    line = F.to_json(F.struct("i", "completion")).alias("line")
    gold = corpora.gold(spark, sf_dir)
    c.filter("i % 5 = 0").withColumn("completion", F.lit("older")).select(line).write.text(f"{path}/part=1")
    c.filter("i % 2 = 0").select(line).write.text(f"{path}/part=2")
    live.score_new_files(spark, f"{path}/part=*", gold, out, mark, max_files=3)
    c.filter("i % 2 = 1").select(line).write.text(f"{path}/part=3")
    live.score_new_files(spark, f"{path}/part=*", gold, out, mark, max_files=3)
    return live.live_means(live.current_scores(spark, out))


def conversation_pairs(spark, sf_dir):
    """``conv_id, turn, prompt, completion``: each user turn with the assistant turn that follows it."""
    c = table(spark, sf_dir, "conversations")
    nxt = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("completion"))
    return c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt")).join(nxt, ["conv_id", "turn"])


query("""
SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS completion FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'""")(conversation_pairs)
