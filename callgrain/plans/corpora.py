"""Corpora of calls derived from the driver's tables, and the same in DuckDB SQL.

``events`` gives one call each; its id picks a shape of model output and whether the
content is right.  ``part`` gives raw rows, its key picks a type expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrain import schemas
from callgrain.functions.jsonkit import encode

#: Declared tools; events of type ``error`` name none of them.
REGISTRY = {
    "click": ("a click", {"type": "object", "properties": {"k": {"type": "integer"}}, "required": ["k"]}),
    "view": ("a view", {"type": "object", "properties": {"k": {"type": "number"}}, "required": ["k"]}),
    "signup": ("a sign-up", {"type": "object", "properties": {"k": {"type": "string"}}, "required": ["k"]}),
    "purchase": ("a purchase", {"type": "object", "properties": {"k": {"type": "integer"}, "amount": {"type": "number"}}, "required": ["amount"]}),
}

#: Type expressions with a value for the one argument of the row's call.
RAW_TYPES = [
    ("str", '"a"'), ("int, optional", "3"), ("List[int]", "[1, 2]"), ("Tuple[int, str]", '[1, "a"]'), ("Union[int, str]", "true"), ("Callable[[int], str]", '"f"'),
    ("set", "[1, 1.0]"), ("Dict[str, int]", "{}"), ("unknown_t", "1"), ("float, default=1.5", "2"), ("List[List[str]], optional", '[["a"], [1]]'), ("bool", "true"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registry_column():
    """The registry as a literal array of tools."""
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(d).alias("description"), F.lit(encode(p)).alias("parameters")) for n, (d, p) in REGISTRY.items()])


def tools(spark: SparkSession) -> DataFrame:
    """The registry as a table ``name, description, parameters``."""
    return spark.createDataFrame([(n, d, encode(p)) for n, (d, p) in REGISTRY.items()], schemas.TOOL)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``i, name, arguments, shape, variant`` of each event's call."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("i"), F.col("event_type").alias("name"), F.col("props").alias("arguments"), (F.col("event_id") % 8).alias("shape"), (F.floor(F.col("event_id") / 8) % 4).alias("variant"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``i, tools, gold``: every event's own call is right."""
    e = events(spark, sf_dir)
    canon = F.regexp_replace("arguments", " ", "")
    return e.select("i", registry_column().alias("tools"), F.array(F.struct("name", "arguments", canon.alias("canon"))).alias("gold"))


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``i, completion``: outputs in eight shapes; variant 1 changes the value, variant 2 the tool, variant 3 writes the same value as a decimal."""
    e = events(spark, sf_dir)
    name = F.when(F.col("variant") == 2, "nosuch").otherwise(F.col("name"))
    decimal = F.regexp_replace("arguments", r"\}", ".0}")
    arguments = F.when(F.col("variant") == 1, '{"k": -1}').when(F.col("variant") == 3, decimal).otherwise(F.col("arguments"))
    call = F.concat(F.lit('{"name": "'), name, F.lit('", "arguments": '), arguments, F.lit("}"))
    text = F.element_at(
        F.array(
            F.concat(F.lit("<tool_call>\n"), call, F.lit("\n</tool_call>")),
            call,
            F.concat(call, F.lit(" and more")),
            F.lit("I cannot help with that."),
            F.lit('<tool_call>\n{"name": broken}\n</tool_call>'),
            F.concat(F.lit("<tool_call>"), call, F.lit('</tool_call>\n<tool_call>{"name": 7, "arguments": {}}</tool_call>')),
            F.concat(F.lit("<tool_call>\n"), call),
            F.concat(F.lit("<tool_call>\n"), call, F.lit("\n<tool_call>\n"), call, F.lit("\n</tool_call>")),
        ),
        (F.col("shape") + 1).cast("int"),
    )
    return e.select("i", text.alias("completion"))


def scored_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``i, completion, tools, gold``."""
    g = gold(spark, sf_dir).withColumnRenamed("i", "_i")
    return completions(spark, sf_dir).join(g, F.col("i") == F.col("_i")).drop("_i")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, query, tools, answers`` raw rows; every fifth dozen of parts calls an undeclared tool."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("query"), (F.col("p_partkey") % len(RAW_TYPES)).alias("k"), (F.floor(F.col("p_partkey") / len(RAW_TYPES)) % 5).alias("d"))
    of = lambda at: F.element_at(F.array(*[F.lit(t[at]) for t in RAW_TYPES]), (F.col("k") + 1).cast("int"))
    spec = F.concat(F.lit('[{"name": "tool_'), F.col("k").cast("string"), F.lit('", "description": "a tool", "parameters": {"x": {"type": "'), of(0), F.lit('", "description": "an input"}}}]'))
    name = F.when(F.col("d") == 0, "other").otherwise(F.concat(F.lit("tool_"), F.col("k").cast("string")))
    answers = F.concat(F.lit('[{"name": "'), name, F.lit('", "arguments": {"x": '), of(1), F.lit("}}]"))
    return p.select("id", "query", spec.alias("tools"), answers.alias("answers"))


#: DuckDB: i, name, shape, variant, and what the output says.
SQL_EVENTS = """e AS (
  SELECT event_id AS i, event_type AS name, props, event_id % 8 AS shape, (event_id // 8) % 4 AS variant FROM events),
c AS (
  SELECT *, shape IN (0, 1, 2, 6) AS emits_json, shape IN (0, 4, 5, 7) AS wrapped, shape IN (0, 1, 2, 5, 6) AS has_call,
    CASE WHEN variant = 2 THEN 'nosuch' ELSE name END AS said,
    CASE variant WHEN 1 THEN '{"k": -1}' WHEN 3 THEN replace(props, '}', '.0}') ELSE props END AS said_args FROM e),
f AS (
  SELECT *, has_call AND said = name AS tool_name, has_call AND said = name AND CAST(json_extract_string(said_args, '$.k') AS DOUBLE) = CAST(json_extract_string(props, '$.k') AS DOUBLE) AS name_and_args,
    has_call AND said IN ('click', 'view') AS schema_valid, wrapped AS protocol,
    has_call AND said NOT IN ('click', 'view', 'signup', 'purchase') AS hallucinated FROM c),
s AS (SELECT *, wrapped AND name_and_args AS strict FROM f)"""

#: DuckDB: id and the fate of each raw row.
SQL_RAW = """r AS (
  SELECT p_partkey AS id, p_name AS query, p_partkey % 12 AS k, (p_partkey // 12) % 5 = 0 AS other FROM part),
st AS (
  SELECT *, CASE WHEN k IN (7, 8) THEN 'normalize_failure' WHEN other OR k IN (4, 6, 10) THEN 'quarantined' ELSE 'kept' END AS status FROM r)"""
