"""Column types of the engine's tables.  Payloads stay JSON text; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

VALID, UNKNOWN_TOOL, SCHEMA_VIOLATION, MALFORMED_SPEC = "VALID", "UNKNOWN_TOOL", "SCHEMA_VIOLATION", "MALFORMED_SPEC"
FLAGS = ["emits_json", "tool_name", "name_and_args", "schema_valid", "protocol", "strict", "hallucinated"]


def struct(**fields) -> StructType:
    return StructType([StructField(k, t, True) for k, t in fields.items()])


TEXT, LONG, FLAG = StringType(), LongType(), BooleanType()
RAW = struct(id=LONG, query=TEXT, tools=TEXT, answers=TEXT)
TOOL = struct(name=TEXT, description=TEXT, parameters=TEXT)
#: ``canon`` is the argument object's comparable text, see ``functions.jsonkit.canonical``.
CALL = struct(name=TEXT, arguments=TEXT, canon=TEXT)
CALLS = ArrayType(CALL)
VERDICT = struct(outcome=TEXT, detail=TEXT)
VERDICTS = ArrayType(VERDICT)
PARSED = struct(calls=CALLS, emits_json=FLAG, wrapped=FLAG)
NORMALISED = struct(error=TEXT, message=TEXT, tools=ArrayType(TOOL), gold=CALLS)
GOLD_ROW = struct(tools=ArrayType(TOOL), gold=CALLS)
TYPE = struct(schema=TEXT, optional=FLAG, error=TEXT)
OBJECT = struct(schema=TEXT, error=TEXT)
DUMP = struct(i=LONG, completion=TEXT)
