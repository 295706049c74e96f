"""Exact JSON: strict decoding, comparable text, and objects at the head of a text."""

from __future__ import annotations

import json
import math
import re
from itertools import takewhile


def encode(value: object) -> str:
    """JSON text that keeps key order and non-ASCII characters."""
    return json.dumps(value, ensure_ascii=False)


def canonical(value: object) -> str:
    """Text that is equal exactly for values that Python holds equal: keys sorted, 1 = 1.0 = true."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{canonical(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, float) and math.isfinite(value) and value == int(value):
        return str(int(value))
    return json.dumps(value)


def call_of(value: object) -> dict[str, str] | None:
    """A call's ``name, arguments, canon`` if the value is one: an object with a string name and object arguments."""
    if not isinstance(value, dict):
        return None
    name, arguments = value.get("name"), value.get("arguments")
    if not isinstance(name, str) or not isinstance(arguments, dict):
        return None
    return {"name": name, "arguments": encode(arguments), "canon": canonical(arguments)}


#: A string, closed or not, or a brace: all that tells where an object ends.
_BOUND = re.compile(r'"(?:[^"\\]|\\.)*+(?:"|\Z)|[{}]', re.S)
#: White space between values.
_BETWEEN = " \t\r\n"


def object_spans(text: str) -> list[str]:
    """Texts of the balanced objects from the first brace on, as long as only white space stands between them."""
    at = text.find("{")
    found, depth, begin = [], 0, at
    for m in _BOUND.finditer(text, at) if at >= 0 else ():
        if depth == 0 and text[at : m.start()].strip(_BETWEEN):
            break
        if m[0] == "{":
            begin = m.start() if depth == 0 else begin
            depth += 1
        elif m[0] == "}":
            depth -= 1
            at = m.end()
            if depth == 0:
                found.append(text[begin:at])
        if depth <= 0 and m[0] != "}":
            break
    return found


def leading_objects(text: str) -> list[object]:
    """Consecutive JSON objects from the first brace on, with white space between them; ends at the first that does not decode."""
    spans = object_spans(text)
    try:
        return json.loads(f"[{','.join(spans)}]")
    except (ValueError, RecursionError):
        return list(takewhile(lambda x: x is not None, map(_decoded, spans)))


def _decoded(text: str) -> object:
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None
