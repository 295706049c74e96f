"""A validator for the closed set of JSON Schema keywords that tool specifications use.

A keyword outside the set is an error of the schema, never a silent pass.
"""

from __future__ import annotations

from callgrain.functions.jsonkit import canonical

#: Type names; keywords that constrain; keywords that only annotate.
TYPES = ("string", "integer", "number", "boolean", "array", "object", "null")
CONSTRAINTS = ("type", "properties", "required", "items", "prefixItems", "minItems", "maxItems", "uniqueItems", "anyOf", "enum", "additionalProperties")
NOTES = ("description", "title", "default", "examples")


class SchemaError(ValueError):
    """The schema itself is not usable."""


def check_schema(schema: object, at: str = "$") -> None:
    """Raise SchemaError unless the schema is well formed and uses known keywords only."""
    if isinstance(schema, bool):
        return
    if not isinstance(schema, dict):
        raise SchemaError(f"{at}: a schema is an object or a boolean")
    for key, x in schema.items():
        here = f"{at}.{key}"
        match key:
            case "type":
                names = x if isinstance(x, list) and x else [x]
                ok = all(isinstance(n, str) and n in TYPES for n in names)
            case "properties":
                ok = isinstance(x, dict)
                for k, sub in x.items() if ok else ():
                    check_schema(sub, f"{here}.{k}")
            case "required":
                ok = isinstance(x, list) and all(isinstance(n, str) for n in x) and len(set(x)) == len(x)
            case "items" | "additionalProperties":
                ok = True
                check_schema(x, here)
            case "prefixItems" | "anyOf":
                ok = isinstance(x, list) and bool(x)
                for k, sub in enumerate(x if ok else ()):
                    check_schema(sub, f"{here}[{k}]")
            case "minItems" | "maxItems":
                ok = isinstance(x, int) and not isinstance(x, bool) and x >= 0
            case "uniqueItems":
                ok = isinstance(x, bool)
            case "enum":
                ok = isinstance(x, list)
            case _:
                ok = key in NOTES
        if not ok:
            raise SchemaError(f"{here}: unsupported or malformed keyword")


def is_type(value: object, name: str) -> bool:
    match name:
        case "string":
            return isinstance(value, str)
        case "boolean":
            return isinstance(value, bool)
        case "integer":
            return not isinstance(value, bool) and (isinstance(value, int) or isinstance(value, float) and value.is_integer())
        case "number":
            return not isinstance(value, bool) and isinstance(value, int | float)
        case "array":
            return isinstance(value, list)
        case "object":
            return isinstance(value, dict)
    return value is None


def _strict(value: object) -> str:
    """Comparable text in which 1 equals 1.0 but not true."""
    if isinstance(value, bool):
        return f"b{value}"
    if isinstance(value, list):
        return "[" + ",".join(map(_strict, value)) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k!r}:{_strict(value[k])}" for k in sorted(value)) + "}"
    return canonical(value)


def violation(value: object, schema: dict | bool, at: str = "$") -> str | None:
    """The first violation of a well-formed schema, or None."""
    if isinstance(schema, bool):
        return None if schema else f"{at}: nothing is allowed here"
    names = schema.get("type")
    if names is not None and not any(is_type(value, n) for n in (names if isinstance(names, list) else [names])):
        return f"{at}: not of type {names}"
    if "enum" in schema and _strict(value) not in map(_strict, schema["enum"]):
        return f"{at}: not one of the listed values"
    if "anyOf" in schema and all(violation(value, s, at) for s in schema["anyOf"]):
        return f"{at}: matches none of the alternatives"
    if isinstance(value, dict):
        for name in schema.get("required", ()):
            if name not in value:
                return f"{at}: {name} is required"
        known, extra = schema.get("properties", {}), schema.get("additionalProperties", True)
        for name in sorted(value):  # the same first one however the object is written
            if found := violation(value[name], known.get(name, extra), f"{at}.{name}"):
                return found
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0):
            return f"{at}: too few items"
        if len(value) > schema.get("maxItems", len(value)):
            return f"{at}: too many items"
        if schema.get("uniqueItems") and len(set(map(_strict, value))) < len(value):
            return f"{at}: items repeat"
        first = schema.get("prefixItems", ())
        for k, x in enumerate(value):
            if found := violation(x, first[k] if k < len(first) else schema.get("items", True), f"{at}[{k}]"):
                return found
    return None
