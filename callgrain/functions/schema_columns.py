"""JSON Schemas compiled to column expressions over ``VARIANT``: the first violation of a value, worked out in the JVM.

The expressions say what :func:`callgrain.functions.json_schema.violation` says, in its words.
Schemas with ``uniqueItems``, or an ``enum`` of arrays or objects, are not compiled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from callgrain.functions.json_schema import SchemaError, check_schema


class NotCompiled(ValueError):
    """The schema needs the general validator."""


def _number(kind: Column) -> Column:
    return (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL")


def _is_type(value: Column, kind: Column, name: str) -> Column:
    if name == "integer":
        x = F.try_variant_get(value, "$", "double")
        return _number(kind) & ((kind == "BIGINT") | ((x == F.rint(x)) & (F.abs(x) < float("inf"))))
    if name == "number":
        return _number(kind)
    if name in ("array", "object"):
        return kind.startswith(name.upper() + "<")
    return kind == {"string": "STRING", "boolean": "BOOLEAN", "null": "VOID"}[name]


def _equals(value: Column, kind: Column, listed: object) -> Column:
    """Equality of a scalar: 1 is 1.0, but not true."""
    if listed is None:
        return kind == "VOID"
    if isinstance(listed, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == F.lit(listed))
    if isinstance(listed, str):
        return (kind == "STRING") & (F.try_variant_get(value, "$", "string") == F.lit(listed))
    if isinstance(listed, int | float) and abs(listed) < 2**53 and listed == int(listed):
        listed = int(listed)
        same = F.try_variant_get(value, "$", "decimal(38, 0)") == F.lit(str(listed)).cast("decimal(38, 0)")
        return _number(kind) & same & (F.try_variant_get(value, "$", "double") == F.lit(float(listed)))
    if isinstance(listed, float) and abs(listed) < 2**53:
        return _number(kind) & (F.try_variant_get(value, "$", "double") == F.lit(listed))
    raise NotCompiled("enum")


def _first(checks: list[Column]) -> Column:
    return F.coalesce(*checks) if checks else F.lit(None).cast("string")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _check(value: Column, schema: dict | bool, at: Column) -> Column:
    """The first violation of ``value`` (a bound VARIANT), or null."""
    if isinstance(schema, bool):
        return F.lit(None).cast("string") if schema else F.concat(at, F.lit(": nothing is allowed here"))
    if schema.get("uniqueItems"):
        raise NotCompiled("uniqueItems")
    # a null inside an array or object may come as SQL's
    return _bound(F.coalesce(F.schema_of_variant(value), F.lit("VOID")), lambda kind: _first(_checks(value, kind, schema, at)))


def _checks(value: Column, kind: Column, schema: dict, at: Column) -> list[Column]:
    said = lambda text: F.concat(at, F.lit(f": {text}"))
    out = []
    names = schema.get("type")
    if names is not None:
        fits = F.lit(False)
        for name in names if isinstance(names, list) else [names]:
            fits = fits | F.coalesce(_is_type(value, kind, name), F.lit(False))
        out.append(F.when(~fits, said(f"not of type {names}")))
    if "enum" in schema:
        fits = F.lit(False)
        for x in schema["enum"]:
            fits = fits | F.coalesce(_equals(value, kind, x), F.lit(False))
        out.append(F.when(~fits, said("not one of the listed values")))
    if "anyOf" in schema:
        fails = F.lit(True)
        for s in schema["anyOf"]:
            fails = fails & _check(value, s, at).isNotNull()
        out.append(F.when(fails, said("matches none of the alternatives")))
    if schema.get("required") or schema.get("properties") or schema.get("additionalProperties", True) is not True:
        fields = F.try_variant_get(value, "$", "map<string, variant>")
        out.append(F.when(kind.startswith("OBJECT<"), _bound(fields, lambda m: _first(_fields(m, schema, at)))))
    if any(k in schema for k in ("items", "prefixItems", "minItems", "maxItems")):
        items = F.try_variant_get(value, "$", "array<variant>")
        out.append(F.when(kind.startswith("ARRAY<"), _bound(items, lambda a: _first(_items(a, schema, at)))))
    return out


def _fields(fields: Column, schema: dict, at: Column) -> list[Column]:
    out = [F.when(~F.map_contains_key(fields, name), F.concat(at, F.lit(f": {name} is required"))) for name in schema.get("required", ())]
    known, extra = schema.get("properties", {}), schema.get("additionalProperties", True)
    if known or extra is not True:

        def one(name: Column) -> Column:
            here = F.concat(at, F.lit("."), name)
            found = None
            for k, s in known.items():
                check = _bound(F.element_at(fields, name), _checker(s, here))
                found = F.when(name == k, check) if found is None else found.when(name == k, check)
            rest = _bound(F.element_at(fields, name), _checker(extra, here))
            return rest if found is None else found.otherwise(rest)

        names = F.array_sort(F.map_keys(fields))
        out.append(F.get(F.filter(F.transform(names, one), lambda x: x.isNotNull()), F.lit(0)))
    return out


def _checker(schema: dict | bool, at: Column) -> Callable[[Column], Column]:
    def check(value: Column) -> Column:
        return _check(value, schema, at)

    return check


def _items(items: Column, schema: dict, at: Column) -> list[Column]:
    size = F.size(items)
    out = []
    if "minItems" in schema:
        out.append(F.when(size < schema["minItems"], F.concat(at, F.lit(": too few items"))))
    if "maxItems" in schema:
        out.append(F.when(size > schema["maxItems"], F.concat(at, F.lit(": too many items"))))
    first, rest = schema.get("prefixItems", []), schema.get("items", True)
    if first or rest is not True:

        def one(x: Column, i: Column) -> Column:
            here = F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))
            found = None
            for k, s in enumerate(first):
                found = F.when(i == k, _check(x, s, here)) if found is None else found.when(i == k, _check(x, s, here))
            last = _check(x, rest, here)
            return last if found is None else found.otherwise(last)

        out.append(F.get(F.filter(F.transform(items, one), lambda x: x.isNotNull()), F.lit(0)))
    return out


def compiled(schema: dict | bool) -> Callable[[Column], Column]:
    """A function of a VARIANT column that gives its first violation, null if there is none.

    Raises SchemaError for a malformed schema, NotCompiled for one that needs the general validator.
    """
    check_schema(schema)
    _check(F.lit(None), schema, F.lit("$"))  # raises here, not inside a plan
    return lambda value: _bound(value, lambda x: _check(x, schema, F.lit("$")))


__all__ = ["NotCompiled", "SchemaError", "compiled"]
