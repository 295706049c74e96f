"""Pure functions: type expressions, exact JSON, the schema validator, reading outputs."""

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from callgrain.functions.json_schema import SchemaError, check_schema, violation
from callgrain.functions.jsonkit import canonical, leading_objects
from callgrain.functions.type_exprs import object_schema, to_schema, without_modifiers
from callgrain.operators.normalize import normalised
from callgrain.operators.parse import read_calls, read_gold
from callgrain.operators.verify import verdict

JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(), x, max_size=4), max_leaves=12)


PLAIN_NAMES = {"str": "string", "int": "integer", "float": "number", "bool": "boolean"}


@st.composite
def typed(draw, depth=3):
    """A type expression with random spacing and case of heads, beside its schema."""
    pad = lambda x: draw(st.sampled_from(["", " ", "\t"])) + x + draw(st.sampled_from(["", "  "]))
    kind = draw(st.sampled_from(["plain", "list", "tuple", "union", "callable"] if depth else ["plain"]))
    if kind == "plain":
        name = draw(st.sampled_from(sorted(PLAIN_NAMES)))
        return pad(name), {"type": PLAIN_NAMES[name]}
    head = draw(st.sampled_from([kind.upper(), kind.title(), kind]))
    inner = [draw(typed(depth - 1)) for _ in range(1 if kind == "list" else draw(st.integers(1, 3)))]
    text, schemas = pad(head) + "[" + ",".join(t for t, _ in inner) + "]", [x for _, x in inner]
    match kind:
        case "list":
            return text, {"type": "array", "items": schemas[0]}
        case "tuple":
            return text, {"type": "array", "prefixItems": schemas, "minItems": len(schemas), "maxItems": len(schemas)}
        case "union":
            return text, {"anyOf": schemas}
    return text, {}


@given(typed())
def test_to_schema_of_any_expression(x):
    text, schema = x
    assert to_schema(text) == schema
    assert json.dumps(to_schema(text)) == json.dumps(schema)  # key order too


@given(typed(), st.lists(st.sampled_from(["optional", "default=[1, 2]", "default", "Optional", "kept", " optional"]), max_size=3))
def test_modifiers_of_any_expression(x, modifiers):
    text, schema = x
    expr, optional = without_modifiers(",".join([text, *modifiers]))
    assert expr == text.strip() and to_schema(expr) == schema
    assert optional == any(m.strip() == "optional" or m.startswith("default") for m in modifiers)


@given(typed(), st.sampled_from([("[", ValueError), ("]", KeyError)]))
def test_brackets_out_of_balance(x, how):
    bracket, error = how
    if "[" not in x[0]:
        with pytest.raises(error):
            to_schema(x[0] + bracket)


@pytest.mark.parametrize(
    ("text", "error"),
    [("bytes", KeyError), ("Str", KeyError), ("   ", KeyError), ("List[float, bool]", KeyError), ("Tuple[]", KeyError), ("List[bool]]", KeyError), ("FrozenSet[int]", NotImplementedError), ("List[Deque[int]]", NotImplementedError), ("List[int, List[int]]", NotImplementedError), ("List[int][int]", NotImplementedError), ("Union[str, List[float]", ValueError)],
)
def test_to_schema_errors(text, error):
    with pytest.raises(error):
        to_schema(text)


def test_odd_texts():
    assert [without_modifiers(x)[0] for x in ("", "bool,", "], int", "Union[str, int], x, y")] == ["", "bool", "], int", "Union[str, int]"]
    assert to_schema("Tuple[bool] of flags") == {"type": "array", "prefixItems": [{"type": "boolean"}], "minItems": 1, "maxItems": 1}
    assert to_schema("List[List[bool], str]") == {"type": "array", "items": {"type": "array", "items": {"type": "boolean"}}}


def test_table_is_not_shared():
    to_schema("str")["extra"] = 1
    assert to_schema("str") == {"type": "string"}


def test_object_schema():
    got = object_schema({"a": {"type": "int", "description": "x"}, "b": {"type": "str", "description": "Defaults to x"}, "c": {"type": "str", "description": "", "default": None}})
    assert list(got["properties"]["a"]) == ["description", "type"]
    assert got["required"] == ["a"]
    assert object_schema({}) == {"type": "object", "properties": {}, "required": []}


@given(JSON)
def test_canonical_is_stable(x):
    assert canonical(json.loads(json.dumps(x))) == canonical(x)


def test_canonical_folds_numbers():
    assert canonical({"b": 1, "a": True}) == canonical({"a": 1.0, "b": 1.0})
    assert canonical([1.5]) != canonical([1])
    assert canonical("1") != canonical(1)


OBJECTS = st.dictionaries(st.text(), JSON, max_size=4)


@given(st.text().filter(lambda t: "{" not in t), st.lists(OBJECTS, min_size=1, max_size=4), st.sampled_from(["", " ", "\n\t"]), st.sampled_from(["", "tail", ", {}", "{", '{"open', "{'a': 1}", "}", ' {"a": "}']))
def test_leading_objects_of_any_run(before, objects, between, after):
    text = before + between.join(json.dumps(x) for x in objects) + after
    assert list(map(canonical, leading_objects(text))) == list(map(canonical, objects))


@pytest.mark.parametrize(("text", "n"), [("[{}, {}]", 1), ("{} {broken} {}", 1), ("{broken} {}", 0), ('{"a": "\\"{"} {"b": {}}', 2), ("{" * 5000, 0), ('{"' + '\\"' * 20000, 0)])
def test_leading_objects(text, n):
    assert len(leading_objects(text)) == n


@pytest.mark.parametrize(
    ("value", "schema", "ok"),
    [
        (True, {"type": "integer"}, False), (1.0, {"type": "integer"}, True), (True, {"type": "number"}, False), (None, {"type": "null"}, True),
        ([1, 1.0], {"uniqueItems": True}, False), ([1, True], {"uniqueItems": True}, True), ([1, "a"], {"prefixItems": [{"type": "integer"}, {"type": "string"}]}, True),
        ([1], {"minItems": 2}, False), ([1, 2, 3], {"maxItems": 2}, False), ("x", {"anyOf": [{"type": "integer"}, {"type": "string"}]}, True), (True, {"enum": [1]}, False), (1.0, {"enum": [1]}, True),
        ({"a": 1}, {"properties": {"a": {"type": "string"}}}, False), ({"a": 1}, {"additionalProperties": False}, False), ({"z": 1}, {"required": ["a"]}, False), ({"z": 1}, {"properties": {}}, True), ([1, "a"], {"items": {"type": "integer"}}, False),
    ],
)
def test_validator(value, schema, ok):
    check_schema(schema)
    assert (violation(value, schema) is None) is ok


@pytest.mark.parametrize("schema", [{"type": "text"}, {"required": "a"}, {"minItems": -1}, {"anyOf": []}, {"pattern": "x"}, 3, {"properties": {"a": {"type": 1}}}])
def test_malformed_schemas(schema):
    with pytest.raises(SchemaError):
        check_schema(schema)


def test_verdicts():
    spec = '{"type": "object", "properties": {"a": {"type": "string"}}, "required": ["a"]}'
    assert verdict(None, "{}")[0] == "UNKNOWN_TOOL"
    assert verdict(spec, '{"a": "x"}') == ("VALID", None)
    assert verdict(spec, "{}")[0] == "SCHEMA_VIOLATION"
    assert verdict('{"type": "nope"}', "{}")[0] == "MALFORMED_SPEC"


def block(x):
    return f"<tool_call>\n{x}\n</tool_call>"


GOOD = '{"name": "f", "arguments": {"a": 1}}'


@pytest.mark.parametrize(
    ("found", "text", "want"),
    [
        ([GOOD], "", (1, True, True)), ([], GOOD, (1, True, False)), ([], GOOD + " junk", (1, True, False)), ([], "words", (0, False, False)), (["{bad}"], "", (0, False, True)),
        ([GOOD, '{"name": 7, "arguments": {}}'], "", (1, False, True)), (['{"name": "f", "arguments": []}'], "", (0, False, True)), (['{"name": "f"}'], "", (0, False, True)), ([GOOD + "\n<tool_call>\n" + GOOD], "", (0, False, True)),
        ([], '{"name": "f", "arguments": null}', (0, False, False)), ([], GOOD + GOOD, (2, True, False)),
    ],
)
def test_read_calls(found, text, want):
    got = read_calls(found, text)
    assert (len(got["calls"]), got["emits_json"], got["wrapped"]) == want


def test_read_gold_rejects_unknown_keys():
    row = {"messages": [{}, {"tool_calls": [{"function": {"name": "f", "arguments": {}}}]}], "tools": [{"function": {"name": "f", "description": "", "parameters": {}, "x": 1}}]}
    with pytest.raises(ValueError):
        read_gold(json.dumps(row))
    del row["tools"][0]["function"]["x"]
    assert read_gold(json.dumps(row))["gold"][0]["name"] == "f"


@pytest.mark.parametrize(
    ("tools", "answers", "error"),
    [("[", "[]", "JSONDecodeError"), ('[{"name": "a", "description": "", "parameters": {"x": {"type": "List[int", "description": ""}}}]', "[]", "ValueError"), ('[{"name": "a"}]', "[]", "KeyError"), ("[]", '[{"name": 1, "arguments": {}}]', "ValueError"), ("[]", "[]", None)],
)
def test_normalise_errors(tools, answers, error):
    assert normalised(tools, answers)["error"] == error
