"""Chat templates given as text, compiled to one column expression.

The part of the usual template language that chat templates need: ``{{ value }}``,
``{% for x in list %}`` with ``loop.first``, ``loop.last`` and ``loop.index0``, ``{% if %}`` with
``elif`` and ``else``, the filters ``tojson`` and ``trim``, ``==``, ``!=``, ``not``, ``and``, ``or`` and
string literals.  A line end after a block tag and blanks before one that begins a line are no
text; ``-`` inside a tag takes all white space on its side away.  Anything else is an error when
the template is compiled, never a silent difference.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class TemplateError(ValueError):
    """The template is malformed, or uses what is not supported."""


@dataclass(frozen=True)
class Text:
    """A string column."""

    column: Column


@dataclass(frozen=True)
class Json(Text):
    """A column of JSON text; ``tojson`` leaves it as it is."""


@dataclass(frozen=True)
class Flag:
    column: Column


@dataclass(frozen=True)
class List:
    """An array column, and what its elements are."""

    column: Column
    item: Callable[[Column], object]


def quoted(text: Column) -> Column:
    """JSON text of a string."""
    one = F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("s")))
    return F.substring(one, 6, F.length(one) - 6)


def to_json(value: object) -> Column:
    """JSON text of a value; objects are dicts of values, in order."""
    if isinstance(value, Json):
        return value.column
    if isinstance(value, Text):
        return quoted(value.column)
    if isinstance(value, Flag):
        return F.when(truth(value), "true").otherwise("false")
    if isinstance(value, List):
        return F.concat(F.lit("["), F.array_join(F.transform(value.column, lambda x: to_json(value.item(x))), ", "), F.lit("]"))
    parts = [p for i, (k, v) in enumerate(value.items()) for p in (F.lit(f'{", " if i else ""}"{k}": '), to_json(v))]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def truth(value: object) -> Column:
    """Whether a value counts as true: a flag that is set, a text or list that is not empty."""
    if isinstance(value, Flag):
        return F.coalesce(value.column, F.lit(False))
    if isinstance(value, List):
        return F.coalesce(F.size(value.column) > 0, F.lit(False))
    if isinstance(value, Text):
        return F.coalesce(value.column != "", F.lit(False))
    return F.lit(bool(value))


_TAG = re.compile(r"\{(\{|%)(-?)\s*(.*?)\s*(-?)(?:\}|%)\}", re.S)
_WORD = re.compile(r"""\s*("[^"]*"|'[^']*'|==|!=|\||\.|[A-Za-z_]\w*)""")


def _tags(text: str):
    """Pieces of a template: ``("text", s)``, ``("out", expression)``, ``("block", statement)``."""
    at, strip, after_block = 0, False, False
    for m in [*_TAG.finditer(text), None]:
        piece = text[at : m.start() if m else len(text)]
        if after_block and not strip:
            piece = piece.removeprefix("\n")
        if strip:
            piece = piece.lstrip()
        if m and m[1] == "%" and not m[2]:
            head, _, line = piece.rpartition("\n")
            if not line.strip(" \t") and ("\n" in piece or at == 0 or after_block):
                piece = piece[: len(piece) - len(line)]
        if m and m[2]:
            piece = piece.rstrip()
        if "{%" in piece or "{{" in piece:
            raise TemplateError(f"a tag that does not end: {piece!r}")
        if piece:
            yield "text", piece
        if m:
            yield ("out" if m[1] == "{" else "block"), m[3]
            at, strip, after_block = m.end(), bool(m[4]), m[1] == "%"


def _words(text: str) -> list[str]:
    out, at = [], 0
    while at < len(text.rstrip()):
        m = _WORD.match(text, at)
        if not m:
            raise TemplateError(f"not understood: {text!r}")
        out.append(m[1])
        at = m.end()
    return out


def _expression(words: list[str]) -> Callable[[dict], object]:
    """``or`` of ``and`` of ``not`` of comparisons of values with filters."""

    def split(ws: list[str], by: str) -> list[list[str]]:
        parts = [[]]
        for w in ws:
            parts.append([]) if w == by else parts[-1].append(w)
        return parts

    for by, use in (("or", lambda a, b: a | b), ("and", lambda a, b: a & b)):
        if len(parts := split(words, by)) > 1:
            each = [_expression(p) for p in parts]

            def joined(env, each=each, use=use):
                out = truth(each[0](env))
                for e in each[1:]:
                    out = use(out, truth(e(env)))
                return Flag(out)

            return joined
    if words[:1] == ["not"]:
        inner = _expression(words[1:])
        return lambda env: Flag(~truth(inner(env)))
    for sign in ("==", "!="):
        if len(parts := split(words, sign)) == 2:
            a, b = map(_expression, parts)

            def compared(env, a=a, b=b, same=sign == "=="):
                x, y = a(env), b(env)
                if not (isinstance(x, Text) and isinstance(y, Text)):
                    raise TemplateError("only texts are compared")
                equal = F.coalesce(x.column == y.column, F.lit(False))
                return Flag(equal if same else ~equal)

            return compared
    return _value(words)


def _value(words: list[str]) -> Callable[[dict], object]:
    if not words:
        raise TemplateError("a value is missing")
    first, rest = words[0], words[1:]
    path, filters = [], []
    while rest:
        if len(rest) < 2 or rest[0] not in (".", "|") or not rest[1].isidentifier() or (rest[0] == "." and filters):
            raise TemplateError(f"not understood: {' '.join(words)}")
        (path if rest[0] == "." else filters).append(rest[1])
        rest = rest[2:]
    if unknown := set(filters) - {"tojson", "trim"}:
        raise TemplateError(f"unknown filters {sorted(unknown)}")

    def value(env: dict) -> object:
        if first[0] in "\"'":
            out = Text(F.lit(first[1:-1]))
        else:
            out = env.get(first)
            for name in path:
                out = out.get(name) if isinstance(out, dict) else None
            if out is None:
                raise TemplateError(f"no value {'.'.join([first, *path])}")
        for f in filters:
            if f == "trim" and not isinstance(out, Text):
                raise TemplateError("only a text is trimmed")
            out = Json(to_json(out)) if f == "tojson" else Text(F.regexp_replace(out.column, r"^\s+|\s+$", ""))
        return out

    return value


def _body(tags, ends: tuple[str, ...]):
    """Parts up to one of the statements ``ends``, and that statement."""
    parts = []
    for kind, said in tags:
        if kind == "text":
            parts.append(lambda env, said=said: F.lit(said))
            continue
        words = _words(said)
        if kind == "out":
            parts.append(_shown(_expression(words)))
        elif words and words[0] in ends:
            return parts, words
        elif words[:1] == ["for"] and len(words) > 3 and words[2] == "in":
            body, _ = _body(tags, ("endfor",))
            parts.append(_loop(words[1], _expression(words[3:]), body))
        elif words[:1] == ["if"]:
            parts.append(_choice(tags, words))
        else:
            raise TemplateError(f"not understood: {said!r}")
    if ends:
        raise TemplateError(f"{ends[-1]} is missing")
    return parts, None


def _shown(value):
    def shown(env):
        x = value(env)
        if not isinstance(x, Text):
            raise TemplateError("only a text is shown; use tojson")
        return F.coalesce(x.column, F.lit(""))

    return shown


def _joined(parts, env) -> Column:
    return F.concat(F.lit(""), *[p(env) for p in parts])


def _loop(name: str, items, body):
    def loop(env):
        xs = items(env)
        if not isinstance(xs, List):
            raise TemplateError("a loop needs a list")
        last = F.size(xs.column) - 1

        def one(x: Column, i: Column) -> Column:
            place = {"first": Flag(i == 0), "last": Flag(i == last), "index0": Text(i.cast("string"))}
            return _joined(body, {**env, name: xs.item(x), "loop": place})

        return F.coalesce(F.array_join(F.transform(xs.column, one), ""), F.lit(""))

    return loop


def _choice(tags, words: list[str]):
    cases, other = [], []
    while words[0] in ("if", "elif"):
        test = _expression(words[1:])
        body, words = _body(tags, ("elif", "else", "endif"))
        cases.append((test, body))
    if words[0] == "else":
        other, _ = _body(tags, ("endif",))

    def choice(env):
        out = _joined(other, env)
        for test, body in reversed(cases):
            out = F.when(truth(test(env)), _joined(body, env)).otherwise(out)
        return out

    return choice


def compiled(text: str) -> Callable[[dict], Column]:
    """A function from named values to the rendered text."""
    parts, _ = _body(iter(_tags(text)), ())
    return lambda env: _joined(parts, env)
