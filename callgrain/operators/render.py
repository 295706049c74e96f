"""Conversations to training examples: messages, tools, prompt and completion (native JSON text)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgrain.functions import templates
from callgrain.functions.templates import quoted


def listed(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def tool_definitions(tools: Column) -> Column:
    """JSON array of function definitions in registry order; schemas are passed through as text."""
    one = lambda t: F.concat(F.lit('{"type": "function", "function": {"name": '), quoted(t["name"]), F.lit(', "description": '), quoted(t["description"]), F.lit(', "parameters": '), t["parameters"], F.lit("}}"))
    return listed(F.transform(tools, one))


def call_messages(query: Column, gold: Column) -> Column:
    """JSON array of a user turn and one assistant turn that holds all calls, in order."""
    one = lambda c: F.concat(F.lit('{"type": "function", "function": {"name": '), quoted(c["name"]), F.lit(', "arguments": '), c["arguments"], F.lit("}}"))
    return F.concat(F.lit('[{"role": "user", "content": '), quoted(query), F.lit('}, {"role": "assistant", "tool_calls": '), listed(F.transform(gold, one)), F.lit("}]"))


def example(query: Column, tools: Column, gold: Column) -> Column:
    """One exported example as JSON text."""
    return F.concat(F.lit('{"messages": '), call_messages(query, gold), F.lit(', "tools": '), tool_definitions(tools), F.lit("}"))


@dataclass(frozen=True)
class Template:
    """A chat template of fixed marks around turns; tools go into the first turn."""

    turn: str = "<|im_start|>"
    end: str = "<|im_end|>"

    def prompt(self, query: Column, tools: Column) -> Column:
        head = F.concat(F.lit(f"{self.turn}system\n"), tool_definitions(tools), F.lit(f"{self.end}\n"))
        return F.concat(head, F.lit(f"{self.turn}user\n"), query, F.lit(f"{self.end}\n{self.turn}assistant\n"))

    def full(self, query: Column, tools: Column, gold: Column) -> Column:
        one = lambda c: F.concat(F.lit('<tool_call>\n{"name": '), quoted(c["name"]), F.lit(', "arguments": '), c["arguments"], F.lit("}\n</tool_call>"))
        return F.concat(self.prompt(query, tools), F.array_join(F.transform(gold, one), "\n"), F.lit(f"{self.end}\n"))


class TextTemplate:
    """A chat template given as text, over ``messages``, ``tools`` and ``add_generation_prompt``.

    Messages have ``role``, ``content`` and ``tool_calls``, whose ``function`` has ``name`` and ``arguments``;
    tools are function definitions.  The prompt renders the user's turn with the flag set, the
    full text both turns without it; what one begins with has to be the other.
    """

    def __init__(self, text: str, end: str = ""):
        self.render, self.end = templates.compiled(text), end

    def _messages(self, query: Column, gold: Column | None) -> templates.List:
        calls = F.lit(None).cast("array<struct<name: string, arguments: string>>")
        turn = lambda role, content, tool_calls: F.struct(F.lit(role).alias("role"), content.alias("content"), tool_calls.alias("tool_calls"))
        turns = [turn("user", query, calls)]
        if gold is not None:
            own = F.transform(gold, lambda c: F.struct(c["name"].alias("name"), c["arguments"].alias("arguments")))
            turns.append(turn("assistant", F.lit(""), own))
        function = lambda c: {"type": templates.Text(F.lit("function")), "function": {"name": templates.Text(c["name"]), "arguments": templates.Json(c["arguments"])}}
        return templates.List(F.array(*turns), lambda m: {"role": templates.Text(m["role"]), "content": templates.Text(m["content"]), "tool_calls": templates.List(m["tool_calls"], function)})

    def _text(self, query: Column, tools: Column, gold: Column | None) -> Column:
        define = lambda t: {"type": templates.Text(F.lit("function")), "function": {"name": templates.Text(t["name"]), "description": templates.Text(t["description"]), "parameters": templates.Json(t["parameters"])}}
        return self.render({"messages": self._messages(query, gold), "tools": templates.List(tools, define), "add_generation_prompt": templates.Flag(F.lit(gold is None))})

    def prompt(self, query: Column, tools: Column) -> Column:
        return self._text(query, tools, None)

    def full(self, query: Column, tools: Column, gold: Column) -> Column:
        text = self._text(query, tools, gold)
        wrong = F.raise_error(F.lit("the template's full text does not begin with its prompt")).cast("string")
        return F.when(F.startswith(text, self.prompt(query, tools)), text).otherwise(wrong)


def without_suffix(text: Column, suffix: str) -> Column:
    """``text`` without one suffix."""
    return F.when(F.endswith(text, F.lit(suffix)), F.substring(text, F.lit(1), F.length(text) - len(suffix))).otherwise(text)


def prompt_completion(rows: DataFrame, template: Template | TextTemplate | None = None) -> DataFrame:
    """``prompt, completion`` added: the full render cut after the prompt, without the closing mark."""
    t = template or Template()
    prompt, full = t.prompt(F.col("query"), F.col("tools")), t.full(F.col("query"), F.col("tools"), F.col("gold"))
    cut = F.substring(full, F.length(prompt) + 1, F.length(full))
    return rows.withColumns({"prompt": prompt, "completion": without_suffix(without_suffix(cut, "\n"), t.end)})


def kept_labels(ids: Column, labels: Column, ignore: int = -100) -> Column:
    """Ids whose label is not masked."""
    pairs = F.filter(F.arrays_zip(ids.alias("id"), labels.alias("label")), lambda x: x["label"] != ignore)
    return F.transform(pairs, lambda x: x["id"])
