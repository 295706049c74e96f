"""Chat templates given as text."""

import json

import pytest
from pyspark.sql import functions as F

from callgrain.functions import templates as t
from callgrain.operators import render

TOOLS = [("f", 'says "hi"', '{"type": "object"}'), ("g", "é", "{}")]
CALLS = [("f", '{"k": 1}', "x"), ("g", "{}", "y")]
CHAT = """{%- if tools %}
<sys>
{% for tool in tools %}
{{ tool | tojson }}
{% endfor %}
</sys>
{% endif %}
{% for m in messages %}
    {% if m.role == "user" %}
[{{ m.role }}] {{ m.content | trim }}
    {% elif m.tool_calls %}
[bot]{% for c in m.tool_calls %}{{ " " }}{{ c.function.name }}({{ c.function.arguments }}){% if not loop.last %},{% endif %}{% endfor %}

    {% else %}
[bot] nothing
    {% endif %}
{% endfor %}
{% if add_generation_prompt %}
[bot]{% endif %}"""


def rows(spark, tools=TOOLS, calls=CALLS, query="  what?\n"):
    return spark.createDataFrame([(1, query, tools, calls)], "id long, query string, tools array<struct<name: string, description: string, parameters: string>>, gold array<struct<name: string, arguments: string, canon: string>>")


def test_prompt_and_full_text(spark):
    r = render.prompt_completion(rows(spark), render.TextTemplate(CHAT)).first()
    tools = "".join(json.dumps({"type": "function", "function": {"name": n, "description": d, "parameters": json.loads(p)}}, ensure_ascii=False) + "\n" for n, d, p in TOOLS)
    assert r.prompt == f"<sys>\n{tools}</sys>\n[user] what?\n[bot]"
    assert r.completion == ' f({"k": 1}), g({})'
    none = render.prompt_completion(rows(spark, tools=[], calls=[]), render.TextTemplate(CHAT)).first()
    assert (none.prompt, none.completion) == ("[user] what?\n[bot]", " nothing")


def test_the_fixed_template_as_text(spark):
    text = """<|im_start|>system
{{ tools | tojson }}<|im_end|>
{% for m in messages %}
<|im_start|>{{ m.role }}
{% if m.tool_calls %}
{% for c in m.tool_calls %}
<tool_call>
{"name": {{ c.function.name | tojson }}, "arguments": {{ c.function.arguments }}}
</tool_call>{% if not loop.last %}

{% endif %}{% endfor %}<|im_end|>
{% else %}
{{ m.content }}<|im_end|>
{% endif %}
{% endfor %}
{% if add_generation_prompt %}
<|im_start|>assistant
{% endif %}"""
    a = render.prompt_completion(rows(spark), render.TextTemplate(text, end="<|im_end|>")).first()
    b = render.prompt_completion(rows(spark)).first()
    assert (a.prompt, a.completion) == (b.prompt, b.completion)


def shown(spark, text, **env):
    return spark.range(1).select(t.compiled(text)(env).alias("t")).first().t


def test_language(spark):
    env = {"a": t.Text(F.lit("x")), "e": t.Text(F.lit("")), "n": t.Text(F.lit(None).cast("string")), "yes": t.Flag(F.lit(True)), "xs": t.List(F.array(F.lit("p"), F.lit("q"), F.lit("r")), t.Text), "o": {"k": t.Json(F.lit("[1]")), "s": t.Text(F.lit('"'))}}
    say = lambda text: shown(spark, text, **env)
    assert say("plain } { %") == "plain } { %"
    assert say("{{ a }}{{ e }}{{ n }}{{ 'lit' }}") == "xlit"
    assert say("{% for x in xs %}{{ loop.index0 }}{{ x }}{% if loop.first %}!{% endif %}{% if not loop.last %}, {% endif %}{% endfor %}") == "0p!, 1q, 2r"
    assert say("{% for x in xs %}{% for y in xs %}{% if x == y %}{{ x }}{{ y }}{% endif %}{% endfor %}{% endfor %}") == "ppqqrr"
    assert say("{{ o | tojson }}{{ xs | tojson }}{{ yes | tojson }}{{ o.s | tojson }}") == '{"k": [1], "s": "\\""}["p", "q", "r"]true"\\""'
    assert say("{% if e or n %}1{% elif a != 'x' and yes %}2{% elif not e %}3{% else %}4{% endif %}") == "3"
    assert say("a \n {%- if yes -%} \n b \n {%- endif -%} \n c") == "abc"
    assert say("a\n  {% if yes %}\nb\n  {% endif %}\nc") == "a\nb\nc"


@pytest.mark.parametrize("text", ["{{ a", "{% if a %}", "{% endfor %}", "{{ nope }}", "{{ a | upper }}", "{% set x = 1 %}", "{{ xs }}", "{% for x in a %}{% endfor %}", "{{ a + a }}", "{{ o.nope }}", "{% if xs == a %}{% endif %}", "{{ xs | trim }}", "{{ }}", "{% for x in xs %}{% else %}{% endfor %}"])
def test_what_is_no_template(spark, text):
    with pytest.raises(t.TemplateError):
        shown(spark, text, a=t.Text(F.lit("x")), xs=t.List(F.array(F.lit("p")), t.Text), o={"k": t.Text(F.lit(""))})


def test_a_prompt_that_is_no_prefix_fails(spark):
    bad = "{% if add_generation_prompt %}A{% else %}B{% endif %}"
    with pytest.raises(Exception, match="does not begin with its prompt"):
        render.prompt_completion(rows(spark), render.TextTemplate(bad)).collect()
