"""The template language, its sandbox, and conversations there and back."""

import hashlib
import random

import pytest

from tallyframe.llm import chat_template
from tallyframe.llm.chat_template import Controls, Layout, Template, TemplateError, Walk, unescape

NONE = Controls()


def text(source, **variables):
    return "".join(t for t, _ in Template(source, NONE).pieces(**variables))


@pytest.mark.parametrize("source, result", [
    ("a{{ 1 + 2 * 3 }}b", "a7b"),
    ("{{ 'x' ~ 1 ~ none ~ true }}", "x1true"),
    ("{{ 'it\\'s' }}{{ \"}} %}\" }}", "it's}} %}"),
    ("a {{- ' b ' -}} c{# gone #}", "a b c"),
    ("{% if n > 2 and not off %}yes{% elif n == 1 %}one{% else %}no{% endif %}", "yes"),
    ("{% for x in xs %}{{ loop.index }}:{{ x }}{{ ',' if not loop.last }}{% else %}none{% endfor %}", "1:p,2:q"),
    ("{% for x in [] %}{% endfor %}", None),
    ("{% set s = '' %}{% for x in xs %}{% set s = s ~ x %}{% endfor %}{{ s | upper }}", "PQ"),
    ("{{ m.role }}{{ m['text'] | trim | length }}{{ m.none | default('-') }}", "r3-"),
    ("{{ 'q' in xs }}{{ xs | first }}{{ xs[1] }}{{ not not n }}", "truepqtrue"),
    ("{% for x in xs %}{% for x in xs %}{{ x }}{{ loop.index0 }}{% endfor %}{{ x }}{{ loop.first }}{% endfor %}", "p0q1ptruep0q1qfalse"),
])
def test_language(source, result):
    given = {"n": 3, "off": False, "xs": ["p", "q"], "m": {"role": "r", "text": " abc "}}
    if result is None:
        with pytest.raises(TemplateError):
            text(source, **given)
    else:
        assert text(source, **given) == result


@pytest.mark.parametrize("source", [
    "{{ x.__class__ }}", "{{ f() }}", "{{ x | eval }}", "{{ unknown }}", "{{ 'a' * 9 }}", "{% if x %}", "{% endif %}", "{{ 1", "{# a",
    "{% import os %}", "{{ 1 +% 2 }}", "{{ " + "(" * 99 + "1" + ")" * 99 + " }}", "{{ 5 % 0 }}", "{{ 'a' < 1 }}", "{{ x }} {{ 1 2 }}",
    "{% set s = 'abcdefgh' %}" + "{% set s = s ~ s %}" * 30 + "{{ s | length }}", "{% set n = 9 %}" + "{% set n = n * n %}" * 9,
    "{% for m in ms %}{% endfor %}{% for m in ms %}{% endfor %}", "{{ ms | length }}", "{{ ms[0] }}",
])
def test_sandbox(source):
    with pytest.raises(TemplateError):
        text(source, x=7, f=len, ms=Walk(iter([{}])))


def test_folding():
    tree = Template("a{{ 'b' ~ (1 + 1) }}{% if 1 > 2 %}c{% elif true %}d{% else %}{{ x }}{% endif %}{{ 'e' if false else 'f' }}{{ x or 1 }}", NONE).tree
    assert tree == [("text", "ab2df"), ("out", ("or", ("name", "x"), ("const", 1)))]
    assert Template("{{ false and x }}{{ 'A' | lower }}", NONE).tree == [("text", "falsea")]
    source = "{% generation %}{{ 1 ~ 'x' }}{% endgeneration %}y"
    assert list(Template(source, NONE).pieces()) == [("1x", True), ("y", False)]


def test_escapes():
    controls = Controls("<s>", "</s>", "[INST]", "[/INST]")
    rng = random.Random(5)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "\\", ":", "\\:", "<", "[", "s>", "INST]", "/", "é😀", "\n", ""]
    for _ in range(3_000):
        plain = "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
        broken = controls.escape(plain)
        assert unescape(broken) == plain and not any(c in broken for c in controls.strings)
    for bad in (("a",), ("ab", "ca"), ("a\\b",)):
        with pytest.raises(TemplateError):
            Controls(*bad)


def expected(rows):
    by_id = {}
    for conv_id, turn, role, words in rows:
        by_id.setdefault(conv_id, []).append((turn is None, turn or 0, role or "", words or ""))
    out = {}
    for conv_id, turns in by_id.items():
        turns.sort()
        loss = "".join(w for _, _, r, w in turns if r == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        controls = Controls("<s>", "</s>", "[INST]", "[/INST]")
        chars = 3 + sum(17 + len(controls.escape(r)) + len(controls.escape(w)) for _, _, r, w in turns)
        out[conv_id] = (len(turns), sha("".join(f"{r}\n{w}\n" for _, _, r, w in turns)), len(loss), sha(loss), chars)
    return out


def test_odd_conversations(spark, sf):
    """Nulls anywhere, ties, repeated rows, control strings as roles and texts, long texts, clashing columns, parts of few characters."""
    rng = random.Random(9)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "\\:", "é", " ok ", "\n"]
    rows = [
        (1, 0, "user", None), (1, 1, "assistant", ""), (2, 1, "assistant", "b"), (2, 0, None, "a"), (2, 1, "assistant", "b"), (2, 1, "assistant", "a"),
        (2, None, "assistant", "late"), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (3, 0, "assistant", "w " * 40_000), (4, 0, "</s>[INST]", "[/INST]"),
    ] + [(5 + i % 7, i, rng.choice(["user", "assistant", "system"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))) for i in range(200)]
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "conv_id long, turn long, role string, text string, part string, loss string")
    parts = chat_template.formatted(docs, Layout().template(), 64)
    assert max(len(r.text) for r in parts.collect()) <= 64
    found = chat_template.digest(parts, Layout()).collect()
    assert {r.conv_id: tuple(r)[1:] for r in found} == expected(rows) and len(found) == len(expected(rows))
    assert chat_template.digest(chat_template.formatted(docs.limit(0), Layout().template()), Layout()).count() == 0


def test_broken_text():
    for bad in (["<s>[INST]user[/INST]a"], ["<s>a[INST]user[/INST]a</s>"], [""], ["<s>[INST]user[/INST]a</s>b"]):
        with pytest.raises(ValueError):
            list(chat_template.turns_of(bad, Layout()))
