"""Chat formatting: a small sandboxed template language, compiled to Python closures, over streams of turns.

A template is cut into text, ``{{ expression }}``, ``{% tag %}`` and ``{# remark #}`` (a dash inside a mark
strips the white space beside it), parsed to a syntax tree, constants in the tree are folded, and what is
left becomes closures that yield pieces of output with a flag: whether a piece stands between
``{% generation %}`` and ``{% endgeneration %}``, that is, under the loss mask.

Tags: for/else/endfor, if/elif/else/endif, set, generation/endgeneration. Expressions: strings, whole
numbers, true, false, none, names, fields (``m.role``, ``m['role']``), ``+ - * % ~``, comparisons, ``in``,
``and or not``, ``a if c else b``, and the filters of FILTERS and ``escape``. The sandbox has no calls, no
attributes of Python objects and no imports; strings and numbers it builds have a largest size, and the
messages of a stream are walked once, turn by turn, with ``loop.first``, ``loop.last``, ``loop.index`` and
``loop.index0``, so that a conversation is never held as a whole.

Control strings inside values are broken by ``escape`` and mended by ``unescape``: every backslash is
doubled, and after the first character of every control string comes ``\\:``. No control string holds
a backslash or any control string's first character past its own start, so neither an escaped value nor
its seams with the template's own marks can spell one.
"""

from __future__ import annotations

import hashlib
import operator
import re
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longest string and largest number that a template may build, deepest nesting.
LARGEST_STRING, LARGEST_NUMBER, DEEPEST = 1 << 26, 1 << 62, 60
#: Code points in a part of a formatted conversation, at most.
PART = 1 << 20


class TemplateError(ValueError):
    """A template that cannot be read, or does what the sandbox forbids."""


class Controls:
    """Strings with a meaning of their own in formatted text."""

    def __init__(self, *strings: str):
        if any(len(s) < 2 or "\\" in s or ":" in s or any(c in s[1:] for c in {t[0] for t in strings}) for s in strings):
            raise TemplateError("control strings have two characters or more, no backslash or colon, and their first ones nowhere else")
        self.strings = strings
        self._starts = re.compile("|".join(f"{re.escape(s[0])}(?={re.escape(s[1:])})" for s in strings) or "(?!)")

    def escape(self, text: str) -> str:
        text = text.replace("\\", "\\\\")
        return self._starts.sub(lambda m: m.group() + "\\:", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\|:)", lambda m: "\\" if m.group(1) == "\\" else "", text) if "\\" in text else text


# --- reading a template

_OPEN = re.compile(r"\{\{-?|\{%-?|\{#")
_TOKEN = re.compile(
    r"\s*(?:(?P<close>-?(?:\}\}|%\}))|(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)"
    r"|(?P<op>==|!=|<=|>=|[-+*%~|.\[\](),<>=]))",
    re.S,
)
_LETTERS = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}


def tokens(source: str) -> list[tuple]:
    """("text", s), ("out", tokens) and ("tag", tokens) of a template; an inner token is (kind, value)."""
    out, at, strip = [], 0, False
    while at < len(source):
        mark = _OPEN.search(source, at)
        text = source[at : mark.start() if mark else len(source)]
        text = text.lstrip() if strip else text
        text = text.rstrip() if mark and mark.group().endswith("-") else text
        if text:
            out.append(("text", text))
        if not mark:
            break
        at, strip = mark.end(), False
        if mark.group() == "{#":
            at = source.find("#}", at) + 2
            if at < 2:
                raise TemplateError("a remark has no end")
            continue
        inner, close = [], "}}" if mark.group()[1] == "{" else "%}"
        while True:
            token = _TOKEN.match(source, at)
            if not token:
                raise TemplateError(f"cannot read {source[at : at + 20]!r}")
            at, kind, value = token.end(), token.lastgroup, token.group(token.lastgroup)
            if kind == "close":
                if not value.endswith(close):
                    raise TemplateError(f"{value!r} where {close!r} is due")
                strip = value.startswith("-")
                break
            if kind == "string":
                value = re.sub(r"\\(.)", lambda m: _LETTERS.get(m.group(1), m.group()), value[1:-1], flags=re.S)
            inner.append((kind, int(value) if kind == "number" else value))
        out.append(("out" if close == "}}" else "tag", inner))
    return out


class Expressions:
    """Recursive descent over the tokens of one expression or tag."""

    def __init__(self, inner: list[tuple]):
        self.inner, self.at, self.depth = inner, 0, 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.inner) and self.inner[self.at][0] in ("op", "name") and self.inner[self.at][1] in values

    def take(self, *values: str):
        if self.peek(*values):
            self.at += 1
            return self.inner[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is due in {self.inner}")

    def name(self) -> str:
        if self.at < len(self.inner) and self.inner[self.at][0] == "name":
            self.at += 1
            return self.inner[self.at - 1][1]
        raise TemplateError(f"a name is due in {self.inner}")

    def end(self) -> None:
        if self.at < len(self.inner):
            raise TemplateError(f"too much in {self.inner}")

    def expression(self) -> tuple:
        self.depth += 1
        if self.depth > DEEPEST:
            raise TemplateError("an expression is nested too deep")
        value = self.either()
        if self.take("if"):
            condition = self.either()
            other = self.expression() if self.take("else") else ("const", "")
            value = ("choose", condition, value, other)
        self.depth -= 1
        return value

    def either(self) -> tuple:
        value = self.both()
        while self.take("or"):
            value = ("or", value, self.both())
        return value

    def both(self) -> tuple:
        value = self.negated()
        while self.take("and"):
            value = ("and", value, self.negated())
        return value

    def negated(self) -> tuple:
        turns = 0
        while self.take("not"):
            turns += 1
        value = self.compared()
        return ("not", ("not", value) if turns % 2 == 0 else value) if turns else value

    def compared(self) -> tuple:
        value = self.summed()
        while sign := self.take("==", "!=", "<=", ">=", "<", ">", "in"):
            value = ("op", sign, value, self.summed())
        return value

    def summed(self) -> tuple:
        value = self.multiplied()
        while sign := self.take("+", "-", "~"):
            value = ("op", sign, value, self.multiplied())
        return value

    def multiplied(self) -> tuple:
        value = self.filtered()
        while sign := self.take("*", "%"):
            value = ("op", sign, value, self.filtered())
        return value

    def filtered(self) -> tuple:
        value = self.primary()
        while True:
            if self.take("|"):
                name, given = self.name(), []
                if self.take("("):
                    while not self.take(")"):
                        given.append(self.expression())
                        if not self.peek(")"):
                            self.need(",")
                value = ("filter", name, value, *given)
            elif self.take("."):
                value = ("get", value, ("const", self.name()))
            elif self.take("["):
                value = ("get", value, self.expression())
                self.need("]")
            else:
                return value

    def primary(self) -> tuple:
        if self.take("("):
            value = self.expression()
            self.need(")")
            return value
        if self.at >= len(self.inner):
            raise TemplateError(f"an expression ends too early in {self.inner}")
        kind, value = self.inner[self.at]
        self.at += 1
        if kind in ("string", "number"):
            return ("const", value)
        if kind == "name":
            constants = {"true": True, "false": False, "none": None}
            return ("const", constants[value]) if value in constants else ("name", value)
        raise TemplateError(f"{value!r} begins no expression")


def parse(source: str) -> list[tuple]:
    """The syntax tree of a template: a list of nodes."""
    queue = tokens(source)[::-1]

    def block(stops: tuple, depth: int) -> tuple[list, str, Expressions | None]:
        if depth > DEEPEST:
            raise TemplateError("tags are nested too deep")
        body = []
        while queue:
            kind, value = queue.pop()
            if kind == "text":
                body.append(("text", value))
                continue
            inner = Expressions(value)
            if kind == "out":
                body.append(("out", inner.expression()))
                inner.end()
                continue
            tag = inner.name()
            if tag in stops:
                return body, tag, inner
            if tag == "set":
                name = inner.name()
                inner.need("=")
                body.append(("set", name, inner.expression()))
                inner.end()
            elif tag == "for":
                name = inner.name()
                inner.need("in")
                over = inner.expression()
                inner.end()
                inside, stop, _ = block(("else", "endfor"), depth + 1)
                other = block(("endfor",), depth + 1)[0] if stop == "else" else []
                body.append(("for", name, over, inside, other))
            elif tag == "if":
                arms, other, condition, stop = [], [], inner.expression(), "elif"
                inner.end()
                while stop == "elif":
                    inside, stop, rest = block(("elif", "else", "endif"), depth + 1)
                    arms.append((condition, inside))
                    if stop == "elif":
                        condition = rest.expression()
                        rest.end()
                if stop == "else":
                    other = block(("endif",), depth + 1)[0]
                body.append(("if", arms, other))
            elif tag == "generation":
                inner.end()
                body.append(("generation", block(("endgeneration",), depth + 1)[0]))
            else:
                raise TemplateError(f"unknown or misplaced tag {tag!r}")
        if stops:
            raise TemplateError(f"one of {stops} is due at the end")
        return body, "", None

    return block((), 0)[0]


# --- meaning

_OPS = {
    "==": operator.eq, "!=": operator.ne, "<=": operator.le, ">=": operator.ge, "<": operator.lt, ">": operator.gt,
    "in": lambda a, b: a in b, "-": operator.sub, "%": operator.mod, "*": operator.mul, "+": operator.add,
    "~": lambda a, b: shown(a) + shown(b),
}
FILTERS = {
    "trim": lambda v: shown(v).strip(), "upper": lambda v: shown(v).upper(), "lower": lambda v: shown(v).lower(),
    "length": lambda v: len(v), "string": lambda v: shown(v), "default": lambda v, other: other if v is None else v,
    "first": lambda v: v[0] if v else None, "last": lambda v: v[-1] if v else None,
}


def shown(value) -> str:
    """A value as text; none is empty."""
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    raise TemplateError(f"a {type(value).__name__} has no text")


def bounded(value):
    if isinstance(value, str) and len(value) > LARGEST_STRING or isinstance(value, int) and abs(value) > LARGEST_NUMBER:
        raise TemplateError("a value grew too large")
    return value


def field(value, key):
    if isinstance(value, dict):
        return value.get(key)
    if isinstance(value, (list, tuple, str)) and isinstance(key, int) and not isinstance(key, bool):
        return value[key] if -len(value) <= key < len(value) else None
    raise TemplateError(f"a {type(value).__name__} has no field {key!r}")


def apply(sign: str, a, b):
    if sign in "+-*%" and not (isinstance(a, int) and isinstance(b, int)) and not (sign == "+" and isinstance(a, str) and isinstance(b, str)):
        raise TemplateError(f"{sign} takes two numbers")
    try:
        return bounded(_OPS[sign](a, b))
    except (TypeError, ZeroDivisionError) as error:
        raise TemplateError(str(error)) from None


def value_of(node: tuple, filters: dict):
    """A closure from the variables to the value of an expression."""
    kind = node[0]
    if kind == "const":
        return lambda scope, v=node[1]: v
    if kind == "name":

        def look(scope, name=node[1]):
            if name not in scope:
                raise TemplateError(f"nothing is named {name!r}")
            return scope[name]

        return look
    if kind == "filter":
        if node[1] not in filters:
            raise TemplateError(f"unknown filter {node[1]!r}")
        do, given = filters[node[1]], [value_of(n, filters) for n in node[2:]]

        def use(scope):
            try:
                return bounded(do(*[g(scope) for g in given]))
            except TypeError as error:
                raise TemplateError(str(error)) from None

        return use
    parts = [value_of(n, filters) for n in node[1 if kind != "op" else 2 :]]
    if kind == "get":
        return lambda scope, a=parts[0], b=parts[1]: field(a(scope), b(scope))
    if kind == "not":
        return lambda scope, a=parts[0]: not a(scope)
    if kind == "and":
        return lambda scope, a=parts[0], b=parts[1]: a(scope) and b(scope)
    if kind == "or":
        return lambda scope, a=parts[0], b=parts[1]: a(scope) or b(scope)
    if kind == "choose":
        return lambda scope, c=parts[0], a=parts[1], b=parts[2]: a(scope) if c(scope) else b(scope)
    return lambda scope, sign=node[1], a=parts[0], b=parts[1]: apply(sign, a(scope), b(scope))


def folded(node: tuple, filters: dict) -> tuple:
    """An expression with constant parts worked out; what would fail is left to fail when rendered."""
    if node[0] in ("const", "name"):
        return node
    head = 2 if node[0] in ("op", "filter") else 1
    node = node[:head] + tuple(folded(n, filters) for n in node[head:])
    if node[0] == "choose" and node[1][0] == "const":
        return node[2] if node[1][1] else node[3]
    if node[0] in ("and", "or") and node[1][0] == "const":
        return node[2] if bool(node[1][1]) == (node[0] == "and") else node[1]
    if all(n[0] == "const" for n in node[head:]):
        try:
            return ("const", value_of(node, filters)({}))
        except TemplateError:
            pass
    return node


def simplified(body: list[tuple], filters: dict) -> list[tuple]:
    """A body with constants folded, decided branches taken, and neighbouring texts joined."""
    out = []

    def add(nodes):
        for n in nodes:
            if n[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + n[1])
            elif n != ("text", ""):
                out.append(n)

    for node in body:
        if node[0] == "out":
            value = folded(node[1], filters)
            add([("text", shown(value[1])) if value[0] == "const" else ("out", value)])
        elif node[0] == "set":
            add([("set", node[1], folded(node[2], filters))])
        elif node[0] == "for":
            add([("for", node[1], folded(node[2], filters), simplified(node[3], filters), simplified(node[4], filters))])
        elif node[0] == "generation":
            add([("generation", simplified(node[1], filters))])
        elif node[0] == "if":
            arms, other = [], simplified(node[2], filters)
            for condition, inside in node[1]:
                condition, inside = folded(condition, filters), simplified(inside, filters)
                if condition[0] != "const":
                    arms.append((condition, inside))
                elif condition[1]:
                    other = inside
                    break
            add([("if", arms, other)] if arms else other)
        else:
            add([node])
    return out


def walked(values):
    """Pairs (value, what ``loop`` is for it), one value ahead of what is given out."""
    if not hasattr(values, "__iter__") or isinstance(values, (str, dict)):
        raise TemplateError("for takes a list")
    values, index = iter(values), 0
    following = next(values, values)
    while following is not values:
        value, following = following, next(values, values)
        yield value, {"first": index == 0, "last": following is values, "index": index + 1, "index0": index}
        index += 1


def renderer(body: list[tuple], filters: dict):
    """A closure from the variables and the mask to pieces (text, whether under the mask)."""
    steps = []
    for node in body:
        if node[0] == "text":
            steps.append(lambda scope, mask, t=node[1]: ((t, mask),))
        elif node[0] == "out":
            steps.append(lambda scope, mask, v=value_of(node[1], filters): ((shown(v(scope)), mask),))
        elif node[0] == "set":

            def put(scope, mask, name=node[1], v=value_of(node[2], filters)):
                scope[name] = v(scope)
                return ()

            steps.append(put)
        elif node[0] == "generation":
            steps.append(lambda scope, mask, inside=renderer(node[1], filters): inside(scope, True))
        elif node[0] == "if":

            def choose(scope, mask, arms=[(value_of(c, filters), renderer(b, filters)) for c, b in node[1]], other=renderer(node[2], filters)):
                return next((inside for condition, inside in arms if condition(scope)), other)(scope, mask)

            steps.append(choose)
        else:

            def loop(scope, mask, name=node[1], over=value_of(node[2], filters), inside=renderer(node[3], filters), other=renderer(node[4], filters)):
                before = {k: scope[k] for k in (name, "loop") if k in scope}
                empty = True
                for value, state in walked(over(scope)):
                    empty = False
                    scope[name], scope["loop"] = value, state
                    yield from inside(scope, mask)
                for k in (name, "loop"):
                    scope.pop(k, None)
                scope.update(before)
                if empty:
                    yield from other(scope, mask)

            steps.append(loop)

    def run(scope, mask):
        for step in steps:
            yield from step(scope, mask)

    return run


class Template:
    """A compiled template: ``pieces(messages=...)`` yields (text, whether under the loss mask)."""

    def __init__(self, source: str, controls: Controls):
        self.source, self.controls = source, controls
        filters = FILTERS | {"escape": lambda v: controls.escape(shown(v))}
        self.tree = simplified(parse(source), filters)
        self._run = renderer(self.tree, filters)

    def __reduce__(self):  # closures are built anew where a task needs them
        return Template, (self.source, self.controls)

    def pieces(self, **variables):
        return self._run(dict(variables), False)


class Walk:
    """Messages that can be walked once; nothing else can be asked of them."""

    def __init__(self, values):
        self._values = values

    def __iter__(self):
        if self._values is None:
            raise TemplateError("messages of a stream are walked once")
        values, self._values = self._values, None
        return values


# --- conversations

@dataclass(frozen=True)
class Layout:
    """Marks of a turn in formatted text: before the first turn, before a role, after it, after a text."""

    begin: str = "<s>"
    role: str = "[INST]"
    text: str = "[/INST]"
    end: str = "</s>"

    def template(self) -> Template:
        """Turns one after the other, values escaped, assistant texts under the loss mask."""
        source = """
            {#- one turn after the other -#}
            {{- '%s' -}}
            {%% for m in messages -%%}
                {{- '%s' ~ (m.role | escape) ~ '%s' -}}
                {%%- if m.role == 'assistant' -%%}
                    {%% generation %%}{{ m.text | escape }}{%% endgeneration %%}
                {%%- else -%%}
                    {{ m.text | escape }}
                {%%- endif -%%}
                {{- '%s' -}}
            {%%- endfor -%%}
        """ % (self.begin, self.role, self.text, self.end)
        return Template(source.strip(), Controls(self.begin, self.role, self.text, self.end))


def formatted(rows: DataFrame, template: Template, part_size: int = PART) -> DataFrame:
    """Every conversation of ``rows`` (conv_id, turn, role, text) through ``template``, in parts of at most ``part_size`` code points.

    Returns conv_id, part (from 0), start (code points before it), text, and loss (spans of the part under
    the mask, end exclusive). Turns go by turn, null last, then role and text; repeated rows are turns of
    their own; null roles and texts are empty; rows under a null conv_id are one conversation of that id.
    Other columns are not read; no rows give no rows. Parts of one conversation follow one another in one
    partition. Turns are sorted, spilling to disk, and streamed: a conversation of any length needs the
    memory of one turn and one part.
    """
    columns = ["conv_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "turn"]
    rows = rows.select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_last("turn"), "role", "text")

    def render(batches):
        turns = (turn for batch in batches for turn in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))))
        out, held = [], 0
        for conv_id, group in groupby(turns, key=lambda t: t[0]):
            messages = Walk({"role": role, "text": text} for _, role, text in group)
            for part in parts(conv_id, template.pieces(messages=messages), part_size):
                out.append(part)
                held += len(part["text"]) + 100
                if held > part_size:
                    yield pa.RecordBatch.from_pylist(out, _PARTS)
                    out, held = [], 0
        yield pa.RecordBatch.from_pylist(out, _PARTS)

    return rows.mapInArrow(render, "conv_id long, part long, start long, text string, loss array<struct<start:long,end:long>>")


_PARTS = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int64()), ("start", pa.int64()), ("text", pa.string()),
    ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
])


def parts(conv_id, pieces, most: int):
    """Pieces (text, mask) of a conversation as rows of ``formatted``; a part ends where it is full."""
    texts, loss, size, number, start = [], [], 0, 0, 0
    for text, mask in pieces:
        while text:
            now, text = text[: most - size], text[most - size :]
            if mask and loss and loss[-1]["end"] == size:
                loss[-1]["end"] = size + len(now)
            elif mask:
                loss.append({"start": size, "end": size + len(now)})
            texts.append(now)
            size += len(now)
            if size == most:
                yield {"conv_id": conv_id, "part": number, "start": start, "text": "".join(texts), "loss": loss}
                texts, loss, size, number, start = [], [], 0, number + 1, start + size
    if size or not number:
        yield {"conv_id": conv_id, "part": number, "start": start, "text": "".join(texts), "loss": loss}


def turns_of(texts, layout: Layout):
    """Turns (role, text) read back from the texts of a conversation's parts."""
    kept, at, stage, role = "", 0, 0, None
    marks = (layout.begin, layout.role, layout.text, layout.end)
    for text in texts:
        kept, at, seen = kept[at:] + text, 0, max(0, len(kept) - at - len(max(marks, key=len)))
        while (found := kept.find(marks[stage], max(at, seen))) >= 0:
            value, at = unescape(kept[at:found]), found + len(marks[stage])
            if stage < 2 and value:
                raise ValueError("a turn does not begin where the last one ended")
            if stage == 2:
                role = value
            if stage == 3:
                yield role, value
            stage = 1 if stage == 3 else stage + 1
    if stage != 1 or at < len(kept):
        raise ValueError("a conversation ends inside a turn")


def digest(parts_: DataFrame, layout: Layout) -> DataFrame:
    """Read back from the parts of ``formatted``, per conversation: the digests of its turns and of what the mask covers."""

    def read(batches):
        rows = (row for batch in batches for row in batch.to_pylist())
        out = []
        for conv_id, group in groupby(rows, key=lambda r: r["conv_id"]):
            loss, state = hashlib.sha256(), {"chars": 0, "loss": 0, "open": ""}

            def texts():
                for row in group:
                    state["chars"] += len(row["text"])
                    covered = state["open"] + "".join(row["text"][s["start"] : s["end"]] for s in row["loss"])
                    # an escape may be cut by the end of a part: its backslash waits
                    whole = len(covered) - (len(covered) - len(covered.rstrip("\\"))) % 2
                    state["open"] = covered[whole:]
                    covered = unescape(covered[:whole])
                    state["loss"] += len(covered)
                    loss.update(covered.encode())
                    yield row["text"]

            every, n = hashlib.sha256(), 0
            for role, text in turns_of(texts(), layout):
                every.update(f"{role}\n{text}\n".encode())
                n += 1
            out.append((conv_id, n, every.hexdigest(), state["loss"], loss.hexdigest(), state["chars"]))
            if len(out) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _DIGEST)], schema=_DIGEST)
                out = []
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [[]] * len(_DIGEST), _DIGEST)], schema=_DIGEST)

    return parts_.mapInArrow(
        read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


_DIGEST = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
    ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
])
