"""Chat formatting with a compiled template language.

A template is parsed into a syntax tree, constant parts are folded, and each node becomes a Python
closure; nothing of a template is ever evaluated as Python. The language has text, ``{{ expression }}``
with filters, ``{% for x in y %}``, ``{% if %}``/``{% elif %}``/``{% else %}``, ``{% set x = e %}`` and
``{% generation %}`` sections. Expressions know strings, integers, true, false, none, names, members
of mappings (``a.b``, ``a['b']``), ``+``, ``~``, ``==``, ``!=``, ``<``, ``>``, ``<=``, ``>=``, ``in``, ``and``,
``or``, ``not`` and parentheses. There are no calls, no attributes and no imports.

Rendering yields (text, in a generation section) fragments one by one and loops over any iterable, so
a conversation of any length is formatted turn by turn.

Control strings inside texts are broken by a backslash after their first character, and backslashes
are doubled, by the filter ``guard``; reading a formatted conversation back undoes this.

Defined cases: a null role or text counts as empty, and an empty role is written as one of its own. Turns are ordered by
turn (null first), ties by role, then by text; rows that repeat are turns each. Rows without a conversation id
form one conversation whose id is null. A conversation without an assistant has an empty loss text. An empty table gives an
empty result, and other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strings that mean something to a model or to the reader below. Fixed values.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[TURN]", "[/TURN]", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))

TEMPLATE = (
    "<s>{% for m in messages %}"
    "{% if m.role == 'user' %}[INST]{{ m.text | guard }}[/INST]"
    "{% elif m.role == 'assistant' %}{% generation %}{{ m.text | guard }}{% endgeneration %}</s>"
    "{% elif m.role == 'system' %}<<SYS>>{{ m.text | guard }}<</SYS>>"
    "{% else %}[ROLE]{{ m.role | guard }}[/ROLE][TURN]{{ m.text | guard }}[/TURN]{% endif %}"
    "{% endfor %}"
)


def guard(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unguard(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


class TemplateError(ValueError):
    pass


FILTERS: dict[str, Callable[[Any], Any]] = {"guard": lambda x: guard(str(x)), "trim": lambda x: str(x).strip(), "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(), "length": len}

# --- expressions ----------------------------------------------------------------------------------

_TOKEN = re.compile(r"\s*(?:(?P<name>[A-Za-z_]\w*)|(?P<int>\d+)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<op>==|!=|<=|>=|[-+~<>()\[\].|,]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_COMPARE: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b,
}


class _Parser:
    """Recursive descent over one expression; nodes are tuples."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("name", "op") and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str:
        if not self.peek(*values):
            raise TemplateError(f"expected {' or '.join(values)}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> tuple:
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.peek("or"):
            self.take("or")
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.peek("and"):
            self.take("and")
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        if self.peek("not"):
            self.take("not")
            return ("not", self.negated())
        return self.compared()

    def compared(self) -> tuple:
        node = self.joined()
        while self.peek(*_COMPARE):
            node = ("compare", self.take(*_COMPARE), node, self.joined())
        return node

    def joined(self) -> tuple:
        node = self.filtered()
        while self.peek("+", "~"):
            node = ("join", self.take("+", "~"), node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.member()
        while self.peek("|"):
            self.take("|")
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            node = ("filter", name, node)
        return node

    def member(self) -> tuple:
        node = self.atom()
        while self.peek(".", "["):
            if self.take(".", "[") == ".":
                if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
                    raise TemplateError("a name must follow the dot")
                node = ("member", node, ("const", self.tokens[self.at][1]))
                self.at += 1
            else:
                node = ("member", node, self.either())
                self.take("]")
        return node

    def atom(self) -> tuple:
        if self.peek("("):
            self.take("(")
            node = self.either()
            self.take(")")
            return node
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends early")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "int":
            return ("const", int(text))
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "name" and text not in ("and", "or", "not", "in"):
            known = {"true": True, "false": False, "none": None}
            return ("const", known[text]) if text.lower() in known and text in ("true", "false", "none") else ("name", text)
        raise TemplateError(f"unexpected {text!r}")


def fold(node: tuple) -> tuple:
    """The expression with constant parts computed."""
    if node[0] in ("const", "name"):
        return node
    parts = tuple(fold(x) if isinstance(x, tuple) else x for x in node)
    if all(x[0] == "const" for x in parts if isinstance(x, tuple)):
        return ("const", _closure(parts)({}))
    return parts


def _member(value: Any, key: Any) -> Any:
    if isinstance(value, dict):
        return value.get(key)
    if isinstance(value, (list, tuple, str)) and isinstance(key, int):
        return value[key] if -len(value) <= key < len(value) else None
    return None


def _closure(node: tuple) -> Callable[[dict], Any]:
    kind = node[0]
    if kind == "const":
        return lambda scope, v=node[1]: v
    if kind == "name":
        return lambda scope, n=node[1]: scope.get(n)
    args = [_closure(x) for x in node if isinstance(x, tuple)]
    if kind == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    if kind == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if kind == "not":
        return lambda scope: not args[0](scope)
    if kind == "compare":
        return lambda scope, f=_COMPARE[node[1]]: f(args[0](scope), args[1](scope))
    if kind == "filter":
        return lambda scope, f=FILTERS[node[1]]: f(args[0](scope))
    if kind == "member":
        return lambda scope: _member(args[0](scope), args[1](scope))
    if node[1] == "+":
        return lambda scope: args[0](scope) + args[1](scope)
    return lambda scope: _shown(args[0](scope)) + _shown(args[1](scope))


def _shown(value: Any) -> str:
    return "" if value is None else str(value)


# --- statements -----------------------------------------------------------------------------------

_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.S)


def parse(source: str) -> list[tuple]:
    """The template's syntax tree with folded expressions; adjacent constant text is one node."""
    root: list[tuple] = []
    open_: list[tuple[str, list, list]] = [("", root, [])]  # kind, body, branches

    def emit(node: tuple) -> None:
        body = open_[-1][1]
        if node[0] == "text" and body and body[-1][0] == "text":
            node = ("text", body.pop()[1] + node[1])
        if node != ("text", ""):
            body.append(node)

    at = 0
    for m in _TAG.finditer(source):
        emit(("text", source[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            node = fold(_Parser(m[1]).whole())
            emit(("text", _shown(node[1])) if node[0] == "const" else ("show", node))
        elif m[2] is not None:
            word, _, rest = m[2].strip().partition(" ")
            kind, body, branches = open_[-1]
            if word == "for":
                if not (found := re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.*)", rest, re.S)):
                    raise TemplateError(f"cannot read for {rest!r}")
                open_.append(("for", [], [found[1], fold(_Parser(found[2]).whole())]))
            elif word == "if":
                open_.append(("if", first := [], [(fold(_Parser(rest).whole()), first)]))
            elif word in ("elif", "else") and kind == "if" and branches[-1][0] != ("const", True):
                test = fold(_Parser(rest).whole()) if word == "elif" else ("const", True)
                branches.append((test, new := []))
                open_[-1] = ("if", new, branches)
            elif word == "generation":
                open_.append(("generation", [], []))
            elif word == "set":
                name, eq, value = rest.partition("=")
                if not eq or not re.fullmatch(r"[A-Za-z_]\w*", name.strip()):
                    raise TemplateError(f"cannot read set {rest!r}")
                emit(("set", name.strip(), fold(_Parser(value).whole())))
            elif word == f"end{kind}" and kind:
                open_.pop()
                if kind == "for":
                    emit(("for", *branches, body))
                elif kind == "generation":
                    emit(("generation", body))
                else:
                    live = []
                    for test, part in branches:  # branches that can never be reached go
                        if test[0] == "const" and not test[1]:
                            continue
                        live.append((test, part))
                        if test[0] == "const":
                            break
                    emit(("if", live))
            else:
                raise TemplateError(f"unexpected {word!r}")
    emit(("text", source[at:]))
    if len(open_) > 1:
        raise TemplateError(f"{open_[-1][0]} is not ended")
    return root


Fragments = Iterator[tuple[str, bool]]


def _body(nodes: list[tuple], masked: bool) -> Callable[[dict], Fragments]:
    steps = [_step(n, masked) for n in nodes]

    def run(scope: dict) -> Fragments:
        for step in steps:
            yield from step(scope)

    return run


def _step(node: tuple, masked: bool) -> Callable[[dict], Fragments]:
    kind = node[0]
    if kind == "text":
        fragment = (node[1], masked)
        return lambda scope: iter((fragment,))
    if kind == "show":
        value = _closure(node[1])
        return lambda scope: iter(((_shown(value(scope)), masked),))
    if kind == "set":
        name, value = node[1], _closure(node[2])

        def put(scope: dict) -> Fragments:
            scope[name] = value(scope)
            return iter(())

        return put
    if kind == "generation":
        return _body(node[1], True)
    if kind == "if":
        branches = [(_closure(test), _body(part, masked)) for test, part in node[1]]

        def choose(scope: dict) -> Fragments:
            return next((part(scope) for test, part in branches if test(scope)), iter(()))

        return choose
    name, over, part = node[1], _closure(node[2]), _body(node[3], masked)

    def loop(scope: dict) -> Fragments:
        for item in over(scope) or ():
            yield from part({**scope, name: item})

    return loop


def compile_template(source: str) -> Callable[..., Fragments]:
    """A function of the template's variables that yields (text, in a generation section)."""
    run = _body(parse(source), False)
    return lambda **scope: run(scope)


# --- reading back ---------------------------------------------------------------------------------

_TURN = re.compile(r"\[INST\](?P<user>.*?)\[/INST\]|<<SYS>>(?P<system>.*?)<</SYS>>|\[ROLE\](?P<role>.*?)\[/ROLE\]\[TURN\](?P<text>.*?)\[/TURN\]|(?P<assistant>.*?)</s>", re.S)
_NEXT = re.compile(r"\[INST\]|<<SYS>>|\[ROLE\]")


class Reader:
    """Turns of a formatted conversation, from its fragments as they come."""

    def __init__(self) -> None:
        self.buffer, self.started = "", False

    def feed(self, fragment: str) -> Iterator[tuple[str, str]]:
        self.buffer += fragment
        if not self.started:
            if not self.buffer.startswith("<s>"):
                return
            self.buffer, self.started = self.buffer[3:], True
        if not fragment.endswith((">", "]")):
            return  # a turn ends with a control string
        while m := _TURN.match(self.buffer):
            if m["assistant"] is not None and _NEXT.match(self.buffer):
                return  # another kind of turn has begun and is not complete
            self.buffer = self.buffer[m.end() :]
            if m["role"] is not None:
                yield unguard(m["role"]), unguard(m["text"])
            else:
                yield m.lastgroup or "", unguard(m[m.lastgroup])

    def close(self) -> None:
        if self.buffer or not self.started:
            raise ValueError("a formatted conversation ends inside a turn")


# --- on Spark -------------------------------------------------------------------------------------


def _ordered(conversations: DataFrame) -> DataFrame:
    """Turns of a conversation side by side and in order; sorted on disk where they do not fit."""
    c = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return c.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Any, dict]]:
    for batch in batches:
        for conv, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text"), strict=True):
            yield conv, {"role": role, "text": text.as_py()}


def _grouped(turns: Iterable[tuple[Any, dict]]) -> Iterator[tuple[Any, Iterator[dict]]]:
    from itertools import groupby

    for conv, group in groupby(turns, key=lambda t: t[0]):
        yield conv, (t for _, t in group)


def formatted(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Fragments of the formatted conversations: conv_id, at, fragment, masked. One row a fragment, so none is held whole."""
    parse(template)  # mistakes show here and not in a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render, rows = compile_template(template), []
        names, kinds = ["conv_id", "at", "fragment", "masked"], [pa.int64(), pa.int64(), pa.string(), pa.bool_()]

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
            rows.clear()
            return made

        for conv, messages in _grouped(_turns(batches)):
            for at, (fragment, masked) in enumerate(render(messages=messages)):
                rows.append((conv, at, fragment, masked))
                if len(rows) >= 2000:
                    yield flush()
        yield flush()

    return _ordered(conversations).mapInArrow(run, "conv_id long, at long, fragment string, masked boolean")


def read_back(fragments: DataFrame) -> DataFrame:
    """What the output says: turns and loss mask of each conversation, one row each.

    ``fragments`` as ``formatted`` makes them: those of a conversation follow each other in order.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        out = []
        for conv, group in groupby(rows(), key=lambda r: r[0]):
            reader, turns, loss, n, loss_chars, chars = Reader(), hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, _, fragment, masked in group:
                chars += len(fragment)
                if masked:
                    text = unguard(fragment)
                    loss_chars += len(text)
                    loss.update(text.encode("utf-8", "surrogatepass"))
                for role, text in reader.feed(fragment):
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            reader.close()
            out.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], [f.split()[0] for f in schema.split(", ")])

    return fragments.select("conv_id", "at", "fragment", "masked").mapInArrow(run, schema)
