"""What source files say, as a table: calls, assignments, constructors, class heritage, literals and markup texts.

One small scanner reads a file's tokens in order. It knows comments, strings (over lines too), nesting and functions,
so nothing inside a comment or a string is taken for code and a line can hold any number of facts. Spark deals
the files out; every question about code is then a query over ``facts``.

Defined cases: files of other languages and null contents have no facts; brackets that never close end with the
file; regular expression literals of scripts are not told from divisions. Names joined by ``.``, ``?.``, ``::`` or ``->`` are
one name. A line number counts from 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.plans.shipping import ship

_QUOTED = r""""(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'"""
_REST = r"(?P<name>[A-Za-z_$][\w$]*(?:\s*(?:\?\.|\.|::|->)\s*[A-Za-z_$][\w$]*)*)|(?P<number>\d[\w.]*)|(?P<space>\s+)|(?P<mark>=>|[=!<>]=+|[-+*/%|&^:]?=|.)"
SHAPES = {
    "indented": re.compile(rf'(?P<comment>#[^\n]*)|(?P<string>[rbfuRBFU]{{0,2}}(?:"""(?:\\.|[^\\])*?"""|\'\'\'(?:\\.|[^\\])*?\'\'\'|{_QUOTED}))|{_REST}', re.S),
    "braced": re.compile(rf"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>{_QUOTED}|`(?:\\.|[^`\\])*`)|{_REST}", re.S),
}
LANGUAGES = {"python": "indented", "ruby": "indented"} | dict.fromkeys(("javascript", "typescript", "java", "go", "rust", "c", "cpp", "csharp", "php", "kotlin", "swift", "dart"), "braced")
#: Words before a bracket that make no call, and words that are no names of values.
WORDS = set("if for while switch catch return function def class elif and or not in is with assert await async lambda func fn let const var new typeof throw yield else do try except finally import from as raise del extends implements".split())
DEFINING = {"def", "function", "func", "fn"}
CLOSES = {")": "(", "]": "[", "}": "{"}
ARGS = "array<struct<text:string,root:string,uses:array<string>>>"
SCHEMA = f"path string, language string, pos int, line int, kind string, name string, full string, text string, scope string, uses array<string>, inner array<string>, args {ARGS}"


class _Scan:
    """One pass over a file's tokens."""

    def __init__(self, language: str, content: str):
        self.content, self.indented, self.scripted = content, LANGUAGES[language] == "indented", language in ("javascript", "typescript")
        self.rows: list[tuple] = []
        line, self.toks = 1, []  # kind, text, line, from, to
        for m in SHAPES[LANGUAGES[language]].finditer(content):
            if m.lastgroup == "space":
                if "\n" in m[0]:
                    self.toks.append(("end", "", line, m.start(), m.end()))
            elif m.lastgroup != "comment":
                text = re.sub(r"\s+", "", m[0]) if m.lastgroup == "name" else m[0]
                self.toks.append((m.lastgroup, text, line, m.start(), m.end()))
            line += m[0].count("\n")
        self.toks.append(("end", "", line, len(content), len(content)))

    def part(self, i: int, j: int) -> str:
        """Text of the tokens from i up to j."""
        while j > i and self.toks[j - 1][0] == "end":
            j -= 1
        return self.content[self.toks[i][3] : self.toks[j - 1][4]].strip() if j > i else ""

    def uses(self, i: int, j: int) -> tuple[list[str], list[str]]:
        """Names read, and names called, among the tokens from i up to j."""
        read, called = [], []
        for k in range(i, j):
            kind, text = self.toks[k][:2]
            if kind == "name" and text not in WORDS:
                leaf = re.split(r"\W+", text)[-1]
                (called if self.toks[k + 1][1] == "(" else read).append(leaf if self.toks[k + 1][1] == "(" else re.split(r"[^\w$]+", text)[0])
                if self.toks[k + 1][1] == "(" and leaf != text:
                    read.append(re.split(r"[^\w$]+", text)[0])
        return list(dict.fromkeys(read)), list(dict.fromkeys(called))

    def add(self, at: int, kind: str, name: str, text: str, scope: str, full: str = "", span: tuple[int, int] = (0, 0), args: list | None = None) -> None:
        read, called = self.uses(*span)
        self.rows.append((at, self.toks[at][2], kind, name, full or name, text, scope, read, called, args or []))

    def attribute(self, i: int) -> bool:
        """Whether the equals sign at i is one of a markup's attribute: a name or a text stands before its name."""
        kind, text = self.toks[i - 2][:2] if i > 1 else ("end", "")
        return self.scripted and self.toks[i - 1][0] == "name" and (kind == "string" or kind == "name" and text not in WORDS)

    def run(self) -> list[tuple]:
        toks, stack, open_, scopes, waiting = self.toks, [], [], [], None
        for i, (kind, text, _, start, _) in enumerate(toks):
            before, after = toks[i - 1] if i else ("end", "", 0, 0, 0), toks[min(i + 1, len(toks) - 1)]
            if self.indented and before[0] == "end" and kind != "end":  # a line that starts further left leaves functions
                column = start - (self.content.rfind("\n", 0, start) + 1)
                while scopes and not stack and column <= scopes[-1][0]:
                    scopes.pop()
            scope = scopes[-1][1] if scopes else ""
            if kind == "end" or text in (";", ")", "]", "}") or text == "," and not self.indented:
                ends = [a for a in open_ if len(stack) == a[0] and (kind != "end" or after[1][:1] not in (".", "?")) or len(stack) <= a[0] and kind != "end" and text not in ";,"]
                for a in ends:
                    open_.remove(a)
                    for name in a[2]:
                        self.add(a[4], "assign", name, self.part(a[1], i), scope, a[3], (a[1], i))
            if kind == "string":
                self.add(i, "literal", "", text.strip("rbfuRBFU")[1:-1] if text[-3:] not in ('"""', "'''") else text.strip("rbfuRBFU")[3:-3], scope)
            elif kind == "name":
                leaf = re.split(r"\W+", text)[-1]
                if before[1] in DEFINING:
                    waiting = leaf
                    if self.indented:
                        line_start = self.content.rfind("\n", 0, start) + 1
                        scopes.append((len(self.content[line_start:start]) - len(self.content[line_start:start].lstrip()), leaf))
                        waiting = None
                elif before[1] == "class" and before[0] == "name":
                    j = i + 1
                    while j < len(toks) - 1 and toks[j][1] not in ("{", ":") and (toks[j][0] != "end" or not self.indented):
                        j += 1
                    self.add(i, "class", leaf, self.part(i + 1, j).strip("()"), scope, span=(i + 1, j))
                elif before[1] == "new":
                    self.add(i, "new", leaf, "", scope, text)
            elif text in ("(", "[", "{"):
                ahead = toks[i - 2][1] if i > 1 else ""
                named = text == "(" and before[0] == "name" and (before[1] not in WORDS or ahead == ".")
                call = before[1] if named and ahead not in DEFINING | {"class", "new"} else None
                stack.append([text, i, call, scope, [i + 1]])
                if text == "{" and waiting and not self.indented:
                    scopes.append((len(stack), waiting))
                    waiting = None
            elif text == "," and stack:
                stack[-1][4].append(i + 1)
            elif text in CLOSES and stack:
                _, at, call, where, cuts = stack.pop()
                if text == "}" and scopes and not self.indented and scopes[-1][0] == len(stack) + 1:
                    scopes.pop()
                if call and after[1] == "{" and not self.indented and toks[at - 2][1] != ".":  # a method, not a call
                    call, waiting = None, call
                if call:
                    args = []
                    for a, b in zip(cuts, [*(c - 1 for c in cuts[1:]), i], strict=True):
                        if shown := self.part(a, b):
                            args.append((shown, re.split(r"[.\[(\s]", shown)[0], self.uses(a, b)[0]))
                    self.add(at - 1, "call", re.split(r"\W+", call)[-1], self.part(at - 1, i + 1), where, call, (at + 1, i), args)
            elif text in ("=", ":=", "+=") and not (stack and stack[-1][0] == "(") and (before[0] == "name" or before[1] in ("}", "]")) and not self.attribute(i):
                j = i - 1
                if before[0] != "name":  # a pattern on the left: every name in it
                    while j and toks[j][1] != CLOSES[before[1]]:
                        j -= 1
                names = self.uses(j, i)[0] if before[0] != "name" else [before[1]]
                kinds = toks[j - 1][1] if j and toks[j - 1][1] in ("var", "let", "const") else ""
                open_.append((len(stack), i + 1, names, kinds, j))
                if after[0] == "name" and after[1] == "function" or "=>" in (toks[k][1] for k in range(i, min(i + 12, len(toks)))):
                    waiting = names[0] if names else None
            elif text == ">" and not self.indented:
                j = i + 1
                while j < len(toks) - 1 and toks[j][0] in ("name", "number", "end") or toks[j][1] in (",", ".", "!", "?", "'", "-"):
                    j += 1
                if toks[j][1] == "<" and (toks[j + 1][1] == "/" or toks[j + 1][3] == toks[j][4]) and re.search(r"[^\W\d_]", shown := self.part(i + 1, j)):
                    self.add(i + 1, "markup", "", shown, scope)
        return self.rows


def facts(files: DataFrame) -> DataFrame:
    """One row for each fact of ``files`` (path, language, content).

    kind: call, assign, new, class, literal or markup. name: the last part of what is called, made or assigned; full:
    all of it (of an assignment var, let or const). text: the call, the value, the heritage or the literal. scope: the
    function around it. uses and inner: names read and called inside; args: each argument with its first name and names read.
    """
    ship(files.sparkSession)

    kinds = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, lang, *r) for p, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in _Scan(lang, text).run()]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            columns[-1] = [[{"text": t, "root": r, "uses": u} for t, r, u in a] for a in columns[-1]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], kinds.names)

    known = files.where(F.col("language").isin(*LANGUAGES) & F.col("content").isNotNull()).select("path", "language", "content")
    return known.mapInArrow(run, SCHEMA)


def calls_without_return(facts_: DataFrame, callee: str = "useEffect") -> DataFrame:
    """(path, line) of calls to ``callee`` whose first function returns nothing: effects that clean nothing up."""
    c = facts_.where((F.col("kind") == "call") & (F.col("name") == callee))
    return c.where(~F.col("text").rlike(r"\breturn\b")).select("path", "line")
