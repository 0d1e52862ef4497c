"""Functions and methods of a source text with the documentation that stands at them, and the heads of its classes.

Python is read with ``ast``; JavaScript and TypeScript with the packrat grammars, whose marks give every function,
method, accessor and variable of the real code, never of strings or comments.
"""

from __future__ import annotations

import ast
import bisect
import re
import warnings
from dataclasses import dataclass

from .grammar_script import parser
from .languages import grammar_of


@dataclass
class Documented:
    name: str
    kind: str  # function, method or class
    owner: str | None  # the class a method belongs to, or that a head declares
    bases: list[str]
    line_start: int
    signature: str
    doc: str | None


# Words that may stand before a declaration.
_MODIFIERS = "export default async public private protected static abstract override readonly declare accessor const get set".split()
_WORD = re.compile(r"[\w$]+")
_NAME = re.compile(r"(?:async\s+)?(?:function\b)?\s*\*?\s*(?:(?:get|set)\s+(?=[^\s(=<:?!]))?([\w$#]+|\[[^\]]*\]|\"[^\"]*\"|'[^']*')?")
_CLASS = re.compile(r"class\b\s*(?!(?:extends|implements)\b)([\w$]+)?")


def _ws(text: str) -> str:
    return " ".join(text.split())


def _statements(node: ast.AST) -> list[ast.stmt]:
    """The statements right below a node; expressions hold no definitions."""
    out: list[ast.stmt] = []
    for field in ("body", "orelse", "finalbody", "handlers", "cases"):
        below = getattr(node, field, None)
        if below:
            out += below
    return out


def from_python(source: str) -> list[Documented]:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(source.lstrip("﻿"))
    source = source.lstrip("﻿")
    breaks = [0, *(m.end() for m in re.finditer(r"\r\n|\r|\n", source))]
    out: list[Documented] = []
    todo: list[tuple[ast.AST, str | None, list[str]]] = [(tree, None, [])]
    while todo:
        node, owner, bases = todo.pop()
        for child in _statements(node):
            if isinstance(child, ast.ClassDef):
                todo.append((child, child.name, [ast.unparse(b) for b in child.bases]))
                out.append(Documented(child.name, "class", *todo[-1][1:], source.count("\n", 0, breaks[child.lineno - 1]) + 1, "", None))
                continue
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                direct = isinstance(node, ast.ClassDef)
                at = breaks[child.lineno - 1]
                ends = breaks[child.body[0].lineno - 1] if child.body[0].lineno > child.lineno else at + child.body[0].col_offset
                out.append(Documented(child.name, "method" if direct else "function", owner if direct else None, bases if direct else [], source.count("\n", 0, at) + 1, _ws(source[at:ends]).rstrip(": "), ast.get_docstring(child, clean=False)))
                todo.append((child, None, []))
            elif hasattr(child, "body") or hasattr(child, "cases"):
                todo.append((child, owner if isinstance(node, ast.ClassDef) else None, bases if isinstance(node, ast.ClassDef) else []))
    return out


def _doc_before(s: str, at: int) -> str | None:
    """The text of the ``/** */`` block that ends before ``at`` with only white space between."""
    end = len(s[:at].rstrip())
    if not s.endswith("*/", 0, end):
        return None
    start = s.rfind("/*", 0, end - 2)
    while start > 0:
        earlier = s.rfind("/*", 0, start)
        line = s.rfind("\n", 0, max(earlier, 0)) + 1
        if earlier < 0 or "*/" in s[earlier + 2 : start] or s[line:earlier].strip():
            break
        start = earlier
    if start < 0 or end - start < 5 or not s.startswith("/**", start):
        return None
    return s[start + 3 : end - 2]


def _modified(s: str, at: int) -> int:
    """Where the modifiers begin that stand before ``at``."""
    while True:
        end = at
        while end and s[end - 1].isspace():
            end -= 1
        word = next((w for w in _MODIFIERS if s.endswith(w, 0, end) and not _WORD.match(s, max(0, end - len(w) - 1), end - len(w))), None) if end < at else None
        if word is None:
            return at
        at = end - len(word)


def from_script(source: str, kind: str) -> list[Documented] | None:
    """None if the text is not valid."""
    end, far, hits, ok = parser(kind)(source)
    if not ok:
        return None
    blocks, classes = hits.get("FnBlock", {}), []
    for at, to in hits.get("Class", {}).items():
        m, brace = _CLASS.match(source, at), source.find("{", at)
        head = source[at:brace]
        bases = re.findall(r"\bextends\s+([\w$.]+)", head) + [b.strip() for x in re.findall(r"\bimplements\s+(.+)", head, re.S) for b in re.sub(r"<[^<>]*>", "", x).split(",")]
        classes.append((at, to, m[1] if m else None, bases))
    decorated = {to: at for at, to in hits.get("Decorators", {}).items()}
    block_of: dict[int, int] = {}  # end -> start of the outermost block that ends there
    for at, to in blocks.items():
        block_of[to] = min(at, block_of.get(to, at))
    declared = sorted(hits.get("VarDecl", {}).items())
    starts = [at for at, _ in declared]
    values: dict[int, list[int]] = {}
    for at, to in sorted([*hits.get("FuncExpr", {}).items(), *hits.get("Arrow", {}).items()]):
        values.setdefault(to, []).append(at)
    value_of = {to: at for at, to in hits.get("VarValue", {}).items()}  # end -> start of an initialiser
    classes.sort()
    class_starts = [c[0] for c in classes]

    found: list[tuple[int, int, int, str]] = []  # declaration, name, end, kind
    for rule, what in (("FuncDecl", "function"), ("Method", "method"), ("Accessor", "method"), ("ObjMethod", "method"), ("ObjAccessor", "method")):
        for at, to in hits.get(rule, {}).items():
            if to not in block_of:
                continue  # an overload or abstract member
            m = _NAME.match(source, at)
            found.append((at, m.start(1) if m and m[1] else at, to, what))
    for at, to in hits.get("VarOne", {}).items():
        i = bisect.bisect_left(starts, at) - 1
        while i >= 0 and declared[i][1] <= at:
            i -= 1
        if i < 0 or not source.startswith("const", declared[i][0]):
            continue
        if value_of.get(to, 0) > at and value_of[to] in values.get(to, ()) and _WORD.match(source, at):
            found.append((declared[i][0], at, to, "function"))
    out, seen = [Documented(name, "class", name, bases, source.count("\n", 0, at) + 1, "", None) for at, _, name, bases in classes if name], set()
    for at, name_at, to, what in sorted(found, key=lambda x: (x[1], -x[2])):
        if name_at in seen:
            continue
        seen.add(name_at)
        start, doc = at, None
        while True:
            start = _modified(source, start)
            doc = doc if doc is not None else _doc_before(source, start)
            if start not in decorated:
                break
            start = decorated[start]
        m = re.compile(r"[\w$#]+").match(source, name_at)
        owner = None
        if what == "method":
            i = bisect.bisect_left(class_starts, at) - 1
            while i >= 0 and classes[i][1] <= at:
                i -= 1
            owner = classes[i] if i >= 0 else None
        body = block_of.get(to, to) if block_of.get(to, to) > at else to
        out.append(Documented(m[0] if m else "", what, owner[2] if owner else None, owner[3] if owner else [], source.count("\n", 0, name_at) + 1, _ws(source[start:body]), doc))
    return out


def declared(path: str | None, source: str | None) -> list[Documented]:
    """Every function and class head of a file; none if the language is unknown or the text is not valid in it."""
    grammar = grammar_of(path)
    if grammar is None or source is None:
        return []
    if grammar != "python":
        return from_script(source, grammar) or []
    try:
        return from_python(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []


def documented(path: str | None, source: str | None) -> list[Documented]:
    """Every function of a file."""
    return [d for d in declared(path, source) if d.kind != "class"]
