"""Parsers: a file in, its symbols, imports and references out.

Python is read with ``ast``; files it refuses give their top-level definitions by a scan of the lines.  Of TypeScript and
JavaScript a tokenizer that knows strings, templates, comments and regular expressions feeds a scan for declarations.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..session import spread

SYMBOL = "struct<fqn:string,name:string,kind:string,line_start:int,line_end:int,signature:string,docstring:string,is_exported:boolean,parent_fqn:string>"
IMPORT = "struct<local_name:string,module:string,imported_symbol:string,is_relative:boolean,level:int,line:int>"
REFERENCE = "struct<kind:string,target_name:string,from_fqn:string,line:int,receiver:string,receiver_type:string>"
SCHEMA = f"file_id bigint, path string, module_fqn string, symbols array<{SYMBOL}>, imports array<{IMPORT}>, refs array<{REFERENCE}>"


def _receiver(node: ast.expr) -> tuple[str | None, str | None]:
    """(receiver, name) of a call's target; a receiver that is no plain dotted name is left out."""
    if isinstance(node, ast.Name):
        return None, node.id
    if isinstance(node, ast.Attribute):
        text = ast.unparse(node.value)
        return (text if re.fullmatch(r"[\w.]+", text) else None), node.attr
    return None, None


class _Python:
    def __init__(self, path: str, text: str, builtins: frozenset[str]):
        self.module = re.sub(r"(^|\.)__init__$", "", re.sub(r"\.pyi?$", "", path).replace("/", "."))
        self.is_test = bool(re.search(r"(^|/)(tests?|__tests__)/|(^|/)test_[^/]*$|_test\.py$", path))
        self.lines, self.builtins = text.split("\n"), builtins
        self.symbols: list[tuple] = [(self.module, self.module.rsplit(".", 1)[-1], "module", 1, max(1, len(self.lines)), None, None, True, None)]
        self.imports: list[tuple] = []
        self.refs: list[tuple] = []

    def _ref(self, kind: str, node: ast.expr, owner: str, types: dict[str, str]) -> None:
        receiver, name = _receiver(node)
        if name and name not in self.builtins:
            self.refs.append((kind, name, owner, node.lineno, receiver, types.get(receiver) if receiver else None))

    def _names(self, kind: str, node: ast.expr | None, owner: str) -> None:
        todo = [node] if node is not None else []
        while todo:
            n = todo.pop()
            if isinstance(n, (ast.Name, ast.Attribute)):  # a dotted name is one
                self._ref(kind, n, owner, {})
            else:
                todo += reversed(list(ast.iter_child_nodes(n)))

    def _calls(self, body: list[ast.stmt], owner: str, types: dict[str, str]) -> None:
        todo: list[ast.AST] = list(body)
        while todo:
            n = todo.pop(0)
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
                continue
            if isinstance(n, ast.Call):
                self._ref("calls", n.func, owner, types)
            todo[0:0] = list(ast.iter_child_nodes(n))

    def visit(self, body: list[ast.stmt], owner: str, in_class: bool, types: dict[str, str]) -> None:
        types = dict(types)
        for n in ast.walk(ast.Module(body=[x for x in body if isinstance(x, ast.Assign)], type_ignores=[])):
            if isinstance(n, ast.Assign) and isinstance(n.value, ast.Call) and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name):
                name = _receiver(n.value.func)[1]
                if name and name[:1].isupper():
                    types.setdefault(n.targets[0].id, name)
        for n in body:
            if isinstance(n, ast.Import):
                self.imports += [(a.asname or a.name, a.name, None, False, 0, n.lineno) for a in n.names]
            elif isinstance(n, ast.ImportFrom):
                self.imports += [(a.asname or a.name, n.module or "", None if a.name == "*" else a.name, n.level > 0, n.level, n.lineno) for a in n.names]
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                fqn = f"{owner}.{n.name}"
                kind = "class" if isinstance(n, ast.ClassDef) else "method" if in_class else "function"
                start = min([n.lineno, *(x.lineno for x in n.decorator_list)])
                first = n.body[0]
                head = " ".join(" ".join(self.lines[n.lineno - 1 : max(n.lineno, first.lineno - 1)]).split()).rstrip(":")
                self.symbols.append((fqn, n.name, kind, start, n.end_lineno, head, ast.get_docstring(n), not n.name.startswith("_"), None if owner == self.module else owner))
                for x in n.decorator_list:
                    self._ref("references", x.func if isinstance(x, ast.Call) else x, fqn, {})
                if kind == "class":
                    for x in n.bases:
                        self._ref("inherits", x, fqn, {})
                    self.visit(n.body, fqn, True, types)
                else:
                    for a in [*n.args.posonlyargs, *n.args.args, *n.args.kwonlyargs]:
                        self._names("references", a.annotation, fqn)
                    self._names("references", n.returns, fqn)
                    if self.is_test and not in_class and n.name.startswith("test_"):
                        self.refs.append(("tests", n.name[5:], fqn, n.lineno, None, None))
                    self.visit(n.body, fqn, False, types)
        own = [x for x in body if not isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Import, ast.ImportFrom))]
        self._calls(own, owner, types)


# Names of Python that never become references.
PYTHON_BUILTINS = frozenset(
    "print len range enumerate zip map filter open isinstance issubclass getattr setattr hasattr super str int float bool bytes list dict set tuple frozenset object type repr hash id iter next "
    "sorted reversed sum min max abs round any all callable vars dir format input chr ord hex oct bin Exception ValueError TypeError KeyError IndexError RuntimeError StopIteration None True False self cls "
    "property staticmethod classmethod NotImplementedError AttributeError OSError IOError".split())
# Objects of the script runtime whose members never become references.
SCRIPT_MEMBER_GLOBALS = frozenset("console window document globalThis process Math JSON Object Reflect Number String Boolean Symbol Date Array Promise localStorage sessionStorage navigator".split())
# Functions of the script runtime that never become references where they are called bare.
SCRIPT_BARE_GLOBALS = frozenset("parseInt parseFloat isNaN isFinite setTimeout setInterval clearTimeout clearInterval structuredClone queueMicrotask require super".split())
# Types of TypeScript that never become references.
SCRIPT_BUILTIN_TYPES = frozenset(
    "string number boolean void any unknown never null undefined object bigint symbol this Array Promise Record Partial Readonly Pick Omit Map Set Date Function Object String Number Boolean RegExp Error "
    "Iterable Iterator ReadonlyArray".split())

_SCRIPT_TOKEN = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|`(?:[^`\\]|\\.)*`?|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|(?<=[=(,:;!&|?{}\n])\s*/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*", re.S)
_DECLARATION = re.compile(r"(?P<export>export\s+(?:default\s+)?)?(?:declare\s+)?(?:(?:abstract\s+)?(?P<kind>class|interface|enum|type|function)\b\*?\s*(?P<name>[A-Za-z_$][\w$]*)|(?:async\s+)?function\s*\*?\s*(?P<fn>[A-Za-z_$][\w$]*)|(?:const|let|var)\s+(?P<var>[A-Za-z_$][\w$]*)\s*(?::[^=;]+)?=\s*(?:async\s*)?(?:function\b|\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^=;{]+)?=>|[A-Za-z_$][\w$]*\s*=>))")
_MEMBER = re.compile(r"(?:^|[;}\n{])\s*(?:@[\w.]+(?:\([^)]*\))?\s*)*(?:(?:public|private|protected|static|readonly|abstract|override|async|get|set)\s+)*\*?(?P<name>#?[A-Za-z_$][\w$]*)\s*(?:<[^>(]*>)?\((?P<args>[^()]*(?:\([^()]*\)[^()]*)*)\)\s*(?::[^;{=]+)?\{")
_CALL = re.compile(r"(?:\bnew\s+)?(?:(?P<recv>[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\.)?(?P<name>[A-Za-z_$][\w$]*)\s*\(")
_IMPORT = re.compile(r"\b(?:import|export)\b\s*(?:type\s+)?(?P<what>[^;'\"]*?)\s*(?:\bfrom\s*)?(?P<q>['\"])(?P<module>[^'\"]+)(?P=q)")
# Words of the language that a bracket may follow.
SCRIPT_WORDS = frozenset("if for while switch catch return function typeof void delete await yield import constructor new class else do try throw in of instanceof".split())
_TYPE_NAME = re.compile(r"(?<![\w$.])[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*(?!\s*\??:)")


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m[0])


def _close(text: str, at: int) -> int:
    depth = 0
    for i in range(at, len(text)):
        if text[i] == "{":
            depth += 1
        elif text[i] == "}":
            depth -= 1
            if depth == 0:
                return i + 1
    return len(text)


def _mark(m: re.Match) -> str:
    """A comment blanked; of a string, template or regular expression no character is left that means anything."""
    own = m[0].lstrip()
    return _blank(m) if own.startswith(("//", "/*")) else m[0][: len(m[0]) - len(own)] + '"' * len(own)


# What may end or begin a line whose statement goes on.
_GOES_ON = re.compile(r"(?:[=|&?:,.(\[{<+\-*/%^!~]|=>|\b(?:keyof|extends|infer|typeof|in|instanceof|readonly|is|as|satisfies|asserts|new|await))\s*\Z")
_CARRIES_ON = re.compile(r"\s*(?:[=|&?:,.)\]}>+*/%^<\-]|(?:extends|is|in|instanceof|as|satisfies)\b)")
_TYPE_BEFORE = re.compile(r"(?:[:|&]|=>|\b(?:is|extends|keyof|readonly))\s*\Z")
_BRACE = re.compile(r"\s*\{")
_CLOSES = {")": "(", "]": "[", "}": "{"}


def _head_end(text: str, at: int, kind: str) -> int:
    """Where the head of a declaration ends that goes on at ``at``: before its body, else behind its last character.

    ``kind`` is ``type_alias``, ``arrow``, ``function`` or one whose body is the first brace outside brackets.  ``text``
    has passed ``_mark``.
    """
    if kind == "arrow" and _BRACE.match(text, at):
        return text.index("{", at)
    open_: list[str] = []
    last = at - 1  # the last character that is no white space
    for i in range(at, len(text)):
        c = text[i]
        before = text[max(at, last - 11) : last + 1] if c in "{\n" and not open_ else ""  # holds the longest word of both patterns
        if c == "{" and not open_ and kind not in ("type_alias", "arrow") and not (kind == "function" and _TYPE_BEFORE.search(before)):
            return i
        if c in "([{" or (c == "<" and kind != "arrow"):
            open_.append(c)
        elif c == ">" and open_ and open_[-1] == "<" and text[i - 1] != "=":
            open_.pop()
        elif c in ")]}":
            while open_ and open_[-1] == "<":
                open_.pop()
            if not open_ or open_.pop() != _CLOSES[c]:
                return i
        elif c == ";" and all(x == "<" for x in open_):
            return i + 1
        elif c == "\n" and not open_ and kind in ("type_alias", "arrow", "function") and before:
            if not _GOES_ON.search(before) and not _CARRIES_ON.match(text, i) and not (kind == "function" and _BRACE.match(text, i)):
                return i
        if not c.isspace():
            last = i
    return len(text)


def _annotations(head: str) -> list[str]:
    """Names of the types behind the colons of a declaration's head, in the order they stand."""
    names, depth, start = [], 0, None
    for i, c in enumerate(head + ","):
        if start is None:
            start = i + 1 if c == ":" else None
            continue
        depth += (c == "<") - (c == ">" and head[i - 1] != "=")
        if depth <= 0 and c in ",)=;{" or i == len(head):
            names += _TYPE_NAME.findall(head[start:i])
            depth, start = 0, None
    return [x for x in names if x not in SCRIPT_BUILTIN_TYPES]


def _script(path: str, source: str) -> tuple[str, list, list, list]:
    module = re.sub(r"\.(d\.ts|mts|cts|tsx|ts|jsx|mjs|cjs|js)$", "", path)
    text = _SCRIPT_TOKEN.sub(_blank, source)
    line = lambda at: source.count("\n", 0, at) + 1
    symbols = [(module, module.rsplit("/", 1)[-1], "module", 1, source.count("\n") + 1, None, None, True, None)]
    imports, refs, spans, seen = [], [], [], set()
    for m in _IMPORT.finditer(_SCRIPT_TOKEN.sub(lambda x: _blank(x) if x[0][:1] == "/" or x[0][:1] == "`" else x[0], source)):
        what, mod, at = m["what"].strip(), m["module"], line(m.start())
        rel = mod.startswith(".")
        named = re.search(r"\{([^}]*)\}", what)
        for x in (named[1].split(",") if named else []):
            parts = re.sub(r"^\s*type\s+", "", x).split(" as ")
            if parts[0].strip():
                imports.append((parts[-1].strip(), mod, parts[0].strip(), rel, 0, at))
        rest = re.sub(r"\{[^}]*\}", "", what)
        for x in rest.split(","):
            x = x.strip()
            if x.startswith("*"):
                imports.append((x.split(" as ")[-1].strip() if " as " in x else "*", mod, None, rel, 0, at))
            elif re.fullmatch(r"[\w$]+", x):
                imports.append((x, mod, "default", rel, 0, at))
        if not what:
            imports.append((mod, mod, None, rel, 0, at))
    found, marked = [], _SCRIPT_TOKEN.sub(_mark, source)
    for m in _DECLARATION.finditer(text):
        name = m["name"] or m["fn"] or m["var"]
        kind = {"type": "type_alias"}.get(m["kind"], m["kind"]) or "function"
        brace, semi = text.find("{", m.end()), text.find(";", m.end())
        end = _close(text, brace) if brace >= 0 and (kind != "type_alias" and (semi < 0 or brace < semi)) else (semi + 1 if semi >= 0 else len(text))
        found.append((m.start(), end, name, kind, bool(m["export"]), _head_end(marked, m.end(), "arrow" if m[0].endswith("=>") else kind)))
    for at, end, name, kind, exported, head_end in found:
        outer = [f for f in found if f[0] < at and end <= f[1]]
        parent = f"{module}::" + ".".join(f[2] for f in sorted(outer)) if outer else None
        fqn = f"{parent}.{name}" if parent else f"{module}::{name}"
        spans.append((at, end, fqn))
        symbols.append((fqn, name, kind, line(at), line(end - 1), " ".join(source[at:head_end].split()), None, exported, parent))
        if kind == "class":
            head = text[at : text.find("{", at)]
            for base in re.findall(r"\b(?:extends|implements)\s+([\w$.]+(?:\s*,\s*[\w$.]+)*)", head):
                refs += [("inherits", b.strip().split(".")[-1], fqn, line(at), b.strip().rpartition(".")[0] or None, None) for b in base.split(",")]
            body = text.find("{", at)
            for m in _MEMBER.finditer(text, body, end):
                n_at = m.start("name")
                if m["name"] in SCRIPT_WORDS - {"constructor"} | {"super"} or text.count("{", body, n_at) - text.count("}", body, n_at) != 1 or n_at in seen:
                    continue
                seen.add(n_at)
                stop = _close(text, m.end() - 1)
                spans.append((n_at, stop, f"{fqn}.{m['name']}"))
                symbols.append((f"{fqn}.{m['name']}", m["name"], "method", line(n_at), line(stop - 1), " ".join(source[n_at : m.end() - 1].split()), None, False, fqn))
    if re.search(r"\.[mc]?tsx?$", path):
        for at, end, fqn in spans:
            stop = min(x for x in (marked.find("{", at), end) if x >= 0)
            refs += [("references", x.rpartition(".")[2], fqn, line(at), x.rpartition(".")[0] or None, None) for x in _annotations(marked[at:stop]) if not x.startswith('"')]
    spans.sort()
    for m in _CALL.finditer(text):
        if m["name"] in SCRIPT_WORDS or (m["recv"].split(".")[0] in SCRIPT_MEMBER_GLOBALS if m["recv"] else m["name"] in SCRIPT_BARE_GLOBALS | SCRIPT_MEMBER_GLOBALS):
            continue
        own = [x for x in spans if x[0] < m.start() < x[1]]
        if m.start("name") in seen or any(abs(x[0] - m.start()) < 2 for x in spans) or re.search(r"function\s*\*?\s*$", text[max(0, m.start() - 12) : m.start("name")]):
            continue
        refs.append(("calls", m["name"], max(own)[2] if own else module, line(m.start()), m["recv"], None))
    return module, symbols, imports, refs


def parse(path: str | None, text: str | None) -> tuple | None:
    """(module, symbols, imports, references); None for a language without a parser."""
    ext = (path or "").rsplit(".", 1)[-1].lower() if "." in (path or "") else ""
    text = (text or "").replace("\r\n", "\n")
    if ext in ("py", "pyi"):
        p = _Python(path, text, PYTHON_BUILTINS)
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            for n, x in enumerate(p.lines):
                m = re.match(r"(class|(?:async\s+)?def)\s+(\w+)", x)
                if m:
                    p.symbols.append((f"{p.module}.{m[2]}", m[2], "class" if m[1] == "class" else "function", n + 1, n + 1, x.strip().rstrip(":"), None, not m[2].startswith("_"), None))
            return p.module, p.symbols, p.imports, p.refs
        p.visit(tree.body, p.module, False, {})
        return p.module, p.symbols, p.imports, p.refs
    if ext in ("ts", "mts", "cts", "tsx", "js", "jsx", "mjs", "cjs"):
        return _script(path, text)
    return None


def parse_files(files: DataFrame) -> DataFrame:
    """``file_id, path, module_fqn, symbols, imports, refs`` of every file with a parser.  No shuffle.

    Null content is an empty file: a module and nothing else.
    """
    names = [[x.split(":")[0] for x in s[7:-1].split(",")] for s in (SYMBOL, IMPORT, REFERENCE)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for f, p, c in zip(b["file_id"], b["path"], b["content"]):
                got = parse(p, c)
                if got:
                    rows.append((f, p, got[0], *([dict(zip(n, x)) for x in part] for n, part in zip(names, got[1:]))))
            yield pd.DataFrame(rows, columns=["file_id", "path", "module_fqn", "symbols", "imports", "refs"])

    return spread(files.select("file_id", "path", "content")).mapInPandas(run, SCHEMA)
