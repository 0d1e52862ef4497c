"""A small packrat engine for parsing-expression grammars.

A grammar is text, one rule a line (continuation lines are indented)::

    Name <- 'literal' TOKEN (A / B)* !C &D E?

``'literal'`` is a keyword or punctuation mark followed by trivia, an upper-case word names an entry of the token
table, anything else is a rule.  ``compile_grammar`` turns the text into one Python function per rule, with a memo table
for every rule that several rules call (linear time) and first-character sets that skip alternatives which cannot match.  The parser is a recogniser
over positions: a rule gives the position behind what it matched, or -1.  ``Hit`` marks -- ``Name@ <- ...`` -- record
``(start, end)`` of every match of that rule, which is how callers see functions and classes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

_LEX = re.compile(r"\s*(?:(<-)|'((?:[^'\\]|\\.)+)'|([A-Za-z_]\w*@?)|([/*+?!&()]))")
NON_ASCII = "\x80"


class Token:
    """A regular expression with the set of characters it may start with (None: any, or it may match nothing)."""

    def __init__(self, pattern: str, first: Iterable[str] | None = None, non_ascii: bool = False):
        self.pattern = pattern
        self.first = None if first is None else frozenset(first) | ({NON_ASCII} if non_ascii else set())


def _rules(text: str) -> dict[str, tuple]:
    rules: dict[str, tuple] = {}
    blocks: list[str] = []
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if line[0].isspace():
            blocks[-1] += " " + line
        else:
            blocks.append(line)
    for block in blocks:
        toks, at = [], 0
        block = block.rstrip()
        while at < len(block):
            m = _LEX.match(block, at)
            if not m:
                raise ValueError(f"bad grammar near {block[at:at + 30]!r}")
            toks.append(next((k, v) for k, v in zip(("arrow", "lit", "name", "op"), m.groups()) if v is not None))
            at = m.end()
        name = toks[0][1]
        assert toks[1][0] == "arrow", block
        node, rest = _choice(toks[2:])
        assert not rest, (name, rest)
        rules[name] = node
    return rules


def _choice(toks: list) -> tuple[tuple, list]:
    alts = []
    while True:
        seq, toks = _seq(toks)
        alts.append(seq)
        if toks and toks[0] == ("op", "/"):
            toks = toks[1:]
            continue
        return (alts[0] if len(alts) == 1 else ("choice", alts)), toks


def _seq(toks: list) -> tuple[tuple, list]:
    items = []
    while toks and toks[0] not in (("op", "/"), ("op", ")")):
        prefix = ""
        while toks[0] in (("op", "!"), ("op", "&")):
            prefix = toks[0][1]
            toks = toks[1:]
        kind, value = toks[0]
        toks = toks[1:]
        if (kind, value) == ("op", "("):
            node, toks = _choice(toks)
            assert toks[0] == ("op", ")")
            toks = toks[1:]
        else:
            node = ("lit", value.replace("\\'", "'").replace("\\\\", "\\")) if kind == "lit" else ("ref", value)
        while toks and toks[0] in (("op", "*"), ("op", "+"), ("op", "?")):
            node = ({"*": "star", "+": "plus", "?": "opt"}[toks[0][1]], node)
            toks = toks[1:]
        if prefix:
            node = ("not" if prefix == "!" else "and", node)
        items.append(node)
    return (items[0] if len(items) == 1 else ("seq", items)), toks


def compile_grammar(text: str, tokens: dict[str, Token], start: str, trivia: str, literal: Callable[[str], str], tests: dict[str, Callable[[str, int], bool]] | None = None, head: Callable[[str], str] = lambda text: text[0], codes: dict[str, str] | None = None, guarded: bool = True):
    """Returns ``run(source) -> (end, furthest, hits, ok)``.

    ``literal(text)`` gives the pattern of a literal without its trivia; ``trivia`` is the pattern skipped behind it.
    ``ok`` is true if the start rule consumed the whole input; ``furthest`` is the furthest position any rule was tried
    at, which is where an invalid input went wrong.  ``tests`` names tokens that match nothing but ask a function.
    ``head(text)`` is the character a literal starts with in the input.  Where the input is a string of token codes,
    ``codes`` gives the one character of each literal and token, which is then compared without a pattern.
    """
    raw = _rules(text)
    marked = {n[:-1] for n in raw if n.endswith("@")}
    rules = {n.rstrip("@"): v for n, v in raw.items()}
    pats: dict[str, str] = {}
    firsts: dict[str, frozenset | None] = {}

    def pat(node) -> str:
        p = literal(node[1]) + trivia if node[0] == "lit" else tokens[node[1]].pattern
        return pats.setdefault(p, f"T{len(pats)}")

    memo_first: dict[str, tuple] = {}

    def first(node, depth=()) -> tuple[frozenset | None, bool]:
        """The characters a match may start with (None: unknown) and whether it may be empty."""
        k = node[0]
        if k == "lit":
            return frozenset(head(node[1])), False
        if k == "ref":
            if node[1] in tokens:
                f = tokens[node[1]].first
                return f, f is None
            if node[1] not in rules:
                raise KeyError(node[1])
            if node[1] in depth:
                return None, False
            if node[1] not in memo_first:
                memo_first[node[1]] = first(rules[node[1]], (*depth, node[1]))
            return memo_first[node[1]]
        if k in ("not", "and"):
            return frozenset(), True
        if k in ("star", "opt"):
            return first(node[1], depth)[0], True
        if k == "plus":
            return first(node[1], depth)
        if k == "choice":
            fs = [first(x, depth) for x in node[1]]
            return (None if any(f is None for f, _ in fs) else frozenset().union(*(f for f, _ in fs))), any(e for _, e in fs)
        got: frozenset = frozenset()
        for x in node[1]:
            f, empty = first(x, depth)
            if f is None:
                return None, False
            got |= f
            if not empty:
                return got, False
        return got, True

    out: list[str] = []
    sets: dict[frozenset, str] = {}
    count = [0]

    def fresh() -> str:
        count[0] += 1
        return f"q{count[0]}"

    def starts(node) -> str | None:
        """A test of ``c`` that holds wherever the node can match; None if it may match anywhere."""
        f, empty = first(node)
        if f is None or empty or not guarded:
            return None
        name = sets.setdefault(f - {NON_ASCII}, f"F{len(sets)}")
        return f"c in {name} or c > '\\x7f'" if NON_ASCII in f else f"c in {name}"

    def emit(node, ind: str) -> None:
        k = node[0]
        if k == "ref" and node[1] in (tests or {}):
            out.append(f"{ind}if not X_{node[1]}(s, p): p = -1")
        elif codes and k in ("lit", "ref") and node[1] in codes and (k == "lit" or node[1] in tokens):
            out.append(f"{ind}p = p + 1 if s[p] == {codes[node[1]]!r} else -1")
        elif k == "lit" or k == "ref" and node[1] in tokens:
            out.append(f"{ind}m = {pat(node)}(s, p)")
            out.append(f"{ind}p = m.end() if m else -1")
        elif k == "ref":
            out.append(f"{ind}p = r_{node[1]}(p)")
        elif k == "seq":
            out.append(f"{ind}while True:")
            for i, x in enumerate(node[1]):
                emit(x, ind + " ")
                if i < len(node[1]) - 1:
                    out.append(f"{ind} if p < 0: break")
            out.append(f"{ind} break")
        elif k == "choice":
            q = fresh()
            out.append(f"{ind}{q} = p; p = -1; c = s[{q}]")
            for x in node[1]:
                may = starts(x)
                out.append(f"{ind}if p < 0:" if may is None else f"{ind}if p < 0 and ({may}):")
                out.append(f"{ind} p = {q}")
                emit(x, ind + " ")
                out.append(f"{ind} c = s[{q}]")
        elif k in ("star", "plus"):
            if k == "plus":
                emit(node[1], ind)
                out.append(f"{ind}if p >= 0:")
                ind += " "
            q = fresh()
            out.append(f"{ind}while True:")
            if may := starts(node[1]):
                out.append(f"{ind} c = s[p]")
                out.append(f"{ind} if not ({may}): break")
            out.append(f"{ind} {q} = p")
            emit(node[1], ind + " ")
            out.append(f"{ind} if p <= {q}:")
            out.append(f"{ind}  p = {q}; break")
        elif k == "opt":
            q = fresh()
            if may := starts(node[1]):
                out.append(f"{ind}c = s[p]")
                out.append(f"{ind}if {may}:")
                ind += " "
            out.append(f"{ind}{q} = p")
            emit(node[1], ind)
            out.append(f"{ind}if p < 0: p = {q}")
        elif k in ("not", "and"):
            q = fresh()
            out.append(f"{ind}{q} = p")
            emit(node[1], ind)
            out.append(f"{ind}p = {q} if p {'<' if k == 'not' else '>='} 0 else -1")

    # A rule that one other rule alone calls is met once at a position, that rule being memoised or met once itself.
    callers: dict[str, set[str]] = {n: set() for n in rules}

    def calls(node, by: str) -> None:
        if node[0] == "ref":
            if node[1] in rules:
                callers[node[1]].add(by)
        elif node[0] in ("seq", "choice"):
            for x in node[1]:
                calls(x, by)
        elif node[0] != "lit":
            calls(node[1], by)

    for name, node in rules.items():
        calls(node, name)

    body: list[str] = []
    for name, node in rules.items():
        out.clear()
        memo = len(callers[name]) > 1 or name in callers[name] or name in marked or name == start
        if memo:
            body.append(f" M_{name} = {{}}; memos.append(M_{name})")
        body.append(f" def r_{name}(p):")
        if memo:
            body.append(f"  v = M_{name}.get(p)")
            body.append("  if v is not None: return v")
            body.append("  p0 = p")
        emit(node, "  ")
        body.extend(out)
        if memo:
            body.append(f"  M_{name}[p0] = p")
        if name in marked:
            body.append(f"  if p >= 0: hits.setdefault({name!r}, {{}})[p0] = p")
        body.append("  return p")
    src = ["def run(s):", " hits = {}; memos = []; n = len(s); s = s.replace('\\x00', '\\x01') + '\\x00'", *body]
    src += [" m = SKIP(s, 0)", f" end = r_{start}(m.end())", " ok = end == n", " far = max((max(x) for x in memos if x), default=0)", " return end, far, hits, ok"]
    env = {v: re.compile(p).match for p, v in pats.items()} | {v: k for k, v in sets.items()}
    env |= {f"X_{k}": f for k, f in (tests or {}).items()}
    env["SKIP"] = re.compile(trivia).match
    exec("\n".join(src), env)  # noqa: S102 - generated from the grammar text above
    run = env["run"]
    if not guarded:
        return run
    whole: list = []

    def checked(s: str):
        got = run(s)
        if got[3]:
            return got
        # Alternatives that are skipped leave no trace of how far the input was looked at: try them all once more.
        if not whole:
            whole.append(compile_grammar(text, tokens, start, trivia, literal, tests, head, codes, False))
        return got[0], whole[0](s)[1], got[2], False

    checked.quick = run  # without the furthest position of a refused input
    return checked
