"""Telling hand-written source from generated, minified, vendored and data files.

Every file is lexed, its tokens are laid out again in a canonical form -- one statement a line, blocks opened and closed on
lines of their own, one space where the form wants one, long bracketed lists wrapped -- and the original layout is compared
with it: a text that expands extremely, or lacks nearly every space the form has, was minified; one whose canonical lines
repeat one pattern without a break was written by a tool; one that consists of literals is data.  What layout cannot show,
that a file is a copy of someone else's or that a tool wrote lines as a person would, is read off its path and the notices in
its head and foot.
"""

from __future__ import annotations

import json
import re
from collections import Counter

from .languages import grammar_of

_LEX = {
    "python": re.compile(r"(?P<com>\#[^\r\n]*)|(?P<str>(?i:[rubf]{0,2})(?:\"\"\"(?:[^\\]|\\.)*?(?:\"\"\"|\Z)|'''(?:[^\\]|\\.)*?(?:'''|\Z)|\"(?:[^\"\\\r\n]|\\.)*\"?|'(?:[^'\\\r\n]|\\.)*'?))|(?P<num>0[xX][\da-fA-F_]+|\d[\w.]*)|(?P<name>[^\W\d]\w*)|(?P<nl>\n)|(?P<op>[^\s\w])", re.S),
    "script": re.compile(r"(?P<com>//[^\r\n]*|/\*.*?(?:\*/|\Z))|(?P<str>`(?:[^`\\]|\\.)*`?|\"(?:[^\"\\\r\n]|\\.)*\"?|'(?:[^'\\\r\n]|\\.)*'?)|(?P<num>0[xX][\da-fA-F_]+|\d[\w.]*)|(?P<name>[^\W\d][\w$]*|\$[\w$]*)|(?P<nl>\n)|(?P<op>=>|[^\s\w])", re.S),
}

# Directory names under which copies of other projects are kept, and names of files that tools write.
VENDOR_DIRS = "vendor _vendor vendored _vendored third_party thirdparty third-party 3rdparty 3rd_party node_modules bower_components jspm_packages site-packages dist-packages venv .venv virtualenv extern external externals".split()
WEAK_VENDOR_DIRS = "deps ext contrib imported lib libs external_libs".split()
TOOL_NAMES = re.compile(r"(_pb2(_grpc)?\.pyi?|\.pb\.[jt]s|\.pb\.go|[._-](gen|generated|autogen)\.\w+|\.g\.[jt]sx?|\.designer\.\w+|(^|/)(lextab|yacctab|parsetab)\.py)$", re.I)
VERSIONED_DIR = re.compile(r"^@?[a-z][\w.]*-v?\d+(\.\d+)+\w*$", re.I)

# Notices of tools and of copies, as they stand in comments at the head or foot of a file.
GENERATED_NOTICE = re.compile(
    r"@generated\b|<auto-?generated|\bauto-?generated\s+(by|from|using|with|at|on|file|code)\b|\bautomatically\s+generated\b|code\s+generated\s+(by|from)\b|\bdo\s+not\s+(edit|modify|change)\b|\bgenerated\s+(client|code|file|source|bindings?|stubs?|parser|by\s+the\s+protocol\s+buffer)\b.*|"
    r"\bmachine[\s-]written\s+by\b|\b(manual|local|your)?\s*(changes|edits)\s+will\s+be\s+(lost|overwritten)\b|\bregenerate\s+(instead|with|by|using)\b|\bthis\s+(file|code|module)\s+(was|is|has\s+been)\s+(auto\w*[\s-]*)?generated\b|automatisch\s+(erzeugt|generiert)|généré\s+automatiquement|generado\s+automáticamente|gerado\s+automaticamente|自动生成|自動生成",
    re.I,
)
COPY_NOTICE = re.compile(
    r"\bbundled\s+copy\b|\bsee\s+upstream\b|\bcopied\s+(verbatim\s+)?from\b.*(\d+\.\d+|upstream|https?://)|\bvendored\s+(from|copy)\b|\bupstream\s+https?://|\btaken\s+from\b.*https?://|\bforked\s+from\b.*https?://|"
    r"\breleased\s+under\s+the\s+\w[\w.-]*\s+licen[cs]e|^[\s*/#!]*@?[\w/.-]+\s+v\d+\.\d+\.\d+\b",
    re.I | re.M,
)
HAND_NOTICE = re.compile(r"\bby\s+hand\b|\bhand-?written\b|\bthey\s+are\s+ours\b|\bmaintained\s+here\b", re.I)

#: Columns beyond which the canonical form wraps a bracketed list.
WIDTH = 88
_COMPOUND = frozenset("<>!=+-*/%&|^:~@?")  # what makes "=" part of another mark
_OPENS, _SHUTS = frozenset("([{"), frozenset(")]}")
# Words that open a statement whose block may follow its colon on the same line.
_BLOCK_WORDS = frozenset("if elif else for while with try except finally def class async match case".split())


class Layout:
    """A text's tokens, the lines they stand in, and the lines of the canonical form.

    ``lines`` and ``canonical`` are lists of token lists, comments left out; ``wanted`` counts the spaces of the canonical
    form that do not depend on a token's meaning, ``missing`` those of them that the text does not have.
    """

    def __init__(self, script: bool, content: str):
        self.script = script
        found = list(_LEX["script" if script else "python"].finditer(content))
        self.tokens = [(m.lastgroup, m[0]) for m in found]
        self.code = [(k, t) for k, t in self.tokens if k not in ("com", "nl")]
        self.lines: list[list[tuple[str, str]]] = []
        self.canonical: list[list[tuple[str, str]]] = []
        self.wanted = self.missing = 0
        self._lay_out([m.span() for m in found])

    def _lay_out(self, spans: list[tuple[int, int]]) -> None:
        script, depth, width, lambdas, open_blocks = self.script, 0, 0, 0, []
        own: list[tuple[str, str]] = []
        line: list[tuple[str, str]] = []
        before, before_end, assigned = "", 0, False

        def close() -> None:
            nonlocal line, width
            if line:
                self.canonical.append(line)
            line, width = [], 0

        for (start, end), (kind, text) in zip(spans, self.tokens):
            if kind == "nl":
                if own:
                    self.lines.append(own)
                own = []
                if not depth and (not script or before in (";", "{", "}", ",")):
                    close()
                before = "\n"
                continue
            if kind == "com":
                continue
            own.append((kind, text))
            assigns = not depth and text == "=" and before not in _COMPOUND
            if before != "\n" and (before == "," or assigns or assigned and text not in ("=", ">", "=>") or script and text == "{" and before == ")"):
                self.wanted += 1
                self.missing += start == before_end
            assigned = assigns
            before, before_end = text, end
            if kind != "op":
                lambdas += text == "lambda" and not depth
                line.append((kind, text))
                width += len(text) + 1
                continue
            if script and text in "{}":
                # what a brace opens begins a line, and so does the brace that closes it
                if text == "}":
                    depth = open_blocks.pop() if open_blocks else 0
                    close()
                    line.append((kind, text))
                else:
                    line.append((kind, text))
                    open_blocks.append(depth)
                    depth = 0
                    close()
                continue
            line.append((kind, text))
            width += len(text) + 1
            if text in _OPENS:
                depth += 1
            elif text in _SHUTS:
                depth = max(0, depth - 1)
            elif text == ";" and not depth or text == "," and depth and width > WIDTH:
                close()
            elif text == ":" and not script and not depth:
                if lambdas:
                    lambdas -= 1
                elif line[0][1] in _BLOCK_WORDS:
                    close()
        if own:
            self.lines.append(own)
        close()

    def expansion(self) -> float:
        """Canonical lines a line of the text; long lists are wrapped on both sides alike, so they do not count."""
        return len(self.canonical) / max(1, len(self.lines))

    def tightness(self) -> float:
        """The share of the canonical form's spaces that the text lacks."""
        return self.missing / self.wanted if self.wanted >= 20 else 0.0

    def uniformity(self) -> tuple[float, int]:
        """(share of canonical lines that repeat the line one period before, the period) for the best period up to 12.

        Only a text that runs through its period four times has one.
        """
        shapes = [_shape(x) for x in self.canonical if x != [("op", "}")]]
        n, best, period = len(shapes), 0.0, 0
        for p in range(1, min(12, n // 4) + 1):
            share = sum(map(str.__eq__, shapes[p:], shapes)) / (n - p)
            if share > best + 0.02:
                best, period = share, p
            if best > 0.97:
                break
        return best, period


def _shape(tokens: list[tuple[str, str]]) -> str:
    """A line's pattern: words and literals by kind, marks as they are."""
    return " ".join("n" if k == "name" else "0" if k == "num" else "s" if k == "str" else t for k, t in tokens)


def literals(code: list[tuple[str, str]]) -> list[str]:
    """Numbers and plain strings; templates and texts in triple quotes are prose or code."""
    return [t for k, t in code if k == "num" or k == "str" and t[0] != "`" and t.lstrip("rRuUbBfF")[:3] not in ('"""', "'''")]


def lay_out(path: str | None, content: str) -> Layout:
    return Layout(grammar_of(path) not in (None, "python"), content)


def by_layout(path: str | None, content: str, x: Layout, valid=lambda path, content: True) -> str | None:
    """minified, generated or data, as the comparison with the canonical layout shows it; None for a text laid out by hand."""
    raw = [y for y in content.splitlines() if y.strip()]
    chars = sum(len(t) for _, t in x.code) or 1
    plain = literals(x.code)
    share = sum(map(len, plain)) / chars
    first = next((i for i, (k, _) in enumerate(x.tokens) if k not in ("com", "nl")), 0)
    remarks = sum(k == "com" for k, _ in x.tokens[first:])
    dense = sum(len(t) for t in plain if not re.search(r"\s", t)) / chars
    if len(plain) >= 12 and share >= 0.7 and 3 * remarks < len(x.lines) or dense >= 0.8 and max(map(len, raw), default=0) >= 200:
        return "data"
    if len(x.code) >= 40 and (x.expansion() >= 4 or x.tightness() >= 0.8 and x.expansion() >= 1.5):
        return "minified"
    if len(x.canonical) >= 8 and remarks <= 1:
        share, period = x.uniformity()
        if share >= 0.97 and not all(y[0][1] in ("import", "from") or y[0][1] == "export" and y[1:2] in ([("op", "*")], [("op", "{")]) for y in x.canonical[:period]) and valid(path, content):
            return "generated"
    return None


def notices(x: Layout) -> str:
    """The comments at the head and at the foot of a file; strings are not among them."""
    tokens = [y for y in x.tokens if y[0] != "nl"]
    first = next((i for i, (k, _) in enumerate(tokens) if k != "com"), len(tokens))
    last = next((i for i in range(len(tokens) - 1, -1, -1) if tokens[i][0] != "com"), -1)
    return "\n".join(t for _, t in tokens[:first] + tokens[max(last + 1, first):])


def is_table(content: str) -> bool:
    """Rows of one delimiter, the same number of it in nearly every line."""
    lines = [x for x in content.splitlines() if x.strip()]
    if len(lines) < 4:
        return False
    for mark in ";\t|,":
        counts = Counter(x.count(mark) for x in lines)
        n, times = counts.most_common(1)[0]
        ends = sum(x.rstrip().endswith(mark) for x in lines)
        if n >= (1 if mark == "\t" else 2) and times >= 0.9 * len(lines) and ends < 0.1 * len(lines):
            indented = sum(x[0] in " \t" for x in lines)
            words = sum(bool(re.match(r"\s*(def|class|import|from|const|let|var|export|function|return|if|for)\b", x)) for x in lines)
            if words < 0.1 * len(lines) and indented < 0.5 * len(lines):
                return True
    return False


def is_json(content: str) -> bool:
    text = content.strip()
    if text[:1] not in ("{", "["):
        return False
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        # cut short: still a document of quoted keys
        return text[:1] in "{[" and len(re.findall(r'"[^"\n]*"\s*:', text)) >= 10 and not re.search(r"^\s*(?:def|function|const|class|import)\b", text, re.M)
    return isinstance(value, (dict, list)) and bool(value)


def by_words(path: str | None, x: Layout) -> str | None:
    """vendored, generated or minified, as the path or a notice says it."""
    place = (path or "").replace("\\", "/")
    dirs, name = [d.lower() for d in place.split("/")[:-1]], place.rsplit("/", 1)[-1]
    if any(d in VENDOR_DIRS for d in dirs) or any(VERSIONED_DIR.match(d) for d in dirs) and any(d in WEAK_VENDOR_DIRS for d in dirs):
        return "vendored"
    if TOOL_NAMES.search(name):
        return "generated"
    said = notices(x)
    if HAND_NOTICE.search(said):
        return None
    return "generated" if GENERATED_NOTICE.search(said) else "vendored" if COPY_NOTICE.search(said) else None


def origin(path: str | None, content: str | None, valid=lambda path, content: True) -> str | None:
    """Why a file is not hand-written: minified, generated, data or vendored; None if it is, or if it is blank.

    ``valid`` says whether the text is valid in its language; lines of one pattern count as generated only if it is.
    """
    if not content or not content.strip():
        return None
    if is_json(content) or is_table(content):
        return "data"
    x = lay_out(path, content)
    return by_layout(path, content, x, valid) or by_words(path, x)
