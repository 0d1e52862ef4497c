"""Packrat grammar of Python over a string of token codes.

The lexer turns a source text into one character per token, with NEWLINE, INDENT and DEDENT as tokens of their own, so
that the grammar below runs on the same engine as those that read characters.
"""

from __future__ import annotations

import functools
import re
import unicodedata

from .peg import Token, compile_grammar

# The keywords and operators of the language.
KEYWORDS = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
SOFT = ["match", "case", "type"]
OPERATORS = "( ) [ ] { } : , ; . ... = == != < > <= >= -> := + - * / // % @ & | ^ ~ << >> ** += -= *= /= //= %= @= &= |= ^= <<= >>= **=".split()
CODE = {t: chr(0x21 + i) for i, t in enumerate([*KEYWORDS, *SOFT, *OPERATORS, "NAME", "NUM", "STR", "BSTR", "NL", "INDENT", "DEDENT", "LINE"])}
assert max(CODE.values()) <= "~"

_DIG = r"\d(?:_?\d)*"
_PREFIX = r"(?i:[rub]|br|rb|f|fr|rf)?"
_TOKEN = re.compile(
    rf"""[ \t\f]*(?:(?P<name>[^\W\d]\w*+(?!["']))
    |(?P<str>{_PREFIX}(?:\"\"\"|'''|\"|'))
    |(?P<word>[^\W\d]\w*)
    |(?P<num>(?:0[xX](?:_?[\da-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:{_DIG})?\.{_DIG}(?:[eE][+-]?{_DIG})?[jJ]?|{_DIG}\.?(?:[eE][+-]?{_DIG})[jJ]?|{_DIG}\.[jJ]?|{_DIG}[jJ]|(?:[1-9](?:_?\d)*|0(?:_?0)*)(?!\.))(?:(?!\w)|(?=and|else|for|i[fns]|not|or)))
    |(?P<op>{"|".join(re.escape(o) for o in sorted(OPERATORS, key=len, reverse=True))})
    |(?P<nl>\r\n|\n|\r)
    |(?P<skip>\\\r?\n|\#[^\r\n]*|\Z))""",
    re.X,
)
_BODY = {q: re.compile(rf"(?:[^\\{q}\r\n]|\\(?:\r\n|(?s:.)))*{q}") for q in "\"'"} | {q * 3: re.compile(rf"(?s:(?:[^\\{q}]|\\.|{q}(?!{q}{q}))*){q * 3}") for q in "\"'"}
_INDENT = re.compile(r"[ \t\f]*")
_BLANK = re.compile(r"[ \t\f]*(?:\#[^\r\n]*)?(?:\r\n|\n|\r|\Z)")
_OPEN, _CLOSE = "([{", {")": "(", "]": "[", "}": "{"}


_WORDS = {t: CODE[t] for t in [*KEYWORDS, *SOFT]}


# What a literal must not hold: broken escapes of text and of bytes.
_BAD_ESCAPE = re.compile(r"(?s)(?:[^\\]|\\[^xuUN])*?\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4})|U(?!00(?:0[0-9a-fA-F]|10)[0-9a-fA-F]{4})|N(?!\{[^{}]+\}))")
_BAD_BYTE = re.compile(r"(?s)(?:[^\\]|\\[^x])*?\\x(?![0-9a-fA-F]{2})")
_NAMED = re.compile(r"\\N\{([^{}]+)\}")


class LexError(Exception):
    def __init__(self, at: int, why: str):
        super().__init__(why)
        self.at, self.why = at, why


def _behind_escape(s: str, at: int, raw: bool) -> int:
    """The position behind the backslash at ``at`` and what it escapes, which a brace never is."""
    m = None if raw else _NAMED.match(s, at)
    if not raw:
        _escapes(m[0] if m else s[at : at + 10], at, False)
    return m.end() if m else at + 1 if s[at + 1 : at + 2] in ("{", "}") else at + 2


def _fstring(s: str, at: int, quote: str, raw: bool) -> int:
    """The position behind an f-string's body that starts at ``at``; its expressions are lexed, not skipped."""
    n = len(s)
    while at < n:
        c = s[at]
        if s.startswith(quote, at):
            return at + len(quote)
        if c == "\\":
            at = _behind_escape(s, at, raw)
        elif c in "\r\n" and len(quote) == 1:
            break
        elif s.startswith("{{", at) or s.startswith("}}", at):
            at += 2
        elif c == "{":
            at = _field(s, at + 1, quote, raw)
        elif c == "}":
            raise LexError(at, "single '}' in f-string")
        else:
            at += 1
    raise LexError(at, "unterminated f-string")


@functools.lru_cache(50_000)
def _is_field(text: str) -> bool:
    """Whether an f-string's field holds an expression; the same fields come again in every file."""
    return parser("FieldExpr").quick(tokens_of(f"({text})\n"))[3]


def _field(s: str, at: int, quote: str, raw: bool) -> int:
    start, depth = at, []
    while at < len(s):
        c = s[at]
        if c in " \t\f":
            at += 1
            continue
        if not depth and (c in "}:" or c == "!" and not s.startswith("!=", at) or c == "=" and re.compile(r"=\s*[}:!]").match(s, at) and s[at - 1] not in "=!<>"):
            if not _is_field(s[start:at]):
                raise LexError(start, "invalid f-string expression")
            if c == "=":
                at = re.compile(r"=\s*").match(s, at).end()
            if s[at] == "!":
                if not re.compile(r"![sra]\s*[:}]").match(s, at):
                    raise LexError(at, "invalid f-string conversion")
                at = re.compile(r"![sra]\s*").match(s, at).end()
            if s[at] == ":":
                at += 1
                while at < len(s) and s[at] != "}":
                    if s.startswith(quote, at) or s[at] in "\r\n" and len(quote) == 1:
                        raise LexError(at, "unterminated f-string field")
                    at = _field(s, at + 1, quote, raw) if s[at] == "{" else at + 1
            if at >= len(s):
                break
            return at + 1
        m = _TOKEN.match(s, at)
        if not m:
            raise LexError(at, "invalid character in f-string")
        if m.lastgroup == "str":
            at = _string(s, m)
            continue
        if m.end() == at:
            break
        if m.lastgroup == "op":
            op = m["op"]
            if m.start("op") > at:  # what ends a field is looked at anew
                at = m.start("op")
                continue
            if op in _OPEN:
                depth.append(op)
            elif op in _CLOSE:
                if not depth or depth.pop() != _CLOSE[op]:
                    raise LexError(at, "unbalanced bracket in f-string")
        at = m.end()
    raise LexError(at, "unterminated f-string field")


def _escapes(body: str, at: int, of_bytes: bool) -> None:
    """Refuses escapes that the language does not know how to finish."""
    if (_BAD_BYTE if of_bytes else _BAD_ESCAPE).match(body):
        raise LexError(at, "broken escape")
    for m in _NAMED.finditer(body) if not of_bytes and "\\N" in body else ():
        try:
            unicodedata.lookup(m[1])
        except KeyError:
            if len(re.search(r"\\*$", body[: m.start()])[0]) % 2 == 0:
                raise LexError(at, "unknown character name") from None


def _string(s: str, m: re.Match) -> int:
    text = m["str"]
    quote = text.lstrip("rRuUbBfF")
    prefix = text[: len(text) - len(quote)].lower()
    if "f" in prefix:
        return _fstring(s, m.end(), quote, "r" in prefix)
    body = _BODY[quote].match(s, m.end())
    if not body:
        raise LexError(m.start("str"), "unterminated string")
    inner = body[0][: -len(quote)]
    if "b" in prefix and not inner.isascii():
        raise LexError(m.start("str"), "bytes beyond ASCII")
    if "\\" in inner and "r" not in prefix:
        _escapes(inner, m.start("str"), "b" in prefix)
    return body.end()


def tokens_of(s: str, places: list[int] | None = None) -> str:
    """The token codes; raises ``LexError``.  The position of each token is put into ``places``, if given."""
    at = 1 if s.startswith("\ufeff") else 0
    codes: list[str] = []
    stack: list[tuple[str, int]] = []
    indents = [(0, 0)]
    n, bol = len(s), True
    match, words, name_code, put, ops, brackets = _TOKEN.match, _WORDS.get, CODE["NAME"], codes.append, CODE, frozenset("()[]{}")
    string, name, word, number, op, line, skip = (_TOKEN.groupindex[g] for g in ("str", "name", "word", "num", "op", "nl", "skip"))
    newline = CODE["NL"]

    while at < n:
        if bol and not stack:
            m = _BLANK.match(s, at)
            if m:
                at = m.end()
                if at >= n:
                    break
                continue
            m = _INDENT.match(s, at)
            col = alt = len(m[0])
            if "\t" in m[0] or "\f" in m[0]:
                col = alt = 0
                for c in m[0]:
                    col, alt = (col + 1, alt + 1) if c == " " else ((col // 8 + 1) * 8, alt + 1) if c == "\t" else (0, 0)
            at = m.end()
            if col == indents[-1][0]:
                if alt != indents[-1][1]:
                    raise LexError(at, "inconsistent use of tabs")
            elif col > indents[-1][0]:
                if alt <= indents[-1][1]:
                    raise LexError(at, "inconsistent use of tabs")
                indents.append((col, alt))
                put(CODE["INDENT"])
                if places is not None:
                    places.append(at)
            else:
                while col < indents[-1][0]:
                    indents.pop()
                    put(CODE["DEDENT"])
                    if places is not None:
                        places.append(at)
                if col != indents[-1][0]:
                    raise LexError(at, "unindent matches no outer level")
        bol = False
        m = match(s, at)
        if not m:
            raise LexError(at, "invalid character or number")
        kind = m.lastindex
        if kind == name:
            put(words(m[name], name_code))
        elif kind == op:
            text = m[op]
            if text in brackets:
                if text in _OPEN:
                    stack.append((text, m.start(op)))
                elif not stack or stack.pop()[0] != _CLOSE[text]:
                    raise LexError(m.start(op), "unbalanced bracket")
            put(ops[text])
        elif kind == line:
            if stack:
                at = m.end()
                continue
            put(newline)
            bol = True
        elif kind == skip:
            at = m.end()
            if at == n and m[skip][:1] == "\\":
                raise LexError(n, "nothing behind a continued line")
            continue
        elif kind == number:
            put(CODE["NUM"])
        elif kind == word:  # a string right behind it
            put(words(m[word], name_code))
        else:
            put(CODE["BSTR" if m[string][:2].strip("rR\"'") in ("b", "B") else "STR"])
        if places is not None:
            places.append(m.start(kind))
        at = m.end() if kind != string else _string(s, m)
    if stack:
        raise LexError(stack[-1][1], "bracket never closed")
    if codes and codes[-1] not in (newline, CODE["DEDENT"]):
        put(newline)
    codes += [CODE["DEDENT"]] * (len(indents) - 1)
    if places is not None:
        places += [n] * (len(codes) - len(places))
    return "".join(codes)


GRAMMAR = r"""
File <- Stmt* EOF
FieldExpr <- '(' (Yield / Stars) ')' NL EOF
Name <- NAME / 'match' / 'case' / 'type'
Stmt <- LINE / Compound / Simple
SimpleLine <- Simple EOF
Simple <- Small (';' Small)* ';'? NL
Small <- 'pass' / 'break' / 'continue' / 'return' Stars? / 'raise' (Expr ('from' Expr)?)? / ('global' / 'nonlocal') Name (',' Name)*
    / 'del' DelTargets / Yield / 'assert' Expr (',' Expr)? / Import / TypeAlias / Assign / Stars
Import <- 'import' Dotted ('as' Name)? (',' Dotted ('as' Name)?)* / 'from' (('.' / '...')* Dotted / ('.' / '...')+) 'import' ('*' / '(' FromName (',' FromName)* ','? ')' / FromName (',' FromName)*)
FromName <- Name ('as' Name)?
Dotted <- Name ('.' Name)*
TypeAlias <- 'type' Name TypeParams? '=' Expr
Assign <- (Access / Name / '(' Single ')') ':' Expr ('=' Rhs)? / (Targets '=')+ Rhs !'=' / Single AugOp Rhs
DelTargets <- DelTarget (',' DelTarget)* ','?
DelTarget <- Access / Name / '(' DelTargets? ')' / '[' DelTargets? ']'
AugOp <- '+=' / '-=' / '*=' / '/=' / '//=' / '%=' / '@=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '**='
Rhs <- Yield / Stars
Yield <- 'yield' ('from' Expr / Stars?)
Single <- Access / Name / '(' Single ')'
Targets <- StarTarget (',' StarTarget)* ','?
StarTarget <- '*' StarTarget0 / StarTarget0
StarTarget0 <- Access / Name / '(' Targets? ')' / '[' Targets? ']'
Access <- Atom (Trailer &('.' / '[' / '('))* ('.' Name / '[' Slices ']') !('.' / '[' / '(')

Compound <- Decorated / Def / Class / If / While / For / Try / With / Match / 'async' (Def / For / With)
Decorated <- ('@' Named NL)+ ('async'? Def / Class)
Def <- 'def' Name TypeParams? '(' Params? ')' ('->' Expr)? ':' Block
Params <- Plain (',' Plain)* (',' '/' (',' Plain)* (',' Default)* / (',' Default)+ (',' '/' (',' Default)*)?)? (',' Behind)? ','? / Default (',' Default)* (',' '/' (',' Default)*)? (',' Behind)? ','? / Behind ','?
Plain <- Name (':' Expr)? !'='
Default <- Name (':' Expr)? '=' Expr
Either <- Name (':' Expr)? ('=' Expr)?
Behind <- '*' (Name (':' ('*' Arith / Expr))? (',' Either)* / (',' Either)+) (',' '**' Name (':' Expr)?)? / '**' Name (':' Expr)?
TypeParams <- '[' TypeParam (',' TypeParam)* ','? ']'
TypeParam <- ('*' / '**')? Name (':' Expr)? ('=' ('*' Arith / Expr))?
Class <- 'class' Name TypeParams? ('(' Args? ')')? ':' Block
Block <- NL INDENT Stmt+ DEDENT / Simple
If <- 'if' Named ':' Block ('elif' Named ':' Block)* Else?
Else <- 'else' ':' Block
While <- 'while' Named ':' Block Else?
For <- 'for' Targets 'in' Stars ':' Block Else?
With <- 'with' ('(' WithItem (',' WithItem)* ','? ')' ':' / WithItem (',' WithItem)* ':') Block
WithItem <- Expr 'as' StarTarget &(',' / ')' / ':') / Expr
Try <- 'try' ':' Block ('finally' ':' Block / Except+ Else? ('finally' ':' Block)?)
Except <- 'except' '*'? (Expr ('as' Name)?)? ':' Block
Match <- 'match' StarNamed (',' StarNamed)* ','? ':' NL INDENT Case+ DEDENT
Case <- 'case' (OpenSeq / Pattern) ('if' Named)? ':' Block
OpenSeq <- MaybeStar ',' (MaybeStar (',' MaybeStar)* ','?)?
MaybeStar <- '*' Name / Pattern
Pattern <- Closed ('|' Closed)* ('as' Name)?
Closed <- ClassPat / Name ('.' Name)* / '-'? NUM (('+' / '-') NUM)? / Str / 'None' / 'True' / 'False' / '(' (OpenSeq / MaybeStar)? ')' / '[' (MaybeStar (',' MaybeStar)* ','?)? ']' / '{' (MapItem (',' MapItem)* ','?)? '}'
MapItem <- '**' Name / ('-'? NUM (('+' / '-') NUM)? / Str / 'None' / 'True' / 'False' / Name ('.' Name)+) ':' Pattern
ClassPat <- Name ('.' Name)* '(' (ClassArg (',' ClassArg)* ','?)? ')'
ClassArg <- Name '=' Pattern / Pattern

Str <- STR+ !BSTR / BSTR+ !STR
Stars <- StarExpr (',' StarExpr)* ','?
StarExpr <- '*' Arith / Expr
Named <- Name ':=' Expr / Expr !':='
StarNamed <- '*' Arith / Named
Expr <- Lambda / Disj ('if' Disj 'else' Expr)?
Lambda <- 'lambda' LParams? ':' Expr
LParams <- LPlain (',' LPlain)* (',' '/' (',' LPlain)* (',' LDefault)* / (',' LDefault)+ (',' '/' (',' LDefault)*)?)? (',' LBehind)? ','? / LDefault (',' LDefault)* (',' '/' (',' LDefault)*)? (',' LBehind)? ','? / LBehind ','?
LPlain <- Name !'='
LDefault <- Name '=' Expr
LEither <- Name ('=' Expr)?
LBehind <- '*' (Name (',' LEither)* / (',' LEither)+) (',' '**' Name)? / '**' Name
Disj <- Conj ('or' Conj)*
Conj <- Inv ('and' Inv)*
Inv <- 'not' Inv / Comp
Comp <- Arith (CompOp Arith)*
CompOp <- '==' / '!=' / '<' / '>' / '<=' / '>=' / 'in' / 'not' 'in' / 'is' 'not'?
Arith <- Factor (BinOp Factor)*
BinOp <- '+' / '-' / '*' / '/' / '//' / '%' / '@' / '&' / '|' / '^' / '<<' / '>>'
Factor <- ('+' / '-' / '~') Factor / Power
Power <- 'await'? Primary ('**' Factor)?
Primary <- Atom Trailer*
Trailer <- '.' Name / '(' (Named CompFor / Args)? ')' / '[' Slices ']'
Args <- Pos (',' Pos)* (',' KwStar)* (',' KwPair)* ','? / KwStar (',' KwStar)* (',' KwPair)* ','? / KwPair (',' KwPair)* ','?
Pos <- '*' Expr / Named !'='
KwStar <- Name '=' Expr / '*' Expr
KwPair <- Name '=' Expr / '**' Expr
Slices <- Slice (',' Slice)* ','?
Slice <- Expr? ':' Expr? (':' Expr?)? / StarNamed
Atom <- Name / NUM / Str / '...' / 'None' / 'True' / 'False' / '(' (Yield / Named (CompFor / (',' StarNamed)* ','?) / '*' Arith ',' (StarNamed (',' StarNamed)* ','?)?)? ')' / '[' (Named CompFor / StarNamed (',' StarNamed)* ','?)? ']' / '{' (Expr ':' Expr CompFor / DictItem (',' DictItem)* ','? / Named CompFor / StarNamed (',' StarNamed)* ','?)? '}'
DictItem <- '**' Arith / Expr ':' Expr
CompFor <- ('async'? 'for' Targets 'in' Disj ('if' Disj)*)+
"""


@functools.cache
def parser(start: str = "File"):
    tokens = {k: Token(re.escape(CODE[k]), CODE[k]) for k in ("NAME", "NUM", "STR", "BSTR", "NL", "INDENT", "DEDENT", "LINE")}
    tokens["EOF"] = Token(r"(?=\x00)", "\x00")
    return compile_grammar(GRAMMAR, tokens, start, "", lambda t: re.escape(CODE[t]), None, lambda t: CODE[t], CODE)


#: Logical lines, as token codes, with whether each is a whole simple statement; the same lines come again in every file.
_LINES: dict[str, bool] = {}
MOST_LINES = 200_000


def _folded(codes: str) -> str:
    """The codes with one LINE in place of each simple statement: what stands on a logical line depends on nothing around it."""
    newline, line, blocks = CODE["NL"], CODE["LINE"], CODE["INDENT"] + CODE["DEDENT"]
    rule, known, out = parser("SimpleLine").quick, _LINES, []
    *rows, last = codes.split(newline)
    for row in rows:
        text = row.lstrip(blocks)
        whole = known.get(text)
        if whole is None:
            if len(known) >= MOST_LINES:
                known.clear()
            whole = known[text] = rule(text + newline)[3]
        out.append(row[: len(row) - len(text)] + line if whole else row + newline)
    return "".join(out) + last


def parse(source: str) -> tuple[bool, int, str]:
    """Whether the text is valid, else the furthest position and the lexer's reason ('' if the grammar refused it)."""
    try:
        codes = tokens_of(source)
    except LexError as e:
        return False, e.at, e.why
    if parser().quick(_folded(codes))[3]:
        return True, len(source), ""
    _, far, _, ok = parser()(codes)
    if ok:
        return True, len(source), ""
    places: list[int] = []
    tokens_of(source, places)
    return False, len(source) if far >= len(places) else places[far], ""
