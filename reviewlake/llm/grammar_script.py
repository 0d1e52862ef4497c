"""Packrat grammars of JavaScript modules, TypeScript and TSX.

One text gives the three grammars: a line that begins with ``[js]``, ``[ts]`` (TypeScript and TSX), ``[plain]`` (TypeScript
only) or ``[tsx]`` belongs to those languages alone.  Operator precedence does not decide validity, so binary operators
are one flat repetition; what the grammar does keep is where the language draws lines: automatic semicolons, regular
expressions against division, generics against comparison, arrow functions against parentheses, template nesting, JSX text.
"""

from __future__ import annotations

import functools
import re
import string

from .peg import Token, compile_grammar

LETTERS = string.ascii_letters + "_$\\"
TRIVIA = r"(?:[\s\ufeff]+|//[^\n\r\u2028\u2029\x00]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/)*"
# The punctuators of the language, used so that a mark never matches the head of a longer one.
PUNCTUATORS = "{ } ( ) [ ] . ... ; , < > <= >= == != === !== + - * / % ** ++ -- << >> >>> & | ^ ! ~ && || ?? ? ?. : = += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??= => @ #".split()
# Words that cannot be identifiers in a module.
RESERVED = "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
IDENT = r"(?:[^\W\d]|[$\u200c\u200d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$\u200c\u200d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*"
ESC = r"\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|u\{[0-9a-fA-F]{1,6}\}|\r\n|0(?!\d)|[^xu0-9])"


def _literal(text: str) -> str:
    if text[0].isalpha():
        return re.escape(text) + r"(?![\w$\\])"
    if text == "?":
        return r"\?(?!\?|\.(?!\d))"
    longer = sorted({p[len(text):] for p in PUNCTUATORS if p.startswith(text) and p != text}, key=len, reverse=True)
    if text == "?.":
        return r"\?\.(?!\d)"
    return re.escape(text) + (f"(?!{'|'.join(map(re.escape, longer))})" if longer else "")


def _tokens() -> dict[str, Token]:
    t = TRIVIA
    digits = r"\d(?:_?\d)*"
    number = rf"(?:0[xX][\da-fA-F](?:_?[\da-fA-F])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?|(?:(?:0|[1-9](?:_?\d)*)n)|(?:(?:0(?!\d)|[1-9](?:_?\d)*)(?:\.(?:{digits})?)?|\.{digits})(?:[eE][+-]?{digits})?)(?![\w$\\])"
    cls = r"\[(?:[^\]\\\n\r]|\\[^\n\r])*\]"
    return {
        "ID": Token(rf"(?!(?:{'|'.join(RESERVED)})(?![\w$\\])){IDENT}{t}", LETTERS, True),
        "WORD": Token(rf"{IDENT}{t}", LETTERS, True),
        "PRIV": Token(rf"#{IDENT}{t}", "#"),
        "NUM": Token(number + t, string.digits + "."),
        "STR": Token(rf"(?:\"(?:[^\"\\\n\r]|{ESC})*\"|'(?:[^'\\\n\r]|{ESC})*'){t}", "\"'"),
        "XSTR": Token(rf"(?:\"[^\"]*\"|'[^']*'){t}", "\"'"),
        "REGEX": Token(rf"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|{cls})+/(?:[dgimsuvy]*)(?![\w$]){t}", "/"),
        "TSTART": Token(r"`(?:[^`\\$\x00]|\\[^\x00]|\$(?!\{))*", "`"),
        "TSUB": Token(rf"\$\{{{t}", "$"),
        "TMID": Token(r"\}(?:[^`\\$\x00]|\\[^\x00]|\$(?!\{))*", "}"),
        "TEND": Token(rf"`{t}", "`"),
        "XTEXT": Token(r"[^{}<>\x00]+", None),
        "XNAME": Token(rf"{IDENT}(?:-[\w$-]*)*(?::{IDENT}(?:-[\w$-]*)*)?(?:\.{IDENT})*{t}", LETTERS, True),
        "RAWGT": Token(r">", ">"),
        "RAWRB": Token(r"\}", "}"),
        "GT": Token(rf">{t}", ">"),
        "LT": Token(rf"<(?!=){t}", "<"),
        "SKIPWS": Token(t, None),
        "SEMI": Token(rf";{t}", ";"),
        "EOF": Token(r"(?=\x00)", "\x00"),
        # a line break between the last token and this one, or a closing brace, or the end
        "ASI": Token(r"(?=\}|\x00)", "}\x00"),
        "ASSIGNOP": Token(rf"(?:=(?![=>])|\+=|-=|\*\*?=|/=|%=|<<=|>>>?=|&&?=|\|\|?=|\^=|\?\?=){t}", "=+-*/%<>&|^?"),
        "BINOP": Token(rf"(?:\?\?(?!=)|\|\|(?!=)|&&(?!=)|===|!==|==|!=|<=|<<(?!=)|<|>>>(?!=)|>>(?!=)|>=|>|\+(?![+=])|-(?![-=])|\*\*(?!=)|\*(?![*=])|/(?![/*=])|%(?!=)|&(?![&=])|\|(?![|=])|\^(?!=)|(?:instanceof|in)(?![\w$\\])){t}", "?|&=!<>+-*/%^i"),
        "PREOP": Token(rf"(?:\+\+|--|\+(?!=)|-(?!=)|~|!(?!=)|(?:delete|void|typeof|await)(?![\w$\\:])){t}", "+-~!dvta"),
        "HASHBANG": Token(rf"#![^\n\r\x00]*{t}", "#"),
    }


GRAMMAR = r"""
Module <- HASHBANG? Item* EOF
Item <- Import / Export / Stmt
Eos <- SEMI / ASI / Nl
Nl <- NLTEST

Import <- 'import' STR ImpAttr? Eos / 'import' !'(' !'.' ImpClause 'from' STR ImpAttr? Eos
[ts]    / 'import' 'type' ImpClause 'from' STR ImpAttr? Eos / 'import' 'type'? ID '=' ('require' '(' STR ')' / QName) Eos
ImpAttr <- ('with' / 'assert') ObjLit
ImpClause <- '*' 'as' ID / Named / ID (',' ('*' 'as' ID / Named))?
Named <- '{' (Spec (',' Spec)* ','?)? '}'
[js]Spec <- ModName ('as' ModName)?
[ts]Spec <- 'type' ModName 'as' ModName &(',' / '}') / 'type' !'as' ModName &(',' / '}') / ModName ('as' ModName)?
ModName <- WORD / STR
Export <- 'export' ExportBody
[ts]    / Decorators 'export' 'default'? Class
ExportBody <- 'default' (FuncDecl / AsyncFuncDecl / ClassDecl
[ts]    / 'abstract' Class / Interface
    / !('function' / 'class') Assign Eos) / '*' ('as' ModName)? 'from' STR ImpAttr? Eos / Named ('from' STR ImpAttr?)? Eos
[ts]    / 'type' Named ('from' STR ImpAttr?)? Eos / 'type' '*' ('as' ModName)? 'from' STR Eos / '=' Expr Eos / 'as' 'namespace' ID Eos / 'import' ID '=' ('require' '(' STR ')' / QName) Eos
    / Decl
[js]Decl <- FuncDecl / AsyncFuncDecl / ClassDecl / VarDecl Eos
[ts]Decl <- FuncDecl / AsyncFuncDecl / ClassDecl / ConstEnum / VarDecl Eos / Interface / TypeAlias / Enum / 'declare' NoNl Ambient / 'abstract' NoNl Class / Namespace
[ts]Ambient <- 'global' Block / Decl / 'abstract' Class
[ts]ConstEnum <- 'const' Enum
[ts]Enum <- 'enum' ID '{' (EnumMember (',' EnumMember)* ','?)? '}'
[ts]EnumMember <- (WORD / STR / '[' STR ']') ('=' Assign)?
[ts]Interface <- 'interface' NoNl ID TypeParams? ('extends' HeritageType (',' HeritageType)*)? ObjType
[ts]HeritageType <- QName TypeArgs?
[ts]TypeAlias <- 'type' NoNl ID TypeParams? '=' Type Eos
[ts]Namespace <- ('namespace' / 'module') NoNl (QName / STR) ModBlock
[ts]ModBlock <- '{' Item* '}'
NoNl <- !NLTEST
Block <- '{' Item0* '}'
Item0 <- Stmt
Stmt <- Block / EmptyStmt / If / For / While / DoWhile / Try / Switch / Return / Throw / Jump / Debugger / Decl / Labelled / ExprStmt
EmptyStmt <- SEMI
Debugger <- 'debugger' Eos
If <- 'if' '(' Expr ')' Stmt ('else' Stmt)?
For <- 'for' 'await'? '(' ForHead ')' Stmt
ForHead <- ForBind ('of' Assign / 'in' Expr) / LHS ('of' Assign / 'in' Expr) / (VarDecl / Expr)? SEMI Expr? SEMI Expr?
[js]ForBind <- ('var' / 'let' / 'const' / 'using') Binding
[ts]ForBind <- ('var' / 'let' / 'const' / 'using') Binding TypeAnn?
While <- 'while' '(' Expr ')' Stmt
DoWhile <- 'do' Stmt 'while' '(' Expr ')' SEMI?
Try <- 'try' Block (Catch Finally? / Finally)
[js]Catch <- 'catch' ('(' Binding ')')? Block
[ts]Catch <- 'catch' ('(' Binding TypeAnn? ')')? Block
Finally <- 'finally' Block
Switch <- 'switch' '(' Expr ')' '{' Case* '}'
Case <- ('case' Expr / 'default') ':' Item0*
Return <- 'return' (Eos / Expr Eos)
Throw <- 'throw' NoNl Expr Eos
Jump <- ('break' / 'continue') (NoNl ID)? Eos
Labelled <- ID ':' Stmt
ExprStmt <- !('function' / 'class' / '{') !LetBracket Expr Eos
LetBracket <- 'let' '['
VarDecl@ <- ('var' / 'let' &(ID / '[' / '{') / 'const') VarOne (',' VarOne)*
[js]VarOne@ <- Binding ('=' VarValue)?
[ts]VarOne@ <- Binding '!'? TypeAnn? ('=' VarValue)?
VarValue@ <- Assign
Binding <- ID / '[' ArrBind? (',' ArrBind?)* ']' / '{' (ObjBind (',' ObjBind)* ','?)? '}'
ArrBind <- '...' Binding / Binding ('=' Assign)?
ObjBind <- '...' Binding / PropName ':' Binding ('=' Assign)? / ID ('=' Assign)?

[js]FuncDecl@ <- 'function' '*'? ID? Params FnBlock
[ts]FuncDecl@ <- 'function' '*'? ID? TypeParams? Params RetType? (FnBlock / Eos)
AsyncFuncDecl <- 'async' NoNl FuncDecl
FnBlock@ <- Block
[js]Params <- '(' (Param (',' Param)* ','?)? ')'
[js]Param <- '...' Binding / Binding ('=' Assign)?
[ts]Params <- '(' (ThisParam (',' Param)* ','? / Param (',' Param)* ','?)? ')'
[ts]ThisParam <- 'this' TypeAnn?
[ts]Param <- Decorators? (ParamMod &(ID / '[' / '{'))* ('...' Binding TypeAnn? / Binding '?'? TypeAnn? ('=' Assign)?)
[ts]ParamMod <- ('public' / 'private' / 'protected' / 'readonly' / 'override')
[ts]RetType <- ':' (Predicate / Type)
[ts]Predicate <- 'asserts' NoNl ('this' / ID) ('is' Type)? / ('this' / ID) 'is' NoNl Type
[ts]TypeAnn <- ':' Type
Decorators@ <- Decorator+
Decorator <- '@' (ID ('.' WORD)* Args? / '(' Expr ')')

ClassDecl@ <- Decorators? Class
[js]Class@ <- 'class' (!'extends' ID)? ('extends' LHS)? ClassBody
[ts]Class@ <- 'class' (!('extends' / 'implements') ID)? TypeParams? ('extends' LHSNoArgs TypeArgs? )? ('implements' HeritageType (',' HeritageType)*)? ClassBody
[ts]LHSNoArgs <- LHS
ClassBody <- '{' Member* '}'
[js]Member <- SEMI / StaticBlock / Decorators? ('static' !MemberEnd)? (Accessor / Method / 'accessor' NoNl Field / Field)
[ts]Member <- SEMI / StaticBlock / Decorators? (Modifier !MemberEnd)* (IndexSig Eos / Accessor / Method / Field)
[ts]Modifier <- 'public' / 'private' / 'protected' / 'static' / 'abstract' / 'readonly' / 'override' / 'declare' / 'accessor'
[js]MemberEnd <- '(' / '=' / SEMI / '}' / ASI
[ts]MemberEnd <- '(' / '=' / SEMI / '}' / ASI / ':' / '?' / '!' / LT
StaticBlock <- 'static' Block
[js]Accessor@ <- ('get' !MemberEnd ClassName '(' ')' / 'set' !MemberEnd ClassName '(' Param ','? ')') FnBlock
[ts]Accessor@ <- ('get' !MemberEnd ClassName '(' ')' RetType? / 'set' !MemberEnd ClassName '(' Param ','? ')' RetType?) (FnBlock / Eos)
[js]Method@ <- ('async' !MemberEnd NoNl)? '*'? ClassName Params FnBlock
[ts]Method@ <- ('async' !MemberEnd NoNl)? '*'? ClassName ('?' / '!')? TypeParams? Params RetType? (FnBlock / Eos)
[js]Field <- ClassName ('=' Assign)? Eos
[ts]Field <- ClassName ('?' / '!')? TypeAnn? ('=' Assign)? Eos
ClassName <- PRIV / PropName
PropName <- WORD / STR / NUM / '[' Assign ']'

Expr <- Assign (',' Assign)*
Assign <- Arrow / Yield / LHS ASSIGNOP Assign / Cond
Yield <- 'yield' !(':' / '=') ('*' Assign / NoNl !(')' / ']' / '}' / ',' / SEMI / ':') Assign)? !ASSIGNOP
[js]Arrow@ <- 'async' NoNl (Params / ID) NoNl '=>' ArrowBody / ID NoNl '=>' ArrowBody / Params NoNl '=>' ArrowBody
[ts]Arrow@ <- 'async' NoNl (TypeParams? Params RetType? / ID) NoNl '=>' ArrowBody / ID NoNl '=>' ArrowBody / ArrowTypes? Params RetType? NoNl '=>' ArrowBody
[plain]ArrowTypes <- TypeParams
[tsx]ArrowTypes <- LT ('const'? ID ('extends' Type ('=' Type)? ','? / ',')) (TypeParam (',' TypeParam)* ','?)? GT
[ts]ArrowNR <- 'async'? (ID / Params) '=>' ArrowBody
ArrowBody@ <- FnBlock / !'{' Assign
[js]Cond <- Binary ('?' Assign ':' Assign)?
[ts]Cond <- Binary ('?' Assign ':' Assign / '?' (ArrowNR / Cond) ':' Assign)?
[js]Binary <- (PRIV 'in')? Unary (BINOP Unary)*
[ts]Binary <- (PRIV 'in')? Unary (NoNl 'as' Type / NoNl 'satisfies' Type / BINOP Unary)*
[js]Unary <- PREOP Unary / Postfix
[plain]Unary <- PREOP Unary / LT Type GT Unary / Postfix
[tsx]Unary <- PREOP Unary / Postfix
Postfix <- LHS (NoNl ('++' / '--'))?
LHS <- Head Suffix*
Head <- New / 'super' &('(' / '.' / '[') / 'import' '(' Assign (',' Assign)? ','? ')' / 'import' '.' WORD / Primary
[js]New <- 'new' '.' WORD / 'new' NewHead NewSuffix* Args?
[ts]New <- 'new' '.' WORD / 'new' NewHead NewSuffix* (TypeArgs &'(')? Args?
NewHead <- New / Primary / 'import' '.' WORD / 'super' &('.' / '[')
NewSuffix <- '.' (PRIV / WORD) / '[' Expr ']' / Template
[js]Suffix <- '?.' (Args / '[' Expr ']' / Template / PRIV / WORD) / NewSuffix / Args
[ts]Suffix <- '?.' (TypeArgs? Args / '[' Expr ']' / PRIV / WORD) / NewSuffix / Args / TypeArgs &('(' / TSTART) / TypeArgs !(WORD / NUM / STR / '[' / '(' / '{' / '+' / '-' / '!') / NoNl '!'
Args <- '(' (Arg (',' Arg)* ','?)? ')'
Arg <- '...' Assign / Assign
Primary <- FuncExpr / ClassExpr / NUM / STR / REGEX / Template / '[' ArrItems ']' / ObjLit / '(' Expr ')'
[tsx]    / Jsx
    / 'this' / 'null' / 'true' / 'false' / ID
[js]FuncExpr@ <- ('async' NoNl)? 'function' '*'? ID? Params FnBlock
[ts]FuncExpr@ <- ('async' NoNl)? 'function' '*'? ID? TypeParams? Params RetType? FnBlock
ClassExpr <- Decorators? Class
ArrItems <- Arg? (',' Arg?)*
ObjLit <- '{' (Prop (',' Prop)* ','?)? '}'
Prop <- '...' Assign / ObjAccessor / ObjMethod / PropName ':' Assign / ID ('=' Assign)?
[js]ObjAccessor@ <- ('get' !PropEnd PropName '(' ')' / 'set' !PropEnd PropName '(' Param ','? ')') FnBlock
[ts]ObjAccessor@ <- ('get' !PropEnd PropName '(' ')' RetType? / 'set' !PropEnd PropName '(' Param ','? ')') FnBlock
PropEnd <- '(' / ':' / ',' / '}' / '='
[js]ObjMethod@ <- ('async' !PropEnd NoNl)? '*'? PropName Params FnBlock
[ts]ObjMethod@ <- ('async' !PropEnd NoNl)? '*'? PropName TypeParams? Params RetType? FnBlock
Template <- TSTART (TSUB Expr TMID)* TEND

[tsx]Jsx <- JsxEl SKIPWS
[tsx]JsxEl <- '<' GT0 JsxChild* '<' '/' RAWGT / '<' XNAME TypeArgs? JsxAttr* ('/' RAWGT / RAWGT JsxChild* '<' '/' XNAME RAWGT)
[tsx]GT0 <- RAWGT
[tsx]JsxChild <- XTEXT / JsxEl / '{' ('...' Assign / Expr)? RAWRB
[tsx]JsxAttr <- '{' '...' Assign '}' / XNAME ('=' (XSTR / '{' Assign '}' / Jsx))?

[ts]QName <- ID ('.' WORD)*
[ts]TypeParams <- LT TypeParam (',' TypeParam)* ','? GT
[ts]TypeParam <- (('const' / 'in' / 'out') !(',' / GT / 'extends' / '='))* ID ('extends' Type)? ('=' Type)?
[ts]TypeArgs <- LT Type (',' Type)* ','? GT
[ts]Type <- FnType / CtorType / UnionType ('extends' NoCond '?' Type ':' Type)?
[ts]NoCond <- FnType / CtorType / UnionType
[ts]FnType <- TypeParams? Params '=>' (Predicate / Type)
[ts]CtorType <- 'abstract'? 'new' TypeParams? Params '=>' Type
[ts]UnionType <- ('|' / '&')? TypeOp (('|' / '&') TypeOp)*
[ts]TypeOp <- ('keyof' / 'unique' / 'readonly') TypeOpEndNot TypeOp / 'infer' ID ('extends' !('?') TypeOp !'?')? / PostfixType
[ts]TypeOpEndNot <- !(',' / ')' / GT / '|' / '&' / SEMI / '=' / ASI)
[ts]PostfixType <- PrimType (NoNl '[' Type? ']')*
[ts]PrimType <- '(' Type ')' / MappedType / ObjType / TupleType / 'typeof' ('import' '(' STR ')' ('.' WORD)* / ('this' / QName) ('.' WORD)*) TypeArgs? / 'import' '(' STR (',' ObjLit)? ')' ('.' WORD)* TypeArgs? / TmplType / STR / '-'? NUM / 'this' / 'null' / 'true' / 'false' / 'void' / QName (NoNl TypeArgs)?
[ts]TmplType <- TSTART (TSUB Type TMID)* TEND
[ts]TupleType <- '[' (TupleItem (',' TupleItem)* ','?)? ']'
[ts]TupleItem <- '...'? (WORD '?'? ':' Type / Type '?'?)
[ts]MappedType <- '{' (('+' / '-')? 'readonly')? '[' ID 'in' Type ('as' Type)? ']' (('+' / '-')? '?')? TypeAnn? SEMI? '}'
[ts]ObjType <- '{' (TypeMember (SEMI / ',' / ASI / Nl))* '}'
[ts]TypeMember <- 'readonly'? IndexSig / 'new' TypeParams? Params RetType? / ('get' !TypeMemEnd PropName '(' ')' RetType? / 'set' !TypeMemEnd PropName '(' Param ')' RetType?) / ('readonly' !TypeMemEnd)? PropName '?'? (TypeParams? Params RetType? / TypeAnn)? / TypeParams? Params RetType?
[ts]TypeMemEnd <- '(' / ':' / '?' / SEMI / ',' / '}' / LT
[ts]IndexSig <- '[' ID ':' Type ']' TypeAnn?
"""

_BREAK = re.compile(r"[\n\r\u2028\u2029]")


def _text(kind: str) -> str:
    keep = {"js": {"js"}, "ts": {"ts", "plain"}, "tsx": {"ts", "tsx"}}[kind]
    lines = []
    for line in GRAMMAR.splitlines():
        m = re.match(r"\[(\w+)\]", line)
        if m:
            if m[1] not in keep:
                continue
            line = line[m.end():]
        lines.append(line)
    return "\n".join(lines)


@functools.cache
def parser(kind: str):
    """The parser of ``kind`` (js, ts or tsx): ``run(source) -> (end, furthest, hits, ok)``."""
    tokens = _tokens()
    # A line break lies directly before this position: white space and whole comments may stand between.
    tokens["NLTEST"] = Token(r"", None)
    run = compile_grammar(_text(kind), tokens, "Module", TRIVIA, _literal, {"NLTEST": line_break_before})
    return run


def line_break_before(s: str, p: int) -> bool:
    """True if the trivia that ends at ``p`` holds a line break."""
    q = p
    while q:
        c = s[q - 1]
        if c in "\n\r\u2028\u2029":
            return True
        if c.isspace() or c == "\ufeff":
            q -= 1
        elif c == "/" and s.startswith("*/", q - 2):
            start = s.rfind("/*", 0, q - 2)
            if start < 0:
                return False
            if _BREAK.search(s, start, q):
                return True
            q = start
        else:
            return False
    return True
