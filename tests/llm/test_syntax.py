import ast
import glob
import random
import re
import sys
import textwrap
import warnings

import pytest

from reviewlake.llm import grammar_python, grammar_script, syntax
from reviewlake.llm.peg import Token, compile_grammar

sys.setrecursionlimit(100_000)
SCHEMA = "file_id bigint, repository_id string, path string, content string, is_valid boolean"

VALID = {
    "js": ["", "\n// only a comment", "/re[/]x/g.test(a) ? b / c / d : `a${`n${1}`}b`", "a\n++b\nc", "let x = 1\n;[1].map(f)", "export default class extends A { static #p = 1; get x() { return this.#p } async *g() {} static { f() } }", "for (const [a, {b = 1, ...c}] of d) continue", "if (a) /x/.test(b); else c()", "label: while (1) break label", "import a, { b as c, default as d } from 'x' with { type: 'json' }", "x = async (a, b) => await a ?? b?.[1]?.(2)", "var async = 1; async = 2; get = 3", "export * as ns from 'm'; export { x as 'y' }", "#!/usr/bin/env node\nf()", "const o = { get a() { return 1 }, async b() {}, *c() {}, ['d']: 1, e, ...f, get: 2 }", "do x(); while (0) y()", "const { a } = b, c = 0x1F_n ?? 1_000.5e-3".replace("0x1F_n", "0x1Fn"), "new.target; new Foo; new a.b(c)()", "throw new Error('x')", "a = b ? (c) : d => e"],
    "ts": ["type A<T extends string = 'x'> = { readonly [K in keyof T]?: T[K] } & (B | C)[]", "function f(this: Window, a?: number, ...b: string[]): asserts a is number;\nfunction f(a) {}", "abstract class A<T> extends B<T> implements C, D { private readonly x!: number; constructor(private y = 1) { super() } abstract z(): void; @dec() m<T>(): T { return <T>this.x } }", "const x = y as unknown as T; z!.a!(); w satisfies U", "enum E { A = 1, B, 'c' }\ndeclare module 'm' { export const x: number }", "f<T>(x); a < b > c; new Map<string, Array<number>>()", "let f: (a: number) => string = <T,>(a: T) => 'x'", "type C = A extends infer U ? U : never; type D = typeof import('x'); type T = [a: string, b?: number, ...c: any[]]", "import type { A } from 'x'; import { type B } from 'y'; export type { A }", "interface I extends J<K> { (a: string): void; new (b): I; readonly c?: number; d(): e is string; get f(): g }", "type X = `a${B}c`; let u: unique symbol; declare global { var z: any }", "for (const x of <any>y) {}", "namespace A.B { export const c = 1 }", "export = x", "@a @b.c(1) export class D {}", "const a = b ? (c): d => e : f", "class A { declare x: number; static async *[Symbol.iterator]<T>(this: A): AsyncGenerator<T> {} }"],
    "tsx": ["const a = <div className='x' {...p} b={1}>text {c} <b/> don't // no comment</div>", "const f = <T,>(x: T) => <></>", "return_(<A.B<string> c={<d/>}>{/* e */}</A.B>)"],
}
BROKEN = {
    "js": ["let x: number = 1", "const a = <b/>", "function f( {", "<<<<<<< HEAD\na\n=======\nb\n>>>>>>> x", "x = 'a\nb'", "if (a { }", "class A { foo bar }", "a b", "import { a from 'b'", "x = “a”", "var 1a", "return_ = 010", "{\"a\": 1}", "export const", "/* open", "`open ${a", "new", "a ? b", "for (;;", "with_ = {a b}"],
    "ts": ["const a = <div>x</div>", "type A = ", "interface I { a: }", "enum { A }", "let x: = 1", "def f(x):\n    return x", "function f(a: string { }", "class A { constructor( }"],
    "tsx": ["const a = <div>", "const a = <div></span", "const a = <div b=1/>"],
}


@pytest.mark.parametrize("kind,text", [(k, t) for k, ts in VALID.items() for t in ts])
def test_valid_scripts(kind, text):
    end, far, _, ok = grammar_script.parser(kind)(text)
    assert ok, text[max(0, far - 20) : far + 20]


@pytest.mark.parametrize("kind,text", [(k, t) for k, ts in BROKEN.items() for t in ts])
def test_broken_scripts(kind, text):
    assert not grammar_script.parser(kind)(text)[3]


def test_failure_position_is_the_furthest():
    text = "const a = 1;\nfunction f() {\n  return (a + ;\n}\n"
    assert text[grammar_script.parser("js")(text)[1]] == ";"
    assert syntax.verdict("x.js", text)[2:] == (3, "syntax")


def test_engine_is_linear_in_nesting():
    g = compile_grammar("S <- E !C\nE <- '(' E ')' '!' / '(' E ')' / N\n", {"N": Token("[0-9]", "0123456789"), "C": Token(r"(?!\x00)", None)}, "S", r"\s*", lambda t: "\\" + t)
    assert g("(" * 200 + "1" + ")" * 200)[3]


def test_python_grammar_agrees_with_cpython_on_the_standard_library():
    folder = ast.__file__.rsplit("/", 1)[0]
    files = sorted(glob.glob(f"{folder}/*.py"))[:60] + sorted(glob.glob(f"{folder}/asyncio/*.py"))[:10]
    assert files
    for p in files:
        text = open(p, encoding="utf-8").read()
        assert grammar_python.parse(text)[0], p


@pytest.mark.parametrize("text", ["f(a=1, b)", "f(**a, *b)", "f(a for a in b, c)", "def f(a=1, b): pass", "def f(*): pass", "def f(a, b=1, /, c): pass", "lambda *: 0", "'a' b'b'", "'\\x4'", "b'\\x'", "b'\u00e9'", "'\\N{no such}'", "x = 1.real", "(*a)", "[*a for a in b]", "{**a for a in b}", "a = \\\n", "x = 012", "print 'a'", "def f(:", "if x\n  y", "x = (1", "x = 'a", "  x = 1", "if x:\n  a\n b", "f(a for", "f'{a'", "f'{}'", "a = b c", "class A(", "'''open", "x = 5abc", "def f():\n\treturn\n        x", "import", "else: x", "f() = 1", "lambda: = 2", "match x:\n  case 1 +: pass", "\"a\nb\""])
def test_broken_python(text):
    with pytest.raises((SyntaxError, ValueError)), warnings.catch_warnings():
        warnings.simplefilter("ignore")
        ast.parse(text)
    assert not grammar_python.parse(text)[0]


def test_python_grammar_agrees_with_cpython_on_altered_texts():
    """The verdicts are the same for texts of which tokens were dropped, put in, swapped or cut off."""
    r, marks = random.Random(4), "( ) [ ] { } : , = * ** def class return lambda x 1 's' b'y' for in if else async await not := @ import from as with try: except f'{x}' del ... . ; match case".split()
    texts = [open(p, encoding="utf-8").read() for p in sorted(glob.glob(f"{ast.__file__.rsplit('/', 1)[0]}/*.py"))[:30]]
    for _ in range(1500):
        lines = r.choice(texts).split("\n")
        at = r.randrange(max(1, len(lines) - 40))
        parts = re.findall(r"\w+|\s+|[^\w\s]", textwrap.dedent("\n".join(lines[at : at + 40]))) or ["x"]
        i, j = r.randrange(len(parts)), r.randrange(len(parts))
        kind = r.randrange(4)
        if kind == 0:
            del parts[i]
        elif kind == 1:
            parts.insert(i, r.choice(marks))
        elif kind == 2:
            parts[i], parts[j] = parts[j], parts[i]
        else:
            del parts[i:]
        text = "".join(parts)
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text)
            want = True
        except SyntaxError:
            want = False
        assert grammar_python.parse(text)[0] is want, text


def test_deep_nesting_is_judged_by_the_grammar():
    assert syntax.verdict("a.py", "x = " + "-" * 50_000 + "1")[1] and not syntax.verdict("a.py", "-" * 50_000)[1]


@pytest.mark.parametrize("text", ["self.a: int = 1", "f'{a !r}'", "rf'\\{{\\'{b}'", "f'\\{c}'", "f'\\N{EM DASH}{d}'", "x = 1if y else\"z\"", "f(*a, b=1, *c, **d)", "def f(a, /, b=1, *, c, **d): pass", "lambda a, /, b=1, *c, d: 0", "'a' f'b'", "(*a, b)", "'\\x41\\u00e9\\N{DIGIT ONE}'", "", "# c", "x: int = 1", "async def f[T: int = str](*, a=1, **k) -> T: yield", "match x:\n  case {'a': [1, *_], **r} | P.Q(b=2) as z if z: pass\n  case -1+2j: ...", "with (a as b, c): pass", "try: pass\nexcept* E as e: pass\nelse: pass\nfinally: pass", "f'{a!r:>{w}} {b=} {{}} {d[\"k\"]}'", "x = yield", "a[b:c, ::d, *e] = f if g else lambda *h, i=1: (j := 2)", "type X[T] = list[T]", "@a.b[c]\nclass D(E, metaclass=F): pass", "if 1:\n\tx\nelse:\n\ty\n", "a = \\\n  1", "print(*a, **b)", "for x, *y in z: pass\nelse: pass", "def f(a, /, b, *, c): pass", "match = case = type = 1; match[case] = type(match)", "{**a, 'b': c}; {*d, e}; [x async for x in y if z]", "global_ = not a in b is not c"])
def test_valid_python(text):
    ast.parse(text)
    assert grammar_python.parse(text)[0]


def test_causes():
    assert syntax.verdict("a.ts", "let a = 1\n<<<<<<< HEAD\nlet b\n=======\n>>>>>>> x\n")[1:] == (False, 2, "merge conflict")
    assert syntax.verdict("a.ts", "function f() {\n  a();\n")[3] == "truncated"
    assert syntax.verdict("a.py", "SELECT a FROM b WHERE c;")[3] == "other language"
    assert syntax.verdict("a.md", "<<<") == (None, True, None, None) and syntax.verdict(None, "x") == (None, True, None, None)


def test_dirty_rows(spark):
    rows = [(1, "r", "a.py", "x = (", None), (1, "r", "a.py", "x = (", None), (2, "r", "b.py", None, None), (3, None, "c.js", "a b", None), (4, "r", None, "x = (", None), (5, "r", "d.py", "x = [" + "1, " * 200_000 + "]", None), (6, "r", "e.js", "(" * 3000 + "1" + ")" * 3000, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.file_id for r in syntax.invalid_files(df).collect()) == [1, 3]
    rates = {(r.repository_id, r.language): (r.files, r.invalid, r.rate) for r in syntax.failure_rates(df).collect()}
    assert rates == {("r", "python"): (3, 1, 0.333333), (None, "javascript"): (1, 1, 1.0), ("r", "javascript"): (1, 0, 0.0)}
    assert syntax.invalid_files(df.limit(0)).count() == 0 and syntax.failure_rates(df.limit(0)).count() == 0


def test_rates_count_what_the_grammars_refuse(spark, data):
    files = spark.read.parquet(f"{data}/../sf0.01/source_files.parquet")
    want = {}
    for r in files.select("file_id", "repository_id", "path", "content").distinct().collect():
        language, ok, _, cause = syntax.verdict(r.path, r.content)
        if language:
            n = want.setdefault((r.repository_id, language), {}).setdefault(r.file_id, [])
            n.append(not ok)
    got = {(r.repository_id, r.language): (r.files, r.invalid, r.rate, r.conflicts + r.truncated + r.other_language + r.other_errors) for r in syntax.failure_rates(files).collect()}
    assert got == {k: (len(v), sum(map(any, v.values())), round(sum(map(any, v.values())) / len(v), 6), sum(map(any, v.values()))) for k, v in want.items()}
    bad = {i for v in want.values() for i, x in v.items() if any(x)}
    assert {r.file_id for r in syntax.invalid_files(files).collect()} == bad and bad
