import pytest

from reviewlake.llm import doc_pairs, origin
from reviewlake.llm.functions_docs import documented
from reviewlake.llm.layout import Layout, by_layout, lay_out
from reviewlake.llm.layout import origin as why
from reviewlake.llm.substance import has_substance

SCHEMA = "file_id bigint, repository_id string, path string, content string, has_substance boolean, name string"


@pytest.mark.parametrize("doc,name,want", [
    ("Rebuild the index when a shard is lost.", "sync", True), ("", "f", False), (None, "f", False), ("...", "f", False), ("--------", "f", False), ("TODO: describe what this does", "f", False), ("TBD.", "f", False), ("{@inheritDoc}", "f", False),
    ("See above.", "f", False), ("Same as `other`.", "f", False), ("noqa", "f", False), ("eslint-disable-next-line no-console", "f", False), ("type: ignore", "f", False), ("@param x\n@returns", "f", False), (":param x:\n:returns:", "f", False), ("Args:\n    x:", "f", False),
    ("Copies the window", "copyWindow", False), ("Function to parse a basket", "parse_basket", False), ("This function is used to prune the edge.", "pruneEdge", False), ("GET USER", "get_user", False), ("Init.", "__init__", False), ("Lorem ipsum.", "f", False), ("_summary_", "f", False),
    ("Docstring goes here.", "f", False), ("Auto-generated method stub.", "f", False), ("Gets the user from the cache, or the store if it is cold.", "getUser", True), ("Merge rows.\n@example\n  f(x)\nTODO: tune", "f", True), ("@param a The account whose rows are merged\n@returns nothing", "f", True),
    ("Der Abgleich sperrt jede zweite Zeile der Liste.", "f", True), ("Raises if the width is wrong. TODO: test", "f", True), ("TODO", "todo_list", False)])
def test_substance(doc, name, want):
    assert has_substance(doc, name) is want


def test_python_functions():
    src = '@d\nasync def a(x):\n    """Doc of a."""\n\nclass K(B):\n    def m(self):\n        # remark\n        """Doc of m."""\n        def inner():\n            "Doc of inner."\n    def n(self):\n        x = 1\n        """not a docstring"""\n    def o(self): f"""not one {x}"""\n'
    got = {d.name: (d.line_start, d.kind, d.owner, d.doc) for d in documented("x.py", src)}
    assert got == {"a": (2, "function", None, "Doc of a."), "m": (6, "method", "K", "Doc of m."), "inner": (9, "function", None, "Doc of inner."), "n": (11, "method", "K", None), "o": (14, "method", "K", None)}


def test_script_functions():
    src = """/** file */
import x from 'y';

/** Doc of a. */
export async function a() {}
/** Doc of b. */
@dec()
export default class B extends C<D> {
  /** Doc of m. */
  @memo(1)
  public static m(): void {}
  /** far */

  // a remark between
  n() {}
  /** Doc of g. */
  get g(): number { return 1; }
  /** abstract */
  h(): void;
  /** Doc of ctor. */
  constructor() { super(); }
}
/** Doc of c. */
export const c = <T>(x: T): T => { return x; };
/** Doc of d. */
const d = function () {};
/** let */
let e = () => 1;
const s = `/** fake */ function t() {}`;
interface I { /** member */ z(): void; }
/* plain */
function p() {}
"""
    got = {d.name: (d.line_start, d.doc and d.doc.strip()) for d in documented("x.ts", src)}
    assert got == {"a": (5, "Doc of a."), "m": (11, "Doc of m."), "n": (15, None), "g": (17, "Doc of g."), "constructor": (21, "Doc of ctor."), "c": (24, "Doc of c."), "d": (26, "Doc of d."), "p": (32, None)}
    assert next(d for d in documented("x.ts", src) if d.name == "m").bases == ["C"]


def test_script_functions_behind_long_annotations():
    doc, long = "/** Reads the rows of a shard. */\n", " | ".join(f"'value={i}'" for i in range(300))
    src = f"{doc}const a: (x: {long}) => void = (x) => {{}};\n{doc}export{' ' * 300}const b = async () => 1;\n{doc}const c = d = () => 1;\n{doc}const e = f(() => 1);\n{doc}const {{ g }} = function () {{}};\n"
    assert [(d.name, d.line_start, d.doc) for d in documented("x.ts", src)] == [("a", 2, " Reads the rows of a shard. "), ("b", 4, " Reads the rows of a shard. ")]


def test_inherited_documentation_climbs(spark):
    base = 'class A:\n    def f(self):\n        """Reads the rows that nobody has claimed yet."""\n\nclass B(A):\n    def f(self):\n        """See above."""\n\nclass C(m.B):\n    def f(self):\n        pass\n    def g(self):\n        pass\n'
    df = spark.createDataFrame([(1, "r", "a.py", base, None, "x"), (1, "r", "a.py", base, None, "x"), (2, "q", "a.py", "class C(B):\n    def f(self): pass\n", None, "x"), (3, "r", "b.py", None, None, "x"), (4, "r", "c.py", "def f(:", None, "x")], SCHEMA)
    got = sorted((r.file_id, r.owner, r.name, r.doc_source) for r in doc_pairs.function_doc_pairs(df).collect())
    assert got == [(1, "A", "f", "own"), (1, "B", "f", "inherited"), (1, "C", "f", "inherited")]
    assert [(r.file_id, r.line_start) for r in doc_pairs.found(df).collect()] == [(1, 2)]
    assert doc_pairs.function_doc_pairs(df.limit(0)).count() == 0


def test_inherited_documentation_passes_classes_without_methods_and_any_depth(spark):
    base = 'class A:\n    def f(self):\n        """Reads the rows that nobody has claimed yet."""\n'
    chain = "".join(f"class K{i}({'A' if i == 0 else f'K{i - 1}'}): {'pass' if i < 9 else 'f = 1'}\n" for i in range(10)) + "class Z(K9):\n    def f(self): pass\n    def g(self): pass\n"
    ring = "class P(Q): pass\nclass Q(P): pass\nclass R(Q):\n    def f(self): pass\n"
    near = 'class N(A):\n    def f(self):\n        """Writes the rows that were claimed by a worker."""\nclass M(A): pass\nclass O(M, N):\n    def f(self): pass\nclass S(O): pass\nclass T(S, A):\n    def f(self): pass\n'
    script = "class V extends A {}\nclass W extends V { f() {} }\n"
    df = spark.createDataFrame([(i, "r", p, c, None, "x") for i, (p, c) in enumerate([("a.py", base), ("b.py", chain), ("c.py", ring), ("d.py", near), ("e.ts", script)])], SCHEMA)
    got = {(r.file_id, r.line_start): r.docstring.split()[0] for r in doc_pairs.function_doc_pairs(df).filter("doc_source = 'inherited'").collect()}
    assert got == {(1, 12): "Reads", (3, 6): "Writes", (3, 9): "Reads", (4, 2): "Reads"}


def test_found_takes_the_nearest_documentation(spark):
    doc = "/** Reads the rows that nobody has claimed yet. */"
    base, below = f"class A {{\n {doc}\n f() {{}}\n}}\n", f"class C extends B {{\n f() {{}}\n {doc}\n g() {{}}\n}}\n"
    line = f"class D {{ set x(v) {{}} {doc} get x() {{ return 1; }} }}\n"
    df = spark.createDataFrame([(i, "r", f"{i}.js", c, None, "x") for i, c in enumerate([base, "class B extends A {}\n", below, line])], SCHEMA)
    found = doc_pairs.found(df)
    assert sorted(tuple(r) for r in found.collect()) == [(0, 3), (2, 4), (3, 1)]
    assert sorted((r.file_id, r.line_start, r.doc_source) for r in doc_pairs.function_doc_pairs(df).collect()) == [(0, 3, "own"), (2, 2, "inherited"), (2, 4, "own"), (3, 1, "own")]
    # the climb decides which documentation is nearest, so it stays in the plan
    assert "Join" in found._jdf.queryExecution().optimizedPlan().toString()


HAND = 'import re\n\ndef load(path, limit=10):\n    """Reads a file."""\n    with open(path) as handle:\n        rows = [x.strip() for x in handle if x]\n    if len(rows) > limit:\n        raise ValueError(path)\n    return rows\n'
MINI = "".join(f"var a{i}=1,b=[{i},2];function f{i}(x){{return x.y({i})}}if(a>1){{b=a.c}}" for i in range(20))


@pytest.mark.parametrize("path,text,want", [
    ("src/a.py", HAND, None), ("src/vendor/a.py", HAND, "vendored"), ("node_modules/x/a.js", "f()", "vendored"), ("src/lib/ext/tool-1.2/a.py", HAND, "vendored"), ("src/vendor_list.py", HAND, None), ("src/a_pb2.py", HAND, "generated"), ("a.gen.ts", "f()", "generated"),
    ("a.py", "# Code generated by tool 1.0. DO NOT EDIT.\n" + HAND, "generated"), ("a.py", HAND + "\n# @generated by tool\n", "generated"), ("a.py", HAND + '\nBANNER = "@generated, DO NOT EDIT"\n', None), ("a.py", "# The listing is generated by the worker; edit the rules here by hand.\n" + HAND, None),
    ("a.py", "# somelib v1.2.3\n# (c) 2012 the somelib authors, released under the MIT license\n" + HAND, "vendored"), ("a.js", MINI, "minified"), ("a.min.js", MINI, "minified"),
    ("a.py", "\n".join(f'W_{i} = "{"Qz9+" * 20}"' for i in range(20)), "data"), ("a.py", 'B = "' + "A9z/" * 200 + '"\n', "data"), ("a.py", "a;b;c\n" + "\n".join(f"{i};x y;{i}" for i in range(20)), "data"), ("a.ts", '{"rows": [' + ", ".join(f'{{"id": {i}}}' for i in range(20)) + "]}", "data"),
    ("a.ts", "\n".join(f"export const F_{i} = [{i}, {i + 1}];" for i in range(40)), "generated"), ("a.py", "\n".join(f"from m{i} import x{i}" for i in range(40)), None), ("a.py", "", None), ("a.py", " \n\t", None), (None, HAND, None), ("a.py", None, None),
    ("a.ts", 'const help = "' + "this explains the tool in words. " * 30 + '";\nf(help);\n', None)])
def test_origin(path, text, want):
    assert why(path, text) == want


def test_origin_rows(spark):
    df = spark.createDataFrame([(1, "r", "node_modules/a.js", "f()", None, "x")] * 2 + [(2, "r", "a.py", None, None, "x"), (3, "r", None, None, None, "x")], SCHEMA)
    assert [r.file_id for r in origin.not_hand_written(df).collect()] == [1]
    assert origin.not_hand_written(df.limit(0)).count() == 0


def test_canonical_layout():
    lines = lambda script, text: ["".join(t for _, t in x) for x in Layout(script, text).canonical]
    assert lines(True, "if(a>1){b=2;c([1,2]);}else{d()}") == ["if(a>1){", "b=2;", "c([1,2]);", "}else{", "d()", "}"]
    assert lines(False, "a=1;b=2\nif a: b(x[1:2], lambda y: 1)\n") == ["a=1;", "b=2", "ifa:", "b(x[1:2],lambday:1)"]
    wide = Layout(False, "x = [" + ", ".join(["12345678"] * 60) + "]\n")
    assert 5 <= len(wide.canonical) <= 8 and wide.tightness() == 0
    assert Layout(True, "a=1;" * 30).tightness() == 1 and Layout(True, "").expansion() == 0


NAMES = "merge split trim load".split()


@pytest.mark.parametrize("path,text,want", [
    ("a.js", "".join(f"function {n}{i}(a){{if(a>{i}){{b=a}}return b}}" for i in range(8) for n in NAMES), "minified"),
    ("a.py", "\n".join(f"a{i}=1;b{i}=2;c{i}=[a{i},b{i}];d{i}=f(a{i},b{i})" for i in range(12)), "minified"),
    ("a.py", "".join(f"class M{i}(Message):\n    FIELD = {i}\n    slots = ('f', 'g')\n\n" for i in range(6)), "generated"),
    ("a.ts", "".join(f"export class M{i} extends Message {{\n  f = undefined;\n}}\n" for i in range(6)), "generated"),
    ("a.js", "module.exports = [\n" + "".join("0x1f, " * 16 + "\n" for _ in range(12)) + "];\n", "data"),
    ("a.py", "RATES = {\n" + "".join(f'    "{n}{i}": {i},  # since the {n} of last year\n' for i in range(9) for n in NAMES) + "}\n", None),
    ("a.py", "".join(f"def {n}(a, b={i}):\n    if a > {i}:\n        return {n}_all(a)\n    return b\n\n\n" if i % 2 else f"def {n}(a):\n    for x in a:\n        yield x\n\n\n" for i, n in enumerate(NAMES)), None),
    ("a.py", "".join(f"from app.{n} import x{i}\n" for i in range(8) for n in NAMES), None)])
def test_layout_alone(path, text, want):
    assert by_layout(path, text, lay_out(path, text)) == want
