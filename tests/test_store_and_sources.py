import subprocess

from pyspark.sql import functions as F

from reviewlake.operators import chunking, parsing, store
from reviewlake.sources import listing
from reviewlake.streaming import events as E


def test_snapshot_is_read_only_when_ready_and_only_by_its_owner(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    store.write_snapshot({"files": df}, root, "r1", "s1")
    store.write_snapshot({"files": df.limit(0)}, root, "r1", "s2")
    df.write.parquet(f"{root}/files/repository_id=r1/snapshot_id=s3")  # never made ready
    assert store.read_snapshot(spark, root, "files", "r1", "s1").count() == 1
    assert store.read_snapshot(spark, root, "files", "r1", "s3").count() == 0
    assert store.read_snapshot(spark, root, "files", "r2", "s1").count() == 0


def test_upsert_keeps_what_was_paid_for(spark):
    old = spark.createDataFrame([("a", [1.0]), ("b", None), ("c", [3.0])], "h string, v array<float>")
    new = spark.createDataFrame([("a", None), ("b", [2.0]), ("d", None)], "h string, v array<float>")
    got = {r.h: (r.v, r.change) for r in store.upsert(old, new, ["h"], ["v"]).collect()}
    assert got == {"a": ([1.0], "reused"), "b": ([2.0], "filled"), "c": ([3.0], "kept"), "d": (None, "inserted")}


def test_first_by_key_and_batches(spark):
    df = spark.createDataFrame([("k", 2), ("k", 1), ("k", 1), ("m", 5)], "k string, n int")
    assert sorted((r.k, r.n) for r in store.first_by_key(df, ["k"], ["n"]).collect()) == [("k", 1), ("m", 5)]
    assert sorted(r.batch_no for r in store.batches(spark.range(130).withColumn("g", F.lit(1)), ["g"], ["id"]).select("batch_no").distinct().collect()) == [0, 1, 2]


def test_container_chunk_leaves_its_members_out(spark):
    s = spark.createDataFrame([(1, "r", "a.py", "m.C", "C", "class", 1, 5, None), (1, "r", "a.py", "m.C.f", "f", "method", 3, 4, "m.C"), (1, "r", "a.py", "m.e", "e", "function", 40, 50, None)], "file_id bigint, repository_id string, path string, fqn string, name string, kind string, line_start int, line_end int, parent_fqn string")
    f = spark.createDataFrame([(1, "class C:\r\n  x = 1  \r\n  def f(self):\r\n    pass\r\n\r\n")], "file_id bigint, content string")
    got = {r.fqn: r.body for r in chunking.symbol_chunks(s, f).collect()}
    assert got == {"m.C": "class C:\n  x = 1", "m.C.f": "  def f(self):\n    pass"}


def test_python_parser():
    module, symbols, imports, refs = parsing.parse("a/b.py", "import os\nfrom .x import y as z\nclass A(Base):\n    def f(self):\n        self.g()\n        t = Thing()\n        t.run()\n\ndef h(x: int):\n    return os.path.join(x)\n")
    assert module == "a.b" and [(s[0], s[2]) for s in symbols[1:]] == [("a.b.A", "class"), ("a.b.A.f", "method"), ("a.b.h", "function")]
    assert imports == [("os", "os", None, False, 0, 1), ("z", "x", "y", True, 1, 2)]
    assert ("inherits", "Base", "a.b.A", 3, None, None) in refs and ("calls", "g", "a.b.A.f", 5, "self", None) in refs and ("calls", "run", "a.b.A.f", 7, "t", "Thing") in refs
    assert parsing.parse("x.py", "def broken(:\n")[1][1][1] == "broken"
    assert parsing.parse("x.txt", "") is None and parsing.parse(None, None) is None


def test_script_parser():
    src = "import { a as b } from './m';\nexport class K extends L {\n  go(x: number): void { this.stop(); }\n}\nexport const f = (x) => { g(x); };\nconst s = 'function fake() {}';\n"
    module, symbols, imports, refs = parsing.parse("p/q.ts", src)
    assert [(s[0], s[2]) for s in symbols] == [("p/q", "module"), ("p/q::K", "class"), ("p/q::K.go", "method"), ("p/q::f", "function")]
    assert imports == [("b", "./m", "a", True, 0, 1)] and ("inherits", "L", "p/q::K", 2, None, None) in refs and any(r[1] == "g" and r[2] == "p/q::f" for r in refs)


def test_script_signatures_are_whole():
    args = ", ".join(f"argument{i}: Map<string, {{ a: number }}>" for i in range(40))
    union = " | ".join(f'"value {i};"' for i in range(60))
    heads = [f"function f({args}): {{ b: T }} | Array<() => void>", f"export class K<T extends {{ a: 1 }}> extends L<{args}>", f"const g = async ({args.replace('{ a: number }', 'X')}) =>", f"type A = {union};", "type B = { a: string; b: () => void };"]
    src = f"{heads[0]} {{ return 1; }}\n{heads[1]} {{\n  go() {{}}\n}}\n{heads[2]} {{ g(); }}\n{heads[3]}\n{heads[4]}\ntype C =\n  | 'x' // first\n  | 'y'\nconst h = x => x < 1\ndeclare function o(a: {{ c: 1 }}): string\ninterface I extends J<{{ d: 1 }}> {{ e: 1 }}\n"
    got = {x[1]: x[5] for x in parsing.parse("q.ts", src)[1]}
    assert [got[n] for n in "fKgAB"] == heads
    assert [got[n] for n in "ChoI"] == ["type C = | 'x' // first | 'y'", "const h = x => x < 1", "declare function o(a: { c: 1 }): string", "interface I extends J<{ d: 1 }>"]


def test_git_and_tree_listing(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.py").write_text("x = 1\n")
    (tmp_path / "b.ts").write_text("")
    run("add", ".")
    run("-c", "user.name=t", "-c", "user.email=t@t", "commit", "-qm", "m")
    listing.register(spark)
    read = lambda **o: spark.read.format("git").options(**o)
    df = read(content="true", slice_files="1").load(str(tmp_path))
    assert {r.path: (r.size_bytes, r.content) for r in df.collect()} == {"d/a.py": (6, "x = 1\n"), "b.ts": (0, "")} and df.rdd.getNumPartitions() == 2
    assert {r.path: (r.size_bytes, r.content) for r in read().load(str(tmp_path)).collect()} == {"d/a.py": (6, None), "b.ts": (0, None)}
    url, cache = f"file://{tmp_path}/.git", str(tmp_path / "clones")
    for _ in range(2):
        assert sorted(r.path for r in read(url=url, cache=cache).load().collect()) == ["b.ts", "d/a.py"]
    assert len(list((tmp_path / "clones").iterdir())) == 1
    tree = {r.path: r.size_bytes for r in listing.list_tree(spark, str(tmp_path / "d")).collect()}
    assert tree == {"a.py": 6}
    assert listing.entries(b"blob aa 12 a b\x00commit bb - sub\x00blob cc - \xff\x00") == [("a b", "aa", 12), ("\\xff", "cc", 0)]
    assert listing.slug("https://x.example/o/re po.git/").startswith("re_po-") and listing.slug("a") != listing.slug("b")
    files = spark.createDataFrame([(".gitignore", "a/\n*.log"), ("d/.gitignore", "x")], "path string, content string")
    assert listing.root_ignore_rules(files) == ["a/", "*.log"] and listing.root_ignore_rules(files.limit(0)) == []


def test_stream_drops_redelivery_and_goes_on_where_it_ended(spark, tmp_path):
    base = "event_id bigint, ts timestamp, event_type string, value double, k string"
    row = lambda i, k: (i, __import__("datetime").datetime(2024, 1, 1, 0, i), "x", 1.0, k)
    spark.createDataFrame([row(1, "a"), row(2, "a"), row(3, "b")], base).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(base).parquet(str(tmp_path / "in"))
    once = E.drain(E.without_redelivery(stream(), "k"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(r.k for r in once.collect()) == ["a", "b"]
    spark.createDataFrame([row(4, "b"), row(5, "c")], base).write.mode("append").parquet(str(tmp_path / "in"))
    again = E.drain(E.without_redelivery(stream(), "k"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(r.k for r in again.collect()) == ["a", "b", "c"]


def test_incremental_index(spark, tmp_path):
    schema = "path string, blob_sha string"
    for n, rows in enumerate(([("a", "1"), ("b", "1")], [("b", "2"), ("c", "1")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        E.index_incrementally(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), *(str(tmp_path / x) for x in ("state", "out", "ck")))
    got = sorted((r.batch_id, r.path, r.change_type) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0, "a", "added"), (0, "b", "added"), (1, "a", "removed"), (1, "b", "modified"), (1, "c", "added")]
