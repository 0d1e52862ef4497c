import pytest

from reviewlake.operators import filters as X

SCHEMA = "path string, size_bytes bigint, content string, exclusion string"


@pytest.mark.parametrize("path,size,content,want", [
    ("a.py", 1, "x\n", "none"), ("a.txt", 1, "", "unsupported_language"), ("node_modules/a.js", 1, "", "vendored"), ("a.py", 1_000_001, "", "too_large"), ("a.py", 1, "x\0y", "binary"),
    ("a.min.js", 1, "x", "minified"), ("a.js", 1, "x" * 201, "minified"), ("a.js", 1, "é" * 101, "minified"), ("a_pb2.py", 1, "x", "generated"), ("a.py", 1, "# @generated\n", "generated"), ("a.py", 1, "\n" * 5000 + "DO NOT EDIT", "none"),
    (None, 1, "x", "unsupported_language"), ("a.py", None, None, "none"), ("a.py", 1, "", "none")])
def test_decisions(spark, path, size, content, want):
    df = spark.createDataFrame([(path, size, content, "clash")], SCHEMA)
    r = X.decide(df).first()
    assert (r.exclusion, r.included) == (want, want == "none")


@pytest.mark.parametrize("path,want", [("tests/a.py", True), ("src/test_a.py", True), ("src/a_test.py", True), ("a.test.ts", True), ("a.spec.tsx", True), ("tests.py", False), ("latest/a.py", False), ("__tests__/b.ts", True)])
def test_tests(spark, path, want):
    assert spark.createDataFrame([(path,)], "path string").select(X.is_test("path")).first()[0] is want


def test_gitignore(spark):
    rules = X.gitignore_rules(["*.log", "!keep.log", "/build", "docs/**/api/", "# c", "", "a?c.py", "[xy].ts"])
    got = {p: spark.createDataFrame([(p,)], "p string").select(X.gitignored("p", rules)).first()[0] for p in ("x.log", "d/keep.log", "build/a", "src/build/a", "docs/v1/api/x", "docs/api/x", "abc.py", "abbc.py", "q/x.ts", "z.ts", "x.logs")}
    assert got == {"x.log": True, "d/keep.log": False, "build/a": True, "src/build/a": False, "docs/v1/api/x": True, "docs/api/x": True, "abc.py": True, "abbc.py": False, "q/x.ts": True, "z.ts": False, "x.logs": False}


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert X.exclusion_counts(X.decide(df)).count() == 0
