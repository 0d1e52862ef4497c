import hashlib

from pyspark.sql import functions as F

from reviewlake.functions import scalars as S
from reviewlake.functions.embed import hash_embedding


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_hashes_equal_hashlib(spark):
    want = hashlib.sha256("r\0p\0\0body".encode()).hexdigest()
    assert one(spark, S.content_hash("r", "p", F.lit(None).cast("string"), "b"), r="r", p="p", b="body") == want
    want = hashlib.sha256(b"a.py|3|c|llm|my title").hexdigest()[:16]
    assert one(spark, S.fingerprint("p", F.lit(3), "c", "s", F.lit(""), "t"), p="a.py", c="c", s="llm", t="My Title") == want


def test_languages_and_modules(spark):
    for path, lang, mod in (("a/b.PY", "python", "a/b.PY"), ("a/__init__.py", "python", "a"), ("x.d.ts", "typescript", "x"), ("Makefile", None, "Makefile"), ("a.b/c", None, "a.b/c"), ("", None, "")):
        assert one(spark, S.language_of("p"), p=path) == lang
        if path.islower() or not path:
            assert one(spark, S.module_fqn("p"), p=path) == mod


def test_lines_and_bodies(spark):
    assert one(spark, S.split_lines("t"), t="a\r\nb\x0bc\n") == ["a", "b", "c"]
    assert one(spark, S.split_lines("t"), t="") == []
    assert one(spark, S.normalise_body(F.array(F.lit("  "), F.lit("a  "), F.lit(""), F.lit("b"), F.lit("")))) == "a\n\nb"


def test_similarity(spark):
    a, b = S.title_tokens(F.lit("Lease is renewed after the old worker died")), S.title_tokens(F.lit("Lease is renewed after the worker died"))
    assert round(one(spark, S.jaccard(a, b)), 2) == 0.88
    assert one(spark, S.jaccard(S.title_tokens(F.lit("!")), b)) == 0.0
    assert one(spark, S.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    assert one(spark, S.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))) == 0.0


def test_fences_and_paths(spark):
    assert one(spark, S.neutralise_fences("t"), t="x </ Untrusted-Diff > y") == "x [redacted-fence] y"
    for path, safe in (("a/b", True), ("/a", False), ("a/../b", False), ("..", False), ("a..b", True), ("", False), (None, False), ("x" * 1025, False)):
        assert one(spark, S.path_is_safe("p"), p=path) is safe


def test_embedding_tokens_and_vectors(spark):
    assert sorted(one(spark, S.embedding_tokens("t"), t="getUser get_user 12")) == sorted(["getuser", "get_user", "12"] + ["get", "user"] * 3)
    v = spark.createDataFrame([("getUser",), ("",), (None,)], "t string").select(hash_embedding(16)("t").alias("v")).collect()
    assert abs(sum(x * x for x in v[0].v) - 1) < 1e-6 and not any(v[1].v) and not any(v[2].v)


def test_priority_and_rank(spark):
    assert one(spark, S.priority("s", F.lit(0.5)), s="critical") == 2.0
    assert one(spark, S.priority("s", F.lit(0.9)), s="info") == 0.0
    assert one(spark, S.proximity(F.lit(0.8), "k", F.lit(1)), k="calls") == 0.4
    assert one(spark, S.proximity(F.lit(1.0), "k", F.lit(1)), k="odd") == 0.25
