from datetime import datetime

from reviewlake.operators import snapshot_diff as D

T = [datetime(2024, 1, n) for n in range(1, 10)]
FILES = "repository_id string, snapshot_id string, path string, blob_sha string, listed_at timestamp_ntz, change_kind string"
SNAPS = "snapshot_id string, repository_id string, ref_name string, status string, created_at timestamp_ntz, path string"


def changes(spark, files, snaps):
    out = D.listing_changes(spark.createDataFrame(files, FILES), spark.createDataFrame(snaps, SNAPS))
    return sorted((r.snapshot_id, r.path, r.change_kind) for r in out.collect())


def snap(i, status="ready", repo="r", ref="main", at=None):
    return (f"s{i}", repo, ref, status, T[at or i], "clash")


def test_all_kinds_over_spellings_corrections_and_unready(spark):
    files = [
        ("r", "s1", "a.py", "AA", T[1], "x"), ("r", "s1", "./b.py", "bb", T[1], "x"), ("r", "s1", "gone.py", "11", T[1], "x"), ("r", "s1", "null.py", None, T[1], "x"),
        ("r", "s2", "zzz.py", "zz", T[2], "x"),  # failed: must not count
        ("r", "s3", ".\\a.py", "aa", T[3], "x"), ("r", "s3", "b.py", "bb", T[3], "x"), ("r", "s3", "b.py", "b2", T[4], "x"), ("r", "s3", "b.py", "b2", T[4], "x"),
        ("r", "s3", "././new\\x.py", "nn", T[3], "x"), ("r", "s3", "null.py", "99", T[3], "x"), ("r", "s3", None, "99", T[3], "x"), ("r", "s3", "A.py", "aa", T[3], "x"),
    ]
    snaps = [snap(1), snap(1), snap(2, "failed"), snap(3), snap(4, repo="q")]
    assert changes(spark, files, snaps) == [("s3", "A.py", "added"), ("s3", "b.py", "modified"), ("s3", "gone.py", "removed"), ("s3", "new/x.py", "added")]


def test_empty_snapshot_removes_all_and_tie_goes_by_id(spark):
    files = [("r", "s1", "a", "1", T[1], "x")]
    assert changes(spark, files, [snap(1, at=1), snap(2, at=1)]) == [("s2", "a", "removed")]


def test_empty_tables(spark):
    assert changes(spark, [], []) == []
    assert changes(spark, [], [snap(1), snap(2)]) == []


def test_diff_keeps_nulls_apart_and_ignores_clashing_columns(spark):
    old = spark.createDataFrame([("a", "1", None, 5), ("b", "", "x", 5), (None, "9", "9", 5)], "k string, u string, v string, _new int")
    new = spark.createDataFrame([("a", "1", "", 6), ("b", "", "x", 6), ("c", "1", None, 6)], "k string, u string, v string, _new int")
    got = sorted((r.k, r.change_kind) for r in D.diff(new, old, ["k"], ["u", "v"]).collect())
    assert got == [("a", "modified"), ("c", "added")]
    assert [r.k for r in D.diff(new, old, ["k"], ["u", "v"], unknown_is_equal=True).collect()] == ["c"]


def test_row_hash_separates_concatenations(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c")], "x string, y string").select(D.row_hash("x", "y").alias("h"))
    assert df.distinct().count() == 2
