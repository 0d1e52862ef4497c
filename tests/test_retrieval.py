import numpy as np
import pytest

from reviewlake.operators import retrieval as R

ITEMS = "request_id string, provenance string, score double, path string, line_start int, content_hash string, token_count int, position_hint int"


def pack(spark, rows, budget):
    df = spark.createDataFrame([("q", *r, 0) for r in rows], ITEMS)
    return {r.content_hash: r.position for r in R.enforce_budget(df, budget).collect()}


def test_budget_skips_and_goes_on(spark):
    got = pack(spark, [("graph", 0.9, "b", 1, "big", 100), ("graph", 0.5, "b", 1, "small", 10), ("anchor", 1.0, "a", 1, "anchor", 95), ("graph", 0.4, "b", 1, "tiny", 5)], 110)
    assert got == {"anchor": 1, "small": 2, "tiny": 3, "big": None}


def test_anchors_stay_over_budget_and_ties_are_ordered(spark):
    got = pack(spark, [("anchor", 1.0, "a", 2, "y", 50), ("anchor", 1.0, "a", 1, "x", 80), ("graph", 0.5, "b", 1, "h2", 1), ("graph", 0.5, "b", 1, "h1", 1)], 60)
    assert got == {"x": 1, "y": 2, "h1": None, "h2": None}
    with pytest.raises(ValueError):
        pack(spark, [], 0)
    assert pack(spark, [], 5) == {}


def test_exact_topk_equals_numpy(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 8))
    v[10] = v[20]
    v[30] = 0
    df = spark.createDataFrame([(f"{i:03}", i, "g" if i % 2 else "h", [float(x) for x in v[i]], str(i % 5)) for i in range(60)], "key string, query_id bigint, grp string, embedding array<float>, repo string")
    u = v.astype(np.float32).astype(np.float64)
    n = np.linalg.norm(u, axis=1, keepdims=True)
    u /= np.where(n == 0, 1, n)
    for ex in (None, "repo"):
        got = {}
        for r in R.exact_topk(df, df, 5, "grp", ex, block=7, chunk=11).collect():
            got.setdefault(r.query_id, []).append((r.place, r.key, r.score))
        for q in range(60):
            s = np.round(u @ u[q], 6)
            ok = [i for i in range(60) if i % 2 == q % 2 and (ex is None or i % 5 != q % 5)]
            want = sorted(ok, key=lambda i: (-s[i], i))[:5]
            assert [k for _, k, _ in sorted(got[q])] == [f"{i:03}" for i in want]
    assert R.exact_topk(df, df, 0, "grp").count() == 0


def test_guard(spark):
    asked = spark.createDataFrame([("a", "m"), ("b", "m"), ("c", "m")], "repository_id string, model string")
    serving = spark.createDataFrame([("a", "s", "m"), ("b", "s", "other")], "repository_id string, snapshot_id string, embedding_model string")
    assert {r.repository_id: r.status for r in R.guard(asked, serving).collect()} == {"a": 200, "b": 409, "c": 404}
    with pytest.raises(R.SnapshotNotReady):
        R.check(asked.filter("repository_id = 'c'"), serving)
    with pytest.raises(R.EmbeddingModelMismatch):
        R.check(asked.filter("repository_id = 'b'"), serving)


def test_innermost_and_overlap(spark):
    sym = spark.createDataFrame([("r", "p", "m", 1, 100), ("r", "p", "m.C", 10, 50), ("r", "p", "m.C.f", 20, 30)], "repository_id string, path string, fqn string, line_start int, line_end int")
    spans = spark.createDataFrame([("q", "r", "p", 25, 26), ("q", "r", "p", 45, 60), ("q", "r", "zz", 1, 2)], "request_id string, repository_id string, path string, span_start int, span_end int")
    got = {(r.path, r.span_start): r.symbol_fqn for r in R.innermost(sym, spans).collect()}
    assert got == {("p", 25): "m.C.f", ("p", 45): "m.C", ("zz", 1): None}
    assert R.symbols_in_spans(sym, spans).count() == 3
