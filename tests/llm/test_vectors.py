import numpy as np
import pytest

from reviewlake.llm import graph_knn
from reviewlake.llm.graph import Graph

SCHEMA = "vector_id bigint, repository_id string, content_hash string, embedding_model string, embedding array<float>, id int, task string"


def frame(spark, rows):
    return spark.createDataFrame([(i, "r", "h", m, None if v is None else [float(x) for x in v], 0, "x") for i, m, v in rows], SCHEMA)


def brute(rows, widths, k):
    out = set()
    for model, w in widths.items():
        ok = {i: np.asarray(v, np.float32).astype(float) for i, m, v in rows if m == model and v is not None and len(v) == w and np.isfinite(v).all() and np.any(v)}
        ids = sorted(ok)
        if not ids:
            continue
        u = np.array([ok[i] / np.linalg.norm(ok[i]) for i in ids])
        for a, i in enumerate(ids):
            s = np.round(u @ u[a], 6)
            for b in sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-s[b], ids[b]))[:k]:
                out.add((min(i, ids[b]), max(i, ids[b])))
    return out


def test_recall_of_the_graph():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got, _ = Graph(x, 24, 40).search(x[:300].astype(np.float32), 40, 11)
    s = x[:300] @ x.T
    s[np.arange(300), np.arange(300)] = -2
    want = np.argsort(-s, axis=1)[:, :10]
    assert np.mean([len(set(want[i]) & set(got[i].tolist())) / 10 for i in range(300)]) >= 0.9


def test_dirty_vectors_ties_and_hot_groups(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "m", rng.normal(size=6)) for i in range(1, 120)]
    rows += [(200 + i, "m", np.ones(6)) for i in range(60)]  # a third is one vector
    rows += [(300, "m", None), (301, "m", np.zeros(6)), (302, "m", np.ones(5)), (303, "m", [np.nan] * 6), (304, "m", [np.inf] * 6), (5, "m", rows[4][2]), (400, "n", [1, 0]), (401, "n", [0, 1]), (500, None, np.ones(6))]
    df = frame(spark, rows)
    got = {(r.vector_id_a, r.vector_id_b) for r in graph_knn.neighbour_pairs(df, 10, {"m": 6, "n": 2}).collect()}
    want = brute(rows, {"m": 6, "n": 2}, 10)
    assert len(got & want) / len(want) >= 0.98 and len(got & want) / len(got) >= 0.98
    assert {p for p in got if p[0] >= 200} == {p for p in want if p[0] >= 200}
    assert (400, 401) in got


@pytest.mark.parametrize("hot", [False, True])
def test_many_shards_find_nearly_all(spark, monkeypatch, hot):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 16))[rng.integers(0, 60, 2400)] + rng.normal(size=(2400, 16)) * 0.3
    if hot:  # a third lies close around one direction, and graphs are built for few queries at a time
        x[:800] = np.ones(16) + rng.normal(size=(800, 16)) * 0.01
        monkeypatch.setattr(graph_knn, "QUERIES_A_TASK", 300)
    points = spark.createDataFrame([("m", i, [float(y) for y in v]) for i, v in enumerate(x)], "embedding_model string, id bigint, embedding array<float>")
    got = {r.id: [c.id for c in r.near] for r in graph_knn.nearest(points, 10, shard=100).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = u @ u.T
    np.fill_diagonal(score, -2)
    want = np.argsort(-score, axis=1)[:, :10]
    assert len(got) == 2400 and all(len(set(v)) == len(v) == 10 and i not in v for i, v in got.items())
    assert np.mean([len(set(want[i]) & set(got[i])) / 10 for i in range(2400)]) >= 0.9


def test_scaled_copies_are_one_point(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=8).astype(np.float32)
    rows = [(i, "m", base * np.float32(1 + i / 7)) for i in range(1, 80)] + [(100 + i, "m", rng.normal(size=8)) for i in range(40)]
    got = {(r.vector_id_a, r.vector_id_b) for r in graph_knn.neighbour_pairs(frame(spark, rows), 10, {"m": 8}).collect()}
    assert {p for p in got if p[1] < 100} == {p for p in brute(rows, {"m": 8}, 10) if p[1] < 100}


def test_width_by_majority_and_few_or_no_rows(spark):
    df = frame(spark, [(1, "m", [1, 2]), (2, "m", [2, 1]), (3, "m", [1, 2, 3])])
    assert [(r.vector_id_a, r.vector_id_b) for r in graph_knn.neighbour_pairs(df).collect()] == [(1, 2)]
    assert graph_knn.neighbour_pairs(df.limit(0), widths={"m": 2}).count() == 0
    assert graph_knn.neighbour_pairs(df.filter("vector_id = 1"), widths={"m": 2}).count() == 0


@pytest.mark.parametrize("n", [1, 2, 17, 600])
def test_small_graphs(n):
    x = np.random.default_rng(n).normal(size=(n, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got, _ = Graph(x, 8, 16).search(x.astype(np.float32), 16, 3)
    assert (got[:, 0] == np.arange(n)).mean() >= 0.98
