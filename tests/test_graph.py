import pytest

from reviewlake.operators import graph as G

EDGES = "repository_id string, edge_id bigint, kind string, src_fqn string, dst_fqn string, confidence double, raw string"
SYMBOLS = "repository_id string, symbol_id bigint, fqn string, name string, kind string, parent_fqn string, module string"


def expand(spark, edges, anchors=("a",), **kw):
    e = spark.createDataFrame([("r", i, *x, "clash") for i, x in enumerate(edges)], EDGES)
    a = spark.createDataFrame([("q", "r", x) for x in anchors], "request_id string, repository_id string, fqn string")
    return {r.fqn: r for r in G.expand(a, e, **kw).collect()}


def test_reached_weakly_near_and_strongly_far_counts_once_at_the_nearer_level(spark):
    got = expand(spark, [("imports", "a", "b", 0.5), ("calls", "a", "c", 1.0), ("calls", "c", "b", 1.0)])
    assert got["b"].distance == 1 and got["b"].kind == "imports" and got["c"].reason == "called by a"


def test_direction_self_edges_and_open_ends(spark):
    got = expand(spark, [("calls", "x", "a", 0.8), ("calls", "a", "a", 1.0), ("calls", "a", None, 0.3)])
    assert list(got) == ["x"] and got["x"].inbound and got["x"].reason == "calls a"


def test_tie_goes_to_the_earlier_edge_and_a_hub_is_cut(spark):
    got = expand(spark, [("calls", "a", "b", 0.8), ("calls", "b", "a", 0.8)])
    assert not got["b"].inbound
    hub = expand(spark, [("calls", f"c{i:02}", "a", 0.8) for i in range(50)], depth=1)
    assert sorted(hub) == [f"c{i:02}" for i in range(40)]


def test_other_repositories_and_empty_input(spark):
    e = spark.createDataFrame([("other", 1, "calls", "a", "b", 1.0, "")], EDGES)
    a = spark.createDataFrame([("q", "r", "a")], "request_id string, repository_id string, fqn string")
    assert G.expand(a, e).count() == 0
    assert G.expand(a.limit(0), e.limit(0)).count() == 0
    with pytest.raises(ValueError):
        G.expand(a, e, depth=0)
