"""Packs from spans to budget, labels and their scores, and the small operators beside them."""

import numpy as np
from pyspark.sql import functions as F

from reviewlake.functions.embed import letter_counts
from reviewlake.operators import evaluate as E
from reviewlake.operators import retrieval as R
from reviewlake.operators import review as V
from reviewlake.operators import store
from reviewlake.streaming import events as S

SYMBOLS = "repository_id string, path string, fqn string, line_start int, line_end int, extra int"
CHUNKS = "repository_id string, fqn string, path string, line_start int, content_hash string, token_count int, body string, extra int"
EDGES = "repository_id string, edge_id int, kind string, src_fqn string, dst_fqn string, confidence double, extra int"
SPANS = "request_id bigint, repository_id string, path string, span_start int, span_end int, extra int"


def pack(spark, spans, limit=5):
    names = {"m.a": ("m.py", 1, "aab"), "m.b": ("m.py", 20, "zz"), "n.c": ("n.py", 1, "abab"), "n.d": ("n.py", 9, "xyz"), "o.e": ("o.py", 1, "aabb"), "q.f": ("q.py", 1, "aba"), "q.g": ("q.py", 5, None)}
    symbols = spark.createDataFrame([("r", p, n, s, s + 5, 0) for n, (p, s, _) in names.items()] + [("other", "m.py", "m.a", 1, 5, 0)], SYMBOLS)
    chunks = spark.createDataFrame([("r", n, p, s, f"h-{n}", 10, t, 0) for n, (p, s, t) in names.items()] + [("other", "x", "x.py", 1, "h-x", 10, "aab", 0), ("r", "m.a", "m.py", 1, "h-m.a", 10, "aab", 7)], CHUNKS)
    edges = spark.createDataFrame([("r", 1, "calls", "m.a", "n.c", 1.0, 0), ("r", 2, "calls", "n.c", "n.d", 1.0, 0), ("r", 3, "calls", "m.a", None, 0.3, 0), ("other", 4, "calls", "m.a", "x", 1.0, 0)], EDGES)
    return R.candidates(spark.createDataFrame(spans, SPANS), symbols, chunks, edges, letter_counts, limit)


def test_candidates_of_all_three_kinds(spark):
    c = pack(spark, [(1, "r", "m.py", 2, 3, 0), (1, "r", "m.py", 3, 4, 0), (2, "r", "nowhere.py", 1, 9, 0)])
    got = {(r.request_id, r.fqn): (r.provenance, round(r.score, 4), r.reason) for r in c.collect()}
    # n.py is covered by the graph, the anchors' own file is left out of the search
    assert got == {
        (1, "m.a"): ("anchor", 1.0, "changed by this diff"), (1, "n.c"): ("graph", 0.3, "called by m.a"), (1, "n.d"): ("graph", 0.2, "called by n.c"),
        (1, "q.f"): ("semantic", 0.3, "similar to the changed code (cosine 1.00)"), (1, "o.e"): ("semantic", 0.2846, "similar to the changed code (cosine 0.95)"), (1, "q.g"): ("semantic", 0.0, "similar to the changed code (cosine 0.00)")}
    kept = R.enforce_budget(c, 30).filter("position is not null").orderBy("position")
    assert [r.fqn for r in kept.collect()][0] == "m.a" and kept.count() == 3


def test_candidates_without_search_and_without_spans(spark):
    assert {r.provenance for r in pack(spark, [(1, "r", "m.py", 2, 3, 0)], 0).collect()} == {"anchor", "graph"}
    assert pack(spark, [(1, "r", "m.py", 2, 3, 0)]).limit(0).count() == 0 and pack(spark, [(1, "r", None, 2, 3, 0)]).count() == 0


def test_search_is_cut_into_blocks_within_groups_and_outside_paths(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(90, 4))
    df = spark.createDataFrame([(f"{i:02}", i, "ab"[i % 2], [float(x) for x in v[i]], f"p{i % 5}") for i in range(90)], "key string, query_id bigint, g string, embedding array<float>, path string")
    asked = df.filter("query_id < 20").withColumn("path", F.when(F.col("query_id") != 3, F.array("path", F.lit("p0"))))
    got = {}
    for r in R.exact_topk(asked, df, 4, ["g"], "path", block=3, chunk=7).collect():
        got.setdefault(r.query_id, []).append((r.place, r.key))
    u = v.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for q in range(20):
        ok = [i for i in range(90) if i % 2 == q % 2 and (q == 3 or i % 5 not in (0, q % 5))]
        want = sorted(ok, key=lambda i: (-round(float(u[i] @ u[q]), 6), i))[:4]
        assert [k for _, k in sorted(got[q])] == [f"{i:02}" for i in want]
    assert R.exact_topk(asked.limit(0), df, 4, "g").count() == 0 and R.exact_topk(asked, df.limit(0), 4, "g").count() == 0


def test_letter_counts(spark):
    row = spark.createDataFrame([("aAz-1",), (None,)], "t string").select(letter_counts(F.col("t")).alias("v")).collect()
    assert row[0].v[0] == 2 and row[0].v[25] == 1 and sum(row[0].v) == 3 and sum(row[1].v) == 0 and len(row[1].v) == 26


def test_labels_by_kind(spark):
    got = spark.createDataFrame([(1, "m.a", 1.0), (2, "m.b", 1.0), (3, None, 0.9), (4, None, 0.3), (5, None, 0.9), (6, "m.c", 0.5)], "ref_id int, dst_fqn string, confidence double")
    labels = spark.createDataFrame([(1, "symbol", "m.a"), (2, "symbol", "m.x"), (3, "external", None), (4, "unresolved", None), (5, "unresolved", None), (6, "external", None), (7, "unresolved", None), (8, None, None)], "ref_id int, label_kind string, target string")
    assert {r.ref_id: r.agrees for r in E.score_labels(got, labels, 0.9).collect()} == {1: True, 2: False, 3: True, 4: True, 5: False, 6: False, 7: False, 8: False}


def test_needed_recall(spark):
    packed = spark.createDataFrame([("q", "a", "anchor", 1), ("q", "b", "graph", 2), ("q", "c", "graph", None), ("z", "b", "semantic", 1)], "request_id string, fqn string, provenance string, position int")
    needed = spark.createDataFrame([("q", "b"), ("q", "b"), ("q", "c"), ("y", "b")], "request_id string, fqn string")
    assert tuple(E.needed_recall(packed, needed).first()) == (2, 3, 1, 0.333333, 3, 0.333333)
    assert tuple(E.needed_recall(packed.limit(0), needed.limit(0)).first()) == (0, 0, 0, 1.0, 0, 0.0)


def test_claim_owner(spark):
    cases = spark.createDataFrame([("a", 35), ("b", 999), ("c", None)], "case_id string, defect_line int")
    requests = spark.createDataFrame([(c, f"{c}{i}", i, i * 30 + 1, i * 30 + 30) for c in "abc" for i in range(3)], "case_id string, request_id string, i int, span_start int, span_end int")
    assert {r.case_id: r.request_id for r in E.claim_owner(cases, requests).collect()} == {"a": "a1", "b": "b0", "c": "c0"}


def test_batches_number_a_hot_scope_over_many_tasks(spark):
    df = spark.createDataFrame([("hot", f"{i:05}", i % 3) for i in range(3000)] + [("cold", f"{i}", 0) for i in range(3)] + [(None, "x", 0)], "s string, k string, batch int")
    got = store.batches(df.repartition(5), ["s"], ["k"], 64).collect()
    assert len(got) == 3004 and {(r.s, r.k): r.batch_no for r in got if r.s == "hot"} == {("hot", f"{i:05}"): i // 64 for i in range(3000)}
    assert {r.batch_no for r in got if r.s == "cold"} == {0}
    assert store.batches(df.limit(0), ["s"], ["k"]).count() == 0


def test_diffs_by_number(spark):
    prs = spark.createDataFrame([("r", 1, "old", 1), ("r", 1, "new", 2), ("s", 1, "other", 1)], "repository_id string, pr_number bigint, diff_text string, updated_at int")
    asked = spark.createDataFrame([("r", 1), ("r", 1), ("r", 2), (None, 1)], "repository_id string, pr_number bigint")
    assert sorted(((r.repository_id or "", r.pr_number, r.diff_text, r.is_known) for r in store.fetch_diffs(asked, prs).collect()), key=str) == [("", 1, None, False), ("r", 1, "new", True), ("r", 2, None, False)]


def test_freshness(spark):
    t = lambda m: f"2024-01-01 00:{m:02}:00"
    df = spark.createDataFrame([("a", "ready", t(0)), ("a", "failed", t(1)), ("b", "ready", t(0)), ("b", "failed", t(5)), ("c", "failed", t(0))], "k string, status string, at string").withColumn("created_at", F.col("at").cast("timestamp_ntz"))
    assert {r.k: (r.is_fresh, r.behind) for r in S.freshness(df, ["k"]).collect()} == {"a": (True, 60.0), "b": (False, 300.0), "c": (False, None)}


def test_evidence(spark):
    schema = "id int, path string, line_start int, line_end int, evidence array<struct<path:string,line_start:int,line_end:int,role:string>>, source string, prompt_version string, suggested_fix string, improved_code string"
    rows = [(1, "a", 5, 6, [("a", 6, 9, "defect_site")], "llm", "v", None, None), (2, "a", 5, 6, [("a", 7, 9, "defect_site"), ("a", 5, 5, "caller")], "llm", None, None, "x"), (3, "a", 5, 6, None, "ruff", None, "f", "x")]
    got = {r.id: r.reasons for r in spark.createDataFrame(rows, schema).select("id", V.evidence_reasons().alias("reasons")).collect()}
    assert got == {1: [], 2: ["evidence: defect site elsewhere", "prompt_version: missing", "improved_code: not explained"], 3: ["evidence: no defect site"]}
