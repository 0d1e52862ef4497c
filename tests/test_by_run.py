"""Findings, files and cases are dealt by run once; all that follows stays where the run lies."""

import re

import pytest

from reviewlake.operators import evaluate as E
from reviewlake.operators import review as V
from reviewlake.plans import catalog, relations
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", ["eval_report", "gate_pipeline", "conservation_check", "eval_suppressed", "findings_budget"])
def test_findings_are_shuffled_once(spark, data, name):
    plan = catalog.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert not [k for k in keys if re.search("finding_id|comment_id|path|case_id|cited", k)], keys
    assert sum(k.startswith("run_id") for k in keys) == 2 + name.startswith("eval"), keys


def test_parts_too_large_to_broadcast(spark, data, monkeypatch):
    monkeypatch.setattr(relations, "PARTS_BROADCAST", -1)
    compare(catalog.queries()["gate_pipeline"](spark, data), connect(data), catalog.oracle_sql()["gate_pipeline"])


def test_cases_matched_within_their_scope(spark):
    comments = spark.createDataFrame([(1, "a", "1", "a", 5, 9, "a bolt"), (1, "b", "2", "b", 5, 9, "a bolt"), (1, "x", "3", "x", 1, 1, ""), (2, "a", "4", "a", 5, 9, "a bolt")], "run_id int, case_id string, comment_id string, path string, line_start int, line_end int, words string")
    cases = spark.createDataFrame([(1, "a", "a", 6, ["bolt"]), (1, "a", "a", 60, ["bolt"]), (1, "b", "b", None, ["bolt"])], "run_id int, case_id string, case_path string, defect_line int, signals array<string>")
    got = E.matches_by(comments, cases, "run_id")
    assert sorted((r.run_id, r.case_id, r.comment_id, r.agrees) for r in got.collect()) == [(1, "a", "1", False), (1, "a", "1", True), (1, "b", "2", False)]
    out = E.verified(got, got.comment_id != "2", ["run_id", "case_id"]).first()
    assert tuple(out) == (0.333333, 0.5, 0, 1, 1, 1)
    assert tuple(E.verified(got.limit(0), got.agrees, ["case_id"]).first()) == (None, 1.0, 0, 0, 0, 0)


def test_merge_keeps_rows_that_are_not_live(spark):
    rows = [(1, "a.py", i, 1, 9, "high", "llm", "one two three", c, live) for i, c, live in (("a", 0.9, False), ("b", 0.8, True), ("c", 0.7, True), ("d", 0.6, False))]
    f = spark.createDataFrame(rows, "run_id int, path string, finding_id string, line_start int, line_end int, severity string, source string, title string, confidence double, live boolean")
    out = V.merge_duplicates(f, ["run_id", "path"], live=f.live)
    assert out.columns == [*f.columns, "duplicate_of"]
    assert {r.finding_id: r.duplicate_of for r in out.collect()} == {"a": None, "b": None, "c": "b", "d": None}
    assert all(r.duplicate_of is None for r in V.merge_duplicates(f, ["run_id", "path"], live=f.finding_id == "c").collect())
