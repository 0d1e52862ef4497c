from reviewlake.operators import decode as D
from reviewlake.operators import diffs, patches
from reviewlake.operators import review as V

F = "finding_id string, run_id int, path string, line_start int, line_end int, severity string, source string, title string, confidence double, rule_id string, fingerprint string"


def findings(spark, rows):
    return spark.createDataFrame([(i, 1, "a.py", s, e, sev, src, t, c, None, i) for i, s, e, sev, src, t, c in rows], F)


def test_greedy_merge_is_not_transitive(spark):
    rows = [("a", 1, 10, "high", "llm", "one two three four five six seven", 0.9), ("b", 1, 10, "high", "llm", "one two three four five six eight", 0.8), ("c", 1, 10, "high", "llm", "one two three four five nine eight", 0.7), ("d", 90, 99, "high", "llm", "one two three four five six seven", 0.6)]
    got = {r.finding_id: r.duplicate_of for r in V.merge_duplicates(findings(spark, rows), ["run_id", "path"]).collect()}
    assert got == {"a": None, "b": "a", "c": None, "d": None}
    pairs = {(r.a, r.b) for r in V.duplicate_pairs(findings(spark, rows), ["run_id", "path"]).collect()}
    assert pairs == {("a", "b"), ("b", "c")}


def test_deterministic_source_wins_a_tie(spark):
    rows = [("a", 1, 2, "high", "llm", "same title here", 0.9), ("b", 1, 2, "high", "ruff", "same title here", 0.9)]
    assert {r.finding_id: r.duplicate_of for r in V.merge_duplicates(findings(spark, rows), ["path"]).collect()} == {"a": "b", "b": None}


def test_different_bugs_with_like_titles_stay(spark):
    rows = [("a", 1, 2, "high", "llm", "Reads the wrong column of orders", 0.9), ("b", 1, 2, "high", "llm", "Reads the wrong row of invoices", 0.9)]
    assert all(r.duplicate_of is None for r in V.merge_duplicates(findings(spark, rows), ["path"]).collect())


def test_two_demotions_land_exactly_on_the_floor(spark):
    df = spark.createDataFrame([("x", "medium", 0.85, True, True, True, False, None), ("y", "medium", 0.85, True, True, True, True, False), ("z", "low", 0.9, False, False, False, False, False), ("n", "odd", 0.1, None, None, None, None, None)], "finding_id string, severity string, confidence double, file_exists boolean, line_in_range boolean, symbols_resolve boolean, patch_parses boolean, patch_applies boolean")
    got = {r.finding_id: (r.status, r.final_confidence, r.gates_failed) for r in V.gates(df, {"medium": 0.75, "low": 0.75}, {"symbols_resolve": 0.3, "patch_parses": 0.1, "patch_applies": 0.05}).collect()}
    assert got == {"x": ("demoted", 0.75, ["patch_parses"]), "y": ("demoted", 0.8, ["patch_applies"]), "z": ("rejected", 0.9, ["file_exists"]), "n": ("verified", 0.1, [])}


def test_budget_keeps_the_best_and_counts_are_conserved(spark):
    rows = [(f"f{i}", 1, 2, "high", "llm", "t", 0.5 + i / 100) for i in range(5)]
    out = V.within_budget(findings(spark, rows).selectExpr("*", "case when finding_id = 'f4' then 'rejected' else 'verified' end status"), 2).collect()
    assert {r.finding_id for r in out if r.is_posted} == {"f3", "f2"} and len(out) == 5


def test_symbol_tokens(spark):
    text = "`foo()` and `len` and `a.b` and `Store::get` and `not a symbol` and `x.self` and `foo`"
    assert spark.createDataFrame([(text,)], "t string").select(V.symbol_tokens("t").alias("x")).first().x == ["foo", "a.b", "Store::get"]


def test_decode_forms(spark):
    item = '{"path": "a.py", "line_start": 5, "line_end": 2, "title": "t", "improved_code": "c"}'
    forms = {1: f'```json\n{{"findings": [{item}]}}\n```', 2: f"Sure: {{\"findings\": [{item}]}} done", 3: f"[{item}, 3]", 4: "", 5: None, 6: "{oops", 7: '{"x": 1}', 8: '{"findings": null}', 9: '"text"', 10: '{"findings": {}}'}
    dec = D.decode(spark.createDataFrame(list(forms.items()), "k int, payload string"))
    assert {r.k: r.reject for r in dec.collect()} == {1: None, 2: None, 3: None, 4: "empty response", 5: "empty response", 6: "invalid JSON", 7: "no findings key", 8: "no findings key", 9: "not an object", 10: "findings is no array"}
    got = [(r.k, r.line_end, r.improved_code, r.reason) for r in D.items(dec, "k").orderBy("k", "ordinal").collect()]
    assert got == [(1, 5, None, None), (2, 5, None, None), (3, 5, None, None), (3, None, None, "expected an object")]


def test_only_files_under_review_are_spoken_of(spark):
    item = lambda p: f'{{"path": "{p}", "line_start": 5, "line_end": 6, "title": "t"}}'
    df = spark.createDataFrame([(1, f"[{item('a.py')}, {item('b.py')}]", ["a.py"]), (2, f"[{item('b.py')}]", None)], "k int, payload string, ok array<string>")
    got = [(r.k, r.path, r.reason) for r in D.items(D.decode(df), "k", "ok").orderBy("k", "ordinal").collect()]
    assert got == [(1, "a.py", None), (1, None, "path: not under review"), (2, "b.py", None)]
    schema = D.draft_schema()
    assert schema["required"] == ["findings"] and "path" in schema["properties"]["findings"]["items"]["required"]


DIFF = """diff --git a/x.py b/x.py
--- a/x.py
+++ b/x.py
@@ -1,2 +1,3 @@ def f
 a
-b
+c
+d
\\ No newline at end of file
@@ -9 +10,0 @@
-z
diff --git a/old b/new
rename from old
rename to new
diff --git a/gone b/gone
deleted file mode 100644
--- a/gone
+++ /dev/null
@@ -1 +0,0 @@
-q
"""


def test_diff_parse():
    files, error = diffs.parse(DIFF)
    assert error is None and [(f["path"], f["status"]) for f in files] == [("x.py", "modified"), ("new", "renamed"), ("gone", "deleted")]
    assert files[0]["hunks"][0]["added"] == [2, 3] and files[0]["hunks"][0]["removed"] == [2] and files[0]["hunks"][1]["removed"] == [9]
    assert diffs.parse("diff --git a/x b/x\n@@ -1,5 +1,5 @@\n a\n")[1] and diffs.parse(None) == ([], None)


def test_a_side_that_is_nothing_tells_the_status():
    files, _ = diffs.parse("diff --git a/x b/x\n--- /dev/null\n+++ b/x\n@@ -0,0 +1 @@\n+a\ndiff --git a/y b/y\n--- a/y\n+++ /dev/null\n@@ -1 +0,0 @@\n-a\n")
    assert [(f["path"], f["status"]) for f in files] == [("x", "added"), ("y", "deleted")]


def test_parse_and_windows_number_lines_alike(spark):
    texts = [(1, DIFF), (2, "diff --git a/p b/p\n@@ -3,3 +5,4 @@\n k\n+n\n+m\n-o\n l\n")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    seen = {(r.doc_id, r.sign, r.new_line if r.sign == "+" else r.old_line) for r in diffs.line_numbers(diffs.lines(df)).collect() if r.sign != " "}
    told = set()
    for r in diffs.parse_diffs(df).collect():
        told |= {(r.doc_id, "+", n) for h in r.hunks for n in h.added} | {(r.doc_id, "-", n) for h in r.hunks for n in h.removed}
    assert told == seen and len(told) >= 6


def test_gate_inputs(spark):
    f = spark.createDataFrame([
        (1, "a", "x.py", 5, 6, "uses `known`", [], "python", "x = 1"), (1, "b", "x.py", 50, 60, "`ghost()`", [], "python", "x = ("), (1, "c", "y.py", 1, 2, "", ["x.py"], "python", None), (1, "d", "y.py", 1, 2, "", ["z.py"], "cobol", "?"),
        (1, "e", "gone.py", 1, 1, None, None, None, None), (2, "f", "x.py", 1, 1, "`ghost`", [], "python", None), (1, "g", "x.py", 8, 13, "", [], "python", "x = 1")],
        "run_id int, finding_id string, path string, line_start int, line_end int, explanation string, evidence array<string>, language string, improved_code string")
    heads = spark.createDataFrame([(1, "x.py", 55), (1, "y.py", 9), (2, "x.py", 9)], "run_id int, path string, lines int")
    shown = spark.createDataFrame([(1, "x.py", 4, 8), (1, "x.py", 9, 10), (1, "x.py", 1, 2), (1, "x.py", 52, 53)], "run_id int, path string, s int, e int")
    vocabulary = spark.createDataFrame([(1, "known")], "run_id int, token string")
    got = {r.finding_id: (r.file_exists, r.line_in_range, r.symbols_resolve, r.patch_parses, r.patch_applies) for r in V.gate_inputs(f, heads, shown, vocabulary, patches.patch_parses).collect()}
    assert got == {"a": (True, True, True, True, True), "b": (True, False, False, False, False), "c": (True, True, True, None, None), "d": (True, False, True, None, False), "e": (False, False, True, None, None), "f": (True, False, True, None, None), "g": (True, True, True, True, False)}
    assert V.gate_inputs(f.limit(0), heads, shown, vocabulary, patches.patch_parses).count() == 0


def test_duplicates_are_merged_before_the_floor_and_within_a_run(spark):
    rows = [("a", 1, 9, "high", "llm", "one two three four", 0.9), ("b", 1, 9, "high", "llm", "one two three four", 0.8), ("c", 1, 9, "high", "llm", "one two three four", 0.95)]
    f = findings(spark, rows).selectExpr("* except (run_id)", "case when finding_id = 'b' then 2 else 1 end run_id", "finding_id <> 'c' file_exists", "true line_in_range", "true symbols_resolve", "true patch_parses", "true patch_applies")
    again = f.filter("finding_id = 'a'").selectExpr("* except (finding_id, confidence)", "'d' finding_id", "0.7d confidence")
    got = {r.finding_id: (r.status, r.gates_failed, r.duplicate_of) for r in V.gates(f.unionByName(again), {"high": 0.75}, {"symbols_resolve": 0.3, "patch_parses": 0.1, "patch_applies": 0.05}, ["run_id", "path"]).collect()}
    assert got == {"a": ("verified", [], None), "b": ("verified", [], None), "c": ("rejected", ["file_exists"], None), "d": ("rejected", ["not_duplicate"], "a")}


def test_many_findings_of_one_file_come_apart(spark):
    rows = [(f"f{i:04}", 10 * i, 10 * i + (12 if i % 2 else 5), "high", "llm", "one two three four", 0.5 + (i % 7) / 100) for i in range(600)]
    got = {r.finding_id: r.duplicate_of for r in V.merge_duplicates(findings(spark, rows), ["run_id", "path"]).collect()}
    want, won = {}, []
    for i, s, e, *_, c in sorted(rows, key=lambda r: (-r[6], r[0])):
        hit = next((w for w, a, b in won if a <= e and s <= b), None)
        want[i] = hit
        won += [(i, s, e)] if hit is None else []
    assert got == want and sum(v is not None for v in got.values()) > 100


def test_diff_windows(spark):
    n = diffs.lines(spark.createDataFrame([(1, DIFF), (2, ""), (3, None)], "doc_id bigint, text string"))
    assert [(r.old_count, r.new_count, r.new_end) for r in diffs.hunk_headers(n).orderBy("line_no").collect()] == [(2, 3, 3), (1, 0, 10), (1, 0, 0)]
    got = [(r.sign, r.old_line, r.new_line) for r in diffs.line_numbers(n).orderBy("line_no").collect()][:4]
    assert got == [(" ", 1, 1), ("-", 2, None), ("+", None, 2), ("+", None, 3)]


def test_patches():
    assert patches.parses("python", "    return x\n") and patches.parses("python", "if x:") and not patches.parses("python", "def (:") and not patches.parses("python", "  ")
    assert patches.parses("typescript", "f({a: '}'})") and not patches.parses("typescript", "f(") and patches.parses("cobol", "x") is None
