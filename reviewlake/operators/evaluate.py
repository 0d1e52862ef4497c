"""Evaluation: comments against labelled defects, stage ratios, latency percentiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, empty: float) -> Column:
    return F.when(b == 0, F.lit(empty)).otherwise(F.round(a / b, 6))


def matches(comments: DataFrame, cases: DataFrame) -> DataFrame:
    """Comments of each case with ``agrees``: same path, the defect's line within the comment's, any signal in its words.

    ``comments``: case_id, comment_id, path, line_start, line_end, words (lower case); ``cases``: case_id, case_path,
    defect_line (null: clean), signals (array).
    """
    return agreeing(comments.join(cases, "case_id"))


def matches_by(comments: DataFrame, cases: DataFrame, scope: str) -> DataFrame:
    """The same where a case lies within a small ``scope`` by which both sides are dealt: a scope's cases are folded to one row
    and joined there, so that neither side is shuffled by case."""
    facts = [c for c in cases.columns if c != scope]
    folded = cases.groupBy(scope).agg(F.collect_list(F.struct(*facts)).alias("_cases"))
    j = comments.join(folded.hint("shuffle_hash"), scope).withColumn("_cases", F.filter("_cases", lambda c: c["case_id"] == F.col("case_id")))
    return agreeing(j.select(*(c for c in comments.columns if c != "case_id"), F.inline("_cases")))


def agreeing(j: DataFrame) -> DataFrame:
    """``agrees`` of comments beside their cases."""
    hit = (F.col("path") == F.col("case_path")) & F.col("defect_line").between(F.col("line_start"), F.col("line_end")) & F.exists("signals", lambda s: F.col("words").contains(s))
    return j.withColumn("agrees", F.coalesce(hit, F.lit(False)))


def stage(matched: DataFrame, cases: DataFrame) -> DataFrame:
    """One row: agreed, wrong, redundant (agreeing comments beyond a case's first), defects and those found, clean cases
    that drew comments, and the ratios.  Precision without comments is 1, recall without defects 0."""
    per = matched.groupBy("case_id").agg(F.count_if("agrees").alias("hits"), F.count("*").alias("n"))
    c = cases.join(per, "case_id", "left").select("case_id", F.col("defect_line").isNotNull().alias("defect"), F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("n", F.lit(0)).alias("n"))
    s = c.agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("agreed"), F.coalesce(F.sum(F.col("n") - F.col("hits")), F.lit(0)).alias("wrong"), F.coalesce(F.sum(F.greatest(F.col("hits") - 1, F.lit(0))), F.lit(0)).alias("redundant"),
              F.count_if("defect").alias("defects"), F.count_if(F.col("defect") & (F.col("hits") > 0)).alias("found"), F.count_if(~F.col("defect") & (F.col("n") > 0)).alias("noisy_clean"), F.count("*").alias("cases"))
    posted = F.col("agreed") + F.col("wrong")
    return s.withColumns({"precision": ratio(F.col("agreed"), posted, 1.0), "precision_strict": ratio(F.col("agreed") - F.col("redundant"), posted, 1.0), "recall": ratio(F.col("found"), F.col("defects"), 0.0), "wrong_per_case": ratio(F.col("wrong"), F.col("cases"), 0.0)})


def withheld(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """True comments that verification took away: agreeing before, absent after."""
    return before.filter("agrees").join(after.select(*keys), list(keys), "left_anti")


def verified(matched: DataFrame, kept: Column, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """One row: precision and defects found before and after verification, and what that cost; ``kept`` tells the comments that
    are left.  Cases are counted one by one first (``by``: the case, and the scope by which comments are dealt).  Precision without comments is null before,
    1 after."""
    hit = F.col("agrees")
    per = matched.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"), F.count_if(kept).alias("left"), F.count_if(hit & kept).alias("held"), F.count_if(~kept).alias("gone"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    t = per.agg(*(total(c).alias(c) for c in ("n", "hits", "left", "held", "gone")), F.count_if(F.col("hits") > 0).alias("found_before"), F.count_if(F.col("held") > 0).alias("found_after"))
    share = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    return t.select(F.round(share("hits", "n"), 6).alias("precision_before"), F.round(F.coalesce(share("held", "left"), F.lit(1.0)), 6).alias("precision_after"), (F.col("hits") - F.col("held")).alias("withheld_true"), F.col("gone").alias("suppressed"), "found_before", "found_after")


def latency(runs: DataFrame, group: str, value: str) -> DataFrame:
    """p50 interpolated and two p95 by rank: at round(0.95 (n-1)) and at max(0, round(0.95 n) - 1), rounding half to even."""
    w = Window.partitionBy(group)
    r = runs.filter(F.col(value).isNotNull()).withColumns({"i": F.row_number().over(w.orderBy(value)) - 1, "n": F.count("*").over(w)})
    at = lambda i: F.max(F.when(F.col("i") == i, F.col(value)))
    a = F.least(F.col("n") - 1, F.bround(F.lit(0.95) * (F.col("n") - 1)).cast("bigint"))
    b = F.greatest(F.lit(0), F.bround(F.lit(0.95) * F.col("n")).cast("bigint") - 1)
    return r.groupBy(group).agg(F.count("*").alias("runs"), F.round(F.percentile(value, 0.5), 6).alias("p50"), at(a).alias("p95_interval"), at(b).alias("p95_rank"))


def score_labels(resolved: DataFrame, labels: DataFrame, external: float) -> DataFrame:
    """Labelled references with ``agrees``: a symbol is the one meant, an external name is known as such (by the confidence
    ``external``), an unresolved one is neither.

    ``resolved``: ref_id, dst_fqn, confidence; ``labels``: ref_id, label_kind (symbol, external, unresolved), target.  A label
    without a reference does not agree.
    """
    j = labels.join(resolved.select("ref_id", "dst_fqn", "confidence"), "ref_id", "left")
    open_, outside = F.col("dst_fqn").isNull() & F.col("confidence").isNotNull(), F.col("confidence") == external
    hit = F.when(F.col("label_kind") == "symbol", F.col("dst_fqn") == F.col("target")).when(F.col("label_kind") == "external", open_ & outside).when(F.col("label_kind") == "unresolved", open_ & ~outside)
    return j.withColumn("agrees", F.coalesce(hit, F.lit(False)))


def needed_recall(packed: DataFrame, needed: DataFrame) -> DataFrame:
    """One row: requests that need something, what they need, what of it their packs hold, the share, and the share of what
    was kept that structure brought.

    ``packed``: request_id, fqn, provenance, position (null: dropped); ``needed``: request_id, fqn.
    """
    kept = packed.filter("position is not null")
    n = needed.select("request_id", "fqn").distinct().join(kept.select("request_id", "fqn").distinct().withColumn("_held", F.lit(True)), ["request_id", "fqn"], "left")
    a = n.agg(F.countDistinct("request_id").alias("requests"), F.count("*").alias("needed"), F.count_if("_held").alias("held"))
    b = kept.agg(F.count("*").alias("kept"), F.count_if(F.col("provenance") == "graph").alias("structural"))
    return a.join(F.broadcast(b)).select("requests", "needed", "held", ratio(F.col("held"), F.col("needed"), 1.0).alias("recall"), "kept", ratio(F.col("structural"), F.col("kept"), 0.0).alias("structural_share"))


def claim_owner(cases: DataFrame, requests: DataFrame) -> DataFrame:
    """``case_id, request_id``: of each case's requests (case_id, request_id, i, span_start, span_end) the first that spans the
    defect's line, the first of all if none does or the case is clean."""
    j = requests.join(cases.select("case_id", "defect_line"), "case_id")
    away = ~F.coalesce(F.col("defect_line").between(F.col("span_start"), F.col("span_end")), F.lit(False))
    return j.groupBy("case_id").agg(F.min_by("request_id", F.struct(away.alias("away"), F.col("i").alias("i"))).alias("request_id"))
