"""Findings: validation, gates in order, duplicates, ranking and budgets.

Thresholds and penalties are parameters; nothing here knows what they should be.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

# Title phrases that name no concrete problem.
VAGUE = ["could be improved", "consider refactoring", "might be better", "should be reviewed", "potential issue", "code smell detected"]
# Backticked words that belong to a language and are no claim about a repository.
UNIVERSAL = "none true false null undefined self this super int str float bool bytes list dict set tuple object type len range print open map filter number string boolean array promise record partial any unknown void never await async return if else for while try except catch finally raise throw import export class def function const let var new delete typeof instanceof in is not and or assert yield lambda pass continue break todo fixme note warning error exception valueerror typeerror keyerror indexerror runtimeerror nameerror attributeerror notimplementederror zerodivisionerror".split()
# Fixed value: what a backticked word must look like to be a claim about a symbol.
_SYMBOL = r"^[A-Za-z_$][A-Za-z0-9_$]*((\.|::)[A-Za-z_$][A-Za-z0-9_$]*)*(\(\))?$"


def invalid_reasons(min_title: int = 8, max_title: int = 160) -> Column:
    """What is wrong with a finding (title, path, lines, source, rule_id, confidence), as an array; empty if nothing is."""
    title = F.trim(F.coalesce("title", F.lit("")))
    vague = F.lit(False)
    for v in VAGUE:
        vague = vague | F.lower(title).contains(v)
    checks = [
        (F.length(title) < min_title, "title: too short"), (F.length(title) > max_title, "title: too long"), (vague, "title: vague"),
        (~S.path_is_safe("path"), "path: unsafe"), (~F.coalesce(F.col("line_start") >= 1, F.lit(False)), "line_start: below 1"), (~F.coalesce(F.col("line_end") >= F.col("line_start"), F.lit(False)), "line_end: before line_start"),
        (~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence: out of range"), ((F.col("source") != "llm") & F.col("rule_id").isNull(), "rule_id: missing")]
    return F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in checks]))


def evidence_reasons() -> Column:
    """What is wrong with a finding's evidence, patch and origin (line_start, line_end, path, evidence: array of structs with
    path, line_start, line_end and role; source, prompt_version, suggested_fix, improved_code), as an array; empty if nothing is."""
    sites = F.filter(F.coalesce("evidence", F.array().cast("array<struct<path:string,line_start:int,line_end:int,role:string>>")), lambda e: e["role"] == "defect_site")
    here = F.exists(sites, lambda e: (e["path"] == F.col("path")) & S.spans_overlap(e["line_start"], e["line_end"], "line_start", "line_end"))
    checks = [
        (F.size(sites) == 0, "evidence: no defect site"), ((F.size(sites) > 0) & ~F.coalesce(here, F.lit(False)), "evidence: defect site elsewhere"),
        ((F.col("source") == "llm") & F.col("prompt_version").isNull(), "prompt_version: missing"), (F.col("improved_code").isNotNull() & F.col("suggested_fix").isNull(), "improved_code: not explained")]
    return F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in checks]))


def symbol_tokens(text: Column | str) -> Column:
    """Distinct backticked words of a text that claim to be symbols, without ``()``, language words left out."""
    found = F.regexp_extract_all(S.col(text), F.lit(r"`([^`\n]{1,200})`"), F.lit(1))
    shaped = F.filter(F.transform(found, F.trim), lambda t: t.rlike(_SYMBOL))
    bare = F.transform(shaped, lambda t: F.regexp_replace(t, r"\(\)$", ""))
    words = F.array(*map(F.lit, UNIVERSAL))
    return F.array_distinct(F.filter(bare, lambda t: ~F.array_contains(words, F.lower(t)) & ~F.array_contains(words, F.lower(F.substring_index(t, ".", -1)))))


def unresolved_tokens(claims: DataFrame, vocabulary: DataFrame, key: str, scope: str | Sequence[str]) -> DataFrame:
    """``key, token`` of every claimed symbol that the scope's vocabulary knows neither whole nor by its tail."""
    at = [scope] if isinstance(scope, str) else list(scope)
    t = claims.select(key, *at, F.explode("tokens").alias("token")).distinct().withColumn("tail", S.fqn_tail("token"))
    v = vocabulary.select(*at, "token").distinct()
    return t.join(v, [*at, "token"], "left_anti").join(v.withColumnRenamed("token", "tail"), [*at, "tail"], "left_anti").select(key, "token")


def merged_ranges(ranges: Column) -> Column:
    """Line ranges (structs ``s, e``) in order, those that overlap or touch made one."""
    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when((F.size(acc) > 0) & (x["s"] <= last["e"] + 1), joined).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(ranges), F.expr("cast(array() as array<struct<s:int,e:int>>)"), step)


def unresolved_texts(texts: DataFrame, vocabulary: DataFrame, key: str, known_in: Sequence[str]) -> DataFrame:
    """``key`` of every text (key, ``known_in``, explanation) that names a symbol its vocabulary (``known_in``, token) does not
    know.  A scope without vocabulary resolves nothing."""
    claims = texts.select(key, *known_in, symbol_tokens("explanation").alias("tokens"))
    asked = claims.join(vocabulary.select(*known_in).distinct(), list(known_in), "left_semi")
    return unresolved_tokens(asked, vocabulary, key, known_in).select(key).distinct()


def gate_inputs(findings: DataFrame, heads: DataFrame, touched: DataFrame, vocabulary: DataFrame, patch_parses: Callable[[Column, Column], Column], scope: Sequence[str] = ("run_id",), known_in: Sequence[str] | None = None) -> DataFrame:
    """Adds what ``gates`` asks of every finding, true, false or null where a gate has no opinion.

    ``findings``: scope, finding_id, path, line_start, line_end, explanation, evidence (array of paths), language,
    improved_code; ``heads``: scope, path, lines (files as they are after the change); ``touched``: scope, path, s, e (line
    ranges that the change shows); ``vocabulary``: ``known_in`` (a repository; the scope if not given), token.  A finding stands within its file and touches the change, or
    its evidence lies in a changed file where its own is none; a patch covers shown lines only.  A scope without vocabulary
    resolves nothing.  A file's ranges are folded to one row.
    """
    keys, known_in = [*scope, "path"], list(known_in or scope)
    head = heads.groupBy(*keys).agg(F.max("lines").alias("lines"))
    shown = touched.groupBy(*keys).agg(merged_ranges(F.collect_list(F.struct(F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e")))).alias("shown"))
    cites = findings.select(*scope, "finding_id", F.explode("evidence").alias("path")).join(shown.select(*keys), keys, "left_semi").select("finding_id").distinct().withColumn("cites", F.lit(True))
    lost = unresolved_texts(findings, vocabulary, "finding_id", known_in).withColumn("symbols_resolve", F.lit(False))
    # what is joined by file comes last, as the merge of duplicates goes on by file
    f = findings.join(cites, "finding_id", "left").join(lost, "finding_id", "left").join(head, keys, "left").join(shown, keys, "left")
    return gate_answers(f.withColumns({"symbols_resolve": F.coalesce("symbols_resolve", F.lit(True)), "parses": patch_parses(F.col("language"), F.col("improved_code"))}))


def gate_answers(facts: DataFrame) -> DataFrame:
    """The gates' questions answered from what is known of each finding beside its row: ``lines`` of its file (null: there is none),
    ``shown`` (the file's merged ranges; null: unchanged), ``cites`` (whether its evidence lies in a changed file),
    ``symbols_resolve``, ``parses`` (what its patch's language says)."""
    changed = F.col("shown").isNotNull()
    touches = F.exists("shown", lambda r: S.spans_overlap(r["s"], r["e"], "line_start", "line_end"))
    inside = F.exists("shown", lambda r: (r["s"] <= F.col("line_start")) & (F.col("line_end") <= r["e"]))
    patch = F.col("improved_code").isNotNull()
    return facts.withColumns({
        "file_exists": F.col("lines").isNotNull(), "line_in_range": F.coalesce((F.col("line_end") <= F.col("lines")) & F.when(changed, touches).otherwise(F.coalesce("cites", F.lit(False))), F.lit(False)),
        "patch_parses": F.when(patch, F.col("parses")), "patch_applies": F.when(patch, F.coalesce(inside, F.lit(False))),
    }).drop("lines", "shown", "cites", "parses")


def gates(findings: DataFrame, floors: Mapping[str, float], penalties: Mapping[str, float], duplicates: Sequence[str] | None = None) -> DataFrame:
    """Runs the gates in order as columns: adds status, confidence after demotions, and ``gates_failed``.

    Expects ``file_exists, line_in_range, symbols_resolve, patch_parses, patch_applies`` (booleans; null passes).  The
    first two reject and end the way; the next three demote by their penalty, a patch that does not parse being gone
    before it could apply; what is left is merged with its duplicates within ``duplicates`` (a run's file), if given, which
    rejects the weaker ones; the floor of the severity comes last.  Confidence is compared at nine places.
    """
    fails = lambda c: ~F.coalesce(F.col(c), F.lit(True))
    gone = fails("file_exists") | fails("line_in_range")
    sym, parse = fails("symbols_resolve") & ~gone, fails("patch_parses") & ~gone
    applies = fails("patch_applies") & ~gone & ~parse
    conf = F.col("confidence")
    for c, name in ((sym, "symbols_resolve"), (parse, "patch_parses"), (applies, "patch_applies")):
        conf = F.when(c, F.greatest(F.lit(0.0), conf - F.lit(penalties[name]))).otherwise(conf)
    out = findings.withColumn("final_confidence", F.round(conf, 9))
    if duplicates is not None:
        out = merge_duplicates(out, duplicates, confidence="final_confidence", live=~gone)
    dup = F.col("duplicate_of").isNotNull() if duplicates is not None else F.lit(False)
    floor = F.coalesce(S.literal_map(dict(floors))[F.col("severity")], F.lit(0.0))
    under = ~gone & ~dup & (F.col("final_confidence") < floor)
    steps = [(fails("file_exists"), "file_exists"), (fails("line_in_range") & ~fails("file_exists"), "line_in_range"), (sym, "symbols_resolve"), (parse, "patch_parses"), (applies, "patch_applies"), (dup, "not_duplicate"), (under, "confidence_floor")]
    failed = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in steps]))
    status = F.when(gone | dup | under, "rejected").when(sym | parse | applies, "demoted").otherwise("verified")
    return out.withColumns({"gates_failed": failed, "status": status})


def drop_counts(gated: DataFrame) -> DataFrame:
    """How often each gate was failed, demotions included."""
    return gated.select(F.explode("gates_failed").alias("gate")).groupBy("gate").agg(F.count("*").alias("drops"))


def _overlap_alike(a: Column, b: Column, least: float) -> Column:
    return S.spans_overlap(a["s"], a["e"], b["s"], b["e"]) & (S.jaccard(a["words"], b["words"]) >= least)


def duplicate_pairs(findings: DataFrame, group: Sequence[str], least: float = 0.7) -> DataFrame:
    """Pairs of a group (a run's file) whose lines overlap and whose titles share ``least`` of their words.

    This is the reference relation for small groups; ``merge_duplicates`` does not need it.
    """
    f = findings.select(*group, "finding_id", F.struct(F.col("line_start").alias("s"), F.col("line_end").alias("e"), S.title_tokens("title").alias("words")).alias("x"))
    a, b = f.withColumnsRenamed({"finding_id": "a", "x": "ax"}), f.withColumnsRenamed({"finding_id": "b", "x": "bx"})
    return a.join(b, list(group)).filter((F.col("a") < F.col("b")) & _overlap_alike(F.col("ax"), F.col("bx"), least)).select(*group, "a", "b")


def merge_duplicates(findings: DataFrame, group: Sequence[str], least: float = 0.7, confidence: str = "confidence", live: Column | None = None) -> DataFrame:
    """Adds ``duplicate_of``: the first winner that a finding duplicates, in order of priority.

    Order: greatest severity times confidence, deterministic sources first, then id.  A finding that duplicates an earlier
    winner loses; winners alone are compared with.  It is a fold over findings whose lines hang together: a group (a run's
    file) is cut where no finding's lines reach over, so a group of any size comes apart into islands, and rows keep their
    place in the fold instead of being joined back.  Findings that are not ``live`` neither win nor lose.
    """
    order = Window.partitionBy(*group).orderBy("line_start", "line_end")
    reach = F.max("line_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = findings.withColumn("_cut", (F.col("line_start") > reach).cast("int"))
    cut = cut.withColumn("_island", F.coalesce(F.sum("_cut").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))).drop("_cut")
    alive = F.coalesce(live, F.lit(False)) if live is not None else F.lit(True)
    # the group's columns stay beside the array: how rows are partitioned by them is known behind the merge, too
    own = [c for c in findings.columns if c not in group]
    x = F.struct((-S.priority("severity", confidence)).alias("p"), (F.col("source") == "llm").cast("int").alias("l"), F.col("finding_id").alias("id"), alive.alias("live"), F.struct(*own).alias("row"))
    g = cut.groupBy(*group, "_island").agg(F.collect_list(x).alias("all"))
    won = "array<struct<id:string,s:int,e:int,words:array<string>>>"
    start = F.struct(F.expr(f"cast(array() as {won})").alias("won"), F.expr("cast(array() as array<string>)").alias("of"))

    def step(acc, y):
        hit = F.get(F.filter(acc["won"], lambda w: _overlap_alike(w, y, least)), 0)["id"]
        own = F.array(F.struct(y["id"].alias("id"), y["s"].cast("int").alias("s"), y["e"].cast("int").alias("e"), y["words"].alias("words")))
        of = F.when(y["live"], hit)
        return F.struct(F.when(y["live"] & hit.isNull(), F.concat(acc["won"], own)).otherwise(acc["won"]).alias("won"), F.concat(acc["of"], F.array(of)).alias("of"))

    # of islands with one live finding at most, none is a duplicate: they are neither sorted nor folded
    several = F.size(F.filter("all", lambda y: y["live"])) > 1
    g = g.withColumn("all", F.when(several, F.array_sort("all", lambda a, b: _before(a, b))).otherwise(F.col("all")))
    lean = F.transform("all", lambda y: F.struct(y["id"].alias("id"), y["live"].alias("live"), y["row"]["line_start"].alias("s"), y["row"]["line_end"].alias("e"), F.when(y["live"], S.title_tokens(y["row"]["title"])).alias("words")))
    of = F.when(several, F.aggregate(lean, start, step)["of"]).otherwise(F.transform("all", lambda y: F.lit(None).cast("string")))
    both = g.select(*group, F.inline(F.arrays_zip(F.col("all"), of.alias("of"))).alias("all", "of"))
    return both.select(*[f"all.row.{c}" if c in own else c for c in findings.columns], F.col("of").alias("duplicate_of"))


def _before(a: Column, b: Column) -> Column:
    """Order of priority, source and id; what else a struct holds is not compared."""
    out = F.lit(0)
    for f in ("id", "l", "p"):
        out = F.when(a[f] < b[f], F.lit(-1)).when(a[f] > b[f], F.lit(1)).otherwise(out)
    return out


def _best_first() -> list[Column]:
    """Priority, severity, confidence, fingerprint, id: a total order."""
    return [F.desc(S.priority("severity", "confidence")), F.desc(S.severity_rank("severity")), F.desc("confidence"), F.col("fingerprint"), F.col("finding_id")]


def ranked(findings: DataFrame, run: str = "run_id") -> DataFrame:
    """Adds ``place`` within a run."""
    return findings.withColumn("place", F.row_number().over(Window.partitionBy(run).orderBy(*_best_first())))


def within_budget(findings: DataFrame, limit: int, run: str = "run_id") -> DataFrame:
    """Adds ``is_posted`` and ``suppressed_as``: eligible findings (verified or demoted) up to ``limit`` a run are posted."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    ok = F.col("status").isin("verified", "demoted")
    # one window over all rows: the eligible come first, so their numbers are those of a window of their own
    order = [F.desc(ok), *_best_first()]
    n = F.row_number().over(Window.partitionBy(run).orderBy(*order))
    out = findings.withColumn("place", F.when(ok, n)).withColumn("is_posted", F.coalesce(F.col("place") <= limit, F.lit(False)))
    return out.withColumn("suppressed_as", F.when(F.col("is_posted"), None).when(F.col("place").isNull(), "rejected").otherwise("over budget"))
