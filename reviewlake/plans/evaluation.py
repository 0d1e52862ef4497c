"""Queries of the evaluation: orders are cases, findings the comments on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import evaluate as E
from ..operators import resolution as X
from ..operators import retrieval
from ..session import cut
from ..sources.tables import table
from . import relations as R
from . import review as V
from .graph import BUDGET, FULL_BUDGET, PACK, _pack, hunks
from .registry import query
from .resolution import USES, imports, labels, modules, references, symbols


def _cases(orders, *more):
    path = R.path_of("o_orderkey")
    return orders.select(*more, path.alias("case_id"), path.alias("case_path"), F.when(F.col("o_orderstatus") != "P", (F.col("o_orderkey") % 60 + 10).cast("int")).alias("defect_line"), F.array(F.lit("ring"), F.lit("bolt"), F.lit("economy")).alias("signals"))


def cases(spark, d):
    return _cases(table(spark, d, "orders"))


CASES = "cas as (select 'src/' || o_orderkey::varchar || '.py' case_id, case when o_orderstatus <> 'P' then (o_orderkey % 60 + 10)::int end dl from orders)"
_HIT = "coalesce(c.dl between f.line_start and f.line_end and (contains(lower(f.title), 'ring') or contains(lower(f.title), 'bolt') or contains(lower(f.title), 'economy')), false)"


def comments(df, *more):
    return df.select(*more, F.col("path").alias("case_id"), F.col("finding_id").alias("comment_id"), "path", "line_start", "line_end", F.lower("title").alias("words"))


def verdicts(spark, d):
    """Gated findings as comments of their cases, with their status; cases are dealt by run as findings are, and joined where they lie."""
    g = V._gates(spark, d)
    c = comments(g, "run_id", "status")
    o = R.by_run(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")
    return E.matches_by(c, _cases(o, "run_id"), "run_id")


def _stage_sql(source: str) -> str:
    return f"""per as (select case_id, count_if(agrees) hits, count(*) n from {source} group by case_id), c2 as (select c.case_id, c.dl is not null defect, coalesce(hits, 0) hits, coalesce(n, 0) n from cas c left join per using (case_id)),
st as (select coalesce(sum(hits), 0)::bigint agreed, coalesce(sum(n - hits), 0)::bigint wrong, coalesce(sum(greatest(hits - 1, 0)), 0)::bigint redundant, count_if(defect) defects, count_if(defect and hits > 0) found, count_if(not defect and n > 0) noisy_clean, count(*) cases from c2)"""


_RATIOS = "case when agreed + wrong = 0 then 1.0 else round(agreed / (agreed + wrong), 6) end as precision, case when agreed + wrong = 0 then 1.0 else round((agreed - redundant) / (agreed + wrong), 6) end as precision_strict, case when defects = 0 then 0.0 else round(found / defects, 6) end as recall, case when cases = 0 then 0.0 else round(wrong / cases, 6) end as wrong_per_case"


@query(f"with {R.FINDINGS}, {CASES} select f.finding_id as comment_id, {_HIT} as agrees from fnd f join cas c on c.case_id = f.path")
def eval_match(spark, d):
    return E.matches(comments(R.findings(spark, d)), cases(spark, d)).select("comment_id", "agrees")


@query(f"with {R.FINDINGS}, {CASES}, m as (select f.path case_id, {_HIT} agrees from fnd f join cas c on c.case_id = f.path), {_stage_sql('m')} select agreed, wrong, redundant, defects, found, noisy_clean, cases, {_RATIOS} from st")
def eval_stage(spark, d):
    return E.stage(E.matches(comments(R.findings(spark, d)), cases(spark, d)), cases(spark, d))


@query(f"with {R.FINDINGS}, {CASES}, m0 as (select f.path case_id, {_HIT} agrees from fnd f join cas c on c.case_id = f.path), m as (select * from m0 union all select case_id, false from cas), {_stage_sql('m')} select agreed, wrong, redundant, defects, found, noisy_clean, cases, {_RATIOS} from st")
def eval_degraded(spark, d):
    """A reviewer made worse on purpose: one more wrong comment on every case."""
    c = cases(spark, d)
    m = E.matches(comments(R.findings(spark, d)), c).select("case_id", "agrees")
    return E.stage(m.unionByName(c.select("case_id", F.lit(False).alias("agrees"))), c)


@query(f"with {V.GATED}, {CASES} select f.path as case_id, f.finding_id as comment_id from gat f join cas c on c.case_id = f.path where {_HIT} and status = 'rejected'")
def eval_suppressed(spark, d):
    return verdicts(spark, d).filter("agrees and status = 'rejected'").select("case_id", "comment_id")


@query(f"with {V.GATED}, {CASES}, m as (select f.path case_id, status, {_HIT} agrees from gat f join cas c on c.case_id = f.path), b as (select count_if(agrees) / count(*) pb, count_if(agrees and status <> 'rejected') / nullif(count_if(status <> 'rejected'), 0) pa, count_if(agrees and status = 'rejected') lost, count_if(status = 'rejected') suppressed, count(distinct case when agrees then case_id end) fb, count(distinct case when agrees and status <> 'rejected' then case_id end) fa from m) select round(pb, 6) as precision_before, round(coalesce(pa, 1.0), 6) as precision_after, lost as withheld_true, suppressed, fb as found_before, fa as found_after from b")
def eval_report(spark, d):
    """Precision and defects found, before and after verification, and what that cost."""
    return E.verified(verdicts(spark, d), F.col("status") != "rejected", ["run_id", "case_id"])


@query(f"with {R.SNAPSHOTS}, r as (select embedding_model, duration_ms, row_number() over (partition by embedding_model order by duration_ms) - 1 i, count(*) over (partition by embedding_model) n from snp where duration_ms is not null) select embedding_model, count(*) as runs, round(quantile_cont(duration_ms, 0.5), 6) as p50, max(case when i = least(n - 1, round_even(0.95::double * (n - 1), 0)::bigint) then duration_ms end) as p95_interval, max(case when i = greatest(0, round_even(0.95::double * n, 0)::bigint - 1) then duration_ms end) as p95_rank from r group by embedding_model")
def eval_latency(spark, d):
    return E.latency(R.snapshots(spark, d), "embedding_model", "duration_ms")


_NEEDED = "ned as (select distinct a.request_id, e.dst_fqn fqn from anc a join edg e on e.repository_id = a.repository_id and e.src_fqn = a.fqn and e.kind = 'calls' where e.dst_fqn is not null and not exists (select 1 from anc b where b.request_id = a.request_id and b.fqn = e.dst_fqn))"


def _recall_sql(pack: str) -> str:
    return f"""with {pack}, {_NEEDED}, k as (select distinct request_id, fqn from pck where place is not null), a as (select count(distinct n.request_id) requests, count(*) needed, count(k.fqn) held from ned n left join k using (request_id, fqn)), b as (select count(*) kept, count_if(provenance = 'graph') structural from pck where place is not null)
select requests, needed, held, round(held / needed, 6) as recall, kept, round(structural / kept, 6) as structural_share from a, b"""


def _recall(spark, d, budget):
    s = cut(R.symbols(spark, d))
    anchors = retrieval.symbols_in_spans(s, hunks(spark, d)).select("request_id", "repository_id", "fqn").distinct()
    calls = R.edges(spark, d, s).filter("kind = 'calls' and dst_fqn is not null").select("repository_id", F.col("src_fqn").alias("fqn"), "dst_fqn")
    needed = anchors.join(calls, ["repository_id", "fqn"]).select("request_id", F.col("dst_fqn").alias("fqn")).join(anchors.select("request_id", "fqn"), ["request_id", "fqn"], "left_anti")
    return E.needed_recall(_pack(spark, d, budget=budget), needed)


@query(_recall_sql(PACK))
def eval_retrieval(spark, d):
    """How much of what the changed symbols call is in their packs, and how much of the packs structure brought, under a budget
    that the anchors alone nearly fill."""
    return _recall(spark, d, BUDGET)


@query(_recall_sql(PACK.replace(f"<= {BUDGET}", f"<= {FULL_BUDGET}")))
def eval_retrieval_full(spark, d):
    """The same under the budget of a real request."""
    return _recall(spark, d, FULL_BUDGET)


@query(f"""with {USES}, lab as (select s.symbol_id * 16 + 3 ref_id, case when s.member is null then 'unresolved' else 'symbol' end lk, o.dst target, s.module, s.repository_id from smx s left join own o on o.repository_id = s.repository_id and o.owner = (select struct_extract_at(c.c, 2) from nxt x join cls c on c.repository_id = x.repository_id and c.module = x.m1 where x.repository_id = s.repository_id and x.module = s.module) and o.name = s.member where s.c1 is not null
  union all select s.symbol_id * 16 + k, 'symbol', t.dst, s.module, s.repository_id from smx s cross join (select unnest([4, 9]) k) join nxt x on x.repository_id = s.repository_id and x.module = s.module join tops t on t.repository_id = x.repository_id and t.module = x.m1 and t.name = x.n1
  union all select symbol_id * 16 + k, case k when 6 then 'external' else 'unresolved' end, null, module, repository_id from smx cross join (select unnest([5, 6, 10]) k)),
j as (select l.*, m.lang as language, r.dst_fqn, r.confidence from lab l join mod m using (repository_id, module) left join res r on r.ref_id = l.ref_id)
select language, lk as label_kind, count(*) as labels, count_if(coalesce(case lk when 'symbol' then dst_fqn = target when 'external' then dst_fqn is null and confidence = 0.9 else dst_fqn is null and confidence <> 0.9 end, false)) as agreed,
  round(count_if(coalesce(case lk when 'symbol' then dst_fqn = target when 'external' then dst_fqn is null and confidence = 0.9 else dst_fqn is null and confidence <> 0.9 end, false)) / count(*), 6) as accuracy from j group by language, lk""")
def eval_resolution(spark, d):
    """References whose target is known from how they were made, against what the resolver says, by language and kind."""
    m, s = cut(modules(spark, d)), cut(symbols(spark, d))
    got = E.score_labels(X.resolve(references(m, s), imports(m, s), m, s), labels(m, s), S.CONFIDENCE["external"]).join(m.select("repository_id", "module", "language"), ["repository_id", "module"])
    ok = F.count_if("agrees")
    return got.groupBy("language", "label_kind").agg(F.count("*").alias("labels"), ok.alias("agreed"), F.round(ok / F.count("*"), 6).alias("accuracy"))


def case_requests(spark, d):
    """Requests of every case: its file in spans of thirty lines."""
    o = cases(spark, d)
    return o.select("case_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i")).select("case_id", F.format_string("%s#%d", "case_id", "i").alias("request_id"), "i", (F.col("i") * 30 + 1).alias("span_start"), (F.col("i") * 30 + 30).alias("span_end"))


@query(f"with {CASES} select case_id, case_id || '#' || (case when dl between 1 and 90 then (dl - 1) // 30 else 0 end)::varchar as owner from cas")
def eval_claim_owner(spark, d):
    """The request that a case's claims belong to: the first whose span holds the defect's line, else the first."""
    return E.claim_owner(cases(spark, d), case_requests(spark, d)).select("case_id", F.col("request_id").alias("owner"))
