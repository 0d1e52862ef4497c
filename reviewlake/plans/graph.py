"""Queries over the symbol graph and retrieval."""

from __future__ import annotations

import string

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.embed import letter_counts
from ..operators import chunking, retrieval, store
from ..operators import graph as G
from ..session import cut
from ..sources.tables import table
from . import relations as R
from .files import CHUNK_CTE
from .registry import query

BUDGET, FULL_BUDGET, SEMANTIC = 300, 12_000, 5
WIDTHS = {"code-embed-64": 64, "code-embed-mini-48": 48}


def spans(spark, d):
    """Changed spans: every chunk is one, its repository the request."""
    return R.chunks(spark, d).select(F.col("repository_id").alias("request_id"), "repository_id", "path", F.col("line_start").alias("span_start"), F.col("line_end").alias("span_end"))


SPANS = R.CHUNKS + ", spn as (select repository_id request_id, repository_id, path, line_start span_start, line_end span_end from chk)"


def anchors(spark, d, s=None):
    """Per request (a file) its classes."""
    return (R.symbols(spark, d) if s is None else s).filter("kind = 'class'").select(F.col("file_id").alias("request_id"), "repository_id", "fqn")


ANCHORS = R.EDGES + ", anc as (select distinct file_id request_id, repository_id, fqn from sym where kind = 'class')"
_WEIGHT = "case kind " + " ".join(f"when '{k}' then {v}" for k, v in S.EDGE_WEIGHTS.items()) + f" else {S.OTHER_WEIGHT} end"


def _hop(level: int, frontier: str, seen: str) -> str:
    return f"""hop{level} as (select f.request_id, f.repository_id, e.dst_fqn fqn, e.src_fqn via_fqn, e.kind, e.confidence, e.edge_id, false inbound from {frontier} f join edg e on e.repository_id = f.repository_id and e.src_fqn = f.fqn where e.dst_fqn is not null
  union all select f.request_id, f.repository_id, e.src_fqn, e.dst_fqn, e.kind, e.confidence, e.edge_id, true from {frontier} f join edg e on e.repository_id = f.repository_id and e.dst_fqn = f.fqn),
best{level} as (select * from (select h.*, confidence::double * ({_WEIGHT})::double / ({level} + 1) raw from hop{level} h where not exists (select 1 from {seen} s where s.request_id = h.request_id and s.repository_id = h.repository_id and s.fqn = h.fqn))
  qualify row_number() over (partition by request_id, repository_id, fqn order by raw desc, edge_id, inbound) = 1),
kept{level} as (select *, {level} distance from best{level} qualify row_number() over (partition by request_id order by raw desc, fqn) <= 40)"""


_PHRASES = "case when inbound then case kind " + " ".join(f"when '{k}' then '{v}'" for k, v in G.INBOUND.items()) + " end else case kind " + " ".join(f"when '{k}' then '{v}'" for k, v in G.OUTBOUND.items()) + " end end"


def _neighbours(anchors: str) -> str:
    return anchors + ", " + _hop(1, "anc", "anc") + ", seen1 as (select request_id, repository_id, fqn from anc union all select request_id, repository_id, fqn from kept1), " + _hop(2, "kept1", "seen1") + f""",
nei as (select request_id, repository_id, fqn, distance, least(1.0::double, raw) proximity, kind, via_fqn, inbound, ({_PHRASES}) || ' ' || via_fqn reason from (select * from kept1 union all select * from kept2))"""


NEIGHBOURS = _neighbours(ANCHORS)


def chunk_rows(spark, d, s):
    """The chunks that the symbols of the source files make."""
    return chunking.symbol_chunks(s, R.files(spark, d)).select("repository_id", "fqn", "path", "line_start", "content_hash", "token_count", "body")


CHUNK_ROWS = "ck as (select distinct repository_id, fqn, path, line_start, sha256(concat_ws(chr(0), repository_id, path, fqn, body)) content_hash, greatest(1, length(body) // 4)::int token_count, body from body where body <> '')"


@query(f"with {NEIGHBOURS} select request_id, fqn, distance, round(proximity, 6) as proximity, kind, via_fqn, inbound, reason from nei")
def graph_expand(spark, d):
    s = cut(R.symbols(spark, d))
    n = G.expand(anchors(spark, d, s), R.edges(spark, d, s))
    return n.select("request_id", "fqn", "distance", F.round("proximity", 6).alias("proximity"), "kind", "via_fqn", "inbound", "reason")


@query(f"with {R.SYMBOLS}, {SPANS} select distinct s.request_id, y.symbol_id, y.fqn, y.line_start from sym y join spn s on s.repository_id = y.repository_id and s.path = y.path and y.line_start <= s.span_end and s.span_start <= y.line_end")
def span_overlap_join(spark, d):
    return retrieval.symbols_in_spans(R.symbols(spark, d), spans(spark, d)).select("request_id", "symbol_id", "fqn", "line_start")


@query(f"""with {R.SYMBOLS}, {SPANS}, x as (select distinct * from spn), i as (select x.*, (select y.fqn from sym y where y.repository_id = x.repository_id and y.path = x.path and y.line_start <= x.span_end and x.span_start <= y.line_end order by y.line_end - y.line_start, y.line_start, y.fqn limit 1) symbol_fqn from x)
select repository_id, path, symbol_fqn, count(*) as hunks, min(span_start) as first_line, max(span_end) as last_line from i group by all""")
def hunk_groups(spark, d):
    """Changed spans grouped by the innermost symbol around them; those outside any symbol are their file's own group."""
    i = retrieval.innermost(R.symbols(spark, d), spans(spark, d).distinct())
    return i.groupBy("repository_id", "path", "symbol_fqn").agg(F.count("*").alias("hunks"), F.min("span_start").alias("first_line"), F.max("span_end").alias("last_line"))


@query(f"with {ANCHORS} select edge_id, kind, src_fqn, dst_fqn from edg e where exists (select 1 from anc a where a.repository_id = e.repository_id and a.fqn in (e.src_fqn, e.dst_fqn))")
def edges_touching(spark, d):
    s = cut(R.symbols(spark, d))
    return G.edges_touching(R.edges(spark, d, s), anchors(spark, d, s)).select("edge_id", "kind", "src_fqn", "dst_fqn")


@query(f"with {CHUNK_CTE}, req as (select file_id request_id, repository_id, list(distinct fqn order by fqn) keys from sym group by all), ask as (select request_id, repository_id, unnest(keys) fqn, generate_subscripts(keys, 1) - 1 pos from req), {CHUNK_ROWS} select a.request_id, a.pos::int as pos, k.content_hash, k.token_count from ask a join ck k on k.repository_id = a.repository_id and k.fqn = a.fqn")
def chunks_for_symbols(spark, d):
    """A request is a file that asks for the chunks of its symbols, in its repository alone."""
    s = cut(R.symbols(spark, d))
    req = s.groupBy(F.col("file_id").alias("request_id"), "repository_id").agg(F.sort_array(F.collect_set("fqn")).alias("keys"))
    return retrieval.in_request_order(req, chunk_rows(spark, d, s), "fqn").select("request_id", "pos", "content_hash", "token_count")


@query(f"with {R.CHUNKS}, req as (select path request_id, repository_id, list(distinct content_hash order by content_hash desc) keys from chk group by all), ask as (select request_id, repository_id, unnest(keys) content_hash, generate_subscripts(keys, 1) - 1 pos from req) select a.request_id, a.pos::int as pos, c.chunk_id from ask a join chk c on c.repository_id = a.repository_id and c.content_hash = a.content_hash")
def chunks_by_hash(spark, d):
    """A request is a file that asks for its chunks by hash, in its repository alone."""
    c = R.chunks(spark, d)
    req = c.groupBy(F.col("path").alias("request_id"), "repository_id").agg(F.sort_array(F.collect_set("content_hash"), asc=False).alias("keys"))
    return retrieval.in_request_order(req, c, "content_hash").select("request_id", "pos", "chunk_id")


@query(f"with {R.EDGES} select repository_id, kind, src_fqn, dst_fqn, dst_unresolved_name, max(confidence) as confidence, min(edge_id) as edge_id from edg group by all")
def edge_dedup(spark, d):
    return G.dedup_edges(R.edges(spark, d))


@query(f"with {R.SYMBOLS} select repository_id, fqn, max(symbol_id) as symbol_id, arg_max(kind, symbol_id) as kind, arg_max(name, symbol_id) as name, count(*) as definitions from sym group by repository_id, fqn")
def symbol_table(spark, d):
    return G.symbol_table(R.symbols(spark, d)).select("repository_id", "fqn", "symbol_id", "kind", "name", "definitions")


def references(spark, d, s):
    """A reference per symbol: to the name three symbols on in its repository, through self for every other method."""
    w = Window.partitionBy("repository_id").orderBy("symbol_id")
    name = F.coalesce(F.lead("name", 3).over(w), F.concat(F.lit("unknown_"), F.col("symbol_id").cast("string")))
    recv = F.when((F.col("kind") == "method") & (F.col("symbol_id") % 2 == 0), "self").when((F.col("kind") == "method") & (F.col("symbol_id") % 3 == 0), "self.store").when(F.col("symbol_id") % 5 == 0, "client")
    return s.select("repository_id", F.col("symbol_id").alias("ref_id"), F.col("path").alias("module"), F.when(F.col("kind") == "method", F.col("parent_fqn")).alias("owner"), recv.alias("receiver"), name.alias("target_name"), S.language_of("path").alias("language"))


REFS = R.SYMBOLS + """, ref as (select repository_id, symbol_id ref_id, path module, case when kind = 'method' then parent_fqn end as owner,
  case when kind = 'method' and symbol_id % 2 = 0 then 'self' when kind = 'method' and symbol_id % 3 = 0 then 'self.store' when symbol_id % 5 = 0 then 'client' end receiver,
  coalesce(lead(name, 3) over (partition by repository_id order by symbol_id), 'unknown_' || symbol_id::varchar) target_name,
  case when ends_with(lower(path), '.py') or ends_with(lower(path), '.pyi') then 'python' else 'typescript' end as lang from sym)"""


def bases(spark, d, s):
    """A class is taken to extend the next class of its repository."""
    c = s.filter("kind = 'class'").select("repository_id", "fqn", "symbol_id")
    nxt = F.lead("fqn").over(Window.partitionBy("repository_id").orderBy("symbol_id"))
    return c.select("repository_id", F.col("fqn").alias("owner"), nxt.alias("base"), F.lit(1).alias("ordinal")).filter("base is not null and base <> owner").dropDuplicates(["repository_id", "owner", "base"])


MEMBERS = """bas as (select distinct repository_id, fqn as owner, base from (select repository_id, fqn, lead(fqn) over (partition by repository_id order by symbol_id) base from sym where kind = 'class') where base is not null and base <> fqn),
own as (select repository_id, parent_fqn as owner, name, arg_max(fqn, symbol_id) dst from sym where parent_fqn is not null group by all),
up as (with recursive u as (select repository_id, owner, base as at, 1 as lv from bas union all select u.repository_id, u.owner, b.base, u.lv + 1 from u join bas b on b.repository_id = u.repository_id and b.owner = u.at where u.lv < 5) select * from u),
cand as (select repository_id, owner, name, dst, 0 lv from own union all select u.repository_id, u.owner, o.name, o.dst, u.lv from up u join own o on o.repository_id = u.repository_id and o.owner = u.at),
mem as (select repository_id, owner, name, min((lv, dst)) k from cand group by all)"""


@query(f"with {R.SYMBOLS}, {MEMBERS} select repository_id, owner as owner_fqn, name, struct_extract_at(k, 2) as dst_fqn, struct_extract_at(k, 1) as depth from mem")
def resolve_members(spark, d):
    s = cut(R.symbols(spark, d))
    m = G.members(s, bases(spark, d, s))
    return m.select("repository_id", F.col("owner").alias("owner_fqn"), "name", "dst_fqn", "depth")


HEUR = """heu as (select r.*, coalesce(c.n, 0) n, c.dst from ref r left join lateral (
  select case when r.receiver is not null and count_if(y.kind = 'method') > 0 then count_if(y.kind = 'method') else count(*) end n,
         case when r.receiver is not null and count_if(y.kind = 'method') > 0 then min(case when y.kind = 'method' then y.fqn end) else min(y.fqn) end dst
  from sym y where y.repository_id = r.repository_id and y.name = r.target_name and (coalesce(r.receiver, '') not like 'self.%' or r.owner is null or y.parent_fqn is distinct from r.owner)) c on true)"""


@query(f"with {REFS}, {HEUR} select ref_id, case when n > 0 then dst end as dst_fqn, case when n = 0 then target_name end as dst_unresolved_name, (case when n = 0 then 0.3 when n = 1 then 0.8 else 0.5 end)::double as confidence from heu")
def resolve_heuristic(spark, d):
    hidden = F.when(F.col("receiver").startswith("self."), F.col("owner"))
    s = cut(R.symbols(spark, d))
    r = references(spark, d, s).withColumns({"prefer_methods": F.col("receiver").isNotNull(), "exclude_owner": hidden})
    return G.heuristic(r, s).select("ref_id", "dst_fqn", "dst_unresolved_name", "confidence")


def hunks(spark, d):
    """Changed spans: of every file the ten lines behind its first third."""
    third = F.floor(F.col("line_count") / 3).cast("int")
    return R.files(spark, d).select(F.col("file_id").alias("request_id"), "repository_id", "path", (third + 1).alias("span_start"), (third + 10).alias("span_end"))


def _candidates(spark, d, spans=None):
    s = R.symbols(spark, d) if spans is None else R.symbols(spark, d).join(spans.select("repository_id").distinct(), "repository_id", "left_semi")
    s = cut(s)
    return retrieval.candidates(hunks(spark, d) if spans is None else spans, s, chunk_rows(spark, d, s), R.edges(spark, d, s), letter_counts, SEMANTIC)


_LETTERS = ", ".join(f"(length(l) - length(replace(l, '{c}', '')))::double" for c in string.ascii_lowercase)
PACK_ANCHORS = CHUNK_CTE + R.EDGES[len(R.SYMBOLS):] + ", hun as (select file_id request_id, repository_id, path, line_count // 3 + 1 span_start, line_count // 3 + 10 span_end from src), anc as (select distinct h.request_id, h.repository_id, y.fqn from hun h join sym y on y.repository_id = h.repository_id and y.path = h.path and y.line_start <= h.span_end and h.span_start <= y.line_end)"
_COS_Q = "case when list_inner_product(q.v, q.v) = 0 or list_inner_product(t.v, t.v) = 0 then 0 else round(list_inner_product(q.v, t.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(t.v, t.v))), 6) end"
CANDIDATES = _neighbours(PACK_ANCHORS) + f""", {CHUNK_ROWS},
hld as (select a.request_id, k.*, 'anchor' provenance, 1.0::double score, 'changed by this diff' reason from anc a join ck k using (repository_id, fqn) union all select n.request_id, k.*, 'graph', 0.6::double * n.proximity + 0.3::double * 0.0 + 0.1::double * 0.0, n.reason from nei n join ck k using (repository_id, fqn)),
txt as (select request_id, repository_id, lower(string_agg(body, chr(10) || chr(10) order by path, line_start, content_hash)) l, list(distinct path) ex from hld where provenance = 'anchor' group by all),
qv as (select request_id, repository_id, ex, [{_LETTERS}] v from txt),
vv as (select repository_id, content_hash, min(path) path, [{_LETTERS}] v from (select repository_id, content_hash, path, lower(body) l from ck) group by repository_id, content_hash, l),
hit as (select q.request_id, q.repository_id, t.content_hash, {_COS_Q} found from qv q join vv t on t.repository_id = q.repository_id and not list_contains(q.ex, t.path) qualify row_number() over (partition by q.request_id order by {_COS_Q} desc, t.content_hash) <= {SEMANTIC}),
itm as (select * from hld union all select h.request_id, k.*, 'semantic', 0.6::double * 0.0 + 0.3::double * greatest(0.0::double, least(1.0::double, h.found)) + 0.1::double * 0.0, printf('similar to the changed code (cosine %.2f)', greatest(0.0::double, least(1.0::double, h.found))) from hit h join ck k on k.repository_id = h.repository_id and k.content_hash = h.content_hash
  where not exists (select 1 from hld x where x.request_id = h.request_id and x.content_hash = h.content_hash) and not exists (select 1 from hld x where x.request_id = h.request_id and x.path = k.path))"""
PACK = CANDIDATES + f""", ord as (select *, row_number() over (partition by request_id order by provenance <> 'anchor', -score, path, line_start, content_hash) n from itm),
fold as (with recursive f as (select request_id, 0::bigint n, 0::bigint used, false kept from (select distinct request_id from ord) union all
  select f.request_id, o.n, case when o.provenance = 'anchor' or f.used + o.token_count <= {BUDGET} then f.used + o.token_count else f.used end, o.provenance = 'anchor' or f.used + o.token_count <= {BUDGET} from f join ord o on o.request_id = f.request_id and o.n = f.n + 1) select * from f where n > 0),
pck as (select o.*, case when f.kept then row_number() over (partition by o.request_id, f.kept order by o.n) end::int as place from ord o join fold f on f.request_id = o.request_id and f.n = o.n)"""


@query(f"with {CANDIDATES} select request_id, fqn, provenance, round(score, 9) as score, token_count, path from itm")
def pack_candidates(spark, d):
    return _candidates(spark, d).select("request_id", "fqn", "provenance", F.round("score", 9).alias("score"), "token_count", "path")


@query(f"with {CANDIDATES} select provenance, count(*) as items, round(min(score), 6) as least, round(max(score), 6) as most from itm group by provenance")
def fusion_score(spark, d):
    return _candidates(spark, d).groupBy("provenance").agg(F.count("*").alias("items"), F.round(F.min("score"), 6).alias("least"), F.round(F.max("score"), 6).alias("most"))


def _pack(spark, d, spans=None, budget=BUDGET):
    return retrieval.enforce_budget(_candidates(spark, d, spans), budget)


@query(f"with {PACK} select request_id, content_hash, place as position from pck")
def token_budget(spark, d):
    return _pack(spark, d).select("request_id", "content_hash", "position")


@query(f"with {PACK} select request_id, place as position, fqn, provenance, round(score, 9) as score, token_count, path, line_start, reason from pck where place is not null")
def context_pack(spark, d):
    return _pack(spark, d).filter("position is not null").select("request_id", "position", "fqn", "provenance", F.round("score", 9).alias("score"), "token_count", "path", "line_start", "reason")


_ONE = PACK.replace("line_count // 3 + 10 span_end from src)", "line_count // 3 + 10 span_end from src where file_id = (select min(file_id) from source_files))")


@query(f"with {_ONE} select request_id, place as position, fqn, provenance, token_count, path, line_start from pck where place is not null")
def context_pack_one(spark, d):
    """The pack of a single request, of the first file: its hunk is found before anything else is read."""
    h = hunks(spark, d)
    one = h.filter(F.col("request_id") == h.agg(F.min("request_id").alias("r")).first()["r"])
    return _pack(spark, d, one).filter("position is not null").select("request_id", "position", "fqn", "provenance", "token_count", "path", "line_start")


@query(f"with {PACK} select request_id, count_if(place is not null and provenance = 'anchor') as anchors, count_if(place is not null and provenance = 'graph') as graph, count_if(place is not null and provenance = 'semantic') as semantic, count_if(place is null) as dropped, coalesce(sum(case when place is not null then token_count end), 0)::bigint as tokens, round(coalesce(sum(case when place is not null then token_count end), 0) / {BUDGET}, 6) as utilization from pck group by request_id")
def pack_stats(spark, d):
    return retrieval.pack_stats(_pack(spark, d), BUDGET)


@query(f"with {PACK} select request_id, path, min(place) as first_place from pck where place is not null group by all")
def pack_paths(spark, d):
    """Distinct paths of a pack by first appearance."""
    return _pack(spark, d).filter("position is not null").groupBy("request_id", "path").agg(F.min("position").alias("first_place"))


def usable(spark, d):
    ok = F.lit(False)
    for m, w in WIDTHS.items():
        ok = ok | ((F.col("embedding_model") == m) & (F.size("embedding") == w))
    return R.vectors(spark, d).filter(ok & ~F.exists("embedding", lambda x: F.isnan(x)) & F.exists("embedding", lambda x: x != 0))


USABLE = R.VECTORS + ", usv as (select *, list_transform(embedding, lambda x: x::double) v from vec where ((embedding_model = 'code-embed-64' and len(embedding) = 64) or (embedding_model = 'code-embed-mini-48' and len(embedding) = 48)) and not list_contains(list_transform(embedding, lambda x: isnan(x)), true) and list_contains(list_transform(embedding, lambda x: x <> 0), true))"
_COS = "round(list_inner_product(q.v, t.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(t.v, t.v))), 6)"


def _search(spark, d, k, exclude=None):
    """The vectors whose id is divisible by 100, each against all of its repository and model."""
    where = R.chunks(spark, d).groupBy("repository_id", "content_hash").agg(F.min("path").alias("path"))
    v = usable(spark, d).join(where, ["repository_id", "content_hash"], "left").select(F.col("vector_id").cast("string").alias("key"), "vector_id", "repository_id", "embedding_model", "embedding", "path")
    q = v.filter("vector_id % 100 = 0").withColumnRenamed("vector_id", "query_id")
    return retrieval.exact_topk(q, v, k, ["repository_id", "embedding_model"], exclude)


_PLACED = USABLE + ", " + R.CHUNKS + ", plc as (select u.*, c.path from usv u left join (select repository_id, content_hash, min(path) path from chk group by all) c using (repository_id, content_hash))"


@query(f"with {_PLACED}, r as (select q.vector_id query_id, t.vector_id::varchar as key, {_COS} score from plc q join plc t on t.repository_id = q.repository_id and t.embedding_model = q.embedding_model where q.vector_id % 100 = 0) select query_id, (row_number() over (partition by query_id order by score desc, key))::int as place, key, score from r qualify place <= 20")
def ann_topk(spark, d):
    return _search(spark, d, 20)


@query(f"with {_PLACED}, r as (select q.vector_id query_id, t.vector_id::varchar as key, {_COS} score from plc q join plc t on t.repository_id = q.repository_id and t.embedding_model = q.embedding_model and t.path is distinct from q.path where q.vector_id % 100 = 0) select query_id, (row_number() over (partition by query_id order by score desc, key))::int as place, key, score from r qualify place <= 10")
def ann_exclude(spark, d):
    """As ``ann_topk``, without what stands in the query's own file."""
    return _search(spark, d, 10, "path")


@query(f"with {CANDIDATES} select request_id, content_hash, round(score, 9) as score, reason from itm where provenance = 'semantic'")
def pack_semantic(spark, d):
    """Search hits that neither anchors nor graph items of the request cover, scored as context."""
    return _candidates(spark, d).filter("provenance = 'semantic'").select("request_id", "content_hash", F.round("score", 9).alias("score"), "reason")


SERVING = "srv as (select repository_id, snapshot_id, embedding_model from (select *, row_number() over (partition by repository_id order by created_at desc, snapshot_id desc) n from snp where status = 'ready') where n = 1)"


@query(f"with {R.SNAPSHOTS}, {SERVING} select r.repository_id, case when s.snapshot_id is null then 404 when s.embedding_model <> 'code-embed-64' then 409 else 200 end as status from (select distinct repository_id from repositories) r left join srv s using (repository_id)")
def search_guard(spark, d):
    asked = table(spark, d, "repositories").select("repository_id").distinct().withColumn("model", F.lit("code-embed-64"))
    return retrieval.guard(asked, store.latest_ready(R.snapshots(spark, d))).select("repository_id", "status")


@query(f"with {R.SNAPSHOTS}, {SERVING}, {USABLE}, ok as (select u.* from usv u join srv s on s.repository_id = u.repository_id and s.embedding_model = u.embedding_model), q as (select repository_id, arg_min(v, vector_id) v, min(vector_id) query_id from ok group by repository_id), r as (select q.repository_id, q.query_id, t.vector_id::varchar as key, {_COS} score from q join ok t on t.repository_id = q.repository_id) select query_id, repository_id, (row_number() over (partition by query_id order by score desc, key))::int as place, key, score from r qualify place <= 50")
def search_api(spark, d):
    """One search per repository within its serving model: the guard first, the limit clamped to 50."""
    serving = store.latest_ready(R.snapshots(spark, d)).select("repository_id", "embedding_model")
    v = usable(spark, d).join(serving, ["repository_id", "embedding_model"]).select(F.col("vector_id").cast("string").alias("key"), "vector_id", "embedding", "repository_id")
    q = v.groupBy("repository_id").agg(F.min("vector_id").alias("query_id"), F.min_by("embedding", "vector_id").alias("embedding"))
    limit = min(120, 50)
    return retrieval.exact_topk(q, v, limit, "repository_id").join(q.select("query_id", "repository_id"), "query_id")
