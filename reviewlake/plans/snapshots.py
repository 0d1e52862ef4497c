"""Queries over snapshots and stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import snapshot_diff, store
from ..sources.tables import table
from . import relations as R
from .registry import query

P3_SQL = r"""
with ready as (
  select snapshot_id, min(created_at) created_at, any_value(repository_id) repository_id, any_value(ref_name) ref_name
  from index_snapshots where status = 'ready' group by snapshot_id),
chain as (
  select snapshot_id, lag(snapshot_id) over w previous_id from ready
  window w as (partition by repository_id, ref_name order by created_at, snapshot_id)),
listed as (
  select snapshot_id, regexp_replace(replace(path, '\', '/'), '^(\./+)+', '') path, lower(blob_sha) sha,
         row_number() over (partition by snapshot_id, regexp_replace(replace(path, '\', '/'), '^(\./+)+', '')
                            order by listed_at desc nulls last, lower(blob_sha) desc nulls last) n
  from files where path is not null),
cur as (select l.snapshot_id, l.path, l.sha from listed l join chain c using (snapshot_id) where n = 1 and previous_id is not null),
old as (select c.snapshot_id, l.path, l.sha from listed l join chain c on l.snapshot_id = c.previous_id where n = 1)
select coalesce(cur.snapshot_id, old.snapshot_id) snapshot_id, coalesce(cur.path, old.path) path,
       case when old.path is null then 'added' when cur.path is null then 'removed' else 'modified' end change_kind
from cur full outer join old on cur.snapshot_id = old.snapshot_id and cur.path = old.path
where old.path is null or cur.path is null or cur.sha <> old.sha
"""


@query(P3_SQL)
def p3_found(spark, d):
    return snapshot_diff.listing_changes(table(spark, d, "files"), table(spark, d, "index_snapshots"))


@query(f"with {R.SNAPSHOTS} select repository_id, snapshot_id, commit_sha from (select *, row_number() over (partition by repository_id order by created_at desc, snapshot_id desc) n from snp where status = 'ready') where n = 1")
def latest_ready(spark, d):
    return store.latest_ready(R.snapshots(spark, d)).select("repository_id", "snapshot_id", "commit_sha")


@query(f"with {R.SNAPSHOTS}, {R.LISTING}, l as (select repository_id, snapshot_id from (select *, row_number() over (partition by repository_id order by created_at desc, snapshot_id desc) n from snp where status = 'ready') where n = 1) select l.repository_id, l.snapshot_id, count(lst.path) as files, coalesce(sum(lst.size_bytes), 0)::bigint as bytes from l left join lst on lst.repository_id = l.repository_id and lst.snapshot_id = l.snapshot_id group by all")
def tenancy_scope(spark, d):
    """Files of each repository's serving snapshot; rows of another repository never match, whatever their snapshot id."""
    latest = store.latest_ready(R.snapshots(spark, d)).select("repository_id", "snapshot_id")
    return latest.join(R.listing(spark, d), ["repository_id", "snapshot_id"], "left").groupBy("repository_id", "snapshot_id").agg(F.count("path").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


@query(f"with {R.LISTING} select snapshot_id, path, blob_sha, size_bytes from lst where blob_sha is not null")
def scan_listing(spark, d):
    return R.listing(spark, d).filter("blob_sha is not null").select("snapshot_id", "path", "blob_sha", "size_bytes")


PLAN_SQL = f"""with {R.SNAPSHOTS}, {R.LISTING},
chain as (select snapshot_id, lag(snapshot_id) over (partition by repository_id, ref_name order by created_at, snapshot_id) previous_id from snp where status = 'ready'),
cur as (select l.snapshot_id, l.path, l.blob_sha from lst l join chain using (snapshot_id) where previous_id is not null),
old as (select c.snapshot_id, l.path, l.blob_sha from lst l join chain c on l.snapshot_id = c.previous_id),
tagged as (select coalesce(cur.snapshot_id, old.snapshot_id) snapshot_id, case when old.path is null then 'added' when cur.path is null then 'removed' when cur.blob_sha is distinct from old.blob_sha then 'modified' else 'unchanged' end change_type
  from cur full outer join old on cur.snapshot_id = old.snapshot_id and cur.path = old.path)
select snapshot_id, count_if(change_type = 'added') as added, count_if(change_type = 'modified') as modified, count_if(change_type = 'removed') as removed, count_if(change_type = 'unchanged') as unchanged,
  count_if(change_type in ('added', 'modified')) as to_parse, count_if(change_type in ('unchanged', 'removed', 'modified')) = 0 as is_full_reindex from tagged group by snapshot_id"""


@query(PLAN_SQL)
def incr_plan(spark, d):
    """Per ready snapshot, what must be parsed again against the one before it."""
    chain = snapshot_diff.ready_chain(R.snapshots(spark, d))
    listed = R.listing(spark, d).join(chain, "snapshot_id")
    plan = snapshot_diff.plan(listed.filter("previous_id is not null").select("snapshot_id", "path", "blob_sha"), listed.filter("next_id is not null").select(F.col("next_id").alias("snapshot_id"), "path", "blob_sha"), ["snapshot_id", "path"], ["blob_sha"])
    n = lambda *k: F.count_if(F.col("change_type").isin(*k))
    return plan.groupBy("snapshot_id").agg(n("added").alias("added"), n("modified").alias("modified"), n("removed").alias("removed"), n("unchanged").alias("unchanged"), n("added", "modified").alias("to_parse"), (n("unchanged", "removed", "modified") == 0).alias("is_full_reindex"))


@query(f"with {R.LISTING}, seen as (select repository_id, path, blob_sha, min(listed_at) first_at from lst where blob_sha is not null group by all) select l.snapshot_id, count(*) as files, count_if(l.listed_at > s.first_at) as hits, count_if(l.listed_at is not distinct from s.first_at) as misses from lst l join seen s on l.repository_id = s.repository_id and l.path = s.path and l.blob_sha = s.blob_sha group by l.snapshot_id")
def incr_cache_hits(spark, d):
    """Parse-cache hits by (repository, path, sha): a text listed before need not be parsed again."""
    lst = R.listing(spark, d).filter("blob_sha is not null")
    first = lst.groupBy("repository_id", "path", "blob_sha").agg(F.min("listed_at").alias("first_at"))
    j = lst.join(first, ["repository_id", "path", "blob_sha"])
    return j.groupBy("snapshot_id").agg(F.count("*").alias("files"), F.count_if(F.col("listed_at") > F.col("first_at")).alias("hits"), F.count_if(F.col("listed_at").eqNullSafe(F.col("first_at"))).alias("misses"))


@query(f"""with {R.CHUNKS}, {R.VECTORS}, per as (select repository_id, content_hash, count(*) n from chk group by all),
hit as (select per.*, v.content_hash is not null h from per left join (select distinct content_hash from vec where embedding is not null) v using (content_hash))
select repository_id, sum(n)::bigint as chunks, count(*) as distinct_chunks, (sum(n) - count(*))::bigint as repeats, count_if(h) as cached, count_if(not h) as missing, ceil(count_if(not h) / 64)::bigint as batches from hit group by repository_id""")
def embed_cache_plan(spark, d):
    return store.embedding_plan(R.chunks(spark, d), R.vectors(spark, d).filter("embedding is not null"), "repository_id")


@query(f"with {R.CHUNKS} select repository_id, content_hash, chunk_id, ((row_number() over (partition by repository_id order by content_hash, chunk_id) - 1) // 64)::bigint as batch_no from chk")
def embed_batches(spark, d):
    return store.batches(R.chunks(spark, d).select("repository_id", "content_hash", "chunk_id"), ["repository_id"], ["content_hash", "chunk_id"])


@query(f"with {R.CHUNKS} select content_hash, chunk_id, path from (select *, row_number() over (partition by content_hash order by chunk_id) n from chk) where n = 1")
def first_by_key(spark, d):
    return store.first_by_key(R.chunks(spark, d), ["content_hash"], ["chunk_id"]).select("content_hash", "chunk_id", "path")


@query(f"with {R.CHUNKS}, {R.VECTORS} select repository_id, count(distinct content_hash) as reused from chk where content_hash in (select content_hash from vec where embedding is not null) group by repository_id")
def chunk_reuse(spark, d):
    stored = R.vectors(spark, d).filter("embedding is not null").select("content_hash").distinct()
    return R.chunks(spark, d).join(stored, "content_hash", "left_semi").groupBy("repository_id").agg(F.countDistinct("content_hash").alias("reused"))


UPSERT_SQL = f"""with {R.CHUNKS}, {R.VECTORS},
st as (select repository_id, content_hash, max(case when len(embedding) > 0 then vector_id end) vector_id, null::int token_count from vec group by all),
nw as (select repository_id, content_hash, null::bigint vector_id, max(token_count) token_count from chk group by all)
select coalesce(st.repository_id, nw.repository_id) as repository_id, coalesce(st.content_hash, nw.content_hash) as content_hash, coalesce(nw.vector_id, st.vector_id) as vector_id, coalesce(nw.token_count, st.token_count) as token_count,
  case when nw.content_hash is null then 'kept' when st.content_hash is null then 'inserted' when (st.vector_id is null and nw.vector_id is not null) or (st.token_count is null and nw.token_count is not null) then 'filled' else 'reused' end as change
from st full outer join nw on st.repository_id = nw.repository_id and st.content_hash = nw.content_hash"""


@query(UPSERT_SQL)
def chunk_upsert(spark, d):
    stored = R.vectors(spark, d).groupBy("repository_id", "content_hash").agg(F.max(F.when(F.size("embedding") > 0, F.col("vector_id"))).alias("vector_id")).withColumn("token_count", F.lit(None).cast("int"))
    new = R.chunks(spark, d).groupBy("repository_id", "content_hash").agg(F.max("token_count").alias("token_count")).withColumn("vector_id", F.lit(None).cast("bigint"))
    return store.upsert(stored, new, ["repository_id", "content_hash"], ["vector_id", "token_count"])


@query(f"with {R.SNAPSHOTS}, {R.CHUNKS}, l as (select repository_id, snapshot_id, created_at from (select *, row_number() over (partition by repository_id order by created_at desc, snapshot_id desc) n from snp where status = 'ready') where n = 1), old as (select distinct l.snapshot_id, c.content_hash from l join chk c on c.repository_id = l.repository_id and c.created_at < l.created_at) select l.snapshot_id, count(distinct c.content_hash) as appended from l join chk c on c.repository_id = l.repository_id and not exists (select 1 from old o where o.snapshot_id = l.snapshot_id and o.content_hash = c.content_hash) group by l.snapshot_id")
def chunk_membership(spark, d):
    """Bridge rows (snapshot, hash) that are not there yet; chunks older than the snapshot are taken for stored ones."""
    latest = store.latest_ready(R.snapshots(spark, d)).select("repository_id", "snapshot_id", F.col("created_at").alias("at"))
    both = R.chunks(spark, d).join(latest, "repository_id")
    stored = both.filter("created_at < at").select("snapshot_id", "content_hash").distinct()
    return store.append_missing(stored, both, ["snapshot_id", "content_hash"]).groupBy("snapshot_id").agg(F.count("*").alias("appended"))


@query(f"with {R.SNAPSHOTS} select repository_id, ref_name, embedding_model, parser_version, arg_max(snapshot_id, (created_at, snapshot_id)) as snapshot_id, count(*) - 1 as replaced from snp group by all")
def snapshot_replace(spark, d):
    return store.replace_snapshots(R.snapshots(spark, d), ["repository_id", "ref_name", "embedding_model", "parser_version"])


@query(f"with {R.SYMBOLS} select file_id, path, count(*) as symbols from sym group by all")
def write_symbols_join(spark, d):
    s = R.symbols(spark, d).drop("path")
    joined = s.join(R.files(spark, d).select("file_id", "path"), "file_id")
    return store.reconcile(s, joined, "symbols").groupBy("file_id", "path").agg(F.count("*").alias("symbols"))


@query(f"with {R.EDGES}, one as (select file_id, fqn, min(symbol_id) id from sym group by all) select e.edge_id, e.kind, s.id as src_id, t.id as dst_id, e.dst_unresolved_name from edg e join one s on s.file_id = e.file_id and s.fqn = e.src_fqn left join one t on t.file_id = e.file_id and t.fqn = e.dst_fqn")
def write_edges_join(spark, d):
    """Inner join on the source, left on the target: no edge may be lost or doubled."""
    e = R.edges(spark, d)
    one = R.symbols(spark, d).groupBy("file_id", "fqn").agg(F.min("symbol_id").alias("id"))
    joined = e.join(one.select("file_id", F.col("fqn").alias("src_fqn"), F.col("id").alias("src_id")), ["file_id", "src_fqn"]).join(one.select("file_id", F.col("fqn").alias("dst_fqn"), F.col("id").alias("dst_id")), ["file_id", "dst_fqn"], "left")
    return store.reconcile(e, joined, "edges").select("edge_id", "kind", "src_id", "dst_id", "dst_unresolved_name")


@query(f"with {R.EDGES}, {R.CHUNKS} select repository_id, sum(f)::bigint as files, sum(s)::bigint as symbols, sum(e)::bigint as edges, sum(c)::bigint as chunks, sum(b)::bigint as blank_files from (select repository_id, 1 f, 0 s, 0 e, 0 c, (trim(coalesce(content, ''), ' ' || chr(9) || chr(10) || chr(13)) = '')::int b from src union all select repository_id, 0, 1, 0, 0, 0 from sym union all select repository_id, 0, 0, 1, 0, 0 from edg union all select repository_id, 0, 0, 0, 1, 0 from chk) group by repository_id")
def index_report(spark, d):
    """One pass of tagged rows for all counts of a repository."""
    tag = lambda df, name, blank=F.lit(False): df.select("repository_id", F.lit(name).alias("what"), blank.alias("blank"))
    rows = tag(R.files(spark, d), "file", F.coalesce("content", F.lit("")).rlike(r"\A[ \t\n\r]*\z")).unionByName(tag(R.symbols(spark, d), "symbol")).unionByName(tag(R.edges(spark, d), "edge")).unionByName(tag(R.chunks(spark, d), "chunk"))
    n = lambda w: F.count_if(F.col("what") == w)
    return rows.groupBy("repository_id").agg(n("file").alias("files"), n("symbol").alias("symbols"), n("edge").alias("edges"), n("chunk").alias("chunks"), F.count_if("blank").alias("blank_files"))


@query("with d as (select doc_id, repository_id, kind, sha256('review' || chr(0) || text)[1:32] k from documents where text is not null), rec as (select k, min(doc_id) doc_id from d where kind = 'review_comment' group by k) select d.doc_id, d.k as prompt_key, rec.doc_id as recorded_as, rec.doc_id is null as is_miss from d left join rec using (k)")
def cassette_replay(spark, d):
    """Recorded answers by prompt key: review comments are the recording, all texts are asked for."""
    asked = table(spark, d, "documents").filter("text is not null").select("doc_id", "kind", S.prompt_key(F.lit("review"), "text").alias("prompt_key"))
    recorded = asked.filter("kind = 'review_comment'").groupBy("prompt_key").agg(F.min("doc_id").alias("recorded_as"))
    return asked.join(recorded, "prompt_key", "left").select("doc_id", "prompt_key", "recorded_as", F.col("recorded_as").isNull().alias("is_miss"))


@query("select r.repository_id, count(d.doc_id) as posted, max(d.created_at) as last_at from (select distinct repository_id from repositories) r left join (select * from documents where kind = 'review_comment') d using (repository_id) group by r.repository_id")
def posted_reviews(spark, d):
    """One row per repository, also where nothing was posted."""
    posted = table(spark, d, "documents").filter("kind = 'review_comment'").groupBy("repository_id").agg(F.count("*").alias("posted"), F.max("created_at").alias("last_at"))
    return table(spark, d, "repositories").select("repository_id").distinct().join(posted, "repository_id", "left").withColumn("posted", F.coalesce("posted", F.lit(0)))


@query("""with prs as (select distinct repository_id, doc_id pr_number, text from documents where kind = 'diff' and repository_id is not null), ask as (select repository_id, pr_number from prs union select distinct repository_id, -1 from documents where repository_id is not null)
select a.repository_id, a.pr_number, p.pr_number is not null as is_known, length(p.text) as size from ask a left join prs p using (repository_id, pr_number)""")
def fetch_diff(spark, d):
    """Diffs of pull requests by repository and number, one unknown number a repository among them."""
    docs = table(spark, d, "documents").filter("repository_id is not null")
    prs = docs.filter("kind = 'diff'").select("repository_id", F.col("doc_id").alias("pr_number"), F.col("text").alias("diff_text"), F.col("created_at").alias("updated_at"))
    asked = prs.select("repository_id", "pr_number").unionByName(docs.select("repository_id", F.lit(-1).cast("bigint").alias("pr_number")))
    return store.fetch_diffs(asked, prs).select("repository_id", "pr_number", "is_known", F.length("diff_text").alias("size"))
