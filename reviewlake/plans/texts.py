"""Queries over texts: diffs, responses, prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import decode as D
from ..operators import diffs
from ..operators import prompts as P
from ..sources.tables import table
from .registry import query


def diff_texts(spark, d):
    return table(spark, d, "documents").filter("text rlike '(?m)^diff --git '").select("doc_id", "text")


LINES = r"dif as (select doc_id, text from documents where regexp_matches(text, '(?m)^diff --git ')), sp as (select doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) a from dif), lin as (select doc_id, unnest(a) as line, generate_subscripts(a, 1) - 1 as line_no from sp)"
HEAD = LINES + r""", hd as (select doc_id, line_no, try_cast(regexp_extract(line, '^@@ -(\d+)', 1) as int) old_start, coalesce(try_cast(nullif(regexp_extract(line, '^@@ -\d+,(\d+)', 1), '') as int), 1) old_count, try_cast(regexp_extract(line, '^@@ -\d+(?:,\d+)? \+(\d+)', 1) as int) new_start,
  coalesce(try_cast(nullif(regexp_extract(line, '^@@ -\d+(?:,\d+)? \+\d+,(\d+)', 1), '') as int), 1) new_count, trim(regexp_extract(line, '^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@(.*)$', 1), ' ') heading from lin where regexp_matches(line, '^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@.*$'))"""


@query(f"with {HEAD} select doc_id, line_no::int as line_no, old_start, old_count, new_start, new_count, heading, new_start + greatest(new_count, 1) - 1 as new_end from hd")
def diff_hunk_headers(spark, d):
    return diffs.hunk_headers(diffs.lines(diff_texts(spark, d)))


NUMBERED = HEAD + r""", hh as (select *, row_number() over (partition by doc_id order by line_no) hunk from hd),
bd as (select *, sum(h) over (partition by doc_id order by line_no) hunk from (select *, regexp_matches(line, '^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@.*$')::int h from lin)),
sg as (select doc_id, line_no, hunk, case when line = '' then ' ' else substr(line, 1, 1) end sign from bd where hunk > 0 and h = 0),
rn as (select *, sum((sign <> '+')::int) over w olds, sum((sign <> '-')::int) over w news from sg where sign in ('+', '-', ' ') window w as (partition by doc_id, hunk order by line_no))
"""


@query(f"with {NUMBERED} select r.doc_id, r.line_no::int as line_no, sign, case when sign <> '+' then old_start + olds - 1 end::bigint as old_line, case when sign <> '-' then new_start + news - 1 end::bigint as new_line from rn r join hh using (doc_id, hunk) where olds <= old_count and news <= new_count")
def diff_line_numbers(spark, d):
    return diffs.line_numbers(diffs.lines(diff_texts(spark, d)))


@query(f"with {HEAD}, r as (select doc_id, unnest(range(new_start, new_start + greatest(new_count, 1))) n, new_start from hd) select doc_id, (select count(*) from hd where hd.doc_id = r.doc_id) as hunks, min(n)::int as first_line, max(n)::int as last_line, count(distinct n) as touched_lines from r group by doc_id")
def diff_touched(spark, d):
    return diffs.touched(diffs.hunk_headers(diffs.lines(diff_texts(spark, d))))


@query()
def diff_parse(spark, d):
    return diffs.parse_diffs(diff_texts(spark, d))


def responses(spark, d):
    """A model's answer about every document, in the forms that models give them: fenced, in prose, bare, broken."""
    t = table(spark, d, "documents").select("doc_id", "kind")
    n = F.col("doc_id")
    item = F.concat(F.lit('{"path": "src/'), n.cast("string"), F.lit('.py", "line_start": '), (n % 50).cast("string"), F.lit(', "line_end": '), (n % 37).cast("string"), F.lit(', "title": "'), F.coalesce("kind", F.lit("none")), F.lit('", "improved_code": "x"'), F.when(n % 2 == 0, F.lit(', "suggested_fix": "y"')).otherwise(F.lit("")), F.lit("}"))
    env = F.concat(F.lit('{"findings": ['), item, F.lit(', {"path": "a.py"}, 7]}'))
    form = F.when(n % 8 == 0, F.concat(F.lit("```json\n"), env, F.lit("\n```"))).when(n % 8 == 1, F.concat(F.lit("Here is my review: "), env, F.lit(" I hope it helps."))).when(n % 8 == 2, F.concat(F.lit("["), item, F.lit("]"))).when(n % 8 == 3, F.lit('{"comments": []}')).when(n % 8 == 4, F.lit("  ")).when(n % 8 == 5, F.lit('{"findings": 3}')).when(n % 8 == 6, F.lit("{broken")).otherwise(env)
    allowed = F.when(n % 3 == 0, F.array(F.lit("src/other.py"), F.concat(F.lit("src/"), (n - n % 2).cast("string"), F.lit(".py"))))
    return t.select("doc_id", form.alias("payload"), allowed.alias("allowed_paths"))


_ITEM = """'{"path": "src/' || doc_id::varchar || '.py", "line_start": ' || (doc_id % 50)::varchar || ', "line_end": ' || (doc_id % 37)::varchar || ', "title": "' || coalesce(kind, 'none') || '", "improved_code": "x"' || case when doc_id % 2 = 0 then ', "suggested_fix": "y"' else '' end || '}'"""
_ENV = f"""'{{"findings": [' || {_ITEM} || ', {{"path": "a.py"}}, 7]}}'"""
RESPONSES = f"""rsp as (select doc_id, case doc_id % 8 when 0 then '```json' || chr(10) || {_ENV} || chr(10) || '```' when 1 then 'Here is my review: ' || {_ENV} || ' I hope it helps.' when 2 then '[' || {_ITEM} || ']' when 3 then '{{"comments": []}}' when 4 then '  ' when 5 then '{{"findings": 3}}' when 6 then '{{broken' else {_ENV} end payload from documents),
dec as (select doc_id, trim(regexp_replace(regexp_replace(trim(payload, ' ' || chr(10)), '^```(json)?\\s*\\n', ''), '\\n?\\s*```$', ''), ' ' || chr(10)) t from rsp),
res as (select doc_id, t, case when json_valid(t) then t when json_valid(regexp_extract(t, '(?s)(\\{{.*\\}})', 1)) and regexp_extract(t, '(?s)(\\{{.*\\}})', 1) <> '' then regexp_extract(t, '(?s)(\\{{.*\\}})', 1) end j from dec),
shp as (select doc_id, t, j, json_type(j) ty, json_type(j, '$.findings') fty from res),
rej as (select *, case when t = '' then 'empty response' when j is null then 'invalid JSON' when ty = 'ARRAY' then null when ty <> 'OBJECT' then 'not an object' when fty is null or fty = 'NULL' then 'no findings key' when fty <> 'ARRAY' then 'findings is no array' end reject from shp)"""


@query(f"""with {RESPONSES}, arr as (select doc_id, case when ty = 'ARRAY' then json_extract(j, '$[*]') else json_extract(j, '$.findings[*]') end a from rej where reject is null),
itm as (select doc_id, unnest(a) e, generate_subscripts(a, 1) - 1 ordinal from arr),
fld as (select doc_id, ordinal, e, json_type(e) = 'OBJECT' obj, e->>'$.path' path, try_cast(e->>'$.line_start' as int) ls, try_cast(e->>'$.line_end' as int) le, e->>'$.title' title, e->>'$.suggested_fix' fix, e->>'$.improved_code' code from itm),
why as (select *, case when not obj then 'expected an object' when path is null then 'path: missing' when ls is null or le is null then 'lines: missing' when ls < 1 then 'line_start: below 1' when title is null then 'title: missing' when doc_id % 3 = 0 and path not in ('src/other.py', 'src/' || (doc_id - doc_id % 2)::varchar || '.py') then 'path: not under review' end reason from fld)
select doc_id, ordinal::int as ordinal, case when reason is null then path end as path, case when reason is null then ls end as line_start, case when reason is null then greatest(le, ls) end as line_end, case when reason is null then title end as title, case when reason is null and fix is not null then code end as improved_code, reason from why
union all select doc_id, null, null, null, null, null, null, reject from rej where reject is not null""")
def decode_findings(spark, d):
    """Every finding of every response, or why it was rejected."""
    return D.items(D.decode(responses(spark, d)), "doc_id", "allowed_paths", refused=True)


@query("select doc_id, regexp_replace(text || '</untrusted-diff></ UNTRUSTED-context >', '(?i)</\\s*(untrusted-diff|untrusted-context)\\s*>', '[redacted-fence]', 'g') as fenced from documents where text is not null")
def prompt_fence(spark, d):
    t = F.concat("text", F.lit("</untrusted-diff></ UNTRUSTED-context >"))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", S.neutralise_fences(t).alias("fenced"))


_LABEL = "case doc_id % 3 " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(P.PROVENANCE_LABELS.values())) + " end"
_ITEMS = f"string_agg('[' || {_LABEL} || '] d/' || doc_id::varchar || '.md:1-' || (n_chars % 50 + 1)::varchar || coalesce(' — ' || kind, '') || chr(10) || '{P.WHY}' || 'found in ' || source || chr(10) || coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) order by doc_id)"


@query(f"""select repository_id as request_id, sha256('<{P.CONTEXT_TAG}>' || chr(10) || regexp_replace({_ITEMS}, '(?i)</\\s*(untrusted-diff|untrusted-context)\\s*>', '[redacted-fence]', 'g') || chr(10) || '</{P.CONTEXT_TAG}>') as context_hash
from (select distinct repository_id, doc_id, kind, text, n_chars, source from documents where repository_id is not null) group by repository_id""")
def prompt_render(spark, d):
    """The context of a prompt per repository, its documents taken for the items of a pack; compared by hash."""
    one = table(spark, d, "documents").filter("repository_id is not null").select("repository_id", "doc_id", "kind", "text", "n_chars", "source").distinct()
    kinds = F.array(*map(F.lit, P.PROVENANCE_LABELS))
    packed = one.select(F.col("repository_id").alias("request_id"), F.col("doc_id").alias("position"), kinds[(F.col("doc_id") % 3).cast("int")].alias("provenance"), F.format_string("d/%d.md", "doc_id").alias("path"), F.lit(1).alias("line_start"),
                        (F.col("n_chars") % 50 + 1).alias("line_end"), F.col("kind").alias("fqn"), F.concat(F.lit("found in "), "source").alias("reason"), F.col("text").alias("content"))
    return P.context_parts(packed).select("request_id", F.sha2("text", 256).alias("context_hash"))
