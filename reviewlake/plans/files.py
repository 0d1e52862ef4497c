"""Queries over files: filters, scalar functions, chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import chunking, filters
from ..sources.tables import table
from . import relations as R
from .registry import query

VENDORED_SQL = ", ".join(f"'{x}'" for x in filters.VENDORED)
LANG_SQL = "case when instr(path, '.') > 0 then case " + " ".join(f"when lower(regexp_extract(path, '[^.]*$')) = '{k}' then '{v}'" for k, v in S.LANGUAGES.items()) + " end end"
_ENDS = lambda suffixes: "(" + " or ".join(f"ends_with(path, '{x}')" for x in suffixes) + ")"
MARKED_SQL = "(" + " or ".join(f"contains(substr(coalesce(content, ''), 1, 4096), '{x}')" for x in filters.GENERATED_MARKERS) + ")"
PHASE1_SQL = f"case when {LANG_SQL} is null then 'unsupported_language' when list_has_any(string_split(path, '/'), [{VENDORED_SQL}]) then 'vendored' when size_bytes > 1000000 then 'too_large' else 'none' end"
MINIFIED_SQL = f"({_ENDS(filters.MINIFIED_SUFFIXES)} or (strlen(coalesce(content, '')) > 0 and strlen(coalesce(content, '')) / (length(coalesce(content, '')) - length(replace(coalesce(content, ''), chr(10), '')) + 1) > 200))"
GENERATED_SQL = f"({_ENDS(filters.GENERATED_SUFFIXES)} or {MARKED_SQL})"
PHASE2_SQL = f"case when {PHASE1_SQL} <> 'none' then {PHASE1_SQL} when instr(substr(coalesce(content, ''), 1, 4096), chr(0)) > 0 then 'binary' when {MINIFIED_SQL} then 'minified' when {GENERATED_SQL} then 'generated' else 'none' end"
NAME_SQL = "regexp_extract(path, '[^/]*$')"
STEM_SQL = f"regexp_replace({NAME_SQL}, '\\.[^.]*$', '')"
TEST_SQL = f"(list_has_any(string_split(path, '/')[:-2], ['tests', 'test', '__tests__']) or starts_with({STEM_SQL}, 'test_') or ends_with({STEM_SQL}, '_test') or contains({NAME_SQL}, '.test') or contains({NAME_SQL}, '.spec'))"


@query(f"with {R.FILES} select file_id, {LANG_SQL} as file_language from src")
def filter_language(spark, d):
    return R.files(spark, d).select("file_id", S.language_of("path").alias("file_language"))


@query(f"with {R.FILES} select file_id, {PHASE1_SQL} as exclusion from src")
def filter_path_phase1(spark, d):
    return R.files(spark, d).select("file_id", filters.path_exclusion("path", "size_bytes").alias("exclusion"))


def _decided(spark, d):
    """Decisions of all rows, repeated rows once: texts are judged where they are read, ids and verdicts are shuffled."""
    return filters.decide(table(spark, d, "source_files")).select("file_id", "exclusion", "included").distinct()


@query(f"with {R.FILES} select file_id, {PHASE2_SQL} as exclusion, {PHASE2_SQL} = 'none' as included from src")
def filter_content_phase2(spark, d):
    return _decided(spark, d).select("file_id", "exclusion", "included")


@query(f"with {R.FILES} select file_id, {TEST_SQL} as in_test from src")
def filter_is_test(spark, d):
    return R.files(spark, d).select("file_id", filters.is_test("path").alias("in_test"))


@query(f"with {R.FILES} select {PHASE2_SQL} as exclusion, count(*) as files from src group by 1")
def filter_exclusion_counts(spark, d):
    return filters.exclusion_counts(_decided(spark, d))


IGNORE = ["*.d.ts", "lib/**/data/", "/app/generators/", "!keep_*.ts", "# a remark", "venv/", "*_tables.py"]


@query(f"with {R.FILES} select file_id, case when regexp_matches(path, '(?:^|.*/)[^/]*_tables\\.py(?:/.*)?$') then true when regexp_matches(path, '(?:^|.*/)venv/.*$') then true when regexp_matches(path, '(?:^|.*/)keep_[^/]*\\.ts(?:/.*)?$') then false when regexp_matches(path, '^app/generators/.*$') then true when regexp_matches(path, '^lib/(?:.*/)?data/.*$') then true when regexp_matches(path, '(?:^|.*/)[^/]*\\.d\\.ts(?:/.*)?$') then true else false end as ignored from src")
def filter_gitignore(spark, d):
    return R.files(spark, d).select("file_id", filters.gitignored("path", filters.gitignore_rules(IGNORE)).alias("ignored"))


SAFE_SQL = r"coalesce(length(path) between 1 and 1024 and not starts_with(path, '/') and not regexp_matches(path, '(^|/|\\)\.\.(/|\\|$)') and instr(path, chr(0)) = 0, false)"


@query(f"select repository_id, count(*) as rows_seen, sum(case when {SAFE_SQL} then 0 else 1 end)::bigint as unsafe from files group by repository_id")
def validate_paths(spark, d):
    f = table(spark, d, "files")
    return f.groupBy("repository_id").agg(F.count("*").alias("rows_seen"), F.sum(F.when(S.path_is_safe("path"), 0).otherwise(1)).alias("unsafe"))


@query(f"with {R.FILES} select file_id, case when {LANG_SQL} = 'python' then regexp_replace(replace(regexp_replace(path, '\\.pyi?$', ''), '/', '.'), '(^|\\.)__init__$', '') else regexp_replace(path, '\\.(d\\.ts|mts|cts|tsx|ts|jsx|mjs|cjs|js)$', '') end as module from src")
def module_fqn(spark, d):
    return R.files(spark, d).select("file_id", S.module_fqn("path").alias("module"))


@query(f"with {R.SYMBOLS} select symbol_id, regexp_extract(replace(fqn, '::', '.'), '[^.]*$') as tail from sym")
def fqn_tail(spark, d):
    return R.symbols(spark, d).select("symbol_id", S.fqn_tail("fqn").alias("tail"))


@query(f"with {R.SYMBOLS} select symbol_id, case when line_start = line_end then path || ':' || line_start::varchar else path || ':' || line_start::varchar || '-' || line_end::varchar end as span, line_end - line_start + 1 as lines from sym")
def span_format(spark, d):
    return R.symbols(spark, d).select("symbol_id", S.span_text("path", "line_start", "line_end").alias("span"), (F.col("line_end") - F.col("line_start") + 1).alias("lines"))


@query(f"with {R.CHUNKS} select chunk_id, sha256(concat_ws(chr(0), repository_id, path, coalesce(symbol_fqn, ''), content)) as computed_hash, greatest(1, length(content) // 4)::int as computed_tokens from chk")
def content_hash(spark, d):
    return R.chunks(spark, d).select("chunk_id", S.content_hash("repository_id", "path", "symbol_fqn", "content").alias("computed_hash"), S.token_count("content").alias("computed_tokens"))


@query(f"with {R.FILES}, l as (select file_id, regexp_split_to_array(coalesce(content, ''), '\\r\\n|[\\n\\r\\v\\f\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') a from src) select file_id, (case when a[-1] = '' then len(a) - 1 else len(a) end)::int as lines, list_max(list_transform(a, lambda x: length(x)))::int as widest from l")
def line_stats(spark, d):
    lines = S.split_lines(F.coalesce("content", F.lit("")))
    return table(spark, d, "source_files").select("file_id", F.size(lines).alias("lines"), F.coalesce(F.array_max(F.transform(lines, F.length)), F.lit(0)).alias("widest")).distinct()


CHUNK_CTE = f"""{R.SYMBOLS},
kids as (select file_id, parent_fqn fqn, list({{'s': line_start, 'e': line_end}}) spans from sym where parent_fqn is not null group by all),
cut as (select y.symbol_id, y.repository_id, y.path, y.fqn, y.line_start, y.line_end, string_split(replace(replace(coalesce(src.content, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))[y.line_start:y.line_end] ls,
        case when y.kind in ('class', 'interface', 'enum') then coalesce(kids.spans, []) else [] end spans
        from sym y join src using (file_id) left join kids on kids.file_id = y.file_id and kids.fqn = y.fqn where y.line_start >= 1),
body as (select *, regexp_replace(regexp_replace(array_to_string(list_transform(list_filter(ls, lambda x, i: len(list_filter(spans, lambda c: i + line_start - 1 between c.s and c.e)) = 0), lambda x: regexp_replace(x, '\\s+$', '')), chr(10)), '^\\n+', ''), '\\n+$', '') body from cut)"""
CHUNK_SQL = f"with {CHUNK_CTE} select symbol_id, body, sha256(concat_ws(chr(0), repository_id, path, fqn, body)) as content_hash, greatest(1, length(body) // 4)::int as token_count from body where body <> ''"


@query(CHUNK_SQL)
def chunk_symbols(spark, d):
    return chunking.symbol_chunks(R.symbols(spark, d), R.files(spark, d)).select("symbol_id", "body", "content_hash", "token_count")


TOKENS_SQL = f"""with {R.CHUNKS},
low as (select chunk_id, unnest(regexp_extract_all(lower(content), '[a-z_][a-z0-9_]*|[0-9]+')) w from chk),
whole as (select chunk_id, unnest(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+')) w from chk),
hump as (select chunk_id, regexp_extract_all(regexp_replace(regexp_replace(w, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+') h from whole),
bag as (select chunk_id, w from low
  union all select chunk_id, unnest(p) from (select chunk_id, list_filter(string_split(w, '_'), lambda x: x <> '') p from low) where len(p) > 1
  union all select chunk_id, lower(unnest(h)) from hump where len(h) > 1)
select chunk_id, count(*) as tokens, count(distinct w) as distinct_tokens from bag group by chunk_id"""


@query(TOKENS_SQL)
def embed_tokens(spark, d):
    bag = R.chunks(spark, d).select("chunk_id", F.explode(S.embedding_tokens("content")).alias("w"))
    return bag.groupBy("chunk_id").agg(F.count("*").alias("tokens"), F.countDistinct("w").alias("distinct_tokens"))


@query(f"""with {R.SYMBOLS}, {R.CHUNKS},
names as (select repository_id, fqn token from sym union select repository_id, regexp_extract(replace(fqn, '::', '.'), '[^.]*$') from sym
  union select repository_id, t from (select repository_id, unnest(regexp_extract_all(content, '[A-Za-z_$][A-Za-z0-9_$]*')) t from chk) where length(t) <= 200)
select repository_id, count(*) as tokens, min(token) as first_token, max(token) as last_token from names group by repository_id""")
def vocabulary(spark, d):
    v = chunking.vocabulary(R.symbols(spark, d), R.chunks(spark, d))
    return v.groupBy("repository_id").agg(F.count("*").alias("tokens"), F.min("token").alias("first_token"), F.max("token").alias("last_token"))


@query()
def embed_hash(spark, d):
    from ..functions.embed import hash_embedding

    return R.chunks(spark, d).select("chunk_id", hash_embedding(64)("content").alias("embedding"))


@query()
def parse_symbols(spark, d):
    from ..operators.parsing import parse_files

    return parse_files(R.files(spark, d))
