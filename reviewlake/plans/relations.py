"""The reference-shaped relations that queries run on, derived from the supplied tables.

Each has a DataFrame and the same derivation as a SQL common table expression, side by side, so they cannot drift.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table


def files(spark: SparkSession, d: str) -> DataFrame:
    """One row per source file."""
    return table(spark, d, "source_files").dropDuplicates(["file_id"])


FILES = "src as (select * from (select *, row_number() over (partition by file_id order by snapshot_id) rn from source_files) where rn = 1)"


def symbols(spark: SparkSession, d: str) -> DataFrame:
    """One row per symbol, with the path of its file."""
    s = table(spark, d, "symbols").dropDuplicates(["symbol_id"])
    return s.join(files(spark, d).select("file_id", "path"), "file_id")


SYMBOLS = FILES + ", sym as (select y.*, src.path from (select * from (select *, row_number() over (partition by symbol_id order by file_id) rn from symbols) where rn = 1) y join (select file_id, path from src) src using (file_id))"


def edges(spark: SparkSession, d: str, s: DataFrame | None = None) -> DataFrame:
    """Members point at their parent (defines); every symbol calls the next one of its file, the last an unknown name."""
    s = symbols(spark, d) if s is None else s
    nxt = F.lead("fqn").over(Window.partitionBy("file_id").orderBy("line_start", "symbol_id"))
    calls = s.select((F.col("symbol_id") * 2).alias("edge_id"), F.lit("calls").alias("kind"), F.col("repository_id"), F.col("file_id"), F.col("fqn").alias("src_fqn"), nxt.alias("dst_fqn"), "name")
    calls = calls.select("edge_id", "kind", "repository_id", "file_id", "src_fqn", "dst_fqn", F.when(F.col("dst_fqn").isNull(), F.concat(F.lit("ext_"), "name")).alias("dst_unresolved_name"), F.when(F.col("dst_fqn").isNull(), 0.3).otherwise(0.8).alias("confidence"))
    parents = s.filter("parent_fqn is not null").select((F.col("symbol_id") * 2 + 1).alias("edge_id"), F.lit("defines").alias("kind"), "repository_id", "file_id", F.col("fqn").alias("src_fqn"), F.col("parent_fqn").alias("dst_fqn"), F.lit(None).cast("string").alias("dst_unresolved_name"), F.lit(1.0).alias("confidence"))
    return calls.unionByName(parents)


EDGES = SYMBOLS + """, edg as (
  select symbol_id * 2 edge_id, 'calls' kind, repository_id, file_id, fqn src_fqn, nxt dst_fqn,
         case when nxt is null then 'ext_' || name end dst_unresolved_name, case when nxt is null then 0.3 else 0.8 end::double confidence
  from (select *, lead(fqn) over (partition by file_id order by line_start, symbol_id) nxt from sym)
  union all
  select symbol_id * 2 + 1, 'defines', repository_id, file_id, fqn, parent_fqn, null, 1.0::double from sym where parent_fqn is not null)"""


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").dropDuplicates(["chunk_id"])


CHUNKS = "chk as (select * from (select *, row_number() over (partition by chunk_id order by content_hash) rn from chunks) where rn = 1)"


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "index_snapshots").dropDuplicates(["snapshot_id"])


SNAPSHOTS = "snp as (select * from (select *, row_number() over (partition by snapshot_id order by created_at) rn from index_snapshots) where rn = 1)"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk_vectors").dropDuplicates(["vector_id"])


VECTORS = "vec as (select * from (select *, row_number() over (partition by vector_id order by content_hash) rn from chunk_vectors) where rn = 1)"


def listing(spark: SparkSession, d: str) -> DataFrame:
    """Latest row of every (snapshot, path), paths and shas in one spelling."""
    from ..operators.snapshot_diff import normal_path

    f = table(spark, d, "files").filter("path is not null")
    return f.groupBy("repository_id", "snapshot_id", normal_path("path").alias("path")).agg(F.max(F.struct("listed_at", F.lower("blob_sha").alias("sha"), "size_bytes")).alias("v")).select("repository_id", "snapshot_id", "path", F.col("v.sha").alias("blob_sha"), F.col("v.size_bytes").alias("size_bytes"), F.col("v.listed_at").alias("listed_at"))


LISTING = r"""lst as (select repository_id, snapshot_id, path, sha blob_sha, size_bytes, listed_at from (
  select repository_id, snapshot_id, regexp_replace(replace(path, '\', '/'), '^(\./+)+', '') path, lower(blob_sha) sha, size_bytes, listed_at,
         row_number() over (partition by repository_id, snapshot_id, regexp_replace(replace(path, '\', '/'), '^(\./+)+', '')
                            order by listed_at desc nulls last, lower(blob_sha) desc nulls last, size_bytes desc nulls last) n
  from files where path is not null) where n = 1)"""


#: Bytes of parts (their titles, and what a hash table adds) up to which they are broadcast; beyond, line items are shuffled to them.
PARTS_BROADCAST = 160 << 20


def run_of(key: str) -> Column:
    """The run of an order: ten orders make one."""
    return F.floor(F.col(key) / 10)


def path_of(key: str) -> Column:
    return F.concat(F.lit("src/"), F.col(key).cast("string"), F.lit(".py"))


def by_run(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by their order's run, and ``run_id``; what goes on by run, or by file within it, needs no further shuffle."""
    return df.withColumn("run_id", run_of(key)).repartition("run_id")


def parts(spark: SparkSession, d: str) -> DataFrame:
    """What a part gives to its findings."""
    return table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("title"))


def findings(spark: SparkSession, d: str, said: DataFrame | None = None) -> DataFrame:
    """A finding per line item: where (order, lines), how grave, how sure, and what it says; a run covers ten orders.

    Line items are shuffled once, by run, as the numbers they are: texts are put together behind the shuffle.  ``said``: parts with
    further columns that follow from their title, which findings get too.
    """
    part = parts(spark, d) if said is None else said
    li = table(spark, d, "lineitem").select(
        (F.col("l_returnflag") == "A").alias("ruff"), "l_discount", "l_linenumber", "l_suppkey", "l_partkey", F.to_date("l_shipdate").alias("day"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"), "l_quantity", "l_orderkey")
    on = F.col("l_partkey") == F.col("p_partkey")
    size = part.agg(F.coalesce(F.sum(F.octet_length("title") + 80), F.lit(0))).first()[0]
    f = by_run(li, "l_orderkey").join(F.broadcast(part), on) if size <= PARTS_BROADCAST else by_run(li.join(part, on), "l_orderkey")
    key = F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")), F.col("l_quantity").cast("int").cast("string"), F.date_format("day", "yyyyMMdd"), F.col("cents").cast("string"))
    return f.select(
        key.alias("finding_id"), "run_id", path_of("l_orderkey").alias("path"),
        (F.col("l_linenumber") * 10).cast("int").alias("line_start"), (F.col("l_linenumber") * 10 + F.col("l_quantity")).cast("int").alias("line_end"),
        F.when(F.col("l_quantity") >= 45, "critical").when(F.col("l_quantity") >= 35, "high").when(F.col("l_quantity") >= 20, "medium").when(F.col("l_quantity") >= 8, "low").otherwise("info").alias("severity"),
        F.when(F.col("ruff"), "ruff").otherwise("llm").alias("source"), F.lit("correctness").alias("category"),
        "title", F.round(1 - F.col("l_discount") * 5, 2).alias("confidence"), *(c for c in part.columns if c not in ("p_partkey", "title"))).distinct()


FINDINGS = """fnd as (select distinct
  concat_ws('-', l_orderkey::varchar, l_linenumber::varchar, l_partkey::varchar, l_suppkey::varchar, l_quantity::int::varchar, strftime(l_shipdate, '%Y%m%d'), round(l_extendedprice * 100)::bigint::varchar) finding_id,
  l_orderkey // 10 run_id, 'src/' || l_orderkey::varchar || '.py' path, (l_linenumber * 10)::int line_start, (l_linenumber * 10 + l_quantity)::int line_end,
  case when l_quantity >= 45 then 'critical' when l_quantity >= 35 then 'high' when l_quantity >= 20 then 'medium' when l_quantity >= 8 then 'low' else 'info' end severity,
  case when l_returnflag = 'A' then 'ruff' else 'llm' end source, 'correctness' category, concat_ws(' ', p_name, p_type) title, round(1 - l_discount * 5, 2) confidence
  from lineitem join part on l_partkey = p_partkey)"""
