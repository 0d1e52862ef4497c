"""Content-addressed tables: reuse, caches, upserts, snapshot replacement, and checked joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def first_by_key(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each key in the given order.  The limit is applied before the shuffle as well as after it."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def latest_ready(snapshots: DataFrame, scope: Sequence[str] = ("repository_id",)) -> DataFrame:
    """Newest ready snapshot of each scope; ties go to the greater id."""
    return first_by_key(snapshots.filter("status = 'ready'"), scope, [F.desc("created_at"), F.desc("snapshot_id")])


def cache_lookup(wanted: DataFrame, cache: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``wanted`` with ``is_hit``.  The cache is folded to its keys before the join."""
    return wanted.join(cache.select(*keys).distinct().withColumn("_hit", F.lit(True)), list(keys), "left").withColumn("is_hit", F.col("_hit").isNotNull()).drop("_hit")


def embedding_plan(chunks: DataFrame, cached: DataFrame, scope: str, batch: int = 64) -> DataFrame:
    """Of each scope: chunks, distinct hashes, repeats, cached and missing hashes, and batches to embed."""
    per = chunks.groupBy(scope, "content_hash").agg(F.count("*").alias("n"))
    hit = cache_lookup(per, cached.select("content_hash"), ["content_hash"])
    return hit.groupBy(scope).agg(
        F.sum("n").alias("chunks"), F.count("*").alias("distinct_chunks"), (F.sum("n") - F.count("*")).alias("repeats"),
        F.sum(F.col("is_hit").cast("bigint")).alias("cached"), F.sum((~F.col("is_hit")).cast("bigint")).alias("missing"),
        F.ceil(F.sum((~F.col("is_hit")).cast("bigint")) / batch).alias("batches"))


def batches(df: DataFrame, scope: Sequence[str], order: Sequence[str], size: int = 64) -> DataFrame:
    """Adds ``batch_no`` within each scope.

    Rows are sorted over all tasks by range, so a scope of any size lies in as many of them as it fills; each numbers its own
    rows, from where the tasks before it ended.  The sorted rows are written to the checkpoint folder, as both passes must see
    the same ranges.  A null scope is one of its own.
    """
    dealt = cut(df.repartitionByRange(*scope, *order).withColumn("_p", F.spark_partition_id()))
    counts = dealt.groupBy(*scope, "_p").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*scope).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(scope)], F.col("_p").alias("_q"), F.coalesce(before, F.lit(0)).alias("_start"))
    same = F.col("_p") == F.col("_q")
    for i, c in enumerate(scope):
        same = same & F.col(c).eqNullSafe(F.col(f"_{i}"))
    own = F.row_number().over(Window.partitionBy(*scope, "_p").orderBy(*order)) - 1
    numbered = dealt.withColumn("_own", own).join(starts, same)
    return numbered.select(*df.columns, F.floor((F.col("_start") + F.col("_own")) / size).alias("batch_no"))


def upsert(stored: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Full outer join of one row per key: new values where known, else stored ones; ``change`` says what happened.

    What is stored survives a new row without a value, so nothing paid for is lost.
    """
    s = stored.select(*keys, F.struct(*values).alias("_s"))
    n = new.select(*keys, F.struct(*values).alias("_n"))
    both = s.join(n, list(keys), "full_outer")
    out = [F.coalesce(F.col(f"_n.{v}"), F.col(f"_s.{v}")).alias(v) for v in values]
    lacked = F.lit(False)
    for v in values:
        lacked = lacked | (F.col(f"_s.{v}").isNull() & F.col(f"_n.{v}").isNotNull())
    change = F.when(F.col("_n").isNull(), "kept").when(F.col("_s").isNull(), "inserted").when(lacked, "filled").otherwise("reused")
    return both.select(*keys, *out, change.alias("change"))


def append_missing(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key is not stored, each once."""
    return new.select(*keys).distinct().join(stored.select(*keys), list(keys), "left_anti")


def replace_snapshots(snapshots: DataFrame, identity: Sequence[str]) -> DataFrame:
    """The newest row of each identity, with how many older ones it replaced."""
    ranked = snapshots.groupBy(*identity).agg(F.max(F.struct("created_at", "snapshot_id")).alias("_k"), F.count("*").alias("_n"))
    return ranked.select(*identity, F.col("_k.snapshot_id").alias("snapshot_id"), (F.col("_n") - 1).alias("replaced"))


def reconcile(before: DataFrame, after: DataFrame, what: str) -> DataFrame:
    """``after``, or an error if a join lost or doubled rows."""
    a, b = before.count(), after.count()
    if a != b:
        raise ValueError(f"{what}: {a} rows before the join, {b} after it")
    return after


def write_snapshot(tables: dict[str, DataFrame], root: str, repository_id: str, snapshot_id: str) -> None:
    """Writes a snapshot's tables beside those of others and makes it readable last, by its row in ``ready``.

    A reader that goes by ``ready`` never sees half a snapshot; writing one again replaces it.
    """
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/repository_id={repository_id}/snapshot_id={snapshot_id}")
    spark = next(iter(tables.values())).sparkSession
    spark.range(1).select(F.lit(repository_id).alias("repository_id"), F.lit(snapshot_id).alias("snapshot_id"), F.current_timestamp().alias("ready_at")).write.mode("append").parquet(f"{root}/ready")


def read_snapshot(spark, root: str, name: str, repository_id: str, snapshot_id: str) -> DataFrame:
    """A table of one ready snapshot; one of another repository, or not ready, is empty."""
    df = spark.read.option("basePath", f"{root}/{name}").parquet(f"{root}/{name}")
    ready = spark.read.parquet(f"{root}/ready").filter((F.col("repository_id") == repository_id) & (F.col("snapshot_id") == snapshot_id)).select("repository_id", "snapshot_id").distinct()
    return df.filter((F.col("repository_id") == repository_id) & (F.col("snapshot_id") == snapshot_id)).join(ready, ["repository_id", "snapshot_id"], "left_semi")


def fetch_diffs(asked: DataFrame, pull_requests: DataFrame) -> DataFrame:
    """Requests (repository_id, pr_number) with ``diff_text`` and ``is_known``; a number that a repository gave twice has its
    last text."""
    keys = ["repository_id", "pr_number"]
    known = pull_requests.groupBy(keys).agg(F.max_by("diff_text", "updated_at").alias("diff_text"), F.lit(True).alias("_known"))
    return asked.select(*keys).distinct().join(known, keys, "left").withColumn("is_known", F.coalesce("_known", F.lit(False))).drop("_known")
