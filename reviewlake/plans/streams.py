"""Queries over event streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import checkpoint_dir
from ..sources.tables import table
from ..streaming import events as E
from . import relations as R
from .registry import query


def _folder(spark) -> str:
    """A fresh folder where all executors can write."""
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"


@query("select date_trunc('hour', ts) as window_start, event_type, count(*) as events, round(sum(value), 4) as total from events group by all")
def stream_event_counts(spark, d):
    """The stream, drained and read back."""
    at = _folder(spark)
    path = f"{d}/events.parquet"
    # A single file is a table too: the stream reads the folder that holds it, by its name.
    folder, name = path.rsplit("/", 1)
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if _is_file(spark, path) else spark.readStream.schema(schema).parquet(path)
    counts = E.event_counts(stream)
    # Each batch gives the windows it changed, to a folder of its own; state is kept only as long as windows wait for late rows.
    put = lambda batch, n: batch.write.mode("overwrite").parquet(f"{at}/out/part={n}")
    counts.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{at}/out").groupBy("window_start", "event_type").agg(F.max_by("events", "part").alias("events"), F.max_by("value", "part").alias("value"))
    return last.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "events", F.round("value", 4).alias("total"))


def _is_file(spark, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


@query("with k as (select event_id, ts, sha256(concat_ws('|', user_id::varchar, event_type, strftime(ts, '%Y-%m-%d'))) k from events) select k as idempotency_key, arg_min(event_id, (ts, event_id)) as event_id, count(*) - 1 as redelivered from k group by k")
def idempotent_runs(spark, d):
    """A run per (user, type, day): the first delivery counts."""
    e = table(spark, d, "events").withColumn("idempotency_key", S.idempotency_key(F.col("user_id").cast("string"), "event_type", F.date_format("ts", "yyyy-MM-dd")))
    first = E.without_redelivery(e, "idempotency_key").select("event_id")
    n = e.groupBy("idempotency_key").agg((F.count("*") - 1).alias("redelivered"), F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    return n.join(first, "event_id", "left_semi").select("idempotency_key", "event_id", "redelivered")


@query("with l as (select user_id, max((ts, event_id, event_type)) k from events group by user_id), n as (select max(ts) newest from events) select user_id, struct_extract_at(k, 1) as last_at, struct_extract_at(k, 3) as last_type from l, n where struct_extract_at(k, 3) not in ('purchase') and struct_extract_at(k, 1) < newest - interval 1 hour")
def stuck_runs(spark, d):
    return E.stuck(table(spark, d, "events"), "user_id", ["purchase"], "1 hour")


@query(f"with {R.SNAPSHOTS}, g as (select repository_id, ref_name, max(created_at) newest, max(created_at) filter (where status = 'ready') serving from snp group by all) select repository_id, ref_name, epoch_us(newest) / 1e6 - epoch_us(serving) / 1e6 > 60 as is_late, coalesce(serving + interval 1 minute >= newest, false) as is_fresh from g")
def index_freshness(spark, d):
    """Whether a ref's serving snapshot is at most a minute behind its newest."""
    return E.freshness(R.snapshots(spark, d), ["repository_id", "ref_name"]).select("repository_id", "ref_name", (F.col("behind") > 60).alias("is_late"), "is_fresh")


INCR_SQL = f"""with {R.SNAPSHOTS}, {R.LISTING}, c as (select repository_id, snapshot_id, row_number() over (partition by repository_id order by created_at desc, snapshot_id desc) n from snp where status = 'ready'),
now as (select l.* from lst l join c using (repository_id, snapshot_id) where n = 1), old as (select l.* from lst l join c using (repository_id, snapshot_id) where n = 2),
t as (select case when old.path is null then 'added' when now.path is null then 'removed' when now.blob_sha is distinct from old.blob_sha then 'modified' else 'unchanged' end change_type from now full outer join old on now.repository_id = old.repository_id and now.path = old.path)
select 1::bigint as batch_id, change_type, count(*) as files from t group by change_type union all select 0, 'added', count(*) from old having count(*) > 0"""


@query(INCR_SQL)
def stream_incr_index(spark, d):
    """Every repository's last two ready snapshots, delivered as a stream in two batches, each planned against the last."""
    at = _folder(spark)
    order = Window.partitionBy("repository_id").orderBy(F.desc("created_at"), F.desc("snapshot_id"))
    last = R.snapshots(spark, d).filter("status = 'ready'").withColumn("n", F.row_number().over(order)).filter("n <= 2").select("repository_id", "snapshot_id", "n")
    pushed = R.listing(spark, d).join(last, ["repository_id", "snapshot_id"]).select("repository_id", "path", "blob_sha", "n")
    schema = pushed.drop("n").schema
    for n in (2, 1):
        pushed.filter(F.col("n") == n).drop("n").write.mode("append").parquet(f"{at}/in")
        E.index_incrementally(spark.readStream.schema(schema).parquet(f"{at}/in"), f"{at}/state", f"{at}/out", f"{at}/check", keys=("repository_id", "path"))
    return spark.read.parquet(f"{at}/out").groupBy("batch_id", "change_type").agg(F.count("*").alias("files")).select(F.col("batch_id").cast("bigint").alias("batch_id"), "change_type", "files")
