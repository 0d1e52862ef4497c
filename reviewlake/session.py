"""Session settings that hold for the whole library."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

#: Settings under which plans stay adaptive: partition counts and skewed joins are decided from sizes seen at run time.
CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # what was cut is deleted once nothing refers to it
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(name: str = "reviewlake", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    return builder.config(map=CONF | conf).getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that checkpoints go to.

    The cluster names it in ``spark.checkpoint.dir``; where that is unset and no folder was set on the context, as in
    tests, a temporary one is made.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if named:
        sc.setCheckpointDir(named)
        return named
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="reviewlake-")
    sc.setCheckpointDir(made)
    return made


def cut(df):
    """The same rows with a short lineage, written to the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df):
    """For work that is heavy per byte: the same rows over all cores if the input comes in fewer partitions than those.

    An input of so few partitions is small, so the shuffle is; a large one has partitions enough and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
