"""What changed between full snapshots (problem 3).

Two full listings are joined by a full outer join on their key, comparing a canonical hash of the compared columns: a
missing side is an addition or a removal, unequal hashes are a change.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_hash(*columns: Column | str) -> Column:
    """128 bits over the columns' text; null and the empty string differ, and so do ('a','bc') and ('ab','c')."""
    parts = [F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("~")) for c in (F.col(x) if isinstance(x, str) else x for x in columns)]
    return F.unhex(F.md5(F.concat_ws("|", *parts)))


def diff(current: DataFrame, previous: DataFrame, keys: Sequence[str], compare: Sequence[str], unknown_is_equal: bool = False) -> DataFrame:
    """``keys`` and ``change_kind`` (added, removed, modified) of two listings with one row per key.

    Rows with a null in a key are left out: they cannot be told apart.  With ``unknown_is_equal`` a row whose compared
    columns hold a null on either side counts as unchanged.  Other columns of the inputs are ignored, whatever their names.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        known = F.lit(True)
        for c in compare:
            known = known & F.col(c).isNotNull()
        h = row_hash(*compare)
        return df.filter(" and ".join(f"`{k}` is not null" for k in keys)).select(*keys, F.struct(F.when(known, h).alias("h") if unknown_is_equal else h.alias("h")).alias(name))

    both = side(current, "_new").join(side(previous, "_old"), list(keys), "full_outer")
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old.h") != F.col("_new.h"), "modified")
    return both.select(*keys, kind.alias("change_kind")).filter("change_kind is not null")


def plan(current: DataFrame, previous: DataFrame, keys: Sequence[str], compare: Sequence[str]) -> DataFrame:
    """As ``diff``, but every key of either side, ``change_type`` being added, removed, modified or unchanged."""
    side = lambda df, name: df.select(*keys, F.struct(row_hash(*compare).alias("h")).alias(name))
    both = side(current, "_new").join(side(previous, "_old"), list(keys), "full_outer")
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old.h") != F.col("_new.h"), "modified").otherwise("unchanged")
    return both.select(*keys, kind.alias("change_type"))


def ready_chain(snapshots: DataFrame) -> DataFrame:
    """Ready snapshots with the ready one just before in the same repository and ref; ``previous_id`` is null for the first.

    Repeated rows count once; of rows that name one snapshot several times the earliest holds; ties of ``created_at`` are
    broken by the snapshot id.  A null ref is a ref of its own.
    """
    ready = snapshots.filter("status = 'ready' and snapshot_id is not null").groupBy("snapshot_id").agg(F.min(F.struct("created_at", "repository_id", "ref_name")).alias("s")).select("snapshot_id", "s.*")
    order = Window.partitionBy("repository_id", "ref_name").orderBy("created_at", "snapshot_id")
    return ready.select("snapshot_id", F.lag("snapshot_id").over(order).alias("previous_id"), F.lead("snapshot_id").over(order).alias("next_id"))


def normal_path(path: Column | str) -> Column:
    """``/`` as separator, no leading ``./``."""
    return F.regexp_replace(F.translate(path if isinstance(path, Column) else F.col(path), "\\", "/"), r"^(\./+)+", "")


def listing_changes(files: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``snapshot_id, path, change_kind`` of every ready snapshot against the ready one before it.

    The listing is folded to one row per (snapshot, path) first -- the latest ``listed_at``, then a known sha, then the
    greatest -- with map-side aggregation, so repeated and corrected rows never reach the join.  The join key is
    (snapshot, path), which spreads any repository however large.
    """
    chain = ready_chain(snapshots)
    latest = files.filter("path is not null and snapshot_id is not null").groupBy("snapshot_id", normal_path("path").alias("path")).agg(F.max(F.struct("listed_at", F.lower("blob_sha").alias("sha"))).alias("v")).select("snapshot_id", "path", F.col("v.sha").alias("sha"))
    listed = latest.join(chain, "snapshot_id")
    current = listed.filter("previous_id is not null").select("snapshot_id", "path", "sha")
    previous = listed.filter("next_id is not null").select(F.col("next_id").alias("snapshot_id"), "path", "sha")
    return diff(current, previous, ["snapshot_id", "path"], ["sha"], unknown_is_equal=True)
