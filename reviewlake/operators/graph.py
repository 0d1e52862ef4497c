"""Symbol graph: edges, bounded expansion, and resolving references to symbols.

Everything is batched over a request column and unrolled to a fixed number of levels, so plans are joins and windows and
nothing is collected.  Names and callers may be skewed: candidates are folded to one row per name before they meet the
references, and per-level limits are applied before the shuffle as well as after it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import cut

# How a neighbour is described, by the edge's kind, seen from its target and from its source.
OUTBOUND = {"calls": "called by", "inherits": "base class of", "tests": "under test by", "references": "referenced by", "defines": "defined in", "imports": "imported by"}
INBOUND = {"calls": "calls", "inherits": "inherits from", "tests": "tests", "references": "references", "defines": "defines", "imports": "imports"}


def edges_touching(edges: DataFrame, names: DataFrame, scope: Sequence[str] = ("repository_id",)) -> DataFrame:
    """Edges with an end among ``names`` (scope columns and ``fqn``), each once: two semi joins, no OR in a join."""
    n = names.select(*scope, "fqn").distinct()
    out = edges.join(n.withColumnRenamed("fqn", "src_fqn"), [*scope, "src_fqn"], "left_semi")
    into = edges.join(n.withColumnRenamed("fqn", "dst_fqn"), [*scope, "dst_fqn"], "left_semi").select(out.columns)
    return out.unionByName(into).dropDuplicates(["edge_id"])


def expand(anchors: DataFrame, edges: DataFrame, depth: int = 2, per_level: int = 40) -> DataFrame:
    """Neighbours of each request's anchors, breadth first over resolved edges in both directions.

    ``anchors``: request_id, repository_id, fqn.  A name keeps its best edge (nearest proximity, then edge id, outbound
    first); each level keeps its ``per_level`` best names.  A name cut by that limit may return on the next level.
    """
    if depth < 1 or per_level < 1:
        raise ValueError("depth and per_level must be positive")
    # read once for every level and direction
    resolved = cut(edges.filter("dst_fqn is not null").select("repository_id", "src_fqn", "dst_fqn", "kind", "confidence", "edge_id"))
    steps = resolved.select("repository_id", F.col("src_fqn").alias("at"), F.col("dst_fqn").alias("fqn"), "kind", "confidence", "edge_id", F.lit(False).alias("inbound")).unionByName(
        resolved.select("repository_id", F.col("dst_fqn").alias("at"), F.col("src_fqn").alias("fqn"), "kind", "confidence", "edge_id", F.lit(True).alias("inbound")))
    seen = cut(anchors.select("request_id", "repository_id", "fqn").distinct())
    frontier, kept = seen, None
    for level in range(1, depth + 1):
        hops = frontier.withColumnRenamed("fqn", "at").join(steps, ["repository_id", "at"]).join(seen, ["request_id", "repository_id", "fqn"], "left_anti")
        hops = hops.withColumns({"raw": S.proximity("confidence", "kind", F.lit(level)), "distance": F.lit(level)})
        best = hops.withColumn("_n", F.row_number().over(Window.partitionBy("request_id", "repository_id", "fqn").orderBy(F.desc("raw"), "edge_id", "inbound"))).filter("_n = 1")
        top = best.withColumn("_n", F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("raw"), "fqn"))).filter(F.col("_n") <= per_level)
        found = top.select("request_id", "repository_id", "fqn", "distance", F.least(F.lit(1.0), "raw").alias("proximity"), "kind", F.col("at").alias("via_fqn"), "inbound")
        kept = found if kept is None else kept.unionByName(found)
        frontier = found.select("request_id", "repository_id", "fqn")
        seen = seen.unionByName(frontier)
    phrase = F.when(F.col("inbound"), S.literal_map(INBOUND)[F.col("kind")]).otherwise(S.literal_map(OUTBOUND)[F.col("kind")])
    return kept.withColumn("reason", F.concat_ws(" ", phrase, "via_fqn"))


def dedup_edges(edges: DataFrame, scope: Sequence[str] = ("repository_id",)) -> DataFrame:
    """One edge per (kind, source, target, unresolved name): the greatest confidence, at the first one's place."""
    return edges.groupBy(*scope, "kind", "src_fqn", "dst_fqn", "dst_unresolved_name").agg(F.max("confidence").alias("confidence"), F.min("edge_id").alias("edge_id"))


def symbol_table(symbols: DataFrame, scope: Sequence[str] = ("repository_id",)) -> DataFrame:
    """Last definition of every fqn, with how many there were.  ``symbol_id`` is the order of definition."""
    s = symbols.groupBy(*scope, "fqn").agg(F.max(F.struct("symbol_id", "kind", "name", "parent_fqn")).alias("_s"), F.count("*").alias("definitions"))
    return s.select(*scope, "fqn", "_s.symbol_id", "_s.kind", "_s.name", "_s.parent_fqn", "definitions")


def candidates(symbols: DataFrame, scope: Sequence[str] = ("repository_id",)) -> DataFrame:
    """Per name: the number and the least fqn of its symbols and of its methods, and the least with another owner.

    One row per name however many symbols bear it, so that joining references to it never multiplies rows.
    """
    owner = F.coalesce("parent_fqn", F.lit(""))
    s = symbols.select(*scope, "name", "fqn", owner.alias("owner"), (F.col("kind") == "method").alias("is_method"))
    by_owner = s.groupBy(*scope, "name", "owner").agg(F.count("*").alias("n"), F.min("fqn").alias("f"), F.count_if("is_method").alias("nm"), F.min(F.when(F.col("is_method"), F.col("fqn"))).alias("fm"))
    first = Window.partitionBy(*scope, "name")
    ranked = by_owner.withColumns({"lead": F.min(F.struct("f", "owner")).over(first)["owner"], "lead_m": F.min(F.when(F.col("fm").isNotNull(), F.struct("fm", "owner"))).over(first)["owner"]})
    return ranked.groupBy(*scope, "name").agg(
        F.sum("n").alias("n"), F.min("f").alias("f"), F.sum("nm").alias("nm"), F.min("fm").alias("fm"), F.min("lead").alias("lead"), F.min("lead_m").alias("lead_m"),
        F.min(F.when(F.col("owner") != F.col("lead"), F.col("f"))).alias("f2"), F.min(F.when(F.col("owner") != F.col("lead_m"), F.col("fm"))).alias("fm2"))


def heuristic(refs: DataFrame, symbols: DataFrame, scope: Sequence[str] = ("repository_id",)) -> DataFrame:
    """References resolved by name alone.

    ``refs``: scope, ref_id, target_name, prefer_methods, exclude_owner (null: none).  Adds dst_fqn, dst_unresolved_name
    and confidence: no candidate 0.3, one 0.8, more the least fqn at 0.5.
    """
    own = symbols.filter("parent_fqn is not null").groupBy(*scope, F.col("name").alias("target_name"), F.col("parent_fqn").alias("exclude_owner")).agg(F.count("*").alias("own_n"), F.count_if(F.col("kind") == "method").alias("own_m"))
    r = refs.join(candidates(symbols, scope).withColumnRenamed("name", "target_name"), [*scope, "target_name"], "left").join(own, [*scope, "target_name", "exclude_owner"], "left")
    n = F.coalesce("n", F.lit(0)) - F.coalesce("own_n", F.lit(0))
    m = F.coalesce("nm", F.lit(0)) - F.coalesce("own_m", F.lit(0))
    out = F.coalesce("exclude_owner", F.lit("\x00"))
    f = F.when(F.col("lead") == out, F.col("f2")).otherwise(F.col("f"))
    fm = F.when(F.col("lead_m") == out, F.col("fm2")).otherwise(F.col("fm"))
    methods = F.col("prefer_methods") & (m > 0)
    count, dst = F.when(methods, m).otherwise(n), F.when(methods, fm).otherwise(f)
    c = S.CONFIDENCE
    return r.select(*refs.columns, F.when(count > 0, dst).alias("dst_fqn"), F.when(count > 0, None).otherwise(F.col("target_name")).alias("dst_unresolved_name"),
                    F.when(count == 0, c["unresolved"]).when(count == 1, c["heuristic_unique"]).otherwise(c["heuristic_ambiguous"]).alias("confidence"))


def members(symbols: DataFrame, bases: DataFrame, depth: int = 5, scope: Sequence[str] = ("repository_id",)) -> DataFrame:
    """Own and inherited members of every class: scope, owner, name, dst_fqn, depth; the nearest definition wins.

    ``bases``: scope, owner, base, ordinal.  Climbing is bounded by ``depth``, which also ends cycles.
    """
    own = cut(symbols.filter("parent_fqn is not null").groupBy(*scope, F.col("parent_fqn").alias("owner"), "name").agg(F.max_by("fqn", "symbol_id").alias("dst_fqn")))
    bases = cut(bases.select(*scope, "owner", "base", "ordinal"))
    out = own.select(*scope, "owner", "name", "dst_fqn", F.lit(0).alias("depth"), F.lit("").alias("way"))
    climb = bases.select(*scope, "owner", F.col("base").alias("at"), F.lpad(F.col("ordinal").cast("string"), 6, "0").alias("way"))
    step = bases.select(*scope, F.col("owner").alias("at"), F.col("base").alias("next"), F.lpad(F.col("ordinal").cast("string"), 6, "0").alias("turn"))
    for level in range(1, depth + 1):
        got = climb.join(own.select(*scope, F.col("owner").alias("at"), "name", "dst_fqn"), [*scope, "at"])
        out = out.unionByName(got.select(*scope, "owner", "name", "dst_fqn", F.lit(level).alias("depth"), "way"))
        if level < depth:
            climb = climb.join(step, [*scope, "at"]).select(*scope, "owner", F.col("next").alias("at"), F.concat("way", "turn").alias("way"))
    # depth first: the way through the bases, compared as text, is the order of a depth-first walk
    best = out.groupBy(*scope, "owner", "name").agg(F.min(F.struct("way", "depth", "dst_fqn")).alias("_b"))
    return best.select(*scope, "owner", "name", "_b.dst_fqn", "_b.depth")


def resolution_stats(edges: DataFrame, by: str = "language") -> DataFrame:
    """Totals and rates by ``by`` and over all (null): external names are counted but are in no rate; no edge gives 1."""
    outside = F.col("dst_fqn").isNull() & (F.col("confidence") == S.CONFIDENCE["external"])
    e = edges.select(by, F.col("dst_fqn").isNotNull().alias("ok"), outside.alias("ext"), (F.col("dst_fqn").isNull() & ~outside).alias("un"))
    g = e.rollup(by).agg(F.count("*").alias("edges"), F.count_if("ok").alias("resolved"), F.count_if("ext").alias("external"), F.count_if("un").alias("unresolved"), F.grouping(by).alias("is_total"))
    tried = F.col("resolved") + F.col("unresolved")
    return g.withColumn("rate", F.when(tried == 0, F.lit(1.0)).otherwise(F.round(F.col("resolved") / tried, 6)))
