"""Context retrieval: spans, candidates, fused scores, token budget, vector search."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import cut
from .graph import expand


def symbols_in_spans(symbols: DataFrame, spans: DataFrame) -> DataFrame:
    """Symbols that overlap a span of the same file: request_id, symbol columns, each once per request.

    ``spans``: request_id, repository_id, path, span_start, span_end.  The file is the equi-join key; the overlap is
    checked within it.
    """
    j = symbols.join(spans.select("request_id", "repository_id", "path", "span_start", "span_end"), ["repository_id", "path"])
    return j.filter(S.spans_overlap("line_start", "line_end", "span_start", "span_end")).drop("span_start", "span_end").distinct()


def innermost(symbols: DataFrame, spans: DataFrame) -> DataFrame:
    """Every span with the narrowest symbol around or across it (then the earliest, then the least fqn); null if none."""
    s = spans.join(symbols.select("repository_id", "path", "fqn", "line_start", "line_end"), ["repository_id", "path"], "left")
    hit = S.spans_overlap("line_start", "line_end", "span_start", "span_end")
    best = F.min(F.when(hit, F.struct((F.col("line_end") - F.col("line_start")).alias("w"), F.col("line_start").alias("s"), F.col("fqn").alias("f"))))
    return s.groupBy(spans.columns).agg(best["f"].alias("symbol_fqn"))


def in_request_order(requests: DataFrame, items: DataFrame, key: str, scope: Sequence[str] = ("repository_id",)) -> DataFrame:
    """Items of a request's own scope looked up by its list of keys, with the place of the key in the list.

    ``requests``: request_id, scope, keys (array).
    """
    return requests.select("request_id", *scope, F.posexplode("keys").alias("pos", key)).join(items, [*scope, key])


def fused(items: DataFrame) -> DataFrame:
    """Adds ``score`` to items with ``provenance, proximity, similarity``: 1 for anchors, else the fused score."""
    return items.withColumn("score", F.when(F.col("provenance") == "anchor", F.lit(1.0)).otherwise(S.fuse(F.coalesce("proximity", F.lit(0.0)), S.clamp(F.coalesce("similarity", F.lit(0.0))), F.lit(0.0))))


def enforce_budget(items: DataFrame, budget: int) -> DataFrame:
    """Whole items under a token budget: anchors first and always, then by score, skipping what does not fit.

    ``items``: request_id, provenance, score, path, line_start, content_hash, token_count.  Adds ``position`` (null if
    dropped).  Skipping makes it a fold, not a running sum: it runs over one array per request, which holds the
    request's candidates -- a few per level and semantic limit -- and never a table.
    """
    if budget < 1:
        raise ValueError("budget must be positive")
    row = items.select(F.struct(*items.columns).alias("r")).schema["r"].dataType.simpleString()
    key = F.struct((F.col("provenance") != "anchor").alias("later"), (-F.col("score")).alias("lack"), F.col("path").alias("path"), F.col("line_start").alias("line"), F.col("content_hash").alias("hash"), F.col("token_count").cast("bigint").alias("t"), F.struct(*items.columns).alias("row"))
    g = items.groupBy("request_id").agg(F.array_sort(F.collect_list(key)).alias("all"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(0).alias("n"), F.array().cast(f"array<struct<row:{row},position:int>>").alias("out"))

    def step(acc, x):
        fits = ~x["later"] | (acc["used"] + x["t"] <= budget)
        mine = F.struct(x["row"].alias("row"), F.when(fits, acc["n"] + 1).alias("position"))
        return F.struct((acc["used"] + F.when(fits, x["t"]).otherwise(0)).alias("used"), (acc["n"] + F.when(fits, 1).otherwise(0)).alias("n"), F.concat(acc["out"], F.array(mine)).alias("out"))

    return g.select(F.explode(F.aggregate("all", start, step)["out"]).alias("o")).select("o.row.*", "o.position")


def pack_stats(packed: DataFrame, budget: int) -> DataFrame:
    """Per request: items kept by provenance, dropped, tokens and the share of the budget used."""
    kept = F.col("position").isNotNull()
    n = lambda p: F.count_if(kept & (F.col("provenance") == p))
    used = F.coalesce(F.sum(F.when(kept, F.col("token_count"))), F.lit(0))
    return packed.groupBy("request_id").agg(n("anchor").alias("anchors"), n("graph").alias("graph"), n("semantic").alias("semantic"), F.count_if(~kept).alias("dropped"), used.cast("bigint").alias("tokens"), F.round(used / budget, 6).alias("utilization"))


def exact_topk(queries: DataFrame, vectors: DataFrame, k: int, group: str | Sequence[str], exclude: str | None = None, block: int = 1024, chunk: int = 8192) -> DataFrame:
    """The ``k`` vectors of highest cosine for every query within its ``group``; ties go to the smaller key.

    ``queries``: query_id, group, embedding [, exclude: a value or an array of them]; ``vectors``: key, group, embedding
    [, exclude].  A group of any size is cut into blocks of queries and of vectors; every pair of blocks is a task's matrix
    product, of which only the best ``k`` are shuffled.  Rows whose ``exclude`` is among the query's are left out before the
    limit.  A ``k`` of 0 or less gives no rows; zero vectors score 0.
    """
    if k <= 0:
        return queries.select("query_id", F.lit(None).cast("string").alias("key"), F.lit(None).cast("double").alias("score")).limit(0)
    keys = [group] if isinstance(group, str) else list(group)
    blocks = lambda df, size, name: df.groupBy(keys).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    plan = blocks(queries, block, "_qs").join(blocks(vectors, chunk, "_vs"), keys)

    def dealt(df: DataFrame, name: str, own: str, others: str) -> DataFrame:
        cols = [F.col(name).alias("id"), F.col("embedding").alias("v"), (F.col(exclude) if exclude else F.lit(None).cast("string")).alias("x")]
        d = df.select(*keys, *cols).join(plan, keys).withColumn(f"_{own}", F.pmod(F.xxhash64("id"), F.col(f"_{own}s")))
        d = d.withColumn(f"_{others}", F.explode(F.sequence(F.lit(0), F.col(f"_{others}s") - 1)))
        where = [F.col(c).alias(f"{own}_{i}") for i, c in enumerate(keys)] + [F.col(c).cast("int").alias(f"{own}{c}") for c in ("_q", "_v")]
        return d.select(*where, "id", "v", "x").groupBy(*[f"{own}_{i}" for i in range(len(keys))], f"{own}_q", f"{own}_v")

    def run(qs: pd.DataFrame, vs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(vs):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "best": pd.Series(dtype=object)})
        vs = vs.assign(id=vs["id"].astype(str)).sort_values("id", kind="stable")
        unit = []
        for side in (qs, vs):
            m = np.stack(side["v"].to_numpy()).astype(np.float64)
            n = np.linalg.norm(m, axis=1, keepdims=True)
            unit.append(m / np.where(n == 0, 1, n))
        s = np.round(unit[0] @ unit[1].T, 6)
        if exclude:
            of = vs["x"].to_numpy(object)
            for i, x in enumerate(qs["x"]):
                s[i, np.isin(of, list(x) if isinstance(x, (np.ndarray, list)) else [x])] = -9
        best = np.argsort(-s, axis=1, kind="stable")[:, :k]
        got, names = np.take_along_axis(s, best, 1), vs["id"].to_numpy()
        return pd.DataFrame({"query_id": qs["id"].array, "best": [[{"lack": 1 - float(c), "key": names[j]} for j, c in zip(best[i], got[i]) if c > -9] for i in range(len(qs))]})

    part = dealt(queries, "query_id", "q", "v").cogroup(dealt(vectors, "key", "v", "q")).applyInPandas(run, "query_id bigint, best array<struct<lack:double,key:string>>")
    merged = part.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    return merged.select("query_id", F.posexplode("best").alias("place", "b")).select("query_id", (F.col("place") + 1).alias("place"), F.col("b.key").alias("key"), F.round(1 - F.col("b.lack"), 6).alias("score"))


def candidates(spans: DataFrame, symbols: DataFrame, chunks: DataFrame, edges: DataFrame, embed: Callable[[Column], Column], semantic_limit: int = 5) -> DataFrame:
    """What may go into each request's pack: ``request_id, repository_id, fqn, path, line_start, content_hash, token_count, body,
    provenance, proximity, similarity, score, reason``.

    ``spans``: request_id (a number), repository_id, path, span_start, span_end; ``chunks``: repository_id, fqn, path, line_start,
    content_hash, token_count, body.  Anchors are the chunks of symbols that a span touches, graph items those of symbols
    around them, semantic items those nearest to the anchors' bodies, found in the repository outside the anchors' files
    and left out if the others hold them or their file.  The search limit comes before that, so fewer may remain.
    """
    own = chunks.select("repository_id", "fqn", "path", "line_start", "content_hash", "token_count", "body").distinct()
    named = cut(symbols_in_spans(symbols, spans).select("request_id", "repository_id", "fqn").distinct())
    zero = F.lit(0.0)
    anchors = named.join(own, ["repository_id", "fqn"]).withColumns({"provenance": F.lit("anchor"), "proximity": F.lit(1.0), "similarity": zero, "reason": F.lit("changed by this diff")})
    around = expand(named, edges).select("request_id", "repository_id", "fqn", "proximity", "reason")
    graph = around.join(own, ["repository_id", "fqn"]).withColumns({"provenance": F.lit("graph"), "similarity": zero})
    held = cut(anchors.unionByName(graph))
    if semantic_limit <= 0:
        return fused(held)
    # a request's anchors are the symbols of a few spans
    bodies = held.filter("provenance = 'anchor'").groupBy(F.col("request_id").alias("query_id"), "repository_id").agg(F.sort_array(F.collect_list(F.struct("path", "line_start", "content_hash", "body"))).alias("a"))
    asked = bodies.select("query_id", "repository_id", embed(F.array_join("a.body", "\n\n")).alias("embedding"), F.array_distinct("a.path").alias("beside"))
    stored = own.groupBy("repository_id", F.col("content_hash").alias("key")).agg(F.min("path").alias("beside"), F.min("body").alias("body")).withColumn("embedding", embed(F.col("body")))
    hits = exact_topk(asked, stored, semantic_limit, "repository_id", "beside").join(asked.select("query_id", "repository_id"), "query_id")
    hits = hits.select(F.col("query_id").alias("request_id"), "repository_id", F.col("key").alias("content_hash"), F.col("score").alias("found"))
    near = hits.join(own, ["repository_id", "content_hash"])
    near = near.join(held.select("request_id", "content_hash").distinct(), ["request_id", "content_hash"], "left_anti").join(held.select("request_id", "path").distinct(), ["request_id", "path"], "left_anti")
    near = near.withColumns({"provenance": F.lit("semantic"), "proximity": zero, "similarity": S.clamp("found")})
    return fused(held.unionByName(near.withColumn("reason", F.format_string("similar to the changed code (cosine %.2f)", "similarity")).drop("found")))


class SnapshotNotReady(LookupError):
    """A repository has no ready snapshot."""


class EmbeddingModelMismatch(ValueError):
    """The serving snapshot was embedded by another model."""


def guard(requests: DataFrame, serving: DataFrame) -> DataFrame:
    """HTTP status of search requests (repository_id, model): 404 without a ready snapshot, 409 for another model, else 200."""
    r = requests.join(serving.select("repository_id", "snapshot_id", "embedding_model"), "repository_id", "left")
    return r.withColumn("status", F.when(F.col("snapshot_id").isNull(), 404).when(F.col("embedding_model") != F.col("model"), 409).otherwise(200))


def check(requests: DataFrame, serving: DataFrame) -> None:
    """Raises for the first request that may not be served."""
    bad = guard(requests, serving).filter("status <> 200").orderBy("status", "repository_id").first()
    if bad is not None:
        raise (SnapshotNotReady if bad["status"] == 404 else EmbeddingModelMismatch)(bad["repository_id"])
