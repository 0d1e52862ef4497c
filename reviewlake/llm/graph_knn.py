"""Problem 1: the most similar vectors of every vector.

Distinct vectors are dealt to shards by centroids; each shard builds a robust-pruned directed graph (see ``graph``) and
answers beam searches.  A vector is a member of the ``COPIES`` shards whose centroids are nearest to it and is searched in the
``PROBES`` nearest ones, so what a vector costs does not grow with their number.  What the searches propose is scored again in
double precision, the shards' bests are merged, and groups of vectors of one direction are put back in.

A shard holds ``SHARD`` vectors of its own on average (and as many copies), at all sizes; beyond ``MOST_SHARDS`` shards they
grow instead, as the centroids are broadcast.  Centroids are fitted on a sample of ``SAMPLE`` vectors a shard, ``MOST_SAMPLE``
at most; every vector is indexed.  A shard that comes out larger than four average ones is split at random, and its queries
search all parts; one with more than ``QUERIES_A_TASK`` queries is built again in further tasks.

Defined results: null, wrong-width, all-zero and non-finite vectors are left out, as are rows with a null id or model; of
rows that repeat a ``vector_id`` the smallest vector holds; scores are rounded to 6 places and ties go to the smaller id;
vectors whose directions agree to seven places are one point; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .graph import Graph

SHARD, MOST_SHARDS, COPIES, PROBES = 4096, 4096, 2, 4
SAMPLE, MOST_SAMPLE, ROUNDS = 64, 131_072, 6
DEGREE, BEAM, ALPHA = 20, 28, 1.2
#: Queries a shard's task answers at most; beyond, the shard is built again in another task.
QUERIES_A_TASK = 250_000


def usable(vectors: DataFrame, widths: dict[str, int] | None = None) -> DataFrame:
    """``embedding_model, vector_id, embedding`` once per id.  ``widths``: of each model; for others the most frequent."""
    v = vectors.select("embedding_model", "vector_id", "embedding").filter("embedding_model is not null and vector_id is not null and size(embedding) > 0")
    fine = v.filter(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0))
    if widths is None:
        counts = v.groupBy("embedding_model", F.size("embedding").alias("w")).count()
        widths = {r["embedding_model"]: r["w"] for r in counts.groupBy("embedding_model").agg(F.max_by("w", F.struct("count", "w")).alias("w")).collect()}
    ok = F.lit(False)
    for model, width in widths.items():
        ok = ok | (F.col("embedding_model") == model) & (F.size("embedding") == width)
    return fine.filter(ok).groupBy("embedding_model", "vector_id").agg(F.min("embedding").alias("embedding"))


def _shard_task(k: int, beam: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list[np.ndarray] = []
        raw: list[np.ndarray] = []
        graph = own = None
        for b in batches:
            query = b["is_query"].to_numpy()
            if not query.all():
                part = b[~query]
                ids.append(part["id"].to_numpy())
                raw.append(np.stack(part["embedding"].to_numpy()))
            b = b[query]
            if not len(b):
                continue
            if graph is None:
                if not ids:
                    return
                own = np.concatenate(ids)
                x = np.concatenate(raw).astype(np.float64)
                by = np.argsort(own)
                own, x = own[by], x[by]
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                graph = Graph(x, DEGREE, beam, ALPHA)
            q = np.stack(b["embedding"].to_numpy()).astype(np.float64)
            q /= np.linalg.norm(q, axis=1, keepdims=True)
            found, _ = graph.search(q, max(beam, k + 1), k + 1)
            score = np.round(np.einsum("bkd,bd->bk", x[np.maximum(found, 0)], q), 6)
            qid = b["id"].to_numpy()
            ok = (found >= 0) & (own[np.maximum(found, 0)] != qid[:, None])
            lack, near = 1.0 - score, own[np.maximum(found, 0)]
            yield pd.DataFrame({"embedding_model": b["embedding_model"].array, "id": qid, "lacks": [x[o][:k] for x, o in zip(lack, ok)], "ids": [x[o][:k] for x, o in zip(near, ok)]})

    return run


def centroids(x: np.ndarray, shards: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from ``shards`` of the vectors, which puts as many centroids where as much of the data is."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = x[np.random.default_rng(7).choice(len(x), shards, replace=False)]
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.where(norm > 0, norm, 1), c)
    return c.astype(np.float32)


def _route(points: DataFrame, fitted: dict[str, np.ndarray]) -> DataFrame:
    """Adds ``homes`` and ``asks``: the shards a point is a member of and those it is searched in."""
    sent = points.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["homes"], b["asks"] = [np.array([0], np.int32)] * len(b), [np.array([0], np.int32)] * len(b)
            for model, part in b.groupby("embedding_model"):
                c = sent.value.get(model)
                if c is None:
                    continue
                by = np.argsort(-(np.stack(part["embedding"].to_numpy()).astype(np.float32) @ c.T), axis=1, kind="stable").astype(np.int32)
                b.loc[part.index, "homes"] = pd.Series(list(by[:, :COPIES]), index=part.index)
                b.loc[part.index, "asks"] = pd.Series(list(by[:, :PROBES]), index=part.index)
            yield b

    return points.mapInPandas(run, "embedding_model string, id bigint, embedding array<float>, homes array<int>, asks array<int>")


def nearest(points: DataFrame, k: int, beam: int = BEAM, shard: int = SHARD) -> DataFrame:
    """``embedding_model, id, near`` for distinct points ``(embedding_model, id, embedding)``.

    ``near`` holds up to ``k`` others as ``struct<lack: double, id: bigint>``, ``lack`` being one minus the rounded score,
    nearest first.  Collected are the models' sizes, the sample the centroids are fitted on, and the shards' sizes.
    """
    sizes = {r["embedding_model"]: r["count"] for r in points.groupBy("embedding_model").count().collect()}
    if not sizes:
        return points.select("embedding_model", "id", F.expr("array(named_struct('lack', 0d, 'id', id))").alias("near")).limit(0)
    fitted: dict[str, np.ndarray] = {}
    for model, n in sorted(sizes.items()):
        shards = min(MOST_SHARDS, -(-n // shard))
        if shards > 1:
            sample = points.filter(F.col("embedding_model") == model).orderBy(F.xxhash64("id", F.lit(3)), "id").limit(min(n, MOST_SAMPLE, SAMPLE * shards)).select("embedding").toPandas()
            fitted[model] = centroids(np.stack(sample["embedding"].to_numpy()).astype(np.float64), min(shards, len(sample)))
    routed = cut(_route(points.select("embedding_model", "id", "embedding"), fitted))
    held = routed.select("embedding_model", F.explode("homes").alias("shard"), F.lit(1).alias("m"), F.lit(0).alias("q")).unionByName(routed.select("embedding_model", F.explode("asks").alias("shard"), F.lit(0).alias("m"), F.lit(1).alias("q")))
    total, rows = 0, []
    for r in held.groupBy("embedding_model", "shard").agg(F.sum("m").alias("m"), F.sum("q").alias("q")).orderBy("embedding_model", "shard").collect():
        parts, copies = max(1, -(-r["m"] // (4 * COPIES * max(shard, sizes[r["embedding_model"]] // MOST_SHARDS)))), max(1, -(-r["q"] // QUERIES_A_TASK))
        rows.append((r["embedding_model"], r["shard"], total, parts, copies))
        total += parts * copies
    # one row a shard and model, bounded by MOST_SHARDS
    plan = F.broadcast(points.sparkSession.createDataFrame(rows, "embedding_model string, shard int, at int, parts int, copies int"))
    member = F.transform("homes", lambda s: F.struct(s.alias("shard"), F.lit(False).alias("is_query")))
    asked = F.transform("asks", lambda s: F.struct(s.alias("shard"), F.lit(True).alias("is_query")))
    each = routed.select("embedding_model", "id", "embedding", F.explode(F.concat(member, asked)).alias("d")).select("embedding_model", "id", "embedding", "d.*").join(plan, ["embedding_model", "shard"])
    # a member is in one part, in all copies of its graph; a query goes to one copy of every part
    own, copy = F.pmod(F.xxhash64("id"), F.col("parts")), F.pmod(F.xxhash64("id", F.lit(1)), F.col("copies"))
    tasks = F.when(F.col("is_query"), F.expr("sequence(0, parts - 1)")).otherwise(F.expr("sequence(0, copies - 1)"))
    each = each.withColumns({"own": own, "copy": copy}).withColumn("t", F.explode(tasks))
    task = F.col("at") + F.when(F.col("is_query"), F.col("t") * F.col("copies") + F.col("copy")).otherwise(F.col("own") * F.col("copies") + F.col("t"))
    dealt = each.select("embedding_model", "id", "embedding", "is_query", task.cast("int").alias("task")).repartitionById(total, F.col("task")).sortWithinPartitions("is_query")
    found = dealt.select("embedding_model", "id", "embedding", "is_query").mapInPandas(_shard_task(k, beam), "embedding_model string, id bigint, lacks array<double>, ids array<bigint>")
    found = found.select("embedding_model", "id", F.arrays_zip(F.col("lacks").alias("lack"), F.col("ids").alias("id")).alias("near"))
    # a point that several shards found stands beside itself once all are sorted
    every = found.groupBy("embedding_model", "id").agg(F.sort_array(F.flatten(F.collect_list("near"))).alias("every"))
    once = F.filter("every", lambda x, i: (i == 0) | (F.get("every", i - 1)["id"] != x["id"]))
    return every.select("embedding_model", "id", F.slice(once, 1, k).alias("near"))


def most_similar(vectors: DataFrame, k: int = 10, widths: dict[str, int] | None = None, beam: int = BEAM) -> DataFrame:
    """``embedding_model, vector_id, best``: the ``k`` best others of every usable vector, ``struct<lack, id>`` each.

    Vectors of one direction are searched once.  Of a group of them only the ``k + 1`` smallest ids can be among anyone's best, so no
    group is ever collected; the row-number limit is applied before the shuffle as well as after it.
    """
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    # the norm is bound once a row, or it would be summed anew for every element
    way = F.transform(F.array(norm), lambda n: F.transform("embedding", lambda x: F.rint(x.cast("double") / n * 1e7)))[0]
    base = usable(vectors, widths).withColumn("way", way)
    base = cut(base.withColumns({"h1": F.xxhash64("way"), "h2": F.xxhash64(F.lit(7), "way")}).drop("way"))
    key = ["embedding_model", "h1", "h2"]
    groups = base.groupBy(key).agg(F.min("vector_id").alias("id"), F.min_by("embedding", "vector_id").alias("embedding"))
    order = Window.partitionBy(key).orderBy("vector_id")
    heads = base.select(*key, "vector_id").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).groupBy(key).agg(F.sort_array(F.collect_list("vector_id")).alias("members")).withColumn("id", F.col("members")[0])
    near = nearest(groups.select("embedding_model", "id", "embedding"), k, beam)
    beside = near.select("embedding_model", F.col("id").alias("of"), F.explode("near").alias("c")).select("embedding_model", "of", F.col("c.lack").alias("lack"), F.col("c.id").alias("id"))
    spread = beside.join(heads.select("embedding_model", "id", "members"), ["embedding_model", "id"]).select("embedding_model", "of", F.transform("members", lambda m: F.struct(F.col("lack").alias("lack"), m.alias("id"))).alias("part"))
    own = heads.select("embedding_model", F.col("id").alias("of"), F.transform("members", lambda m: F.struct(F.lit(0.0).alias("lack"), m.alias("id"))).alias("part"))
    best = spread.unionByName(own).groupBy("embedding_model", "of").agg(F.slice(F.sort_array(F.flatten(F.collect_list("part"))), 1, k + 1).alias("best"))
    keyed = heads.select(*key, F.col("id").alias("of")).join(best, ["embedding_model", "of"])
    return base.select(*key, "vector_id").join(keyed, key).select("embedding_model", "vector_id", F.slice(F.filter("best", lambda x: x["id"] != F.col("vector_id")), 1, k).alias("best"))


def neighbour_pairs(vectors: DataFrame, k: int = 10, widths: dict[str, int] | None = None) -> DataFrame:
    """``vector_id_a < vector_id_b`` of every pair of which one is among the other's ``k`` best."""
    best = most_similar(vectors, k, widths).select(F.col("vector_id").alias("v"), F.explode("best.id").alias("o"))
    return best.select(F.least("v", "o").alias("vector_id_a"), F.greatest("v", "o").alias("vector_id_b")).distinct()
