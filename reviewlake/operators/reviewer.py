"""Asking a model about many requests, recording its answers, and playing them back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import prompt_key

SCHEMA = "request_id string, prompt_key string, payload string, input_tokens bigint, output_tokens bigint, cost double, model string, error string"


def review(requests: DataFrame, complete: Callable[[str, str], dict], parallel: int = 4) -> DataFrame:
    """Asks ``complete(system, user)`` about every request (request_id, system, user).

    ``complete`` is sent to the executors and gives a dict with ``text`` and, if known, ``input_tokens, output_tokens,
    cost, model``.  ``parallel`` partitions bound how many ask at once.  A request that fails keeps its error, and the
    others go on; missing token counts are 0.
    """
    if parallel < 1:
        raise ValueError("parallel must be positive")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, k, system, user in zip(b["request_id"], b["prompt_key"], b["system"], b["user"]):
                try:
                    r = complete(system, user)
                    rows.append((i, k, r["text"], int(r.get("input_tokens") or 0), int(r.get("output_tokens") or 0), float(r.get("cost") or 0), r.get("model"), None))
                except Exception as e:  # noqa: BLE001 - whatever goes wrong belongs to this request alone
                    rows.append((i, k, None, 0, 0, 0.0, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    asked = requests.select(F.col("request_id").cast("string").alias("request_id"), prompt_key("system", "user").alias("prompt_key"), "system", "user")
    return asked.repartition(parallel).mapInPandas(run, SCHEMA)


def record(answers: DataFrame, path: str) -> None:
    """Writes answers as JSON lines in the order of their keys; failed ones are left out."""
    answers.filter("error is null").dropDuplicates(["prompt_key"]).select("prompt_key", "payload", "model").orderBy("prompt_key").write.mode("overwrite").json(path)


def replay(requests: DataFrame, cassette: DataFrame, strict: bool = True) -> DataFrame:
    """Recorded answers to requests, at no cost.  A request without one fails the job if ``strict``, else has no payload."""
    asked = requests.select(F.col("request_id").cast("string").alias("request_id"), prompt_key("system", "user").alias("prompt_key"))
    got = asked.join(cassette.select("prompt_key", "payload").dropDuplicates(["prompt_key"]), "prompt_key", "left")
    if strict:
        got = got.withColumn("payload", F.coalesce("payload", F.raise_error(F.concat(F.lit("no recording of "), "prompt_key")).cast("string")))
    return got.withColumn("cost", F.lit(0.0))


def outcome(answers: DataFrame, by: str = "run_id") -> DataFrame:
    """Answers put together: tokens, cost, failures, completeness (1 without requests), models in order."""
    failed = F.count_if(F.col("error").isNotNull())
    return answers.groupBy(by).agg(F.count("*").alias("requests"), failed.alias("failures"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("cost"), 6).alias("cost"),
                                   F.round(1 - failed / F.count("*"), 6).alias("completeness"), F.array_sort(F.collect_set("model")).alias("models"))
