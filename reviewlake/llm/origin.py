"""Problem 5: generated, minified, vendored and data files.

The rules are in ``layout``.  Defined results: a null or blank text is hand-written (no case); a null path gives no path
evidence; rows that repeat a ``file_id`` give it once, if any of its rows is a case.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .layout import origin
from .syntax import verdict


def classify_origin(files: DataFrame) -> DataFrame:
    """One row per input row: ``file_id, origin``; ``origin`` is null for hand-written text.  No shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"file_id": b["file_id"].array, "origin": [origin(p, c, lambda p, c: verdict(p, c)[1]) for p, c in zip(b["path"], b["content"])]})

    return spread(files.select("file_id", "path", "content")).mapInPandas(run, "file_id bigint, origin string")


def not_hand_written(files: DataFrame) -> DataFrame:
    """The ``file_id`` of every file that is not hand-written, once."""
    return classify_origin(files).filter(F.col("origin").isNotNull()).select("file_id").distinct()
