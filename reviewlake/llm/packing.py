"""Problem 7: filling fixed-capacity containers.

Documents are dealt at random into groups of bounded size; each group is packed by first-fit decreasing, a tournament tree
over the bins' free room giving the first bin that fits in logarithmic time.  Only a document that alone exceeds the
capacity is split: into full containers of its own and one rest that is packed like any other.

Defined results: a null token count is taken from the text (matches of ``\\w+|[^\\w\\s]+``), null text having none; a document
without tokens is placed as an empty piece; negative counts are read as null; rows with a null id are left out; rows that
repeat a ``doc_id`` count once, the one with the most tokens holding.  A bin's number is unique over all groups.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

CAPACITY = 2048
#: Documents a group holds on average; one group is packed in one task's memory.
GROUP = 25_000

_TOKEN = re.compile(r"\w+|[^\w\s]+")


class Bins:
    """Open bins with a tournament tree of their free room."""

    def __init__(self, capacity: int):
        self.capacity, self.leaves, self.count = capacity, 1, 0
        self.tree = [capacity, capacity]  # tree[1] is the root, leaves follow at ``leaves``

    def place(self, size: int) -> int:
        """The first bin with room for ``size``; a new one if none has."""
        if self.tree[1] < size or self.count == 0:
            return self._take(self._open(), size)
        at = 1
        while at < self.leaves:
            at *= 2
            if self.tree[at] < size:
                at += 1
        bin_ = at - self.leaves
        if bin_ >= self.count:
            bin_ = self._open()
        return self._take(bin_, size)

    def _open(self) -> int:
        if self.count == self.leaves:
            rooms = self.tree[self.leaves :]
            self.leaves *= 2
            self.tree = [0] * self.leaves + rooms + [self.capacity] * (self.leaves - len(rooms))
            for at in range(self.leaves - 1, 0, -1):
                self.tree[at] = max(self.tree[2 * at], self.tree[2 * at + 1])
        self.count += 1
        return self.count - 1

    def _take(self, bin_: int, size: int) -> int:
        at = self.leaves + bin_
        self.tree[at] -= size
        at //= 2
        while at:
            room = max(self.tree[2 * at], self.tree[2 * at + 1])
            if self.tree[at] == room:
                break
            self.tree[at] = room
            at //= 2
        return bin_


def first_fit_decreasing(sizes: list[tuple[int, int, int]], capacity: int) -> list[int]:
    """The bin of each ``(size, ...)``, in the order given."""
    bins, out = Bins(capacity), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i][0], *sizes[i][1:])):
        out[i] = bins.place(sizes[i][0])
    return out


@pandas_udf(LongType())
def count_tokens(text: pd.Series) -> pd.Series:
    return text.map(lambda t: 0 if t is None else sum(1 for _ in _TOKEN.finditer(t))).astype("int64")


def token_counts(documents: DataFrame) -> DataFrame:
    """``doc_id, n_tokens``: the given count, or the text's where it is null or negative.  Texts are sent to Python for
    those rows alone."""
    d = documents.select("doc_id", "text", "n_tokens").filter("doc_id is not null")
    known = d.filter("n_tokens >= 0").select("doc_id", "n_tokens")
    counted = d.filter("n_tokens is null or n_tokens < 0").select("doc_id", count_tokens("text").alias("n_tokens"))
    return known.unionByName(counted).groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))


def pack(documents: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``batch_id, doc_id, part_no, token_start, token_end``: every token of every document once, no bin over ``capacity``.

    The number of groups follows from the number of documents, so that each is packed within one task whatever the
    table's size.  A batch id is the group's number and the bin's, joined.
    """
    if capacity < 1 or group < 1:
        raise ValueError("capacity and group must be positive")
    sizes = token_counts(documents)
    total = documents.select("doc_id").count()
    groups = max(1, round(total / group))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows come sorted by group: one group's sizes are in memory at a time
        held: list[tuple[int, int]] = []
        current = None

        def flush() -> pd.DataFrame:
            out, rests, bins = [], [], 0
            for doc, n in held:
                full = n // capacity if n > capacity else 0
                for part in range(full):
                    out.append((current, bins, doc, part + 1, part * capacity, (part + 1) * capacity))
                    bins += 1
                if n - full * capacity or not n:
                    rests.append((n - full * capacity, doc, full))
            for (size, doc, full), bin_ in zip(rests, first_fit_decreasing(rests, capacity)):
                out.append((current, bins + bin_, doc, full + 1, full * capacity, full * capacity + size))
            d = pd.DataFrame(out, columns=["g", "b", "doc_id", "part_no", "token_start", "token_end"])
            return pd.DataFrame({"batch_id": d["g"] * (1 << 32) + d["b"], **{c: d[c] for c in ("doc_id", "part_no", "token_start", "token_end")}})

        for b in batches:
            for g, doc, n in zip(b["g"].tolist(), b["doc_id"].tolist(), b["n_tokens"].tolist()):
                if g != current:
                    if held:
                        yield flush()
                    held, current = [], g
                held.append((doc, n))
        if held:
            yield flush()

    dealt = sizes.withColumn("g", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(groups))).repartition(groups, "g").sortWithinPartitions("g", "doc_id")
    return dealt.select("g", "doc_id", "n_tokens").mapInPandas(run, "batch_id bigint, doc_id bigint, part_no bigint, token_start bigint, token_end bigint")
