"""Chunks at symbol boundaries, and the vocabulary of a repository."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

CONTAINERS = ["class", "interface", "enum"]
CHUNKABLE = ["function", "method", "class", "interface", "type_alias", "enum"]


def symbol_chunks(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """One chunk per chunkable symbol: its lines, for containers without those of their members; empty ones are left out.

    A symbol's members are folded to an array of spans per parent and meet it and its file on ``file_id``; a line is never
    a row of its own.  Line ends may be CR LF or LF; symbols that end behind the file are cut there.
    """
    s = symbols.filter(F.col("kind").isin(CHUNKABLE) & (F.col("line_start") >= 1))
    members = s.filter("parent_fqn is not null").groupBy("file_id", F.col("parent_fqn").alias("fqn")).agg(F.collect_list(F.struct(F.col("line_start").alias("s"), F.col("line_end").alias("e"))).alias("_spans"))
    text = files.select("file_id", F.split(F.regexp_replace(F.coalesce("content", F.lit("")), "\r\n?", "\n"), "\n").alias("_lines"))
    own = F.expr("slice(_lines, line_start, greatest(0, line_end - line_start + 1))")
    spans = F.when(F.col("kind").isin(CONTAINERS) & F.col("_spans").isNotNull(), F.col("_spans")).otherwise(F.expr("cast(array() as array<struct<s:int,e:int>>)"))
    cut = s.join(members, ["file_id", "fqn"], "left").join(text, "file_id").withColumn("_own", own).withColumn("_spans", spans)
    kept = F.filter("_own", lambda x, i: ~F.exists("_spans", lambda c: (i + F.col("line_start") >= c["s"]) & (i + F.col("line_start") <= c["e"])))
    out = cut.withColumn("body", S.normalise_body(kept)).filter("body <> ''")
    return out.withColumns({"content_hash": S.content_hash("repository_id", "path", "fqn", "body"), "token_count": S.token_count("body")}).drop("_lines", "_own", "_spans")


def vocabulary(symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """``repository_id, token``: names, their tails and the identifiers of chunks, each once.

    Identifiers are made distinct per chunk before they are exploded, and per partition before the shuffle.
    """
    names = symbols.select("repository_id", F.col("fqn").alias("token"))
    tails = symbols.select("repository_id", S.fqn_tail("fqn").alias("token"))
    words = chunks.select("repository_id", F.explode(S.identifiers("content")).alias("token"))
    return names.unionByName(tails).unionByName(words).distinct()
