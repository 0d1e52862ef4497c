"""Problem 6: source files that do not parse.

Each text is read by the packrat grammar of its path's language, which must consume the whole input; where it fails, the
furthest position tells the line and what stands there the cause.  The grammar alone decides; tests hold the one of Python
against CPython's own parser, over the standard library and over altered texts.

Defined results: a null path or a path without a known extension is never flagged; null content is read as empty, and an
empty text is valid; of rows that repeat a ``file_id``, the file is flagged if any of its rows is invalid.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from . import grammar_python, grammar_script
from .languages import LABELS, grammar_of

#: Nested expressions take Python frames, which lie on the heap.
DEPTH = 200_000

_CONFLICT = re.compile(r"^(<{7}( |$)|={7}$|>{7}( |$)|\|{7}( |$))", re.M)
_OTHER = re.compile(r"\s*(#!/bin/(ba|z)?sh|<\?php|<!doctype|<html|package\s+\w+\s*$|select\b.+\bfrom\b|#include\b|\{\s*\"|import\s+\w+\nfrom\s)", re.I | re.M)


def _cause(content: str, at: int, grammar: str) -> str:
    rest, end = content[at:], len(content.rstrip())
    line = content.rfind("\n", 0, at) + 1
    if _CONFLICT.search(content[line : at + 8]) or re.match(r"[<>=|]{3,}", rest) and _CONFLICT.search(content):
        return "merge conflict"
    if _OTHER.match(content):
        return "other language"
    if at >= end:
        return "truncated"
    return "syntax"


def verdict(path: str | None, content: str | None) -> tuple[str | None, bool, int | None, str | None]:
    """(language, valid, failure line, cause)."""
    grammar = grammar_of(path)
    if grammar is None:
        return None, True, None, None
    content = content or ""
    if sys.getrecursionlimit() < DEPTH:
        sys.setrecursionlimit(DEPTH)
    if grammar == "python":
        ok, at, _ = grammar_python.parse(content)
    else:
        end, at, _, ok = grammar_script.parser(grammar)(content)
    if ok:
        return LABELS[grammar], True, None, None
    at = min(at, len(content))
    return LABELS[grammar], False, content.count("\n", 0, at) + 1, _cause(content, at, grammar)


def check_syntax(files: DataFrame) -> DataFrame:
    """One row per input row: ``file_id, repository_id, grammar_language, is_valid, fail_line, cause``.

    Only the four columns it needs are read; one pass over the texts, nothing is shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [verdict(p, c) for p, c in zip(b["path"], b["content"])]
            yield pd.DataFrame({
                "file_id": b["file_id"].array, "repository_id": b["repository_id"].array,
                "grammar_language": [x[0] for x in got], "is_valid": [x[1] for x in got],
                "fail_line": pd.array([x[2] for x in got], dtype="Int32"), "cause": [x[3] for x in got],
            })

    return spread(files.select("file_id", "repository_id", "path", "content")).mapInPandas(run, "file_id bigint, repository_id string, grammar_language string, is_valid boolean, fail_line int, cause string")


def invalid_files(files: DataFrame) -> DataFrame:
    """The ``file_id`` of every file that is not valid in the language of its path, once."""
    return check_syntax(files).filter(~F.col("is_valid")).select("file_id").distinct()


def failure_rates(files: DataFrame) -> DataFrame:
    """Files, invalid files and their rate by repository and language, with the counts of each cause.

    Repeated rows of a file are counted once: rows are folded to one per file before the groups are, so that a group that
    holds a third of all files is counted by partial sums.
    """
    one = check_syntax(files).filter(F.col("grammar_language").isNotNull()).groupBy("file_id").agg(
        F.min("repository_id").alias("repository_id"), F.min("grammar_language").alias("language"),
        F.max((~F.col("is_valid")).cast("int")).alias("bad"), F.max("cause").alias("cause"))
    causes = {"merge conflict": "conflicts", "truncated": "truncated", "other language": "other_language", "syntax": "other_errors"}
    return one.groupBy("repository_id", "language").agg(
        F.count("*").alias("files"), F.sum("bad").alias("invalid"), F.round(F.sum("bad") / F.count("*"), 6).alias("rate"),
        *(F.sum((F.col("cause") == c).cast("bigint")).alias(n) for c, n in causes.items())).fillna(0, list(causes.values()))
