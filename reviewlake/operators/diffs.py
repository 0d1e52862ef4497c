"""Unified diffs: hunk headers and line numbers with columns and windows, the full parse with a scan of each text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@(.*)$"


def lines(diffs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, line_no, line``: the lines of every diff, CR LF or LF."""
    return diffs.select(key, F.posexplode(F.split(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), "\n")).alias("line_no", "line"))


def hunk_headers(numbered: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per hunk header; an omitted count is 1; ``new_end`` is the last line a hunk covers, one at least."""
    h = numbered.filter(F.col("line").rlike(HUNK))
    part = lambda i: F.regexp_extract("line", HUNK, i)
    num = lambda i: F.when(part(i) == "", F.lit(1)).otherwise(part(i).try_cast("int"))
    out = h.select(key, "line_no", num(1).alias("old_start"), num(2).alias("old_count"), num(3).alias("new_start"), num(4).alias("new_count"), F.trim(part(5)).alias("heading"))
    return out.withColumn("new_end", F.col("new_start") + F.greatest(F.col("new_count"), F.lit(1)) - 1)


def line_numbers(numbered: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, line_no, sign, old_line, new_line`` of every body line within the counts of its hunk.

    The running counts are window sums over a hunk; hunks are numbered by a running count over a text.
    """
    is_head = F.col("line").rlike(HUNK)
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    h = hunk_headers(numbered, key).select(key, "old_start", "old_count", "new_start", "new_count", F.row_number().over(Window.partitionBy(key).orderBy("line_no")).alias("hunk"))
    body = numbered.withColumn("hunk", F.sum(is_head.cast("int")).over(w)).filter((F.col("hunk") > 0) & ~is_head)
    sign = F.when(F.col("line") == "", " ").otherwise(F.substring("line", 1, 1))
    b = body.withColumn("sign", sign).filter(F.col("sign").isin("+", "-", " "))
    inside = Window.partitionBy(key, "hunk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumns({"olds": F.sum((F.col("sign") != "+").cast("int")).over(inside), "news": F.sum((F.col("sign") != "-").cast("int")).over(inside)})
    j = b.join(h, [key, "hunk"])
    ok = (F.col("olds") <= F.col("old_count")) & (F.col("news") <= F.col("new_count"))
    return j.filter(ok).select(key, "line_no", "sign", F.when(F.col("sign") != "+", F.col("old_start") + F.col("olds") - 1).alias("old_line"), F.when(F.col("sign") != "-", F.col("new_start") + F.col("news") - 1).alias("new_line"))


def touched(headers: DataFrame, key: str = "doc_id") -> DataFrame:
    """Hunks, their hull and the number of distinct lines they cover, without listing the lines: overlaps count once."""
    before = Window.partitionBy(key).orderBy("new_start", "new_end").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("new_end").over(before), F.lit(-1))
    fresh = F.greatest(F.lit(0), F.col("new_end") - F.greatest(F.col("new_start") - 1, reach))
    return headers.withColumn("_n", fresh).groupBy(key).agg(F.count("*").alias("hunks"), F.min("new_start").alias("first_line"), F.max("new_end").alias("last_line"), F.sum("_n").alias("touched_lines"))


_FILE = re.compile(r"^diff --git (.+?) (.+)$")
_HUNK = re.compile(HUNK)


def _path(text: str) -> str | None:
    text = text.split("\t")[0].strip()
    if text.startswith('"') and text.endswith('"'):
        text = text[1:-1].encode().decode("unicode_escape", "replace")
    return None if text == "/dev/null" else re.sub(r"^[ab]/", "", text)


def parse(text: str | None) -> tuple[list[dict], str | None]:
    """The files of a diff with their hunks, and an error if a hunk's body is shorter than its header says."""
    files: list[dict] = []
    rows = re.split(r"\r\n|\n", text or "")
    i = 0
    while i < len(rows):
        m = _FILE.match(rows[i])
        if not m:
            i += 1
            continue
        f = {"path": _path(m[2]), "old_path": None, "status": "modified", "is_binary": False, "hunks": []}
        files.append(f)
        i += 1
        while i < len(rows) and not _FILE.match(rows[i]):
            x = rows[i]
            h = _HUNK.match(x)
            if h:
                old, new = int(h[2] or 1), int(h[4] or 1)
                at_old, at_new, start = int(h[1]), int(h[3]), int(h[3])
                added, removed = [], []
                i += 1
                while (old > 0 or new > 0) and i < len(rows):
                    s = rows[i][:1] or " "
                    if s == "\\":
                        i += 1
                        continue
                    if s not in "+- ":
                        break
                    if s != "-":
                        if s == "+":
                            added.append(at_new)
                        at_new, new = at_new + 1, new - 1
                    if s != "+":
                        if s == "-":
                            removed.append(at_old)
                        at_old, old = at_old + 1, old - 1
                    i += 1
                if old or new:
                    return files, f"hunk at line {start} does not match its header"
                f["hunks"].append({"old_start": int(h[1]), "old_count": int(h[2] or 1), "new_start": start, "new_count": int(h[4] or 1), "added": added, "removed": removed, "heading": h[5].strip()})
                continue
            if x.startswith("new file"):
                f["status"] = "added"
            elif x.startswith("deleted file"):
                f["status"] = "deleted"
            elif x.startswith("rename from "):
                f["status"], f["old_path"] = "renamed", x[12:]
            elif x.startswith("rename to "):
                f["path"] = x[10:]
            elif x.startswith("Binary files") or x.startswith("GIT binary patch"):
                f["is_binary"] = True
            elif x.startswith("+++ "):
                if _path(x[4:]):
                    f["path"] = _path(x[4:])
                elif f["status"] == "modified":  # a side that is nothing tells as much as a header
                    f["status"] = "deleted"
            elif x.startswith("--- "):
                if not _path(x[4:]):
                    f["status"] = "added" if f["status"] == "modified" else f["status"]
                elif f["status"] == "deleted":
                    f["path"] = _path(x[4:])
            i += 1
    return files, None


def parse_diffs(diffs: DataFrame) -> DataFrame:
    """``doc_id, path, old_path, status, is_binary, hunks, error``: a row per file of every diff; a corrupt diff keeps the
    files read so far, with its error."""
    hunk = "struct<old_start:int,old_count:int,new_start:int,new_count:int,added:array<int>,removed:array<int>,heading:string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t in zip(b["doc_id"], b["text"]):
                files, error = parse(t)
                out += [(k, f["path"], f["old_path"], f["status"], f["is_binary"], f["hunks"], error) for f in files]
            yield pd.DataFrame(out, columns=["doc_id", "path", "old_path", "status", "is_binary", "hunks", "error"])

    return diffs.select("doc_id", "text").mapInPandas(run, f"doc_id bigint, path string, old_path string, status string, is_binary boolean, hunks array<{hunk}>, error string")
