"""Problem 4: splitting oversized chunks at natural boundaries.

The pieces of a chunk are fixed by rule (see ``spans``): each ends at the strongest boundary its window holds, the last of
its kind, and the next one starts a fixed overlap before.  Because every cut depends on the one before, the pieces follow
from one scan along the boundaries.  ``merge_segments`` is the agglomerative form for callers without such a rule: atomic
segments are merged over their weakest boundaries, kept in a heap, while the merged size and the overlap fit.

Defined results: null content and content within the limit give no pieces; null ``line_start`` counts from 1; rows that
repeat a chunk give its pieces once (rows of one ``chunk_id`` with other content each give theirs); characters are code
points.
"""

from __future__ import annotations

import bisect
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

LIMIT, LEAST, OVERLAP = 1600, 800, 120

_BLANK = re.compile(r"^[ \t\r]*\n", re.M)


def _ends(pattern: str, text: str) -> list[int]:
    return [m.end() for m in re.finditer(pattern, text)]


def spans(text: str, limit: int = LIMIT, least: int = LEAST, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of every piece; none if the text is within the limit.

    A piece starting at s ends at the last e with s + least < e <= s + limit behind a blank line, else behind a line,
    else behind a space or tab, else at s + limit; a rest within the limit is the last piece.
    """
    if len(text) <= limit:
        return []
    # ``^`` of re.M also follows other line separators never: only "\n" ends a line here.
    kinds = [[m.end() for m in _BLANK.finditer(text)], _ends(r"\n", text), None]
    out, s = [], 0
    while len(text) - s > limit:
        e = 0
        for i in range(3):
            if kinds[i] is None:
                kinds[i] = _ends(r"[ \t]", text)
            at = bisect.bisect_right(kinds[i], s + limit) - 1
            if at >= 0 and kinds[i][at] > s + least:
                e = kinds[i][at]
                break
        e = e or s + limit
        out.append((s, e))
        s = e - overlap
    out.append((s, len(text)))
    return out


def merge_segments(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Agglomerative pieces: atomic segments (lines, cut at words or characters where a line is too long) merged weakest
    boundary first -- inside a paragraph before between paragraphs, the smallest result first among equals -- while the
    merged size plus the overlap stays within the limit."""
    room = limit - overlap
    if len(text) <= limit or room <= 0:
        return [(0, len(text))] if text else []
    cuts = [0]
    for m in re.finditer(r"[^\n]*\n|[^\n]+\Z", text):
        start, end = m.span()
        while end - start > room:
            space = max(text.rfind(" ", start, start + room), text.rfind("\t", start, start + room)) + 1
            start = space if space > start else start + room
            cuts.append(start)
        cuts.append(end)
    n = len(cuts) - 1
    strength = [0] * (n + 1)
    for i in range(1, n):
        before = text[cuts[i - 1] : cuts[i]]
        strength[i] = 0 if not before.endswith("\n") else 2 if not before.strip() or not text[cuts[i] : cuts[i + 1]].strip() else 1
    start, end, left, right = list(cuts[:-1]), list(cuts[1:]), list(range(-1, n - 1)), [*range(1, n), -1]
    version, gone = [0] * n, [False] * n
    heap = [(strength[i + 1], end[i + 1] - start[i], i, i + 1, 0, 0) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, size, i, j, vi, vj = heapq.heappop(heap)
        if gone[i] or gone[j] or version[i] != vi or version[j] != vj or size > room:
            continue
        end[i], right[i], gone[j] = end[j], right[j], True
        version[i] += 1
        if right[i] >= 0:
            left[right[i]] = i
        for a, b in ((left[i], i), (i, right[i])):
            if a >= 0 and b >= 0:
                heapq.heappush(heap, (strength[b], end[b] - start[a], a, b, version[a], version[b]))
    pieces = [(start[i], end[i]) for i in range(n) if not gone[i]]
    return [(max(0, s - overlap) if k else s, e) for k, (s, e) in enumerate(pieces)]


def split_chunks(chunks: DataFrame, limit: int = LIMIT, least: int = LEAST, overlap: int = OVERLAP, by=None) -> DataFrame:
    """``chunk_id, piece_no, line_start, line_end, char_start, char_end`` of every chunk longer than ``limit``.

    Short chunks are filtered out before anything is sent to Python; texts are never shuffled, only spans are.
    """
    if not 0 <= overlap < least < limit:
        raise ValueError("0 <= overlap < least < limit must hold")
    cut = by or (lambda text: spans(text, limit, least, overlap))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for chunk, first, text in zip(b["chunk_id"], b["line_start"], b["content"]):
                first = 1 if pd.isna(first) else int(first)
                newlines = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 10)
                for n, (s, e) in enumerate(cut(text)):
                    at = np.searchsorted(newlines, [s, e - 1]).tolist()
                    rows.append((chunk, n + 1, first + at[0], first + at[1], s, e))
            yield pd.DataFrame(rows, columns=["chunk_id", "piece_no", "line_start", "line_end", "char_start", "char_end"])

    long = chunks.select("chunk_id", "line_start", "content").filter(f"chunk_id is not null and length(content) > {limit}")
    return long.mapInPandas(run, "chunk_id bigint, piece_no bigint, line_start bigint, line_end bigint, char_start bigint, char_end bigint").distinct()
