"""Problem 8: evaluation texts leaking into training text.

Both sides become word sequences without case, punctuation, markup and entities.  Karp-Rabin hashes of eight words find
shared seeds; around them greedy string tiling repeatedly marks the longest non-overlapping match, and the tiles' coverage
of the item is held against a threshold: they may stand in any order, so a reordered passage is caught as well.
``leaks`` then checks what was covered for passages in order: an item has leaked if some window of at least 40 of its words
holds at most one altered word in ten.  (Four alterations in 40 words leave a run of eight, so no such window is without a
seed, and at least 28 words in runs of three, so none is below the coverage asked for.)

The items are a stated query set that all documents are read against, in blocks: a block's index is broadcast, and documents
are read once a block without any shuffle.  Items are dealt to blocks by hash so that a block holds ``BROADCAST_WORDS`` words
on average, and more blocks are made until none holds twice as many (or a single item).  Which seeds are shared instructions is
counted over all items before, so blocks change no result.

Defined results: null and blank texts hold nothing; repeated rows give a pair once; an item of fewer than 40 words cannot
leak; an item that repeats another's text leaks with it; a null id gives no row.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, spread

WINDOW, ALTERED, SEED, TILE = 40, 0.1, 8, 3
#: Texts of items that may hold a run of words before it counts as a shared instruction.
COMMON = 2
#: Item words of a block, whose texts are broadcast at once and indexed by each task (some 60 bytes a word).
BROADCAST_WORDS = 1_000_000
#: Share of a window that tiles of any order must cover; fewer cannot hold a passage with one altered word in ten.
COVERED = 0.7

_TAG = re.compile(r"<!--|-->|</?[a-zA-Z][a-zA-Z0-9]*(?:\s[^<>]*)?/?>")
#: Runs of letters, digits and inner underscores; those at the ends are emphasis.
_WORD = re.compile(r"[^\W_](?:\w*[^\W_])?")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """The words of a text; tags, character entities, emphasis and invisible characters are taken out first."""
    if not text:
        return []
    for _ in range(2):
        if "<" in text:
            text = _TAG.sub(" ", text)
        if "&" in text:
            text = html.unescape(text)
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKC", text) if unicodedata.category(c) != "Cf")
    return _WORD.findall(text.lower())


def rolling(ids: np.ndarray, k: int = SEED) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``k`` ids, 64 bits."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = h * _BASE + ids[j : j + n]
        h ^= h >> np.uint64(29)
    return h


def _unsigned(codes: list[int]) -> np.ndarray:
    return np.array(codes, np.int64).view(np.uint64)


def tiles(a: list[int], b: list[int], least: int = TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in a, start in b, length), longest first, no word of either side in two tiles."""
    places: dict[int, list[int]] = defaultdict(list)
    for i, h in enumerate(rolling(_unsigned(a), least).tolist()):
        places[h].append(i)
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    last: dict[int, int] = {}  # diagonal -> where its last match ends in b
    for j, h in enumerate(rolling(_unsigned(b), least).tolist()):
        for i in places.get(h, ()):
            if last.get(j - i, -1) > j:
                continue
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n < least:
                continue  # equal hashes of other words
            last[j - i] = j + n
            runs[n].append((i, j, n))
    used_a, used_b, out = bytearray(len(a)), bytearray(len(b)), []
    while runs:
        n = max(runs)
        for i, j, m in runs.pop(n):
            # what earlier tiles took is cut off; the longest free part goes back if it is shorter than n
            best, at, start = 0, 0, None
            for x in range(m + 1):
                if x < m and not used_a[i + x] and not used_b[j + x]:
                    start = x if start is None else start
                elif start is not None:
                    if x - start > best:
                        best, at = x - start, start
                    start = None
            if best == m:
                used_a[i : i + m] = b"\1" * m
                used_b[j : j + m] = b"\1" * m
                out.append((i, j, m))
            elif best >= least:
                runs[best].append((i + at, j + at, best))
    return out


def _rows(a: list[int], b: list[int]) -> list[int]:
    """The table of longest common subsequences, a number a row: bit j of row i is 0 where the ``j``-th word of ``b`` makes
    the subsequence of ``a[: i + 1]`` and ``b[: j + 1]`` longer."""
    places: dict[int, int] = defaultdict(int)
    for j, x in enumerate(b):
        places[x] |= 1 << j
    full = (1 << len(b)) - 1
    row, out = full, []
    for x in a:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        out.append(row)
    return out


def _lengths(row: int, n: int) -> np.ndarray:
    """Length of the common subsequence with each prefix of ``b``, read off a row."""
    bits = np.unpackbits(np.frombuffer(row.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _common(a: list[int], b: list[int]) -> list[int]:
    """Positions of ``a`` in a longest common subsequence with ``b``, of whatever size: ``a`` is halved while its rows of bits
    would take more than some 32 MB."""
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > 1 << 28:
        half = len(a) // 2
        fore, back = _rows(a[:half], b)[-1], _rows(a[half:][::-1], b[::-1])[-1]
        at = int(np.argmax(_lengths(fore, len(b)) + _lengths(back, len(b))[::-1]))
        return _common(a[:half], b[:at]) + [half + x for x in _common(a[half:], b[at:])]
    rows, out, i, j = _rows(a, b), [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if not i or rows[i - 1] >> (j - 1) & 1:
            j -= 1
            out.append(i)
    return out[::-1]


def covered(item: list[int], marks: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words of the item tiles cover, in whatever order they stand on the other side."""
    out = np.zeros(len(item), bool)
    for i, _, n in marks:
        out[i : i + n] = True
    return out


def chains(marks: list[tuple[int, int, int]], least: int) -> Iterator[list[tuple[int, int, int]]]:
    """Tiles that follow one another on both sides with gaps of like size: the heaviest such chain, then the heaviest of the
    tiles left, down to ``least`` words.  A gap costs what it is longer than eight words."""
    rest = sorted(marks)
    while sum(n for _, _, n in rest) >= least:
        score, back = [n for _, _, n in rest], [-1] * len(rest)
        for y, (i, j, n) in enumerate(rest):
            for x in range(y):
                pi, pj, pn = rest[x]
                gi, gj = i - pi - pn, j - pj - pn
                if gi >= 0 and gj >= 0 and abs(gi - gj) <= 6 + min(gi, gj) and score[x] + n - (gi > 8) * (gi - 8) > score[y]:
                    score[y], back[y] = score[x] + n, x
        chain, y = set(), max(range(len(rest)), key=score.__getitem__)
        while y >= 0:
            chain.add(y)
            y = back[y]
        yield [rest[y] for y in sorted(chain)]
        rest = [t for y, t in enumerate(rest) if y not in chain]


def in_order(item: list[int], part: list[int], chain: list[tuple[int, int, int]], marks: list[tuple[int, int, int]] = ()) -> np.ndarray:
    """Which words of the item stand in the part along a chain of tiles, those between the tiles included.

    Words of other tiles (``marks``) stand elsewhere and are not taken for the chain's surroundings.
    """
    mine, other = list(item), list(part)
    for i, j, n in set(marks).difference(chain):
        mine[i : i + n], other[j : j + n] = [None] * n, [-1 << 62] * n
    found = np.zeros(len(item), bool)
    # Beyond the outer tiles no run of three is left, so every third word is altered and a window ends within this reach.
    reach = 3 * (int(len(item) * ALTERED) + 1)
    (i, j, _), (ei, ej, en) = chain[0], chain[-1]
    gaps = [(max(0, i - reach), i, max(0, j - reach), j), (ei + en, ei + en + reach, ej + en, ej + en + reach)]
    for (i, j, n), (ni, nj, _) in zip(chain, chain[1:]):
        gaps.append((i + n, ni, j + n, nj))
    for i, _, n in chain:
        found[i : i + n] = True
    for a, to_a, b, to_b in gaps:
        for x in _common(mine[a:to_a], other[b:to_b]):
            found[a + x] = True
    return found


def longest_window(found: np.ndarray, shared: np.ndarray, least: int = WINDOW, altered: float = ALTERED, own_words: int = WINDOW // 2) -> int:
    """Words of the longest run of item words of which at most ``altered`` are missing; 0 if none has ``least`` words.

    The run must begin and end with a found word, and ``own_words`` of it must not be an instruction that items
    share.  For each end the earliest start that has no more to spare is the longest run and holds the most words of its own.
    """
    if len(found) < least:
        return 0
    part = round(altered * 1000)
    kept = np.concatenate([[0], np.cumsum(np.where(found, part, part - 1000))])
    own = np.concatenate([[0], np.cumsum(found & ~shared)])
    starts = np.flatnonzero(found)
    lowest = np.minimum.accumulate(kept[starts]) if len(starts) else starts
    ends = starts + 1
    at = np.searchsorted(-lowest, -kept[ends])  # the first start whose sum is at most the end's
    ok = at < len(starts)
    begin, ends = starts[at[ok]], ends[ok]
    length = ends - begin
    ok = (length >= least) & (own[ends] - own[begin] >= own_words)
    return int(length[ok].max()) if ok.any() else 0


class Index:
    """Seeds, words and shared parts of a block of items.

    ``items``: (id, text), or (id, text, places) where ``places`` names the words at which a shared seed begins.  Without
    them a seed is shared if more than ``COMMON`` distinct texts of these items hold it.
    """

    def __init__(self, items: Iterable[tuple]):
        self.vocabulary: dict[str, int] = {}
        texts: dict[tuple, tuple[list[int], Sequence[int] | None]] = {}
        for item_id, text, *places in items:
            texts.setdefault(tuple(words_of(text)), ([], places[0] if places else None))[0].append(item_id)
        self.ids: list[list[int]] = []
        self.items: list[tuple[list[int], np.ndarray]] = []
        hashes, holders, places_, given = [], [], [], []
        for words, (ids, shared) in sorted(texts.items(), key=lambda x: min(x[1][0])):
            if len(words) < WINDOW:
                continue
            codes = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            h = rolling(np.array(codes, np.uint64))
            hashes.append(h)
            holders.append(np.full(len(h), len(self.items), np.int32))
            places_.append(np.arange(len(h), dtype=np.int32))
            self.items.append((codes, np.zeros(len(codes), bool)))
            self.ids.append(sorted(set(ids)))
            given.append(shared)
        self.hashes, self.holders, self.places = (np.concatenate(x) if x else np.empty(0, d) for x, d in ((hashes, np.uint64), (holders, np.int32), (places_, np.int32)))
        by = np.argsort(self.hashes, kind="stable")
        self.hashes, self.holders, self.places = self.hashes[by], self.holders[by], self.places[by]
        if any(x is None for x in given):
            given = self._shared()
        for (_, mark), shared in zip(self.items, given):
            for p in shared:
                mark[p : p + SEED] = True
        # Four alterations of 40 words leave at least 26 of its runs of three, so a region with fewer holds no leak.
        self.threes = [np.unique(rolling(np.array(codes, np.uint64), 3)) for codes, _ in self.items]
        self.fewest = int(WINDOW * (1 - ALTERED)) - 2 * (int(WINDOW * ALTERED) + 1)

    def _shared(self) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in self.items]
        one = np.unique(np.rec.fromarrays([self.hashes, self.holders]))
        seeds, texts = np.unique(one.f0, return_counts=True)
        for at in np.flatnonzero(np.isin(self.hashes, seeds[texts > COMMON])).tolist():
            out[self.holders[at]].append(int(self.places[at]))
        return out

    def search(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """What ``cover`` gives of items that leaked in order."""
        return [x for x in self.cover(text) if x[1]]

    def cover(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, words of the longest leaked window, covered words, words of the item) of every item whose tiles cover
        enough of a window; a passage that stands only in another order has a leaked window of 0 words."""
        words = words_of(text)
        if len(words) < WINDOW * (1 - ALTERED) or not len(self.hashes):
            return []
        get = self.vocabulary.get
        codes = np.array([get(w, 0) for w in words], np.uint64)
        h = rolling(codes)
        lo, hi = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        anchors: dict[int, set[int]] = defaultdict(set)
        for j in np.flatnonzero(hi > lo).tolist():
            for x, p in zip(self.holders[lo[j] : hi[j]].tolist(), self.places[lo[j] : hi[j]].tolist()):
                anchors[x].add(j - p)
        out: list[tuple[int, int, int, int]] = []
        if not anchors:
            return out
        h3 = rolling(codes, 3)
        for x, diagonals in anchors.items():
            item, shared = self.items[x]
            n, best = len(item), 0
            pad = 12 + n // 4
            regions: list[list[int]] = []
            for d in sorted(diagonals):
                lo_, hi_ = max(0, d - pad), min(len(words), d + n + pad)
                if regions and lo_ <= regions[-1][0] + pad:
                    regions[-1][1] = max(regions[-1][1], hi_)
                else:
                    regions.append([lo_, hi_])
            threes = self.threes[x]
            near = lambda a, b: int((threes[np.minimum(np.searchsorted(threes, h3[a:b]), len(threes) - 1)] == h3[a:b]).sum())
            # at most the runs of the regions that the item has; each counts as often as it stands there
            counts = [near(a, max(a, b - 2)) for a, b in regions]
            if sum(counts) < self.fewest:
                continue
            seen = np.zeros(n, bool)
            parts = []
            for (a, b), count in zip(regions, counts):
                # alien words must not equal one another
                part = [c if c else -k - 1 for k, c in enumerate(codes[a:b].tolist())]
                marks = tiles(item, part)
                seen |= covered(item, marks)
                if count >= self.fewest:
                    parts.append((part, marks))
            if not longest_window(seen, shared, WINDOW, 1 - COVERED, 0):
                continue
            for part, marks in parts:
                for chain in chains(marks, int(WINDOW * COVERED)):
                    best = max(best, longest_window(in_order(item, part, chain, marks), shared))
            if best or longest_window(seen, shared, WINDOW, 1 - COVERED):
                out.extend((i, best, int(seen.sum()), n) for i in self.ids[x])
        return out


def _keyed(items: DataFrame) -> DataFrame:
    """``words, text, ids, n``: every distinct text (by a key of its words) that is long enough to leak, with its items."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words = [words_of(t) for t in b["text"]]
            b["words"], b["n"] = [xxhash.xxh128_hexdigest(" ".join(w)) for w in words], list(map(len, words))
            yield b[b["n"] >= WINDOW]

    one = items.select("item_id", "text").filter("item_id is not null and text is not null").distinct()
    return one.mapInPandas(run, "item_id bigint, text string, words string, n bigint")


def _shared_places(keyed: DataFrame) -> DataFrame:
    """``words, places``: where in a text the seeds begin that more than ``COMMON`` distinct texts hold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seeds = [stable_seeds(words_of(t)) for t in b["text"]]
            counts = list(map(len, seeds))
            yield pd.DataFrame({"words": np.repeat(b["words"].to_numpy(), counts), "seed": np.concatenate(seeds), "place": np.concatenate([np.arange(n, dtype=np.int32) for n in counts])})

    held = keyed.groupBy("words").agg(F.min("text").alias("text")).mapInPandas(run, "words string, seed bigint, place int")
    common = held.select("seed", "words").distinct().groupBy("seed").count().filter(F.col("count") > COMMON).select("seed")
    return held.join(common, "seed", "left_semi").groupBy("words").agg(F.sort_array(F.collect_list("place")).alias("places"))


def stable_seeds(words: list[str]) -> np.ndarray:
    """Seeds of a text that are the same in every process, as signed numbers."""
    return rolling(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))).view(np.int64)


def _search(documents: DataFrame, block: list[tuple]) -> DataFrame:
    index = documents.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = Index(index.value)
        for b in batches:
            rows = [(d, *x) for d, t in zip(b["doc_id"], b["text"]) for x in at.cover(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "leaked_words", "covered_words", "item_words"])

    return documents.mapInPandas(run, "doc_id bigint, item_id bigint, leaked_words int, covered_words int, item_words int")


def coverage(documents: DataFrame, items: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """``doc_id, item_id, leaked_words, covered_words, item_words``: every pair of a document and an item of which tiles in
    any order cover enough.  ``leaked_words`` is the longest window that stands in order, 0 if the passage is reordered."""
    keyed = cut(_keyed(items))
    keyed = cut(keyed.join(_shared_places(keyed), "words", "left").withColumn("hash", F.xxhash64("words")))
    total = keyed.agg(F.sum("n").alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // max(1, broadcast_words)))
    while True:
        dealt = keyed.withColumn("block", F.pmod("hash", F.lit(blocks)))
        sizes = {r["block"]: r for r in dealt.groupBy("block").agg(F.sum("n").alias("n"), F.countDistinct("words").alias("texts")).collect()}
        if all(r["n"] <= 2 * broadcast_words or r["texts"] == 1 for r in sizes.values()):
            break
        blocks *= 2
    texts = spread(documents.select("doc_id", "text").filter("doc_id is not null"))
    found = None
    for block in sorted(sizes) or [0]:
        rows = dealt.filter(F.col("block") == block).orderBy("item_id").select("item_id", "text", F.coalesce("places", F.array().cast("array<int>")).alias("places")).collect()
        part = _search(texts, [tuple(r) for r in rows])
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("leaked_words", "covered_words", "item_words")))


def leaks(documents: DataFrame, items: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """The pairs of ``coverage`` that hold a passage in order."""
    return coverage(documents, items, broadcast_words).filter("leaked_words > 0")
