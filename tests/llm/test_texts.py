import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reviewlake.llm import leakage, packing, pieces, spam


# -- pieces ------------------------------------------------------------------------------------------------------------
def brute(t, limit, least, overlap):
    out, s = [], 0
    if len(t) <= limit:
        return out
    while len(t) - s > limit:
        ends = range(s + limit, s + least, -1)
        blank = [e for e in ends if t[e - 1] == "\n" and not t[t.rfind("\n", 0, e - 1) + 1 : e - 1].strip(" \t\r")]
        line = [e for e in ends if t[e - 1] == "\n"]
        space = [e for e in ends if t[e - 1] in " \t"]
        e = (blank or line or space or [s + limit])[0]
        out.append((s, e))
        s = e - overlap
    return [*out, (s, len(t))]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \t\n\r😀", max_size=200))
def test_spans_equal_brute_force(text):
    assert pieces.spans(text, 20, 10, 3) == brute(text, 20, 10, 3)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \t\n", max_size=200))
def test_merged_segments_cover_within_the_limit(text):
    got = pieces.merge_segments(text, 30, 5)
    assert all(e - s <= 30 for s, e in got)
    if text:
        assert got[0][0] == 0 and got[-1][1] == len(text) and all(b[0] <= a[1] for a, b in zip(got, got[1:]))


def merged_by_hand(t, limit, overlap):
    """The weakest boundary whose sides fit is merged, found anew among all of them each time."""
    room = limit - overlap
    if len(t) <= limit:
        return [(0, len(t))] if t else []
    cuts = [0]
    for line in re.findall(r"[^\n]*\n|[^\n]+\Z", t):
        start, end = cuts[-1], cuts[-1] + len(line)
        while end - start > room:
            space = 1 + max(t.rfind(" ", start, start + room), t.rfind("\t", start, start + room))
            start = space if space > start else start + room
            cuts.append(start)
        cuts.append(end)
    parts = [(a, b) for a, b in zip(cuts, cuts[1:])]
    atoms = list(parts)

    def strength(at):
        i = next(i for i, p in enumerate(atoms) if p[0] == at)
        before, behind = t[slice(*atoms[i - 1])], t[slice(*atoms[i])]
        return 0 if not before.endswith("\n") else 2 if not before.strip() or not behind.strip() else 1

    while True:
        fits = [(strength(b[0]), b[1] - a[0], a[0], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if b[1] - a[0] <= room]
        if not fits:
            return [(max(0, a - overlap) if k else a, b) for k, (a, b) in enumerate(parts)]
        i = min(fits)[3]
        parts[i : i + 2] = [(parts[i][0], parts[i + 1][1])]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \t\n", max_size=160))
def test_merged_segments_equal_merging_by_hand(text):
    assert pieces.merge_segments(text, 24, 4) == merged_by_hand(text, 24, 4)


def test_chunks(spark):
    schema = "chunk_id bigint, line_start int, content string, piece_no int"
    text = "x" * 1000 + "\n" + "y" * 1000
    df = spark.createDataFrame([(1, 7, text, 0), (1, 7, text, 0), (2, 1, "short", 0), (3, 1, None, 0), (4, None, "😀" * 1601, 0), (5, 1, "a" * 1600, 0), (None, 1, text, 0), (6, 1, "z " * 100_000, 0)], schema)
    rows = sorted((r.chunk_id, r.piece_no, r.line_start, r.line_end, r.char_start, r.char_end) for r in pieces.split_chunks(df).collect())
    assert [r for r in rows if r[0] == 1] == [(1, 1, 7, 7, 0, 1001), (1, 2, 7, 8, 881, 2001)]
    assert [r for r in rows if r[0] == 4] == [(4, 1, 1, 1, 0, 1600), (4, 2, 1, 1, 1480, 1601)]
    assert {r[0] for r in rows} == {1, 4, 6} and max(r[5] for r in rows if r[0] == 6) == 200_000
    assert pieces.split_chunks(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pieces.split_chunks(df, overlap=900)


# -- packing -----------------------------------------------------------------------------------------------------------
@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=60))
def test_tournament_tree_is_first_fit(sizes):
    items = [(s, i) for i, s in enumerate(sizes)]
    bins, want = [], [0] * len(items)
    for i in sorted(range(len(items)), key=lambda i: (-items[i][0], i)):
        at = next((b for b, room in enumerate(bins) if room >= items[i][0]), None)
        if at is None:
            bins.append(20)
            at = len(bins) - 1
        bins[at] -= items[i][0]
        want[i] = at
    assert packing.first_fit_decreasing(items, 20) == want


def test_every_token_is_placed_once(spark):
    rng = random.Random(3)
    rows = [(i, "w " * 3, rng.choice([None, rng.randint(0, 900), rng.randint(0, 9000)]), 1) for i in range(3000)] + [(5, "w w", 2, 1), (None, "x", 5, 1), (9001, None, None, 1), (9002, "", None, 1), (9003, "a, b", -1, 1), (9004, "", 4096, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens bigint, batch_id int")
    out = packing.pack(df, 2048, 1000).collect()
    load, parts = {}, {}
    for r in out:
        load[r.batch_id] = load.get(r.batch_id, 0) + r.token_end - r.token_start
        parts.setdefault(r.doc_id, []).append((r.part_no, r.token_start, r.token_end))
    assert max(load.values()) <= 2048
    want = {}
    for i, t, n, _ in rows:
        if i is not None:
            n = len(re.findall(r"\w+|[^\w\s]+", t or "")) if n is None or n < 0 else n
            want[i] = max(n, want.get(i, 0))
    assert set(parts) == set(want)
    for doc, p in parts.items():
        p.sort()
        assert p[0][1] == 0 and p[-1][2] == want[doc] and all(a[2] == b[1] and a[0] + 1 == b[0] for a, b in zip(p, p[1:]))
        assert len(p) == max(1, -(-want[doc] // 2048))
    total = sum(want.values())
    assert len(load) <= -(-total // 2048) + 3 + 3  # a last batch a group, and little more
    assert packing.pack(df.limit(0)).count() == 0


# -- leakage -----------------------------------------------------------------------------------------------------------
WORDS = [f"w{i}" for i in range(400)]


def item(seed, n=120):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def altered(text, every, seed=0):
    w = text.split()
    for i in range(every // 2, len(w), every):
        w[i] = f"zz{seed}{i}"
    return " ".join(w)


def words(text, a, b):
    return " ".join(text.split()[a:b])


@pytest.mark.parametrize("doc,leaks", [
    (lambda t: t, True), (lambda t: "intro text " + words(t, 30, 70) + " outro", True), (lambda t: words(t, 30, 69), False), (lambda t: words(t, 10, 45), False), (lambda t: altered(words(t, 20, 80), 10), True), (lambda t: altered(t, 4), False),
    (lambda t: "\n".join("> " + words(t, i, i + 8) for i in range(0, 120, 8)), True), (lambda t: " ".join(f"<b>{w.upper()}</b>&nbsp;" for w in t.split()), True), (lambda t: ", ".join(f"*{w}*" for w in t.split()), True),
    (lambda t: " ".join(words(t, i, i + 20) for i in (100, 60, 20, 80, 40, 0)), False), (lambda t: "", False), (lambda t: None, False), (lambda t: "noise " * 30_000 + words(t, 0, 60), True)])
def test_leaks(doc, leaks):
    t = item(1)
    got = leakage.Index([(7, t), (8, item(2))]).search(doc(t))
    assert [x[0] for x in got] == ([7] if leaks else [])


def test_shared_instructions_are_no_leak():
    shared = item(99, 45)
    items = [(i, shared + " " + item(i)) for i in range(5)]
    assert leakage.Index(items).search("before " + shared + " after") == []
    assert [x[0] for x in leakage.Index(items).search(shared + " " + words(item(3), 0, 60))] == [3]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=40), st.lists(st.integers(0, 5), max_size=40))
def test_tiles_are_disjoint_matches_and_maximal(a, b):
    ts = leakage.tiles(a, b, 3)
    ua, ub = [0] * len(a), [0] * len(b)
    for i, j, n in ts:
        assert n >= 3 and a[i : i + n] == b[j : j + n]
        for x in range(n):
            ua[i + x] += 1
            ub[j + x] += 1
    assert max([*ua, *ub, 0]) <= 1
    for i in range(len(a) - 2):
        for j in range(len(b) - 2):
            if a[i : i + 3] == b[j : j + 3]:
                assert any(ua[i : i + 3]) or any(ub[j : j + 3])


def test_both_ways_give_the_same(spark):
    items = spark.createDataFrame([(1, item(1), "x"), (1, item(1), "x"), (2, item(2), "x"), (3, None, "x"), (4, "short", "x"), (5, item(1), "x")], "item_id bigint, text string, seed string")
    docs = spark.createDataFrame([(1, item(1), 0), (1, item(1), 0), (2, words(item(2), 5, 60), 0), (3, item(9), 0), (4, None, 0), (5, " ", 0)], "doc_id bigint, text string, item_id int")
    want = [(1, 1), (1, 5), (2, 2)]
    assert sorted((r.doc_id, r.item_id) for r in leakage.leaks(docs, items).collect()) == want
    assert sorted((r.doc_id, r.item_id) for r in leakage.leaks(docs, items, broadcast_words=0).collect()) == want
    assert leakage.leaks(docs.limit(0), items).count() == 0 and leakage.leaks(docs, items.limit(0)).count() == 0


def test_both_ways_know_shared_instructions(spark):
    shared, pair = item(99, 45), item(98, 45)
    rows = [(i, f"{shared} {item(i)}") for i in range(4)] + [(10, f"{pair} {item(10)}"), (11, f"{pair} {item(11)}"), (12, f"{pair} {item(11)}".upper()), (13, item(98, 45)[:60])]
    items = spark.createDataFrame(rows, "item_id bigint, text string")
    docs = spark.createDataFrame([(1, f"before {shared} after"), (2, f"{shared} {words(item(3), 0, 60)}"), (3, f"before {pair} after")], "doc_id bigint, text string")
    # An instruction of two texts is none, however many items repeat one of them.
    want = [(2, 3), (3, 10), (3, 11), (3, 12)]
    got = [sorted(tuple(r) for r in leakage.leaks(docs, items, **x).collect()) for x in ({}, {"broadcast_words": 0})]
    assert [r[:2] for r in got[0]] == want and got[0] == got[1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14))
def test_common_subsequence_equals_the_table(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    got, rest = [a[i] for i in leakage._common(a, b)], iter(b)
    assert len(got) == table[-1][-1] and all(x in rest for x in got)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.booleans()), max_size=40))
def test_longest_window_equals_every_window(words):
    found, shared = np.array([x or y for x, y in words], bool), np.array([x and y for x, y in words], bool)
    want = max((j - i for i in range(len(found)) for j in range(i + 8, len(found) + 1) if found[i] and found[j - 1] and 4 * (~found[i:j]).sum() <= j - i and (found[i:j] & ~shared[i:j]).sum() >= 4), default=0)
    assert leakage.longest_window(found, shared, 8, 0.25, 4) == want


def test_gaps_of_any_length_are_aligned():
    r = random.Random(5)
    a = [f"v{r.randrange(5000)}" for _ in range(12_000)]
    # a long middle in which every third word is altered holds no tile: 1,000 of 12,000 words are missing
    b = [f"q{i}" if 4000 <= i < 7000 and i % 3 == 0 else w for i, w in enumerate(a)]
    assert leakage.Index([(1, " ".join(a))]).search(" ".join(b)) == [(1, 12_000, 9002, 12_000)]
    codes = {w: i for i, w in enumerate(dict.fromkeys(a + b))}
    mine, other = [codes[w] for w in a] * 2, [codes[w] for w in b] * 2
    assert len(leakage._common(mine, other)) >= 22_000  # more cells than are held at once


def test_a_passage_beside_a_longer_shared_instruction():
    shared = item(99, 90)
    items = [(i, shared + " " + item(i)) for i in range(4)]
    text = shared + " " + " ".join(f"n{i}" for i in range(40)) + " " + words(item(2), 60, 105)
    assert [x[0] for x in leakage.Index(items).search(text)] == [2]


def test_reordered_passages_are_covered_but_not_leaked(spark):
    t = item(1)
    reordered = " ".join(words(t, i, i + 20) for i in (100, 60, 20, 80, 40, 0))
    assert leakage.Index([(7, t)]).cover(reordered) == [(7, 0, 120, 120)]
    docs = spark.createDataFrame([(1, reordered), (2, t)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, t)], "item_id bigint, text string")
    assert sorted(tuple(r) for r in leakage.coverage(docs, items).collect()) == [(1, 7, 0, 120, 120), (2, 7, 120, 120, 120)]


# -- spam --------------------------------------------------------------------------------------------------------------
PROSE = "The scheduler waits until the last worker has reported, and only then closes the batch. Nobody noticed that the lease had run out before. We should write down why the limit is there, because the next reader will ask. "
NOTES = ["The lease ran out before the batch closed.", "Nobody asked why the limit is there.", "Two workers reported the same shard.", "The oldest voucher is booked twice a week.", "A trailing newline breaks the excerpt.", "Our cache keeps the header of another file."]
PHRASES = ["cheap flights", "best hotel deals", "last minute travel", "car rental", "city breaks", "budget trips"]


def stuffed(sep, n=80, seed=0):
    return sep.join(random.Random(seed).choices(PHRASES, k=n))


@pytest.mark.parametrize("text,want", [
    (PROSE * 3, False), (stuffed(" | "), True), (stuffed(" "), True), (stuffed("\n"), True), (stuffed(" » ").upper(), True), (stuffed(" - ").replace("e", "3").replace("o", "0"), True), (PROSE + "\n\n" + stuffed(", ", 120), True), (PROSE * 4 + "\n\n" + stuffed(", ", 12), False),
    (" ".join("#" + p.replace(" ", "") for p in stuffed("\n", 40).split("\n")), True), ("\n".join(f"https://x{i}.example/a/{i * 7}" for i in range(30)), True), ("\n".join(f"- [label {i % 4}](https://x{i}.example/a)" for i in range(30)), True),
    ("\n".join(f"- [Title {i}](https://x{i}.example/a) - {PROSE[:120]}." for i in range(12)), False), ("".join(f'<li><a href="https://x{i}.example">{p}</a></li>' for i, p in enumerate(PHRASES * 6)), True), ("<!-- " + " ".join(f'<img src="/{i}.png" alt="{stuffed(" ", 4, i)}">' for i in range(20)) + " -->", True),
    ("\n".join(f"Travel Deal {'Max' if i % 2 else 'Pro'} {i + 10} nights {i * 13}.99 EUR SKU-{i * 997}" for i in range(20)), True), (" ".join(f"Best {random.Random(i).choice(PHRASES)} for {random.Random(i + 50).choice(PHRASES)} in Rome, book {random.Random(i + 99).choice(PHRASES)} now." for i in range(30)), True),
    ("\n".join(f"2024-05-{i + 1:02} 03:31:{i:02} INFO worker job_{i * 31} took {i * 77} ms" for i in range(25)), False), ("| case | score | note |\n|---|---|---|\n" + "\n".join(f"| c{i} | 0.{i} | {NOTES[i]} |" for i in range(6)), False), ("", False), (None, False), ("   \n", False), ("ok", False)])
def test_spam(text, want):
    assert (spam.spam_share(text)[0] > spam.SHARE) is want


def test_compression_finds_spam_and_rules_only_take_out(monkeypatch):
    log = "\n".join(f"2024-05-{i + 1:02} 03:31:{i:02} INFO worker job took {i * 77} ms" for i in range(25))
    texts = [stuffed(" | "), "\n".join(f"https://x{i}.example/a/{i * 7}" for i in range(30)), " ".join("#" + p.replace(" ", "") for p in stuffed("\n", 40).split("\n")), "buy cheap flights " * 9]
    assert all(spam.spam_share(t)[0] == 1 for t in texts) and not spam.spam_share(log)[0]
    monkeypatch.setattr(spam, "_informs", lambda lines: False)
    assert all(spam.spam_share(t)[0] == 1 for t in [*texts, log])


def test_mentions_are_no_lists():
    assert [spam.spam_share(t)[0] for t in ("see https://x.example/a/very/long/path/to/some/page?with=parameters", "#fix #later", "a", "Hello, world.")] == [0, 0, 0, 0]
    assert spam.redundancy("ab ab ab ab ab ab ab ab ab ab ab ab ab ab ab") < 0.5 < spam.redundancy("short words stay as they are") <= 1.2


def test_spam_rows(spark):
    df = spark.createDataFrame([(1, stuffed(" | "), 0.1), (1, stuffed(" | "), 0.1), (2, None, 0.1), (3, PROSE, 0.1), (4, stuffed(" ", 60_000), 0.1)], "doc_id bigint, text string, spam_share double")
    assert sorted(r.doc_id for r in spam.spam_documents(df).collect()) == [1, 4]
    assert spam.spam_documents(df.limit(0)).count() == 0


def test_rolling_hash_is_of_the_run_alone():
    a = np.array([5, 1, 2, 3, 9, 1, 2, 3], np.uint64)
    h = leakage.rolling(a, 3)
    assert h[1] == h[5] and len(set(h.tolist())) == len(h) - 1 and len(leakage.rolling(a[:2], 3)) == 0
