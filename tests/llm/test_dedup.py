"""SimHash, substring and suffix dedup against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from assaykit.llm import simhash, substring, suffix, windows
from assaykit.llm.common import connected_components


def slow_repeats(docs, window):
    """{row: kept words digest ...} by the definition, for (doc_id, words) rows."""
    first = {}
    for doc_id, ws in docs:
        for i in range(len(ws) - window + 1):
            key = tuple(ws[i : i + window])
            order = float("inf") if doc_id is None else doc_id
            first[key] = min(first.get(key, float("inf")), order)
    out = []
    for doc_id, ws in docs:
        order = float("inf") if doc_id is None else doc_id
        gone = set()
        for i in range(len(ws) - window + 1):
            if first[tuple(ws[i : i + window])] < order:
                gone.update(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((doc_id, len(ws), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def slow_suffix(docs, window):
    count = Counter()
    for _, raw in docs:
        count.update(raw[i : i + window] for i in range(len(raw) - window + 1))
    out = []
    for doc_id, raw in docs:
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - window + 1):
            if count[raw[i : i + window]] > 1:
                gone[i : i + window] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((doc_id, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def mixed_texts(prose):
    long, shared = prose(1, 300), prose(2, 90)
    near = long.split()
    near[150] = "changed"
    return [
        (0, long), (1, long), (2, " ".join(near)), (3, prose(3, 40) + " " + shared + " " + prose(4, 30)),
        (4, shared + " " + prose(5, 60)), (5, prose(6, 20) + "\n" + shared + "\t" + shared), (6, "word " * 200), (7, "word " * 120),
        (8, None), (9, ""), (10, " \n "), (11, prose(7, 49)), (12, prose(7, 49)), (13, prose(8, 55)), (13, prose(8, 55)), (13, shared),
        (None, long), (14, "a" * 3000), (15, "é" * 900 + prose(9, 100)), (16, "é" * 300 + prose(9, 100)), (17, prose(10, 3000)),
        (18, " ".join(prose(10, 3000).split()[1000:1400])),
    ]


@pytest.mark.parametrize("window", [50, 12])
def test_substring_matches_definition(documents, prose, window):
    rows = mixed_texts(prose)
    got = [tuple(r) for r in substring.report(documents(rows), window).collect()]
    assert sorted(got, key=str) == slow_repeats([(i, (t or "").encode().split()) for i, t in rows], window)


@pytest.mark.parametrize("window", [400, 40])
def test_suffix_matches_definition(documents, prose, window):
    rows = mixed_texts(prose)
    got = [tuple(r) for r in suffix.report(documents(rows), window).collect()]
    assert sorted(got, key=str) == slow_suffix([(i, (t or "").encode()) for i, t in rows], window)


def test_long_texts_are_read_in_segments(documents, monkeypatch, prose):
    monkeypatch.setattr(windows, "SEGMENT", 64)
    for kind in ("word", "byte"):
        seq = windows.Sequence(prose(1, 400), kind)
        starts = [a + s for a, h in seq.segments(20) for s in range(h.n - 19)]
        assert starts == list(range(seq.n - 19))
        one = np.concatenate([h.grams(20) for _, h in seq.segments(20)])
        monkeypatch.setattr(windows, "SEGMENT", 1 << 18)
        whole = next(windows.Sequence(prose(1, 400), kind).segments(20))[1].grams(20)
        monkeypatch.setattr(windows, "SEGMENT", 64)
        assert (one == whole).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=12, max_size=80), st.integers(2, 12))
def test_anchor_is_the_leftmost_smallest_gram(values, width):
    h = np.array(values, np.uint64)
    p, first, last = windows.anchors(h, width)
    seen = []
    for at, a, b in zip(p.tolist(), first.tolist(), last.tolist(), strict=True):
        for s in range(a, b + 1):
            seen.append(s)
            assert at == s + int(h[s : s + width].argmin())
    assert seen == list(range(len(h) - width + 1))


def test_removing_repeats_keeps_rows_and_columns(documents, prose):
    rows = mixed_texts(prose)
    docs = documents(rows)
    out = substring.remove_repeats(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    kept = {r["doc_id"]: r for r in out.collect() if r["doc_id"] in (0, 1, 4, 8, 17)}
    assert out.count() == len(rows)
    assert kept[0]["text"] == rows[0][1] and kept[1]["text"] == "" and kept[1]["n_chars"] == 0
    assert kept[8]["text"] is None and kept[17]["text"] == dict(rows)[17] and kept[4]["text"] == prose(5, 60)


def test_empty_tables(documents):
    docs = documents([])
    assert substring.report(docs).collect() == [] and suffix.report(docs).collect() == []
    assert simhash.report(docs).collect() == [] and simhash.keep_first(docs).collect() == []


def slow_fingerprint(text):
    ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, distance):
    """Smallest id of each row's component, rows being (id, fingerprint)."""
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= distance:
                label[root(i)] = root(j)
    groups = {}
    for i, (doc_id, _) in enumerate(prints):
        groups.setdefault(root(i), []).append(doc_id)
    return [min((x for x in groups[root(i)] if x is not None), default=None) for i in range(len(prints))]


def test_simhash_matches_definition(documents, prose):
    rows = mixed_texts(prose) + [(100 + i, prose(50, 400 + i)) for i in range(12)] + [(200, "One  TWO"), (201, "one two"), (202, "É é"), (203, "x")]
    prints = [(i, slow_fingerprint(t)) for i, t in rows]
    want = sorted([(i, f"{f:016x}", c) for (i, f), c in zip(prints, slow_components(prints, 3), strict=True)], key=str)
    got = sorted([tuple(r) for r in simhash.report(documents(rows)).collect()], key=str)
    assert got == want


@pytest.mark.parametrize("block", [512, 8])
def test_links_are_complete(spark, block):
    """Clusters around few centres, with crowded keys that must be divided when blocks are small."""
    r = random.Random(5)
    values = set()
    for c in range(6):
        centre = r.getrandbits(64)
        for _ in range(60):
            x = centre
            for b in r.sample(range(64), r.randrange(5)):
                x ^= 1 << b
            values.add(x)
    values |= {r.getrandbits(16) for _ in range(60)}  # these agree on most bits
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    got = {tuple(r) for r in simhash.links(prints, 3, block).collect()}
    want = {(min(a, b), max(a, b)) for i, (a, x) in enumerate(zip(signed, values, strict=True)) for b, y in zip(signed[:i], values[:i], strict=True) if (x ^ y).bit_count() <= 3}
    if block > len(values):
        assert got == want
    groups = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(sorted(got), "a bigint, b bigint")).collect()}
    least = slow_components(list(zip(signed, values, strict=True)), 3)
    assert {v: c for v, c in zip(signed, least, strict=True)} == {v: groups.get(v, v) for v in signed}


def test_thresholds_follow_the_costs():
    costs = np.array([[10.0, 100.0], [10.0, 20.0], [500.0, 900.0]])
    assert simhash.allocate(costs, 1) == (120.0 + 500.0 - 90.0, [0, 1, 0]) or simhash.allocate(costs, 1)[1] == [1, 1, -1]
    assert simhash.allocate(costs, 0) == (30.0, [0, 1, -1])


def test_one_document_of_a_group_stays(documents, prose):
    rows = [(3, "same text here"), (1, "same text here"), (1, "same text here"), (2, prose(1, 30)), (None, "alone in this"), (5, None), (6, "")]
    docs = documents(rows)
    out = simhash.keep_first(docs)
    assert out.columns == docs.columns
    assert sorted(str((r["doc_id"], r["text"])) for r in out.collect()) == sorted(str(x) for x in [(1, "same text here"), (2, prose(1, 30)), (None, "alone in this"), (5, None)])


def thue_morse(n, a, b):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_regular_patterns_are_told_apart(spark, documents):
    # equal modulo 2^64 as polynomials at any odd point
    one, other = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    same = " ".join(f"word{i}" for i in range(49))
    rows = [(1, f"{same} {one}"), (2, f"{same} {other}"), (3, f"{same} {one}")]
    got = {r["doc_id"]: r["n_removed"] for r in substring.report(documents(rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 50}
    words = [thue_morse(2048, "x ", "y ").split(), thue_morse(2048, "y ", "x ").split()]
    units = [windows.Sequence(" ".join(w), "word").units(0, 2048) for w in words]
    assert windows.Hashes(units[0]).of(0, 2048) != windows.Hashes(units[1]).of(0, 2048)
    data = [windows.Sequence(x, "byte").units(0, 1024) for x in (one, other)]
    assert windows.Hashes(data[0]).of(0, 1024) != windows.Hashes(data[1]).of(0, 1024)


def test_hashes_do_not_depend_on_place():
    units = windows._RANDOM.integers(0, 1 << 62, 500, dtype="uint64")
    units[300:340] = units[20:60]
    h = windows.Hashes(units)
    assert h.of(20, 60) == h.of(300, 340) == windows.Hashes(units[20:60]).of(0, 40)
    assert (h.grams(40)[[20, 300]] == h.of(20, 60)).all() and len(set(h.grams(3).tolist())) == 498 - 38
