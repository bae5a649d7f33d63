"""The prefix trie against a brute-force trie."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from assaykit.llm import conversation_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, name string, digest string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", "y") for r in rows], SCHEMA).repartition(3)


def slow_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0), tie, (role, text)))
    own = {c: [x[2] for x in sorted(t)] for c, t in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = own.get(base, [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, q in built.items():
        for d in range(len(q) + 1):
            members[tuple(q[:d])].append(c)
        ends[tuple(q)].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for e in range(len(p) + 1):
            leaves[p[:e]] += not kids[p]
            saved[p[:e]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items())


def check(spark, rows):
    got = conversation_trie.report(table(spark, rows))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert all(t == "bigint" for _, t in got.dtypes[:-1])
    assert sorted(map(tuple, got.collect())) == slow_trie(rows)


def test_random_conversations(spark):
    r = random.Random(5)
    rows = []
    for c in [*range(90), *range(300, 340), 512, 7_000_001]:
        for t in range(r.choice([1, 2, 3, 7, 8, 9])):
            rows.append((c, t, r.choice(["user", "assistant"]), r.choice(["a", "bb", "çö𝄞"])))
    check(spark, rows)


def test_nulls_ties_repeats_and_missing_bases(spark):
    rows = [
        (None, 0, "user", "lost"), (1, None, "user", "first"), (1, 0, None, None), (1, 0, "user", ""), (1, 0, "user", ""),
        (2, 3, "a", "b"), (2, 3, "a", "b"), (2, 3, "b", "a"), (205, 1, "user", "alone"), (-7, 0, "user", "minus"), (-7, 5, "user", "later"),
        (100, 0, "user", "base"), (101, 0, "x", "own"), (102, 0, "x", "own"), (103, 0, "x", "own"), (104, 0, "x", "own"), (105, 0, "x", "own"),
    ]
    check(spark, rows)


def test_one_conversation_is_long_and_many_are_equal(spark):
    long = [(0, t, "user", f"t{t % 5}") for t in range(70)]
    fork = [(1, t, "user", f"t{t % 5}" if t < 40 else "other") for t in range(70)]
    same = [(c, t, "user", f"t{t}") for c in range(10, 60) for t in range(9)]
    check(spark, long + fork + same)


def test_pieces_of_a_long_conversation_keep_its_order(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "TURNS", 8)
    monkeypatch.setattr(conversation_trie, "IDS", 4)
    check(spark, [(c, 3 * t - 20, "user", f"t{t}") for c in (0, 1, 2, 9, 11) for t in range(33)])


def test_empty_tables(spark):
    assert conversation_trie.report(table(spark, [])).count() == 0
    assert conversation_trie.report(table(spark, [(None, 1, "a", "b")])).count() == 0


def test_turnless_conversations_are_members_of_the_root_only(spark):
    turnless = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 0)
    check(spark, [(turnless, 0, "user", "taken away")])
    check(spark, [(turnless, 0, "user", "taken away"), (300, 0, "user", "kept")])


@pytest.mark.parametrize("width", [1, 2, 4])
def test_cuts_name_every_depth_once(width):
    depths = [d for j in range(5) for d in range(1, 32) if d % (2 << j) == (1 << j)]
    assert sorted(depths) == list(range(1, 32))
    assert all(d - (d & -d) < d for d in depths)
    assert len([d for d in depths if d & -d == width]) == 32 // (2 * width)
