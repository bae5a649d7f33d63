"""Spelling variants against brute force, and the properties the gram index rests on."""

import random
import re
import zlib
from collections import Counter

import pytest

from assaykit.llm import spelling


def slow_words(rows, least=3):
    counts = Counter()
    for doc_id, text in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if n >= least and len(w) >= 5}


def slow_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_groups(counts):
    near = {w: [x for x in counts if slow_near(w, x)] for w in counts}
    form = {}
    for w, n in counts.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-counts[x], x))
            if counts[best] >= 2 * n:
                form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items())


def variants(seed, n, alphabet="abcdeé", length=(5, 9)):
    r = random.Random(seed)
    out = []
    while len(out) < n:
        w = "".join(r.choice(alphabet) for _ in range(r.randint(*length)))
        for _ in range(r.randint(1, 4)):
            out.append(w)
            i = r.randrange(max(1, len(w)))
            w = r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice(alphabet) + w[i:], w[:i] + r.choice(alphabet) + w[i + 1 :]])
    return out


def collected(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[0])


def test_documents_against_brute_force(spark, documents):
    r = random.Random(3)
    vocabulary = variants(1, 400)
    rows = [(i, " ".join(r.choice(vocabulary[: 40 + i * 4]).title() for _ in range(150)) + "1É×÷ÿ") for i in range(60)]
    rows += [(None, "Wordlike wordlike wordlike"), (None, None), (7, ""), (3, "naïveté NAÏVETÉ naïveté naiveté naiveté naiveté"), rows[5], rows[5]]
    got = collected(spelling.report(documents(rows)))
    assert got == slow_groups(slow_words(rows))
    assert sum(1 for x in got if x[1] is not None and x[2] != x[1]) > 0  # forms of forms occur


@pytest.mark.parametrize(("list_size", "frequent"), [(64, 64), (1, 64), (3, 2), (0, 5)])
def test_every_pair_whatever_the_lists(spark, list_size, frequent):
    words = sorted({*variants(2, 300, "ab", (1, 8)), "aaaaa", "aaaaaa", "aaaaaaa"})
    table = spark.createDataFrame([(w, 10 + i) for i, w in enumerate(words)], "word string, n bigint").repartition(3)
    got = spelling.near_words(table, list_size, frequent, long_word=6).collect()
    assert len(got) == len({(r["a"], r["b"]) for r in got})
    assert {(r["a"], r["b"]) for r in got} == {(a, b) for a in words for b in words if slow_near(a, b)}
    assert all((r["n_a"], r["n_b"]) == (10 + words.index(r["a"]), 10 + words.index(r["b"])) for r in got)


def test_grams_are_made_longer_while_frequent():
    assert spelling.decompose("abcd", set()) == ["\x02a", "ab", "bc", "cd", "d\x03"]
    assert spelling.decompose("abcd", {"ab", "abc", "d\x03"}) == ["\x02a", "abcd", "bc", "cd", "d\x03"]


@pytest.mark.parametrize("seed", range(5))
def test_near_words_share_an_entry(seed):
    r = random.Random(seed)
    words = sorted(set(variants(seed, 300, "abc", (5, 12))))
    frequent = {w[p : p + q]: r.randrange(1, 99) for w in words for q in (2, 3, 4) for p in range(len(w) - q + 1) if r.random() < 0.5}
    listed = {w: set(spelling.entries(w, frequent)) for w in words}
    for w in words:
        grams = spelling.decompose(w, frequent)
        assert len(grams) > spelling.affected(grams)
        for x in words:
            if slow_near(w, x):
                assert listed[w] & listed[x], (w, x)
                bound = max(len(grams) - spelling.affected(grams), 1)
                other = Counter(spelling.decompose(x, frequent))
                assert sum((Counter(grams) & other).values()) >= bound


def test_deletions_are_hashes_of_what_is_left():
    whole, less = spelling.deletions("abcab")
    assert less == [spelling.deletions("abcab"[:i] + "abcab"[i + 1 :])[0] for i in range(5)]
    assert whole == spelling.deletions("abcab")[0] and spelling.deletions("") == (0, [])


def test_a_form_at_twice_the_count_and_ties_by_code_points(spark, documents):
    text = "words " * 4 + "wordy " * 2 + "wordz " * 4 + "kept1 lonely lonely lonely " + "worda " * 3
    rows = [(1, text), (2, "wordy")]
    got = {r[0]: r[1:] for r in collected(spelling.report(documents(rows)))}
    assert got == {r[0]: r[1:] for r in slow_groups(slow_words(rows))}
    assert got["lonely"] == (None, "lonely", 3, 0, None)


def test_a_very_long_run(spark, documents):
    long = "ab" * 60_000
    rows = [(1, f"{long} {long} {long} {long}c {long}c {long}c short " + "short " * 5)] + [(i, None) for i in range(3)]
    got = collected(spelling.report(documents(rows)))
    assert [(len(r[0]), r[3], r[4]) for r in got] == [(120_000, 3, 1), (120_001, 3, 1), (5, 6, 0)]


def test_empty_tables(spark, documents):
    assert spelling.report(documents([])).count() == 0
    assert spelling.report(documents([(1, None), (None, ""), (2, "a bb ccc")])).count() == 0
