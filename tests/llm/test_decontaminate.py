"""The automaton against plain search, and the cut texts."""

import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from assaykit.llm import decontaminate as dc


def slow(text, items, window):
    hit, found = set(), set()
    for name, item in items:
        k = min(window, len(item))
        grams = {tuple(item[i : i + k]) for i in range(len(item) - k + 1)} if k else set()
        for i in range(len(text) - k + 1):
            if k and tuple(text[i : i + k]) in grams:
                hit.update(range(i, i + k))
                found.add(name)
    return hit, found


token = st.sampled_from([b"a", b"b", b"c"])


@settings(max_examples=300, deadline=None)
@given(st.lists(token, max_size=40), st.lists(st.lists(token, max_size=9), min_size=1, max_size=6), st.integers(1, 5))
def test_automaton_finds_what_search_finds(text, items, window):
    items = [(str(n), item) for n, item in enumerate(items) if item]
    spans, longest, found = dc.Automaton(items, window).scan(text)
    hit, names = slow(text, items, window)
    assert {i for a, b in spans for i in range(a, b)} == hit and found == names
    assert spans == sorted(spans) and all(a < b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))
    assert (longest > 0) == bool(hit)


def test_report_and_blocks_agree(spark, documents, prose):
    r = random.Random(1)
    items = [(i, prose(900 + i, 14)) for i in range(12)] + [(100, "Short ITEM"), (101, "..."), (102, None), (103, prose(900, 14)), (12, "x1")]
    rows = [(i, prose(i, 20) + " " + (items[r.randrange(12)][1] if i % 3 else "") + ". short item! " * (i % 4 == 0) + prose(i + 50, 20)) for i in range(30)]
    rows += [(50, None), (51, ""), (52, "?!"), (53, prose(903, 14).upper()), (53, prose(903, 14).upper()), (54, "éa é")]
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id bigint, text string, scan string")
    docs = documents(rows)
    want = []
    norm = [(str(i), dc.words(t or "")) for i, t in items]
    for i, t in rows:
        hit, names = slow(dc.words(t or ""), norm, 10)
        names = sorted(names)
        want.append((i, len(dc.words(t or "")), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    got = sorted(tuple(x) for x in dc.report(docs, bench).collect())
    assert got == sorted(want)
    many = {str(x["_whole_row"]["doc_id"]): x["scan"] for x in dc.mark(docs, bench, 10, block_words=60).collect()}
    one = {str(x["_whole_row"]["doc_id"]): x["scan"] for x in dc.mark(docs, bench, 10).collect()}
    assert many == one
    assert dc.report(documents([]), bench).collect() == [] and len(dc.report(docs, bench.limit(0)).collect()) == len(rows)


def test_cut_texts(spark, documents, prose):
    bad = prose(1, 30)
    rows = [(1, f"{prose(2, 60)} {bad}. {prose(3, 60)}"), (2, prose(4, 50)), (3, bad + " end"), (4, None), (5, "")]
    bench = spark.createDataFrame([(1, bad)], "item_id bigint, text string")
    docs = documents(rows)
    out = dc.decontaminate(docs, bench)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    kept = {r["doc_id"]: r for r in out.collect()}
    assert set(kept) == {1, 2, 4, 5} and kept[2]["text"] == rows[1][1]
    assert kept[1]["text"] == f"{prose(2, 60)} {prose(3, 60)}" and kept[1]["n_chars"] == len(kept[1]["text"])


def test_texts_are_scanned_and_cut_in_one_pass(spark, documents, prose):
    bench = spark.createDataFrame([(1, prose(1, 30))], "item_id bigint, text string")
    out = dc.decontaminate(documents([(1, f"{prose(2, 60)} {prose(1, 30)}"), (2, None)]), bench)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_blocks_cut_the_same(spark, documents, prose, monkeypatch):
    items = [(i, prose(900 + i, 14)) for i in range(12)]
    rows = [(i, f"{prose(i, 20)} {items[i % 12][1]}. {prose(i + 50, 20)} {items[i % 5][1] if i % 3 else ''}") for i in range(30)] + [(50, None), (51, items[0][1])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = {tuple(x) for x in dc.decontaminate(documents(rows), bench, max_coverage=0.8).collect()}
    monkeypatch.setattr(dc.mark, "__defaults__", (10, 60, None))
    assert {tuple(x) for x in dc.decontaminate(documents(rows), bench, max_coverage=0.8).collect()} == want and len(want) == 31
