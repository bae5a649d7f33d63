"""Registered queries against their SQL, and the pipeline stage by stage."""

import pytest

import check_oracles
import corpus_pipeline
from assaykit.llm import decontaminate, packing, toxicity
from assaykit.llm.common import read_table
from assaykit.llm.queries import ORACLE_SQL, QUERIES, vocabulary
from assaykit.plans.catalog import Entry
from assaykit.session import cut_lineage

from .test_dedup import slow_components, slow_fingerprint, slow_repeats


@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
def test_oracle(spark, sf, key):
    note = check_oracles.compare(spark, check_oracles.connect(sf), Entry(QUERIES[key], ORACLE_SQL[key]), sf)
    assert note.startswith("ok"), note


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark, sf):
    docs = read_table(spark, sf, "documents")
    columns, steps = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = cut_lineage(stage(spark, before, sf))
        steps[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns, name

    before, after = steps["toxicity"]
    scores = toxicity.report(before, read_table(spark, sf, "labels")).collect()
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in scores if not r["predicted"]}

    before, after = steps["simhash"]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    prints = [(i, slow_fingerprint(t)) for i, t in rows]
    assert {r["doc_id"] for r in after.collect()} == set(slow_components(prints, 3))

    before, after = steps["substring"]
    rows = sorted((r["doc_id"], (r["text"] or "").encode().split()) for r in before.collect())
    lost = {i: n for i, _, n, _ in slow_repeats(rows, 50)}
    for r in after.collect():
        assert len((r["text"] or "").encode().split()) == len(dict(rows)[r["doc_id"]]) - lost[r["doc_id"]]
    assert after.count() == len(rows)

    before, after = steps["decontamination"]
    bench = read_table(spark, sf, "benchmark")
    left = decontaminate.report(after, bench).collect()
    cover = {r["doc_id"]: (r["n_hit"], r["n_words"]) for r in decontaminate.report(before, bench).collect()}
    assert {r["doc_id"] for r in left} == {i for i, (hit, n) in cover.items() if hit <= 0.5 * n}
    assert sum(r["n_hit"] for r in left) <= 0.1 * sum(hit for hit, _ in cover.values())

    before, after = steps["packing"]
    lengths = {r["doc_id"]: r["n"] for r in after.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    encode = packing.WordEncoder(vocabulary())
    texts = [(r["doc_id"], r["text"] or "") for r in before.collect()]
    assert lengths == {i: len(ids) // 4 + 1 for (i, _), ids in zip(texts, encode([t for _, t in texts]), strict=True)}
