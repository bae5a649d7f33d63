"""Vantage-point trees, shards and packing against brute force."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from assaykit.llm import packing, sharding, vptree
from assaykit.llm.queries import vocabulary

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string, shard string"


def exact(rows, every, k):
    """The definition in plain Python: components in order, double precision."""
    good = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        if (i, v) not in good:
            good.append((i, v))
    out = []
    for q, a in good:
        if q % every == 0:
            near = sorted((float(np.sqrt(np.cumsum((np.float32(a).astype(float) - np.float32(b).astype(float)) ** 2)[-1])), i) for i, b in good if i != q)
            out += [(q, r + 1, i, d) for r, (d, i) in enumerate(near[:k])]
    return sorted(out)


@pytest.mark.parametrize("n", [0, 5, 300])
def test_factor_one_is_exact(spark, n):
    r = np.random.default_rng(n)
    rows = [(i, r.normal(size=8).astype(np.float32).tolist()) for i in range(n)]
    if n > 100:
        rows += [(1000 + i, rows[3][1]) for i in range(150)]  # one vector a third of the time
        rows += [(2000, None), (2001, [0.0] * 8), (2002, [1.0] * 7 + [float("nan")]), (2003, [1.0] * 7 + [None]), (2004, [1.0] * 7 + [float("inf")]), (None, rows[0][1])]
        rows += [rows[0], rows[0]]
    df = spark.createDataFrame([(i, v, 0, "a", "b") for i, v in rows], SCHEMA)
    got = sorted(tuple(x) for x in vptree.search(df, every=50, k=10, shard_rows=64, query_rows=4).collect())
    assert got == exact(rows, 50, 10)


def test_larger_factors_skip_more_and_stay_close():
    r = np.random.default_rng(1)
    points = r.normal(size=(3000, 4))
    tree = vptree.Tree(np.arange(3000), points)
    want = tree.search(np.arange(50), points[:50], 10)
    for factor, least in ((1.0, 1.0), (1.5, 0.9), (4.0, 0.3)):
        got = tree.search(np.arange(50), points[:50], 10, factor)
        recall = np.mean([len(set(a[0]) & set(b[0])) / 10 for a, b in zip(got, want, strict=True)])
        assert recall >= least


@pytest.mark.parametrize("n_shards", [1, 7])
def test_shards_are_even_and_gapless(documents, prose, n_shards):
    rows = [(i, prose(i, 5 + i % 90)) for i in range(400)] + [(1000 + i, prose(3, 60)) for i in range(200)]
    rows += [(None, None), (5000, ""), (5001, None), (3, prose(3, 8))]
    out = sharding.report(documents(rows), n_shards).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(i) for i, _ in rows)
    bytes_, slots, of_text = defaultdict(int), defaultdict(list), defaultdict(set)
    texts = {i: t for i, t in rows}
    for r in out:
        bytes_[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        text = texts[r["doc_id"]] or ""
        if r["doc_id"] != 3:
            assert r["size"] == len(text.encode()) + 16 and r["text_crc32"] == zlib.crc32(text.encode())
        of_text[r["text_crc32"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(bytes_) == set(range(n_shards))
    largest = max(r["size"] for r in out)
    mean = sum(bytes_.values()) / n_shards
    assert all(abs(b - mean) <= 2 * largest for b in bytes_.values())
    # equal texts lie next to each other: a group spreads over no more shards than its size asks for
    assert all(len(s) <= 2 + 200 * largest / mean for s in of_text.values())


def test_no_rows_no_shards(documents):
    assert sharding.report(documents([]), 4).collect() == []


def test_lower_bounds_hold_and_certify():
    r = np.random.default_rng(2)
    for _ in range(200):
        capacity = int(r.integers(5, 60))
        sizes = r.integers(1, capacity + 1, size=int(r.integers(1, 9)))
        bins, offsets = packing.best_fit(sizes, capacity)
        used = int(bins.max()) + 1
        assert packing.lower_bound(sizes, capacity) <= fewest(sizes.tolist(), capacity) <= used
        for b in range(used):
            own = np.flatnonzero(bins == b)
            spans = sorted((int(offsets[i]), int(offsets[i] + sizes[i])) for i in own)
            assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False)) and spans[-1][1] <= capacity
    # more than half a bin each: no two fit together
    assert packing.lower_bound(np.array([6, 6, 6, 6, 4]), 10) == 4
    assert packing.lower_bound(np.array([4, 4, 4, 4, 4]), 10) == 3


def fewest(sizes, capacity):
    """Optimal number of bins by trying all ways (few sizes)."""
    best = [len(sizes)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity:
                place(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        place(i + 1, [*bins, sizes[i]])

    sizes = sorted(sizes, reverse=True)
    place(0, [])
    return best[0]


ODD = ["It's a test, isn't it? We'll see...", "ÀÉÎ Straße ǅ ΣΑΣ İ K x́     tab\tand\x0bmore\x1c!", "<|endoftext|> a<|startoftext|>b", "日本語 テスト 123 4５6 ½", "a,b.c;;d !!?? ... word, word. word", "\n\n  \r\n", "naïve İstanbul ſ ﬁ Ω", "été, ́x", "ab1cd 2nd 'S 'LL", "🙂🙂 ok"]


def test_ids_are_those_of_the_tokenizer(prose):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary())
    encode = packing.WordEncoder(vocabulary())
    texts = [*ODD, *ODD, prose(1, 200), ""]
    for text, ids in zip(texts, encode(texts), strict=True):
        assert np.frombuffer(ids, np.uint32).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_pieces_fill_sequences_without_gaps(documents, prose):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary())
    rows = [(i, prose(i, 3 + i * 7 % 60)) for i in range(300)] + [(400, None), (401, ""), (402, prose(5, 900)), (7, prose(7, 9)), (None, "x y")]
    rows += [(500 + i, prose(77, 30)) for i in range(100)]
    capacity = 128
    out = packing.pack(documents(rows), vocabulary(), capacity, with_ids=True).collect()
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        ids = np.array(r["ids"], np.uint32)
        assert r["length"] == len(ids) <= capacity and r["ids_crc32"] == zlib.crc32(ids.tobytes())
        of_doc[r["doc_id"]].append((r["piece"], r["start"], r["ids"]))
        of_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in rows:
        if i != 7:
            want = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
            parts = sorted(of_doc[i])
            assert [x for p in parts for x in p[2]] == want and [p[0] for p in parts] == list(range(len(parts)))
            assert all(p[1] == k * capacity for k, p in enumerate(parts)) and len(parts) == -(-len(want) // capacity)
    want = [len(plain.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows if i == 7]
    assert len(want) == 2 and len(of_doc[7]) == sum(-(-n // capacity) for n in want)
    for spans in of_sequence.values():
        spans = sorted(spans)
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and sum(n for _, n in spans) <= capacity
    lengths = np.array([r["length"] for r in out])
    assert len(of_sequence) <= 1.02 * packing.lower_bound(lengths, capacity) + 1


def test_partitions_with_gaps_are_packed_again(spark):
    r = np.random.default_rng(3)
    sizes = r.integers(20, 90, size=600)
    loose = spark.createDataFrame([(str(i), int(s)) for i, s in enumerate(sizes)], "key string, length bigint")
    out = packing.assign(loose, 100, part_pieces=64).collect()
    assert sorted(int(x["key"]) for x in out) == list(range(600))
    bins = defaultdict(list)
    for x in out:
        bins[x["round"], x["part"], x["bin"]].append((x["offset"], int(sizes[int(x["key"])])))
    for spans in bins.values():
        spans = sorted(spans)
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and spans[-1][0] + spans[-1][1] <= 100
    alone = sum(int(packing.best_fit(part, 100)[0].max()) + 1 for part in np.array_split(sizes, 10))
    assert len(bins) <= alone


def test_nothing_to_pack(documents):
    assert packing.pack(documents([]), vocabulary()).collect() == []


def test_ids_of_odd_chunks_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    plain, encode = Tokenizer.from_file(vocabulary()), packing.WordEncoder(vocabulary())
    random = np.random.default_rng(3)
    signs = [*"aBéÉßª²İıŉ'.,日дДΣς05  \n\t !ʼﬁKǅĳ-#$_", "̇", "́", "'s", "'re", "\r", "\x00"]
    texts = ["".join(random.choice(signs, random.integers(60))) for _ in range(20_000)]
    texts += ["word$$$ Word!!, x.** été### (a) b_ _c", "", " "]
    got = [np.frombuffer(ids, np.uint32).tolist() for ids in encode(texts)]
    assert got == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert list(encode([])) == []
