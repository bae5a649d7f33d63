"""Decoding, and held-out accuracy on planted documents."""

import random

import numpy as np
import pytest

from assaykit.llm import toxicity as tx

BASE = "the of and this that with from have there which their would people about other into could time some these".split()
BAD = "idiot moron scumbag worthless".split()
LEET = {"o": "0", "i": "1", "e": "3", "s": "$", "a": "@", "t": "7"}


def disguise(word, r):
    kind = r.randrange(4)
    if kind == 0:
        return "".join(LEET.get(c, c) for c in word)
    if kind == 1:
        return " ".join(word)
    if kind == 2:
        at = r.randrange(1, len(word) - 1)
        return word[:at] + word[at] * 3 + word[at:]
    return ".".join(word)


def corpus(n=600):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(BASE) for _ in range(r.randrange(30, 90))]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(BAD))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


@pytest.fixture(scope="module")
def model(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return tx.fit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))


def test_counts_cover_whole_texts(spark):
    texts = ["abc abd", None, "", "x" * 5, "Été"]
    counts = tx.trigram_counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    assert counts.sum() == sum(len(t) + 1 for t in texts if t)
    a, b, c = (int(tx.codes(x)[0]) for x in "abc")
    assert counts[a, b, c] == 1 and counts[0, a, b] == 2 and counts[c, 0, a] == 1


def test_decoding(model):
    decoder = tx.Decoder(model.logp)
    assert decoder.decode("1d10t") == "idiot" and decoder.decode("w0r7hle$s") == "worthless"
    assert decoder.decode("m.o.r.o.n") == "moron" and decoder.decode("i d i o t") == "idiot"
    assert decoder.decode("idiooot") == "idiot" and decoder.decode("worthless") == "worthless"
    assert decoder.decode("") == "" and tx.restored_words("2024 555-1234, $!", decoder, {}) == {"2024", "555-1234", "$!"}
    words = tx.restored_words("The 1D10T, and s c u m b a g 555-1234 (people)", decoder, {})
    assert {"idiot", "scumbag", "people", "the", "and"} <= words


@pytest.mark.parametrize(("text", "word"), [
    ('they said "i d i o t" there', "idiot"), ("people (s c u m b a g) from", "scumbag"), ("the s c u m b a g. they", "scumbag"),
    ("their id iot would", "idiot"), ("other idi ot into", "idiot"), ("some m or on people", "moron"), ("some «m o r o n», people", "moron"),
    ("with i. d. i. o. t. with", "idiot"), ("these 1 d 1 0 t these", "idiot"), ("time 1d 10t time", "idiot"),
])
def test_spacing_with_edges_and_groups(model, text, word):
    words = tx.restored_words(text, tx.Decoder(model.logp), {})
    assert word in words
    assert {w for w in text.split() if w in BASE} <= words


def test_signs_only_and_brackets_as_letters(model):
    decoder = tx.Decoder(model.logp)
    counts = np.zeros((tx.LETTERS,) * 3)
    for word in ["ass", "crap", "rap", "scum"] * 50:
        k = [0, 0, *map(int, tx.codes(word)), 0]
        for j in range(len(k) - 2):
            counts[k[j], k[j + 1], k[j + 2]] += 1
    small = tx.Decoder(tx.language_model(counts))
    for text, word in [("@$$", "ass"), ("455", "ass"), ("(rap", "crap"), ("( r a p", "crap"), ("(r a p", "crap"), ("(s c u m)", "scum"), ("s c u m.", "scum")]:
        assert word in tx.restored_words(text, small, {}), text
    assert "people" in tx.restored_words("(people) (from", decoder, {})
    assert tx.restored_words("", decoder, {}) == set() and not any(len(w) > 1 for w in tx.restored_words("... -- (", decoder, {}))


def test_long_runs_of_single_letters_take_linear_time(model):
    words = tx.restored_words("a b " * 20_000, tx.Decoder(model.logp), {})
    assert {"a", "b"} <= words


def brute_best(decoder, chars):
    """Best probability over all paths."""
    best = -np.inf
    paths = [("", 0.0)]
    for i in range(len(chars)):
        paths = [(s + x, p + c) for s, p in paths for x, c in decoder.options(chars, i)]
    for s, p in paths:
        k = [0, 0, *[0 if x == " " else int(tx.codes(x)[0]) for x in s], 0]
        best = max(best, p + sum(decoder.logp[k[j], k[j + 1], k[j + 2]] for j in range(len(k) - 2)))
    return best


@pytest.mark.parametrize("chars", ["1d1ot", "aa*b", "m.o0n", "l33t", "ooo", "oo", "moon", "eerie", "tall", "aab", "peoplle"])
def test_viterbi_is_the_best_path(model, chars):
    decoder = tx.Decoder(model.logp)
    said = decoder.decode(chars)
    paths = [("", 0.0)]
    for i in range(len(chars)):
        paths = [(s + x, p + c) for s, p in paths for x, c in decoder.options(chars, i)]

    def full(s, p):
        k = [0, 0, *[0 if x == " " else int(tx.codes(x)[0]) for x in s], 0]
        return p + sum(decoder.logp[k[j], k[j + 1], k[j + 2]] for j in range(len(k) - 2))

    assert max(full(s, p) for s, p in paths if s == said) == pytest.approx(brute_best(decoder, chars))


def test_held_out_and_disguised_documents(spark):
    rows, labels = corpus()
    r = random.Random(9)
    hidden = [(10_000 + i, " ".join([*r.choices(BASE, k=40), *[disguise(r.choice(BAD), r) for _ in range(3)], *r.choices(BASE, k=20)])) for i in range(40)]
    extra = [(20_000, None), (20_001, ""), (20_002, "12345 !!"), (None, "the people"), (1, "again the same id")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0.5) for i, t in rows + hidden + extra], "doc_id bigint, text string, lang string, source string, score double")
    known = spark.createDataFrame([*labels, (None, 1, 1), (30_000, 1, None)], "doc_id bigint, quality int, toxic int")
    out = tx.report(docs, known)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    got = {x["doc_id"]: x for x in out.collect()}
    assert out.count() == len(rows + hidden + extra)
    import zlib

    for i, _, toxic in labels:
        if i != 1:
            assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
            assert got[i]["predicted"] == toxic
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.7) for x in got.values())
    assert np.mean([got[i]["predicted"] for i, _ in hidden]) >= 0.9
    assert not any(got[i]["predicted"] for i in (20_000, 20_001, 20_002, None))
    kept = tx.drop_toxic(docs, known)
    assert kept.columns == docs.columns and kept.count() == sum(1 - x["predicted"] for x in out.collect())


def test_without_labels(spark, documents):
    docs = documents([(1, "a text"), (2, None)])
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert [x["predicted"] for x in tx.report(docs, none).collect()] == [0, 0]
    assert tx.report(documents([]), none).collect() == []


def _evidence(reader, block):
    """Words of each text, with the weights a reader has settled for them."""
    text_of, words, sizes = reader.read(block)
    values = reader.value[words] if reader.weights is not None else np.zeros(len(words))
    own = [{} for _ in block]
    for t, w, v in zip(text_of.tolist(), words.tolist(), values.tolist(), strict=True):
        assert reader.names[w] not in own[t]
        own[t][reader.names[w]] = v
    return own, sizes.tolist()


@pytest.mark.parametrize("weighed", [False, True])
def test_a_full_reader_keeps_what_comes_again_and_reads_the_same(model, monkeypatch, weighed):
    r = random.Random(5)
    weights = {"=idiot": 2.0, "moro": 3.0, "scumb": 1.5, "=the": 0.5, "worth": 2.5} if weighed else None

    def word():
        kind = r.randrange(6)
        if kind == 0:
            return disguise(r.choice(BAD), r)
        if kind == 1:
            return "".join(r.choice("aeiourstl13!(.") for _ in range(r.randrange(1, 9)))
        return r.choice(BASE)

    blocks = [[" ".join(word() for _ in range(60)) for _ in range(4)] + [" ".join(r.choice(BAD)) + " mo ron sc um bag", ""] for _ in range(60)]
    monkeypatch.setattr(tx, "CACHED", 150)
    one = tx.Reader(tx.Decoder(model.logp), weights)
    learnt = []
    learn = one._learn
    monkeypatch.setattr(one, "_learn", lambda tokens: (learnt.append(set(tokens)), learn(tokens)))
    for block in blocks:
        assert _evidence(one, block) == _evidence(tx.Reader(tx.Decoder(model.logp), weights), block)
    # words of every text are learnt again at most when too many others come again
    assert sum("people" in tokens for tokens in learnt) <= len(blocks) // 10
    assert len(one.index) <= 150 + 6 * 62


def test_joined_words_are_not_kept(model):
    reader = tx.Reader(tx.Decoder(model.logp), {"=idiot": 2.0})
    own, _ = _evidence(reader, ["the i d i o t and id iot people"])
    assert own[0]["idiot"] == 2.0
    assert _evidence(reader, ["the people"])[0] == [{"the": 0.0, "people": 0.0}]
    assert "idiot" not in reader.words and "idiot" not in reader.names


def test_words_with_doubled_letters_are_decoded_together(model, monkeypatch):
    """A token of letters, doubled or not, needs no lattice of its own, and reads as one does."""
    r = random.Random(11)
    tokens = {"".join(r.choice("aabbeellnooprsstéèßñ") for _ in range(r.randrange(1, 12))) for _ in range(4000)}
    tokens = {r.choice(["", "", '"', "«", "["]) + t + r.choice(["", "", ".", "!", "),", "»"]) for t in tokens} | {"oo", "ee.", "a²²b", "²²", "aßß", "x́xx", "İİ".lower(), "(ll", "çç("}
    decoder, asked = tx.Decoder(model.logp), []
    form = tx._form
    monkeypatch.setattr(tx, "_form", lambda token, *more: (asked.append(token), form(token, *more))[1])
    reader = tx.Reader(decoder, {"=the": 1.0})
    reader.read([" ".join(sorted(tokens))])
    letters = [t for t in tokens if (bare := t.strip(tx._EDGES)).isalpha() and len(bare) > 1 and "(" not in t and not tx._THRICE.search(bare)]
    assert len(letters) > 2000 and not set(letters) & set(asked)
    assert any(tx._TWICE.search(t) and decoder.decode(t.strip(tx._EDGES)) != t.strip(tx._EDGES) for t in letters)
    for t in tokens:
        words, tail, head, more = form(t, decoder, {})
        k = reader.index[t]
        got = ([reader.names[reader.word[k]]] if reader.word[k] >= 0 else []) + [reader.names[w] for w in reader.several.get(k, [])]
        assert got == [*words, *more]
        if "²" not in t:
            assert (reader.tail[k], reader.head[k]) == (reader._ends(tail), reader._ends(head))


def test_joined_words_without_a_weight_are_not_numbered(model):
    reader = tx.Reader(tx.Decoder(model.logp), {"=idiot": 2.0})
    own, _ = _evidence(reader, ["the i d i o t m o r o n mo r on people"])
    assert own[0]["idiot"] == 2.0 and not {"moron", "idiotmoron"} & set(reader.words)


def test_features_of_lists_of_words_are_counted_together():
    import pyarrow as pa

    lists = [["idiot", "idiots", "the"], [], ["=abc", "ab", "ééééé"], ["abcd", "=abcd", "", "abcdefg"], ["the", "idiotic"]]
    group = np.array([0, 1, 2, 2, 0])
    found, n = tx._occurrences(pa.array(lists, pa.list_(pa.string())), group, 3)
    want = {}
    for g, own in zip(group.tolist(), lists, strict=True):
        for f in {f for w in own for f in tx.features(w)}:
            want.setdefault(f, [0, 0, 0])[g] += 1
    assert dict(zip(found.to_pylist(), n.tolist(), strict=True)) == want
    weights = {"=the": 1.0, "idio": 0.5, "=idiots": 2.0, "abcdef": 0.25, "ééééé": 3.0, "=": 4.0}
    words = sorted({w for own in lists for w in own})
    assert tx._weights_of(pa.array(words), weights).tolist() == [tx.weight(w, weights) for w in words]
    assert tx._weights_of(pa.array(words), {}).tolist() == [0.0] * len(words)
