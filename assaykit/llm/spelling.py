"""Spelling variants by a variable-length gram index.

Two words are near if one inserted, deleted or replaced character turns one into the other.

* *Dictionary.* All grams of 2 to 4 characters of all words, which are padded by a mark at either end,
  are counted. Those above a frequency threshold are frequent; there are few of them, as a gram takes
  part in the count once per place, so their number is bounded by the threshold.
* *Decomposition.* At each place of a word stands its variable gram: two characters, made longer while
  it is frequent, up to five. A gram is decided by its own characters, so an edit can change those grams
  only that cover its place: the most grams that cover one place are the word's affected-gram bound.
* *Lists.* Two near words share all other grams, at the same distance from the start (before the edit)
  or from the end (after it). In any common order of grams the first shared one is among the first
  (bound + 1) of either word, so those, the rarest, are what a word enters in the lists. A word of five
  characters has six grams or more and a bound of five at most; shorter words may have no gram to spare.
* *Merging and verification.* Words that meet in a list are verified by edit distance. A list of more
  than ``LIST`` words isn't compared pairwise: its words, once each for all such lists, are met by what
  is left when one character is deleted, which only near words (or hash collisions) share, and verified.
  Words of fewer than five and of more than ``LONG_WORD`` characters are compared in this way too.

Defined cases: null and empty texts have no words; a null doc_id is written as nothing where a run is
altered; repeated rows count each; a run of any length is a word like others; an empty table has no
word; extra columns are ignored and may have any name.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import CRC_TABLE, crc_sql

#: Shortest and longest variable gram. With five at most, a padded word has more grams than its bound.
SHORT, LONG = 2, 5
#: A gram is frequent above ``FREQUENT`` places, or above so many that no more than ``DICTIONARY`` can be.
FREQUENT, DICTIONARY = 64, 200_000
#: Words of a list that are compared pairwise; characters of words that enter lists.
LIST, LONG_WORD = 64, 256
START, END = "\x02", "\x03"
MIN_LENGTH, MIN_COUNT, EVERY = 5, 3, 97

_LOWER = {c: c + 32 for c in range(65, 91)}
#: Distinct strings counted in a task before the counts are sent on.
_HELD = 200_000


def _counted(counts: Counter, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({name: pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})


def altered(doc_id: int | None, run: str, every: int = EVERY) -> str:
    """``run``, or what is left of it if the rule of altered runs takes one of its characters."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, every: int = EVERY) -> DataFrame:
    """(word, n): words of at least ``min_length`` code points that occur ``min_count`` times or more."""
    # a greedy match is a whole run; shorter runs can't give a word
    run = re.compile("[a-zÀ-ÿ]{%d,}" % min_length)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for part in parts:
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                text = (text.as_py() or "").translate(_LOWER)
                # long texts are read run by run, without a list of them
                own = Counter(run.findall(text) if len(text) < 1 << 20 else (m.group() for m in run.finditer(text)))
                seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in own.items():
                    # the checksum of the joined text, continued from that of its beginning
                    if not zlib.crc32(word.encode(), seed) % every:
                        word = altered(doc_id, word, every)
                        if len(word) < min_length:
                            continue
                    counts[word] += n
                if len(counts) > _HELD:
                    yield _counted(counts, "word")
                    counts.clear()
        yield _counted(counts, "word")

    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(count, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def frequent_grams(words: DataFrame, frequent: int = FREQUENT, dictionary: int = DICTIONARY) -> dict[str, int]:
    """Counts of the frequent grams of up to ``LONG`` characters; at most ``dictionary`` of them."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for part in parts:
            for word in part.column(0):
                s = f"{START}{word.as_py()}{END}"
                for q in range(SHORT, LONG + 1):
                    counts.update(s[p : p + q] for p in range(len(s) - q + 1))
                if len(counts) > _HELD:
                    yield _counted(counts, "gram")
                    counts.clear()
        yield _counted(counts, "gram")

    grams = cut_lineage(words.select("word").mapInArrow(count, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > frequent))
    # counts of all grams add up to this; so many of them at most can exceed total / dictionary
    total = grams.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    kept = grams.where(F.col("n") > max(frequent, total // dictionary))
    return {r["gram"]: r["n"] for r in kept.collect()}


def decompose(word: str, frequent) -> list[str]:
    """The variable gram at each place of a word, padded at both ends."""
    s, out = f"{START}{word}{END}", []
    for p in range(len(s) - SHORT + 1):
        q = SHORT
        while q < LONG and p + q < len(s) and s[p : p + q] in frequent:
            q += 1
        out.append(s[p : p + q])
    return out


def affected(grams: list[str]) -> int:
    """The most grams that one edit can change: those that cover one place."""
    most = 0
    for at in range(1, len(grams)):
        most = max(most, sum(p + len(grams[p]) > at for p in range(max(0, at - LONG + 1), min(at + 1, len(grams)))))
    return most


def entries(word: str, frequent: dict[str, int]) -> list[tuple[str, int]]:
    """(gram, place) under which a word is listed; the place from the start, or, below 0, from the end."""
    grams = decompose(word, frequent)
    rarest = sorted(range(len(grams)), key=lambda p: (frequent.get(grams[p], 0), grams[p], p))[: affected(grams) + 1]
    return [(grams[p], at) for p in rarest for at in (p, p - len(grams))]


def _lists(words: DataFrame, frequent) -> DataFrame:
    def emit(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            names, counts, grams, places = [], [], [], []
            for word, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                for gram, at in entries(word, frequent.value):
                    names.append(word)
                    counts.append(n)
                    grams.append(gram)
                    places.append(at)
            yield pa.RecordBatch.from_pydict({
                "word": pa.array(names, pa.string()), "n": pa.array(counts, pa.int64()),
                "gram": pa.array(grams, pa.string()), "at": pa.array(places, pa.int64())})

    return words.select("word", "n").mapInArrow(emit, "word string, n bigint, gram string, at bigint")


#: Polynomial hashes of words less a character; equal hashes are verified, so they decide nothing.
_BASE, _PRIME = 0x5DEECE66D1234567, (1 << 61) - 1


def deletions(word: str) -> tuple[int, list[int]]:
    """Hash of a word, and of what is left of it without each of its characters in turn."""
    before, after, scale = [0], [0], [1]
    for c in word:
        before.append((before[-1] * _BASE + ord(c)) % _PRIME)
        scale.append(scale[-1] * _BASE % _PRIME)
    for k, c in enumerate(reversed(word)):
        after.append((after[-1] + ord(c) * scale[k]) % _PRIME)
    size = len(word)
    return before[-1], [(before[i] * scale[size - 1 - i] + after[size - 1 - i]) % _PRIME for i in range(size)]


def _variants(words: DataFrame) -> DataFrame:
    """(id, key, at) of ``words(id, word)``: ``at`` is the deleted place, -1 for the whole word."""

    def emit(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, keys, places = [], [], []
            for id_, word in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                whole, less = deletions(word)
                ids += [id_] * (len(less) + 1)
                keys += [whole, *less]
                places += range(-1, len(less))
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "key": pa.array(keys, pa.int64()), "at": pa.array(places, pa.int64())})

    return words.select("id", "word").mapInArrow(emit, "id bigint, key bigint, at bigint")


def _near_by_deletion(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b) of near words among ``words(word, n)``, each pair once or more, from either side."""
    named = cut_lineage(words.select(F.xxhash64("word").alias("id"), "word", "n"))
    variants = cut_lineage(_variants(named))
    a, b = variants.alias("a"), variants.where("at >= 0").alias("b")
    same = F.col("a.key") == F.col("b.key")
    replaced = a.join(b, same & (F.col("a.at") == F.col("b.at")) & (F.col("a.id") < F.col("b.id")))
    # the word a is the longer word b less its character at
    deleted = a.where("at < 0").join(b, same)
    pair = [F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), F.col("b.at").alias("at")]
    met = replaced.select(*pair, F.lit(True).alias("replaced")).unionByName(deleted.select(*pair, F.lit(False).alias("replaced")))
    for side in "ab":
        met = met.join(named.select(F.col("id").alias(f"id_{side}"), F.col("word").alias(side), F.col("n").alias(f"n_{side}")), f"id_{side}")
    at = F.col("at").cast("int")
    left, right = (lambda w: F.substring(w, F.lit(1), at)), (lambda w: F.substring(w, at + 2, F.lit((1 << 31) - 1)))
    as_replaced = F.col("replaced") & (F.col("a") != F.col("b")) & (F.char_length("a") == F.char_length("b")) & (left("a") == left("b")) & (right("a") == right("b"))
    as_deleted = ~F.col("replaced") & (F.col("a") == F.concat(left("b"), right("b")))
    return met.where(as_replaced | as_deleted).select("a", "n_a", "b", "n_b")


def near_words(words: DataFrame, list_size: int = LIST, frequent: int = FREQUENT, long_word: int = LONG_WORD) -> DataFrame:
    """(a, n_a, b, n_b): every ordered pair of near words of ``words(word, n)``, once."""
    spark, size = words.sparkSession, F.char_length("word")
    listable = words.where(size <= long_word)
    grams = spark.sparkContext.broadcast(frequent_grams(listable, frequent))
    listed = cut_lineage(_lists(listable, grams))
    sizes = cut_lineage(listed.groupBy("gram", "at").agg(F.count("*").alias("size")).where("size > 1"))
    short = cut_lineage(listed.join(sizes.where(F.col("size") <= list_size).select("gram", "at"), ["gram", "at"]))
    crowded = listed.join(sizes.where(F.col("size") > list_size).select("gram", "at"), ["gram", "at"], "left_semi")
    # two very short words need not share a gram; a very short and a longer one do
    bare = words.where((size < LONG) | (size >= long_word)).select("word", "n")
    a, b = short.alias("a"), short.alias("b")
    near = (F.abs(F.char_length("a.word") - F.char_length("b.word")) <= 1) & (F.levenshtein("a.word", "b.word", 1) == 1)
    found = a.join(b, (F.col("a.gram") == F.col("b.gram")) & (F.col("a.at") == F.col("b.at")) & (F.col("a.word") < F.col("b.word")) & near)
    found = found.select(F.col("a.word").alias("a"), F.col("a.n").alias("n_a"), F.col("b.word").alias("b"), F.col("b.n").alias("n_b"))
    found = found.unionByName(_near_by_deletion(crowded.select("word", "n").unionByName(bare).distinct()))
    pair = F.col("a") < F.col("b")
    found = found.select(
        F.when(pair, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(pair, F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"),
        F.when(pair, F.col("b")).otherwise(F.col("a")).alias("b"), F.when(pair, F.col("n_b")).otherwise(F.col("n_a")).alias("n_b"))
    found = cut_lineage(found.distinct())
    return found.unionByName(found.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))


def groups(words: DataFrame) -> DataFrame:
    """Per word of ``words(word, n)``: word, form, root, n, n_near, form_n.

    form is the near word of largest n (ties: the smallest) if that is at least twice the word's own;
    root is where following forms ends. A form occurs twice as often as what leads to it, so the way is
    at most 63 words long; each round doubles the steps taken.
    """
    best = near_words(words).groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), "b")).alias("best"))
    rows = words.join(best, words["word"] == best["a"], "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "best")
    leads = -F.col("best.less") >= 2 * F.col("n")
    rows = cut_lineage(rows.select("word", "n", "n_near", F.when(leads, F.col("best.b")).alias("form"), F.when(leads, -F.col("best.less")).alias("form_n")))
    ways = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ways = cut_lineage(ways.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if ways.where("moved").isEmpty():
            break
        ways = ways.drop("moved")
    rows = rows.join(ways.select("word", "root"), "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.col("n_near").cast("bigint").alias("n_near"), "form_n")


def report(docs: DataFrame) -> DataFrame:
    """The words of ``docs`` with their forms and roots."""
    return groups(cut_lineage(words(docs)))


_CRC = crc_sql("concat(doc_id, ':', run)")
ORACLE = f"""
WITH RECURSIVE k AS ({CRC_TABLE}),
r AS (SELECT doc_id, run, count(*) AS c FROM (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
x AS (SELECT run, c, {_CRC} AS h FROM r, k),
y AS (SELECT CASE WHEN h % {EVERY} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM x),
w AS (SELECT word, sum(c)::BIGINT AS n FROM y WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(c) >= {MIN_COUNT}),
v AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS v FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word AS a, b.word AS b, b.n FROM v a JOIN v b ON a.i = b.i AND a.v = b.v AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM v a JOIN w b ON a.v = b.word
  UNION SELECT b.word, a.word, a.n FROM v a JOIN w b ON a.v = b.word),
o AS (SELECT a, b, n AS n_b, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS place FROM p),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN n_b >= 2 * n THEN b END AS form, CASE WHEN n_b >= 2 * n THEN n_b END AS form_n
  FROM w LEFT JOIN o ON o.a = w.word AND o.place = 1),
g AS (SELECT word, word AS root FROM f UNION ALL SELECT g.word, f.form FROM g JOIN f ON f.word = g.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, g.root, f.n, f.n_near, f.form_n FROM f JOIN g USING (word) JOIN f e ON e.word = g.root AND e.form IS NULL
"""
