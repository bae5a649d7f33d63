"""Repeated windows of long sequences: hashing and the distributed search two operators build on.

A text is a sequence of units (words or bytes). Among the grams of a window, the leftmost with the
smallest hash is its anchor; equal windows have equal anchors, so windows can only repeat where their
anchor's gram does. There are few anchors, each standing for a run of neighbouring window starts.

``search`` narrows down in steps, each on what the step before left:

1. anchors whose gram occurs often enough stay, and with them the texts that hold them;
2. the runs of staying anchors are collapsed into classes of equal content: where a class repeats, all
   its windows do, however many copies there are; what is left in buckets (grams) of several classes
   is cut into blocks of windows, whose buckets are what all windows of a block share, and collapsed
   in the same way;
3. what is left then is compared window by window.

Long texts are read in segments of bounded size. Every table between steps holds plain rows, and a
gram, class or window that occurs very often is counted before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from ..session import cut_lineage

#: Window starts of one segment of a long text; bytes hashed together.
SEGMENT = 1 << 18
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_RANDOM = np.random.default_rng(20_11)
_BYTE = _RANDOM.integers(0, 1 << 62, 256, dtype=np.uint64)
#: A random number for each byte at each of the first places of a word.
_PLACES = 64
_PLACED = _RANDOM.integers(0, 1 << 64, (_PLACES, 256), dtype=np.uint64, endpoint=False).reshape(-1)
#: Two primes below 2^31, so that products fit 62 bits, and the points at which polynomials are taken.
PRIMES = (2_147_483_647, 2_147_483_629)
_POINTS = tuple(int(x) for x in _RANDOM.integers(1 << 29, 1 << 31, 2))


def _powers(point: int, prime: int, n: int) -> np.ndarray:
    """At least ``n`` powers of ``point`` modulo ``prime``."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(point, len(out), prime)) % np.uint64(prime)])
    return out


_TABLES: list[tuple[np.ndarray, np.ndarray]] = []


def power_tables(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each prime, at least ``n`` powers of its point and of the point's inverse."""
    if not _TABLES or len(_TABLES[0][0]) < n:
        _TABLES[:] = [(_powers(x, p, n), _powers(pow(x, -1, p), p, n)) for x, p in zip(_POINTS, PRIMES, strict=True)]
    return _TABLES


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over 64 bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Hashes:
    """Hashes of any ranges of a segment of units, from running sums.

    A range is a polynomial in its units, modulo each of two primes. Ranges of equal length that differ
    agree at a random point with a chance of at most (length / 2^31)^2; modulo a power of two,
    regular patterns would agree at every point.
    """

    def __init__(self, units: np.ndarray):
        self.n = len(units)
        self.tables = power_tables(max(SEGMENT + 4096, self.n + 1))
        self.sums = []
        for prime, (power, _) in zip(PRIMES, self.tables, strict=True):
            sums = np.zeros(self.n + 1, np.uint64)
            # terms are below 2^31, so their sums fit
            np.cumsum(units % np.uint64(prime) * power[: self.n] % np.uint64(prime), out=sums[1:])
            self.sums.append(sums)

    def _mixed(self, low, high, place) -> np.ndarray:
        one, two = (
            (sums[high] - sums[low]) % np.uint64(prime) * inverse[place] % np.uint64(prime)
            for prime, (_, inverse), sums in zip(PRIMES, self.tables, self.sums, strict=True)
        )
        return mix(one << np.uint64(31) | two)

    def of(self, a, b) -> np.ndarray:
        """Hashes of the ranges [a, b), the same wherever a range stands."""
        return self._mixed(a, b, a)

    def grams(self, size: int) -> np.ndarray:
        """Hashes of all ranges of ``size`` units."""
        m = self.n - size + 1
        return self._mixed(slice(0, m), slice(size, None), slice(0, m))


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte (exclusive) of the words of a text, cut at the six ASCII white characters."""
    white = np.ones(len(raw) + 2, np.int8)
    white[1:-1] = _WHITE[raw]
    step = np.diff(white)
    return np.flatnonzero(step == -1), np.flatnonzero(step == 1)


def word_units(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: the sum of random numbers for its bytes and their places, or, of a word
    of more than ``_PLACES`` bytes, its XXH64."""
    out, at = np.empty(len(starts), np.uint64), 0
    size = ends - starts
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + SEGMENT, "right")))
        some = np.minimum(size[at:stop], _PLACES)
        first = np.cumsum(some) - some
        place = np.arange(int(some.sum())) - np.repeat(first, some)
        byte = raw[np.repeat(starts[at:stop], some) + place]
        out[at:stop] = np.add.reduceat(_PLACED[place * 256 + byte], first)
        at = stop
    for i in np.flatnonzero(size > _PLACES).tolist():
        out[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]].tobytes())
    return out


class Sequence:
    """The units of one text; ``kind`` is "word" or "byte"."""

    def __init__(self, text: str | None, kind: str):
        self.kind = kind
        self.raw = np.frombuffer((text or "").encode(), np.uint8)
        if kind == "word":
            self.starts, self.ends = word_bounds(self.raw)
            self.n = len(self.starts)
            self._units = None
        else:
            self.n = len(self.raw)

    def units(self, a: int, b: int) -> np.ndarray:
        if self.kind == "byte":
            return _BYTE[self.raw[a:b]]
        if self._units is None:
            self._units = word_units(self.raw, self.starts, self.ends)
        return self._units[a:b]

    def segments(self, window: int) -> Iterator[tuple[int, Hashes]]:
        """(first unit, hashes) of segments that together hold every window once."""
        for a in range(0, self.n - window + 1, SEGMENT):
            yield a, Hashes(self.units(a, min(self.n, a + SEGMENT + window - 1)))

    def without(self, spans: list[tuple[int, int]]) -> bytes:
        """The text less the given disjoint, sorted spans of units; words are joined by one space."""
        keep = np.ones(self.n, bool)
        for a, b in spans:
            keep[a:b] = False
        if self.kind == "byte":
            return self.raw[keep].tobytes()
        raw = self.raw.tobytes()
        return b" ".join([raw[a:b] for a, b in zip(self.starts[keep].tolist(), self.ends[keep].tolist(), strict=True)])


def anchors(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors (p, first, last): gram p is the leftmost smallest of the ``width`` grams from each
    window start first .. last. ``h`` holds the hashes of all grams of a segment."""
    least, size = h, 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    cuts = np.flatnonzero(least[1:] != least[:-1]) + 1
    p, first, last = [], [], []
    for s, end in zip([0, *cuts.tolist()], [*(cuts - 1).tolist(), len(least) - 1], strict=True):
        while s <= end:
            at = s + int(h[s : s + width].argmin())
            stop = min(end, at)
            p.append(at)
            first.append(s)
            last.append(stop)
            s = stop + 1
    return np.array(p, np.int64), np.array(first, np.int64), np.array(last, np.int64)


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans joined."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


@dataclass(frozen=True)
class Search:
    """What to look for. ``window_keys(hashes, starts, window)`` names a window by two 64-bit numbers.

    ``earlier``: a window counts if it also starts in a document with a smaller id; otherwise, if it
    also starts anywhere else.
    """

    kind: str
    window: int
    gram: int
    earlier: bool
    window_keys: Callable[[Hashes, np.ndarray, int], tuple[np.ndarray, np.ndarray]]

    @property
    def width(self) -> int:
        """Grams in a window."""
        return self.window - self.gram + 1

    @property
    def block(self) -> int:
        """Window starts compared together before single windows are."""
        return max(1, self.window // 12)


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x, np.uint64).view(np.int64))


#: A text is known by its id (null as the largest) and a hash of its content; rows equal in both
#: have the same result.
KEY = ("_ord", "_hash")


def key_columns() -> list[Column]:
    order = F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1))
    return [order.alias("_ord"), F.xxhash64(F.col("doc_id").isNull(), F.coalesce("text", F.lit(""))).alias("_hash")]


SCAN = "struct<n:bigint,sha:string,grams:array<bigint>,at:array<bigint>>"


def _scan(text: Column, find: Search, digest: Callable[[Sequence], str]) -> Column:
    @F.arrow_udf(SCAN)
    def scan(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            n, sha, grams, at, offsets = [], [], [], [], [0]
            for text in part:
                seq = Sequence(text.as_py(), find.kind)
                n.append(seq.n)
                sha.append(digest(seq))
                count = 0
                for a, hashes in seq.segments(find.window):
                    h = hashes.grams(find.gram)
                    p, _, _ = anchors(h, find.width)
                    p = np.unique(p)
                    grams.append(h[p])
                    at.append(p + a)
                    count += len(p)
                offsets.append(offsets[-1] + count)
            offsets = pa.array(offsets, pa.int32())
            grams = _longs(np.concatenate(grams) if grams else np.empty(0, np.uint64))
            at = pa.array(np.concatenate(at) if at else np.empty(0, np.int64), pa.int64())
            yield pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.ListArray.from_arrays(offsets, grams), pa.ListArray.from_arrays(offsets, at)],
                ["n", "sha", "grams", "at"],
            )

    return scan(text)


RUNS = "_ord bigint, _hash bigint, first bigint, last bigint, at bigint, bucket bigint, c1 bigint, c2 bigint"


def _batch(order, key, columns: dict) -> pa.RecordBatch:
    """Rows of one text; unsigned columns are stored as bigint."""
    n = len(next(iter(columns.values())))
    arrays = [pa.array([order.as_py()] * n, pa.int64()), pa.array([key.as_py()] * n, pa.int64())]
    arrays += [_longs(x) if x.dtype == np.uint64 else pa.array(x, pa.int64()) for x in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=["_ord", "_hash", *columns])


def _class(hashes: Hashes, first: np.ndarray, end: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A region [first, end) as the hashes of its two halves; ``tag`` tells regions of equal content apart."""
    middle = (first + end) // 2
    c1 = mix(hashes.of(first, middle) + np.uint64(3) * tag.astype(np.uint64))
    return c1, mix(hashes.of(middle, end) + np.uint64(5) * (end - first).astype(np.uint64))


def _runs(suspects: DataFrame, find: Search) -> DataFrame:
    """A row for each run of window starts under a staying anchor: bucket is its gram, (c1, c2) its class."""

    def emit(parts):
        for part in parts:
            for order, key, text, at in zip(*(part.column(c) for c in ("_ord", "_hash", "text", "at")), strict=True):
                seq, stay = Sequence(text.as_py(), find.kind), np.array(at.as_py(), np.int64)
                for a, hashes in seq.segments(find.window):
                    h = hashes.grams(find.gram)
                    p, first, last = anchors(h, find.width)
                    some = np.isin(p + a, stay)
                    p, first, last = p[some], first[some], last[some]
                    c1, c2 = _class(hashes, first, last + find.window, p - first)
                    yield _batch(order, key, {"first": first + a, "last": last + a, "at": p + a, "bucket": h[p], "c1": c1, "c2": c2})

    return suspects.select("_ord", "_hash", "text", "at").mapInArrow(emit, RUNS)


def _blocks(suspects: DataFrame, find: Search) -> DataFrame:
    """Given runs cut into blocks of neighbouring starts, aligned to the anchor: bucket is what all
    windows of a block have in common, (c1, c2) the class of all they cover."""
    size = find.block

    def emit(parts):
        for part in parts:
            for order, key, text, runs in zip(*(part.column(c) for c in ("_ord", "_hash", "text", "runs")), strict=True):
                seq = Sequence(text.as_py(), find.kind)
                runs = np.array(sorted({(r["first"], r["last"], r["at"], r["done"]) for r in runs.as_py()}), np.int64)
                for a, hashes in seq.segments(find.window):
                    own = runs[(runs[:, 0] >= a) & (runs[:, 0] < a + SEGMENT)]
                    if not len(own):
                        continue
                    first, last, p = own[:, 0] - a, own[:, 1] - a, own[:, 2] - a
                    low, high = (p - last) // size, (p - first) // size
                    row = np.repeat(np.arange(len(own)), high - low + 1)
                    number = np.arange(len(row)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1) + low[row]
                    near, far = number * size, number * size + size - 1  # distances from start to anchor
                    start, stop = np.maximum(first[row], p[row] - far), np.minimum(last[row], p[row] - near)
                    common = mix(hashes.of(p[row] - near, p[row] - far + find.window) + number.astype(np.uint64))
                    c1, c2 = _class(hashes, start, stop + find.window, p[row] - start)
                    yield _batch(order, key, {"first": start + a, "last": stop + a, "at": p[row] + a, "bucket": common, "c1": c1, "c2": c2, "done": own[row, 3]})

    return suspects.select("_ord", "_hash", "text", "runs").mapInArrow(emit, RUNS + ", done bigint").withColumn("done", F.col("done") == 1)


def _refine(rows: DataFrame, find: Search) -> tuple[DataFrame, DataFrame]:
    """(spans that repeat, rows to look at more closely) from rows with a bucket and a class.

    Where a class repeats, so do all its windows. Rows of other classes can only share some of their
    windows with rows of the same bucket; one row stands for its class there. ``done`` marks rows that
    repeat anyway and are only there to be compared with.
    """
    place = F.struct(*KEY, "first", "last", "at")
    classes = cut_lineage(rows.groupBy("c1", "c2").agg(
        F.count("*").alias("copies"), F.max("done").alias("done"), F.min(place).alias("head"), F.min("bucket").alias("bucket")))
    lone = (F.col("copies") == 1) & ~F.col("done")
    held = classes.groupBy("bucket").agg(F.count("*").alias("n"), F.max(lone).alias("lone"))
    several = cut_lineage(held.where("n > 1" if find.earlier else "n > 1 and lone").select("bucket"))
    if find.earlier:
        # copies in later documents are repeats; those in the class's first document may still be
        own = rows.join(classes.select("c1", "c2", "head"), ["c1", "c2"])
        whole = own.where("_ord > head._ord")
        rest = own.where("_ord = head._ord").join(several, "bucket", "left_semi").select(*KEY, "first", "last", "at", "done")
    else:
        whole = rows.join(classes.where("copies > 1").select("c1", "c2"), ["c1", "c2"], "left_semi")
        rest = classes.join(several, "bucket", "left_semi").select("head.*", (F.col("done") | (F.col("copies") > 1)).alias("done"))
    spans = whole.select(*KEY, F.col("first").alias("a"), (F.col("last") + find.window).alias("b"))
    runs = rest.groupBy(*KEY).agg(F.collect_set(F.struct("first", "last", "at", "done")).alias("runs"))
    return spans, runs


def _windows(suspects: DataFrame, find: Search) -> DataFrame:
    """A row for each window that starts in the given runs."""

    def emit(parts):
        for part in parts:
            for order, key, text, runs in zip(*(part.column(c) for c in ("_ord", "_hash", "text", "runs")), strict=True):
                seq = Sequence(text.as_py(), find.kind)
                runs = sorted({(r["first"], r["last"]) for r in runs.as_py()})
                for a, hashes in seq.segments(find.window):
                    own = [np.arange(f - a, e - a + 1) for f, e in runs if a <= f < a + SEGMENT]
                    if own:
                        starts = np.unique(np.concatenate(own))
                        w1, w2 = find.window_keys(hashes, starts, find.window)
                        yield _batch(order, key, {"first": starts + a, "w1": w1, "w2": w2})

    return suspects.select("_ord", "_hash", "text", "runs").mapInArrow(emit, "_ord bigint, _hash bigint, first bigint, w1 bigint, w2 bigint")


def search(docs: DataFrame, find: Search, digest: Callable[[Sequence], str], result: Callable[[Sequence, list], dict], fields: list[tuple[str, pa.DataType]]) -> DataFrame:
    """doc_id, key, n and sha of every row of ``docs``, and ``found``: ``result(sequence, spans)`` for
    texts with repeated windows (spans of units, joined), null for the others."""
    rows = docs.select(*key_columns(), "doc_id", "text")
    read = cut_lineage(rows.select(*KEY, "doc_id", _scan(F.col("text"), find, digest).alias("s")))
    found = read.select(*KEY, F.explode(F.arrays_zip(F.col("s.grams").alias("gram"), F.col("s.at").alias("at"))).alias("g")).select(*KEY, "g.gram", "g.at")

    # 1: grams that occur often enough. What is counted is written before it is joined: a join of two
    # plain tables is one whose skewed keys Spark splits
    often = F.min("_ord") < F.max("_ord") if find.earlier else F.count("*") > 1
    grams = cut_lineage(found.groupBy("gram").agg(often.alias("often")).where("often").select("gram"))
    stay = found.join(grams, "gram").groupBy(*KEY).agg(F.collect_set("at").alias("at"))
    suspects = cut_lineage(rows.select(*KEY, "text").join(stay, [*KEY]))

    # rows equal in id and text have the same windows at the same places
    each = suspects.dropDuplicates([*KEY])

    # 2: runs of windows under one anchor, then blocks of a run
    spans, runs = _refine(cut_lineage(_runs(suspects, find).withColumn("done", F.lit(False))), find)
    more, runs = _refine(cut_lineage(_blocks(each.join(runs, [*KEY]), find)), find)

    # 3: single windows
    windows = cut_lineage(_windows(each.join(runs, [*KEY]), find))
    counted = windows.groupBy("w1", "w2").agg(often.alias("often"), F.min("_ord").alias("least"))
    counted = cut_lineage(counted.where("often").select("w1", "w2", "least"))
    again = windows.join(counted, ["w1", "w2"])
    if find.earlier:
        again = again.where("_ord > least")
    spans = spans.unionByName(more).unionByName(again.select(*KEY, F.col("first").alias("a"), (F.col("first") + find.window).alias("b")))

    spans = spans.groupBy(*KEY).agg(F.collect_set(F.struct("a", "b")).alias("spans"))

    @F.arrow_udf(from_arrow_type(pa.struct(fields)))
    def finish(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for text, list_ in zip(texts, lists, strict=True):
            out.append(result(Sequence(text.as_py(), find.kind), merge([(s["a"], s["b"]) for s in list_.as_py()])))
        return pa.array(out, pa.struct(fields))

    done = suspects.select(*KEY, "text").join(spans, [*KEY]).select(*KEY, finish("text", "spans").alias("found")).dropDuplicates([*KEY])
    return read.select(*KEY, "doc_id", F.col("s.n").alias("n"), F.col("s.sha").alias("sha")).join(done, [*KEY], "left").select("doc_id", *KEY, "n", "sha", "found")
