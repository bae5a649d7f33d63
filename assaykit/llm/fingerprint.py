"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes cuts a text wherever it falls on a given residue modulo the
block size, so a cut depends on what stands around it and not on where it stands. Every piece becomes
one of 64 signs, by its CRC-32; the signs of all pieces, in order, are the signature. The block size is the
smallest power of two that lets about ``PIECES`` pieces cover the text, and a fingerprint
``size:signature:signature at twice the size`` can be compared with those of the same, half or twice
the size. A text with far more cuts than expected (a short period) has its rest in the last piece, so
that signatures have at most ``LIMIT`` signs and all of the text is covered.

Two signatures of the same block size are alike by 1 - (edit distance) / (signs of the longer one); runs of
more than three equal signs count as three, and without ``COMMON`` consecutive signs in common the
likeness is 0. Both are built-in functions of Spark on narrow rows.

Neighbours in the order of ids (descending) are found by one range exchange of the texts, which are
read as a stream inside a partition. The last row of a partition needs the first of the next: these
two rows a partition are written with the results and joined by partition number afterwards.

Defined cases: null is the empty text, whose fingerprint is "1::"; a null doc_id comes after all others;
rows of equal doc_id are ordered by a hash of their texts, and equal rows follow each other; the only
row of a table is its own next one; an empty table gives no rows; extra columns are ignored and may have
any name.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Bytes the rolling hash sees; pieces aimed at, and at most; consecutive signs two signatures must share.
WINDOW, PIECES, LIMIT, COMMON = 7, 64, 128, 4
SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Bytes hashed together.
SEGMENT = 1 << 20
_BYTE = np.random.default_rng(20_12).integers(0, 1 << 32, 256, dtype=np.uint32)


def rolling(raw: np.ndarray) -> np.ndarray:
    """Hash of the last ``WINDOW`` bytes (fewer at the beginning) at each byte: rotated random numbers
    of the bytes, added by exclusive or and spread."""
    numbers = _BYTE[raw]
    out = numbers.copy()
    for k in range(1, min(WINDOW, len(raw))):
        old = numbers[:-k]
        out[k:] ^= (old << np.uint32(k)) | (old >> np.uint32(32 - k))
    out *= np.uint32(0x9E3779B1)
    return out >> np.uint32(7)


def block_size(n_bytes: int) -> int:
    return 1 << max(0, -(-n_bytes // PIECES) - 1).bit_length()


def _cuts(raw: np.ndarray, size: int) -> tuple[list[int], list[int]]:
    """Ends of pieces at block sizes ``size`` and twice ``size``, at most ``LIMIT`` - 1 of each."""
    one: list[int] = []
    two: list[int] = []
    mask = np.uint32(2 * size - 1)
    for a in range(0, len(raw), SEGMENT):
        low = max(0, a - WINDOW + 1)
        rest = rolling(raw[low : a + SEGMENT])[a - low :] & mask
        ends = np.flatnonzero((rest & np.uint32(size - 1)) == size - 1)
        if len(two) < LIMIT:
            two += (ends[rest[ends] == mask] + (a + 1)).tolist()[:LIMIT]
        if len(one) < LIMIT:
            one += (ends + (a + 1)).tolist()[:LIMIT]
        if len(two) >= LIMIT:
            break
    return one[: LIMIT - 1], two[: LIMIT - 1]


def _signature(data: memoryview, ends: list[int]) -> str:
    out, start = [], 0
    for end in [*ends, len(data)]:
        if end > start:
            out.append(SIGNS[zlib.crc32(data[start:end]) & 63])
            start = end
    return "".join(out)


def fingerprint(text: str) -> str:
    data = text.encode()
    size = block_size(len(data))
    one, two = _cuts(np.frombuffer(data, np.uint8), size)
    view = memoryview(data)
    return f"{size}:{_signature(view, one)}:{_signature(view, two)}"


def _alike(x: Column, y: Column) -> Column:
    """Likeness of two signatures of one block size."""
    short = lambda s: F.regexp_replace(s, r"(.)\1{3,}", "$1$1$1")
    x, y = short(x), short(y)
    runs = lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(s) - (COMMON - 1), F.lit(1))), lambda i: F.substring(s, i, F.lit(COMMON)))
    longer = F.greatest(F.char_length(x), F.char_length(y))
    related = (F.least(F.char_length(x), F.char_length(y)) >= COMMON) & F.arrays_overlap(runs(x), runs(y))
    return F.when(x == y, 1.0).when(related, 1 - F.levenshtein(x, y) / longer).otherwise(0.0)


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints, 0 to 1; 0 where no block size is common to both."""
    (size_a, a1, a2), (size_b, b1, b2) = ([F.split(x, ":")[k] for k in range(3)] for x in (a, b))
    size_a, size_b = size_a.cast("bigint"), size_b.cast("bigint")
    return (
        F.when(a == b, 1.0).when(size_a == size_b, F.greatest(_alike(a1, b1), _alike(a2, b2)))
        .when(size_a == 2 * size_b, _alike(a1, b2)).when(size_b == 2 * size_a, _alike(a2, b1)).otherwise(0.0)
    )


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of a text column."""

    @F.arrow_udf("string")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t.as_py() or "") for t in texts], pa.string())

    return docs.withColumn(name, prints(F.col(f"`{text}`")))


#: A result row; where ``edge`` is 1, the first row of a partition, and 2, its last, still without a next one.
_FIELDS = {
    "doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(),
    "next_fingerprint": pa.string(), "edge": pa.int32(), "part": pa.int32(), "text": pa.string(),
}
_SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string, edge int, part int, text string"


def edited(text: str, after: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of ``after``."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _row(doc_id, text: str, print_: str, after: str, next_print: str) -> tuple:
    changed = edited(text, after)
    return (doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), print_, fingerprint(changed), next_print, 0, None, None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(_FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _FIELDS.values(), strict=True)], names=list(_FIELDS))


def _followed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition, each with its next one, and the partition's two edges."""
    part_id, last = TaskContext.get().partitionId(), None
    for part in parts:
        rows = []
        for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
            text = text.as_py()
            print_ = fingerprint(text)
            if last is None:
                rows.append((doc_id, len(text), None, print_, None, None, 1, part_id, text))
            else:
                rows.append(_row(*last, text, print_))
            last = (doc_id, text, print_)
        yield _batch(rows)
    if last is not None:
        yield _batch([(last[0], len(last[1]), None, last[2], None, None, 2, part_id, last[1])])


def _joined(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        yield _batch([_row(*row) for row in zip(*(part.column(k).to_pylist() for k in range(5)), strict=True)])


def neighbours(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # the last key only lets many equal rows be split; it is the same whenever a task runs again
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.col("place")]
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    rows = cut_lineage(rows.mapInArrow(_followed, _SCHEMA))
    heads, ends = rows.where("edge = 1"), rows.where("edge = 2")
    # one number a partition
    order = sorted(r["part"] for r in heads.select("part").collect())
    ways = spark.createDataFrame(list(zip(order, [*order[1:], *order[:1]], strict=True)), "part int, next int")
    pairs = ends.join(F.broadcast(ways), "part").alias("e").join(heads.alias("h"), F.col("e.next") == F.col("h.part"))
    pairs = pairs.select("e.doc_id", "e.text", "e.fingerprint", F.col("h.text").alias("after"), F.col("h.fingerprint").alias("next_fingerprint"))
    return rows.where("edge = 0").unionByName(pairs.mapInArrow(_joined, _SCHEMA)).drop("edge", "part", "text")


def report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    near = [likeness(F.col("fingerprint"), F.col(c)).cast("double") for c in ("edited_fingerprint", "next_fingerprint")]
    return neighbours(docs).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near[0].alias("near_edited"), near[1].alias("near_next"))
