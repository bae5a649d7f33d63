"""Substring dedup by level-wise doubling: windows repeated at one length alone are extended to twice it.

The first level has half the wanted length. At that length only anchors are compared (every wanted
window holds one, see ``windows``); those that do not start in two documents are dropped with all the
windows they stand for. The windows of the others are extended to twice the length: a window is named
by the pair of its halves' identifiers. The wanted length is where removal is decided, and every word
of a longer repeat lies in a repeated window of this length, so no further level can add one.

Removed are the words of windows whose words also start, in the same order, in a document with a
smaller doc_id; windows are judged on the input.

Defined cases: null and empty texts have no words; texts shorter than a window keep all; of rows with
equal doc_id none is earlier; a null doc_id is larger than any other; a window repeated inside one
document only stays; extra columns are kept and may have any name.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, as_struct
from .windows import KEY, Hashes, Search, Sequence, key_columns, search

WINDOW = 50


def _halves(hashes: Hashes, starts, window: int):
    """A window of twice a level's length as the identifiers of its two halves."""
    half = window // 2
    return hashes.of(starts, starts + half), hashes.of(starts + half, starts + window)


def _find(window: int) -> Search:
    return Search("word", window, max(1, window // 2), True, _halves)


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _all_words(seq: Sequence) -> str:
    return _sha(b" ".join(seq.raw.tobytes().split()))


def report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document row: doc_id, n_words, n_removed, kept_sha256."""

    def result(seq: Sequence, spans: list) -> dict:
        return {"removed": sum(b - a for a, b in spans), "sha": _sha(seq.without(spans))}

    rows = search(docs, _find(window), _all_words, result, [("removed", pa.int64()), ("sha", pa.string())])
    return rows.select(
        "doc_id", F.col("n").alias("n_words"), F.coalesce("found.removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("found.sha", "sha").alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated words removed from ``text``; all rows and columns stay.

    A text that loses words becomes its kept words joined by one space, any other is unchanged. An
    integer n_chars column is set to the length of a changed text.
    """

    def result(seq: Sequence, spans: list) -> dict:
        return {"text": seq.without(spans).decode()}

    changed = search(docs, _find(window), lambda seq: "", result, [("text", pa.string())])
    changed = changed.where("found is not null").select(*KEY, F.col("found.text").alias("_new")).dropDuplicates([*KEY])
    types = dict(docs.dtypes)
    rows = docs.select(as_struct(docs), *key_columns()).join(changed, [*KEY], "left")

    def column(name):
        old = F.col(f"{ROW}.`{name}`")
        if name == "text":
            return F.coalesce("_new", old).alias(name)
        if name == "n_chars" and types[name] in ("int", "bigint"):
            return F.when(F.col("_new").isNotNull(), F.char_length("_new")).otherwise(old).cast(types[name]).alias(name)
        return old.alias(name)

    return rows.select(*[column(c) for c in docs.columns])
