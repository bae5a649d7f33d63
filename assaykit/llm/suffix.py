"""Suffix-array dedup by bucket-pointer refinement, over bytes.

Suffixes are put into buckets by their first q bytes. A bucket is refined by sorting its suffixes on
the bucket identifiers at later offsets: (b(s), b(s + q)) names 2q bytes, and the identifiers so made
are used again at twice the offset, (B(s), B(s + 2q)) for 4q bytes. Buckets with one suffix are done
and leave. Here a suffix's identifier is the hash of its bucket's content, which every task can
compute for itself, so no identifiers have to be renumbered between rounds, and sorting is Spark's
grouping by identifier. Only anchors enter the first round (every window of 4q bytes holds one, see
``windows``); suffixes at other starts enter with the anchor of their window, if it stays.

Removed are all bytes covered by a window that also starts anywhere else, in the same document too.

Defined cases: null and empty texts have no bytes; texts shorter than a window keep all; matches never
cross documents; rows equal in doc_id and text are different places; overlapping occurrences in one
text count; a cut may leave bytes that are no text, so kept bytes are reported by their digest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import Hashes, Search, Sequence, mix, search

WINDOW = 400


def _refined(hashes: Hashes, starts: np.ndarray, window: int):
    """The identifiers of a window's two halves, each made of two q-gram identifiers."""
    cuts = [window * k // 4 for k in range(5)]
    b = [hashes.of(starts + a, starts + e) for a, e in zip(cuts, cuts[1:], strict=False)]
    pair = lambda x, y: mix(x * np.uint64(0xD6E8FEB86659FD93) + y)
    return pair(b[0], b[1]), pair(b[2], b[3])


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def result(seq: Sequence, spans: list) -> dict:
        return {"removed": sum(b - a for a, b in spans), "spans": len(spans), "sha": _sha(seq.without(spans))}

    find = Search("byte", window, max(1, window // 4), False, _refined)
    rows = search(docs, find, lambda seq: _sha(seq.raw.tobytes()), result, [("removed", pa.int64()), ("spans", pa.int64()), ("sha", pa.string())])
    return rows.select(
        "doc_id", F.col("n").alias("n_bytes"), F.coalesce("found.removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("found.spans", F.lit(0)).cast("bigint").alias("n_spans"), F.coalesce("found.sha", "sha").alias("kept_sha256"),
    )
