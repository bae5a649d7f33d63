"""Piecewise hashes against a byte-by-byte version, and neighbours against a sorted list."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from assaykit.llm import fingerprint as fp


def slow_fingerprint(text):
    data, size = text.encode(), 1
    while size * fp.PIECES < len(data):
        size *= 2
    out = []
    for block in (size, 2 * size):
        signs, start = [], 0
        for i in range(len(data)):
            h = 0
            for k in range(fp.WINDOW):
                if i - k >= 0:
                    x = int(fp._BYTE[data[i - k]])
                    h ^= ((x << k) | (x >> (32 - k))) & 0xFFFFFFFF if k else x
            h = (h * 0x9E3779B1 & 0xFFFFFFFF) >> 7
            if h % block == block - 1 and len(signs) < fp.LIMIT - 1:
                signs.append(fp.SIGNS[zlib.crc32(data[start : i + 1]) & 63])
                start = i + 1
        if start < len(data):
            signs.append(fp.SIGNS[zlib.crc32(data[start:]) & 63])
        out.append("".join(signs))
    return f"{size}:{out[0]}:{out[1]}"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def slow_likeness(a, b):
    import re

    def alike(x, y):
        x, y = (re.sub(r"(.)\1{3,}", r"\1\1\1", s) for s in (x, y))
        grams = [{s[i : i + fp.COMMON] for i in range(len(s) - fp.COMMON + 1)} for s in (x, y)]
        return 1.0 if x == y else 1 - distance(x, y) / max(len(x), len(y)) if grams[0] & grams[1] else 0.0

    (na, a1, a2), (nb, b1, b2) = a.split(":"), b.split(":")
    if a == b:
        return 1.0
    na, nb = int(na), int(nb)
    return max(alike(a1, b1), alike(a2, b2)) if na == nb else alike(a1, b2) if na == 2 * nb else alike(a2, b1) if nb == 2 * na else 0.0


def slow_report(rows):
    """Rows with distinct (doc_id, text), or equal rows; ties by text are not in these tables."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for (i, text), (_, after) in zip(order, [*order[1:], *order[:1]], strict=True):
        text, after = text or "", after or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        prints = [slow_fingerprint(x) for x in (text, changed, after)]
        out.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), *prints[:2], *[round(slow_likeness(prints[0], p), 9) for p in prints[1:]]))
    return sorted(out, key=str)


def collected(df):
    assert df.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert dict(df.dtypes)["near_next"] == "double"
    return sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in df.collect()), key=str)


@pytest.mark.parametrize("partitions", [1, 8])
def test_documents_against_brute_force(spark, documents, prose, partitions):
    rows = [(i * 3, prose(i, 4 + i * 5)) for i in range(40)]
    rows += [(200, ""), (201, None), (203, "é"), (204, "𝄞𝄞ab"), (205, "ab" * 700), (206, "x" * 3000), (-4, "minus"), (None, "last")]
    rows += [(300, rows[30][1]), (301, rows[30][1] + " and more"), (302, rows[30][1])]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert collected(fp.report(documents(rows))) == slow_report(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_repeated_rows_and_ties(spark, documents, prose):
    rows = [(5, prose(1, 60))] * 30 + [(4, prose(2, 60))] * 2 + [(9, None)] * 3
    assert collected(fp.report(documents(rows))) == slow_report(rows)
    # rows of one id and several texts: each is followed once
    tied = [(1, "a" * 9), (1, "b" * 9), (1, "c" * 9), (2, "d" * 9)]
    got = collected(fp.report(documents(tied)))
    follow = {hashlib.sha256((x[1][:5] + y[1][:4]).encode()).hexdigest(): y[1] for x in tied for y in tied}
    assert sorted(follow[r[2]] for r in got) == sorted(t for _, t in tied)


def test_empty_and_single_tables(spark, documents):
    assert fp.report(documents([])).count() == 0
    assert collected(fp.report(documents([(1, None)]))) == [(1, 0, hashlib.sha256(b"").hexdigest(), "1::", "1::", 1.0, 1.0)]
    assert collected(fp.report(documents([(8, "only one row")]))) == slow_report([(8, "only one row")])


def test_long_texts_are_read_in_segments(monkeypatch, prose):
    text = prose(3, 3000)
    whole = fp.fingerprint(text)
    monkeypatch.setattr(fp, "SEGMENT", 997)
    assert fp.fingerprint(text) == whole == slow_fingerprint(text)


def test_likeness_follows_what_two_texts_share(spark, prose):
    text = prose(4, 1500)
    r = random.Random(1)
    words = text.split()
    cases = [text, " ".join(words[:1350]), "New words first. " + text, " ".join(words[:750]) + " " + prose(5, 750), prose(6, 1500), prose(7, 90)]
    edited = words[:]
    for _ in range(5):
        edited[r.randrange(len(edited))] = "changed"
    cases.append(" ".join(edited))
    rows = spark.createDataFrame([(text, c) for c in cases], "text string, other string")
    rows = fp.with_fingerprint(fp.with_fingerprint(rows), "other", "print")
    near = [x[0] for x in rows.select(fp.likeness(F.col("fingerprint"), F.col("print"))).collect()]
    assert near[0] == 1 and near[1] > 0.8 and near[2] > 0.9 and 0.3 < near[3] < 0.7 and near[4] == near[5] == 0 and near[6] > 0.8
