"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has bit i set if more than half of the shingle hashes have it set. Two fingerprints
within ``max_distance`` bits must, for partitions of the bits with thresholds t_i that add up to
max_distance - m + 1, agree to within t_i bits on at least one partition i (t_i = -1 skips it).
Bits that go together are put into the same partition, and a dynamic program gives each partition
the threshold with the least estimated work; both come from counts over all fingerprints.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; repeated
rows and equal texts share a fingerprint and so a component; a null doc_id takes part but never
names a component unless it is alone there (then null); extra columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import ROW, as_struct, connected_components, signed

BITS = 64
#: Fingerprints under one key that are compared directly; a larger group is divided further.
BLOCK = 512


def fingerprint_of(text: str, shingle: int = 3) -> int:
    """SimHash of the XXH64 (seed 42) of all shingles of A-Z-lower-cased words, repeats included."""
    ws = text.encode().lower().split()
    if not ws:
        return 0
    joined = b" ".join(ws)
    digest = xxhash.xxh64_intdigest
    if len(ws) <= shingle:
        return digest(joined, 42)
    sizes = np.fromiter(map(len, ws), np.int64, len(ws))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(ws) - shingle + 1].tolist()
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for part in np.array_split(hashes, max(1, len(hashes) // 65_536)):
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8)[:, ::-1], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(texts, shingle: int = 3):
    """Column of fingerprints as bigint (the same 64 bits)."""

    @F.arrow_udf("bigint")
    def compute(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield signed(np.array([fingerprint_of(x.as_py() or "", shingle) for x in part], np.uint64))

    return compute(texts)


def _bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each pair of bits in how many both are set (over all rows)."""

    def count(parts):
        total, n = np.zeros((BITS, BITS)), 0
        for part in parts:
            values = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            bits = ((values[:, None] >> np.arange(BITS)) & 1).astype(np.float32)
            total += bits.T @ bits
            n += len(values)
        if n:
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "both": pa.array([total.astype(np.int64).ravel().tolist()], pa.list_(pa.int64()))})

    # a table of 64 x 64 sums for each partition, added up before it leaves the executors
    each = prints.select("fp").mapInArrow(count, "n bigint, both array<bigint>")
    sums = each.select("n", F.posexplode("both").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()
    both = np.zeros(BITS * BITS)
    for r in sums:
        both[r["i"]] = r["v"]
    return (sums[0]["n"] if sums else 0), both.reshape(BITS, BITS)


def correlated_partitions(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """Bits in ``m`` partitions of near equal size; each grows by the bit most correlated with it."""
    p = both.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    left, out = set(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        part: list[int] = []
        while len(part) < size:
            rest = sorted(left)
            gain = corr[np.ix_(rest, part or rest)].sum(axis=1)
            best = rest[int(np.argmax(gain))]
            part.append(best)
            left.discard(best)
        out.append(sorted(part))
    return out


def project(column, bits: list[int]):
    """The given bits of a bigint column, packed; neighbouring bits move together."""
    out, at, k = F.lit(0).cast("bigint"), 0, 0
    while k < len(bits):
        run = 1
        while k + run < len(bits) and bits[k + run] == bits[k] + run:
            run += 1
        piece = F.shiftrightunsigned(column, bits[k])
        if run < BITS:
            piece = piece.bitwiseAND(F.lit((1 << run) - 1).cast("bigint"))
        out = out.bitwiseOR(F.shiftleft(piece, at))
        at += run
        k += run
    return out


def _flips(width: int, most: int) -> list[int]:
    """Masks of 1 to ``most`` set bits."""
    return [sum(1 << b for b in c) for t in range(1, most + 1) for c in combinations(range(width), t)]


def _pair_counts(prints: DataFrame, parts: list[list[int]], most: int) -> np.ndarray:
    """counts[i, t]: pairs within t bits on partition i, for t = 0 .. most, over all fingerprints."""
    keys = prints.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), project(F.col("fp"), b).alias("v")) for i, b in enumerate(parts)])).alias("k"))
    held = keys.groupBy("k.i", "k.v").agg(F.count("*").alias("n"))
    near = held.select("i", F.explode(F.array(F.struct(F.col("v"), F.lit(0).alias("t")), *[
        F.struct(F.col("v").bitwiseXOR(F.lit(1 << b).cast("bigint")).alias("v"), F.lit(1).alias("t"))
        for b in range(max(map(len, parts)))] if most else F.array(F.struct(F.col("v"), F.lit(0).alias("t"))))).alias("k"), "n")
    out = np.zeros((len(parts), most + 1))
    # pairs at distance 1 = sum over keys of own count x count over the neighbouring keys
    summed = near.groupBy("i", "k.v").agg(F.sum(F.when(F.col("k.t") == 0, F.col("n"))).alias("own"), F.sum(F.when(F.col("k.t") == 1, F.col("n"))).alias("by"))
    for r in summed.groupBy("i").agg(F.sum(F.col("own").cast("double") * (F.col("own") - 1) / 2).alias("p0"), F.sum(F.col("own").cast("double") * F.col("by") / 2).alias("p1")).collect():
        out[r["i"], 0] = r["p0"] or 0
        if most:
            out[r["i"], 1] = (r["p0"] or 0) + (r["p1"] or 0)
    return out


def allocate(costs: np.ndarray, total: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 of least cost that add up to ``total``; costs[i, t] for t = 0, 1, ...

    A dynamic program over partitions and the sum so far.
    """
    m, most = costs.shape
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(m):
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (cost, ts) in best.items():
            for t in range(-1, most):
                new = cost + (costs[i, t] if t >= 0 else 0.0)
                if s + t not in step or new < step[s + t][0]:
                    step[s + t] = (new, [*ts, t])
        best = step
    return best.get(total, (float("inf"), []))


def plan(prints: DataFrame, max_distance: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions to search, for the cheapest number of partitions."""
    n, both = _bit_counts(prints)
    options = []
    for m in range(max(1, (max_distance + 1) // 2), max_distance + 2):
        parts = correlated_partitions(n, both, m)
        pairs = _pair_counts(prints, parts, 1)
        probes = np.array([[n * 2.0, n * (2.0 + len(p))] for p in parts])
        # a probe row is shuffled, a candidate only compared
        cost, ts = allocate(probes * 8 + pairs, max_distance - m + 1)
        if ts:
            options.append((cost, [(p, t) for p, t in zip(parts, ts, strict=True) if t >= 0]))
    return min(options, key=lambda o: o[0])[1]


def links(prints: DataFrame, max_distance: int = 3, block: int = BLOCK, depth: int = 2) -> DataFrame:
    """(a, b), a < b: edges that connect distinct fingerprints at most ``max_distance`` bits apart.

    Fingerprints meet under a key (partition, its bits); those within a partition's threshold are
    reached by flipping bits of the probe. A group of more than ``block`` fingerprints under a key is
    not paired off: its members must also agree on one of max_distance + 1 parts of the remaining
    bits, which gives longer keys, ``depth`` times over. Groups that are crowded still hold near
    copies of few texts; they are compared in blocks, and each block sends a star of every set it
    finds connected, so the edges stay in proportion to the fingerprints. All other edges are links.
    """
    searched = plan(prints, max_distance)
    own = [F.struct(F.lit(f"{i}").alias("path"), project(F.col("fp"), bits).alias("v"), F.lit(False).alias("probe")) for i, (bits, _) in enumerate(searched)]
    flipped = [
        F.struct(F.lit(f"{i}").alias("path"), project(F.col("fp"), bits).bitwiseXOR(F.lit(mask).cast("bigint")).alias("v"), F.lit(True).alias("probe"))
        for i, (bits, t) in enumerate(searched) for mask in _flips(len(bits), t)
    ]
    rows = prints.select("fp", F.explode(F.array(*own, *flipped)).alias("k")).select("fp", "k.*")
    unused = {f"{i}": [b for b in range(BITS) if b not in bits] for i, (bits, _) in enumerate(searched)}
    found = []
    for level in range(depth + 1):
        rows = cut_lineage(rows)
        sizes = rows.groupBy("path", "v").agg(F.count("*").alias("size"))
        crowded = rows.join(sizes.where(F.col("size") > block), ["path", "v"])
        near = rows.join(sizes.where((F.col("size") > 1) & (F.col("size") <= block)), ["path", "v"], "left_semi")
        left = near.where(~F.col("probe")).select("path", "v", F.col("fp").alias("a"))
        right = near.select("path", "v", F.col("fp").alias("b"), "probe")
        close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance
        pairs = left.join(right, ["path", "v"]).where(close & F.when(F.col("probe"), F.col("a") != F.col("b")).otherwise(F.col("a") < F.col("b")))
        found.append(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        if level == depth:
            found.append(_connect(crowded, max_distance, block))
            break
        if crowded.isEmpty():
            break
        longer, branches = {}, []
        for p, rest in unused.items():
            for j in range(max_distance + 1):
                part = rest[j :: max_distance + 1]
                longer[f"{p}.{j}"] = [b for b in rest if b not in part]
                branches.append(F.when(F.col("path") == p, F.struct(F.lit(f"{p}.{j}").alias("path"), F.xxhash64("v", project(F.col("fp"), part)).alias("v"))))
        rows = crowded.select("fp", "probe", F.explode(F.array(*branches)).alias("k")).where("k is not null").select("fp", "k.path", "k.v", "probe")
        unused = longer
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def connected_within(values: np.ndarray, max_distance: int) -> np.ndarray:
    """The smallest position of each value's connected set (links: at most ``max_distance`` bits)."""
    close = np.bitwise_count(values[:, None] ^ values[None, :]) <= max_distance
    label = np.arange(len(values))
    while True:
        new = np.where(close, label[None, :], len(values)).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _connect(crowded: DataFrame, max_distance: int, block: int) -> DataFrame:
    """Stars of the connected sets of every pair of blocks of a crowded group (path, v, size)."""
    half = max(1, block // 2)
    n = F.ceil(F.col("size") / half).cast("int")
    own = F.pmod(F.xxhash64("fp"), n).cast("int")
    rows = crowded.withColumn("own", own).withColumn("n", n)
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    rows = rows.select("path", "v", "fp", "own", other.alias("other"))
    rows = rows.select("path", "v", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")

    def connect(frame: pd.DataFrame) -> pd.DataFrame:
        values = np.unique(frame["fp"].to_numpy(np.int64))
        label = connected_within(values.view(np.uint64), max_distance)
        some = label != np.arange(len(values))
        return pd.DataFrame({"a": np.minimum(values[label[some]], values[some]), "b": np.maximum(values[label[some]], values[some])})

    return rows.groupBy("path", "v", "i", "j").applyInPandas(connect, "a bigint, b bigint")


def components(docs: DataFrame, shingle: int = 3, max_distance: int = 3) -> DataFrame:
    """One row per document row: doc_id, text_hash (64 bits), fp (bigint), group and component_id."""
    rows = cut_lineage(docs.select(
        F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), fingerprints(F.col("text"), shingle).alias("fp")
    ))
    classes = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    groups = connected_components(links(classes.select("fp"), max_distance))
    member = cut_lineage(
        classes.join(groups, classes["fp"] == groups["node"], "left").select("fp", "first_id", F.coalesce("component", "fp").alias("group"))
    )
    least = member.groupBy("group").agg(F.min("first_id").alias("component_id"))
    return rows.join(member.join(least, "group").select("fp", "group", "component_id"), "fp")


def report(docs: DataFrame, shingle: int = 3, max_distance: int = 3) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id."""
    return components(docs, shingle, max_distance).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = 3, max_distance: int = 3) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest doc_id (null counts as largest).

    Rows with the same doc_id are told apart by their text; of rows equal in both, one stays.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("_n"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("text_hash").alias("_h"))
    first = components(docs, shingle, max_distance).groupBy("group").agg(F.min(rank).alias("k")).select("k.*")
    keys = [F.col("doc_id").isNull().alias("_n"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h")]
    rows = docs.select(as_struct(docs), *keys).join(first, ["_n", "_id", "_h"], "left_semi")
    one = Window.partitionBy("_n", "_id", "_h").orderBy(F.lit(0))
    return rows.withColumn("_at", F.row_number().over(one)).where("_at = 1").select(f"{ROW}.*")
