"""Trie of conversation prefixes by van Emde Boas recursion.

A node is a distinct sequence of first turns. Sequences are cut at half depth: what stands above the
cut makes the upper trie, what stands below makes one lower forest per distinct prefix at the cut, and
both are cut at half depth again. All subproblems of a level are worked on together:

* *Digests*, from single turns upward: a block of 2w turns is the pair of its halves (a Merkle tree of
  SHA-256 digests), so equal blocks have equal digests and no others do.
* *Names*, from the deepest cut downward: the prefix at a cut is known by the name of the prefix at the
  enclosing cut and the digest of the block between the two; its name is its smallest member. A depth
  is cut at one level only (that of its lowest set bit), so all levels together name each turn once.
* *Totals*, from the smallest blocks upward: the totals of the trees of a lower forest are summed at
  the prefix they hang from, and grafted on that prefix and its ancestors inside the upper trie.

No task needs a whole conversation or a whole node: rows are (conversation, depth), groups are
pre-aggregated, each level is written to the shared folder. Only the digest over a node's ending
members is sequential by its definition: members come to it as texts of up to 4,096 ids, in order, and
stream through a hash state.

Defined cases: rows without conv_id belong to no conversation; null roles and texts are empty; turns are
ordered by number, null first, and equal numbers by the digest of role and text; repeated rows are turns
like any other; a conversation without turns of its own is a member of the root only; an empty table has
no node; extra columns are ignored and may have any name.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import CRC_TABLE, crc_sql

#: Consecutive turn numbers ordered together, and ids hashed as one text.
TURNS, IDS = 4096, 4096
#: Rule of rebuilt conversations: groups of ids, and first turns taken over (fewer than ``TAKEN``).
GROUP, TAKEN = 100, 6


def _digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, length) of each turn; depth counts from 1, length is in code points.

    A conversation of any length is ordered in pieces of ``TURNS`` turn numbers.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("double").alias("turn"),
        F.floor(F.col("turn").cast("double") / TURNS).alias("piece"),
        _digest(F.octet_length(role).cast("string"), F.lit(":"), role, text).alias("digest"), F.char_length(text).cast("bigint").alias("length"),
    )
    turns = cut_lineage(turns)
    before = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = turns.groupBy("conv_id", "piece").agg(F.count("*").alias("n"))
    pieces = pieces.select("conv_id", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("upto"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "piece").orderBy("turn", "digest"))
    placed = turns.withColumn("at", inside).alias("t").join(
        pieces.alias("p"), (F.col("t.conv_id") == F.col("p.conv_id")) & F.col("t.piece").eqNullSafe(F.col("p.piece")))
    return placed.select("t.conv_id", (F.col("upto") + F.col("at")).alias("depth"), "digest", "length")


def rebuilt(turns: DataFrame, group: int = GROUP, taken: int = TAKEN) -> tuple[DataFrame, DataFrame]:
    """(turns, members) after each conversation c has taken over the first turns of another.

    h = crc32(decimal c) mod ``taken`` first turns come from conversation c - c mod ``group``; c's own
    turns after its first h follow. ``members`` holds (conv_id, depth) of every conversation, the
    turnless at depth 0.
    """
    head = turns.where((F.col("depth") < taken) & (F.col("conv_id") % group == 0))
    # fewer than ``taken`` turns of a conversation
    head = head.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "digest", "length"))).alias("head"))
    convs = turns.groupBy("conv_id").agg(F.max("depth").alias("own")).select(
        "conv_id", "own", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % taken).cast("int").alias("h"))
    convs = convs.join(head.withColumnRenamed("conv_id", "base"), "base", "left")
    first = F.when((F.col("h") > 0) & F.col("head").isNotNull(), F.slice("head", 1, F.greatest(F.col("h"), F.lit(1)))).otherwise(F.slice("head", 1, 0))
    convs = cut_lineage(convs.select("conv_id", "own", "h", F.coalesce(first, F.expr("slice(array(struct(0L as depth, unhex('') as digest, 0L as length)), 1, 0)")).alias("first")))
    taken_over = convs.select("conv_id", F.explode("first").alias("f")).select("conv_id", "f.depth", "f.digest", "f.length")
    kept = turns.join(convs.select("conv_id", "h", F.size("first").alias("k")), "conv_id").where("depth > h")
    kept = kept.select("conv_id", (F.col("depth") - F.col("h") + F.col("k")).alias("depth"), "digest", "length")
    members = convs.select("conv_id", (F.size("first") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).cast("bigint").alias("depth"))
    return cut_lineage(taken_over.unionByName(kept)), members


def _blocks(turns: DataFrame, levels: int) -> list[DataFrame]:
    """Per level j: (conv_id, k, digest, length) of the full blocks of 2^j turns; block k ends at depth
    (k + 1) 2^j, length is that of its last turn."""
    out = [turns.select("conv_id", (F.col("depth") - 1).alias("k"), "digest", "length")]
    for _ in range(1, levels):
        half = F.col("k") % 2
        pairs = out[-1].groupBy("conv_id", F.shiftright("k", 1).alias("pair")).agg(
            F.max(F.when(half == 0, F.col("digest"))).alias("a"), F.max(F.when(half == 1, F.col("digest"))).alias("b"),
            F.max(F.when(half == 1, F.col("length"))).alias("length"))
        pairs = pairs.where("a is not null and b is not null")
        out.append(cut_lineage(pairs.select("conv_id", F.col("pair").alias("k"), _digest("a", "b").alias("digest"), "length")))
    return out


def _names(turns: DataFrame, levels: int, root: int) -> tuple[DataFrame, DataFrame]:
    """(names, nodes): the name of each conversation's prefix at each depth, and per node
    (name, depth, n_convs, length)."""
    blocks, names = _blocks(turns, levels), []
    for j in reversed(range(levels)):
        cuts = blocks[j].where("k % 2 = 0").withColumn("above", F.shiftleft("k", j))
        top = cuts.where("above = 0").withColumn("parent", F.lit(root).cast("bigint"))
        if names:
            known = reduce(DataFrame.unionByName, names).select("conv_id", F.col("depth").alias("above"), F.col("name").alias("parent"))
            top = top.unionByName(cuts.where("above > 0").join(known, ["conv_id", "above"]))
        cuts = top.select("conv_id", (F.col("above") + (1 << j)).alias("depth"), "parent", "digest", "length")
        key = ["depth", "parent", "digest"]
        found = cuts.groupBy(*key).agg(F.min("conv_id").alias("name"))
        names.append(cut_lineage(cuts.join(found, key).select("conv_id", "depth", "name", "length")))
    names = reduce(DataFrame.unionByName, names)
    # equal prefixes end in equal turns, so any member tells the length of the last one
    return names.drop("length"), names.groupBy("name", "depth").agg(F.count("*").alias("n_convs"), F.max("length").alias("length"))


SUMS = ("n_leaves", "saved_tokens")


def _grafted(nodes: DataFrame, names: DataFrame, levels: int) -> DataFrame:
    """(name, depth, n_leaves, saved_tokens) over whole subtrees, from nodes with their own values."""
    sums = [F.sum(c).alias(c) for c in SUMS]
    parts = [nodes.select("name", "depth", "parent", *SUMS)]
    for j in range(levels):
        width = 1 << j
        # roots of lower trees: their totals inside blocks of this width are complete
        hung = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        hung = hung.where(F.col("depth") % (2 * width) == (width + 1) % (2 * width)).where(F.col("depth") > width)
        hung = hung.groupBy("name", "depth").agg(F.max("parent").alias("parent"), *sums)
        hung = hung.groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("cut")).agg(*sums)
        if j:
            up = hung.select("conv_id", F.explode(F.sequence(F.col("cut") - (width - 1), F.col("cut"))).alias("depth"), *SUMS)
            up = up.join(names, ["conv_id", "depth"]).groupBy("name", "depth").agg(*sums)
        else:
            up = hung.select(F.col("conv_id").alias("name"), F.col("cut").alias("depth"), *SUMS)
        parts.append(cut_lineage(up))
    parts[0] = parts[0].drop("parent")
    return reduce(DataFrame.unionByName, parts).groupBy("name", "depth").agg(*sums)


def _ends(members: DataFrame, names: DataFrame, root: int) -> DataFrame:
    """(name, depth, ends_sha256) of the nodes at which conversations end."""
    at = members.where("depth > 0").join(names, ["conv_id", "depth"])
    at = at.unionByName(members.where("depth = 0").withColumn("name", F.lit(root).cast("bigint")))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    texts = at.groupBy("name", "depth", F.floor(F.col("conv_id") / IDS).alias("piece")).agg(ids.alias("ids"))

    def hashed(parts):
        key, state, out = None, None, []
        for part in parts:
            for name, depth, ids in zip(*(part.column(c).to_pylist() for c in ("name", "depth", "ids")), strict=True):
                if (name, depth) != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = (name, depth), hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            yield _rows(out)
            out = []
        if key is not None:
            yield _rows([(*key, state.hexdigest())])

    def _rows(out):
        names_, depths, shas = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_pydict({"name": pa.array(names_, pa.int64()), "depth": pa.array(depths, pa.int64()), "ends_sha256": pa.array(shas, pa.string())})

    ordered = texts.repartition("name", "depth").sortWithinPartitions("name", "depth", "piece")
    return ordered.mapInArrow(hashed, "name bigint, depth bigint, ends_sha256 string")


def trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """The nodes of ``turns(conv_id, depth, digest, length)`` of ``members(conv_id, depth)``.

    Per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.
    """
    found = members.agg(F.min("conv_id"), F.max("depth"), F.count("*")).first()
    root, deepest, n = found
    levels = int(deepest or 0).bit_length()
    spark = members.sparkSession
    none = hashlib.sha256(b"").hexdigest()
    top = spark.range(1 if n else 0).select(F.lit(root).cast("bigint").alias("name"), F.lit(0).cast("bigint").alias("depth"), F.lit(n).cast("bigint").alias("n_convs"))
    if not levels:
        return top.join(_ends(members, turns.select("conv_id", "depth", F.col("conv_id").alias("name")), root or 0), ["name", "depth"], "left").select(
            F.col("name").alias("conv_id"), "depth", F.lit(None).cast("bigint").alias("parent_conv_id"), "n_convs", F.lit(0).cast("bigint").alias("n_children"),
            F.lit(1).cast("bigint").alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
    names, nodes = _names(turns, levels, root)
    # a node's parent is what its smallest member is called one turn earlier
    above = names.select(F.col("conv_id").alias("name"), (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    nodes = nodes.where("depth > 1").join(above, ["name", "depth"]).unionByName(nodes.where("depth = 1").withColumn("parent", F.lit(root).cast("bigint")))
    nodes = cut_lineage(nodes)
    children = nodes.groupBy(F.col("parent").alias("name"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["name", "depth"], "left").fillna(0, ["n_children"])
    nodes = cut_lineage(nodes.withColumns({
        "n_leaves": (F.col("n_children") == 0).cast("bigint"), "saved_tokens": (F.col("n_convs") - 1) * F.col("length")}))
    totals = cut_lineage(_grafted(nodes, names, levels))
    shown = nodes.select("name", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children").join(totals, ["name", "depth"])
    whole = totals.where("depth = 1").agg(F.count("*").alias("n_children"), *[F.sum(c).alias(c) for c in SUMS])
    shown = shown.unionByName(top.withColumn("parent_conv_id", F.lit(None).cast("bigint")).crossJoin(F.broadcast(whole)))  # one row and one row
    shown = shown.join(_ends(members, names, root), ["name", "depth"], "left")
    return shown.select(
        F.col("name").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def report(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations."""
    turns, members = rebuilt(cut_lineage(sequences(conversations)))
    return trie(turns, members)


ORACLE = f"""
WITH k AS ({CRC_TABLE}),
u AS (SELECT conv_id, turn, coalesce(text, '') AS text, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, list({{'g': g, 'n': length(text)}} ORDER BY turn NULLS FIRST, g) AS q FROM u GROUP BY conv_id),
h AS (SELECT conv_id, q, {crc_sql("conv_id::VARCHAR")} % 6 AS h FROM s, k),
r AS (SELECT a.conv_id AS c, coalesce(b.q[1:a.h], []) || a.q[a.h + 1:] AS q FROM h a LEFT JOIN h b ON b.conv_id = a.conv_id - a.conv_id % 100),
x AS (SELECT c, d, q[1:d] AS p, len(q) = d AS is_end FROM (SELECT c, q, unnest(range(0, len(q) + 1)) AS d FROM r)),
n AS (SELECT d, p, min(c) AS c, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (is_end), '') AS ends FROM x GROUP BY d, p),
m AS (SELECT n.*, o.c AS parent, coalesce(j.n_children, 0) AS n_children FROM n
  LEFT JOIN n o ON o.d = n.d - 1 AND o.p = n.p[1:n.d - 1]
  LEFT JOIN (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL) j ON j.d = n.d AND j.p = n.p),
t AS (SELECT e, p[1:e] AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum(CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * p[d].n END) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM m) GROUP BY ALL)
SELECT m.c AS conv_id, m.d::BIGINT AS depth, m.parent AS parent_conv_id, m.n_convs, m.n_children::BIGINT AS n_children, t.n_leaves, t.saved::BIGINT AS saved_tokens,
  sha256(m.ends) AS ends_sha256
FROM m JOIN t ON t.e = m.d AND t.p = m.p
"""
