"""Preference formatting: chosen and rejected conversations as one prompt and two masked completions.

``format_pairs`` takes pairs of turn lists, finds their longest common turn prefix, renders it once as
the prompt, and renders what is left of either side as its completion. A completion's mask gives for
every turn how many characters are not learned and how many are: of an assistant turn the text and its
end mark are learned, of any other turn nothing.

``swapped_pairs`` makes such pairs from a table of conversations: chosen is a conversation up to its
last assistant turn. Rejected leaves it at one of its assistant turns (of m such turns the one numbered
conv_id modulo m, from 0): it gives there the last answer of the next answered conversation (by conv_id
over the whole table; the last one takes the first) and ends. Turns after the last assistant turn are
no part of either side; they are kept as ``trailing``.

Defined cases: turns without conv_id or turn number belong to no conversation; a null text is empty
and a null role is ``none``; turns with the same number are ordered by role and text; conversations
without an assistant turn have status ``unanswered``, the whole as prompt and no completions; equal
sides have status ``identical`` and empty completions, a rejected side that only ends earlier has
status ``prefix`` and an empty completion; one answered conversation alone is its own partner; extra
columns are ignored. A conversation is one record of the result, so its turns are brought together as
the words of a document are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import ROWS_PER_CHUNK, with_chunk
from ..session import cut_lineage

END = "<|end|>\n"


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def render(turns: Column) -> Column:
    """Turns as text."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(END))), "")


def mask(turns: Column) -> Column:
    """"unlearned,learned" characters of every turn, joined by semicolons."""

    def runs(t):
        head, body = F.char_length(_head(t)), F.char_length(t["text"]) + len(END)
        own = t["role"] == "assistant"
        return F.concat_ws(",", F.when(own, head).otherwise(head + body).cast("string"), F.when(own, body).otherwise(0).cast("string"))

    return F.array_join(F.transform(turns, runs), ";")


def format_pairs(pairs: DataFrame) -> DataFrame:
    """Adds status, n_prompt, prompt, chosen, rejected and the masks in place of ``chosen_turns`` and
    ``rejected_turns`` (arrays of struct<role, text>, no nulls inside; both null: unanswered)."""
    c, r = F.col("chosen_turns"), F.col("rejected_turns")
    # the shorter side is padded with nulls, which no turn equals
    differs = F.array_position(F.zip_with(c, r, lambda x, y: x.eqNullSafe(y)), False).cast("bigint")
    n = F.when(differs > 0, differs - 1).otherwise(F.size(c).cast("bigint"))
    rows = pairs.withColumn("n_prompt", n)
    size = F.greatest(F.size(c), F.size(r))
    rest = lambda side: F.slice(side, F.col("n_prompt").cast("int") + 1, F.greatest(size, F.lit(1)))
    status = F.when(F.size(c) != F.size(r), "prefix").otherwise("pair")
    status = F.when((F.col("n_prompt") == F.size(c)) & (F.col("n_prompt") == F.size(r)), "identical").otherwise(
        F.when((F.col("n_prompt") < F.size(c)) & (F.col("n_prompt") < F.size(r)), "pair").otherwise(status))
    return rows.select(
        *[x for x in pairs.columns if x not in ("chosen_turns", "rejected_turns")],
        status.alias("status"), "n_prompt", render(F.slice(c, F.lit(1), F.col("n_prompt").cast("int"))).alias("prompt"),
        render(rest(c)).alias("chosen"), render(rest(r)).alias("rejected"), mask(rest(c)).alias("chosen_mask"), mask(rest(r)).alias("rejected_mask"),
    )


def next_ids(ids: DataFrame, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """(conv_id, partner_id): of each id of ``ids`` (conv_id, unique) the next larger one; the largest takes
    the smallest. The order is cut into chunks; only the first id of every chunk leaves it."""
    chunked, _ = with_chunk(ids.select("conv_id"), "conv_id", rows_per_chunk)
    inside = chunked.select("conv_id", "_chunk", F.lead("conv_id").over(Window.partitionBy("_chunk").orderBy("conv_id")).alias("_next"))
    # one row per chunk, at most MAX_CHUNKS of them
    firsts = chunked.groupBy("_chunk").agg(F.min("conv_id").alias("_first"))
    order = Window.partitionBy(F.lit(0)).orderBy("_chunk")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select("_chunk", F.coalesce(F.lead("_first").over(order), F.first("_first").over(whole)).alias("_after"))
    return inside.join(F.broadcast(after), "_chunk").select("conv_id", F.coalesce("_next", "_after").alias("partner_id"))


def swapped_pairs(turns: DataFrame, rows_per_chunk: int = ROWS_PER_CHUNK) -> tuple[DataFrame, DataFrame]:
    """(pairs, unanswered): see above; pairs have conv_id, partner_id, trailing, chosen_turns, rejected_turns."""
    turn = F.struct("turn", F.coalesce("role", F.lit("none")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = turns.where("conv_id is not null and turn is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    plain = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    # read by the ranking, the answers and the sides
    whole = cut_lineage(whole.select("conv_id", plain.alias("turns")))
    said = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i)["role"] == "assistant")
    cut = whole.withColumn("said", said)
    alone = cut.where(F.size("said") == 0).drop("said")
    cut = cut.where(F.size("said") > 0).select(
        "conv_id", "turns", F.element_at("said", -1).alias("n"),
        F.element_at("said", (F.pmod("conv_id", F.size("said").cast("bigint")) + 1).cast("int")).alias("branch"))
    # what travels to a neighbour is one answer, not the conversation
    answers = cut.select(F.col("conv_id").alias("partner_id"), F.element_at("turns", F.col("n"))["text"].alias("answer"))
    partners = next_ids(cut, rows_per_chunk).join(answers, "partner_id")
    both = cut.join(partners, "conv_id")
    swapped = F.concat(
        F.slice("turns", F.lit(1), F.col("branch") - 1),
        F.array(F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("text"))),
    )
    trailing = render(F.slice("turns", F.col("n") + 1, F.size("turns")))
    pairs = both.select(
        "conv_id", "partner_id", trailing.alias("trailing"), F.slice("turns", F.lit(1), F.col("n")).alias("chosen_turns"), swapped.alias("rejected_turns"))
    return pairs, alone


def report(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, partner_id, trailing, status, n_prompt, prompt, chosen, rejected, masks."""
    pairs, alone = swapped_pairs(turns)
    none = F.lit(None).cast("string")
    alone = alone.select(
        "conv_id", F.lit(None).cast("bigint").alias("partner_id"), F.lit("").alias("trailing"), F.lit("unanswered").alias("status"),
        F.size("turns").cast("bigint").alias("n_prompt"),
        render(F.col("turns")).alias("prompt"), *[none.alias(c) for c in ("chosen", "rejected", "chosen_mask", "rejected_mask")],
    )
    return format_pairs(pairs).unionByName(alone)


ORACLE = """
WITH t AS (
  SELECT conv_id, coalesce(role, 'none') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, 'none'), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
said AS (
  SELECT conv_id, i, text, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS m
  FROM t WHERE role = 'assistant' WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
answers AS (
  SELECT conv_id, i AS n, text, coalesce(lead(conv_id) OVER (ORDER BY conv_id), min(conv_id) OVER ()) AS partner_id
  FROM said WHERE k = m - 1),
pairs AS (
  SELECT s.conv_id, a.partner_id, a.n, s.i AS branch, x.text AS other, s.text = x.text AS same
  FROM said s JOIN answers a ON a.conv_id = s.conv_id JOIN answers x ON x.conv_id = a.partner_id
  WHERE s.k = (s.conv_id % s.m + s.m) % s.m),
sides AS (SELECT *, CASE WHEN same THEN branch ELSE branch - 1 END AS n_prompt FROM pairs),
drawn AS (
  SELECT conv_id, i, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS s,
         CASE WHEN role = 'assistant' THEN '14,' || (length(text) + 8) ELSE (length(role) + length(text) + 13) || ',0' END AS runs
  FROM t)
SELECT conv_id, any_value(partner_id) AS partner_id,
  CASE WHEN any_value(n) IS NULL THEN 'unanswered' WHEN NOT any_value(same) THEN 'pair' WHEN any_value(n = branch) THEN 'identical' ELSE 'prefix' END AS status,
  coalesce(any_value(n_prompt), count(*)) AS n_prompt,
  coalesce(string_agg(s, '' ORDER BY i) FILTER (i <= coalesce(n_prompt, i)), '') AS prompt,
  CASE WHEN any_value(n) IS NOT NULL THEN coalesce(string_agg(s, '' ORDER BY i) FILTER (i > n_prompt AND i <= n), '') END AS chosen,
  CASE WHEN any_value(same) THEN '' ELSE '<|assistant|>' || chr(10) || any_value(other) || '<|end|>' || chr(10) END AS rejected,
  CASE WHEN any_value(n) IS NOT NULL THEN coalesce(string_agg(runs, ';' ORDER BY i) FILTER (i > n_prompt AND i <= n), '') END AS chosen_mask,
  CASE WHEN any_value(same) THEN '' ELSE '14,' || (length(any_value(other)) + 8) END AS rejected_mask,
  coalesce(string_agg(s, '' ORDER BY i) FILTER (i > n), '') AS trailing
FROM drawn LEFT JOIN sides USING (conv_id) GROUP BY conv_id
"""
