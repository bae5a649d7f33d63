"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Words are runs of ASCII digits, ASCII letters (lower-cased) and any non-ASCII characters. The items
of a block form one generalised suffix automaton over words. A document's words are streamed through
it once; the automaton's state and match length say at every word how long the longest item passage
ending there is, so every item window is found in time linear in the text.

Defined cases: null and empty texts have no words and are clean; an item without words is ignored;
an item shorter than the window counts as one window; repeated items and items equal in text are each
reported; repeated document rows are each judged alone; extra columns are kept and may have any name.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import ROW, as_struct, worker_cache

#: Item words held by one automaton. More items are streamed against in further passes.
BLOCK_WORDS = 200_000

_KEPT = set(b"0123456789abcdefghijklmnopqrstuvwxyz")
_TABLE = bytes(
    b if b >= 0x80 or b in _KEPT else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


class Automaton:
    """Generalised suffix automaton of word sequences with, per state, the items it stands for."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends = []
        for _, item in items:
            last = 0
            for word in item:
                last = self._extend(last, word)
            ends.append(last)
        # items with an occurring window: states whose strings include one of `window` words
        self.names: list[str] = [name for name, _ in items]
        self.holders: list[set[int]] = [set() for _ in self.next]
        self.short: list[tuple[tuple[int, int], ...]] = [() for _ in self.next]
        for n, (_, item) in enumerate(items):
            state = 0
            for word in item:
                state = self.next[state][word]
                up = state
                while self.length[up] >= window and n not in self.holders[up]:
                    self.holders[up].add(n)
                    up = self.link[up]
        whole: dict[int, list[tuple[int, int]]] = {}
        for n, (_, item) in enumerate(items):
            if len(item) < window:
                whole.setdefault(ends[n], []).append((len(item), n))
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.short[state] = self.short[self.link[state]] + tuple(whole.get(state, ()))
        # the state of a match's last `window` words
        self.base = list(range(len(self.next)))
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            if self.length[self.link[state]] >= window:
                self.base[state] = self.base[self.link[state]]
        self.least = min([window, *(len(item) for _, item in items)])

    def _add(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, state: int, word: bytes, target: int) -> int:
        copy = self._add(self.length[state] + 1)
        self.next[copy] = dict(self.next[target])
        self.link[copy] = self.link[target]
        self.link[target] = copy
        while state != -1 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        target = self.next[last].get(word)
        if target is not None:
            return target if self.length[target] == self.length[last] + 1 else self._split(last, word, target)
        new = self._add(self.length[last] + 1)
        state = last
        while state != -1 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state != -1:
            target = self.next[state][word]
            self.link[new] = target if self.length[target] == self.length[state] + 1 else self._split(state, word, target)
        return new

    def scan(self, text: list[bytes]) -> tuple[list[tuple[int, int]], int, set[str]]:
        """Hit word ranges (joined, in order), the longest match, and the names of occurring items."""
        state, length, longest = 0, 0, 0
        after, up, lengths, least, window = self.next, self.link, self.length, self.least, self.window
        spans: list[list[int]] = []
        found: set[int] = set()
        root = after[0]
        for i, word in enumerate(text):
            target = after[state].get(word)
            if target is None:
                if not state:
                    continue
                if word not in root:
                    state = length = 0
                    continue
                while target is None:
                    state = up[state]
                    target = after[state].get(word)
                length = lengths[state]
            state = target
            length += 1
            if length < least:
                continue
            reach = 0
            if length >= window:
                reach = length
                found |= self.holders[self.base[state]]
            for size, n in self.short[state]:
                if size <= length:
                    reach = max(reach, size)
                    found.add(n)
            if reach:
                longest = max(longest, reach)
                start = i + 1 - reach
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, i + 1])
        return [(a, b) for a, b in spans], longest, {self.names[n] for n in found}


def _automaton(token: str, items: list[tuple[str, str]], window: int) -> Automaton:
    """The automaton of a block, built once in each Python worker."""
    held = worker_cache(f"decontaminate {token}")
    if window not in held:
        held[window] = Automaton([(name, w) for name, text in items if (w := words(text))], window)
    return held[window]


SCAN = "struct<n_words:bigint,longest:bigint,spans:array<struct<a:bigint,b:bigint>>,items:array<string>>"
SCAN_AND_CUT = SCAN[:-1] + ",text:string>"


def _scanner(token: str, shared, window: int, least: int | None = None):
    """Scans of texts; with ``least`` given, the text without its spans of so many words is found in the
    same pass, null where there is none to cut.

    Called non-deterministic so that Spark scans each text once: a filter on a scan would otherwise be
    pushed below it as a second scan, in a Python worker of its own.
    """
    fields = [
        ("n_words", pa.int64()), ("longest", pa.int64()),
        ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("items", pa.list_(pa.string())),
    ]

    def scan(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        auto = _automaton(token, shared.value, window)
        for part in parts:
            out = []
            for text in part.to_pylist():
                ws = words(text) if text else []
                spans, longest, names = auto.scan(ws)
                row = {"n_words": len(ws), "longest": longest, "spans": [{"a": a, "b": b} for a, b in spans], "items": sorted(names)}
                if least is not None:
                    spans = [(a, b) for a, b in spans if b - a >= least]
                    row["text"] = cut_spans(text, spans) if spans else None
                out.append(row)
            yield pa.array(out, pa.struct(fields if least is None else [*fields, ("text", pa.string())]))

    return F.arrow_udf(scan, SCAN if least is None else SCAN_AND_CUT).asNondeterministic()


def _union(left: list[dict], right: list[dict]) -> list[dict]:
    out: list[dict] = []
    for span in sorted(left + right, key=lambda s: s["a"]):
        if out and span["a"] <= out[-1]["b"]:
            out[-1]["b"] = max(out[-1]["b"], span["b"])
        else:
            out.append(dict(span))
    return out


def _merge(left, right):
    @F.arrow_udf(SCAN)
    def merge(left: pa.Array, right: pa.Array) -> pa.Array:
        out = [
            {"n_words": x["n_words"], "longest": max(x["longest"], y["longest"]), "spans": _union(x["spans"], y["spans"]), "items": sorted({*x["items"], *y["items"]})}
            for x, y in zip(left.to_pylist(), right.to_pylist(), strict=True)
        ]
        return pa.array(out, left.type)

    return merge(left, right)


def mark(docs: DataFrame, items: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS, least: int | None = None) -> DataFrame:
    """``docs`` as struct column ``_whole_row`` with column ``scan``: n_words, longest, spans, items.

    With ``least`` given there is a column ``new`` too, the text without its spans of at least so many words.

    ``items`` has item_id and text. Spans are half-open word ranges, sorted and disjoint. What is
    broadcast is bounded: at most ``block_words`` item words (or one longer item) at a time. With
    more item words the documents are streamed through one automaton after another, and the spans
    of a row are joined.
    """
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    # a word takes two bytes or more with its separator, so this bounds the words from above
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // (2 * block_words)))
    rows = docs.select(as_struct(docs), F.lit(None).cast(SCAN).alias("scan"))
    for block in range(n_blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).collect()
        shared = spark.sparkContext.broadcast([(r["item_id"] or "", r["text"]) for r in part])
        scan = _scanner(uuid.uuid4().hex, shared, window, least if n_blocks == 1 else None)
        if n_blocks == 1:
            rows = rows.withColumn("scan", scan(F.col(f"{ROW}.text")))
            if least is not None:
                rows = rows.withColumn("new", F.coalesce("scan.text", f"{ROW}.text"))
        else:
            rows = rows.withColumn("new", scan(F.col(f"{ROW}.text")))
            rows = rows.withColumn("scan", F.col("new") if block == 0 else _merge("scan", "new")).drop("new")
            rows = cut_lineage(rows)
    if n_blocks > 1 and least is not None:
        rows = rows.withColumn("new", _cut(F.col(f"{ROW}.text"), F.col("scan"), least))
    return rows


def report(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = F.aggregate("scan.spans", F.lit(0).cast("bigint"), lambda s, x: s + x["b"] - x["a"])
    return (
        mark(docs, items, window)
        .select(F.col(f"{ROW}.doc_id").alias("doc_id"), "scan")
        .select(
            "doc_id", F.col("scan.n_words").alias("n_words"), hit.alias("n_hit"),
            F.size("scan.items").cast("bigint").alias("n_items"),
            F.sha2(F.concat_ws(",", "scan.items"), 256).alias("items_sha256"),
            (hit > 0).alias("contaminated"),
        )
    )


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans and the gap behind each of them."""
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw)]
    kept, upto = [], 0
    for a, b in spans:
        kept.append(raw[upto : at[a][0]])
        upto = at[b][0] if b < len(at) else len(raw)
    return b"".join([*kept, raw[upto:]]).decode()


def _cut(texts, scans, least: int):
    """Column of the texts without their spans of at least ``least`` words."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, scans: pa.Array) -> pa.Array:
        out = []
        for text, scan in zip(texts.to_pylist(), scans.to_pylist(), strict=True):
            spans = [(s["a"], s["b"]) for s in scan["spans"] if s["b"] - s["a"] >= least]
            out.append(cut_spans(text, spans) if spans else text)
        return pa.array(out, pa.string())

    return cut(texts, scans)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, max_span: int = 0, max_coverage: float = 0.5) -> DataFrame:
    """``docs`` without benchmark passages; columns unchanged.

    Spans longer than ``max_span`` words (every hit, by default) are cut out of ``text``; a document
    in which hits cover more than ``max_coverage`` of its words is dropped. An integer n_chars column
    is set to the length of the new text.
    """
    hit = F.aggregate("scan.spans", F.lit(0).cast("bigint"), lambda s, x: s + x["b"] - x["a"])
    rows = mark(docs, items, window, least=max_span + 1).where(hit <= F.lit(max_coverage) * F.col("scan.n_words"))
    types = dict(docs.dtypes)

    def column(name):
        if name == "text":
            return F.col("new").alias(name)
        old = F.col(f"{ROW}.`{name}`")
        if name == "n_chars" and types[name] in ("int", "bigint"):
            cut = F.exists("scan.spans", lambda s: s["b"] - s["a"] > max_span)
            return F.when(cut, F.char_length("new")).otherwise(old).cast(types[name]).alias(name)
        return old.alias(name)

    return rows.select(*[column(c) for c in docs.columns])
