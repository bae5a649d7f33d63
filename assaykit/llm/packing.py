"""Best-fit packing of tokenised documents into sequences, certified by lower bounds.

Every document becomes its token ids and a closing id, cut into pieces only if longer than a
sequence. Pieces are dealt to partitions and packed by best-fit decreasing. Dual-feasible functions
give each partition a lower bound on its number of bins; a partition that meets it is certified
optimal. The documents of partitions with a gap are dealt to new partitions together and packed
again, until no partition has a gap or a round saves nothing.

Defined cases: null and empty texts are one piece holding the closing id alone; equal texts and
repeated rows are packed as often as they occur; extra columns may have any name.
"""

from __future__ import annotations

import os
import string
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import batches, release_memory, worker_cache

#: Pieces of one packing partition; a bin of a partition is at most this much work.
PART_PIECES = 8_192
#: Distinct text chunks whose ids a Python worker remembers, in each of two generations.
CACHED = 200_000
#: Bytes of texts, about, that are encoded together.
BLOCK = 1 << 22
#: ASCII signs that the tokenizer keeps together and apart from letters before them.
_MARKS = string.punctuation.replace("'", "")


class WordEncoder:
    """Ids of whole texts from a tokenizer whose tokens never span white space.

    A text is cut at blanks and line ends, and each distinct chunk is encoded once. Chunks of letters
    only are encoded many at a time, cut at the tokens that end a word.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # for lower-case letters between blanks, of which normalizing and finding words leave nothing to do;
        # ASCII letters are their own byte-level signs
        self.latin, self.ascii = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)
        self.ascii.pre_tokenizer = split = pre_tokenizers.WhitespaceSplit()
        self.latin.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        del vocabulary
        release_memory()

    def _remember(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct ``chunks``, which become known. When too many are, they become the older
        generation, and what is met again is taken over from there."""
        own = list(map(self.known.get, chunks))
        new = [c for c, ids in zip(chunks, own, strict=True) if ids is None]
        if len(self.known) + 2 * len(new) > CACHED:
            self.older, self.known = self.known, {c: ids for c, ids in zip(chunks, own, strict=True) if ids is not None}
        get = self.older.get
        again = {c: ids for c in new if (ids := get(c)) is not None}
        self.known.update(again)
        self._learn(set(new).difference(again))
        get = self.known.__getitem__
        return [get(c) if ids is None else ids for c, ids in zip(chunks, own, strict=True)]

    def _learn(self, chunks: set[str]) -> None:
        # ids of a word do not depend on its case; up to here in Unicode both sides agree on what lower case is
        plain, other = list(chunks), []
        text = "\n".join(plain)
        if text and max(text) >= "\u0250":
            other = [c for c in plain if max(c, default="") >= "\u0250"]
            plain = list(chunks.difference(other))
            text = "\n".join(plain)
        low = text.lower().split("\n") if plain else []
        stems = [c.rstrip(_MARKS) for c in low]
        alone = list(map(str.isalpha, stems))
        words = set(compress(stems, alone)).difference(self.known)
        plain_words = set(compress(words, map(str.isascii, words)))
        rest = {c for c in other if not c.isalpha()}
        for some, tokenizer in ((plain_words, self.ascii), (words - plain_words, self.latin), (set(other) - rest, self.tokenizer)):
            rest |= self._words(some, tokenizer)
        other = rest
        other.update(c for c, is_word in zip(plain, alone, strict=True) if not is_word)
        known = self.known
        other.update({c[len(s) :] for c, s, is_word in zip(low, stems, alone, strict=True) if is_word and s is not c}.difference(known))
        for block in batches(other, 1024):
            for chunk, e in zip(block, self.tokenizer.encode_batch_fast(block, add_special_tokens=False), strict=True):
                known[chunk] = np.array(e.ids, np.uint32).tobytes()
        for chunk, stem, low_, is_word in zip(plain, stems, low, alone, strict=True):
            if is_word:
                known[chunk] = known[stem] if stem is low_ else known[stem] + known[low_[len(stem) :]]

    def _words(self, words: set[str], tokenizer) -> set[str]:
        """Makes words of letters known, many at a time; returns those that must be encoded by themselves."""
        left: set[str] = set()
        every = list(words)
        for at in range(0, len(every), 4096):
            block = every[at : at + 4096]
            ids = np.array(tokenizer.encode_batch_fast([" ".join(block)], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(block):
                raw, cuts = ids.tobytes(), (cuts * 4).tolist()
                self.known.update(zip(block, [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)], strict=True))
            else:  # a character that the tokenizer does not take as a letter
                left.update(block)
        return left

    def __call__(self, texts: pa.Array | list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null is the empty text."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // BLOCK
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield from self._block(texts.slice(a, b - a))

    def _block(self, texts: pa.Array) -> Iterator[bytes]:
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        own = self._remember(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, own), np.int64, len(own)) // 4
        ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(np.frombuffer(b"".join(own), np.uint32)))
        number = coded.indices.to_numpy()
        # ids before each chunk, and so before each text
        before = np.concatenate([[0], np.cumsum(size[number])])[np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])]
        raw = ids.take(coded.indices).flatten().to_numpy()
        for a, b in zip(before.tolist(), before[1:].tolist(), strict=False):
            yield raw[a:b].tobytes()


def encoder(path: str) -> WordEncoder:
    """The encoder of a vocabulary file, loaded once in each Python worker."""
    held = worker_cache(f"packing {path}")
    if path not in held:
        held[path] = WordEncoder(path)
    return held[path]


PIECES = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint,ids:array<int>>>"


def pieces(texts, vocabulary: str, capacity: int, end_id: int = 0, with_ids: bool = False):
    """Column of the pieces of each text."""
    kind = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    @F.arrow_udf(PIECES)
    def cut(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode, end, step = encoder(vocabulary), np.array([end_id], np.uint32).tobytes(), 4 * capacity
        for part in parts:
            out = []
            for ids in encode(part):
                ids += end
                out.append([
                    {"piece": k, "start": at // 4, "length": len(p := ids[at : at + step]) // 4, "ids_crc32": zlib.crc32(p),
                     "ids": np.frombuffer(p, np.int32).tolist() if with_ids else None}
                    for k, at in enumerate(range(0, len(ids), step))
                ])
            yield pa.array(out, kind)

    return cut(texts)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Fewest bins that hold the lengths, as far as dual-feasible functions can tell.

    u(k): x -> x if (k+1) x is a multiple of the capacity, else floor((k+1) x / C) C / k, and
    f(l): sizes over C - l count as whole bins and sizes under l as nothing.
    """
    sizes, counts = np.unique(np.asarray(lengths, np.int64), return_counts=True)
    if not len(sizes):
        return 0
    bound = -(-int((sizes * counts).sum()) // capacity)
    for k in range(1, 21):
        scaled = (k + 1) * sizes
        # in units of capacity / k, so that the sum stays whole
        value = np.where(scaled % capacity == 0, sizes * k, (scaled // capacity) * capacity)
        bound = max(bound, -(-int((value * counts).sum()) // (capacity * k)))
    total, number = np.cumsum(sizes * counts), np.cumsum(counts)
    for i in np.flatnonzero(sizes <= capacity // 2):
        least = int(sizes[i])
        j = int(np.searchsorted(sizes, capacity - least, "right"))
        middle = int(total[j - 1] - (total[i - 1] if i else 0))
        bound = max(bound, int(number[-1] - number[j - 1]) + -(-middle // capacity))
    return bound


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin, offset in it) of each length; bins are 0, 1, ..."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[int] = []  # distinct free sizes, sorted
    open_bins: dict[int, list[int]] = {}
    used = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        at = bisect_left(room, size)
        if at < len(room):
            free = room[at]
            holders = open_bins[free]
            b = holders.pop()
            if not holders:
                del room[at], open_bins[free]
        else:
            free, b = capacity, used
            used += 1
        bins[i], offsets[i] = b, capacity - free
        free -= size
        if free:
            if free in open_bins:
                open_bins[free].append(b)
            else:
                open_bins[free] = [b]
                insort(room, free)
    return bins, offsets


PACKED = "key string, length bigint, part bigint, bin bigint, offset bigint, bins bigint, bound bigint"


def _pack_partition(capacity: int):
    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("key", kind="stable")
        lengths = frame["length"].to_numpy(np.int64)
        bins, offsets = best_fit(lengths, capacity)
        return frame[["key", "length", "part"]].assign(bin=bins, offset=offsets, bins=int(bins.max()) + 1, bound=lower_bound(lengths, capacity))

    return pack


def assign(loose: DataFrame, capacity: int, part_pieces: int = PART_PIECES, max_rounds: int = 4) -> DataFrame:
    """(key, round, part, bin, offset) of pieces ``loose(key, length)`` shorter than a sequence.

    Each round deals its pieces to partitions by a hash of the key and the round. Partitions whose
    bin count equals their lower bound are final. In the others, bins that are full are final too;
    the documents of the rest are exchanged and packed again in the next round. The last round keeps
    what it has.
    """
    done, rest, before = [], loose.select("key", "length"), None
    for n in range(max_rounds):
        count = rest.count() if before is None else before
        if not count:
            break
        n_parts = -(-count // part_pieces)
        dealt = rest.withColumn("part", F.pmod(F.xxhash64("key", F.lit(n)), F.lit(n_parts)))
        packed = cut_lineage(dealt.groupBy("part").applyInPandas(_pack_partition(capacity), PACKED))
        result = packed.select("key", F.lit(n).alias("round"), "part", "bin", "offset", "length", "bins", "bound")
        if n_parts == 1 or n == max_rounds - 1:
            done.append(result)
            break
        fill = packed.groupBy("part", "bin").agg(F.sum("length").alias("fill"))
        loosely = packed.where("bins > bound").select("key", "length", "part", "bin").join(fill.where(F.col("fill") < capacity), ["part", "bin"])
        loosely = cut_lineage(loosely.select("key", "length", "part", "bin"))
        after = loosely.count()
        again = loosely.select("part", "bin").distinct()
        done.append(result.join(again, ["part", "bin"], "left_anti"))
        rest, before = loosely.select("key", "length"), after
    out = None
    for part in done:
        part = part.select("key", "round", "part", "bin", "offset")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = loose.select("key", F.lit(0).alias("round"), F.lit(0).cast("bigint").alias("part"), F.lit(0).cast("bigint").alias("bin"), F.lit(0).cast("bigint").alias("offset")).where("false")
    return out


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Pieces as long as a sequence are sequences of their own.
    """
    cut = docs.select("doc_id", pieces(F.col("text"), vocabulary, capacity, end_id, with_ids).alias("all"))
    # each row gets an id when it is written; it is read back from there and so never changes
    rows = cut_lineage(cut.withColumn("row", F.monotonically_increasing_id()))
    each = rows.select("doc_id", "row", F.explode("all").alias("p")).select("doc_id", "p.*", F.concat_ws("-", "row", "p.piece").alias("key"))
    each = each.withColumn("whole", -1 - F.monotonically_increasing_id())
    loose = each.where(F.col("length") < capacity).select("key", "length")
    # a partition has far fewer than 2^20 bins
    number = F.shiftleft(F.col("round").cast("bigint"), 58).bitwiseOR(F.shiftleft("part", 20)).bitwiseOR(F.col("bin"))
    placed = assign(loose, capacity).select("key", number.alias("number"), "offset")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("number", "whole").alias("sequence_id"), F.coalesce("offset", F.lit(0)).cast("bigint").alias("offset")]
    return each.join(placed, "key", "left").select(*columns, *(["ids"] if with_ids else []))
