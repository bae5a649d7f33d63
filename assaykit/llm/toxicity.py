"""Toxicity of texts after noisy-channel deobfuscation.

1. A character language model (trigrams) is counted over all documents.
2. Every word that could be disguised - with figures or signs among its letters, letters repeated, or
   letters set apart by blanks - is a lattice: each character may stand for itself, a sign for one of
   the letters it resembles, a repeated letter or a separator for nothing. Viterbi decoding finds the
   most likely original under the channel's probabilities and the language model. A word of plain
   letters without repeats has one path and is its own decoding. Any blank between words may stand
   for nothing as well, whatever their lengths and the quotes, brackets and stops around them; what
   that joins is added to the words as they stand.
3. The restored words are scored: how much more often than others a word, or its beginning, occurs in
   documents labelled toxic (a lower confidence bound of the log odds). A logistic regression over a
   few sums of these per document gives the score.

Labels are learned from a bounded sample of labelled rows (``fit_rows``); the language model and the
scores cover all documents and whole texts.

Defined cases: null and empty texts have no words and get the score of a text without evidence; labels
that are null or without a document are ignored; a document labelled more than once is toxic if any
of its labels says so; repeated rows are scored each; without labels of both kinds every score is the
share of toxic labels, or 0 if there are none; extra columns may have any name.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import ROW, as_struct, worker_cache

#: Labelled rows the lexicon and the regression learn from, and words a worker remembers.
FIT_ROWS, CACHED = 20_000, 120_000
THRESHOLD = 0.7

#: Letters of the model: a-z, the letters of Latin-1, any other letter; 0 is all that is no letter.
LETTERS = 2 + 26 + 31
#: What a sign or figure may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "#": "h", "%": "o",
}
SEPARATORS = ".-_*~'·, "
#: Log probabilities of the channel.
DISGUISED, REPEATED, SEPARATED, KEPT_SIGN = np.log(0.01), np.log(0.01), np.log(0.02), np.log(0.02)


def _code_table() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if chr(c).isalpha():
            table[c] = LETTERS - 1
    for k in range(26):
        table[ord("a") + k] = table[ord("A") + k] = 1 + k
    latin = [c for c in range(0xDF, 0x100) if c != 0xF7]
    for k, c in enumerate(latin[:31]):
        table[c] = 27 + k
    for k, c in enumerate(latin[:31]):
        if c != 0xDF:
            table[c - 32] = 27 + k
    return table


_TABLE: list[np.ndarray] = []


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def _codes_of(points: np.ndarray) -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_code_table())
    return _TABLE[0][points]


def codes(text: str) -> np.ndarray:
    return _codes_of(_points(text))


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of character trigrams over all texts, (LETTERS, LETTERS, LETTERS).

    Each task sends what it has counted, at most one row per trigram; the sums fit the alphabet.
    """
    blank = np.zeros(1, np.uint8)

    def blocks_of(texts, size=1 << 19):
        """Texts, long ones in parts, in lists of about ``size`` characters."""
        block, held = [], 0
        for text in texts:
            text = text.as_py() or ""
            for at in range(0, len(text), size):
                block.append(text[at : at + size])
                held += len(block[-1])
                if held >= size:
                    yield block
                    block, held = [], 0
        if block:
            yield block

    def count(parts):
        worker_cache("trigrams")  # frees what other operators keep
        total = np.zeros(LETTERS**3, np.int64)
        for part in parts:
            for block in blocks_of(part.column(0)):
                # each text stands between two blanks and one; trigrams across texts do not count
                c = np.concatenate([x for text in block for x in (blank, blank, codes(text), blank)]).astype(np.int64)
                k = (c[:-2] * LETTERS + c[1:-1]) * LETTERS + c[2:]
                ends = np.cumsum([len(text) + 3 for text in block])[:-1]
                total += np.bincount(np.delete(k, np.concatenate([ends - 2, ends - 1])), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"k": pa.array(some, pa.int64()), "n": pa.array(total[some])})

    out = np.zeros(LETTERS**3)
    for r in docs.select("text").mapInArrow(count, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[r["k"]] = r["n"]
    return out.reshape(LETTERS, LETTERS, LETTERS)


def language_model(counts: np.ndarray) -> np.ndarray:
    """log p(c | a, b), interpolated with the bigram and the plain distribution."""
    one = counts.sum((0, 1)) + 1.0
    one /= one.sum()
    pairs = counts.sum(0)
    two = (pairs + 20.0 * one) / (pairs.sum(1, keepdims=True) + 20.0)
    three = (counts + 10.0 * two) / (counts.sum(2, keepdims=True) + 10.0)
    return np.log(three)


_TWICE, _THRICE = re.compile(r"(.)\1"), re.compile(r"(.)\1\1")


class Decoder:
    """Viterbi decoding of words under the channel and the language model."""

    def __init__(self, model: np.ndarray):
        self.logp = model.astype(np.float64)
        self.code = {c: int(codes(c)[0]) for c in "abcdefghijklmnopqrstuvwxyz"}

    def options(self, chars: str, i: int) -> list[tuple[str, float]]:
        """(what the character stands for, log probability); "" for nothing, " " for no letter."""
        c = chars[i]
        if c.isalpha():
            out = [(c, 0.0)]
            if i and chars[i - 1] == c:
                out.append(("", REPEATED))
            return out
        out = [(" ", KEPT_SIGN)]
        out += [(x, DISGUISED - np.log(len(LOOKALIKES[c]))) for x in LOOKALIKES.get(c, "")]
        if c in SEPARATORS and 0 < i < len(chars) - 1:
            out.append(("", SEPARATED))
        return out

    def single_letters(self, word: str) -> str:
        """The most likely original of letters none of which stands three times in a row.

        A letter that stands twice has two paths, which differ in the factors around it only, and
        those do not depend on what becomes of other letters.
        """
        out, kept = "", 0
        for m in _TWICE.finditer(word):
            i = m.end()
            a, c = (self.letter(word[i - 3]) if i > 2 else 0), (self.letter(word[i]) if i < len(word) else 0)
            b = self.letter(word[i - 1])
            if REPEATED + self.logp[a, b, c] > self.logp[a, b, b] + self.logp[b, b, c]:
                out += word[kept : i - 1]
                kept = i
        return out + word[kept:] if kept else word

    def letter(self, c: str) -> int:
        k = self.code.get(c)
        if k is None:
            k = self.code[c] = int(codes(c)[0])
        return k

    def decode(self, chars: str, fixed: tuple[int, int] = (0, 0), mark: str = "") -> str:
        """The most likely original of lower-case ``chars``; blanks where no letter stands.

        So many characters as ``fixed`` says at either end stand for themselves; ``mark`` is left
        where a blank stands for nothing.
        """
        logp = self.logp
        if chars.isalpha() and not _THRICE.search(chars):
            return self.single_letters(chars)
        # paths by their last two letters: (log probability, letters so far as linked pairs)
        paths: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for i in range(len(chars)):
            grown: dict[tuple[int, int], tuple[float, tuple]] = {}
            inside = fixed[0] <= i < len(chars) - fixed[1]
            for x, cost in self.options(chars, i) if inside else [(chars[i], 0.0)]:
                k = None if x == "" else 0 if x == " " else self.letter(x)
                for (a, b), (p, said) in paths.items():
                    if x == "":
                        state, new = (a, b), (p + cost, (said, mark) if mark and chars[i] == " " else said)
                    else:
                        state, new = (b, k), (p + cost + logp[a, b, k], (said, x))
                    if state not in grown or new[0] > grown[state][0]:
                        grown[state] = new
            paths = grown
        best, said = max(((p + logp[a, b, 0], said) for (a, b), (p, said) in paths.items()), key=lambda x: x[0])
        out = []
        while said:
            said, x = said
            out.append(x)
        return "".join(reversed(out))


#: A word whose lattice has more than one path: a sign or figure beside a letter, or a letter twice.
_MIXED = re.compile(r"(?=.*[^\W\d_])(?:.*[\W\d_].*[^\W\d_]|.*[^\W\d_][\d@$!|+*#%€£(]|.*([^\W\d_])\1)", re.DOTALL)
_SIGNS_LAST = re.compile(r"([^\W\d_]{2,})([\W\d_]+)")
_EDGES = " \t\r\n.,;:?\"'()[]{}<>«»„“”-_/\\&="


#: Characters by what they are in a token: a letter, what the pattern of letters takes though Python
#: calls it none, or a sign that edges lose.
_LETTER, _ODD_LETTER, _EDGE = 1, 2, 3
_ANY_LETTER = re.compile(r"[^\W\d_]")
_KINDS: list[np.ndarray] = []


def _kinds(points: np.ndarray) -> np.ndarray:
    if not _KINDS:
        table = np.zeros(0x110000, np.uint8)
        for c in map(chr, range(0x110000)):
            if c.isalpha():
                table[ord(c)] = _LETTER
            elif _ANY_LETTER.match(c):
                table[ord(c)] = _ODD_LETTER
        for c in _EDGES.replace("(", "").strip():
            table[ord(c)] = _EDGE
        _KINDS.append(table)
    return _KINDS[0][points]


def _plain(tokens: list[str], drops: np.ndarray) -> tuple[np.ndarray, str, np.ndarray]:
    """Tokens that are, between edge signs, two letters or more none of which stands three times in a
    row: which tokens these are, their originals one after the other, and the lengths of the originals.

    ``drops[a, b, c]``: of a letter b that stands twice between a and c, one is likelier to be meant
    (see ``Decoder.single_letters``).
    """
    points = _points("\n" + "\n".join(tokens) + "\n")
    kind = _kinds(points)
    letter = (kind == _LETTER) | (kind == _ODD_LETTER)
    breaks = np.flatnonzero(points == 10)
    start, stop = breaks[:-1] + 1, breaks[1:]
    upto = lambda marks: np.concatenate([np.zeros(1, np.int32), np.cumsum(marks, dtype=np.int32)])
    held = lambda marks: (sums := upto(marks))[stop] - sums[start]
    n = held(letter)
    places, before = np.flatnonzero(letter), upto(letter)[start]
    some = np.flatnonzero((n >= 2) & (held(kind == _EDGE) + n == stop - start))
    first, last = places[before[some]], places[before[some] + n[some] - 1]
    some, first, last = (x[last - first + 1 == n[some]] for x in (some, first, last))
    double = letter & np.append(points[1:] == points[:-1], False)
    thrice = upto(double[:-1] & double[1:])
    twice, odd = upto(double), upto(kind == _ODD_LETTER)
    good = (thrice[last] == thrice[first]) & ((twice[last] == twice[first]) | (odd[last + 1] == odd[first]))
    some, first, last = some[good], first[good], last[good]
    kept = np.zeros(len(points) + 1, np.int8)
    kept[first] = 1
    kept[last + 1] -= 1
    kept = np.cumsum(kept[:-1], dtype=np.int8).astype(bool)
    at = np.flatnonzero(double & kept)
    kept[at[drops[_codes_of(points[at - 1]), _codes_of(points[at]), _codes_of(points[at + 2])]]] = False
    sums = upto(kept)
    return some, points[kept].tobytes().decode("utf-32-le"), sums[last + 1] - sums[first]


#: Left in a decoded text where a blank stands for nothing; pieces of a joined word at most.
_JOIN, _PIECES = "\x01", 24
_BRACKET = _EDGES.replace("(", "")


def _form(token: str, decoder: Decoder, decoded: dict[str, str]) -> tuple:
    """(words, last two letters, first two letters, further readings) of a token; ``decoded`` remembers.

    Letters are "" where the token has no letter at that end, and None for a token of one character
    or of edge signs only.
    """
    bare = token.strip(_EDGES)
    more: tuple[str, ...] = ()
    if "(" in token and bare and (other := token.strip(_BRACKET)) != bare:
        # a bracket at an end may stand for a letter
        more = tuple(decoder.decode(other).split())
    if len(bare) < 2:
        return (bare,) if bare else (), None, None, more
    if not bare.isalpha() and not _MIXED.match(bare) or bare.isalpha() and not _TWICE.search(bare):
        words = (bare,)
        if not bare.isalpha() and all(c in LOOKALIKES or c in SEPARATORS for c in bare) and (said := decoder.decode(bare)).isalpha():
            words, more = (said,), (*more, bare)
    elif (m := _SIGNS_LAST.fullmatch(bare)) and not _TWICE.search(m[1]):
        # letters with one path: what the signs stand for depends on the last two of them
        key = m[1][-2:] + m[2]
        if key not in decoded:
            decoded[key] = decoder.decode(key, (2, 0))
        words = tuple((m[1][:-2] + decoded[key]).split())
    else:
        words = tuple(decoder.decode(bare).split())
    if not words:
        return words, "", "", more
    tail, head = f" {words[-1]}"[-2:], f"{words[0]} "[:2]
    return words, tail if tail[1].isalpha() else "", head if head[0].isalpha() else "", more


def _between(tail: str, middle: str, head: str, decoder: Decoder) -> str:
    """What stands between two words: a blank, a mark, or the restored letters ``middle`` (one character
    and one blank in turn). A word of two letters or more leaves one state of the lattice, so this is
    the most likely path through the whole text."""
    left, right = f"{tail} " if tail else "", f" {head}" if head else ""
    chars = f"{left}{middle}{right}" if middle else f"{tail} {head}"
    said = decoder.decode(chars, (len(tail), len(head)), _JOIN)
    said = said[len(tail) : len(said) - len(head)]
    return f"{'' if tail else ' '}{said}{'' if head else ' '}"


def _joined(forms: list[tuple], tokens: list[str], decoder: Decoder, known: dict) -> Iterator[str]:
    """Words that a stretch of tokens holds if blanks stand for nothing."""
    text, tail, middle = [""], "", []
    for token, (words, end, head, _) in [*zip(tokens, forms, strict=True), ("", ((), "", "", ()))]:
        if end is None:
            middle.append(words[0] if words else token[0])
            continue
        key = (tail, " ".join(middle), head) if middle else (tail, head)
        gap = known.get(key)
        if gap is None:
            gap = known[key] = _between(*key, decoder) if middle else _JOIN if tail and head and _JOIN in _between(tail, "", head, decoder) else ""
        text.append(gap or " ")
        text.append(words[0] if len(words) == 1 else f"{words[0]} {words[-1]}" if words else "")
        tail, middle = end, []
    text = "".join(text)
    if _JOIN in text:
        for chain in text.split():
            if _JOIN in chain:
                # the word may begin at any piece: what stands before it may be joined wrongly
                pieces = [x for x in chain.split(_JOIN) if x]
                for i in range(max(1, len(pieces) - 1)):
                    yield "".join(pieces[i : i + _PIECES])


#: A token's end without a letter, and a token of one character.
_NO_LETTER, _ALONE = -1, -2
#: Words are hashed by their characters times powers of an odd number, modulo 2^64; a hash only tells
#: which joined words are worth spelling out.
_ODD = 0x9E3779B97F4A7C15
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)
_SLOTS = 21


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_PREFIX = [pow(_ODD, k, 1 << 64) for k in range(7)]


def _hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first 0 to 6 characters and of all, (words, 8), and lengths."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size) - size
    letters = np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(letters * _powers(_ODD, len(letters) + 1)[:-1])])
    ends = start[:, None] + np.minimum(np.array([0, 1, 2, 3, 4, 5, 6, 1 << 40]), size[:, None])
    return (sums[ends] - sums[start][:, None]) * _powers(_ODD_INVERSE, len(letters) + 1)[start][:, None], size


def _slot(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - _SLOTS)


class Reader:
    """The words of texts after deobfuscation, many texts at a time.

    Every token is decoded once and becomes a number; so does every word. Whether a blank between two
    words stands for nothing depends on two letters on either side, so it is looked up, for all blanks
    of the texts together, in a table of all four letters. With ``weights`` given, joined words are
    first looked up by hashes of their beginnings and of themselves, for all of them together, and only
    those that may have a weight are spelled out. Joined words seldom come again, so the next call drops
    them. What else is remembered is dropped when it holds ``CACHED`` tokens or twice as many words.
    """

    def __init__(self, decoder: Decoder, weights: dict[str, float] | None = None):
        self.decoder, self.weights = decoder, weights
        p = decoder.logp
        # [ab, cd]: "ab" "cd" read as one word is likelier than with a blank that is no letter between
        joins = np.empty((LETTERS, LETTERS, LETTERS, LETTERS), bool)
        for a in range(LETTERS):
            together = p[a][:, :, None] + p
            apart = p[a, :, 0][:, None, None] + p[:, 0, :][:, :, None] + p[0][None]
            joins[a] = SEPARATED + together > KEPT_SIGN + apart
        self.joins = joins.reshape(LETTERS**2, LETTERS**2)
        twice = np.einsum("abb->ab", p)[:, :, None] + np.einsum("bbc->bc", p)[None]
        self.drops = REPEATED + p > twice
        self.telling = np.zeros((2, 1 << _SLOTS), bool)
        for whole in (0, 1):
            features = [f[whole:] for f in weights or () if f.startswith("=") == whole]
            self.telling[whole, _slot(_hashes(features)[0][:, 7])] = True
        # a word with a weight begins like one of these
        self.openings = {f[k : k + 4] for f in weights or () for k in range(1 + f.startswith("="))}
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        # forms of tokens that are not one plain word
        self.special: dict[int, tuple] = {}
        self.gaps: dict[tuple, str] = {}
        self.words: dict[str, int] = {}
        self.names: list[str] = []
        self.tail, self.head, self.word = (np.zeros(1 << 12, np.int32) for _ in range(3))
        self.single, self.again, self.decoded = np.zeros(1 << 12, bool), np.zeros(1 << 12, bool), {}
        # of words: hashes, lengths and weights, for as many as are settled
        self.hashes, self.size, self.value = np.zeros((1 << 12, 8), np.uint64), np.zeros(1 << 12, np.int64), np.zeros(1 << 12)
        self.settled = self.lasting = 0
        self.several: dict[int, list[int]] = {}

    def _keep_met_again(self) -> None:
        """Drops the tokens that no call since the last drop has met again, and the words of none but them;
        all, if too many would stay."""
        kept = np.flatnonzero(self.again[: len(self.index)])
        number = dict(zip(kept.tolist(), range(len(kept)), strict=True))
        word = self.word[kept]
        several = {number[k]: words for k, words in self.several.items() if k in number}
        words = np.unique(np.concatenate([word[word >= 0], np.array([w for own in several.values() for w in own], np.int32)]))
        if len(kept) > CACHED // 2 or len(words) > CACHED:
            self._forget()
            return
        self.index = {t: number[k] for t, k in self.index.items() if k in number}
        self.special = {number[k]: form for k, form in self.special.items() if k in number}
        for own in (self.tail, self.head, self.single):
            own[: len(kept)] = own[kept]
        self.again[:] = False
        self.word[: len(kept)] = np.where(word >= 0, np.searchsorted(words, word), -1)
        self.several = {k: np.searchsorted(words, own).tolist() for k, own in several.items()}
        self.names = list(map(self.names.__getitem__, words.tolist()))
        self.words = dict(zip(self.names, range(len(self.names)), strict=True))
        for own in (self.hashes, self.size, self.value):
            if self.weights is not None:
                own[: len(words)] = own[words]
        self.settled = self.lasting = len(words)

    def _ends(self, letters: str | None) -> int:
        if not letters:
            return _ALONE if letters is None else _NO_LETTER
        return self.decoder.letter(letters[0]) * LETTERS + self.decoder.letter(letters[1])

    def _word(self, word: str) -> int:
        number = self.words.get(word)
        if number is None:
            number = self.words[word] = len(self.names)
            self.names.append(word)
        return number

    def _make_room(self) -> None:
        while len(self.value) < len(self.names):
            self.hashes, self.size, self.value = (np.concatenate([x, np.zeros_like(x)]) for x in (self.hashes, self.size, self.value))

    def _drop_joined(self) -> None:
        """Forgets the joined words of the call before."""
        for word in self.names[self.lasting :]:
            del self.words[word]
        del self.names[self.lasting :]

    def _settle(self) -> None:
        """Hashes and weights of words that are new."""
        new = self.names[self.settled :]
        if self.weights is None or not new:
            return
        self._make_room()
        here = slice(self.settled, len(self.names))
        self.hashes[here], self.size[here] = h, _ = _hashes(new)
        self.value[here] = 0
        likely = self.telling[1][_slot(h[:, 7])]
        for k in (4, 5, 6):
            likely |= self.telling[0][_slot(h[:, k])]
        for i in np.flatnonzero(likely).tolist():
            self.value[self.settled + i] = weight(new[i], self.weights)
        self.settled = len(self.names)

    def _has_weight(self, found: tuple[int, str]) -> bool:
        """Whether a joined word has a weight, which is remembered until the next call."""
        word = found[1]
        if word[:4] not in self.openings:
            return False
        value = self.worth.get(word)
        if value is None:
            value = self.worth[word] = weight(word, self.weights)
        return value > 0

    def _weigh_joined(self) -> None:
        if self.weights is not None:
            self._make_room()
            self.value[self.lasting : len(self.names)] = [self.worth[w] for w in self.names[self.lasting :]]

    def _learn(self, tokens: list[str]) -> None:
        """Decodes distinct tokens that are new, plain words all together, and numbers them in their order."""
        some, text, sizes = _plain(tokens, self.drops)
        end = np.cumsum(sizes)
        first = end - sizes
        plain = [text[a:b] for a, b in zip(first.tolist(), end.tolist(), strict=True)]
        begin = len(self.index)
        rest = np.ones(len(tokens), bool)
        rest[some] = False
        others = [tokens[i] for i in np.flatnonzero(rest).tolist()]
        self.index.update(zip(tokens, range(begin, begin + len(tokens)), strict=True))
        while len(self.tail) < len(self.index):
            self.tail, self.head, self.word, self.single, self.again = (
                np.concatenate([x, np.zeros_like(x)]) for x in (self.tail, self.head, self.word, self.single, self.again)
            )
        here = begin + some
        new = set(plain).difference(self.words)
        self.words.update(zip(new, range(len(self.names), len(self.names) + len(new)), strict=True))
        self.names += new
        self.word[here] = np.fromiter(map(self.words.__getitem__, plain), np.int32, len(plain))
        letters = codes(text).astype(np.int32)
        # a single letter has a blank beside it
        self.tail[here] = np.where(sizes > 1, letters[end - 2], 0) * LETTERS + letters[end - 1]
        self.head[here] = letters[first] * LETTERS + np.where(sizes > 1, letters[np.minimum(first + 1, end - 1)], 0)
        self.single[here] = True
        forms = [_form(token, self.decoder, self.decoded) for token in others]
        here = begin + np.flatnonzero(rest)
        self.tail[here] = [self._ends(f[1]) for f in forms]
        self.head[here] = [self._ends(f[2]) for f in forms]
        self.word[here] = [self._word(f[0][0]) if f[0] else -1 for f in forms]
        self.single[here] = [len(f[0]) == 1 for f in forms]
        for k, form in zip(here.tolist(), forms, strict=True):
            words, tail, _, more = form
            if len(words) != 1 or more or tail is None:
                self.special[k] = form
                if len(words) > 1 or more:
                    self.several[k] = [self._word(w) for w in (*words[1:], *more)]

    def _forms(self, ids: np.ndarray) -> list[tuple]:
        out, formed = [], self.formed
        for k in ids.tolist():
            form = formed.get(k)
            if form is None:
                form = self.special.get(k)
                if form is None:
                    word = self.names[self.word[k]]
                    form = (word,), f" {word}"[-2:] if self.tail[k] >= 0 else "", f"{word} "[:2] if self.head[k] >= 0 else "", ()
                formed[k] = form
            out.append(form)
        return out

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, word) numbers of the distinct words of each text, in order of texts, and how many
        distinct words each text has as they stand. With weights, joined words without one are left out."""
        self._drop_joined()
        if len(self.index) > CACHED or len(self.names) > 2 * CACHED:
            self._keep_met_again()
        if len(self.gaps) > CACHED // 2:
            self.gaps.clear()
        if len(self.decoded) > CACHED // 4:
            self.decoded.clear()
        tokens, sizes = [], []
        for text in texts:
            own = text.lower().split()
            tokens += own
            sizes.append(len(own))
        place = pa.array(tokens, pa.large_string()).dictionary_encode().indices.to_numpy().astype(np.int64)
        # numbers of a dictionary come in the order in which its entries are met
        distinct = [tokens[i] for i in np.flatnonzero(np.diff(np.maximum.accumulate(place), prepend=-1)).tolist()]
        ids = np.fromiter(map(self.index.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = ids < 0
        self.again[ids[~new]] = True
        if new.any():
            ids[new] = len(self.index) + np.arange(new.sum())
            self._learn([distinct[i] for i in np.flatnonzero(new).tolist()])
        ids = ids[place]
        self._settle()
        text_of = np.repeat(np.arange(len(texts)), sizes)
        pairs = _distinct((text_of << 32) | ids)
        at, token = pairs >> 32, pairs & 0xFFFFFFFF
        word = self.word[token].astype(np.int64)
        found = ((at << 32) | word)[word >= 0]
        more: list[int] = []
        if self.several:
            some = np.zeros(len(self.index), bool)
            some[np.fromiter(self.several, np.int64)] = True
            for i in np.flatnonzero(some[token]).tolist():
                more += [int(at[i]) << 32 | w for w in self.several[int(token[i])]]
        standing = _distinct(np.concatenate([found, np.array(more, np.int64)]))
        self.lasting = len(self.names)
        self.worth: dict[str, float] = {}
        self.formed: dict[int, tuple] = {}
        hidden = self._joined_words(tokens, ids, text_of)
        more = [int(text_of[k]) << 32 | self._word(w) for k, w in (hidden if self.weights is None else filter(self._has_weight, hidden))]
        self._weigh_joined()
        pairs = _distinct(np.concatenate([standing, np.array(more, np.int64)])) if more else standing
        return pairs >> 32, pairs & 0xFFFFFFFF, np.bincount(standing >> 32, minlength=len(texts))

    def _joined_words(self, tokens: list[str], ids: np.ndarray, text_of: np.ndarray) -> Iterator[tuple[int, str]]:
        """(token, word) of words that blanks hide."""
        alone = self.tail[ids] == _ALONE
        loose, joined = self._loose(ids, alone, text_of)
        first, last = _runs(loose, text_of[:-1])
        if self.weights is not None and len(first):
            # stretches of plain words only are looked up together
            plain = np.concatenate([[0], np.cumsum(self.single[ids])])
            simple = plain[last + 2] - plain[first] == last + 2 - first
            unjoined = np.concatenate([[0], np.cumsum(~joined)])
            simple &= unjoined[last + 1] == unjoined[first]
            yield from self._telling(ids, first[simple], last[simple] + 1)
            first, last = first[~simple], last[~simple]
        for a, b in zip(first.tolist(), (last + 1).tolist(), strict=True):
            if b == a + 1 and joined[a]:
                (left, *_), (right, *_) = self._forms(ids[a : b + 1])
                yield a, left[-1] + right[0]
            else:
                for w in _joined(self._forms(ids[a : b + 1]), tokens[a : b + 1], self.decoder, self.gaps):
                    yield a, w
        first, last = _runs(alone, text_of)
        some = last - first >= 2
        for a, b in zip(first[some].tolist(), last[some].tolist(), strict=True):
            for w in self._spelled(tokens[a : b + 1], self._forms(ids[a : b + 1])):
                yield a, w

    def _loose(self, ids, alone, text_of) -> tuple[np.ndarray, np.ndarray]:
        """Of the blanks after each token: which may stand for nothing, and which do between two words."""
        left, right = self.tail[ids[:-1]], self.head[ids[1:]]
        joined = (left >= 0) & (right >= 0) & (text_of[1:] == text_of[:-1])
        joined[joined] = self.joins[left[joined], right[joined]]
        return joined | ((text_of[1:] == text_of[:-1]) & (alone[:-1] | alone[1:])), joined

    def _telling(self, ids: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, str]]:
        """(token, word) of the joined words that may have a weight; a word begins at each token of a
        stretch first .. last but the last, and has ``_PIECES`` tokens at most."""
        length = last - first
        if not len(length):
            return
        # tokens of all stretches in one row
        base = np.repeat(first - np.concatenate([[0], np.cumsum(length + 1)[:-1]]), length + 1)
        row = ids[base + np.arange(len(base))]
        ends = np.repeat(np.cumsum(length + 1), length + 1)
        start = np.flatnonzero(np.arange(len(row)) < ends - 1)
        end = np.minimum(ends[start], start + _PIECES)
        word = self.word[row]
        hashes, size = self.hashes[word], self.size[word]
        offset = np.concatenate([[0], np.cumsum(size)])
        power = _powers(_ODD, int(offset[-1]) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes[:, 7] * power[offset[:-1]])])
        whole = (sums[end] - sums[start]) * _powers(_ODD_INVERSE, int(offset[-1]) + 1)[offset[start]]
        likely = self.telling[1][_slot(whole)]
        scale = np.array(_PREFIX, np.uint64)
        for k in (4, 5, 6):
            have = np.minimum(size[start], k)
            h = hashes[start, have]
            at = start + 1
            open_ = np.flatnonzero((have < k) & (at < end))
            while len(open_):
                piece = at[open_]
                take = np.minimum(size[piece], k - have[open_])
                h[open_] += scale[have[open_]] * hashes[piece, take]
                have[open_] += take
                at[open_] += 1
                open_ = open_[(have[open_] < k) & (at[open_] < end[open_])]
            likely |= self.telling[0][_slot(h)]
        names = list(map(self.names.__getitem__, word.tolist()))
        start, end = start[likely], end[likely]
        for at, a, b in zip((base[start] + start).tolist(), start.tolist(), end.tolist(), strict=True):
            yield at, "".join(names[a:b])

    def _spelled(self, tokens: list[str], forms: list[tuple]) -> Iterator[str]:
        """Words of a run of single characters."""
        chars = " ".join(f[0][0] if f[0] else t[0] for t, f in zip(tokens, forms, strict=True))
        yield from self.decoder.decode(chars).split()
        if tokens[0].startswith("(") and chars[0] != "(":
            yield from self.decoder.decode(f"({chars}").split()


def _distinct(numbers: np.ndarray) -> np.ndarray:
    numbers = np.sort(numbers)
    return numbers[np.concatenate([[True], numbers[1:] != numbers[:-1]])] if len(numbers) else numbers


def _runs(mask: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of consecutive marked places of one text."""
    places = np.flatnonzero(mask)
    if not len(places):
        return places, places
    cut = np.flatnonzero((np.diff(places) > 1) | (np.diff(text_of[places]) != 0)) + 1
    return places[np.concatenate([[0], cut])], places[np.concatenate([cut - 1, [len(places) - 1]])]


def restored_words(text: str, decoder: Decoder, known: dict) -> set[str]:
    """The words of one text after deobfuscation; ``known`` keeps what is learnt between calls."""
    if "reader" not in known:
        known["reader"] = Reader(decoder)
    reader = known["reader"]
    return {reader.names[w] for w in reader.read([text])[1].tolist()}


def _blocks(texts: pa.Array, size: int = 1 << 20) -> Iterator[list[str]]:
    """Whole texts in lists of about ``size`` characters."""
    block, held = [], 0
    for text in texts:
        text = text.as_py() or ""
        block.append(text)
        held += len(text)
        if held >= size:
            yield block
            block, held = [], 0
    if block:
        yield block


def features(word: str) -> list[str]:
    """The word and its beginnings."""
    return [f"={word}", *[word[:k] for k in (4, 5, 6) if len(word) >= k]]


def _features_of(words: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """``features`` of many words, kind by kind: (which words have one, the features)."""
    size = pc.utf8_length(words).to_numpy()
    yield np.arange(len(words)), pc.binary_join_element_wise("=", words, "")
    for k in (4, 5, 6):
        long = np.flatnonzero(size >= k)
        yield long, pc.utf8_slice_codeunits(words.take(pa.array(long)), 0, k)


def _words_of(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Of a column of lists of words: the distinct words, and (list, number of the word) of every entry."""
    coded = lists.flatten().dictionary_encode()
    size = pc.list_value_length(lists).to_numpy()
    return coded.dictionary, np.repeat(np.arange(len(lists)), size), coded.indices.to_numpy().astype(np.int64)


def _occurrences(lists: pa.Array, group: np.ndarray, n_groups: int, part: int = 1 << 18) -> tuple[pa.Array, np.ndarray]:
    """Features of lists of words, and in how many lists of each group each stands, (features, groups);
    lists of about ``part`` words are counted at a time."""
    words, row, word = _words_of(lists)
    owners, own = zip(*_features_of(words), strict=True)
    coded = pa.concat_arrays(own).dictionary_encode()
    numbers = np.split(coded.indices.to_numpy(), np.cumsum([len(x) for x in owners])[:-1])
    of = np.full((len(owners), len(words)), -1, np.int32)
    for own, owner, number in zip(of, owners, numbers, strict=True):
        own[owner] = number
    out = np.zeros(len(coded.dictionary) * n_groups, np.int32)
    ends = np.cumsum(np.bincount(row, minlength=len(lists)))
    cuts = np.unique(np.append(ends[np.searchsorted(ends, np.arange(part, len(row), part))], len(row)))
    for a, b in zip([0, *cuts.tolist()], cuts.tolist(), strict=False):
        pairs = ((row[a:b] << 32) | of[:, word[a:b]]).ravel()
        pairs = _distinct(pairs[pairs >= 0])
        np.add.at(out, (pairs & 0xFFFFFFFF) * n_groups + group[pairs >> 32], 1)
    return coded.dictionary, out.reshape(-1, n_groups)


def _weights_of(words: pa.Array, weights: dict[str, float]) -> np.ndarray:
    """``weight`` of many words."""
    out, known, values = np.zeros(len(words)), pa.array(weights.keys(), pa.string()), np.array([0.0, *weights.values()])
    for owner, own in _features_of(words):
        found = values[pc.fill_null(pc.add(pc.index_in(own, known), 1), 0).to_numpy()]
        out[owner] = np.maximum(out[owner], found)
    return out


@dataclass
class Model:
    """What scoring needs: the language model, the weights of features, and the regression."""

    logp: np.ndarray
    token: str = ""
    weights: dict[str, float] = field(default_factory=dict)
    mean: np.ndarray = field(default_factory=lambda: np.zeros(5))
    spread: np.ndarray = field(default_factory=lambda: np.ones(5))
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros(6))


def log_odds(counts: dict[str, tuple[int, int]], n0: int, n1: int, least: int = 2) -> dict[str, float]:
    """Lower bounds (one and a half standard errors) of the log odds of features; positive ones."""
    out = {}
    for f, (c0, c1) in counts.items():
        if c1 >= least:
            odds = np.log((c1 + 0.5) / (n1 - c1 + 0.5)) - np.log((c0 + 0.5) / (n0 - c0 + 0.5))
            error = np.sqrt(1 / (c1 + 0.5) + 1 / (c0 + 0.5) + 1 / (n1 - c1 + 0.5) + 1 / (n0 - c0 + 0.5))
            if odds - 1.5 * error > 0:
                out[f] = float(odds - 1.5 * error)
    return out


def weight(word: str, weights: dict[str, float]) -> float:
    """The largest weight of a word and its beginnings."""
    get = weights.get
    return max(get(f"={word}", 0.0), get(word[:4], 0.0), get(word[:5], 0.0), get(word[:6], 0.0)) if len(word) > 3 else get(f"={word}", 0.0)


def evidence(text_of: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Five numbers for each text, from the weights of its distinct words: the three largest weights,
    the logarithm of their sum over 1, and that of the number of words as they stand (``sizes``)."""
    n = len(sizes)
    out = np.zeros((n, 5))
    out[:, 4] = np.log1p(sizes)
    some = values > 0
    text_of, values = text_of[some], values[some]
    out[:, 3] = np.log1p(np.bincount(text_of, np.maximum(0.0, values - 1), minlength=n))
    order = np.lexsort((-values, text_of))
    text_of, values = text_of[order], values[order]
    rank = np.arange(len(text_of)) - np.searchsorted(text_of, text_of)
    for k in range(3):
        out[text_of[rank == k], k] = values[rank == k]
    return out


def fit_regression(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; the last coefficient is the constant."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = a.T @ (a * (p * (1 - p))[:, None]) + penalty
        step = np.linalg.solve(h, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sample(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(text, toxic, half) of at most ``fit_rows`` labelled documents whose labels may be learned from.

    Held out are documents whose crc32(doc_id as text) mod 3 is 1. The sample is that with the
    smallest hashes, so it does not depend on the order of rows; half splits it evenly.
    """
    order = F.xxhash64("doc_id", F.lit(42))
    known = (
        labels.where("doc_id is not null and toxic is not null").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
        .groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
        .orderBy(order, "doc_id").limit(fit_rows)
    )
    # a bounded table: fit_rows rows of an id and a label
    known = known.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_toxic"))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id"))
    return rows.select("text", F.col("_toxic").alias("toxic"), F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)).cast("int").alias("half"))


def _reader(token: str, logp: np.ndarray, weights: dict[str, float] | None = None) -> Reader:
    """The reader of a model, kept by a Python worker."""
    held = worker_cache(f"toxicity {token}")
    if "reader" not in held:
        held["reader"] = Reader(Decoder(logp), weights)
    return held["reader"]


def _restored(rows: DataFrame, logp) -> DataFrame:
    """(toxic, half, words, size) of the sample."""
    token = uuid.uuid4().hex

    def run(parts):
        reader = _reader(token, logp.value)
        for part in parts:
            begin = 0
            for block in _blocks(part.column(0)):
                text_of, words, sizes = reader.read(block)
                ends = np.searchsorted(text_of, np.arange(len(block) + 1))
                names = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([reader.names[w] for w in words.tolist()], pa.string()))
                given = [part.column(k).slice(begin, len(block)) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays([*given, names, pa.array(sizes, pa.int64())], names=["toxic", "half", "words", "size"])
                begin += len(block)

    return cut_lineage(rows.mapInArrow(run, "toxic int, half int, words array<string>, size bigint"))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, lexicon: int = 100_000) -> Model:
    """Language model from all documents; lexicon and regression from a bounded sample of labels.

    The regression sees, for each half of the sample, evidence by a lexicon of the other half.
    """
    sc = docs.sparkSession.sparkContext
    logp = language_model(trigram_counts(docs))
    rows = _restored(sample(docs, labels, fit_rows), sc.broadcast(logp))

    cells = [(y, h) for y in (0, 1) for h in (0, 1)]

    def seen(parts):
        for part in parts:
            y, h = (part.column(k).to_numpy() for k in (0, 1))
            found, n = _occurrences(part.column(2), 2 * y + h, len(cells))
            yield pa.RecordBatch.from_arrays([found, *[pa.array(own, pa.int64()) for own in n.T]], names=["f", *[f"c{y}{h}" for y, h in cells]])

    sizes = {(r["toxic"], r["half"]): r["n"] for r in rows.groupBy("toxic", "half").agg(F.count("*").alias("n")).collect()}
    model = Model(logp, uuid.uuid4().hex)
    n1, n0 = (sum(n for (y, _), n in sizes.items() if y == k) for k in (1, 0))
    if not n1 or not n0:
        share = n1 / (n1 + n0) if n1 + n0 else 0.0
        model.coefficients[-1] = np.log((share + 1e-9) / (1 - share + 1e-9))
        return model
    sums = [F.sum(f"c{y}{h}").alias(f"c{y}{h}") for y, h in cells]
    each = rows.mapInArrow(seen, ", ".join(["f string", *[f"c{y}{h} bigint" for y, h in cells]])).groupBy("f").agg(*sums)
    # features seen in several toxic documents, those that tell most by the weight they get first
    c0, c1 = F.col("c00") + F.col("c01") + 0.5, F.col("c10") + F.col("c11") + 0.5
    no0, no1 = (n0 + 1) - c0, (n1 + 1) - c1
    bound = F.log(c1 / no1) - F.log(c0 / no0) - 1.5 * F.sqrt(1 / c1 + 1 / c0 + 1 / no1 + 1 / no0)
    telling = each.where("c10 + c11 >= 2 and (c10 + c11) * {0} > 2 * (c00 + c01) * {1}".format(n0, n1))
    telling = telling.orderBy(F.round(bound, 9).desc(), "f").limit(lexicon).collect()
    by_half = []
    for h in (0, 1):
        counts = {r["f"]: (r[f"c0{h}"], r[f"c1{h}"]) for r in telling}
        by_half.append(log_odds(counts, sizes.get((0, h), 0), sizes.get((1, h), 0)))
    model.weights = log_odds({r["f"]: (r["c00"] + r["c01"], r["c10"] + r["c11"]) for r in telling}, n0, n1)
    halves = sc.broadcast(by_half)

    def judged(parts):
        for part in parts:
            y, h = part.column(0), part.column(1).to_numpy()
            words, row, word = _words_of(part.column(2))
            values = np.stack([_weights_of(words, halves.value[1 - k]) for k in (0, 1)])
            x = evidence(row, values[h[row], word], part.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), y], names=["x", "y"])

    points = rows.mapInArrow(judged, "x array<double>, y int").collect()
    x, y = np.array([r["x"] for r in points]), np.array([r["y"] for r in points], float)
    model.mean, model.spread = x.mean(0), x.std(0) + 1e-6
    model.coefficients = fit_regression((x - model.mean) / model.spread, y)
    return model


def scores(text: Column, shared) -> Column:
    """Column of scores from a broadcast ``Model``."""

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        reader = _reader(model.token, model.logp, model.weights)
        for part in parts:
            out = []
            for block in _blocks(part):
                text_of, words, sizes = reader.read(block)
                x = (evidence(text_of, reader.value[words], sizes) - model.mean) / model.spread
                z = x @ model.coefficients[:-1] + model.coefficients[-1]
                out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            yield pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())

    return score(text)


def report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    rows = docs.select("doc_id", scores(F.col("text"), shared).alias("score"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those whose score reaches the threshold; columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    rows = docs.select(as_struct(docs), scores(F.col("text"), shared).alias("score"))
    return rows.where(F.col("score") < threshold).select(f"{ROW}.*")
