"""Deterministic pseudo-random numbers.

Everything random here is a function of a row key and a salt, never of ``rand()``: the result is
the same for any partitioning and when a task is retried after an executor is lost.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

REPLICA_PRIME = 2**31 - 1


def digest(key: Column, salt: str) -> Column:
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(salt)))


def _word(hexdigest: Column, index: int) -> Column:
    """The ``index``-th 32-bit word of an md5 text, as a bigint."""
    return F.conv(F.substring(hexdigest, 1 + 8 * index, 8), 16, 10).cast("bigint")


def hash32(key: Column, salt: str) -> Column:
    return _word(digest(key, salt), 0)


def uniform(key: Column, salt: str) -> Column:
    """Uniform number in [0, 1)."""
    return hash32(key, salt).cast("double") / F.lit(4294967296.0)


def slot(key: Column, slots: int, salt: str) -> Column:
    """Hash bucket in 0..slots-1."""
    return F.pmod(hash32(key, salt), F.lit(slots)).cast("bigint")


def replica_coefficients(key: Column, salt: str) -> Column:
    """Four numbers below 2^31 - 1 from one md5 of the key.

    They are the coefficients of a cubic polynomial over the prime field. Its values at replica
    1, 2, 3, ... are uniform and four-wise independent, so one digest per key serves any number
    of replicas at the price of three multiplications each.
    """
    text = digest(key, salt)
    return F.array(*[_word(text, i) % REPLICA_PRIME for i in range(4)])


def replica_value(coefficients: Column, replica: Column) -> Column:
    """Value in 0..2^31-2 of the polynomial at ``replica`` (Horner, stays below 2^63)."""
    terms = [coefficients.getItem(i) for i in (3, 2, 1, 0)]
    return reduce(lambda acc, term: (acc * replica + term) % REPLICA_PRIME, terms)


def poisson_cuts() -> list[int]:
    """Cumulative Poisson(1) probabilities scaled to the range of ``replica_value``."""
    cuts, total, k = [], 0.0, 0
    while True:
        total += math.exp(-1) / math.factorial(k)
        cut = int(total * REPLICA_PRIME)
        if cut >= REPLICA_PRIME - 1:
            return cuts
        cuts.append(cut)
        k += 1


def poisson_weight(value: Column) -> Column:
    """Poisson(1) weight of a replica value."""
    cuts = poisson_cuts()
    weight = F.when(value < cuts[0], F.lit(0.0))
    for k, cut in enumerate(cuts[1:], start=1):
        weight = weight.when(value < cut, F.lit(float(k)))
    return weight.otherwise(F.lit(float(len(cuts))))


def poisson_matrix(keys: np.ndarray, n_boot: int, salt: str) -> np.ndarray:
    """``poisson_weight(replica_value(replica_coefficients(key, salt), replica))`` of integer keys (rows) and
    replicas 1 to ``n_boot`` (columns), for use inside a task."""
    texts = b"".join(hashlib.md5(f"{key}|{salt}".encode()).digest() for key in keys.tolist())
    terms = np.frombuffer(texts, ">u4").reshape(-1, 4).astype(np.int64) % REPLICA_PRIME
    replica = np.arange(1, n_boot + 1, dtype=np.int64)
    value = np.zeros((len(keys), n_boot), np.int64)
    for i in (3, 2, 1, 0):
        value = (value * replica + terms[:, i : i + 1]) % REPLICA_PRIME
    return np.searchsorted(np.array(poisson_cuts()), value, "right").astype(np.uint8)
