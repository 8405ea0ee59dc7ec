"""Stable hashes that decide splits, orders and bootstrap weights.

Everything here is a pure function of a key, so results do not depend on
partitioning, row order or retries.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_word(key: Column) -> Column:
    """The first 32 bits of the key's SHA-256, as a BIGINT."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("bigint")


def hash_bucket(key: Column, modulo: int = 100) -> Column:
    """Bucket of ``key`` in ``[0, modulo)``; callers put a seed into the key."""
    return hash_word(key) % F.lit(modulo)


def seeded(seed: int | str, key: Column) -> Column:
    """``seed:key``."""
    return F.concat(F.lit(f"{seed}:"), key.cast("string"))


def order_key(seed: int | str, key: Column) -> Column:
    """Sort key of a seeded shuffle: any engine sorts the same rows the same way."""
    return F.sha2(seeded(seed, key), 256)


#: Prime modulus of the bootstrap draws; a draw is a whole number below it.
DRAW_MODULUS = 2**31 - 1


def draw_seeds(seed: int, key: Column) -> list[Column]:
    """Four whole numbers below ``DRAW_MODULUS`` from one digest of the key: start and step of two draws."""
    digest = F.sha2(seeded(seed, key), 256)
    return [F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint") % DRAW_MODULUS for at in (1, 9, 17, 25)]


def draw(start: Column, step: Column, replicate: Column) -> Column:
    """Uniform draw in (0, 1) of a key in one replicate: ``(start + replicate * step) mod p``, as a share of p.

    Any two replicates draw independently of each other because ``start`` and
    ``step`` are independent and the modulus is prime; quantiles over the
    replicates need no more than that. One digest serves all replicates.
    """
    return ((start + replicate * step) % DRAW_MODULUS + F.lit(0.5)) / F.lit(float(DRAW_MODULUS))


def poisson_cuts(terms: int = 10) -> list[int]:
    """Whole draws below ``cuts[k]`` have a Poisson(1) weight of at most ``k``."""
    total, cuts = 0.0, []
    for k in range(terms):
        total += math.exp(-1) / math.factorial(k)
        cuts.append(min(int(total * DRAW_MODULUS), DRAW_MODULUS))
    return cuts


#: Largest mean whose Poisson draws are inverted exactly.
EXACT_MEAN = 64


def poisson_draw(mean: Column, u: Column, v: Column) -> Column:
    """A Poisson draw of a whole-number mean from two uniform ones.

    Up to ``EXACT_MEAN`` the distribution function is inverted at ``u``: the
    draw is how many of its values lie below. Beyond, a normal deviate of both
    is corrected for skewness and fourth moment (Cornish and Fisher), which is
    within a thousandth of the distribution in total variation.
    """
    m = mean.cast("double")
    below = F.struct(F.exp(-m).alias("term"), F.exp(-m).alias("total"), (F.exp(-m) < u).cast("bigint").alias("n"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * m / i
        total = acc["total"] + term
        return F.struct(term.alias("term"), total.alias("total"), (acc["n"] + (total < u).cast("bigint")).alias("n"))

    # Ten deviations above the mean, where nothing is left.
    last = F.least(F.ceil(m + 10 * F.sqrt(m)), F.lit(200)) + 12
    exact = F.aggregate(F.sequence(F.lit(1), last.cast("int")), below, step, lambda acc: acc["n"])
    z = F.sqrt(-2 * F.log(u)) * F.cos(F.lit(2 * math.pi) * v)
    bent = m + F.sqrt(m) * z + (z * z - 1) / 6 + (z - z * z * z) / (72 * F.sqrt(m))
    return F.when(mean <= EXACT_MEAN, exact).otherwise(F.greatest(F.lit(0), F.floor(bent + 0.5)))
