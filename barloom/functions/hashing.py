"""Counter-based uniforms: plain BIGINT arithmetic, so any engine can repeat the draw."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The modulus and the round multipliers of the mixing function.
MODULUS = 2147483647
SEED_MUL, REP_MUL, POS_MUL = 48271, 7919, 104729
ROUNDS = (16807, 69621, 48271)


def _big(x: Column | int) -> Column:
    return F.lit(x).cast("bigint") if isinstance(x, int) else x.cast("bigint")


def mix(seed: Column | int, rep: Column | int, pos: Column | int) -> Column:
    """Pseudo-random integer in [0, MODULUS) of (seed, replicate, position)."""
    x = (_big(seed) * SEED_MUL + _big(rep) * REP_MUL + _big(pos) * POS_MUL + 1) % MODULUS
    for c in ROUNDS:
        x = (x * x + x * c + 12345 + c) % MODULUS
    return x


def uniform(seed: Column | int, rep: Column | int, pos: Column | int) -> Column:
    return mix(seed, rep, pos) / F.lit(float(MODULUS))
