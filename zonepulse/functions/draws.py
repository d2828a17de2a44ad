"""Random numbers that a seed word and a place determine, as Spark SQL expressions.

The seed is the 32-bit FNV-1a hash of the word, the stream that of the mulberry32
generator. Its state moves by a fixed step, so the k-th number is a function of the
seed and k alone: any task can make any part of a stream.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Start and prime of FNV-1a, step of mulberry32. Fixed values.
FNV_START, FNV_PRIME, STEP = 2166136261, 16777619, 0x6D2B79F5
_LOW = (1 << 32) - 1


def _times(x: Column, y: Column) -> Column:
    """Product modulo 2 ** 32 of numbers below 2 ** 32; both halves stay within a long."""
    high = (x * F.shiftright(y, 16)).bitwiseAND(F.lit(0xFFFF))
    return (F.shiftleft(high, 16) + x * y.bitwiseAND(F.lit(0xFFFF))).bitwiseAND(F.lit(_LOW))


def seed_of(word: Column) -> Column:
    """FNV-1a over the word's characters, which are ASCII."""
    letters = F.filter(F.split(word, ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(FNV_START).cast("long"), lambda h, c: _times(h.bitwiseXOR(F.ascii(c).cast("long")), F.lit(FNV_PRIME).cast("long")))


def uniform(seed: Column, k: Column) -> Column:
    """The k-th number of the seed's stream, from 1 on, in [0, 1)."""
    state = (seed + k.cast("long") * STEP).bitwiseAND(F.lit(_LOW))
    one = _times(state.bitwiseXOR(F.shiftright(state, 15)), state.bitwiseOR(F.lit(1)))
    mixed = _times(one.bitwiseXOR(F.shiftright(one, 7)), one.bitwiseOR(F.lit(61)))
    two = one.bitwiseXOR((one + mixed).bitwiseAND(F.lit(_LOW)))
    return two.bitwiseXOR(F.shiftright(two, 14)) / F.lit(float(1 << 32))


def normal(seed: Column, k: Column) -> Column:
    """The k-th standard normal number, from two of the stream."""
    least = F.lit(1e-12)
    radius = F.sqrt(-2 * F.log(F.greatest(uniform(seed, 2 * k - 1), least)))
    return radius * F.cos(2 * math.pi * F.greatest(uniform(seed, 2 * k), least))
