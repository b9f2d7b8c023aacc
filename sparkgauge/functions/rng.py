"""Seeded random numbers: draw i of a stream as a column, and sequential generators in Python.

The generator adds a constant to a 32-bit state and mixes it, so the state before draw i is
seed + (i + 1) * constant: any draw can be computed alone, on any executor.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the generator.
STEP = 0x6D2B79F5
WORD = (1 << 32) - 1


def _times(a: Column, b: Column) -> Column:
    """Product modulo 2^32 of two 32-bit words, without overflow of 64 bits."""
    low = a * b.bitwiseAND(F.lit(0xFFFF))
    high = F.shiftleft((a * F.shiftright(b, 16)).bitwiseAND(F.lit(0xFFFF)), 16)
    return (low + high).bitwiseAND(F.lit(WORD))


def with_uniform(df: DataFrame, seed: int, draw: Column, name: str) -> DataFrame:
    """Adds ``name``: draw number ``draw`` (from 0, below 2^31) of the stream of ``seed``, in [0, 1).

    Each word is used several times by the next, so each is a column of its own: as one expression
    it would be copied over and over.
    """
    word = lambda c: c.bitwiseAND(F.lit(WORD))
    a, t, u = F.col("_a"), F.col("_t"), F.col("_u")
    return (
        df.withColumn("_a", word(F.lit(seed & WORD).cast("long") + _times(F.lit(STEP).cast("long"), word(draw.cast("long") + 1))))
        .withColumn("_t", a.bitwiseXOR(F.shiftright(a, 15)))
        .withColumn("_t", _times(t, a.bitwiseOR(F.lit(1))))
        .withColumn("_u", t.bitwiseXOR(F.shiftright(t, 7)))
        .withColumn("_t", word(t + _times(u, t.bitwiseOR(F.lit(61)))).bitwiseXOR(t))
        .withColumn(name, t.bitwiseXOR(F.shiftright(t, 14)).cast("double") / 4294967296.0)
        .drop("_a", "_t", "_u")
    )


def uniforms(seed: int, draws: np.ndarray) -> np.ndarray:
    """The same draws in numpy, for tasks that make many at once."""
    word = np.uint64(WORD)
    a = (np.uint64(seed & WORD) + np.uint64(STEP) * ((draws.astype(np.uint64) + np.uint64(1)) & word)) & word
    t = (a ^ (a >> np.uint64(15))) * (a | np.uint64(1)) & word
    t = ((t + ((t ^ (t >> np.uint64(7))) * (t | np.uint64(61)) & word)) & word) ^ t
    return (t ^ (t >> np.uint64(14))) / 4294967296.0


class Rng:
    """The same stream, one draw after the other, with normal, gamma and beta variates."""

    def __init__(self, seed: int):
        self.state, self.kept = seed & WORD, None

    def next(self) -> float:
        self.state = a = (self.state + STEP) & WORD
        t = (a ^ a >> 15) * (a | 1) & WORD
        t = (t + ((t ^ t >> 7) * (t | 61) & WORD) & WORD) ^ t
        return (t ^ t >> 14) / 4294967296.0

    def int(self, n: int) -> int:
        return math.floor(self.next() * n)

    def _positive(self) -> float:
        while (u := self.next()) <= 2.220446049250313e-16:
            pass
        return u

    def normal(self) -> float:
        """Box-Muller in pairs; the second of a pair is kept for the next call."""
        if self.kept is not None:
            kept, self.kept = self.kept, None
            return kept
        radius = math.sqrt(-2 * math.log(self._positive()))
        angle = 2 * math.pi * self.next()
        self.kept = radius * math.sin(angle)
        return radius * math.cos(angle)

    def gamma(self, shape: float) -> float:
        """Marsaglia and Tsang's method; a shape below 1 through the next one."""
        if not shape > 0:
            raise ValueError("gamma: shape must be positive")
        if shape < 1:
            g = self.gamma(shape + 1)
            return g * self._positive() ** (1 / shape)
        d = shape - 1 / 3
        c = 1 / math.sqrt(9 * d)
        while True:
            x = self.normal()
            if 1 + c * x <= 0:
                continue
            v = (1 + c * x) ** 3
            u = self.next()
            if u < 1 - 0.0331 * x**4 or (u > 0 and math.log(u) < 0.5 * x * x + d * (1 - v + math.log(v))):
                return d * v

    def beta(self, a: float, b: float) -> float:
        x = self.gamma(a)
        return x / (x + self.gamma(b))


def normal_quantile(p: float) -> float:
    return -math.inf if p <= 0 else math.inf if p >= 1 else NormalDist().inv_cdf(p)


def normal_cdf(z: float) -> float:
    return NormalDist().cdf(z)


def quantile(values: list[float], p: float) -> float:
    """Linear interpolation at p (n - 1)."""
    v = sorted(values)
    if not v:
        return math.nan
    at = p * (len(v) - 1)
    low, high = math.floor(at), math.ceil(at)
    return v[low] if low == high else v[low] * (high - at) + v[high] * (at - low)
