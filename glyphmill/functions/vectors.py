"""Numeric array expressions: softmax, arg-max, normalise, seeded noise."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.functions.draws import Part, let, u32


def softmax(scores: Column) -> Column:
    def shares(powers: Column) -> Column:
        return let(F.aggregate(powers, F.lit(0.0), lambda a, x: a + x), lambda t: F.transform(powers, lambda x: x / t))

    wide = scores.cast("array<double>")
    return let(let(F.array_max(wide), lambda top: F.transform(wide, lambda x: F.exp(x - top))), shares)


def arg_max(scores: Column) -> Column:
    """0-based position of the largest value, the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def normalise(values: Column, mean: Sequence[float], std: Sequence[float]) -> Column:
    """``(x - mean) / std`` with the channel statistics repeated along the array."""
    means, stds = (F.array(*[F.lit(float(x)) for x in xs]) for xs in (mean, std))
    return F.transform(
        values.cast("array<double>"), lambda x, i: (x - F.get(means, i % len(mean))) / F.get(stds, i % len(std))
    )


def clamp(values: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.transform(values.cast("array<double>"), lambda x: F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def add_noise(values: Column, strength: float, seed: Part, row: Part) -> Column:
    """Gaussian noise of the given strength, clamped to [0, 1]; 0 changes nothing."""
    if strength <= 0:
        return values

    def normal(i: Column) -> Column:
        a = (u32(seed, "noise", row, i, "a") + 1) / F.lit(4294967296.0)
        b = u32(seed, "noise", row, i, "b") / F.lit(4294967296.0)
        return F.sqrt(F.lit(-2.0) * F.log(a)) * F.cos(F.lit(2.0 * math.pi) * b)

    return clamp(F.transform(values.cast("array<double>"), lambda x, i: x + normal(i) * F.lit(float(strength))))
