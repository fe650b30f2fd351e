"""Vector expressions over arrays, computed in double precision in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """L2-normalised; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(doubles(v), lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is empty or zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def cosine01(a: Column, b: Column) -> Column:
    """Mapped to [0, 1]; 0 for empty and zero vectors."""
    return F.coalesce(F.greatest((cosine(a, b) + 1) / 2, F.lit(0.0)), F.lit(0.0))


def contrast(c: Column, mode: str) -> Column:
    """A cosine by one of the modes ``normalized``, ``relu``, ``relu_sq``."""
    if mode == "normalized":
        return F.greatest((c + 1) / 2, F.lit(0.0))
    if mode == "relu":
        return F.greatest(c, F.lit(0.0))
    if mode == "relu_sq":
        return F.pow(F.greatest(c, F.lit(0.0)), F.lit(2.0))
    raise ValueError(f"unknown mode {mode!r}")


def min_max(c: Column, *partition: str) -> Column:
    """Scaled to [0, 1] within the partition; all ones where the range is zero."""
    w = Window.partitionBy(*partition)
    low, high = F.min(c).over(w), F.max(c).over(w)
    return F.when(high == low, F.lit(1.0)).otherwise((c - low) / (high - low))


def quantize(v: Column, bits: int = 8) -> Column:
    """Levels of ``2**bits - 1`` steps between the least and the greatest element, with these."""
    low, high = F.array_min(doubles(v)), F.array_max(doubles(v))
    steps = float(2**bits - 1)
    levels = F.transform(doubles(v), lambda x: F.when(high == low, F.lit(0)).otherwise(F.round((x - low) / (high - low) * steps)).cast("int"))
    return F.struct(levels.alias("levels"), low.alias("low"), high.alias("high"))


def dequantize(q: Column, bits: int = 8) -> Column:
    steps = float(2**bits - 1)
    return F.transform(q["levels"], lambda x: x / steps * (q["high"] - q["low"]) + q["low"])
