"""Statistics of masks held as array<int> in row order, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_at_least(alpha: Column, threshold: int) -> Column:
    return F.size(F.filter(alpha, lambda v: v >= threshold))


def count_between(alpha: Column, low: int, high: int) -> Column:
    """Values strictly between the bounds."""
    return F.size(F.filter(alpha, lambda v: (v > low) & (v < high)))


def band_width(height: Column, width: Column, share: float) -> Column:
    return F.greatest(F.lit(2), F.floor(F.least(height, width) * share).cast("int"))


def _line(i: Column, width: Column) -> Column:
    return F.floor(i / width)


def band(alpha: Column, height: Column, width: Column, side: str, size: Column, threshold: int) -> tuple[Column, Column]:
    """(area share, span share) of foreground in the band along one side.

    The span is the share of the side's columns (or rows) with any foreground in the band.
    """
    y, x = (lambda i: _line(i, width)), (lambda i: i % width)
    inside = {
        "top": lambda i: y(i) < size,
        "bottom": lambda i: y(i) >= height - size,
        "left": lambda i: x(i) < size,
        "right": lambda i: x(i) >= width - size,
    }[side]
    along, length, depth = (x, width, F.least(size, height)) if side in ("top", "bottom") else (y, height, F.least(size, width))
    at = F.array_compact(F.transform(alpha, lambda v, i: F.when((v >= threshold) & inside(i), along(i).cast("int"))))
    return F.size(at) / (depth * length), F.size(F.array_distinct(at)) / length


def overlap_counts(a: Column, b: Column, threshold: int) -> tuple[Column, Column, Column]:
    """(pixels in both, pixels in either, sum of absolute differences) of two masks of one size."""
    both = F.size(F.filter(F.zip_with(a, b, lambda p, q: (p >= threshold) & (q >= threshold)), lambda v: v))
    either = F.size(F.filter(F.zip_with(a, b, lambda p, q: (p >= threshold) | (q >= threshold)), lambda v: v))
    apart = F.aggregate(F.zip_with(a, b, lambda p, q: F.abs(p - q)), F.lit(0).cast("long"), lambda s, v: s + v)
    return both, either, apart


def composite(alpha: Column, value: Column, canvas: Column) -> Column:
    """Samples laid over a canvas sample, half rounded to even."""
    return F.zip_with(alpha, value, lambda a, v: F.rint((v * a + canvas * (255 - a)) / 255.0).cast("int"))
