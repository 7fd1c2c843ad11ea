"""Text, path and number helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def suffix(path: Column) -> Column:
    """Lower-case last suffix with its dot; empty for names without one and for names of one leading dot."""
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"^.+(\.[^.]+)$", 1))


def is_image(path: Column, extensions: tuple[str, ...]) -> Column:
    return suffix(path).isin(*extensions)


def png_name(path: Column) -> Column:
    """path with its last suffix replaced by .png, or .png added where it has none."""
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", ""), F.lit(".png"))


def truthy(c: Column) -> Column:
    """1, true or yes, whatever the case and the white space around; null is false."""
    return F.coalesce(F.lower(F.trim(c)).isin("1", "true", "yes"), F.lit(False))


def number(c: Column) -> Column:
    """Text as double; blank, null and unreadable text is 0."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def joined(c: Column, separator: str = ";") -> Column:
    return F.array_join(c, separator)


def distinct_in_order(*lists: Column) -> Column:
    """Entries of the lists one after another, each at its first place only; nulls dropped."""
    return F.array_distinct(F.array_compact(F.concat(*lists)))


def flags(*pairs: tuple[Column, str]) -> Column:
    """Names whose condition holds, in the order given."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in pairs]))


def share(part: Column, whole: Column) -> Column:
    """part / whole, the whole taken as one where it is less."""
    return part / F.greatest(whole, F.lit(1))


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def analysis_size(side: Column, longest: Column, limit: int) -> Column:
    """Side after scaling an image down to the limit, half rounded to even, one at least."""
    scale = F.least(F.lit(1.0), F.lit(float(limit)) / longest)
    return F.greatest(F.lit(1), F.rint(side * scale).cast("int"))


def luma(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def saturation(r: Column, g: Column, b: Column) -> Column:
    top = F.greatest(r, g, b)
    return F.when(top > 0, (top - F.least(r, g, b)) / top).otherwise(0.0)


def sheet_cell(position: Column, columns: int) -> tuple[Column, Column]:
    """Column and row of a contact sheet's cell, counted from zero."""
    return (position % columns).cast("int"), F.floor(position / columns).cast("int")


def duration_text(seconds: Column) -> Column:
    s = F.coalesce(seconds, F.lit(0.0)).cast("int")
    return F.concat(F.floor(s / 60).cast("string"), F.lit(" min "), (s % 60).cast("string"), F.lit(" s"))
