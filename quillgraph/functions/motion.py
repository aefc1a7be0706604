"""Numbers for layered backgrounds and staggered reveals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def crossfade(offset: Column, height: Column, count: Column, layer: Column, top: float) -> Column:
    """Opacity of a layer (from 0) among `count` layers over a page of `height` that is scrolled by `offset`.

    One layer has the full opacity.  Before the first segment and on pages without
    height the first layer has it, behind the last the last one; between, two
    neighbours share it.
    """
    segment = height / F.nullif(count, F.lit(0))
    t = offset / F.nullif(segment, F.lit(0.0))
    base = F.floor(t)
    part = t - base
    full, none = F.lit(float(top)), F.lit(0.0)
    return (
        F.when(count == 1, full)
        .when((F.coalesce(segment, none) <= 0) | (t <= 0), F.when(layer == 0, full).otherwise(none))
        .when(t >= count - 1, F.when(layer == count - 1, full).otherwise(none))
        .when(layer == base, (F.lit(1.0) - part) * full)
        .when(layer == base + 1, part * full)
        .otherwise(none)
    )


def opacity_style(x: Column) -> Column:
    """As a style sheet takes it: all decimals there are, none where there are none; null and not-a-number are 0."""
    whole = F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0)).cast("decimal(20,17)").cast("string")
    return F.regexp_replace(whole, r"\.?0+$", "")


def opacity_text(x: Column) -> Column:
    """As a page template writes it, with two decimals; null and not-a-number are zero."""
    return F.format_string("%.2f", F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0)))


def stagger(place: Column, start: int, step: int) -> Column:
    """Delay of the item at `place` (from 0)."""
    return F.lit(start) + place * F.lit(step)


def clamped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))
