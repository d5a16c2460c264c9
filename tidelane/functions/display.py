"""Classes, colours and shapes by which cells, waves and routes are drawn."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper bounds of the wave height classes in metres, and of the period classes in seconds.
HEIGHT_CLASSES = (("calm", 0.5), ("moderate", 1.5), ("high", 2.5), ("very high", None))
PERIOD_CLASSES = (("short", 2.0), ("medium", 5.0), ("long", 8.0), ("very long", None))
#: A channel is base + span * shape(ratio), with the shapes of SHAPES. A variable without a ramp has that of the direction.
RAMPS = {
    "htsgwsfc": ((120, 100, "rise"), (80, 100, "fall"), (50, 50, "fall")),
    "perpwsfc": ((0, 30, "fall"), (100, 120, "rise"), (120, 50, "late")),
    "dirpwsfc": ((100, 100, "early"), (50, 50, "fall"), (150, 50, "rise")),
}
OPACITY = "0.8"
GREY = "rgba(128, 128, 128, 0.8)"
#: Seconds before a wave's animation starts, at the least and on top of that at random, by height class.
DELAYS = {"calm": (2.0, 3.5), "moderate": (1.5, 3.0), "high": (1.0, 2.5), "very high": (0.0, 1.0)}
GAUGE_FLOORS = {"height": 5.0, "period": 15.0}


def _classed(value: Column, classes) -> Column:
    out = None
    for name, below in classes[:-1]:
        out = F.when(value < below, name) if out is None else out.when(value < below, name)
    return F.when(value.isNotNull(), out.otherwise(classes[-1][0]))


def height_class(height: Column) -> Column:
    return _classed(height, HEIGHT_CLASSES)


def period_class(period: Column) -> Column:
    return _classed(period, PERIOD_CLASSES)


def ratio(value: Column, low: Column, high: Column) -> Column:
    """Place of a value between two others, 0 to 1 if it lies between them; null if they don't differ."""
    return F.when(high > low, (value - low) / F.nullif(high - low, F.lit(0.0)))


def _shaped(r: Column, shape: str) -> Column:
    """A ramp's course; beyond the ends the bent ones stay where they end."""
    if shape == "late":
        return 1 - F.sqrt(F.greatest(F.lit(0.0), 1 - r))
    if shape == "early":
        return F.pow(F.greatest(F.lit(0.0), r), F.lit(0.7))
    return r if shape == "rise" else 1 - r


def colour(variable: str, value: Column, low: Column, high: Column) -> Column:
    """The colour of a value between two others; grey where they don't differ or the variable is none."""
    if variable == "none":
        return F.lit(GREY)
    r = ratio(value, low, high)
    channels = [F.floor(base + span * _shaped(r, shape) + 0.5).cast("int").cast("string") for base, span, shape in RAMPS.get(variable, RAMPS["dirpwsfc"])]
    return F.when(r.isNull(), GREY).otherwise(F.concat(F.lit("rgba("), F.concat_ws(",", *channels, F.lit(OPACITY)), F.lit(")")))


def fixed(value: Column, digits: int = 6) -> Column:
    """The number with so many digits after the point, as text; half goes away from zero."""
    return F.format_string(f"%.{digits}f", value)


def line_width(period: Column) -> Column:
    return 1 + 3 * (period - 2) / 6


def arrow_length(height: Column) -> Column:
    return F.greatest(F.lit(20.0), F.least(F.lit(90.0), height * 8))


def arrow_tip(x: Column, y: Column, height: Column, direction: Column) -> tuple[Column, Column]:
    """End of a wave's arrow that starts at x, y."""
    angle, reach = F.radians(direction + 90), height * arrow_length(height)
    return x + reach * F.cos(angle), y + reach * F.sin(angle)


def start_delay(wave_class: Column, seed: int = 0) -> Column:
    """A pseudo-random delay in seconds; higher classes start sooner."""
    least, span = (functools.reduce(lambda c, k: c.when(wave_class == k, DELAYS[k][i]), DELAYS, F.when(F.lit(False), 0.0)) for i in (0, 1))
    return least + F.rand(seed) * span


def phase(time_ms: Column, delay_ms: Column, cycle_ms: float = 1200.0) -> Column:
    """Place in the animation's cycle; null before the start."""
    return F.when(time_ms >= delay_ms, (time_ms - delay_ms) % F.lit(cycle_ms))


def date_key(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd")


def ordinal_date(day: Column) -> Column:
    """January 1st, 2024."""
    d = F.dayofmonth(day)
    suffix = F.when(d.between(11, 13), "th").when(d % 10 == 1, "st").when(d % 10 == 2, "nd").when(d % 10 == 3, "rd").otherwise("th")
    return F.concat(F.date_format(day, "MMMM "), d.cast("string"), suffix, F.date_format(day, ", yyyy"))


def load_condition(name: Column) -> Column:
    return F.when(name == "ballast", 1).otherwise(0)
