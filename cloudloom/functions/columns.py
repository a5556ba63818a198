"""Column expressions shared by the operators: finite masks, guarded moments, labels, lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tolerances of "all close" and of a zero eigenvalue, and the slack of radius tests.
CLOSE_ABS, CLOSE_REL = 1e-8, 1e-5
ZERO_EIGENVALUE = 1e-8
RADIUS_SLACK = 1e-12


def finite(c: Column) -> Column:
    """True where c is a finite number; null counts as not finite."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def or_null(c: Column) -> Column:
    """c with NaN and infinities as null, so that aggregates skip them."""
    return F.when(finite(c), c)


def distance(ax: Column, ay: Column, az: Column, bx: Column, by: Column, bz: Column) -> Column:
    dx, dy, dz = ax - bx, ay - by, az - bz
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def close_to(c_min: Column, c_max: Column, first: Column) -> Column:
    """All values between c_min and c_max are close to the first one."""
    slack = F.lit(CLOSE_ABS) + F.lit(CLOSE_REL) * F.abs(first)
    return (c_max - first <= slack) & (first - c_min <= slack)


def number_label(value: float, style: str = "package") -> str:
    """A number in a feature name: 4 -> 4, 6.5 -> 6p5, -1 -> m1; style 'variant' keeps the point of integers: 0 -> 0p0."""
    value = float(value)
    text = f"{value:.1f}" if style == "variant" and value.is_integer() else str(int(value)) if value.is_integer() else f"{value:g}"
    return text.replace(".", "p").replace("-", "m")


def parse_numbers(text: Column, kind: str = "double") -> Column:
    """A comma-separated list as an array of numbers; blanks are skipped."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(parts, lambda x: x.try_cast(kind))


def float_list(text: str, required: bool = True) -> list[float]:
    values = [float(x) for x in text.split(",") if x.strip()]
    if required and not values:
        raise ValueError("at least one number is needed")
    return values


def short_number(value: float | None) -> str:
    """For reports: NA, three decimals, or scientific below 0.001."""
    if value is None or value != value:
        return "NA"
    return f"{value:.2e}" if 0 < abs(value) < 0.001 else f"{value:.3f}"
