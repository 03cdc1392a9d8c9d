"""Small column helpers: exact rounding of integer ratios, binding a value once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once, so that a costly expression is not repeated in the plan."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def safe_div(a: Column | str, b: Column | str) -> Column:
    """a / b, 0.0 when b is 0."""
    a, b = _col(a), _col(b)
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.nullif(b, F.lit(0)))


def round_ratio(num: Column | str, den: Column | str, places: int) -> Column:
    """num / den for non-negative integers, rounded half up; 0.0 when den is 0."""
    wide = "decimal(28,0)"
    num, den = _col(num).cast(wide), _col(den).cast(wide)
    doubled = F.lit(2 * 10**places).cast("decimal(9,0)") * num + den
    whole = F.call_function("div", doubled, F.lit(2).cast("decimal(2,0)") * F.nullif(den, F.lit(0).cast(wide)))
    return F.coalesce(whole.cast("double") / F.lit(float(10**places)), F.lit(0.0))


def percent_text(num: Column | str, den: Column | str) -> Column:
    """`12.3%`, ties to even as printf does it."""
    num, den = _col(num), _col(den)
    scaled = num * F.lit(1000)
    q = F.floor(F.try_divide(scaled, den)).cast("bigint")
    twice = (scaled - q * den) * 2
    up = F.when((twice > den) | ((twice == den) & (F.pmod(q, F.lit(2)) == 1)), 1).otherwise(0)
    n = q + up
    return F.format_string("%d.%d%%", F.floor(n / 10).cast("bigint"), F.pmod(n, F.lit(10)))
