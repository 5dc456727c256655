"""Correct decimal rounding and fixed-point text as column expressions.

Spark's ``round`` and ``format_string('%.2f', x)`` round the shortest decimal form half-up (0.235 -> '0.24', 2.675 -> 2.68);
the reference rounds the exact binary value, half to even (0.235 is 0.23499... -> '0.23', 2.675 -> 2.67), as DuckDB's
``printf`` does.  The same result comes from an error-free product: with s = 10^decimals, p = x * s and the rounding error e of
that product (Dekker's two-product, from factors split into halves of 26 bits), p + e is the exact value.  Half-way cases of
p are settled by the sign of e, and e is too small to move any other.  All of it stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2^27 + 1
_EXACT = float(1 << 52)  # beyond, a double has no fractions left to round


def _halves(x: float) -> tuple[float, float]:
    t = _SPLIT * x
    high = t - (t - x)
    return high, x - high


def _units(a: Column, decimals: int) -> Column:
    """|x| in units of the last decimal, rounded half to even by the exact value; a whole number below 2^52."""
    s = 10.0 ** decimals
    s_high, s_low = (F.lit(v) for v in _halves(s))
    p = a * F.lit(s)
    t = a * F.lit(_SPLIT)
    high = t - (t - a)
    low = a - high
    error = ((high * s_high - p) + high * s_low + low * s_high) + low * s_low
    floor = F.floor(p).cast("double")
    tie = p - floor == 0.5
    return F.when(tie & (error > 0), floor + 1).when(tie & (error < 0), floor).otherwise(F.rint(p))


def _once(c: Column, make) -> Column:
    """``make`` of a column whose expression is evaluated once, however often it is used."""
    return F.transform(F.array(c.cast("double")), make)[0]


def round_exact(c, decimals: int) -> Column:
    """``round(x, decimals)`` as Python rounds; NULL stays NULL.  Values of 2^52 units and more stay as they are."""
    col = F.col(c) if isinstance(c, str) else c

    def make(x: Column) -> Column:
        a = F.abs(x)
        units = _units(a, decimals) / F.lit(10.0 ** decimals)
        return F.when(F.isnan(x) | (a * F.lit(10.0 ** decimals) >= F.lit(_EXACT)), x).otherwise(F.when(x < 0, -units).otherwise(units))

    return _once(col, make)


def fixed(c, decimals: int) -> Column:
    """``'%.{decimals}f' % x`` with Python rounding; NULL and NaN give NULL.  From 2^52 units on the digits are those of the
    shortest decimal form, and negative zero prints without its sign."""
    col = F.col(c) if isinstance(c, str) else c
    s = 10 ** decimals

    def text(x: Column) -> Column:
        a = F.abs(x)
        units = _units(a, decimals).cast("long")
        whole = ((units - units % F.lit(s)) / F.lit(s)).cast("decimal(20,0)").cast("string")
        digits = F.concat(whole, F.lit("."), F.lpad((units % F.lit(s)).cast("string"), decimals, "0")) if decimals else whole
        large = F.when(a == F.lit(float("inf")), F.lit("inf")).otherwise(F.format_string(f"%.{decimals}f", a))
        body = F.when(a * F.lit(float(s)) < F.lit(_EXACT), digits).otherwise(large)
        return F.when(x.isNotNull() & ~F.isnan(x), F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), body))

    return _once(col, text)
