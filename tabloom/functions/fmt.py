"""printf-style fixed-point text with C rounding semantics.

R's ``sprintf`` (C printf) rounds the *exact binary value* of a double, so
4.35 (really 4.34999999999999964...) prints as "4.3".  Java's formatter rounds
the shortest decimal text half-up and prints "4.4".  ``c_fixed`` reproduces C
as a JVM-side expression: the scaled value ``x * 10^d`` is split into its
rounded product and exact error (Dekker's two-product), which decides the
direction at a decimal midpoint.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2^27 + 1


def _split_const(b: float) -> tuple[float, float]:
    c = _SPLIT * b
    hi = c - (c - b)
    return hi, b - hi


def c_round(x: Column, digits: int) -> Column:
    """Round |x| * 10^digits to an integer the way C printf does (ties to even on
    exact binary ties), returning the signed rounded value / 10^digits."""
    s = float(10 ** digits)
    a = F.abs(x.cast("double"))
    p = a * F.lit(s)
    c = a * F.lit(_SPLIT)
    ah = c - (c - a)
    al = a - ah
    bh, bl = _split_const(s)
    e = ((ah * F.lit(bh) - p) + ah * F.lit(bl) + al * F.lit(bh)) + al * F.lit(bl)
    k = F.floor(p).cast("double")
    frac = p - k
    up = (F.when(frac > 0.5, True).when(frac < 0.5, False)
          .when(e > 0, True).when(e < 0, False)
          .otherwise(F.pmod(k, F.lit(2.0)) == 1.0))
    r = F.when(up, k + 1).otherwise(k) / F.lit(s)
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(F.when(x < 0, -r).otherwise(r))


def c_fixed(x: Column, digits: int) -> Column:
    """Text of ``sprintf('%.<digits>f', x)`` with C rounding."""
    return F.format_string(f"%.{digits}f", c_round(x, digits))


def c_general(x: Column, sig: int = 6) -> Column:
    """Text of C ``%g``.  Used only on a few summary values per column (samples,
    five-number summaries), so an Arrow-batched UDF with Python's C-semantics
    ``%g`` is cheaper than a very large codegen expression."""
    fmt = f"%.{sig}g"

    @F.pandas_udf("string")
    def g(v):
        import pandas as pd
        return pd.Series([None if (a is None or a != a) else fmt % a for a in v])

    return g(x.cast("double"))
