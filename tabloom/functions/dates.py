"""Lenient date / timestamp parsing (never raises; NULL when nothing fits)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The fallback orders tried after ISO, in this order
# (ymd, dmy, mdy, dashed and slashed, with and without H:M[:S]).
DATE_ORDERS = ["Ymd", "dmY", "mdY", "Y-m-d", "d-m-Y", "m/d/Y", "d/m/Y",
               "Ymd HMS", "Ymd HM", "dmY HMS", "dmY HM",
               "mdY HMS", "mdY HM", "Y-m-d H:M:S", "d-m-Y H:M:S"]

# Spark datetime patterns standing for each order.  An order without
# separators accepts the common separators '-', '/', '.' and none.
_SEPS = ["-", "/", ".", ""]


def _order_patterns(order: str) -> list[str]:
    date_part, _, time_part = order.partition(" ")
    tokens = {"Y": "yyyy", "m": "MM", "d": "dd"}
    if any(s in date_part for s in "-/"):
        sep = "-" if "-" in date_part else "/"
        fields = [tokens[t] for t in date_part.split(sep)]
        dates = [sep.join(fields)]
    else:
        fields = [tokens[t] for t in date_part]
        dates = [s.join(fields) for s in _SEPS]
    if not time_part:
        return dates
    if time_part in ("HMS", "H:M:S"):
        times = ["HH:mm:ss"]
    else:
        times = ["HH:mm"]
    return [f"{d} {t}" for d in dates for t in times]


def _all_patterns() -> list[str]:
    pats: list[str] = []
    for o in DATE_ORDERS:
        for p in _order_patterns(o):
            if p not in pats:
                pats.append(p)
    return pats


ISO_PATTERNS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd"]


# What the fields of a pattern can look like (a year beyond four digits has a sign)
_FIELDS = {"yyyy": "[+-]?[0-9]{4,19}", "MM": "(?:0[1-9]|1[0-2])", "dd": "(?:0[1-9]|[12][0-9]|3[01])",
           "HH": "(?:[01][0-9]|2[0-3])", "mm": "[0-5][0-9]", "ss": "[0-5][0-9]"}
_DIGITS = "^[+-]?[0-9]{2}.*[0-9]$"        # every pattern begins and ends in digits


def _shape(pattern: str) -> str:
    """Regular expression of all texts that a pattern may take, and few others."""
    parts = re.split("(yyyy|MM|dd|HH|mm|ss)", pattern)
    return "^" + "".join(_FIELDS.get(p) or re.escape(p) for p in parts) + "$"


def parse_timestamp(c: Column, fmt: str | None = None) -> Column:
    """String -> timestamp: explicit format, else ISO, else the fallback orders."""
    s = F.trim(c.cast("string"))
    if fmt:
        return F.try_to_timestamp(s, F.lit(fmt))
    # a text that fails a pattern costs an exception: only those of its shape are tried
    cands = [F.when(s.rlike(_shape(p)), F.try_to_timestamp(s, F.lit(p))) for p in dict.fromkeys(ISO_PATTERNS + _all_patterns())]
    return F.when(s.rlike(_DIGITS), F.coalesce(*cands))


def parse_date(c: Column, fmt: str | None = None) -> Column:
    return parse_timestamp(c, fmt).cast("date")


def to_date_any(c: Column, dtype: str) -> Column:
    """Date value of a column that is already a date/timestamp, or a string."""
    if dtype in ("date",):
        return c
    if dtype.startswith("timestamp"):
        return c.cast("date")
    return parse_date(c)
