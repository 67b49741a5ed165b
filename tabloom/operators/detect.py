"""Schema / task detection: task type, time columns, survey roles, implicates,
Likert items, variable and value labels."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..functions.types import column as _q
from ..functions.types import kind


def detect_task_types(df: DataFrame, columns: list[str], time_col_present: bool = False) -> DataFrame:
    """Task type per candidate target column, all columns in one aggregate:
    text -> binary (2 levels) / multiclass; numeric -> count (integral, >= 0,
    > 2 distinct, max < 1e6), proportion (all in [0, 1]) or regression."""
    k = {f.name: kind(f.dataType) for f in df.schema.fields}
    aggs, items = [], []
    for i, c in enumerate(columns):
        aggs.append(F.count_distinct(_q(c)).alias(f"nd{i}"))
        if k[c] == "numeric":
            x = _q(c).cast("double")
            aggs += [F.bool_and(F.when(x.isNotNull(), x == F.floor(x))).alias(f"int{i}"),
                     F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}")]
    w = df.agg(*aggs)
    for i, c in enumerate(columns):
        nd = F.col(f"nd{i}")
        if time_col_present:
            t = F.lit("time_series")
        elif k[c] == "numeric":
            t = (F.when(F.col(f"int{i}") & (F.col(f"mn{i}") >= 0) & (nd > 2) & (F.col(f"mx{i}") < 1e6), "count")
                 .when((F.col(f"mn{i}") >= 0) & (F.col(f"mx{i}") <= 1), "proportion").otherwise("regression"))
        elif k[c] in ("string", "logical"):
            t = F.when(nd == 2, "binary_classification").otherwise("multiclass_classification")
        else:
            t = F.lit("regression")
        items.append(F.struct(F.lit(c).alias("column"), t.alias("task_type")))
    return w.select(F.inline(F.array(*items)))


def detect_time_columns(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Date/timestamp columns, plus text columns where >= 80 % of non-empty values
    parse as a date (full scan, one aggregate for all text columns)."""
    k = {f.name: kind(f.dataType) for f in df.schema.fields}
    items = []
    text = [c for c in df.columns if k[c] == "string"]
    aggs = []
    for i, c in enumerate(text):
        s = _q(c)
        ok = s.isNotNull() & (F.length(s) > 0)
        aggs += [F.count_if(ok).alias(f"n{i}"), F.count_if(ok & parse_date(s).isNotNull()).alias(f"p{i}")]
    w = df.agg(*aggs) if aggs else df.sparkSession.range(1)
    for c in df.columns:
        if k[c] in ("date", "timestamp"):
            items.append(F.struct(F.lit(c).alias("column"), F.lit(True).alias("is_time"), F.lit(1.0).alias("parse_rate")))
        elif k[c] == "string":
            i = text.index(c)
            rate = F.col(f"p{i}") / F.col(f"n{i}")
            items.append(F.struct(F.lit(c).alias("column"), (F.coalesce(rate, F.lit(0.0)) >= threshold).alias("is_time"),
                                  rate.cast("double").alias("parse_rate")))
        else:
            items.append(F.struct(F.lit(c).alias("column"), F.lit(False).alias("is_time"),
                                  F.lit(None).cast("double").alias("parse_rate")))
    return w.select(F.inline(F.array(*items)))


# Name / label patterns for survey design roles (EN/DE).
SURVEY_ROLE_PATTERNS = {
    "weight": ["weight", r"\bwt\b", "gewicht", "hochrechnung"],
    "strata": ["strata", "stratum", "schicht"],
    "psu": ["psu", "cluster", "primary sampling"],
    "id": ["^id$", "persnr", "hhnr", "respondent", "caseid"],
    "wave": ["wave", "welle", "period", "^year$", r"\byr\b"],
}


def detect_survey_columns(df: DataFrame) -> DataFrame:
    """(role, column) for every column whose name or variable label matches."""
    rows = []
    for role, pats in SURVEY_ROLE_PATTERNS.items():
        pat = re.compile("|".join(pats))
        for f in df.schema.fields:
            label = (f.metadata or {}).get("label", "") or ""
            if pat.search(f.name.lower()) or pat.search(label.lower()):
                rows.append((role, f.name))
    return df.sparkSession.createDataFrame(rows, "role string, column string")


LONG_IMPLICATE_COLUMNS = ["implicate", "imputation", "imp", "imp_id"]
WIDE_IMPLICATE_PATTERN = re.compile(r"(_imp|_i)([0-9]+)$")


def detect_implicates(df: DataFrame) -> dict:
    """Long form: first of implicate/imputation/imp/imp_id with >= 2 values.
    Wide form: base columns with suffix ``_impN`` / ``_iN`` for >= 2 N."""
    lower = {c.lower(): c for c in df.columns}
    for cand in LONG_IMPLICATE_COLUMNS:
        if cand in lower:
            col = lower[cand]
            m = df.agg(F.count_distinct(col).alias("m")).first()["m"]
            if m >= 2:
                return {"kind": "long", "column": col, "m": int(m)}
    groups: dict[str, dict[int, str]] = {}
    for c in df.columns:
        mt = WIDE_IMPLICATE_PATTERN.search(c)
        if mt:
            groups.setdefault(c[: mt.start()], {})[int(mt.group(2))] = c
    groups = {b: v for b, v in groups.items() if len(v) >= 2}
    if groups:
        return {"kind": "wide", "bases": {b: [v[k] for k in sorted(v)] for b, v in groups.items()},
                "m": max(len(v) for v in groups.values())}
    return {"kind": "none", "m": 0}


# The Likert keyword pattern (EN/DE), matched case-insensitively.
LIKERT_PATTERN = ("agree|disagree|neutral|nie|selten|manchmal|oft|immer|"
                  "strongly|always|never|trifft\\s*zu|stimme")


def detect_likert(df: DataFrame, columns: list[str], labels: dict | None = None) -> DataFrame:
    """Likert if 3-7 levels and (a level or value label matches the keyword
    pattern, or 5/7 levels), or numeric with 3-7 distinct integer values.
    One aggregate: per column the distinct count, an integrality flag and
    whether any level matches; distinct counts use the exact aggregate."""
    labels = labels or {}
    k = {f.name: kind(f.dataType) for f in df.schema.fields}
    aggs = []
    for i, c in enumerate(columns):
        aggs.append(F.count_distinct(c).alias(f"nd{i}"))
        if k[c] == "numeric":
            x = _q(c).cast("double")
            aggs.append(F.bool_and(F.when(x.isNotNull(), x == F.round(x))).alias(f"int{i}"))
        else:
            aggs.append(F.bool_or(F.lower(_q(c).cast("string")).rlike(LIKERT_PATTERN)).alias(f"kw{i}"))
    w = df.agg(*aggs)
    items = []
    for i, c in enumerate(columns):
        nd = F.col(f"nd{i}")
        in_range = (nd >= 3) & (nd <= 7)
        vl = list((labels.get(c) or {}).values())
        lab_kw = bool(vl) and 3 <= len(vl) <= 7 and any(
            re.search(LIKERT_PATTERN, str(v).lower()) for v in vl)
        if k[c] == "numeric":
            ok = in_range & F.coalesce(F.col(f"int{i}"), F.lit(False))
        else:
            ok = in_range & (F.coalesce(F.col(f"kw{i}"), F.lit(False)) | nd.isin(5, 7))
        ok = ok | F.lit(lab_kw)
        items.append(F.struct(F.lit(c).alias("column"), nd.cast("long").alias("n_levels"), ok.alias("is_likert")))
    return w.select(F.inline(F.array(*items)))


def horizon_label(frequency: str, h: int) -> str:
    unit = {"daily": "day", "weekly": "week", "monthly": "month", "quarterly": "quarter",
            "yearly": "year"}.get(frequency, "step")
    return f"{h} {unit}{'s' if h != 1 else ''} ahead"


def extract_labels(df: DataFrame) -> DataFrame:
    """(column, variable label, value_labels JSON) from StructField metadata."""
    rows = []
    for f in df.schema.fields:
        md = f.metadata or {}
        rows.append((f.name, md.get("label"), json.dumps(md.get("value_labels")) if md.get("value_labels") else None))
    return df.sparkSession.createDataFrame(rows, "column string, label string, value_labels string")


def harmonize_labelled(df: DataFrame, max_labels: int = 50) -> DataFrame:
    """Columns with <= 50 value labels become their label text (unlisted code ->
    NULL); the variable label stays in the metadata."""
    out = []
    for f in df.schema.fields:
        vl = (f.metadata or {}).get("value_labels")
        if vl and len(vl) <= max_labels:
            m = F.create_map(*[x for code, lab in vl.items() for x in (F.lit(str(code)), F.lit(lab))])
            key = F.col(f.name).cast("long").cast("string") if kind(f.dataType) == "numeric" else F.col(f.name)
            out.append(F.try_element_at(m, key).alias(f.name, metadata=f.metadata))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
