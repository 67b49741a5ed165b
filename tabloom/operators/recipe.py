"""Replayable preprocessing recipe.

A recipe is a list of JSON-serialisable steps ``{id, targets, params}``.
``apply_recipe`` resolves each step's targets against the current schema,
*fits* the step with one aggregate over the current frame (moments, exact
type-7 quantiles, level counts) and *transforms* with column expressions or
a join to a per-level lookup table.  Only one row per column (or per level)
ever reaches the driver; the data stays a lazy plan, so consecutive
projections collapse into one stage.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranks
from ..functions.dates import parse_date, parse_timestamp
from ..functions.fmt import c_fixed
from ..functions.stats import inv_norm_cdf
from ..functions.types import column as _q
from ..functions.types import kind

SELECTORS = ("all", "all_numeric", "all_categorical", "all_predictors")
DATE_SAFE = ("date_features", "parse_datetime")


# Step vocabulary with default parameters.
STEP_DEFAULTS: dict[str, dict] = {
    "drop_zero_var": {}, "drop_id_like": {}, "drop_high_missing": {"threshold": 0.6},
    "impute": {}, "lump_rare": {"threshold": 0.01}, "date_features": {},
    "parse_datetime": {"format": "", "tz": "UTC", "as": "Date"},
    "yeo_johnson": {}, "log": {"offset": 0}, "log10": {"offset": 0}, "log2": {"offset": 0},
    "boxcox": {"lambda": None}, "sqrt": {}, "inverse": {}, "zscore": {}, "min_max": {},
    "robust_scale": {}, "quantile_normal": {},
    "clip": {"lower": 0.01, "upper": 0.99, "by_quantile": True},
    "bin_equal_width": {"n_bins": 5}, "bin_quantile": {"n_bins": 5},
    "target_encode": {"smoothing": 10}, "ordinal_encode": {"levels": {}},
    "frequency_encode": {}, "pca": {"n_components": 3, "var_explained": None}, "one_hot": {},
}
ALIASES = {"scale": "zscore", "winsorize": "clip", "encode": "one_hot"}


@dataclass
class Step:
    id: str
    targets: object = "all_predictors"      # selector token, list of names, or None
    params: dict = field(default_factory=dict)

    def to_dict(self) -> dict:
        return {"id": self.id, "targets": self.targets, "params": self.params}


def step(id: str, targets="all_predictors", **params) -> Step:
    base_id = ALIASES.get(id, id)
    if base_id not in STEP_DEFAULTS:
        raise ValueError(f"recipe_step: unknown id `{id}`")
    p = dict(STEP_DEFAULTS[base_id])
    p.update(params)
    return Step(id, targets, p)


def resolve_targets(s: Step, df: DataFrame, target: str | None = None,
                    time_col: str | None = None) -> list[str]:
    """Selector tokens -> names; NULL -> all predictors; explicit empty list -> none;
    the time column is removed except for date steps."""
    k = {f.name: kind(f.dataType) for f in df.schema.fields}
    tgt = s.targets if s.targets is not None else "all_predictors"
    if isinstance(tgt, str) and tgt in SELECTORS:
        cols = {"all_numeric": [c for c in df.columns if k[c] == "numeric"],
                "all_categorical": [c for c in df.columns if k[c] == "string"],
                "all_predictors": [c for c in df.columns if c != target],
                "all": list(df.columns)}[tgt]
    else:
        names = [tgt] if isinstance(tgt, str) else list(tgt)
        cols = [c for c in names if c in df.columns]
    if time_col and s.id not in DATE_SAFE:
        cols = [c for c in cols if c != time_col]
    return cols


def scope_columns(s: Step, cols: list[str], scope: list[str] | None) -> list[str]:
    used_token = isinstance(s.targets, str) and s.targets in SELECTORS
    if scope and used_token:
        return [c for c in cols if c in scope]
    return cols


# ----------------------------------------------------------------- helpers

def _replace(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """Replace columns in place, keeping their position."""
    return df.select(*[exprs[c].alias(c) if c in exprs else _q(c) for c in df.columns])


def _num(c: str) -> Column:
    return _q(c).cast("double")


def _one_row(df: DataFrame, aggs: list[Column]) -> dict:
    return df.agg(*aggs).first().asDict() if aggs else {}


def exact_quantile_values(df: DataFrame, cols: list[str], probs: list[float]) -> dict[str, list]:
    """Type-7 quantiles for several columns in one distributed pass."""
    if not cols:
        return {}
    items = [F.struct(F.lit(c).alias("column"), _num(c).alias("x")) for c in cols]
    long = df.select(F.inline(F.array(*items)))
    q = ranks.exact_quantiles(long, ["column"], "x", probs).collect()
    out = {c: [None] * len(probs) for c in cols}
    for r in q:
        out[r["column"]][min(range(len(probs)), key=lambda i: abs(probs[i] - r["p"]))] = r["q"]
    return out


def join_lookup(df: DataFrame, lut: DataFrame, on: list[str] | str, how: str = "left") -> DataFrame:
    """Join a per-level table: broadcast where it is small, by level where it isn't."""
    return ranks.attach_groups(df, lut, on, how)


def level_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(_q(col).cast("string").alias("_lvl")).agg(F.count(F.lit(1)).alias("_cnt"))


def modes(df: DataFrame, cols: list[str]) -> dict[str, str | None]:
    """Most frequent non-NULL value per column, ties -> alphabetically first."""
    if not cols:
        return {}
    items = [F.struct(F.lit(c).alias("column"), _q(c).cast("string").alias("v")) for c in cols]
    vc = (df.select(F.inline(F.array(*items))).where(F.col("v").isNotNull())
          .groupBy("column", "v").agg(F.count(F.lit(1)).alias("n")))
    top = ranks.top_k_per_group(vc, ["column"], [F.desc("n"), F.asc("v")], 1).collect()
    out = {c: None for c in cols}
    for r in top:
        out[r["column"]] = r["v"]
    return out


_R_FMT = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss",
          "%b": "MMM", "%B": "MMMM", "%e": "d", "%j": "DDD"}


def r_format_to_spark(fmt: str) -> str:
    out, i = [], 0
    while i < len(fmt):
        tok = fmt[i:i + 2]
        if tok in _R_FMT:
            out.append(_R_FMT[tok])
            i += 2
        else:
            ch = fmt[i]
            out.append(f"'{ch}'" if ch.isalpha() else ch)
            i += 1
    return "".join(out)


# ----------------------------------------------------------------- apply

def apply_recipe(df: DataFrame, steps: list, target: str | None = None, time_col: str | None = None,
                 scope: list[str] | None = None, fit_on: DataFrame | None = None):
    """Apply steps in order.  Returns ``(DataFrame, log lines)``.  ``fit_on``
    (default: the data itself) supplies the rows the statistics are fitted on."""
    log: list[str] = []
    for raw in steps:
        s = raw if isinstance(raw, Step) else Step(raw["id"], raw.get("targets", "all_predictors"),
                                                   dict(raw.get("params") or {}))
        sid = ALIASES.get(s.id, s.id)
        if sid not in STEP_DEFAULTS:
            log.append(f"UNKNOWN step `{s.id}` -> ignored")
            continue
        p = dict(STEP_DEFAULTS[sid])
        p.update(s.params or {})
        tg = scope_columns(s, resolve_targets(s, df, target, time_col), scope)
        if not tg:
            log.append(f"{s.id} -> no eligible columns (skipped)")
            continue
        fit = df if fit_on is None else fit_on
        df, msg = _STEPS[sid](df, fit, tg, p, target=target, time_col=time_col, sid=s.id, log=log)
        if fit_on is not None:
            fit_on, _ = _STEPS[sid](fit_on, fit_on, [c for c in tg if c in fit_on.columns], p,
                                    target=target, time_col=time_col, sid=s.id, log=[])
        log.append(msg)
    return df, log


def _drop(df, fit, tg, p, sid, **_):
    return df.drop(*tg), f"{sid} -> dropped {len(tg)} cols"


def _impute(df, fit, tg, p, **_):
    k = {f.name: kind(f.dataType) for f in df.schema.fields}
    nulls = _one_row(fit, [F.count_if(_q(c).isNull()).alias(c) for c in tg])
    todo = [c for c in tg if nulls.get(c, 0) > 0]
    nums = [c for c in todo if k[c] == "numeric"]
    cats = [c for c in todo if k[c] != "numeric"]
    med = exact_quantile_values(fit, nums, [0.5])
    mode = modes(fit, cats)
    ex = {}
    for c in nums:
        m = med[c][0]
        if m is not None:
            keep_type = float(m).is_integer()
            base = _q(c) if keep_type else _num(c)
            ex[c] = F.coalesce(base, F.lit(m).cast(df.schema[c].dataType) if keep_type else F.lit(m))
    for c in cats:
        if mode[c] is not None:
            ex[c] = F.coalesce(_q(c), F.lit(mode[c]).cast(df.schema[c].dataType))
    return _replace(df, ex), f"impute -> filled {len(tg)} cols"


def _lump(df, fit, tg, p, **_):
    thr = float(p.get("threshold", 0.01))
    n = fit.count()  # shares use every row, NULLs included
    out = df
    for c in tg:
        rare = (level_counts(fit, c).where(F.col("_lvl").isNotNull() & (F.col("_cnt") / F.lit(float(n)) < thr))
                .select(F.col("_lvl").alias(f"_rare_{c}"), F.lit(True).alias(f"_israre_{c}")))
        out = join_lookup(out, rare, _q(c).cast("string") == _q(f"_rare_{c}"))
        out = out.withColumn(c, F.when(_q(f"_israre_{c}"), F.lit("Other")).otherwise(_q(c).cast("string")))
        out = out.drop(f"_rare_{c}", f"_israre_{c}")
    return out, f"lump_rare -> processed {len(tg)} cols"


def _date_features(df, fit, tg, p, time_col=None, **_):
    k = {f.name: kind(f.dataType) for f in df.schema.fields}
    parsed = {}
    str_cols = [c for c in tg if k[c] == "string"]
    ok = _one_row(fit, [F.count_if(parse_date(_q(c)).isNotNull()).alias(c) for c in str_cols])
    skipped = 0
    for c in tg:
        if k[c] == "string" and ok.get(c, 0) == 0:
            skipped += 1
            continue
        if k[c] in ("date", "timestamp", "string"):
            parsed[c] = _q(c).cast("date") if k[c] != "string" else parse_date(_q(c))
        else:
            skipped += 1
    cols = []
    for c in df.columns:
        if c in parsed:
            d = parsed[c]
            if c == time_col:
                cols.append(_q(c) if k[c] != "string" else d.alias(c))
            dow = F.dayofweek(d)  # Sunday=1
            iso = ((dow + 5) % 7) + 1
            cols += [F.year(d).alias(f"{c}_year"), F.month(d).alias(f"{c}_month"), iso.alias(f"{c}_dow"),
                     F.weekofyear(d).alias(f"{c}_week"), F.quarter(d).alias(f"{c}_qtr"),
                     F.when(iso.isin(6, 7), 1).otherwise(0).alias(f"{c}_is_weekend"),
                     F.unix_date(d).alias(f"{c}_days_since_epoch")]
        else:
            cols.append(_q(c))
    extra = f" ({skipped} unparsed; check parse_datetime)" if skipped else ""
    return df.select(*cols), f"date_features -> expanded {len(tg)} cols{extra}"


def _parse_datetime(df, fit, tg, p, **_):
    k = {f.name: kind(f.dataType) for f in df.schema.fields}
    fmt = p.get("format") or ""
    sfmt = r_format_to_spark(fmt) if fmt else None
    as_kind = str(p.get("as", "Date")).lower()
    ex = {}
    for c in tg:
        if k[c] in ("date", "timestamp"):
            continue
        if as_kind in ("posix", "posixct", "datetime"):
            ex[c] = parse_timestamp(_q(c), sfmt)
        else:
            ex[c] = parse_date(_q(c), sfmt)
    chk = _one_row(df.select(*[ex[c].alias(f"v_{c}") for c in ex], *[_q(c) for c in ex]),
                   [F.count_if(F.col(f"v_{c}").isNotNull()).alias(f"ok_{c}") for c in ex]
                   + [F.count_if(_q(c).isNotNull()).alias(f"in_{c}") for c in ex])
    failed = sum(1 for c in ex if chk[f"ok_{c}"] == 0 and chk[f"in_{c}"] > 0)
    extra = f" ({failed} unparsed)" if failed else ""
    return _replace(df, ex), f"parse_datetime -> coerced {len(tg)} cols{extra}"


def _yeo(df, fit, tg, p, **_):
    ex = {c: F.signum(_num(c)) * F.log1p(F.abs(_num(c))) for c in tg}
    return _replace(df, ex), f"yeo_johnson -> transformed {len(tg)} cols"


def _log(df, fit, tg, p, sid, log, **_):
    offset = float(p.get("offset") or 0)
    st = _one_row(fit, [a for c in tg for a in (F.count_if(_num(c) == 0).alias(f"z_{c}"), F.min(_num(c)).alias(f"m_{c}"))])
    fn = {"log": F.log, "log10": F.log10, "log2": F.log2}[sid]
    ex = {}
    for c in tg:
        eff = offset
        if st[f"z_{c}"] > 0 and eff == 0:
            eff = 1.0
        mn = st[f"m_{c}"]
        if mn is not None and mn + eff <= 0:
            log.append(f"{sid} -> {c} contains non-positive values; min shifted")
            eff = eff - mn + 1e-9
        ex[c] = fn(_num(c) + F.lit(eff))
    return _replace(df, ex), f"{sid} -> transformed {len(tg)} cols"


def boxcox_lambda(fit: DataFrame, c: str, lo: float = -2.0, hi: float = 2.0, rounds: int = 6,
                  grid: int = 9) -> float:
    """Maximise (l-1) sum(ln x) - n/2 ln var(x_l) on [lo, hi].  Each round is ONE
    aggregate evaluating ``grid`` candidate lambdas; the bracket then shrinks
    around the best one."""
    x = _num(c)
    base = _one_row(fit, [F.count(F.lit(1)).alias("n"), F.sum(F.log(x)).alias("sl")])
    n, sl = base["n"], base["sl"] or 0.0
    a, b = lo, hi
    best = 0.0
    for _ in range(rounds):
        lams = [a + (b - a) * i / (grid - 1) for i in range(grid)]
        aggs = [F.var_samp(F.log(x) if abs(l) < 1e-9 else (F.pow(x, F.lit(l)) - 1) / l).alias(f"v{i}")
                for i, l in enumerate(lams)]
        v = _one_row(fit, aggs)
        scores = []
        for i, l in enumerate(lams):
            vi = v[f"v{i}"]
            scores.append(math.inf if (vi is None or not math.isfinite(vi) or vi <= 0)
                          else -((l - 1) * sl - n / 2.0 * math.log(vi)))
        j = min(range(grid), key=lambda i: scores[i])
        best = lams[j]
        step_w = (b - a) / (grid - 1)
        a, b = max(lo, best - step_w), min(hi, best + step_w)
    return best


def _boxcox(df, fit, tg, p, log, **_):
    lam_in = p.get("lambda")
    neg = _one_row(fit, [F.count_if(_num(c) <= 0).alias(c) for c in tg])
    ex, done, skipped = {}, 0, 0
    for c in tg:
        if neg[c] > 0:
            log.append(f"boxcox -> {c} has non-positive values; skipped")
            skipped += 1
            continue
        lam = float(lam_in) if lam_in is not None and math.isfinite(float(lam_in)) else boxcox_lambda(fit, c)
        ex[c] = F.log(_num(c)) if abs(lam) < 1e-9 else (F.pow(_num(c), F.lit(lam)) - 1) / lam
        done += 1
    return _replace(df, ex), f"boxcox -> transformed {done} / skipped {skipped}"


def _sqrt(df, fit, tg, p, **_):
    return _replace(df, {c: F.sqrt(F.greatest(_num(c), F.lit(0.0))) for c in tg}), f"sqrt -> transformed {len(tg)} cols"


def _inverse(df, fit, tg, p, **_):
    return (_replace(df, {c: F.lit(1.0) / F.nullif(_num(c), F.lit(0.0)) for c in tg}),
            f"inverse -> transformed {len(tg)} cols")


def _moments(fit, tg):
    return _one_row(fit, [a for c in tg for a in (F.avg(_num(c)).alias(f"m_{c}"), F.stddev_samp(_num(c)).alias(f"s_{c}"))])


def _zscore(df, fit, tg, p, **_):
    st = _moments(fit, tg)
    ex = {}
    for c in tg:
        m, s = st[f"m_{c}"], st[f"s_{c}"]
        if s is not None and math.isfinite(s) and s > 0:
            ex[c] = (_num(c) - F.lit(m)) / F.lit(s)
    return _replace(df, ex), f"zscore -> standardized {len(tg)} cols"


def _min_max(df, fit, tg, p, **_):
    st = _one_row(fit, [a for c in tg for a in (F.min(_num(c)).alias(f"a_{c}"), F.max(_num(c)).alias(f"b_{c}"))])
    ex = {}
    for c in tg:
        a, b = st[f"a_{c}"], st[f"b_{c}"]
        if a is not None and b is not None and b > a:
            ex[c] = (_num(c) - F.lit(a)) / F.lit(b - a)
    return _replace(df, ex), f"min_max -> scaled {len(tg)} cols"


def _robust(df, fit, tg, p, **_):
    q = exact_quantile_values(fit, tg, [0.25, 0.5, 0.75])
    st = _moments(fit, tg)
    ex = {}
    for c in tg:
        q1, med, q3 = q[c]
        if q1 is not None and q3 - q1 > 0:
            ex[c] = (_num(c) - F.lit(med)) / F.lit(q3 - q1)
        else:
            s = st[f"s_{c}"]
            if s is not None and math.isfinite(s) and s > 0:
                ex[c] = (_num(c) - F.lit(st[f"m_{c}"])) / F.lit(s)
    return _replace(df, ex), f"robust_scale -> processed {len(tg)} cols"


def _quantile_normal(df, fit, tg, p, **_):
    out = df
    for c in tg:
        n = _one_row(fit, [F.count(_q(c)).alias("n")])["n"]
        vc = ranks.value_weights(fit, [], _num(c))
        cum = ranks.with_cumulative(vc, [], "value", "w")
        lut = cum.select(F.col("value").alias(f"_qv_{c}"),
                         inv_norm_cdf((F.col("cum_before") + (F.col("w") + 1) / 2.0) / F.lit(n + 1)).alias(f"_qz_{c}"))
        out = join_lookup(out, lut, _num(c) == F.col(f"_qv_{c}"))
        out = out.withColumn(c, F.when(_q(c).isNull(), F.lit(None).cast("double")).otherwise(_q(f"_qz_{c}")))
        out = out.drop(f"_qv_{c}", f"_qz_{c}")
    return out, f"quantile_normal -> mapped {len(tg)} cols"


def _clip(df, fit, tg, p, **_):
    lo, hi = float(p.get("lower", 0.01)), float(p.get("upper", 0.99))
    by_q = bool(p.get("by_quantile", True))
    q = exact_quantile_values(fit, tg, [lo, hi]) if by_q else {c: [lo, hi] for c in tg}
    ex = {}
    for c in tg:
        a, b = q[c]
        if a is None:
            continue
        ex[c] = F.when(_num(c) < a, F.lit(a)).when(_num(c) > b, F.lit(b)).otherwise(_num(c))
    return _replace(df, ex), f"clip -> bounded {len(tg)} cols"


def equal_width_breaks(lo: float, hi: float, n: int) -> list[float]:
    """Breaks of R ``cut(x, n)``: n equal bins, outer breaks widened by range/1000."""
    if hi == lo:
        d = abs(lo) / 1000 if lo != 0 else 1 / 1000
        return [lo - d + (2 * d) * i / n for i in range(n + 1)]
    by = (hi - lo) / n
    br = [lo + i * by for i in range(n + 1)]
    dx = hi - lo
    br[0], br[-1] = lo - dx / 1000, hi + dx / 1000
    return br


def bin_index(x: Column, breaks: list[float]) -> Column:
    """1-based right-closed bin of ``x`` (first bin includes its lower edge)."""
    arr = F.array(*[F.lit(float(b)) for b in breaks])
    idx = F.size(F.filter(arr, lambda b: b < x))
    return F.when(x.isNull(), F.lit(None)).otherwise(F.least(F.greatest(idx, F.lit(1)), F.lit(len(breaks) - 1)))


def _bin_equal(df, fit, tg, p, **_):
    n = max(2, int(p.get("n_bins", 5)))
    st = _one_row(fit, [a for c in tg for a in (F.min(_num(c)).alias(f"a_{c}"), F.max(_num(c)).alias(f"b_{c}"))])
    ex = {}
    for c in tg:
        if st[f"a_{c}"] is None:
            continue
        ex[c] = bin_index(_num(c), equal_width_breaks(st[f"a_{c}"], st[f"b_{c}"], n))
    return _replace(df, ex), f"bin_equal_width -> {n} bins on {len(tg)} cols"


def _bin_quantile(df, fit, tg, p, **_):
    n = max(2, int(p.get("n_bins", 5)))
    probs = [i / n for i in range(n + 1)]
    q = exact_quantile_values(fit, tg, probs)
    ex = {}
    for c in tg:
        br = []
        for v in q[c]:
            if v is not None and v not in br:
                br.append(v)
        if len(br) < 3:
            continue
        ex[c] = bin_index(_num(c), br)
    return _replace(df, ex), f"bin_quantile -> {n} bins on {len(tg)} cols"


def _target_encode(df, fit, tg, p, target=None, log=None, **_):
    if not target or target not in df.columns:
        return df, "target_encode -> no target available; skipped"
    m = float(p.get("smoothing", 10))
    is_class = kind(df.schema[target].dataType) != "numeric"
    if is_class:
        top = modes(fit, [target])[target]
        yv = F.when(_q(target).isNull(), F.lit(None)).otherwise((_q(target).cast("string") == F.lit(top)).cast("double"))
    else:
        yv = _num(target)
    gm = _one_row(fit, [F.avg(yv).alias("gm")])["gm"]
    out = df
    for c in tg:
        if c == target:
            continue
        lut = (fit.where(_q(c).isNotNull()).groupBy(_q(c).cast("string").alias(f"_te_{c}"))
               .agg(F.avg(yv).alias("_mu"), F.count(F.lit(1)).alias("_n"))
               .select(f"_te_{c}", ((F.col("_mu") * F.col("_n") + F.lit(gm) * m) / (F.col("_n") + m)).alias(f"_tv_{c}")))
        out = join_lookup(out, lut, _q(c).cast("string") == _q(f"_te_{c}"))
        out = out.withColumn(c, F.coalesce(_q(f"_tv_{c}"), F.lit(gm))).drop(f"_te_{c}", f"_tv_{c}")
    return out, f"target_encode -> encoded {len(tg)} cols"


def _ordinal(df, fit, tg, p, **_):
    lv = p.get("levels") or {}
    ex = {}
    for c in tg:
        if isinstance(lv, dict) and lv.get(c):
            order = [str(v) for v in lv[c]]
        elif isinstance(lv, (list, tuple)) and lv:
            order = [str(v) for v in lv]
        else:
            order = [r[0] for r in fit.where(_q(c).isNotNull()).select(_q(c).cast("string")).distinct()
                     .orderBy(1).collect()]
        arr = F.array(*[F.lit(v) for v in order])
        pos = F.array_position(arr, _q(c).cast("string"))
        ex[c] = F.when(pos > 0, pos.cast("int"))
    return _replace(df, ex), f"ordinal_encode -> encoded {len(tg)} cols"


def _frequency(df, fit, tg, p, **_):
    out = df
    n = fit.count()
    for c in tg:
        lut = level_counts(fit, c).where(F.col("_lvl").isNotNull()).select(
            F.col("_lvl").alias(f"_fe_{c}"), (F.col("_cnt") / F.lit(float(n))).alias(f"_fv_{c}"))
        out = join_lookup(out, lut, _q(c).cast("string") == _q(f"_fe_{c}"))
        out = out.withColumn(c, _q(f"_fv_{c}")).drop(f"_fe_{c}", f"_fv_{c}")
    return out, f"frequency_encode -> encoded {len(tg)} cols"


def _pca(df, fit, tg, p, log, **_):
    import numpy as np
    k = {f.name: kind(f.dataType) for f in df.schema.fields}
    nums = [c for c in tg if k[c] == "numeric"]
    if len(nums) < 2:
        return df, "pca -> need at least 2 numeric columns; skipped"
    st = _one_row(fit, [a for c in nums for a in (F.count_if(_q(c).isNull()).alias(f"z_{c}"),
                                                   F.avg(_num(c)).alias(f"m_{c}"), F.stddev_samp(_num(c)).alias(f"s_{c}"))])
    use = [c for c in nums if st[f"z_{c}"] == 0 and st[f"s_{c}"] is not None and st[f"s_{c}"] > 0]
    if len(use) < 2:
        return df, "pca -> not enough variance; skipped"
    z = {c: (_num(c) - F.lit(st[f"m_{c}"])) / F.lit(st[f"s_{c}"]) for c in use}
    aggs = [F.sum(z[a] * z[b]).alias(f"c_{i}_{j}") for i, a in enumerate(use) for j, b in enumerate(use) if j >= i]
    cc = _one_row(fit, aggs + [F.count(F.lit(1)).alias("_n")])
    kk = len(use)
    C = np.zeros((kk, kk))
    for i in range(kk):
        for j in range(i, kk):
            C[i, j] = C[j, i] = cc[f"c_{i}_{j}"] / (cc["_n"] - 1)
    val, vec = np.linalg.eigh(C)
    order = np.argsort(val)[::-1]
    val, vec = val[order], vec[:, order]
    for j in range(kk):  # sign convention: largest |loading| positive
        if vec[np.argmax(np.abs(vec[:, j])), j] < 0:
            vec[:, j] = -vec[:, j]
    n_comp = int(p.get("n_components") or 3)
    ve = p.get("var_explained")
    if ve is not None and math.isfinite(float(ve)):
        cum = np.cumsum(val) / np.sum(val)
        hits = np.where(cum >= float(ve))[0]
        n_comp = max(1, int(hits[0]) + 1 if len(hits) else kk)
    n_comp = min(n_comp, kk)
    pcs = []
    for j in range(n_comp):
        e = None
        for i, c in enumerate(use):
            term = z[c] * F.lit(float(vec[i, j]))
            e = term if e is None else e + term
        pcs.append(e.alias(f"pca_{j + 1}"))
    out = df.select(*[_q(c) for c in df.columns if c not in use], *pcs)
    return out, f"pca -> {kk} cols -> {n_comp} components"


def _one_hot(df, fit, tg, p, **_):
    """Levels of all target columns in one job (one row a level reaches the
    driver, as many as columns are made); each level becomes a 0/1 column."""
    long = fit.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), _q(c).cast("string").alias("l"))
                                         for c in tg])))
    rows = long.where(F.col("l").isNotNull()).distinct().collect()
    levels = {c: [] for c in tg}
    for r in rows:
        levels[r["column"]].append(r["l"])
    for c in tg:
        levels[c].sort()
    out_cols = [_q(c) for c in df.columns if not (c in levels and len(levels[c]) > 1)]
    for c in tg:
        if len(levels[c]) > 1:
            for lv in levels[c]:
                out_cols.append(F.when(_q(c).cast("string") == F.lit(lv), 1).otherwise(0).alias(f"{c}_{lv}"))
    return df.select(*out_cols), f"one_hot -> encoded {len(tg)} cols"


_STEPS = {
    "drop_zero_var": _drop, "drop_id_like": _drop, "drop_high_missing": _drop,
    "impute": _impute, "lump_rare": _lump, "date_features": _date_features,
    "parse_datetime": _parse_datetime, "yeo_johnson": _yeo,
    "log": _log, "log10": _log, "log2": _log, "boxcox": _boxcox, "sqrt": _sqrt, "inverse": _inverse,
    "zscore": _zscore, "min_max": _min_max, "robust_scale": _robust, "quantile_normal": _quantile_normal,
    "clip": _clip, "bin_equal_width": _bin_equal, "bin_quantile": _bin_quantile,
    "target_encode": _target_encode, "ordinal_encode": _ordinal, "frequency_encode": _frequency,
    "pca": _pca, "one_hot": _one_hot,
}


# ----------------------------------------------------------------- step lists

def _skewed(r) -> bool:
    return bool(r["is_numeric"]) and r["skew"] is not None and abs(r["skew"]) > 1


# The default recipe as data: option that switches a rule on (and its default), step, which
# profile rows it takes, whether the target may be among them, parameters (names in braces
# are options).
DEFAULT_RULES = (
    ("drop_zero_var", True, "drop_zero_var", lambda r, o: r["is_constant"], True, {}),
    ("drop_id_like", True, "drop_id_like", lambda r, o: r["is_id_like"], False, {}),
    ("drop_high_missing", True, "drop_high_missing",
     lambda r, o: r["pct_missing"] > 100 * o["high_missing_threshold"], True, {"threshold": "{high_missing_threshold}"}),
    ("impute", True, "impute", lambda r, o: r["n_missing"], True, {}),
    ("lump_rare", True, "lump_rare", lambda r, o: r["n_unique"] > 6 and not r["is_numeric"], True,
     {"threshold": "{rare_threshold}"}),
    ("add_date_feat", True, "date_features", lambda r, o: any(x in r["class"] for x in ("Date", "POSIX")), True, {}),
    ("yeo_johnson", True, "yeo_johnson", lambda r, o: _skewed(r), True, {}),
    ("winsorize", False, "clip", lambda r, o: r["is_numeric"], True, {"lower": 0.01, "upper": 0.99, "by_quantile": True}),
    ("scale", True, "zscore", lambda r, o: r["is_numeric"], False, {}),
    ("encode_cats", True, "one_hot", lambda r, o: not r["is_numeric"], False, {}),
)


def default_steps(profile_rows: list[dict], target: str | None = None, **options) -> list[Step]:
    """Ordered defaults built from a (collected, one-row-per-column) profile: every rule of
    ``DEFAULT_RULES`` that the options leave on, applied to the rows that it takes."""
    chosen = {"rare_threshold": 0.01, "high_missing_threshold": 0.6} | {r[0]: r[1] for r in DEFAULT_RULES} | options
    filled = lambda v: chosen[v[1:-1]] if isinstance(v, str) and v[:1] == "{" else v
    return [step(name, [r["column"] for r in profile_rows if takes(r, chosen) and (with_target or r["column"] != target)],
                 **{k: filled(v) for k, v in params.items()})
            for option, _, name, takes, with_target, params in DEFAULT_RULES if chosen[option]]


def suggest_steps(profile: DataFrame) -> DataFrame:
    """Rule-based suggestion per column (first rule that fires), as a DataFrame."""
    sk = F.col("skew")
    action = (F.when(F.col("is_constant"), "drop_zero_var").when(F.col("is_id_like"), "drop_id_like")
              .when(F.col("pct_missing") > 60, "drop_high_missing")
              .when(sk.isNotNull() & (F.abs(sk) > 1.5), "yeo_johnson")
              .when(F.col("pct_missing") > 0, "impute"))
    reason = (F.when(F.col("is_constant"), F.lit("zero variance"))
              .when(F.col("is_id_like"), F.lit("ID-like (one value per row)"))
              .when(F.col("pct_missing") > 60, F.concat(c_fixed(F.col("pct_missing"), 0), F.lit("% missing")))
              .when(sk.isNotNull() & (F.abs(sk) > 1.5), F.concat(F.lit("skew="), c_fixed(sk, 2)))
              .when(F.col("pct_missing") > 0, F.concat(c_fixed(F.col("pct_missing"), 1), F.lit("% missing"))))
    return profile.select("column", action.alias("action"), reason.alias("reason")).where(F.col("action").isNotNull())


def drop_high_missing(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Drop columns whose missing share exceeds ``threshold`` (one aggregate)."""
    r = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(_q(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    n = r["_n"] or 0
    keep = [c for i, c in enumerate(df.columns) if n == 0 or (n - r[f"c{i}"]) / n <= threshold]
    return df.select(*keep)


def make_names(s: str) -> str:
    """Syntactically valid name: invalid characters become '.', an 'X' prefix
    when the name does not start with a letter (or a dot not followed by a digit)."""
    import re
    out = re.sub(r"[^A-Za-z0-9._]", ".", s)
    if not re.match(r"^([A-Za-z]|\.(?![0-9]))", out):
        out = "X" + out
    return out


def quick_recipe(df: DataFrame, options: list[str], target: str | None, order_cols: list[str],
                 keys: list[str] = (), time_col: str | None = None) -> DataFrame:
    """The legacy seven-option pipeline in its fixed order: drop >50 % missing
    columns, impute numeric medians, impute categorical modes, dummy-encode,
    scale, target lags 1-3, 7-row rolling mean, then keep complete rows.
    Dummy names follow make.names with '.' written as '_' (Spark column
    paths treat '.' as struct access)."""
    from . import series
    k = lambda d: {f.name: kind(f.dataType) for f in d.schema.fields}
    if "drop_high_na" in options:
        df = drop_high_missing(df, 0.5)
    if "impute_num" in options:
        nums = [c for c, t in k(df).items() if t == "numeric"]
        df, _ = apply_recipe(df, [step("impute", nums)]) if nums else (df, [])
    if "impute_cat" in options:
        cats = [c for c, t in k(df).items() if t == "string"]
        df, _ = apply_recipe(df, [step("impute", cats)]) if cats else (df, [])
    if "dummy" in options:
        cats = [c for c, t in k(df).items() if t == "string" and c not in (target, time_col)]
        for c in cats:
            levels = [r[0] for r in df.where(_q(c).isNotNull()).select(c).distinct().orderBy(c).collect()]
            df = df.select(*[_q(x) for x in df.columns if x != c],
                           *[F.when(_q(c) == lv, 1).otherwise(0).alias(f"{c}_{make_names(c + lv).replace('.', '_')}") for lv in levels])
    if "scale" in options:
        nums = [c for c, t in k(df).items() if t == "numeric" and c != target and c not in keys and c not in order_cols]
        df, _ = apply_recipe(df, [step("zscore", nums)]) if nums else (df, [])
    numeric_target = target in df.columns and k(df)[target] == "numeric"
    if "lags" in options and numeric_target:
        df = series.lag_features(df, target, order_cols, keys, [1, 2, 3])
    if "rollmean" in options and numeric_target:
        df = series.rolling_mean(df, target, order_cols, keys, 7, "rollmean_7")
    return df.na.drop("any")
