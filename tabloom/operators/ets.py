"""Exponential smoothing in state-space form for many series: error A/M, trend N/A/M (damped
or not), season N/A/M, chosen by AICc.

The rows of a series stand in order in one partition and are read in batches.  A batch's
series run through time together: one numpy step advances the states of every series under
every smoothing parameter of the grid, so the grid is an axis of the arrays and nothing is
looped per series.  A series that is longer than a batch carries its states into the next
one, so memory is bounded by the batch; the recursions of multiplicative models admit no
other order of work.

Whether the error is additive or relative changes only the likelihood, so both are taken
from one recursion (sum of squares, sum of squared relative errors, sum of log means).
First states come from a regression on the seasonally adjusted first rows (bounded).  With
additive error and no multiplicative part the errors are affine in the first level and
trend: two runs of the homogeneous recursion beside the main one give the quadratic form
whose minimum is taken exactly.

Result of ``ets_fit``: one row a series (or one a series and code): parameters, first and
last states, sum of squared errors, AICc.  Rows with a NULL or NaN value are left out; a
series with too few rows for a code has no row of it; multiplicative codes need positive
values."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.stats import norm_ppf
from ..session import ship_package

CODES = ("ANN", "AAN", "AAA", "MNN", "MAN", "MAM", "MMN", "MMM")    # besides ZZZ, the choice among all
BATCH_VALUES = 200_000          # rows of a batch of series
BATCH_CELLS = 2_000_000         # series x grid points of a batch
Z975 = norm_ppf(0.975)
TINY = 1e-10

# smoothing parameters: alpha, beta as a share of alpha, gamma as a share of 1 - alpha, damping
ALPHA = {"": (1e-3, .03, .06, .1, .15, .2, .25, .3, .35, .4, .45, .5, .55, .6, .65, .7, .75, .8, .85, .9, .95, .999),
         "t": (.01, .05, .1, .2, .3, .4, .5, .6, .7, .8, .9, .99), "s": (.01, .05, .1, .2, .3, .4, .55, .7, .85, .99),
         "ts": (.01, .05, .1, .2, .35, .5, .7, .95)}
BETA, GAMMA, PHI = (.001, .05, .15, .3, .6, .95), (.001, .05, .15, .3, .6), (.8, .9, .95, .98)


def structures(code: str = "ZZZ", damped: bool | None = None, season: bool = True) -> list[tuple[str, str, bool, str]]:
    """(error, trend, damped, season) that a code allows; the automatic choice leaves out
    multiplicative trends and additive error with a multiplicative season, which is unstable."""
    if code == "ZZZ":
        wanted = [(e, t, s) for e in "AM" for t in "NA" for s in ("NAM" if season else "N") if (e, s) != ("A", "M")]
    elif code in CODES:
        wanted = [tuple(code)]
    else:
        raise ValueError(f"unknown ets model {code}")
    out = []
    for e, t, s in wanted:
        for d in ((False,) if t == "N" else (False, True) if damped is None else (damped,)):
            out.append((e, t, d, s))
    return out


def grid(trend: str, damped: bool, season: str) -> np.ndarray:
    """(4, points): alpha, beta, gamma, phi."""
    kind = ("t" if trend != "N" else "") + ("s" if season != "N" else "")
    rows = [(a, a * b, (1 - a) * g, p) for a, b, g, p in itertools.product(
        ALPHA[kind], BETA if trend != "N" else (0.0,), GAMMA if season != "N" else (0.0,), PHI if damped else (1.0,))]
    return np.array(rows).T


def first_states(y: np.ndarray, m: int, trend: str, season: str) -> tuple[float, float, np.ndarray]:
    """(level, trend, seasonal indices) before the first row, from the first rows only."""
    indices = np.zeros(0)
    own = y[:max(10, 2 * m)]
    if season != "N":
        head = y[:len(y[:3 * m]) // m * m]
        t = np.arange(len(head))
        slope, cut = np.polyfit(t, head, 1) if len(head) > m else (0.0, head.mean())
        line = cut + slope * t
        raw = head - line if season == "A" else head / np.where(np.abs(line) < TINY, TINY, line)
        indices = raw.reshape(-1, m).mean(axis=0)
        indices = indices - indices.mean() if season == "A" else np.maximum(indices / max(indices.mean(), TINY), 1e-2)
        tiled = np.resize(indices, len(own))
        own = own - tiled if season == "A" else own / tiled
    if trend == "N":
        return float(own.mean()), 0.0, indices
    b, a = np.polyfit(np.arange(1, len(own) + 1), own, 1) if len(own) > 1 else (0.0, own[0])
    if trend == "A":
        return float(a), float(b), indices
    level = a if abs(a) > TINY else TINY
    return float(level), float(min(max((level + b) / level, 0.5), 2.0)), indices


class Run:
    """The recursion of one structure for a batch of series under all grid points."""

    def __init__(self, trend: str, damped: bool, season: str, m: int, first: list[tuple[float, float, np.ndarray]]):
        self.trend, self.season, self.m = trend, season, m
        self.alpha, self.beta, self.gamma, self.phi = (p[None] for p in grid(trend, damped, season))
        shape = (len(first), self.alpha.shape[1])
        self.level = np.repeat(np.array([[f[0]] for f in first], float), shape[1], axis=1)
        self.slope = np.repeat(np.array([[f[1]] for f in first], float), shape[1], axis=1)
        # one plane a season, used in turn
        self.seasons = np.repeat(np.array([f[2] for f in first], float).T[:, :, None], shape[1], axis=2) if season != "N" else None
        self.sse, self.rel, self.logs = np.zeros(shape), np.zeros(shape), np.zeros(shape)
        self.linear = season != "M" and trend != "M"
        # homogeneous runs from a unit of level and a unit of trend
        self.unit = [Unit(self, k) for k in range(1 + (trend == "A"))] if self.linear else []
        self.cross = np.zeros((len(self.unit), *shape))
        self.gram = np.zeros((len(self.unit), len(self.unit), *shape))

    def advance(self, level, slope, season, y, alpha, beta, gamma, phi):
        """(mean, error, new level, trend and seasonal index)"""
        if self.trend == "M":
            grown = np.maximum(slope, TINY) ** phi
            base = level * grown
        else:
            grown = phi * slope
            base = level + grown
        mean = base if self.season == "N" else base + season if self.season == "A" else base * season
        error = y - mean
        own = error / np.where(np.abs(season) < TINY, TINY, season) if self.season == "M" else error
        new = base + alpha * own
        if self.trend == "M":
            grown = grown + beta * own / np.where(np.abs(level) < TINY, TINY, level)
        elif self.trend == "A":
            grown = grown + beta * own
        if self.season == "A":
            season = season + gamma * error
        elif self.season == "M":
            season = season + gamma * error / np.where(np.abs(base) < TINY, TINY, base)
        return mean, error, new, grown, season

    def step(self, t: int, y: np.ndarray, n: int) -> None:
        """One row of each of the first ``n`` series; ``t`` counts rows of the series."""
        at = t % self.m
        season = self.seasons[at, :n] if self.seasons is not None else None
        mean, error, self.level[:n], self.slope[:n], new = self.advance(
            self.level[:n], self.slope[:n], season, y[:, None], self.alpha, self.beta, self.gamma, self.phi)
        if season is not None:
            self.seasons[at, :n] = new
        self.sse[:n] += error * error
        self.rel[:n] += (error / np.where(np.abs(mean) < TINY, TINY, mean)) ** 2
        self.logs[:n] += np.log(np.maximum(np.abs(mean), TINY))
        for i, u in enumerate(self.unit):
            u.step(self, at, n)
            self.cross[i, :n] += u.error[:n] * error
            for j in range(i + 1):
                self.gram[i, j, :n] += u.error[:n] * self.unit[j].error[:n]


class Unit:
    """Errors and states of the homogeneous recursion from a unit of one first state."""

    def __init__(self, run: Run, which: int):
        shape = run.level.shape
        self.level, self.slope = np.full(shape, float(which == 0)), np.full(shape, float(which == 1))
        self.seasons = np.zeros((run.m, *shape)) if run.seasons is not None else None
        self.error = np.zeros(shape)

    def step(self, run: Run, at: int, n: int) -> None:
        season = self.seasons[at, :n] if self.seasons is not None else None
        _, self.error[:n], self.level[:n], self.slope[:n], new = run.advance(
            self.level[:n], self.slope[:n], season, 0.0, run.alpha, run.beta, run.gamma, run.phi)
        if season is not None:
            self.seasons[at, :n] = new


def n_parameters(trend: str, damped: bool, season: str, m: int) -> int:
    """Smoothing parameters, first states and the error's variance."""
    return 2 + 1 + 2 * (trend != "N") + damped + (m if season != "N" else 0)


def best(run: Run, row: int, error: str, damped: bool, n: int, first: tuple) -> dict | None:
    """The grid point of least AICc for one series, its states, and its criteria."""
    k = n_parameters(run.trend, damped, run.season, run.m)
    if n - k - 1 <= 0:
        return None
    shift = np.zeros((len(run.unit), run.level.shape[1]))
    sse = run.sse[row]
    if error == "A" and run.linear:
        g = np.moveaxis(run.gram[:, :, row], -1, 0)
        g = g + np.tril(g, -1).transpose(0, 2, 1)
        c = run.cross[:, row].T
        shift = -np.einsum("gij,gj->gi", np.linalg.pinv(g, hermitian=True), c).T
        sse = np.maximum(sse + np.einsum("ig,gi->g", shift, c), 0)
    total = sse if error == "A" else run.rel[row]
    lik = n * np.log(np.maximum(total, 1e-300)) + (2 * run.logs[row] if error == "M" else 0)
    lik = np.where(np.isfinite(lik), lik, np.inf)
    i = int(lik.argmin())
    if not np.isfinite(lik[i]):
        return None
    last = n % run.m
    state = lambda own, units: float(own + sum(s[i] * u for s, u in zip(shift, units)))
    seasons = [] if run.seasons is None else [
        state(run.seasons[(last + j) % run.m, row, i], [u.seasons[(last + j) % run.m, row, i] for u in run.unit]) for j in range(run.m)]
    start = [float(s[i]) for s in shift] + [0.0, 0.0]
    return {"alpha": float(run.alpha[0, i]), "beta": float(run.beta[0, i]), "gamma": float(run.gamma[0, i]), "phi": float(run.phi[0, i]),
            "level0": first[0] + start[0], "trend0": first[1] + (start[1] if run.trend == "A" and len(shift) > 1 else 0.0),
            "season0": [float(x) for x in first[2]], "level": state(run.level[row, i], [u.level[row, i] for u in run.unit]),
            "trend": state(run.slope[row, i], [u.slope[row, i] for u in run.unit]), "season": seasons,
            "sse": float(sse[i]), "sigma2": float(total[i] / max(n - (k - 1), 1)),
            "aicc": float(lik[i] + 2 * k + 2 * k * (k + 1) / (n - k - 1)), "n": n}


FITTED = ("error string, trend_type string, season_type string, damped boolean, period int, alpha double, beta double, gamma double, "
          "phi double, level0 double, trend0 double, season0 array<double>, level double, trend double, season array<double>, "
          "sse double, sigma2 double, aicc double, n long")


class _Batch:
    """Series that run together; the last one may go on in the next batch."""

    def __init__(self, wanted: list, m: int):
        self.wanted, self.m = wanted, m
        self.shapes = sorted({w[1:] for w in wanted})
        self.reset()

    def reset(self) -> None:
        self.keys, self.values = [], []

    def solve(self, keep_last: bool, carried: tuple | None) -> tuple[list, tuple | None]:
        """(fitted rows, state of the last series if it goes on)"""
        out, carry = [], None
        lone = carried is not None
        groups = ([[0]] if lone else []) + ([[len(self.keys) - 1]] if keep_last and len(self.keys) > lone else [])
        alone = {g[0] for g in groups}
        groups.append([i for i in range(len(self.keys)) if i not in alone])
        for g in groups:
            if not g:
                continue
            before = carried if lone and g == [0] else None
            state = self.advance(g, before)
            if keep_last and g == [len(self.keys) - 1]:
                carry = state
            else:
                out += self.finish(g, state)
        return out, carry

    def advance(self, group: list[int], before: tuple | None) -> tuple:
        series = [np.array(self.values[i], float) for i in group]
        order = np.argsort([-len(s) for s in series], kind="stable")
        series = [series[i] for i in order]
        if before is None:
            counts = np.zeros(len(series), np.int64)
            firsts, runs, ok = {}, {}, {}
            for trend, damped, season in self.shapes:
                enough = [len(s) >= 2 * self.m if season != "N" else len(s) >= 1 for s in series]
                positive = [bool((s > 0).all()) for s in series]
                ok[trend, damped, season] = [e and (p or "M" not in (trend, season)) for e, p in zip(enough, positive)]
                firsts[trend, damped, season] = [
                    first_states(s, self.m, trend, season) if e else (1.0, float(trend == "M"), np.full(self.m if season != "N" else 0, float(season == "M")))
                    for s, e in zip(series, ok[trend, damped, season])]
                runs[trend, damped, season] = Run(trend, damped, season, self.m, firsts[trend, damped, season])
            least = np.array([s.min() if len(s) else np.inf for s in series])
        else:
            counts, order, firsts, runs, ok, least = before
            least = np.minimum(least, [s.min() if len(s) else np.inf for s in series])
        sizes = np.array([len(s) for s in series])
        wide = np.zeros((len(series), sizes.max(initial=0)))
        for i, s in enumerate(series):
            wide[i, :len(s)] = s
        start = int(counts[0]) if len(counts) else 0
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            for t in range(wide.shape[1]):
                n = int(np.searchsorted(-sizes, -t, side="left"))
                for run in runs.values():
                    run.step(start + t, wide[:n, t], n)
        return counts + sizes, order, firsts, runs, ok, least

    def finish(self, group: list[int], state: tuple) -> list:
        counts, order, firsts, runs, ok, least = state
        out = []
        for row, i in enumerate(order):
            for error, trend, damped, season in self.wanted:
                shape = (trend, damped, season)
                if not ok[shape][row] or (least[row] <= 0 and "M" in (error, trend, season)):
                    continue
                got = best(runs[shape], row, error, damped, int(counts[row]), firsts[shape][row])
                if got is not None:
                    out.append((*self.keys[group[i]], error, trend, season, damped, self.m, *got.values()))
        return out


def ets_fit(df: DataFrame, keys: Sequence[str], order_col: str, value: str, model: str = "ZZZ", frequency: int = 12,
            damped: bool | None = None, choose: bool = True) -> DataFrame:
    """The model of least AICc of every series among those that the code ``model`` allows (``ZZZ``: all);
    with ``choose`` false, one row for every structure."""
    ship_package(df.sparkSession)
    keys = list(keys)
    m = max(int(frequency), 1)
    wanted = [s for s in structures(model, damped, m > 1) if m > 1 or s[3] == "N"]
    if not wanted:
        raise ValueError(f"{model} needs a frequency above 1")
    cells = max(grid(t, d, s).shape[1] for _, t, d, s in wanted)
    schema = T.StructType([T.StructField(k, df.schema[k].dataType) for k in keys] + T.StructType.fromDDL(FITTED).fields)
    v = F.col(value).cast("double")
    rows = df.select(*keys, F.col(order_col).alias("_t"), v.alias("_v")).where(v.isNotNull() & ~F.isnan(v))
    rows = (rows.repartition(*keys) if keys else rows.coalesce(1)).sortWithinPartitions(*keys, "_t")

    def run(batches: Iterator[pa.RecordBatch]):
        fields = to_arrow_schema(schema)
        batch, carried, held = _Batch(wanted, m), None, 0

        def emit(found):
            return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*found), fields)], schema=fields)
        for b in batches:
            names = zip(*(b.column(i).to_pylist() for i in range(len(keys)))) if keys else itertools.repeat((), b.num_rows)
            for key, y in zip(names, b.column(len(keys) + 1).to_pylist()):
                if not batch.keys or key != batch.keys[-1]:
                    if batch.keys and (held >= BATCH_VALUES or len(batch.keys) * cells >= BATCH_CELLS):
                        found, carried = batch.solve(False, carried)
                        batch.reset()
                        held = 0
                        if found:
                            yield emit(found)
                    batch.keys.append(key)
                    batch.values.append([])
                batch.values[-1].append(y)
                held += 1
                if held >= 2 * BATCH_VALUES:      # within a long series
                    found, carried = batch.solve(True, carried)
                    batch.keys, batch.values, held = [key], [[]], 0
                    if found:
                        yield emit(found)
        if batch.keys:
            found, _ = batch.solve(False, carried)
            if found:
                yield emit(found)
    fitted = rows.mapInArrow(run, schema)
    if not choose:
        return fitted
    if not keys:
        return fitted.orderBy("aicc", "error", "trend_type", "season_type", "damped").limit(1)     # a row a structure
    w = Window.partitionBy(*keys).orderBy("aicc", "error", "trend_type", "season_type", "damped")
    return fitted.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def forecast_path(r, h: int) -> tuple[list[float], list[float]]:
    """(means, standard errors) of the next ``h`` rows of a fitted series.  Relative errors spread by the
    recursion of their second moments, which is exact for linear states and an approximation else."""
    season, m = list(r["season"]), max(int(r["period"]), 1)
    damp = np.cumsum([r["phi"] ** i for i in range(1, h + 1)])
    mean = []
    for i in range(h):
        base = r["level"] + damp[i] * r["trend"] if r["trend_type"] == "A" else \
            r["level"] * r["trend"] ** damp[i] if r["trend_type"] == "M" else r["level"]
        s = season[i % m] if season else None
        mean.append(base if s is None else base + s if r["season_type"] == "A" else base * s)
    c = [r["alpha"] + r["beta"] * damp[j] + r["gamma"] * ((j + 1) % m == 0) * bool(season) for j in range(h)]
    if r["error"] == "A":
        return mean, [math.sqrt(r["sigma2"] * (1 + sum(x * x for x in c[:i]))) for i in range(h)]
    square = []
    for i in range(h):
        square.append(mean[i] ** 2 + r["sigma2"] * sum(c[j - 1] ** 2 * square[i - j] for j in range(1, i + 1)))
    return mean, [math.sqrt(max((1 + r["sigma2"]) * q - x * x, 0)) for x, q in zip(mean, square)]


def ets_forecast(fitted: DataFrame, keys: Sequence[str], h: int = 12) -> DataFrame:
    """(keys, step, predicted, lower, upper) from the last states, 95 % limits."""
    ship_package(fitted.sparkSession)
    keys = list(keys)
    schema = T.StructType([fitted.schema[k] for k in keys]).add("step", "integer").add("predicted", "double").add("lower", "double").add("upper", "double")

    def run(batches):
        fields = to_arrow_schema(schema)
        for batch in batches:      # one row a series
            out = []
            for r in batch.to_pylist():
                for i, (x, s) in enumerate(zip(*forecast_path(r, h))):
                    out.append((*(r[k] for k in keys), i + 1, x, x - Z975 * s, x + Z975 * s))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*out), fields)], schema=fields)
    return fitted.mapInArrow(run, schema)
