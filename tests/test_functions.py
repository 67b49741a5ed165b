"""Shared building blocks: exact quantiles / ranks under skew, halo windows,
C-style number formatting, inverse normal, date parsing."""

import math
import random
from statistics import NormalDist

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabloom.functions import ranks
from tabloom.functions.dates import parse_date, parse_timestamp
from tabloom.functions.fmt import c_fixed
from tabloom.functions.stats import inv_norm_cdf, t_sf2, chi2_sf
from tabloom.operators import series


def test_exact_quantiles_match_type7_with_a_hot_value(spark):
    rng = random.Random(7)
    # one value holds a third of all rows, the rest are spread out
    vals = [5.0] * 1000 + [rng.uniform(-100, 100) for _ in range(2000)]
    df = spark.createDataFrame([(("a" if i % 2 else "b"), v) for i, v in enumerate(vals)], "g string, x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    for path in ("bucketed", "native"):
        if path == "bucketed":
            vc = ranks.value_weights(df, ["g"], "x")
            q = ranks.quantiles_from_counts(vc, ["g"], "value", "w", probs).collect()
        else:
            q = ranks.exact_quantiles(df, ["g"], "x", probs).collect()
        pdf = pd.DataFrame({"g": ["a" if i % 2 else "b" for i in range(len(vals))], "x": vals})
        for r in q:
            expect = np.percentile(pdf[pdf.g == r["g"]].x, r["p"] * 100)
            assert math.isclose(r["q"], expect, rel_tol=1e-12, abs_tol=1e-9), (path, r)


def test_average_ranks_match_pandas(spark):
    rng = random.Random(3)
    vals = [float(rng.randint(0, 20)) for _ in range(500)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, x double")
    out = ranks.average_ranks(df, [], "x").orderBy("id").toPandas()
    expect = pd.Series(vals).rank(method="average").tolist()
    assert out["rank_avg"].tolist() == expect


def test_top_k_per_group(spark):
    df = spark.createDataFrame([(i % 3, float(i)) for i in range(300)], "g int, v double")
    top = ranks.top_k_per_group(df, ["g"], [F.desc("v")], 2, buckets=5).collect()
    got = sorted((r["g"], r["v"]) for r in top)
    assert got == sorted([(g, v) for g in range(3) for v in sorted([float(i) for i in range(300) if i % 3 == g])[-2:]])


def test_halo_windows_are_exact_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(series, "MIN_BLOCK_ROWS", 50)
    n = 2000
    df = spark.createDataFrame([("s", i, float((i * 37) % 101)) for i in range(n)], "k string, t long, y double")
    out = series.lag_features(df, "y", ["t"], ["k"], [1, 5]).orderBy("t").toPandas()
    y = pd.Series([float((i * 37) % 101) for i in range(n)])
    assert out["lag_1"].fillna(-1).tolist() == y.shift(1).fillna(-1).tolist()
    assert out["lag_5"].fillna(-1).tolist() == y.shift(5).fillna(-1).tolist()
    rm = series.rolling_mean(df, "y", ["t"], ["k"], 7).orderBy("t").toPandas()
    expect = y.rolling(7).mean()
    assert np.allclose(rm["rollmean_7"].fillna(-1), expect.fillna(-1))


@settings(max_examples=60, deadline=None)
@given(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False), st.integers(min_value=0, max_value=4))
def test_c_fixed_matches_c_printf(spark, x, d):
    got = spark.range(1).select(c_fixed(F.lit(x), d).alias("s")).first()["s"]
    want = ("%." + str(d) + "f") % x
    if want in ("-0", "-0.0", "-0.00", "-0.000", "-0.0000"):
        want = want[1:]
        got = got.lstrip("-")
    assert got == want


def test_c_fixed_midpoints(spark):
    vals = [4.35, 0.125, 2.5, 1.005, 12.5, 0.5, 1.5]
    got = [r["s"] for r in spark.createDataFrame([(v,) for v in vals], "x double")
           .select(c_fixed(F.col("x"), 1).alias("s")).collect()]
    assert got == ["%.1f" % v for v in vals]


def test_inverse_normal_cdf(spark):
    ps = [1e-10, 1e-4, 0.01, 0.2, 0.5, 0.7, 0.975, 0.999999]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select(inv_norm_cdf(F.col("p")).alias("z")).collect()
    for p, r in zip(ps, got):
        assert math.isclose(r["z"], NormalDist().inv_cdf(p), rel_tol=1e-9, abs_tol=1e-12)


def test_distribution_tails():
    assert math.isclose(t_sf2(2.0, 10), 0.07338803477074, rel_tol=1e-8)
    assert math.isclose(chi2_sf(3.84145882069412, 1), 0.05, rel_tol=1e-8)


def test_dates_iso_mixed_garbage(spark):
    # fixture of the reference's date tests
    rows = [("2024-01-31",), ("2024-12-15",), ("31/01/2024",), ("15-12-2024",), ("2024-06-01",),
            ("not a date",), ("still nope",), (None,)]
    out = spark.createDataFrame(rows, "s string").select(parse_date(F.col("s")).cast("string").alias("d")).collect()
    assert [r["d"] for r in out] == ["2024-01-31", "2024-12-15", "2024-01-31", "2024-12-15", "2024-06-01",
                                     None, None, None]
    ts = spark.createDataFrame([("2024-01-31 10:15:00",), ("2024-12-15 23:59:59",)], "s string").select(
        parse_timestamp(F.col("s")).cast("string").alias("t")).collect()
    assert [r["t"] for r in ts] == ["2024-01-31 10:15:00", "2024-12-15 23:59:59"]


def test_running_weights_of_skewed_keys_cross_partitions(spark):
    """One key holds most distinct values, another most weight; NULL is a key of its own."""
    rng = random.Random(11)
    rows = [("big", float(v), rng.randrange(1, 5)) for v in range(4000)] + [(None, float(v), 2) for v in range(50)] \
        + [(f"k{i}", float(v), 1) for i in range(300) for v in range(3)] + [("hot", 1.0, 10 ** 9), ("hot", 2.0, 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double, w long").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")     # so small a table would be one partition
    got = {(r["k"], r["v"]): (r["cum_before"], r["_total"]) for r in
           ranks.with_cumulative(df.where("k IS NOT NULL"), ["k"], "v", "w", totals=True).collect()}
    plain = {(r["k"], r["v"]): r["cum_before"] for r in ranks.with_cumulative(df, ["k"], "v", "w").collect()}
    assert len(got) == len(rows) - 50 and len(plain) == len(rows)
    sums = {}
    for k, v, w in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        before = sums.get(k, 0)
        assert plain[k, v] == before and (k is None or got[k, v][0] == before)
        sums[k] = before + w
    assert all(got[k, v][1] == sums[k] for k, v in got)
    placed = ranks._placed(df, ["k"], "v", "w")
    sizes = [r["n"] for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) > 4 and max(sizes) < 2 * sum(sizes) / len(sizes)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
