import numpy as np

from tabloom.llm import embedding_dedup


def check(spark, vectors):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, n_links string")
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(df, 0.95).collect()}
    assert len(got) == len(vectors)
    unit = {}
    for i, v, _ in vectors:
        x = np.array([np.nan if y is None else y for y in (v or [])], np.float32).astype(float)
        if len(x) and np.isfinite(x).all() and np.abs(x).max() > 0:
            unit[i] = x / np.linalg.norm(x)
    ids, missed, total = sorted(unit), 0, 0
    for i, _, _ in vectors:
        want = sum(i in unit and j != i and len(unit[j]) == len(unit[i]) and unit[i] @ unit[j] >= 0.95 for j in ids)
        assert got[i]["n_links"] <= want
        missed, total = missed + want - got[i]["n_links"], total + want
        assert got[i]["kept"] == (got[i]["component_id"] == i)
    return got, missed, total


def test_links_of_planted_groups(spark):
    rng = np.random.default_rng(0)
    vectors = []
    for g in range(40):
        centre = rng.standard_normal(32)
        centre /= np.linalg.norm(centre)
        for _ in range(8):
            x = centre + rng.standard_normal(32) / np.sqrt(32) * rng.choice([0.05, 0.15, 0.25])
            vectors.append((len(vectors), x.astype(np.float32).tolist(), "x"))
    vectors += [(1000 + i, rng.standard_normal(32).astype(np.float32).tolist(), "x") for i in range(400)]
    _, missed, total = check(spark, vectors)
    assert total > 1000 and missed <= 0.01 * total


def test_awkward_vectors(spark):
    one = [1.0, 2.0, 3.0]
    vectors = [(1, one, ""), (2, one, ""), (3, [2.0, 4.0, 6.0], ""), (4, None, ""), (5, [], ""), (6, [0.0, 0.0, 0.0], ""),
               (7, [1.0, None, 3.0], ""), (8, [float("nan"), 1.0, 1.0], ""), (9, [float("inf"), 1.0, 1.0], ""),
               (10, [-1.0, -2.0, -3.0], ""), (11, [1.0, 2.0], ""), (12, [1e-30, 2e-30, 3e-30], "")]
    got, missed, _ = check(spark, vectors)
    assert missed == 0 and got[2]["component_id"] == 1 and got[12]["n_links"] == 3
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_calibration_reaches_the_recall():
    for n in (10, 10_000, 1_000_000):
        lines, tables = embedding_dedup.calibrate(n, 0.95)
        rng = np.random.default_rng(1)
        d = rng.standard_normal((4000, tables, lines + 1)) * np.sqrt(0.1)
        at = rng.uniform(0, embedding_dedup.CELL, (4000, tables, lines))
        same = (np.floor((at + d[:, :, :lines]) / embedding_dedup.CELL) == 0).all(axis=2)
        hits = (same & (np.abs(d[:, :, lines]) <= embedding_dedup.WINDOW)).sum(axis=1)
        assert (hits >= embedding_dedup.COUNT).mean() > embedding_dedup.RECALL - 0.004
