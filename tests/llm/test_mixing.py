from itertools import product

import pytest
from cases import empty, rows, table
from pyspark.sql import functions as F

from tabloom.llm import mixing
from tabloom.llm.queries import source_weights


def test_water_fill():
    assert mixing.water_fill([100, 100], [5.0, 1.0], 3) == pytest.approx([200 * 5 / 6, 200 / 6])
    # the first source is capped at three times its size, the others share the excess by weight
    out = mixing.water_fill([10, 300, 300], [5.0, 2.0, 1.0], 3)
    assert out == pytest.approx([30, 580 * 2 / 3, 580 / 3]) and sum(out) == pytest.approx(610)
    assert mixing.water_fill([0, 0], [5.0, 2.0], 3) == [0.0, 0.0] and mixing.water_fill([], [], 3) == []


def test_flow_is_largest_and_cheapest():
    # both patterns can serve either source: three tokens of each at cost 1, the rest at 3
    sizes, members, quotas = [3, 4], [[0, 1], [1]], [2, 5]

    def best():
        found = None
        for a0, a1, b1 in product(range(7), range(7), range(9)):
            if a0 <= quotas[0] and a1 + b1 <= quotas[1] and a0 + a1 <= 6 and b1 <= 8:
                cost = sum(sum(2 * (k // s) + 1 for k in range(n)) for n, s in ((a0 + a1, 3), (b1, 4)))
                found = min(found or (1, 0), (-(a0 + a1 + b1), cost))
        return found
    taken = mixing.min_cost_flow(sizes, members, quotas, 2)
    cost = sum(sum(2 * (k // s) + 1 for k in range(n)) for n, s in zip(taken, sizes))
    assert (-sum(taken), cost) == best()


def test_each_source_comes_near_its_target(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), (F.col("id") % 97 + 1).alias("size"),
        F.array(F.expr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN 'small' ELSE NULL END")).alias("members"))
    got = mixing.mix(docs, source_weights).collect()
    by = {}
    for r in got:
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
        t = by.setdefault(r["members"][0], [0, r["targets"][0], r["source_sizes"][0]])
        t[0] += r["taken"]
    for taken, target, held in by.values():
        assert target <= 3 * held + 1e-6 and abs(taken - target) <= 0.005 * target + 5
    again = mixing.mix(docs.repartition(7), source_weights).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)


def test_overlapping_sources(spark):
    docs = spark.createDataFrame([(i, 10, m) for i, m in enumerate(
        [["a"]] * 20 + [["a", "b"]] * 20 + [["b"]] * 5 + [[]] * 3 + [None] * 2)], "doc_id long, size long, members array<string>")
    got = mixing.mix(docs, lambda names: [1.0] * len(names)).collect()
    assert all(r["taken"] == 0 for r in got if not r["members"])
    assert sum(r["taken"] for r in got) == pytest.approx(450, abs=20)


def test_awkward_rows(spark):
    docs = table(spark).select("doc_id", mixing.word_count("text").alias("size"), F.array("source").alias("members"))
    got = mixing.mix(docs, source_weights).collect()
    assert len(got) == len(rows())
    assert {r["doc_id"]: r["size"] for r in got}[9] == 0
    none = empty(spark).select("doc_id", mixing.word_count("text").alias("size"), F.array("source").alias("members"))
    assert mixing.mix(none, source_weights).count() == 0
