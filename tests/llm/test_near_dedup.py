import random

import numpy as np
from cases import SCHEMA, edited, empty, prose, rows, table
from pyspark.accumulators import AccumulatorParam

from tabloom.llm import near_dedup, workers
from tabloom.llm.components import connected_components
from tabloom.llm.scratch import Scratch


def shingles(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(docs, size, percent):
    sets = [(i, shingles(t, size)) for i, t in docs if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in sets:
        for j, b in sets:
            met = len(a & b)
            if a and b and i < j and 100 * met >= percent * (len(a) + len(b) - met):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in sets}, {i: len(s) for i, s in sets}


def check(df, docs, size, percent=80):
    got = near_dedup.near_duplicates(df, shingle=size, percent=percent).collect()
    component, n = brute(docs, size, percent)
    assert len(got) == len(docs)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
            continue
        assert (r["component_id"], r["n_shingles"]) == (component[r["doc_id"]], n[r["doc_id"]]), r
        assert r["kept"] == (r["doc_id"] == component[r["doc_id"]])


def test_awkward_rows(spark):
    check(table(spark), [(r[0], r[1]) for r in rows()], 4)


def test_groups_and_chains(spark):
    # copies of copies: a chain links documents that are not similar themselves; a passage many share
    rng, docs, text = random.Random(5), [], prose(50, 100)
    passage = prose(51, 60)
    for i in range(25):
        docs.append((i * 7 % 100, text))
        text = edited(text, i, 0.02)
    for i in range(40):
        docs.append((200 + i, prose(100 + i, rng.randrange(20, 90)) + " " + passage))
    for i in range(40):
        docs.append((300 + i, edited(prose(52, 80), i, rng.choice((0.0, 0.01, 0.03, 0.06)))))
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    check(df, docs, 5)
    check(df, docs, 4)


def test_empty(spark):
    assert near_dedup.near_duplicates(empty(spark)).count() == 0
    df = spark.createDataFrame([(1, None, None, None, 0), (2, "", None, None, 0)], SCHEMA)
    assert all(r["kept"] and r["n_shingles"] == 0 for r in near_dedup.near_duplicates(df).collect())


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 200), (100, 201), (300, 100), (7, 7)]
    got = connected_components(spark.createDataFrame(chain, "a long, b long"), Scratch(spark)).collect()
    want = {i: 0 for i in range(61)} | {x: 100 for x in (100, 200, 201, 300)}
    assert {r["node"]: r["component"] for r in got} == want


def test_shingle_set_is_the_word_set():
    words = near_dedup._WordHash()
    a = near_dedup.shingle_set("A b  c\td e", 4, words)
    assert len(a) == 2 and np.array_equal(a, near_dedup.shingle_set("a B c d E", 4, words))
    assert len(near_dedup.shingle_set("x y", 4, words)) == 1 and len(near_dedup.shingle_set(None, 4, words)) == 0


def test_long_texts_come_and_go_in_small_batches(spark, monkeypatch):
    # 24 near copies of 300 KB in one partition: Spark's own batches hold all of them
    words = [f"{random.Random(9).getrandbits(20):05x}{i:04x}" for i in range(30_000)]
    docs = [(i, " ".join([f"x{i}"] * (i + 1) + words)) for i in range(24)]
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)

    class Largest(AccumulatorParam):
        def zero(self, value):
            return 0

        def addInPlace(self, a, b):
            return max(a, b)
    came, went = (spark.sparkContext.accumulator(0, Largest()) for _ in range(2))

    def watched(run):
        def seen(batches):
            def coming():
                for batch in batches:
                    came.add(batch.nbytes)
                    yield batch
            for out in run(coming()):
                went.add(out.nbytes)
                yield out
        return seen
    monkeypatch.setattr(near_dedup, "tidy", watched)
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = near_dedup.near_duplicates(df).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == [(i, 0, i == 0) for i in range(24)]
    longest = max(len(t) for _, t in docs)
    assert longest < came.value < workers.BATCH_BYTES + 2 * longest
    assert 0 < went.value < 8 * (near_dedup.SET_VALUES + 2 * len(words))
    assert spark.conf.get(key) == before
