"""The network of the secret scan learns from every finding, in portions."""

import hashlib

import numpy as np

from tabloom.llm import secrets
from tabloom.llm.scratch import Scratch


def _docs(spark, n):
    digest = lambda i: hashlib.sha256(str(i).encode()).hexdigest().upper()
    texts = [f"some words {digest(i)[:6]} then password={digest(i)[:10]}-{digest(i)[10:20]} after" for i in range(n)]
    texts += [f"write to user.{i}@mail{i % 7}.example.com about {digest(-i)[:6]} soon" for i in range(n)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_no_finding_is_left_out(spark):
    docs = _docs(spark, 2100).repartition(4)
    found = secrets.labelled(docs.select("text")).where("good").orderBy("draw").collect()
    assert len(found) == 2100
    without = docs.where(~docs.text.contains(found[-1]["value"]))     # the one of the highest hash
    assert without.count() == docs.count() - 1
    a, b = secrets.train(docs), secrets.train(without)
    assert a.scale != b.scale or any(not np.array_equal(a.p[k], b.p[k]) for k in a.p)


def test_portions_hold_every_finding_and_train(spark, monkeypatch):
    monkeypatch.setattr(secrets, "PORTION", 150, raising=False)
    docs = _docs(spark, 300)
    found = secrets.labelled(docs.select("text"))
    taught, up, down = secrets.lessons(found, Scratch(spark))
    rows, all_found = taught.collect(), found.collect()
    assert len({r["part"] for r in rows}) == -(-(up + down) // 150) and (up, down) == (300, len(all_found) - 300)
    assert sorted((r["value"], r["good"]) for r in rows) == sorted((r["value"], r["good"]) for r in all_found)
    contexts = {(r["left"], r["right"]) for r in all_found if not r["good"]}
    swapped = [r for r in rows if r["good"] and (r["left"], r["right"]) in contexts]
    assert 100 < len(swapped) < 200
    net, again = secrets.train(docs), secrets.train(docs.repartition(3))
    assert net.scale == again.scale and net.threshold == again.threshold
    codes, mask = secrets.encode([(r["left"], r["value"], r["right"]) for r in rows])
    truth = np.array([r["good"] for r in rows])
    found = net.probabilities(codes, mask) >= net.threshold
    assert found[truth].mean() > 0.95 and found[~truth].mean() < 0.05
