import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from cases import empty, prose, rows, table

from tabloom.llm import pii_crf, queries
from tabloom.session import table as load

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def brute_base(text):
    only = lambda m: re.sub("[^0-9]", "", m[0])
    return sorted([(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
                  + [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
                  + [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(only(m)) <= 19 and luhn(only(m))]
                  + [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(only(m)) <= 15])


CASES = ["a@b.c@d.e x@y", "@a.b a.@-.- é@x.y.z. %+a@b.c", "1.2.3.4.5.6.7.8.9 256.1.1.1 001.02.0003.255 1..2.3.4.5", "4111 1111-1111 1111",
         "4111111111111111 4111111111111111", "+1 (017) 555-7713. +1+2 (345) 678-9012345 +49 () -", "+12345678901234567890", "", "no", "٣٤@x.y 1٣.2.3.4"]


@pytest.mark.parametrize("text", CASES)
def test_base_findings(text):
    assert pii_crf.base_findings(text) == brute_base(text)


def test_base_findings_of_random_texts():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice("ab@@..1124+-() é") for _ in range(rng.randrange(60)))
        assert pii_crf.base_findings(text) == brute_base(text)


def test_tokens_and_labels_of_random_texts():
    rng = random.Random(2)
    for _ in range(500):
        text = "".join(rng.choice("ab@..1124+-() é") for _ in range(rng.randrange(60)))
        spans = pii_crf.tokens(text)
        assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        found = pii_crf.base_findings(text)
        touched = [any(s < f and b < e for b, _, f in found) for s, e in spans]
        assert [x > 0 for x in pii_crf.labels(spans, found)] == touched


def test_messages_are_exact_on_trees():
    """Without a loop the marginals equal those summed over all labellings."""
    field, rng = pii_crf.SkipChain(), np.random.default_rng(0)
    for k in field.p:
        field.p[k] = rng.normal(0, 1, field.p[k].shape)
    unary = rng.normal(0, 1, (4, pii_crf.LABELS))
    edges = np.array([[0, 0, 1], [1, 1, 2], [2, 1, 3]])
    node, pair = field.marginals(unary, edges)
    pot, total, exact = field.potentials(), 0.0, np.zeros_like(unary)
    for y in itertools.product(range(pii_crf.LABELS), repeat=4):
        p = np.exp(sum(unary[i, c] for i, c in enumerate(y)) + sum(pot[k, y[a], y[b]] for k, a, b in edges))
        total += p
        for i, c in enumerate(y):
            exact[i, c] += p
    assert np.abs(node - exact / total).max() < 1e-3
    assert np.abs(pair[0].sum(axis=1) - node[0]).max() < 1e-3


def corpus():
    rng = random.Random(4)
    out = []
    for i in range(240):
        number = f"({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}"
        mail = f"name.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com"
        words = [prose(i, 12), prose(i + 900, 12), prose(i + 1800, 9)]
        kind = i % 3
        if kind == 0:
            text = f"{words[0]} +1 {number} {words[1]} +1 {number} {words[2]}"
        elif kind == 1:
            text = f"{words[0]} {mail} {words[1]} {mail}. {words[2]} {rng.randrange(10**6)}"
        else:
            text = f"{words[0]} {rng.randrange(10**5)} {words[1]} {rng.randrange(100, 999)}-{rng.randrange(1000, 9999)} {words[2]} {words[0][:5]}.{rng.randrange(99)}"
        out.append((i, text))
    return out


def test_consistency_and_clean_documents(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    field = pii_crf.train(docs)
    weak = ["call +1 (243) 555-5526 soon or else 555-5526 later", "call 555-5526 later", "write to name.37@mail1.example.com or name.37 there",
            "the number 4111111111111111 4111111111111111 twice", "item 4411 and 12-9044"]
    more = docs.union(spark.createDataFrame(list(enumerate(weak, 1000)), "doc_id long, text string"))
    got = {r["doc_id"]: [(s["kind"], s["start"], s["finish"]) for s in r["spans"]] for r in pii_crf.scan(more, field).collect()}
    assert got[1000] == [("phone", 5, 22), ("crf_phone", weak[0].rindex("555"), weak[0].rindex("555") + 8)]
    assert got[1001] == [] and got[1004] == []
    assert got[1002][0] == ("email", 9, 34) and ("crf_email", 38, 45) in got[1002]
    for i, text in corpus():
        assert got[i] == [(pii_crf.KINDS[k], s, e) for s, k, e in brute_base(text)]


def test_query_over_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.QUERIES["op13_pii"](spark, sf).collect()}
    clean = added = 0
    for r in load(spark, sf, "documents").select("doc_id", "text").collect():
        base, row = brute_base(r["text"] or ""), got.pop(r["doc_id"])
        names = [f"{pii_crf.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert [row[f"n_{k}"] for k in pii_crf.KINDS] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert row["base_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert [x for x in row["spans"].split(",") if x and not x.startswith("crf_")] == names
        clean += not base
        added += not base and row["spans"] != ""
    assert not got and added <= 0.01 * clean


def test_awkward_rows(spark):
    field = pii_crf.train(table(spark))
    got = pii_crf.scan(table(spark), field).collect()
    assert len(got) == len(rows()) and all(r["spans"] == [] for r in got)
    assert pii_crf.scan(empty(spark), pii_crf.train(empty(spark))).count() == 0
    long = "+1 (017) 555-7713 and " + "12-3 " * 20000 + "x@" * 5000 + "9" * 20000
    docs = spark.createDataFrame([(1, long), (1, long), (None, None)], "doc_id long, text string")
    assert sorted(len(r["spans"]) for r in pii_crf.scan(docs, field).collect())[0] == 0
