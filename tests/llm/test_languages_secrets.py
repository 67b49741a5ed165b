import re
import zlib

import numpy as np
import pytest
from cases import empty, rows, table

from tabloom.llm import language_id, queries, secrets
from tabloom.session import table as load

SMALL = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    got = queries.QUERIES["op3_language_id"](spark, SMALL).collect()
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in load(spark, SMALL, "documents").collect()}
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]][0] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_awkward_rows(spark):
    model = language_id.train(table(spark))
    got = {r["doc_id"]: r for r in language_id.predict(table(spark), model).collect()}
    for i, text, *_ in rows():
        if not any(c.isalpha() for c in text or ""):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
        else:
            assert got[i]["lang_pred"] in ("en", "fr")
    kept = language_id.predict(table(spark), model, keep=True)
    assert kept.count() == len(rows()) and kept.columns[-2:] == ["lang_pred", "score"]
    none = language_id.train(empty(spark))
    assert {r["lang_pred"] for r in language_id.predict(table(spark), none).collect()} == {"und"}


def brute_base(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    return sorted([(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
                  + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
                  + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16])


CASES = ["password: token = abcdefghijkl", "TOKEN='abc.def/ghi+jk='", "secret=short1 passwd = longenough-value", "toKen=abcdefghijklmnop",
         "AKIAAKIAAKIAAKIAAK AKIA1", "é0123456789abcdef0 deadbeefdeadbeef", "apikey : \"aaaaaaaaaaaa\" api_key=bbbbbbbbbbbb", "", "x"]


@pytest.mark.parametrize("text", CASES)
def test_base_findings(text):
    assert secrets.base_findings(text)[0] == brute_base(text)


def test_secret_query_keeps_base_findings(spark):
    docs = load(spark, SMALL, "documents")
    got = {r["doc_id"]: r for r in queries.QUERIES["op1_secrets"](spark, SMALL).collect()}
    for r in docs.select("doc_id", "text").collect():
        base = brute_base(r["text"] or "")
        names = [f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base]
        row = got[r["doc_id"]]
        assert [row["n_assign"], row["n_access"], row["n_hex"]] == [sum(k == i for _, k, _ in base) for i in range(3)]
        assert [x for x in row["spans"].split(",") if x and not x.startswith("model")] == names


def test_network_finds_secrets_in_other_words():
    rng = np.random.default_rng(0)
    hexes = ["".join(rng.choice(list("0123456789abcdef"), 24)) for _ in range(300)]
    mails = [f"user.{rng.integers(99)}@mail{rng.integers(9)}.example.com" for _ in range(300)]
    words = [("some words come before ", h, " and after") for h in hexes] + [("write to them at ", m, " or call") for m in mails]
    truth = np.r_[np.ones(300), np.zeros(300)]
    codes, mask = secrets.encode(words)
    net = secrets.CharCNN()
    net.fit(codes[::2], mask[::2], truth[::2])
    net.calibrate(codes[1::2], mask[1::2], truth[1::2])
    found = net.probabilities(codes[1::2], mask[1::2]) >= net.threshold
    assert found[truth[1::2] > 0].mean() >= secrets.RECALL - 0.02 and found[truth[1::2] == 0].mean() < 0.05


def test_redaction_and_awkward_rows(spark):
    net = secrets.train(table(spark))
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(table(spark), net).collect()}
    assert len(got) == len({r[0] for r in rows()}) and got[9] == []
    df = spark.createDataFrame([("keep", "a password=abcdefabcdef0123 b deadbeefdeadbeef c"), ("none", None)], "start string, text string")
    out = {r["start"]: r["text"] for r in secrets.redact(df, net).collect()}
    assert out == {"keep": "a [SECRET] b [SECRET] c", "none": None}
    assert secrets.scan(empty(spark), secrets.train(empty(spark))).count() == 0
