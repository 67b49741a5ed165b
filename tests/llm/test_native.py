import hashlib
import re

import numpy as np
from cases import empty, rows, table
from pyspark.sql import functions as F

from tabloom.llm import fingerprints, licenses, queries
from tabloom.session import table as load

SMALL = "/root/testdata/sf0.01"


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def python_nodes(df):
    return re.findall("Python|Pandas|Arrow", df._jdf.queryExecution().optimizedPlan().toString())


def test_fingerprints_estimate_likeness(spark):
    out = queries.QUERIES["op5_fingerprints"](spark, SMALL)
    assert not python_nodes(out)
    got = {r["doc_id"]: r for r in out.collect()}
    docs = sorted((r["doc_id"], r["text"] or "") for r in load(spark, SMALL, "documents").select("doc_id", "text").collect())
    errors = []
    for (i, text), (_, after) in zip(docs, docs[1:] + docs[:1]):
        k = len(text) // 4
        edited = text[:len(text) - k] + after[:k]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(text)
        a, b = shingles(text), shingles(edited)
        errors.append(got[i]["near_edited"] - (len(a & b) / len(a | b) if a | b else 1.0))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.06


def test_fingerprint_of_awkward_texts(spark):
    df = table(spark).withColumn("print", fingerprints.fingerprint(F.col("text")))
    by_text = {}
    for r in df.collect():
        assert by_text.setdefault(r["text"] or "", r["print"]) == r["print"]
        assert len(r["print"]) == (0 if not (r["text"] or "").split() else fingerprints.BINS * fingerprints.BITS // 4)
    out = fingerprints.with_next(table(spark)).collect()
    assert len(out) == sum(r[0] is not None for r in rows())
    texts = {r[0]: r[1] or "" for r in rows()}
    for r in out:
        i = r["doc_id"]
        assert r["next_head"] == texts[(i + 1) % 21][:len(texts[i]) // 4]
    assert fingerprints.with_next(empty(spark)).count() == 0
    one = spark.createDataFrame([(5, "a b c d e f g h")], "doc_id long, text string")
    assert fingerprints.with_next(one).collect()[0]["next_head"] == "a b"


def brute_phrases(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), sorted(labels)


NOTICES = ["CC-BY cc by Cc By; all rights reserved. general  public LICENSE", None, "", "cc", "cc by cc by all rights reserved " * 500,
           "SPDX-License-Identifier: GPL-3.0-or-later and MIT License", "Licensed under the Apache License, Version 2.0",
           "see http://www.apache.org/licenses/LICENSE-2.0 or the GNU General Public License v3", "mit freundlichen permit", "İ cc by K"]


def test_license_places_and_labels(spark):
    df = spark.createDataFrame(list(enumerate(NOTICES)), "doc_id long, text string")
    out = licenses.scan(df)
    assert not python_nodes(out)
    got = sorted(out.collect())
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_phrases(NOTICES[r["doc_id"]])
        assert set(r["base_labels"]) <= set(r["labels"]) and 0 <= r["score"] <= 1
    assert [got[i]["labels"] for i in (5, 6, 7, 8)] == [["gpl-3.0", "mit"], ["apache-2.0"], ["apache-2.0", "gpl", "gpl-3.0"], []]
    assert licenses.scan(table(spark)).count() == len(rows()) and licenses.scan(empty(spark)).count() == 0


def test_license_query_against_brute_force(spark):
    got = {r["doc_id"]: r for r in queries.QUERIES["op6_licenses"](spark, SMALL).collect()}
    for r in load(spark, SMALL, "documents").collect():
        n, n_base, first, last, labels = brute_phrases(r["text"])
        x = got[r["doc_id"]]
        assert (x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["base_labels"]) == (n, n_base, first, last, ",".join(labels))


def test_rules_are_many_and_compile():
    assert len(licenses.rules()) >= 200
    for r in licenses.rules():
        re.compile(r["pattern"])


WRAPPED = {"GNU General Public\n * License, version 2": ["gpl-2.0"], "MIT\nLicense": ["mit"], "MIT \u00a0\tLicense": ["mit"],
           "# Apache License,\r\n# Version 2.0": ["apache-2.0"], "/* Licensed  under the\n *\n * Mozilla\tPublic License,    *\n * v. 2.0 */": ["mpl-2.0"],
           "// released under the terms\n//   of the MIT\n//   license": ["mit"], "dnl Boost Software\ndnl License": ["bsl-1.0"],
           "* GNU Lesser General   *\n* Public License,      *\n* version 2.1          *": ["lgpl-2.1"],
           "the MIT\n- and no license": [], "admit\n* licence": [], " " * 20000 + "\n# " * 5000: []}


def test_wrapped_and_commented_notices(spark):
    df = spark.createDataFrame(list(enumerate(WRAPPED)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    for i, (text, labels) in enumerate(WRAPPED.items()):
        # the phrases add their own labels
        assert got[i]["labels"] == sorted({*labels, *got[i]["base_labels"]}), text[:60]
        assert (got[i]["n_words"], got[i]["n_base"], got[i]["first_word"], got[i]["last_word"], got[i]["base_labels"]) == brute_phrases(text)
