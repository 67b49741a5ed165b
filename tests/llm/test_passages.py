import duckdb
import pytest
from cases import empty, prose, rows, table
from pyspark.sql import functions as F

from tabloom.llm import passage_dedup, queries


def sentence(seed, n):
    return prose(seed, n).capitalize() + "."


def test_repeated_passage_goes_and_short_sentences_stay(spark):
    passage = " ".join(sentence(90 + i, 15) for i in range(4))
    docs = [(5, f"{sentence(1, 9)} {passage}\nAll rights reserved."), (2, f"own words {passage} {sentence(2, 8)}"),
            (9, f"{sentence(3, 30)}\nAll rights reserved. {passage.upper()}"), (7, f"{sentence(4, 12)} All rights reserved.")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    spans = passage_dedup.repeated_passages(df)
    out = {r["doc_id"]: r for r in df.join(spans, "doc_id").withColumn(
        "clean", passage_dedup.without(F.col("text"), F.col("spans"))).collect()}
    assert out[2]["n_removed"] == 0 and out[7]["n_removed"] == 0       # the earliest, and only a short sentence
    assert out[2]["clean"] == docs[1][1]
    for i in (5, 9):
        # the first sentence of the earliest occurrence has words of its own before it
        assert out[i]["n_removed"] >= 3 and "omega" not in out[i]["clean"]
        assert all(sentence(90 + k, 15).lower() not in out[i]["clean"].lower() for k in range(1, 4))
    assert sentence(1, 9) in out[5]["clean"] and sentence(3, 30) in out[9]["clean"]


def test_awkward_rows(spark):
    got = passage_dedup.repeated_passages(table(spark)).collect()
    assert len(got) == len(rows())
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[0][0]["n_removed"] == 0 and by[1][0]["n_removed"] == 1 and by[None][0]["n_removed"] == 1
    assert len(by[3]) == 2 and by[9][0]["n_units"] == 0 and by[11][0]["n_units"] == 0
    assert passage_dedup.repeated_passages(empty(spark)).count() == 0


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_equals_its_twin(spark, sf):
    path = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet')")
    for name in ("op8_passage_dedup", "op10_mixing"):
        got = queries.QUERIES[name](spark, path)
        rel = con.sql(queries.ORACLE[name])
        assert sorted(got.columns) == sorted(rel.columns)
        assert sorted(map(tuple, got.select(*rel.columns).collect())) == sorted(rel.fetchall())


def test_every_repeated_unit_is_reported_with_its_run(spark):
    short, line, other = "All rights reserved.", "Read more here", "引用された文です。"
    docs = [(1, f"{short} {sentence(1, 9)}\n{line}\n{other}"), (2, f"{sentence(2, 9)} {short}\n{line}\nown {other}"),
            (3, f"{other}{line}\n{sentence(3, 9)}")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r["doc_id"]: r for r in passage_dedup.repeated_passages(df, unit=passage_dedup.ANY_UNIT).collect()}
    cut = {i: [(t[u["start"]:u["finish"]].strip(), u["run_words"]) for u in out[i]["repeats"]] for i, t in docs}
    assert cut == {1: [], 2: [(short, 6), (line, 6)], 3: [(other, 4), (line, 4)]}
    assert all(out[i]["spans"] == [] and out[i]["n_removed"] == 0 for i in out)
    all_go = {r["doc_id"]: r["n_removed"] for r in passage_dedup.repeated_passages(df, unit=passage_dedup.ANY_UNIT, least=1).collect()}
    assert all_go == {1: 0, 2: 2, 3: 2}


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_repeated_units_equal_their_twin(spark, sf):
    path = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet')")
    got = queries.QUERIES["op8_repeated_units"](spark, path)
    rel = con.sql(queries.ORACLE["op8_repeated_units"])
    assert sorted(map(tuple, got.select(*rel.columns).collect())) == sorted(rel.fetchall())
