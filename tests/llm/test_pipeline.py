import hashlib

import public_tokenizers
import tiktoken
from cases import SCHEMA, edited, empty, prose, rows
from test_languages_secrets import brute_base
from test_near_dedup import brute

import corpus_pipeline
from tabloom.llm import byte_bpe
from tabloom.llm.scratch import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_one_by_one(spark):
    sf = "/root/testdata/sf0.001"
    scratch, docs = Scratch(spark), spark.read.parquet(f"{sf}/documents.parquet")
    seen = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        seen.append(docs)
        docs = scratch.save(stage(spark, docs, sf), f"t{i}")
        assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == COLUMNS
    named, unique, clean, mixed = (s.select("doc_id", "text", "source").collect() for s in seen[1:])
    component, _ = brute([(r["doc_id"], r["text"]) for r in named], 5, 80)
    assert sorted(r["doc_id"] for r in unique) == sorted(i for i, c in component.items() if i == c)
    assert [r["doc_id"] for r in sorted(clean)] == [r["doc_id"] for r in sorted(unique)]
    assert not any(brute_base(r["text"] or "") for r in clean)
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in clean}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks=byte_bpe.load_ranks(
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    texts = {r["doc_id"]: r["text"] or "" for r in mixed}
    out = docs.collect()
    assert sorted(r["doc_id"] for r in out) == sorted(r["doc_id"] for r in mixed)
    for r in out:
        assert r["n_tokens"] == len(coder.encode_ordinary(texts[r["doc_id"]]))
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_awkward_rows(spark):
    for source in (spark.createDataFrame(rows(), SCHEMA).selectExpr(
            "*", "'x' AS kept", "1 AS copy", "2 AS id", "'y' AS score", "'mine' AS lang_pred", "7 AS size", "-3 AS component_id"), empty(spark)):
        docs, scratch = source, Scratch(spark)
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            last = i == len(corpus_pipeline.STAGES) - 1
            docs = scratch.save(stage(spark, docs, ""), f"t{i}")
            assert last or docs.columns == source.columns
            if not last and "kept" in docs.columns:      # the corpus' own columns keep their values
                own = ["kept", "copy", "id", "score", "lang_pred", "size", "component_id"]
                assert {tuple(r) for r in docs.select(*own).distinct().collect()} <= {("x", 1, 2, "y", "mine", 7, -3)}
        docs.count()


def test_texts_of_one_id_or_none_are_judged_by_themselves(spark):
    a, b, c = prose(1, 80), prose(2, 80), prose(3, 80)
    docs = [(1, a, "p"), (1, b, "q"), (1, b, "o"), (2, edited(a, 5, 0.01), "r"), (None, c, "s"), (None, c, "s"), (None, edited(c, 6, 0.01), "t"), (None, b, "u"), (7, "", "v"), (8, None, "w")]
    df = spark.createDataFrame([(i, t, None, s, 0) for i, t, s in docs], SCHEMA).repartition(3)
    got = sorted((r["doc_id"] or 0, r["text"] or "", r["source"]) for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect())
    texts = [t for _, t, _ in got]
    # one of a and its edit, one of b (of three), one of c's group; the empty ones stay
    assert sum(t in (a, docs[3][1]) for t in texts) == 1 and texts.count(b) == 1 and sum(t in (c, docs[6][1]) for t in texts) == 1
    assert [s for i, t, s in got if t == b] == ["o"] or [i for i, t, _ in got if t == b] == [0]
    assert {(7, "", "v"), (8, "", "w")} <= set(got)
