import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from cases import empty, prose, rows, table
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.accumulators import AccumulatorParam
from tokenizers import Tokenizer

import corpus_pipeline
from tabloom.llm import byte_bpe, pretokens, token_counts, workers

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
EXTRA = ["<|endoftext|>", "a  <|endoftext|> b", "x\x85y\xa0z  \n", "it's WE'LL don't", "١٢٣ ⅷ ½", "࢏꟎ new",
         "a" * 47 + " " + "b" * 48 + " " + "c" * 49]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def coder():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS),
                             special_tokens={})


def with_extra(spark):
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(EXTRA)], "doc_id long, text string")
    return table(spark).select("doc_id", "text").unionByName(more)


def texts():
    return [(r[0], r[1]) for r in rows()] + [(1000 + i, t) for i, t in enumerate(EXTRA)]


def test_counts_equal_the_library(spark, library):
    got = token_counts.token_counts(with_extra(spark), JSON, public_tokenizers.PATTERN).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in texts()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert token_counts.token_counts(empty(spark), JSON, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_split_and_merge_any_text(text):
    split = pretokens.splitter(public_tokenizers.PATTERN)
    ranks = test_split_and_merge_any_text.__dict__.setdefault("ranks", byte_bpe.load_ranks(RANKS))
    coder = test_split_and_merge_any_text.__dict__.setdefault("coder", tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    words = split(text)
    assert "".join(words) == text
    assert [i for w in words for i in byte_bpe.heap_merge(w.encode(), ranks)] == coder.encode_ordinary(text)


@pytest.mark.parametrize(("frequent", "portion"), [(1 << 20, 10**6), (40, 300)])
def test_encoding_equals_the_library_and_decodes(spark, coder, frequent, portion):
    docs = with_extra(spark).coalesce(1)
    got = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, frequent=frequent, portion=portion).collect()
    assert len(got) == len(texts())
    by_id = dict(texts())
    for r in got:
        text = by_id[r["doc_id"]] or ""
        assert bytes(r["text"]) == text.encode()
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == coder.encode_ordinary(text)


def test_encoding_of_nothing(spark):
    assert byte_bpe.encode(empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def test_texts_and_portions_come_in_small_batches(spark, coder, monkeypatch):
    # 30 texts of about 250 KB in one partition: Spark's own batches hold all of them
    docs = [(i, f"{i} " + prose(i % 3, 30_000)) for i in range(30)]
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)

    class Largest(AccumulatorParam):
        def zero(self, value):
            return 0

        def addInPlace(self, a, b):
            return max(a, b)
    texts, portions = (spark.sparkContext.accumulator(0, Largest()) for _ in range(2))

    def watched(run):
        def seen(batches):
            def coming():
                for batch in batches:
                    (texts if batch.num_columns == 2 else portions).add(batch.nbytes)
                    yield batch
            yield from run(coming())
        return seen
    monkeypatch.setattr(byte_bpe, "tidy", watched)
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r for r in corpus_pipeline.encode_bytes(spark, df, "").collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        ids = np.array(coder.encode_ordinary(t), "<u4").tobytes()
        assert bytes(got[i]["ids"]) == ids and got[i]["n_tokens"] * 4 == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(ids).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    longest = max(len(t) for _, t in docs)
    assert longest < texts.value < workers.BATCH_BYTES + 2 * longest
    assert 0 < portions.value < workers.BATCH_BYTES + 4 * (byte_bpe.PORTION_CHARS + longest)
    assert spark.conf.get(key) == before


def test_words_of_equal_hash_are_never_mixed_up(monkeypatch):
    words = [w.encode() for w in dict.fromkeys(prose(4, 200).split())]
    table = pa.table({"word": pa.array(words, pa.binary()), "ids": pa.array([[i, 7] for i in range(len(words))], pa.list_(pa.int32()))})
    asked = pa.array([*words, b"", b"no", b"x" * 100], pa.binary())
    known = byte_bpe._Known(table)
    at = known.places(asked)
    assert [known.words[i].as_py() for i in at[:-3].tolist()] == words and at[-3:].tolist() == [-1] * 3
    assert [known.flat[known.ends[i]] for i in at[:-3]] == list(range(len(words)))
    plain = byte_bpe._hashes
    monkeypatch.setattr(byte_bpe, "_hashes", lambda w: plain(w) % np.uint32(8))
    known = byte_bpe._Known(table)
    at = known.places(asked)
    found = [(known.words[i].as_py(), w) for i, w in zip(at.tolist(), asked.to_pylist()) if i >= 0]
    assert len(found) == 8 and all(a == b for a, b in found)
