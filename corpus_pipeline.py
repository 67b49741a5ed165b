"""A training corpus from ``documents``: language identification, near-duplicates,
secrets, mixing, byte-level BPE.

Every stage takes (spark, docs, sf_dir), where ``docs`` holds the columns of
``documents`` (and any others), works on all rows it is given and returns the same
columns, but for the last, which returns the encoded corpus.  ``run`` writes each
stage's result as Parquet to the shared folder and reads it again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import byte_bpe, language_id, mixing, near_dedup, secrets
from tabloom.llm.queries import source_weights
from tabloom.llm.scratch import Scratch
from tabloom.llm.workers import give_back

LEAST_SCORE = 0.5    # of a language; below it the document is of no language that was learned
ORACLE_SQL = None    # a fitted classifier, a network and BPE merges are no SQL: tested by brute force


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is one of the learned ones; ``lang`` becomes the
    prediction.  Texts without a letter and undecided ones go."""
    model = language_id.train(docs)
    # names that no column of the corpus has
    named = language_id.predict(docs, model, keep=True, names=("_lang_found", "_lang_score"))
    return named.where((F.col("_lang_found") != language_id.UNKNOWN) & (F.col("_lang_score") >= LEAST_SCORE)).withColumn(
        "lang", F.col("_lang_found")).select(*docs.columns)


def _keyed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` with ``_near_key``, one number for each distinct (id, text): the id itself where it has
    one text; texts that share an id, or have none, take numbers above all ids."""
    digest = F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit(""))
    rows = docs.select("doc_id", digest.alias("_near_digest")).distinct()
    odd = rows.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("_near_id"))
    odd = scratch.save(rows.join(odd, F.col("doc_id").eqNullSafe(F.col("_near_id"))).select(
        "_near_id", F.col("_near_digest").alias("_near_text"), F.monotonically_increasing_id().alias("_near_more")), "odd")
    above = max(docs.agg(F.max(F.col("doc_id").cast("long"))).first()[0] or 0, 0) + 1
    x = docs.withColumn("_near_digest", digest).join(
        odd, F.col("doc_id").eqNullSafe(F.col("_near_id")) & (F.col("_near_digest") == F.col("_near_text")), "left")
    return x.select(*docs.columns, F.coalesce(F.lit(above) + F.col("_near_more"), F.col("doc_id").cast("long")).alias("_near_key"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles, similarity 0.8):
    the one of smallest id; documents without an id, and different texts of one id, are compared
    like any others and come after all ids.  Of rows equal in id and text, the least stays."""
    scratch = Scratch(spark)
    keyed = _keyed(docs, scratch)
    kept = near_dedup.near_duplicates(keyed, id_col="_near_key").where("kept").select(F.col("doc_id").alias("_near_key")).distinct()
    often = scratch.save(keyed.groupBy("_near_key").count().where("count > 1").select("_near_key"), "often")
    rows = keyed.join(kept, "_near_key", "left_semi")
    once = rows.join(often, "_near_key", "left_anti").select(*docs.columns)
    least = rows.join(often, "_near_key", "left_semi").groupBy("_near_key").agg(F.min(F.struct(*docs.columns)).alias("_near_row"))
    return once.unionByName(least.select("_near_row.*"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a mark and ``n_chars`` counted anew."""
    clean = secrets.redact(docs, secrets.train(docs))
    return clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it (0 to 3 times); rows that share an id are
    taken as often as the most taken of them."""
    sized = docs.select("doc_id", mixing.word_count("text").alias("size"), F.array("source").alias("members"))
    # names that no column of the corpus has
    copies = mixing.mix(sized, source_weights, repeats=3).groupBy(F.col("doc_id").alias("_mix_id")).agg(
        F.max("copies").cast("int").alias("_mix_copies")).where("_mix_copies > 0")
    return docs.join(copies, F.col("doc_id").eqNullSafe(F.col("_mix_id"))).withColumn(
        "_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).select(*docs.columns)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and the digests of
    the ids and of the bytes they decode to, one row a document taken."""
    give_back(spark)
    coded = byte_bpe.encoded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, "doc_id",
                             F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), "ids",
                             F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
    give_back(spark)
    return coded


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE", encode_bytes),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{i}")
        if i > 0:
            scratch.drop(f"stage-{i - 1}")
    return docs
