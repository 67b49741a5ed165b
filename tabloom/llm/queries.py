"""Registered queries of the training-data operators: thin digests of their outputs
over whole tables, with DuckDB twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import functions as F

from ..session import table
from . import byte_bpe, embedding_dedup, fingerprints, language_id, licenses, mixing, near_dedup, passage_dedup, pii_crf, secrets, token_align, \
    token_counts, turn_repair

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _span_digest(found, kinds):
    """Counts of the base kinds, the digest of the base spans and all spans as text."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["finish"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    of_kind = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *(of_kind(k).alias(f"n_{k}") for k in kinds),
                        F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


@query("op1_secrets")
def op1_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.train(docs))
    return _span_digest(found, ("assign", "access", "hex"))


@query("op2_near_dedup")
def op2_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


@query("op3_language_id")
def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    named = language_id.predict(docs, language_id.train(docs))
    return named.select("doc_id", language_id.held_out("doc_id").alias("held_out"), "lang_pred", "score")


@query("op4_token_counts")
def op4_token_counts(spark, sf_dir):
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"),
                                       public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


@query("op5_fingerprints")
def op5_fingerprints(spark, sf_dir):
    rows = fingerprints.with_next(table(spark, sf_dir, "documents"))
    n_chars = F.char_length("text")
    edited = F.concat(F.substring("text", F.lit(1), n_chars - F.floor(n_chars / 4).cast("int")), "next_head")
    rows = rows.withColumn("edited", edited).withColumn("edited_fingerprint", fingerprints.fingerprint(F.col("edited")))
    own = F.col("fingerprint")
    return rows.select(
        "doc_id", n_chars.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        fingerprints.likeness(own, F.col("edited_fingerprint")).alias("near_edited"),
        fingerprints.likeness(own, F.col("next_fingerprint")).alias("near_next"))


@query("op6_licenses")
def op6_licenses(spark, sf_dir):
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


@query("op7_byte_bpe")
def op7_byte_bpe(spark, sf_dir):
    return byte_bpe.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                            public_tokenizers.PATTERN, "doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
                            F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


PASSAGE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT doc_id, unnest(x) AS unit, generate_subscripts(x, 1) AS i
      FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?\n]*[.!?\n]+|[^.!?\n]+') AS x FROM d)),
o AS (SELECT doc_id, unit, i, sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY i) AS finish FROM p),
n AS (SELECT doc_id, i, CAST(finish - length(unit) AS BIGINT) AS start, CAST(finish AS BIGINT) AS finish,
             len(regexp_extract_all(unit, '[^\x20\x09-\x0D]+')) AS words,
             translate(array_to_string(regexp_extract_all(unit, '[^\x20\x09-\x0D]+'), ' '),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM o),
u AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS nr,
             row_number() OVER (PARTITION BY norm ORDER BY doc_id, i) AS occurrence FROM n WHERE words > 0),
r AS (SELECT *, nr - row_number() OVER (PARTITION BY doc_id ORDER BY nr) AS run FROM u WHERE occurrence > 1),
g AS (SELECT doc_id, run, sum(words) AS words, count(*) AS n, min(start) AS start, max(finish) AS finish
      FROM r GROUP BY 1, 2 HAVING sum(words) >= 20),
s AS (SELECT doc_id, sum(n) AS n_removed, sum(finish - start) AS removed_chars,
             string_agg(start || ':' || finish, ',' ORDER BY start) AS spans FROM g GROUP BY 1),
c AS (SELECT doc_id, count(*) AS n_units FROM u GROUP BY 1)
SELECT d.doc_id, coalesce(n_units, 0)::BIGINT AS n_units, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(removed_chars, 0)::BIGINT AS removed_chars, coalesce(spans, '') AS spans
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
"""


@query("op8_passage_dedup", PASSAGE_SQL)
def op8_passage_dedup(spark, sf_dir):
    found = passage_dedup.repeated_passages(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_units", "n_removed",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["finish"] - s["start"]).alias("removed_chars"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(
            ":", s["start"].cast("string"), s["finish"].cast("string"))), ",").alias("spans"))


# every repeated unit, whatever the length of its run, cut at the sentence ends of all scripts
REPEATS_SQL = r"""
WITH p AS (SELECT doc_id, unnest(x) AS unit, generate_subscripts(x, 1) AS i
      FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^.!?\n。！？｡।॥؟۔։።]*[.!?\n。！？｡।॥؟۔։።]+|[^.!?\n。！？｡।॥؟۔։።]+') AS x
            FROM documents)),
o AS (SELECT doc_id, unit, i, sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY i) AS finish FROM p),
n AS (SELECT doc_id, i, CAST(finish - length(unit) AS BIGINT) AS start, CAST(finish AS BIGINT) AS finish,
             regexp_extract_all(unit, '[^\x20\x09-\x0D]+') AS x FROM o),
u AS (SELECT *, len(x) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS nr,
             row_number() OVER (PARTITION BY translate(array_to_string(x, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                'abcdefghijklmnopqrstuvwxyz') ORDER BY doc_id, i) AS occurrence FROM n WHERE len(x) > 0),
r AS (SELECT *, nr - row_number() OVER (PARTITION BY doc_id ORDER BY nr) AS run FROM u WHERE occurrence > 1),
g AS (SELECT *, sum(words) OVER (PARTITION BY doc_id, run) AS run_words FROM r),
s AS (SELECT doc_id, count(*) AS n_repeats, sum(words) AS repeated_words,
             string_agg(start || ':' || finish || ':' || run_words, ',' ORDER BY start) AS repeats FROM g GROUP BY 1)
SELECT d.doc_id, coalesce(n_repeats, 0)::BIGINT AS n_repeats, coalesce(repeated_words, 0)::BIGINT AS repeated_words,
       coalesce(repeats, '') AS repeats
FROM documents d LEFT JOIN s USING (doc_id)
"""


@query("op8_repeated_units", REPEATS_SQL)
def op8_repeated_units(spark, sf_dir):
    found = passage_dedup.repeated_passages(table(spark, sf_dir, "documents"), unit=passage_dedup.ANY_UNIT)
    return found.select(
        "doc_id", F.size("repeats").cast("long").alias("n_repeats"),
        F.aggregate("repeats", F.lit(0).cast("long"), lambda a, s: a + s["words"]).alias("repeated_words"),
        F.array_join(F.transform("repeats", lambda s: F.concat_ws(
            ":", s["start"].cast("string"), s["finish"].cast("string"), s["run_words"].cast("string"))), ",").alias("repeats"))


@query("op9_embedding_dedup")
def op9_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.95)


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
         ('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 7))::BIGINT AS draw
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS held, row_number() OVER (ORDER BY source NULLS LAST) AS nr FROM d GROUP BY source),
w AS (SELECT source, held, 3.0::DOUBLE * held AS cap, [5, 2, 1][CAST((nr - 1) % 3 + 1 AS INT)]::DOUBLE AS weight, nr FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, nr) AS place FROM w),
l AS (SELECT *, (SELECT sum(held) FROM s)::DOUBLE - coalesce(sum(cap) OVER before, 0) AS room,
             (SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER before, 0) AS shares
      FROM o WINDOW before AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min(place) AS edge FROM l WHERE cap * shares > room * weight),
t AS (SELECT l.source, l.held,
             CASE WHEN edge IS NULL OR place < edge THEN cap
                  ELSE (SELECT room / shares FROM l WHERE place = edge) * weight END AS target
      FROM l CROSS JOIN f),
q AS (SELECT *, CAST(round_even(target, 0) AS BIGINT) AS quota FROM t),
c0 AS (SELECT d.doc_id, d.source, d.size, d.draw, q.held AS source_size, q.target,
              CASE WHEN held = 0 THEN 0 ELSE quota // held END AS copies, 0 AS more,
              CASE WHEN held = 0 THEN 0 ELSE quota % held END AS rest
       FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
""" + "".join(f""",
m{i} AS (SELECT *, more = 0 AND size > 0 AND size <= rest AND sum(CASE WHEN more = 0 AND size > 0 AND size <= rest
                   THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY draw) <= rest AS took FROM c{i}),
c{i + 1} AS (SELECT doc_id, source, size, draw, source_size, target, copies, more + CASE WHEN took THEN 1 ELSE 0 END AS more,
              rest - coalesce(sum(CASE WHEN took THEN size END) OVER (PARTITION BY source), 0) AS rest FROM m{i})
""" for i in range(mixing.ROUNDS)) + f"""
SELECT doc_id, size::BIGINT AS size, source_size, round(target, 4) AS target,
       (size * (copies + more))::BIGINT AS taken
FROM c{mixing.ROUNDS}
"""


def source_weights(names: list) -> list[float]:
    return [(5.0, 2.0, 1.0)[i % 3] for i in range(len(names))]


@query("op10_mixing", MIX_SQL)
def op10_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", mixing.word_count("text").alias("size"), F.array("source").alias("members"))
    mixed = mixing.mix(docs, source_weights, repeats=3)
    return mixed.select("doc_id", "size", F.get("source_sizes", F.lit(0)).alias("source_size"),
                        F.round(F.get("targets", F.lit(0)), 4).alias("target"), "taken")


@query("op11_turn_repair")
def op11_turn_repair(spark, sf_dir):
    return turn_repair.digest(turn_repair.repair(turn_repair.damage(table(spark, sf_dir, "conversations"))))


@query("op12_token_alignment")
def op12_token_alignment(spark, sf_dir):
    aligned = token_align.cross_alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                          public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)
    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


@query("op13_pii")
def op13_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return _span_digest(pii_crf.scan(docs, pii_crf.train(docs)), pii_crf.KINDS)
