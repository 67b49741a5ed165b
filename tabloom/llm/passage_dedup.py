"""Substring dedup by hashing lines and the sentences in them.

A text is cut into units: lines, and lines at sentence ends, because a passage quoted
by many documents seldom stands on lines of its own (``UNIT`` is a parameter; lines or
paragraphs alone are other patterns).  Units are normalised (A-Z as a-z, runs of white
space as one blank, trimmed) and hashed; equal digests are grouped over all documents
and the occurrence of smallest doc_id, first in its text, is kept.  All others are repeats.
Every repeat is reported, with the words of the run of adjacent repeats that it is part
of; ``spans`` are those of runs of ``least`` words or more: passages, not common short
sentences (``least=1`` removes every repeat).  Spans are code points of the original
text, end exclusive, from the first unit's start to the last one's end.

A task emits one small row a unit.  Digests meet by a count and a smallest id, which are
combined before the shuffle (a unit that a third of the corpus repeats is one row a
task); units that occur once leave there; the others are joined with their digest's
first id, where adaptive execution may split a frequent one; a document's runs are a
window over its own repeats.

Inputs: a null or empty text, and one without words, has no units; rows that share an
id are one document (none of them loses its units to another) and keep a row each; rows
without id come last in the order; texts of any length are read whole; an empty table
gives an empty result; other columns are ignored."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .workers import tidy

UNIT = r"[^.!?\n]*[.!?\n]+|[^.!?\n]+"
# the same with the sentence ends of other scripts
ANY_UNIT = r"[^.!?\n。！？｡।॥؟۔։።]*[.!?\n。！？｡।॥؟۔։።]+|[^.!?\n。！？｡।॥؟۔։።]+"
LEAST = 20          # words of a run that is removed
NO_ID = (1 << 63) - 1


def units(docs: DataFrame, unit: str) -> DataFrame:
    """(doc_id, row, nr, start, finish, words, digest, again) of every unit with a word in
    ``docs`` (doc_id, row, text); ``again`` marks a unit that its own text has said before."""
    names = ["doc_id", "row", "nr", "start", "finish", "words", "digest", "again"]

    def run(batches):
        cut = re.compile(unit).finditer
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            owner, nr, start, finish, words, digest, again = ([] for _ in names[1:])
            for i, text in enumerate(batch.column(2)):
                said: set[bytes] = set()
                place = 0
                for m in cut(text.as_py() or ""):
                    # bytes.lower and bytes.split know ASCII letters and white space only
                    parts = m[0].encode("utf-8", "surrogatepass").lower().split()
                    if not parts:
                        continue
                    key = hashlib.blake2b(b" ".join(parts), digest_size=8).digest()
                    owner.append(i)
                    nr.append(place)
                    place += 1
                    start.append(m.start())
                    finish.append(m.end())
                    words.append(len(parts))
                    digest.append(key)
                    again.append(key in said)
                    said.add(key)
            at = np.array(owner, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[at]), pa.array(rows[at]), pa.array(nr, pa.int32()), pa.array(start, pa.int32()),
                 pa.array(finish, pa.int32()), pa.array(words, pa.int32()),
                 pa.array(np.frombuffer(b"".join(digest), "<i8")), pa.array(again, pa.bool_())], names)
    return docs.mapInArrow(tidy(run), "doc_id long, row long, nr int, start int, finish int, words int, digest long, again boolean")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = UNIT,
                      least: int = LEAST) -> DataFrame:
    """(id, n_units, n_removed, spans, repeats) of every row; ``spans`` are the (start, finish) to
    remove, in order, ``repeats`` the (start, finish, words, run_words) of every repeated unit."""
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"),
                        F.xxhash64(text).alias("row"), text.alias("text"))
    found = scratch.save(units(keyed, unit), "units")
    same = ["digest", "words"]
    firsts = scratch.save(found.groupBy(*same).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
                          .where("n >= 2").select(*same, "first"), "firsts")
    repeats = found.join(firsts, same).where("again OR doc_id > first").select(
        "doc_id", "row", "nr", "start", "finish", "words").distinct()
    document = Window.partitionBy("doc_id", "row").orderBy("nr")
    runs = repeats.withColumn("run", F.col("nr") - F.row_number().over(document)).groupBy("doc_id", "row", "run").agg(
        F.sum("words").alias("words"), F.count(F.lit(1)).alias("n"), F.min("start").alias("start"),
        F.max("finish").alias("finish"), F.array_sort(F.collect_list(F.struct("start", "finish", "words"))).alias("parts"))
    passage = F.col("words") >= least
    # as many spans as a text has runs
    spans = runs.groupBy("doc_id", "row").agg(
        F.sum(F.when(passage, F.col("n"))).alias("n_removed"),
        F.array_sort(F.collect_list(F.when(passage, F.struct("start", "finish")))).alias("spans"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "words", "parts"))), lambda r: F.transform(
            r["parts"], lambda u: F.struct(u["start"].alias("start"), u["finish"].alias("finish"), u["words"].alias("words"),
                                           r["words"].alias("run_words"))))).alias("repeats"))
    counts = found.groupBy("doc_id", "row").agg((F.max("nr") + 1).cast("long").alias("n_units"))
    removed = scratch.save(counts.join(spans, ["doc_id", "row"], "left"), "removed")
    scratch.drop("units", "firsts")
    out = keyed.select("doc_id", "row").join(removed, ["doc_id", "row"], "left")
    return out.select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias(id_col), F.coalesce("n_units", F.lit(0)).alias("n_units"),
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,finish:int>>")).alias("spans"),
        F.coalesce("repeats", F.array().cast("array<struct<start:int,finish:int,words:int,run_words:bigint>>")).alias("repeats"))


def without(text: Column, spans: Column) -> Column:
    """``text`` without its ``spans``: what stands between them, joined."""
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["finish"]))
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.char_length(text)))
    return F.array_join(F.zip_with(ends, starts, lambda a, b: F.substring(text, a + 1, b - a)), "")
