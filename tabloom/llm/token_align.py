"""Cross-tokenizer alignment: which tokens of two tokenizers end at the same byte.

A text is encoded by a byte-level BPE (A, with a space before the text) and by a
sentencepiece model (B, which adds that space itself).  A dictionary from the
cumulative byte end of every token to its index is made for either side; the
intersection of their key sets, sorted, slices both id lists into groups, and every
slice gives its links: the pair of tokens, one of either side, whose byte ranges end
together at the slice's end (tokens hold a byte at least, so a slice has one).

``align`` writes one row a document, with its distinct linked id pairs and how often
it holds each.  ``link_counts`` sums them over the corpus (tasks add up their own
pairs before the shuffle).  ``score_links`` brings the counts back: pairs above a
count that at most ``FREQUENT`` pairs reach go to every task as sorted arrays, all
others are joined by pair, so no pair of many documents is a hot key, whatever the
number of distinct pairs.  Nothing is left out.

Inputs: a text that is null or empty, or whose tokens of either side do not spell the
space and the text, has no tokens: zeros, and '' for the groups.  Null ids, repeated
rows and texts of any length keep a row each; ties for the highest count of a B id
are all best; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .pretokens import portions
from .scratch import Scratch
from .token_counts import byte_symbols
from .workers import tidy

FREQUENT = 1 << 18         # pairs whose counts every task holds (16 bytes each)
PORTION_CHARS = 1_000_000  # characters encoded at a time
PENDING = 1 << 21          # pairs a task adds up at a time
STEPS = 16                 # steps of the histogram of counts to the factor of two
LONG_SPACE = re.compile(r"\s{10000}")
SHIFT = 32                 # a pair as one number: A id << SHIFT | B id


class Coders:
    """Both tokenizers, from the contents of their files, with the bytes of every token.

    Where the ids of A follow the order of its merges, tiktoken gives the ids that the
    tokenizers library gives, over the same vocabulary and several times as fast; it cannot
    split very long white space, so texts with such take the library itself."""

    def __init__(self, json_file: bytes, model_file: bytes, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_buffer(json_file)
        self.a.encode_special_tokens = True   # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model_file)
        symbols = byte_symbols()
        spec = json.loads(json_file)
        vocab, special = self.a.get_vocab(), {t["content"] for t in spec.get("added_tokens", [])}
        bytes_a = [b""] * (max(vocab.values()) + 1)
        for entry, i in vocab.items():
            bytes_a[i] = entry.encode() if entry in special else bytes(symbols[c] for c in entry)
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        self.fast = tiktoken.Encoding("a", pat_str=pattern, special_tokens={}, mergeable_ranks={
            bytes_a[i]: i for entry, i in vocab.items() if entry not in special}) if made == list(range(256, 256 + len(made))) else None
        bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.bytes = (bytes_a, bytes_b)
        self.sizes = tuple(np.array([len(x) for x in side]) for side in self.bytes)
        # every id as text, within a group and at its end
        self.names = tuple(tuple(np.array([f"{i}{mark}" for i in range(len(side))], object) for mark in marks)
                           for side, marks in zip(self.bytes, (",|", ",;")))

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or LONG_SPACE.search(text):
            return np.array(self.a.encode(" " + text, add_special_tokens=False).ids, np.int64)
        return self.fast.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int64)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of either side; two empty arrays where the tokens do not spell the text."""
        out = []
        for text, b in zip(texts, self.b.encode(texts, num_threads=1)):
            a, whole = self.ids(text), (" " + text).encode()
            ids = a.tolist()
            spelled = self.fast.decode_bytes(ids) if self.fast else b"".join(map(self.bytes[0].__getitem__, ids))
            fits = text and spelled == whole and b"".join(map(self.bytes[1].__getitem__, b)) == whole
            out.append((a, np.array(b, np.int64)) if fits else (np.zeros(0, np.int64),) * 2)
        return out

    def slices(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ends in a, ends in b) of the groups: where tokens of both sides end."""
        index_a, index_b = (dict(zip(np.cumsum(size[ids]).tolist(), range(1, len(ids) + 1)))
                            for size, ids in zip(self.sizes, (a, b)))
        common = sorted(index_a.keys() & index_b.keys())
        return tuple(np.array(list(map(index.__getitem__, common)), np.int64) for index in (index_a, index_b))

    def groups(self, a: np.ndarray, b: np.ndarray, ends: tuple[np.ndarray, np.ndarray]) -> str:
        """``a1,a2|b1;a3|b2,b3``: the ids of every group in order."""
        parts = np.empty(len(a) + len(b), object)
        # before a group stand the tokens of both sides of the earlier ones, before its b also its a
        before = (np.r_[0, ends[1]][:-1], ends[0])
        for ids, end, other, (inner, last) in zip((a, b), ends, before, self.names):
            names = inner[ids]
            names[end - 1] = last[ids[end - 1]]
            parts[np.arange(len(ids)) + np.repeat(other, np.diff(end, prepend=0))] = names
        return "".join(parts.tolist())[:-1]


def align(docs: DataFrame, tokenizer: str, model: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
          digest: bool = True) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, pair_a, pair_b, times) of every row, for the file
    ``tokenizer`` that splits texts by ``pattern``, and the file ``model``: ``groups`` as text or, with ``digest``, the SHA-256 of that text; the distinct linked pairs as sorted arrays."""
    spark = docs.sparkSession
    ship_package(spark)
    with open(tokenizer, "rb") as f, open(model, "rb") as g:
        shared = spark.sparkContext.broadcast((f.read(), g.read()))   # the two vocabulary files

    def run(batches):
        coders = Coders(*shared.value, pattern)
        for ids, texts in portions(batches, PORTION_CHARS):
            counts, groups, pairs, times = [], [], [], []
            for a, b in coders.encode(texts):
                ends = coders.slices(a, b)
                text = coders.groups(a, b, ends)
                groups.append(hashlib.sha256(text.encode()).hexdigest() if digest and text else text)
                linked = (a[ends[0] - 1] << SHIFT) | b[ends[1] - 1]   # the last tokens of every slice
                found, n = np.unique(linked, return_counts=True)
                counts.append((len(a), len(b), len(ends[0]), len(linked)))
                pairs.append(found)
                times.append(n)
            flat = np.concatenate([*pairs, np.zeros(0, np.int64)])
            offsets = pa.array(np.r_[0, np.cumsum([len(x) for x in pairs])].astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in
                     (flat >> SHIFT, flat & ((1 << SHIFT) - 1), np.concatenate([*times, np.zeros(0, np.int64)]))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(4)),
                 pa.array(groups, pa.string()), *lists],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pair_a", "pair_b", "times"])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
                                      "pair_a array<int>, pair_b array<int>, times array<int>")


def _flat(batch: pa.RecordBatch, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs as numbers, times, place of the row) of three list columns from ``first`` on."""
    a, b, n = (batch.column(first + i) for i in range(3))
    values = [x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b, n)]
    sizes = np.diff(a.offsets.to_numpy())
    return (values[0] << SHIFT) | values[1], values[2], np.repeat(np.arange(len(a)), sizes)


def link_counts(aligned: DataFrame) -> DataFrame:
    """(pair_a, pair_b, n): links of every id pair over all rows of ``aligned``."""
    def run(batches):
        def total(parts):
            keys, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            # sums of whole numbers below 2 ** 53 are exact
            return keys, np.bincount(place, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)
        parts, held = [], 0
        for batch in batches:
            keys, times, _ = _flat(batch, 0)
            parts.append((keys, times))
            held += len(keys)
            if held >= PENDING:
                parts = [total(parts)]
                held = len(parts[0][0])
                if 2 * held >= PENDING:
                    yield _pairs(*parts[0])
                    parts, held = [], 0
        if parts:
            yield _pairs(*total(parts))
    rows = aligned.select("pair_a", "pair_b", "times").mapInArrow(tidy(run), "pair_a int, pair_b int, n long")
    return rows.groupBy("pair_a", "pair_b").agg(F.sum("n").alias("n"))


def _pairs(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array((keys >> SHIFT).astype(np.int32)), pa.array((keys & ((1 << SHIFT) - 1)).astype(np.int32)), pa.array(n)],
        ["pair_a", "pair_b", "n"])


def _least_frequent(counts: DataFrame, most: int) -> int:
    """The smallest count such that no more than ``most`` pairs have it or more, to a step of a
    histogram whose rows grow with the logarithm of the counts only."""
    step = F.floor(F.log2(F.col("n")) * STEPS).cast("int")
    bins = sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("pairs"), F.max("n").alias("high")).collect(),
                  reverse=True)
    held, least = 0, 1 << 62
    for _, pairs, high in bins:
        if held + pairs > most:
            return high + 1
        held, least = held + pairs, 1
    return least


def score_links(aligned: DataFrame, scratch: Scratch, frequent: int = FREQUENT) -> DataFrame:
    """``aligned`` (a written table with a column ``row``, distinct and not null) with n_best, the
    links whose pair's count is the highest of their B id, and count_sum, the counts summed over links."""
    spark = aligned.sparkSession
    counts = scratch.save(link_counts(aligned), "counts")
    best = counts.groupBy("pair_b").agg(F.max("n").alias("best"))   # a row an id of the vocabulary
    least = _least_frequent(counts, frequent)
    top = counts.where(F.col("n") >= least).join(best, "pair_b").select("pair_a", "pair_b", "n", (F.col("n") == F.col("best")).alias("is_best"))
    top = top.toArrow()   # at most ``frequent`` rows
    keys = (top["pair_a"].to_numpy().astype(np.int64) << SHIFT) | top["pair_b"].to_numpy()
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[order], top["n"].to_numpy()[order], top["is_best"].to_numpy()[order]))

    def run(batches):
        known, n, is_best = shared.value
        for batch in batches:
            wanted, times, place = _flat(batch, 1)
            at = np.minimum(np.searchsorted(known, wanted), max(len(known) - 1, 0))
            hit = known[at] == wanted if len(known) else np.zeros(len(wanted), bool)
            size = batch.num_rows
            got, count = at[hit], times[hit]
            sums, bests = np.zeros(size, np.int64), np.zeros(size, np.int64)
            np.add.at(sums, place[hit], n[got] * count)
            np.add.at(bests, place[hit], is_best[got] * count)
            rest = ~hit
            offsets = pa.array(np.r_[0, np.cumsum(np.bincount(place[rest], minlength=size))].astype(np.int32))
            pairs = pa.StructArray.from_arrays(
                [pa.array((wanted[rest] >> SHIFT).astype(np.int32)), pa.array((wanted[rest] & ((1 << SHIFT) - 1)).astype(np.int32)),
                 pa.array(times[rest])], ["pair_a", "pair_b", "times"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bests), pa.array(sums), pa.ListArray.from_arrays(offsets, pairs)],
                                             ["row", "n_best", "count_sum", "rest"])
    found = scratch.save(aligned.select("row", "pair_a", "pair_b", "times").mapInArrow(
        tidy(run), "row long, n_best long, count_sum long, rest array<struct<pair_a:int,pair_b:int,times:long>>"), "found")
    rare = found.select("row", F.explode("rest").alias("p")).select("row", "p.*")
    rare = rare.join(counts.where(F.col("n") < least), ["pair_a", "pair_b"]).join(best, "pair_b").select(
        "row", F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("n") * F.col("times")).alias("count_sum"))
    scored = found.select("row", "n_best", "count_sum").union(rare).groupBy("row").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.join(scored, "row")


def cross_alignment(docs: DataFrame, tokenizer: str, model: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                    frequent: int = FREQUENT, digest: bool = True) -> DataFrame:
    """Every row of ``docs`` aligned and scored: the columns of ``align`` with n_best and count_sum."""
    scratch = Scratch(docs.sparkSession)
    aligned = scratch.save(align(docs, tokenizer, model, pattern, id_col, text_col, digest).withColumn(
        "row", F.monotonically_increasing_id()), "aligned")
    return score_links(aligned, scratch, frequent)
