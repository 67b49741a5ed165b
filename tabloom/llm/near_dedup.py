"""MinHash near-duplicates from bottom-k sketches of one hash function.

A document's set holds its distinct word shingles, each hashed to 64 bits; its
sketch is the ``k`` smallest hashes.  Steps, every one a Spark job over all rows:

1. Equal sets collapse into classes (copies are never paired).
2. Inverted lists of the retained values: values kept by one class only link
   nothing.  In each sketch the values are ordered rarest first; a pair that must
   share ``m`` of ``s`` values has to meet in the first ``s - m + 1``, so a passage
   that a third of the corpus quotes is not a list unless a sketch is mostly that.
3. In every list each member is compared with the list's most central member (the
   one with the fewest values of its own): first the union-sketch estimate of the
   Jaccard similarity, then the full sets.  Links give components.
4. Lists that still hold several components are searched completely: the
   members' full sets are ordered rarest first, prefixes are cut by the overlap
   that the two size classes demand, and members of different components that meet
   are compared.  A large group of near copies is thereby never paired with itself.

Step 4 loses no link whose two sketches met in step 2.  That fails only if fewer
than ``MET`` of a sketch is shared at a similarity of 0.8: five standard
deviations for k = 96, under one in a million; sets up to 0.8 k are exact.

Inputs: null or empty texts have an empty set, keep their row and link with
nothing.  Rows that repeat a doc_id keep a row each; classes whose smallest id is the
same are one node.  A null doc_id keeps its row with a null component and ``kept``
true.  An empty table gives an empty result.
Other columns of the input are ignored."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch
from .workers import small_batches, tidy

K = 96                # retained values
MET = 0.6             # share of a sketch that a linked pair must have in common
MARGIN = 4.5          # standard deviations left to the union-sketch estimate
SIZE_STEP = 1.05      # ratio of neighbouring size classes in the exact search
BITMAP_BITS = 1 << 22  # of the semi-join filter; fixed, so its broadcast is too
WORD_CACHE = 500_000  # hashed words a Python worker remembers
SET_VALUES = 1 << 18  # of the full sets that a worker holds before it sends them on


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def shingle_set(text: str | None, size: int, words: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``size`` words.

    A-Z is lower-cased; words end at ASCII white space.  Fewer words than ``size``
    form one shingle; no words give an empty set."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.int64)
    h = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    width = min(size, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[i:len(h) - width + 1 + i]
    return np.unique(_mix(out).view(np.int64))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    values = np.concatenate(rows) if rows else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))


def features(docs: DataFrame, shingle: int, k: int) -> DataFrame:
    """(doc_id, n, digest, sketch) of every row of ``docs`` (doc_id, text)."""
    def run(batches):
        words = _WordHash()
        for batch in batches:
            sizes, digests, sketches = [], [], []
            for text in batch.column(1):        # one full set at a time
                full = shingle_set(text.as_py(), shingle, words)
                sizes.append(len(full))
                digests.append(hashlib.blake2b(full.tobytes(), digest_size=16).digest())
                sketches.append(full[:k].copy())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), _lists(sketches)],
                ["doc_id", "n", "digest", "sketch"])
    return docs.mapInArrow(tidy(run), "doc_id long, n long, digest binary, sketch array<long>")


def _bits(ids: DataFrame) -> dict[int, int]:
    """Bitmap of hashed ids, as 64-bit words: at most BITMAP_BITS / 64 rows reach the driver."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP_BITS))
    rows = ids.select(slot.alias("slot")).distinct().groupBy(F.expr("slot div 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 AS int))")).alias("bits")).collect()
    return {r["word"]: r["bits"] for r in rows}


def _full_sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, n, digest, full) of the rows whose id is in ``ids`` (some others may pass)."""
    bits = np.zeros(BITMAP_BITS // 64, np.int64)
    for word, value in _bits(ids).items():
        bits[word] = value
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(bits)

    def run(batches):
        words, table = _WordHash(), shared.value
        for batch in batches:
            slots = batch.column(2).to_numpy(zero_copy_only=False)
            there = np.flatnonzero((table[slots // 64] >> (slots % 64)) & 1)
            ids, texts = batch.column(0), batch.column(1)
            at, sets, held = [], [], 0
            for i in there.tolist():            # texts one at a time, sets as many as fit
                at.append(i)
                sets.append(shingle_set(texts[i].as_py(), shingle, words))
                held += len(sets[-1])
                if held >= SET_VALUES or i == there[-1]:
                    digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(at)), pa.array([len(s) for s in sets], pa.int64()),
                         pa.array(digests, pa.binary()), _lists(sets)], ["doc_id", "n", "digest", "full"])
                    at, sets, held = [], [], 0
    keyed = docs.where("doc_id IS NOT NULL").select(
        "doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP_BITS)).alias("slot"))
    return keyed.mapInArrow(tidy(run), "doc_id long, n long, digest binary, full array<long>")


def _sizes_fit(percent: int):
    return F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")


def _with_sets(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """``pairs`` (a, b) with both sides' array ``column`` as ``sa``, ``sb`` and sizes."""
    one = lambda x: sets.select(F.col("doc_id").alias(x), F.col(column).alias(f"s{x}"),
                                F.col("n").alias(f"n{x}"))
    return pairs.select("a", "b").join(one("a"), "a").join(one("b"), "b")


def _verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the similarity: 100 * intersection >= percent * union."""
    both = _with_sets(pairs, full, "full").where(_sizes_fit(percent)).withColumn(
        "met", F.size(F.array_intersect("sa", "sb")))
    return both.where(f"100 * met >= {percent} * (na + nb - met)").select("a", "b")


def _prefixes(rows: DataFrame, kept: str, need: str) -> DataFrame:
    """The part of ``rows`` (doc_id, n, value, df >= 2) among the rarest ``need`` of a
    document's ``kept`` values; values of one document only (df 1) come first and are not in ``rows``."""
    from pyspark.sql import Window
    of_doc = Window.partitionBy("doc_id")
    ranked = rows.withColumn("place", F.row_number().over(of_doc.orderBy("df", "value"))) \
        .withColumn("own", F.expr(kept) - F.count(F.lit(1)).over(of_doc))
    return ranked.withColumn("place", F.col("place") + F.col("own")).where(f"place <= {need}")


def _shared_values(rows: DataFrame) -> DataFrame:
    """``rows`` (value, ...) whose value occurs more than once, with the count ``df``."""
    often = rows.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df >= 2")
    return rows.join(often, "value")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                    percent: int = 80, k: int = K) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``; see the module text."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with small_batches(spark):
        feats = scratch.save(features(docs, shingle, k), "features")
    live = feats.where("n > 0 AND doc_id IS NOT NULL")
    # classes of equal sets, by their smallest id; one id in several classes links them
    classes = scratch.save(live.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    reps = scratch.save(live.join(classes.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"])
                        .dropDuplicates(["digest", "doc_id"]).select("doc_id", "n", "sketch"), "sketches")

    # lists of the retained values, rarest first
    s = f"least(n, {k})"
    met = f"IF(1.25 * n <= {k}, ceil({percent} * n / 100), floor({MET} * {s}))"
    values = reps.select("doc_id", "n", F.explode("sketch").alias("value"))
    lists = scratch.save(_prefixes(_shared_values(values), s, f"{s} - {met} + 1")
                         .select("value", "doc_id", "n", "own"), "lists")

    # every member against the most central one
    centres = lists.groupBy("value").agg(F.min(F.struct("own", "doc_id")).alias("c"))
    centres = scratch.save(centres.select("value", F.col("c.doc_id").alias("centre")), "centres")
    star = lists.join(centres, "value").where("doc_id <> centre").select(
        F.least("doc_id", "centre").alias("a"), F.greatest("doc_id", "centre").alias("b")).distinct()
    sd = f"sqrt({percent / 100} * {1 - percent / 100} / {k})"
    near = _with_sets(star, reps, "sketch").where(_sizes_fit(percent)).withColumn(
        "low", F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)).withColumn(
        "met", F.size(F.array_intersect(F.array_intersect("low", "sa"), "sb"))).where(
        f"met >= ({percent / 100} - IF(na + nb <= {k}, 0, {MARGIN} * {sd})) * size(low) - 1e-9")
    near = scratch.save(near.select("a", "b").distinct(), "near")
    with small_batches(spark):
        full = scratch.save(_full_sets(docs, lists.select("doc_id"), shingle)
                            .join(classes.select("digest", F.col("rep").alias("doc_id")), ["digest", "doc_id"])
                            .dropDuplicates(["digest", "doc_id"]).select("doc_id", "n", "full"), "full")
    first = connected_components(_verified(near, full, percent), scratch, "star")

    # lists with several components: the exact search
    label = lambda df: df.join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn(
        "component", F.coalesce("component", "doc_id"))
    marked = scratch.save(label(lists).select("value", "doc_id", "component"), "marked")
    mixed = marked.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi")) \
        .where("lo <> hi").select("value")
    open_docs = scratch.save(marked.join(mixed, "value").select("doc_id", "component").distinct(), "open")
    rest = _residual_pairs(full.join(open_docs, "doc_id"), scratch, percent)
    second = _verified(rest, full, percent)
    second = second.join(first.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(
        first.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left").select(
        F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = connected_components(second, scratch, "rest")

    final = first.join(merged.select(F.col("node").alias("component"), F.col("component").alias("root")),
                       "component", "left").select(F.col("node").alias("rep"),
                                                   F.coalesce("root", "component").alias("component"))
    final = final.unionByName(merged.join(first.select("node"), "node", "left_anti").select(
        F.col("node").alias("rep"), "component"))
    final = scratch.save(classes.join(final, "rep").where("component <> rep").select("rep", "component"), "final")
    named = scratch.save(classes.join(final.distinct(), "rep", "left").select(
        "digest", F.coalesce("component", "rep").alias("component")), "named")
    scratch.drop("full", "lists", "marked", "near", "open", "sketches", "centres", "final")
    out = feats.select("doc_id", "n", "digest").join(named, "digest", "left")
    own = F.when(F.col("n") > 0, F.least("component", "doc_id")).otherwise(F.col("doc_id"))
    own = F.when(F.col("doc_id").isNotNull(), own)
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"),
                      F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def _residual_pairs(sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Pairs of different components that may reach the similarity, from full sets
    (doc_id, n, full, component).  Exact: two sets with an overlap of at least o share
    one of the n - o + 1 rarest elements of each, and o follows from the sizes."""
    step = float(np.log(SIZE_STEP))
    ratio = percent / (100 + percent)
    rows = sets.select("doc_id", "n", "component", F.explode("full").alias("value"))
    ranked = _prefixes(_shared_values(rows), "n", f"n - ceil({percent} * n / 100) + 1")
    reach = int(np.ceil(np.log(100 / percent) / step)) + 1
    size_class = f"cast(floor(ln(n) / {step}) AS int)"
    # for each class of partner sizes, the prefix that the least overlap demands
    keyed = ranked.withColumn("own_class", F.expr(size_class)).withColumn(
        "other", F.explode(F.expr(f"sequence(own_class - {reach}, own_class + {reach})"))).where(
        f"place <= n - ceil({ratio} * (n + floor(exp(other * {step}) * (1 - 1e-9))) - 1e-9) + 1").select(
        "value", F.least("own_class", "other").alias("lo"), F.greatest("own_class", "other").alias("hi"),
        "doc_id", "n", "place", "component")
    keyed = scratch.save(keyed, "residual")
    key = ["value", "lo", "hi"]
    mixed = keyed.groupBy(*key).agg(F.min("component").alias("x"), F.max("component").alias("y")) \
        .where("x <> y").select(*key)
    parts = scratch.save(keyed.join(mixed, key), "parts")
    # a member can meet a partner of size m only if place <= n + 1 - ratio * (n + m)
    groups = parts.groupBy(*key, "component").agg(
        F.min(F.expr(f"place - (1 - {ratio}) * n")).alias("reach"), F.min("n").alias("least"))
    group = lambda x: groups.select(*key, *(F.col(c).alias(f"{c}_{x}") for c in ("component", "reach", "least")))
    met = group("a").join(group("b"), key).where(
        "component_a < component_b"
        f" AND reach_a <= 1.000001 - {ratio} * least_b AND reach_b <= 1.000001 - {ratio} * least_a")
    side = lambda x: parts.select(*key, F.col("component").alias(f"component_{x}"), F.col("doc_id").alias(x),
                                  F.col("n").alias(f"n{x}"), F.col("place").alias(f"place_{x}"))
    overlap = f"ceil({ratio} * (na + nb) - 1e-9)"
    pairs = met.join(side("a"), [*key, "component_a"]).join(side("b"), [*key, "component_b"]).where(
        _sizes_fit(percent)).where(f"place_a <= na - {overlap} + 1 AND place_b <= nb - {overlap} + 1")
    out = scratch.save(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "rest")
    scratch.drop("residual", "parts")
    return out
