"""Byte-level BPE encoding and decoding.

Merging is a Spark expression: ``encode_words`` folds ranked merges over the byte
pieces of each distinct word with higher-order functions and a rank map that is a
literal of the plan (hash buckets of a few entries, so a look-up is constant time).

Texts meet the words without any shuffle of texts or word occurrences:

1. Words are counted over all documents (combined in each task, then by key).
2. Words frequent enough that at most ``frequent`` of them qualify (the bound comes
   from a histogram of the counts over the whole vocabulary) are folded once; that
   bounded table goes to the workers.
3. One pass over the documents emits ids for those words and lists the distinct other
   words of each portion; the same fold encodes them in the next operator of the same
   stage, and the last operator puts their ids into place and decodes.

Decoding concatenates the binary pieces of the ids.  Words above ``FOLD_BYTES`` bytes
(a fold is quadratic in the word) are merged by a heap in the worker instead.

What a task holds is bounded by its portions only while the texts come in small batches:
``encode`` counts inside ``small_batches``, and who executes its result should too
(``encoded`` does, and writes the columns it is asked for).

Inputs: a null or empty text has no ids; null ids, repeated rows and texts of any
length keep one row each; other columns are ignored."""

from __future__ import annotations

import base64
import heapq
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .pretokens import portions, splitter
from .scratch import Scratch
from .workers import give_back, small_batches, tidy

BUCKETS = 1 << 15
FREQUENT = 1 << 20          # words whose ids the workers hold
FOLD_BYTES = 48
PORTION_CHARS = 1_000_000   # characters of the documents handled at a time; about 40 bytes of worker memory each
COUNT_CHARS = 4_000_000     # characters whose words are counted at a time
OPEN = 1 << 31              # marks the place of a word that is encoded later


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file: one base64 piece and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


def rank_map(spark: SparkSession, ranks: dict[bytes, int]) -> str:
    """JSON array of buckets {hexadecimal piece: rank}, by the low bits of Spark's ``hash``."""
    rows = spark.createDataFrame([(p.hex().upper(), r) for p, r in ranks.items()], "piece string, rank int")
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank, slot in rows.select("piece", "rank", F.hash("piece").bitwiseAND(BUCKETS - 1)).collect():
        buckets[slot][piece] = rank                  # as many rows as the vocabulary file has
    return json.dumps(buckets, separators=(",", ":"))


def _rank(piece: Column, table: Column) -> Column:
    """Rank of a piece, null if no piece is spelled so."""
    bucket = F.get(table, F.hash(piece).bitwiseAND(BUCKETS - 1))
    return bucket[piece]


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def encode_words(word: Column, table: Column) -> Column:
    """``_encode_words`` with the literal ``table`` once in the plan."""
    return _let(table, lambda t: _encode_words(word, t))


def _encode_words(word: Column, table: Column) -> Column:
    """Ids (array<int>) of a binary ``word``: while some adjacent pieces join to a known
    piece, the leftmost pair of lowest rank becomes one piece.

    The fold's state holds the bounds ``b`` of the pieces (in hexadecimal digits) and at
    each piece the rank ``o`` of its pair with the next one (null if they don't join).  A
    merge takes one bound away and looks up only the two pairs that it changes; bounds
    outside the word are null, and so are the ranks of what they would bound."""
    digits = F.octet_length(word) * 2

    def fold(hexed: Column) -> Column:
        rank = lambda start, end: _rank(F.substring(hexed, start + 1, end - start), table)

        def merge(b: Column, o: Column, at: Column) -> Column:
            """Joins pieces ``at`` and ``at + 1``."""
            return F.struct(
                F.filter(b, lambda x, i: i != at + 1).alias("b"),
                F.transform(F.filter(o, lambda x, i: i != at), lambda x, i: F.when(
                    i == at, rank(F.get(b, at), F.get(b, at + 3))).when(
                    i == at - 1, rank(F.get(b, at - 1), F.get(b, at + 2))).otherwise(x)).alias("o"))

        def step(s: Column, _: Column) -> Column:
            best = F.array_position(s["o"], F.array_min(s["o"])).cast("int") - 1
            return _let(best, lambda at: F.when(at.isNull(), s).otherwise(merge(s["b"], s["o"], at)))
        start = _let(F.sequence(F.lit(0), digits, F.lit(2)), lambda b: F.struct(b.alias("b"), F.transform(
            b, lambda x, i: rank(x, F.get(b, i + 2))).alias("o")))
        return F.aggregate(F.sequence(F.lit(4), F.greatest(digits, F.lit(4)), F.lit(2)), start, step, lambda s: F.transform(
            F.filter(s["b"], lambda x: x < digits), lambda x, i: rank(x, F.get(s["b"], i + 1))))
    return _let(F.hex(word), fold)


def heap_merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a long word: the same merges, lowest rank and leftmost first, from a heap."""
    pieces: list[bytes | None] = [word[i:i + 1] for i in range(len(word))]
    after = list(range(1, len(word))) + [-1]
    before = list(range(-1, len(word) - 1))
    heap: list[tuple[int, int, bytes]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] >= 0:
            joined = pieces[i] + pieces[after[i]]
            if joined in ranks:
                heapq.heappush(heap, (ranks[joined], i, joined))
    for i in range(len(word)):
        offer(i)
    while heap:
        _, i, joined = heapq.heappop(heap)
        if pieces[i] is None or after[i] < 0 or pieces[i] + pieces[after[i]] != joined:
            continue
        gone = after[i]
        pieces[i], pieces[gone], after[i] = joined, None, after[gone]
        if after[i] >= 0:
            before[after[i]] = i
        offer(i)
        offer(before[i])
    return [ranks[p] for p in pieces if p is not None]


def count_words(texts: DataFrame, pattern: str) -> DataFrame:
    """(word, n) over all rows of ``texts`` (id, text); words as binary, at most FOLD_BYTES long."""
    def run(batches):
        split = splitter(pattern)
        for _, part in portions(batches, COUNT_CHARS):
            found = _words(part, split).value_counts()
            short = found.filter(pc.less_equal(pc.binary_length(found.field("values")), FOLD_BYTES))
            yield pa.RecordBatch.from_arrays([short.field("values"), short.field("counts")], ["word", "n"])
    return texts.mapInArrow(tidy(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, bound: int) -> DataFrame:
    """The words of the counts that make at most ``bound`` words, most frequent first."""
    level = F.least(F.col("n"), F.lit(1 << 16))
    steps = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect()
    least, held = 1 << 16, 0
    for r in sorted(steps, key=lambda r: -r["level"]):
        held += r["words"]
        if held > bound:
            break
        least = r["level"]
    return counts.where(F.col("n") >= least)


def encode(docs: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           frequent: int = FREQUENT, portion: int = PORTION_CHARS) -> DataFrame:
    """(id, ids, text) of every row: ``ids`` are the token ids as little-endian unsigned
    32-bit integers, ``text`` is what they decode to."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ranks = load_ranks(ranks_file)
    table = F.from_json(F.lit(rank_map(spark, ranks)), "array<map<string,int>>")
    with small_batches(spark):
        counts = scratch.save(count_words(texts, pattern), "words")
    words = frequent_words(counts, min(frequent, FREQUENT))
    known = scratch.save(words.select("word", encode_words(F.col("word"), table).alias("ids")), "known")
    shared = spark.sparkContext.broadcast(_Known.of(known))            # at most FREQUENT words
    scratch.drop("words", "known")
    give_back(spark)
    pieces = spark.sparkContext.broadcast(ranks)        # as large as the vocabulary file

    def first(batches):
        split, known = splitter(pattern), shared.value
        for ids, part in portions(batches, portion):
            codes, rare = known.codes([split(t) for t in part], pieces.value)
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids], pa.list_(pa.int64())), pa.array([codes], pa.list_(pa.binary())),
                 pa.array([rare], pa.list_(pa.binary()))], ["doc_ids", "codes", "rare"])

    def last(batches):
        by_id = np.empty(max(pieces.value.values()) + 1, object)
        for piece, i in pieces.value.items():
            by_id[i] = piece
        for batch in batches:
            for ids, codes, found in zip(*(batch.column(i) for i in range(3))):
                # a slice of a larger array: its offsets don't start at 0
                done = found.values
                flat, ends = done.flatten().to_numpy(zero_copy_only=False).astype(np.uint32), done.offsets.to_numpy()
                tokens = [_placed(np.frombuffer(c.as_buffer(), "<u4"), flat, ends - ends[0]) for c in codes.values]
                yield pa.RecordBatch.from_arrays(
                    [ids.values, pa.array([t.tobytes() for t in tokens], pa.binary()),
                     pa.array([b"".join(by_id[t]) for t in tokens], pa.binary())],
                    ["doc_id", "ids", "text"])
    portioned = texts.mapInArrow(tidy(first), "doc_ids array<long>, codes array<binary>, rare array<binary>")
    folded = portioned.select("doc_ids", "codes", F.transform("rare", lambda w: encode_words(w, table)).alias("rare"))
    return folded.mapInArrow(tidy(last), "doc_id long, ids binary, text binary").withColumnRenamed("doc_id", id_col)


def encoded(docs: DataFrame, ranks_file: str, pattern: str, *columns: Column | str) -> DataFrame:
    """``columns`` of ``encode``'s result, written once while texts pass in small batches."""
    coded = encode(docs, ranks_file, pattern).select(*columns)
    with small_batches(docs.sparkSession):
        return Scratch(docs.sparkSession).save(coded, "coded")


def _words(texts: list[str], split) -> pa.Array:
    """All words of some texts, end to end, as binary."""
    found = [w for t in texts for w in split(t)]
    return pa.array(found, pa.string()).cast(pa.binary())


def _spread(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + size], end to end."""
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)
    return flat[at]


def _hashes(words: pa.Array) -> np.ndarray:
    """A 32-bit number (FNV-1a) of each of some binary words without nulls; a step for each byte of the longest."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    starts, sizes = ends[:-1], np.diff(ends)
    found, live = np.full(len(words), 0x811C9DC5, np.uint32), np.arange(len(words))
    for i in range(sizes.max(initial=0)):
        live = live[sizes[live] > i]
        data = np.frombuffer(words.buffers()[2], np.uint8)
        found[live] = (found[live] ^ data[starts[live] + i]) * np.uint32(0x01000193)
    return found


class _Known:
    """The frequent words and their ids, as Arrow and numpy arrays in order of the words' hashes: a
    look-up is a binary search, while a hash table of all words would be built anew for each portion."""

    def __init__(self, table: pa.Table):
        # the driver does this: one column at a time, and hashes by chunk
        hashes = np.concatenate([np.zeros(0, np.uint32), *(_hashes(c.cast(pa.binary())) for c in table.column("word").chunks)])
        order = np.argsort(hashes)
        self.hashes, order = hashes[order], pa.array(order.astype(np.int32))
        self.words = table.column("word").combine_chunks().cast(pa.binary()).take(order)
        table = table.select(["ids"])
        ids = table.column("ids").combine_chunks().take(order)
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        self.flat = flat.astype(np.min_scalar_type(int(flat.max(initial=0))))
        self.ends = (ids.offsets.to_numpy() - ids.offsets[0].as_py()).astype(np.uint32)

    @classmethod
    def of(cls, known: DataFrame) -> _Known:
        """From a frame (word, ids); what came from Spark is given back before the result travels."""
        found = cls(known.toArrow())
        give_back(known.sparkSession)
        return found

    def places(self, words: pa.Array) -> np.ndarray:
        """Where each of some binary words stands, or -1.  Of words with equal hashes one may be
        missed, which is then encoded like the words that aren't frequent."""
        found = np.full(len(words), -1)
        if not len(self.words):
            return found
        short = np.flatnonzero(pc.binary_length(words).to_numpy(zero_copy_only=False) <= FOLD_BYTES)
        words = words.take(pa.array(short))
        hashes = _hashes(words)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        same = np.flatnonzero(self.hashes[at] == hashes)
        equal = pc.equal(words.take(pa.array(same)), self.words.take(pa.array(at[same])))
        same = same[equal.to_numpy(zero_copy_only=False)]
        found[short[same]] = at[same]
        return found

    def codes(self, found: list[list[str]], ranks: dict[bytes, int]) -> tuple[list[bytes], list[bytes]]:
        """(ids of each document as bytes, words still open); the place of an open word holds
        OPEN plus its number.  Long words are merged here."""
        coded = pa.array([w for f in found for w in f], pa.string()).cast(pa.binary()).dictionary_encode()
        each = coded.indices.to_numpy(zero_copy_only=False)
        words = coded.dictionary
        at = self.places(words)
        extra, rare = [], []                     # runs of the words that aren't known
        starts, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        known = at >= 0
        sizes[known] = self.ends[at[known] + 1] - self.ends[at[known]]
        starts[known] = np.cumsum(sizes[known]) - sizes[known]
        runs = _spread(self.flat, self.ends[at[known]].astype(np.int64), sizes[known])
        held = len(runs)
        for i in np.flatnonzero(~known).tolist():
            word = words[i].as_py()
            if len(word) > FOLD_BYTES:
                run = heap_merge(word, ranks)
            else:
                run = [OPEN + len(rare)]
                rare.append(word)
            starts[i], sizes[i] = held, len(run)
            held += len(run)
            extra += run
        flat = np.concatenate([runs, np.array(extra, np.uint32)])
        tokens = _spread(flat, starts[each], sizes[each]).astype("<u4")
        counts = np.array([len(f) for f in found], np.int64)
        until = np.r_[0, np.cumsum(sizes[each])][np.r_[0, np.cumsum(counts)]]
        return [tokens[a:b].tobytes() for a, b in zip(until[:-1], until[1:])], rare


def _placed(tokens: np.ndarray, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``tokens`` with every open place replaced by the ids flat[ends[i] : ends[i + 1]] of its word."""
    there = tokens >= OPEN
    if not there.any():
        return tokens
    number = np.where(there, tokens - np.uint32(OPEN), 0).astype(np.int64)
    both = np.concatenate([flat, tokens])
    sizes = np.where(there, np.diff(ends)[number], 1)
    starts = np.where(there, ends[number], len(flat) + np.arange(len(tokens)))
    return _spread(both, starts, sizes).astype("<u4")
