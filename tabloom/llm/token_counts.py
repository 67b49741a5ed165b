"""Token counts by rank-synchronous array merging.

The distinct pre-tokens of a portion of documents lie end to end in one ragged
numpy array.  In every round each sequence finds its lowest-rank adjacent pair and
all sequences apply theirs at once, at each place it stands (left to right where
places overlap); a sequence with no mergeable pair leaves with its symbol count.
Applying all places of a pair at once equals merging them one by one, because a
pair that holds a merged symbol always ranks after the merge that made the symbol.

Inputs: a null or empty text has 0 bytes and 0 tokens; null ids, repeated rows and
texts of any length keep one row each; other columns are ignored."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .pretokens import portions, splitter
from .workers import tidy

PORTION_CHARS = 2_000_000   # characters whose pre-tokens are held at a time
CHUNK_BYTES = 1 << 20       # bytes merged at a time
CACHE_WORDS = 400_000       # counts a Python worker remembers
NEVER = np.int32(2**31 - 1)


def byte_symbols() -> dict[str, int]:
    """Byte-level alphabet: printable Latin-1 characters stand for themselves, the
    other bytes for the characters from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_merges(path: str) -> dict:
    """Merge table of a byte-level BPE ``tokenizer.json``: sorted pair keys with the
    rank of each, the symbol each rank makes, the symbols of single bytes, and the
    special strings that stand for one token each."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
    keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
    order = np.argsort(keys, kind="stable")
    first = np.zeros(256, np.int32)
    for ch, b in byte_symbols().items():
        first[b] = vocab[ch]
    return {"keys": keys[order], "ranks": order.astype(np.int32), "first": first,
            "made": np.array([vocab[a + b] for a, b in pairs], np.int32),
            "special": [t["content"] for t in spec.get("added_tokens", [])]}


def merged_lengths(words: list[bytes], table: dict) -> np.ndarray:
    """Symbols left of each of ``words`` when no pair can be merged any more."""
    keys, ranks, made = table["keys"], table["ranks"], table["made"]
    out = np.zeros(len(words), np.int64)
    sizes = np.array([len(w) for w in words], np.int64)
    seq = np.repeat(np.arange(len(words)), sizes)
    sym = table["first"][np.frombuffer(b"".join(words), np.uint8)].astype(np.int64)
    while len(sym):
        # the rank of each symbol with its right neighbour in the same sequence
        rank = np.full(len(sym), NEVER, np.int32)
        inside = np.flatnonzero(seq[:-1] == seq[1:])
        pair = (sym[inside] << 32) | sym[inside + 1]
        at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        known = keys[at] == pair
        rank[inside[known]] = ranks[at[known]]
        starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
        lengths = np.diff(np.r_[starts, len(seq)])
        best = np.minimum.reduceat(rank, starts)
        ended = best == NEVER
        out[seq[starts[ended]]] = lengths[ended]
        best = np.repeat(best, lengths)
        hit = (rank == best) & (best != NEVER)
        # of adjacent places (a pair of equal symbols) every second one is free
        place = np.arange(len(hit))
        run = place - np.maximum.accumulate(np.where(hit, -1, place))
        hit &= run % 2 == 1
        sym[hit] = made[best[hit]]
        keep = np.repeat(~ended, lengths)
        keep[1:] &= ~hit[:-1]
        sym, seq = sym[keep], seq[keep]
    return out


class _Counts(dict):
    """Token counts of pre-tokens; unknown ones are merged together, in chunks."""

    def __init__(self, table: dict):
        super().__init__()
        self.table = table

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > CACHE_WORDS:
            self.clear()
            new = list(words)
        chunk: list[bytes] = []
        names: list[str] = []
        held = 0
        for i, w in enumerate(new):
            names.append(w)
            chunk.append(w.encode("utf-8", "surrogatepass"))
            held += len(chunk[-1])
            if held >= CHUNK_BYTES or i == len(new) - 1:
                self.update(zip(names, merged_lengths(chunk, self.table).tolist()))
                chunk, names, held = [], [], 0


def token_counts(docs: DataFrame, tokenizer: str, pattern: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row, as the library counts them for the file
    ``tokenizer``: special strings in a text are one token each, none is added."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(load_merges(tokenizer))  # as large as the vocabulary file

    def run(batches):
        table = shared.value
        split, counts = splitter(pattern), _Counts(table)
        special = regex.compile("|".join(map(regex.escape, sorted(table["special"], key=len, reverse=True)))) \
            if table["special"] else None
        for ids, texts in portions(batches, PORTION_CHARS):
            found, extra = [], []
            for t in texts:
                parts = special.split(t) if special else [t]
                extra.append(len(parts) - 1)
                found.append(split(t) if len(parts) == 1 else [w for p in parts for w in split(p)])
            counts.learn(set().union(*found))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()),
                 pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                 pa.array([sum(map(counts.__getitem__, f)) + e for f, e in zip(found, extra)], pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, n_bytes long, n_tokens long")
