"""Conversation structure repair by a rank-convergence parallel Viterbi search.

A conversation's roles have to read ``(s?(ua)+)?`` by their initials.  Every row is kept
(0), given the role that is due (1) or deleted (2, the only edit of a blank or repeated
row); an empty turn of the due role can be inserted anywhere (5); a truncated row that
stays costs 5 more.  The automaton has four states (nothing yet, after s, after u, after
a), so the costs of the rest of a conversation are a vector of four numbers, and a row is
a min-plus matrix.

Rows are range-partitioned by conversation and order, which cuts a large conversation
into pieces, and pieces into chunks of at most ``CHUNK_ROWS`` rows and ``CHUNK_CHARS``
characters.  A conversation that lies within one chunk is solved where it stands.  The
chunks of all others run in parallel from speculative vectors for the costs behind them,
one for each state in which the chunk may end, until those differ by constants only: from
there to the chunk's start one vector serves every end, and its decisions are final.  The
four results, chained from the last chunk to the first, give the true vector behind every
chunk; the fix-up pass reruns only the rows up to where the speculative vectors had
met.  Tracing then takes at every row the first of D, I, K, R that the backward costs
allow, which gives the cheapest edits of ASCII-least initials; each chunk's trace from all
four states is a map of four states, chained from the first chunk to the last.

Only chunk summaries are ever brought together by conversation, and streamed in order, so
no task holds a conversation.  A conversation's SHA-256 is sequential by its nature and
streams the repaired rows of that conversation through one task.

Inputs: null roles and texts are one space; null turns come first; rows of equal turn are
ordered by role, then the first 64 characters, then the digest of the text (rows that are
equal in all are interchangeable); null conversation ids are one conversation; an empty
role has no initial, so that keeping it leaves the state; a row with ``present`` false
only names its conversation; texts of any length are read whole; an empty table gives an
empty result; other columns are ignored."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ship_package
from .scratch import Scratch
from .workers import tidy

CHUNK_ROWS, CHUNK_CHARS = 4096, 4_000_000
SOLVE_ROWS, SOLVE_CHARS = 20_000, 4_000_000     # rows and characters of whole conversations solved at a time
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5   # costs
NEXT = np.array([2, 2, 3, 2])   # the state after the role that is due
FAR = 1 << 40
SPREAD = 16                     # no two of a row's true costs differ by more than 12
OTHER, NONE = 3, 4              # classes of initials besides u, a, s: any other, no initial
CLIPPED, FORCED = 8, 16         # flags of a row beside its class
D, I, K, R = range(4)           # decisions in ASCII order
LETTERS = "DIKR"
ROLES = {2: "user", 3: "assistant"}
WORD_CHARACTER = re.compile(r"[^\x20\x09-\x0D]")
LEGAL = ("su", "ua", "au")


# ------------------------------------------------------------------ the automaton

def _close(costs: np.ndarray) -> np.ndarray:
    """Costs when turns may be inserted first; states are the first axis."""
    return np.minimum(costs, np.minimum(INSERT + costs[NEXT], 2 * INSERT + costs[NEXT[NEXT]]))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each code of a row: min-plus matrix, cost of keeping it by state, state after that,
    cost of its new role."""
    size = 32
    step = np.full((size, 4, 4), FAR)
    keep, after, rerole = np.full((size, 4), FAR), np.zeros((size, 4), np.int64), np.full(size, FAR)
    moves = {0: {0: 2, 1: 2, 3: 2}, 1: {2: 3}, 2: {0: 1}, OTHER: {}, NONE: {s: s for s in range(4)}}
    for code in range(size):
        kind, more = code & 7, TRUNCATED if code & CLIPPED else 0
        for s in range(4):
            step[code, s, s] = DELETE
        if code & FORCED or kind not in moves:
            continue
        rerole[code] = REROLE + more
        for s in range(4):
            step[code, s, NEXT[s]] = min(step[code, s, NEXT[s]], rerole[code])
            if s in moves[kind]:
                keep[code, s], after[code, s] = KEEP + more, moves[kind][s]
                step[code, s, after[code, s]] = min(step[code, s, after[code, s]], keep[code, s])
    return np.stack([_close(m) for m in step]), keep, after, rerole


MATRIX, KEPT, KEPT_TO, REROLED = _tables()
END = _close(np.array([0, FAR, FAR, 0]))    # behind the last row: nothing, or a user-assistant pair done
UNITS = np.where(np.eye(4, dtype=bool), 0, SPREAD)


def backward(codes: list[np.ndarray], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(costs before every row, costs behind it), sequences end to end, all stepped at once from
    their ends; ``ends`` (sequence, state, vector) are the costs behind the last rows."""
    sizes = np.array([len(c) for c in codes], np.int64)
    flat = np.concatenate([*codes, np.zeros(0, np.uint8)])
    stop = np.cumsum(sizes)
    here = np.zeros((len(flat), *ends.shape[1:]), np.int64)
    behind = np.zeros_like(here)
    order = np.argsort(-sizes, kind="stable")     # the longest first, so that those left are a prefix
    cost, left = ends[order].copy(), np.searchsorted(-sizes[order], -np.arange(1, sizes.max(initial=0) + 1), side="right")
    for j, n in enumerate(left.tolist()):
        at = stop[order[:n]] - 1 - j
        behind[at] = cost[:n]
        cost[:n] = (MATRIX[flat[at]][..., None] + cost[:n, None]).min(axis=2)
        here[at] = cost[:n]
    return here, behind


def decisions(flat: np.ndarray, here: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """(row, state): the first of D, I, K, R that is on a cheapest way."""
    ok = np.stack([DELETE + behind == here,
                   INSERT + here[:, NEXT] == here,
                   KEPT[flat] + np.take_along_axis(behind, KEPT_TO[flat], axis=1) == here,
                   REROLED[flat][:, None] + behind[:, NEXT] == here])
    return ok.argmax(axis=0).astype(np.uint8)


def trace(codes: np.ndarray, acts: np.ndarray, state: int, last: bool) -> tuple[str, list[int], list, int]:
    """(initials of the edits, source row of every repaired row or -1, its new role or None, state behind)."""
    letters, source, role, to = [], [], [], NEXT.tolist()
    kept = KEPT_TO[codes].tolist()
    for i, act in enumerate(acts.tolist()):
        while act[state] == I:
            state = to[state]
            letters.append("I")
            source.append(-1)
            role.append(ROLES[state])
        done = act[state]
        letters.append(LETTERS[done])
        if done == D:
            continue
        state = kept[i][state] if done == K else to[state]
        source.append(i)
        role.append(None if done == K else ROLES[state])
    while last and state not in (0, 3):
        state = to[state]
        letters.append("I")
        source.append(-1)
        role.append(ROLES[state])
    return "".join(letters), source, role, state


# ------------------------------------------------------------------ rows and chunks

def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present): rows damaged by the crc32 of ``conv_id:turn`` modulo 20:
    0 drops a row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it a user's."""
    space = F.lit(" ")
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"),
                                F.coalesce("text", space).alias("text"), (F.crc32(name.cast("binary")) % 20).alias("fault"))
    fault = F.col("fault")
    return rows.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (fault != 0).alias("present"), F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows in order within partitions that are ranges of it; rows that are equal in all may part."""
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    rows = rows.withColumns({"digest": digest, "head": F.substring("text", 1, 64), "salt": F.monotonically_increasing_id()})
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "head", "digest", "salt")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", "turn", "role", "text", "digest", "present", F.spark_partition_id().alias("part"))


class _Chunk:
    """The rows of one conversation that are read together."""

    def __init__(self, conv):
        self.conv = conv
        self.roles, self.texts, self.digests, self.codes = [], [], [], []
        self.turns, self.faults, self.chars = [], [0, 0, 0], 0
        self.illegal, self.seen = 0, set()

    def add(self, turn, role: str, text: str, digest: bytes) -> None:
        kind = "uas".find(role[:1]) if role else NONE
        code = OTHER if kind < 0 else kind
        last = None
        for last in WORD_CHARACTER.finditer(text[-64:]):   # nearly always enough
            pass
        if last is None:
            for last in WORD_CHARACTER.finditer(text):
                pass
        if last is None:
            code, fault = code | FORCED, 0
        elif digest in self.seen:
            code, fault = code | FORCED, 1
        elif last[0] not in ".!?":
            code, fault = code | CLIPPED, 2
        else:
            fault = None
        if fault is not None:
            self.faults[fault] += 1
        self.digests.append(None if code & FORCED else digest)
        self.seen.add(digest)
        if self.roles and self.roles[-1][:1] + role[:1] not in LEGAL:
            self.illegal += 1
        self.roles.append(role)
        self.texts.append(text)
        self.codes.append(code)
        self.chars += len(text)
        if turn is not None:
            self.turns.append(turn)


SUMMARY = "n long, blank long, duplicate long, truncated long, illegal long, low long, high long, turns long"
PIECE = "cost long, audit string, source array<int>, new_role array<string>"


def _schema(conv_type: T.DataType, text: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", conv_type)]).add("at", "long") if not text else T.StructType(
        _schema(conv_type, "").fields + T.StructType.fromDDL(text).fields)


def _chunks(rows: DataFrame, chunk_rows: int, chunk_chars: int) -> DataFrame:
    """One row a chunk; conversations that lie within one chunk (``alone``) with their solution."""
    conv_type = rows.schema["conv_id"].dataType
    schema = _schema(conv_type, f"alone boolean, {SUMMARY}, codes binary, roles array<string>, texts array<string>, "
                                f"digests array<binary>, {PIECE}")

    def emit(done: list[tuple[int, bool, _Chunk]], fields):
        alone = [c for _, single, c in done if single]
        codes = [np.array(c.codes, np.uint8) for c in alone]
        here, behind = backward(codes, np.repeat(END[None, :, None], len(alone), axis=0))
        flat = np.concatenate([*codes, np.zeros(0, np.uint8)])
        acts, at = decisions(flat, here[..., 0], behind[..., 0]), 0
        solved = {}
        for c, own in zip(alone, codes):
            audit, source, role, _ = trace(own, acts[at:at + len(own)], 0, True)
            solved[id(c)] = (int(here[at, 0, 0]) if len(own) else 0, audit, source, role)
            at += len(own)
        rows = []
        for place, single, c in done:
            cost, audit, source, role = solved.get(id(c), (None,) * 4)
            rows.append((c.conv, place, single, len(c.roles), *c.faults, c.illegal, min(c.turns, default=None),
                         max(c.turns, default=None), len(set(c.turns)), bytes(c.codes), c.roles, c.texts,
                         [] if single else c.digests, cost, audit, source, role))
        return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows), fields)], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]):
        arrow = to_arrow_schema(schema)
        done, held_rows, held_chars, number, first = [], 0, 0, 0, True
        chunk, single, part = None, True, 0
        for batch in batches:
            names = ("conv_id", "turn", "role", "text", "digest", "present", "part")
            for conv, turn, role, text, digest, present, part in zip(*(batch.column(c).to_pylist() for c in names)):
                new = chunk is None or conv != chunk.conv
                if new or len(chunk.roles) >= chunk_rows or chunk.chars >= chunk_chars:
                    if chunk is not None:
                        done.append(((part << 40) + number, new and single and not first, chunk))
                        held_rows, held_chars, number = held_rows + len(chunk.roles) + 1, held_chars + chunk.chars, number + 1
                        first, single = first and not new, new
                    if held_rows >= SOLVE_ROWS or held_chars >= SOLVE_CHARS:
                        yield emit(done, arrow)
                        done, held_rows, held_chars = [], 0, 0
                    chunk = _Chunk(conv)
                if present:
                    chunk.add(turn, role, text, digest)
        if chunk is not None:
            yield emit([*done, ((part << 40) + number, False, chunk)], arrow)
    return _ordered(rows).mapInArrow(tidy(run), schema)


# ------------------------------------------------------------------ conversations of many chunks

def _repeats(chunks: DataFrame) -> DataFrame:
    """(at, later): places in a chunk whose role and text an earlier chunk of the conversation holds.
    A chunk holds a digest once here, so no key has more rows than its conversation has chunks."""
    held = chunks.select("conv_id", "at", F.posexplode("digests").alias("place", "digest")).where("digest IS NOT NULL")
    first = held.groupBy("conv_id", "digest").agg(F.min("at").alias("first")).select(
        F.col("conv_id").alias("conv"), F.col("digest").alias("same"), "first")
    later = held.join(first, (F.col("digest") == F.col("same")) & F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("at") > F.col("first")))
    return later.groupBy("at").agg(F.collect_list("place").alias("later"))


def _speculate(chunks: DataFrame) -> DataFrame:
    """``chunks`` (conv_id, at, codes, later) with repeats marked, ``ends`` (costs at the chunk's start for
    each speculative vector, by state), ``met`` (rows from its start whose decisions hold for every end)
    and their decisions."""
    schema = _schema(chunks.schema["conv_id"].dataType, "codes binary, repeated long, unclipped long, ends array<long>, met int, acts binary")

    def run(batches):
        for batch in batches:
            codes, counts = [], []
            for raw, later in zip(batch.column("codes").to_pylist(), batch.column("later").to_pylist()):
                own = np.frombuffer(raw, np.uint8).copy()
                at = np.array(later or [], np.int64)
                clipped = int((own[at] & CLIPPED > 0).sum())
                own[at] = (own[at] & ~np.uint8(CLIPPED)) | FORCED
                codes.append(own)
                counts.append((len(at), clipped))
            here, behind = backward(codes, np.repeat(UNITS[None], len(codes), axis=0))
            # the vectors differ by constants only where every state has the same differences
            apart = behind - behind[..., :1]
            parallel = (apart == apart[:, :1]).all(axis=(1, 2))
            acts = decisions(np.concatenate([*codes, np.zeros(0, np.uint8)]), here[..., 0], behind[..., 0])
            ends, met, fixed, at = [], [], [], 0
            for own in codes:
                n = len(own)
                ends.append(here[at].reshape(-1).tolist() if n else UNITS.reshape(-1).tolist())
                # once parallel they stay so: the rows before the last parallel one
                along = np.flatnonzero(parallel[at:at + n])
                met.append(int(along[-1]) + 1 if len(along) else 0)
                fixed.append(acts[at:at + met[-1]].tobytes())
                at += n
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("at"), pa.array([c.tobytes() for c in codes], pa.binary()),
                 pa.array([c[0] for c in counts], pa.int64()), pa.array([c[1] for c in counts], pa.int64()),
                 pa.array(ends, pa.list_(pa.int64())), pa.array(met, pa.int32()), pa.array(fixed, pa.binary())],
                [f.name for f in schema])
    return chunks.mapInArrow(tidy(run), schema)


def _stream(df: DataFrame, schema: T.StructType, descending: bool, start, step) -> DataFrame:
    """``step(state, row) -> (state, out)`` along the rows of every conversation in the order of ``at``."""
    def run(batches):
        fields = to_arrow_schema(schema)
        state, conv, begun = None, None, False
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not begun or row["conv_id"] != conv:
                    state, conv, begun = start(), row["conv_id"], True
                state, values = step(state, row)
                out.append(values)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*out), fields)], schema=fields)
    return df.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("at") if descending else F.asc("at")).mapInArrow(tidy(run), schema)


def _behind(guessed: DataFrame) -> DataFrame:
    """(at, last, vector): the true costs behind every chunk, from the last to the first."""
    def step(state, row):
        vector, last = state
        ends = np.array(row["ends"], np.int64).reshape(4, 4)
        return ((ends + vector).min(axis=1), False), (row["at"], last, vector.tolist())
    return _stream(guessed.select("conv_id", "at", "ends"), T.StructType.fromDDL("at long, last boolean, vector array<long>"),
                   True, lambda: (END, True), step)


def _fix(guessed: DataFrame) -> DataFrame:
    """Rows behind the place where the speculative vectors met rerun from the true one: all
    decisions of every chunk, the state it ends in by the state it starts in, its cost from state 0."""
    schema = _schema(guessed.schema["conv_id"].dataType, "last boolean, codes binary, acts binary, nexts array<int>, cost long")

    def run(batches):
        for batch in batches:
            codes = [np.frombuffer(c, np.uint8) for c in batch.column("codes").to_pylist()]
            met, ends = batch.column("met").to_pylist(), batch.column("ends").to_pylist()
            vectors = np.array(batch.column("vector").to_pylist(), np.int64).reshape(-1, 4)
            rest = [c[m:] for c, m in zip(codes, met)]
            here, behind = backward(rest, vectors[..., None])
            again = decisions(np.concatenate([*rest, np.zeros(0, np.uint8)]), here[..., 0], behind[..., 0])
            acts, nexts, costs, at = [], [], [], 0
            for own, last, known, tail, end, vector in zip(codes, batch.column("last").to_pylist(), batch.column("acts").to_pylist(),
                                                           rest, ends, vectors):
                whole = np.concatenate([np.frombuffer(known, np.uint8).reshape(-1, 4), again[at:at + len(tail)]])
                at += len(tail)
                acts.append(whole.tobytes())
                nexts.append([trace(own, whole, s, last)[3] for s in range(4)])
                costs.append(int((np.array(end, np.int64).reshape(4, 4)[0] + vector).min()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("at"), batch.column("last"), batch.column("codes"), pa.array(acts, pa.binary()),
                 pa.array(nexts, pa.list_(pa.int32())), pa.array(costs, pa.int64())], [f.name for f in schema])
    return guessed.mapInArrow(tidy(run), schema)


def _states(fixed: DataFrame) -> DataFrame:
    """(at, state, seam, shared): the state before every chunk, from the first to the last; whether the roles
    on either side of its start are illegal together; whether both sides have the same turn."""
    def step(state, row):
        now, first, role, turn = state
        seam = int(bool(row["n"]) and role is not None and role + row["head"] not in LEGAL)
        shared = int(row["low"] is not None and row["low"] == turn)
        role = row["tail"] if row["n"] else role
        turn = row["high"] if row["high"] is not None else turn
        return (row["nexts"][now], False, role, turn), (row["at"], now, first, seam, shared)
    return _stream(fixed, T.StructType.fromDDL("at long, state int, first boolean, seam int, shared int"), False,
                   lambda: (0, True, None, None), step)


def _traced(fixed: DataFrame) -> DataFrame:
    """(at, audit, source, new_role) of every chunk from its state on."""
    schema = T.StructType.fromDDL("at long, audit string, source array<int>, new_role array<string>")

    def run(batches):
        for batch in batches:
            out = [trace(np.frombuffer(c, np.uint8), np.frombuffer(a, np.uint8).reshape(-1, 4), s, last)[:3] for c, a, s, last in
                   zip(*(batch.column(x).to_pylist() for x in ("codes", "acts", "state", "last")))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("at"), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.list_(pa.int32())),
                 pa.array([o[2] for o in out], pa.list_(pa.string()))], [f.name for f in schema])
    return fixed.mapInArrow(tidy(run), schema)


def _wide(chunks: DataFrame, scratch: Scratch) -> DataFrame:
    """The solution of every chunk of the conversations of more than one, and what its borders add."""
    light = chunks.select("conv_id", "at", "codes").join(_repeats(chunks), "at", "left").select("conv_id", "at", "codes", "later")
    guessed = scratch.save(_speculate(light), "guessed")
    ends = _behind(guessed)
    fixed = scratch.save(_fix(guessed.select("conv_id", "at", "codes", "ends", "met", "acts").join(ends, "at").select(
        "conv_id", "at", "codes", "ends", "met", "acts", "last", "vector")), "fixed")
    border = chunks.select("at", "n", "low", "high", F.substring(F.get("roles", F.lit(0)), 1, 1).alias("head"),
                           F.substring(F.try_element_at("roles", F.lit(-1)), 1, 1).alias("tail"))
    states = scratch.save(_states(fixed.select("conv_id", "at", "nexts").join(border, "at").select(
        "conv_id", "at", "nexts", "n", "low", "high", "head", "tail")), "states")
    traced = _traced(fixed.select("at", "codes", "acts", "last").join(states.select("at", "state"), "at"))
    return traced.join(states.drop("state"), "at").join(fixed.select("at", F.col("cost").alias("whole")), "at").join(
        guessed.select("at", "repeated", "unclipped"), "at")


def repair(rows: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Repaired pieces of the conversations in ``rows`` (conv_id, turn, role, text, present), one row a
    chunk: conv_id, at (order within the conversation), alone (the conversation is this chunk), counts,
    audit (initials of the edits) and rows, an array of (role, text).  ``cost`` is the whole
    conversation's, on its first chunk; sums over pieces give the other counts."""
    ship_package(rows.sparkSession)
    scratch = Scratch(rows.sparkSession)
    chunks = scratch.save(_chunks(rows, chunk_rows, chunk_chars), "chunks")
    counts = ["n", "blank", "duplicate", "truncated", "illegal", "low", "high", "turns"]
    kept = lambda source, role, roles, texts: F.transform(F.arrays_zip(source.alias("s"), role.alias("r")), lambda x: F.struct(
        F.coalesce(x["r"], F.get(roles, x["s"])).alias("role"), F.when(x["s"] < 0, "").otherwise(F.get(texts, x["s"])).alias("text")))
    done = kept(F.col("source"), F.col("new_role"), F.col("roles"), F.col("texts"))
    alone = chunks.where("alone").select("conv_id", "at", "alone", *counts, "cost", "audit", done.alias("rows"))
    wide = _wide(chunks.where("NOT alone"), scratch)
    rest = chunks.where("NOT alone").drop("cost", "audit", "source", "new_role").join(wide, "at").withColumns({
        "duplicate": F.col("duplicate") + F.col("repeated"), "truncated": F.col("truncated") - F.col("unclipped"),
        "illegal": F.col("illegal") + F.col("seam"), "turns": F.col("turns") - F.col("shared"),
        "cost": F.when(F.col("first"), F.col("whole")).otherwise(0)})
    return alone.union(rest.select("conv_id", "at", "alone", *counts, "cost", "audit", done.alias("rows")))


def digest(pieces: DataFrame) -> DataFrame:
    """One row a conversation: gaps, blank, duplicate, truncated, illegal, cost, audit and the SHA-256 of
    the repaired ``role:text`` joined by newlines."""
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    text = F.array_join(F.transform("rows", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    alone = pieces.where("alone").select("conv_id", gaps, *counts, "audit", F.sha2(text.cast("binary"), 256).alias("repaired_sha256"))
    wide = pieces.where("NOT alone")
    sums = wide.groupBy("conv_id").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("turns").alias("turns"), *(F.sum(c).alias(c) for c in counts))
    # rows, not chunks, so that a batch is small whatever a chunk holds; the audit goes with a chunk's first
    lines = wide.select("conv_id", "at", "audit", F.posexplode_outer("rows").alias("place", "row")).select(
        "conv_id", F.struct("at", "place").alias("at"), F.when(F.coalesce("place", F.lit(0)) == 0, F.col("audit")).otherwise("").alias("audit"),
        "row.role", "row.text")
    schema = T.StructType([T.StructField("conv", pieces.schema["conv_id"].dataType)]).add("audit", "string").add("repaired_sha256", "string")

    def run(batches):
        conv, audit, sha, empty, begun = None, [], hashlib.sha256(), True, False
        arrow = None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([conv], arrow), pa.array(["".join(audit)]), pa.array([sha.hexdigest()])],
                                              [f.name for f in schema])
        for batch in batches:
            arrow = batch.column("conv_id").type
            for one, letters, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text"))):
                if not begun or one != conv:
                    if begun:
                        yield row()
                    conv, audit, sha, empty, begun = one, [], hashlib.sha256(), True, True
                audit.append(letters)
                if role is not None:
                    sha.update(("" if empty else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                    empty = False
        if begun:
            yield row()
    hashed = lines.repartition("conv_id").sortWithinPartitions("conv_id", "at").drop("at").mapInArrow(tidy(run), schema)
    rest = sums.join(hashed, F.col("conv_id").eqNullSafe(F.col("conv"))).select("conv_id", gaps, *counts, "audit", "repaired_sha256")
    return alone.union(rest)
