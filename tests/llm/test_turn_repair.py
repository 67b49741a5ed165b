import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tabloom.llm import queries, turn_repair
from tabloom.session import table as load

COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        out += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64],
                                      hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))


def legal_prefix(initials):
    return re.fullmatch(r"(s?(ua)*u?)?", initials) is not None


def cheapest(rows, faults):
    """Edits by a search of the cheapest, then ASCII-least initials, over (row, roles so far)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, initials, out = heapq.heappop(heap)
        # what is left of the roles matters only by its last two
        state = (i, "" if not initials else initials[-1])
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", initials):
            return cost, audit, out
        for role in ("user", "assistant"):
            if legal_prefix(initials + role[0]):
                heapq.heappush(heap, (cost + 5, audit + "I", i, initials + role[0], (*out, (role, ""))))
        if i == len(rows):
            continue
        _, role, text = rows[i]
        heapq.heappush(heap, (cost + 2, audit + "D", i + 1, initials, out))
        if faults[i] in ("blank", "duplicate"):
            continue
        more = 5 if faults[i] == "truncated" else 0
        for new, letter, price in ((role, "K", 0), ("user", "R", 1), ("assistant", "R", 1)):
            if legal_prefix(initials + new[:1]):
                heapq.heappush(heap, (cost + price + more, audit + letter, i + 1, initials + new[:1], (*out, (new, text))))
    raise AssertionError


def brute(rows):
    convs = defaultdict(list)
    for r in rows:
        convs[r[0]].append(r)
    out = {}
    for conv, own in convs.items():
        own = damaged(own)
        seen, faults = set(), []
        for _, role, text in own:
            body = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = [t for t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, fixed = cheapest(own, faults)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha)
    return out


def random_rows(seed, convs=60, longest=30):
    rng = random.Random(seed)
    out = []
    for c in range(convs):
        for i in range(rng.randrange(longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice([f"Text {rng.randrange(9)}.", "No end", "Again.", "", None, " \t", "Why? ", "x" * 70 + str(rng.randrange(3)) + "!"])
            out.append((c if c else None, rng.choice([i, i, i, i + 3, None]), role, text))
    return out


def got(df):
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in df.collect()}


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("chunk", [4096, 5, 1])
def test_equals_search(spark, chunk):
    rows = random_rows(chunk)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS part", "1 AS at", "'y' AS cost").repartition(5)
    assert got(turn_repair.digest(turn_repair.repair(turn_repair.damage(df), chunk_rows=chunk))) == brute(rows)


def test_query_over_conversations(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in load(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.QUERIES["op11_turn_repair"](spark, sf)) == brute(rows)


def test_one_conversation_holds_most_rows(spark):
    rng = random.Random(3)
    rows = [(7, i, rng.choice(["user", "assistant", "tool"]), f"Row {rng.randrange(1200)}{rng.choice(['.', '.', ''])}") for i in range(1500)]
    rows += [(8, None, "user", "same")] * 400 + [(9, 0, "system", "Hello."), (10, 1, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    pieces = turn_repair.repair(turn_repair.damage(df), chunk_rows=64)
    assert got(turn_repair.digest(pieces)) == brute(rows)
    assert max(r["n"] for r in pieces.collect()) <= 64


def test_vectors_meet_and_never_spread():
    rng = np.random.default_rng(0)
    for _ in range(200):
        codes = rng.choice([0, 1, 2, 3, 4, 8, 9, 10, 16, 17], 60).astype(np.uint8)
        true, _ = turn_repair.backward([codes], turn_repair.END[None, :, None])
        assert (true.max(axis=1) - true.min(axis=1)).max() <= 12 < turn_repair.SPREAD
        cut = int(rng.integers(1, 59))
        guess, _ = turn_repair.backward([codes[:cut]], turn_repair.UNITS[None])
        assert ((guess[0] + true[cut, :, 0]).min(axis=1) == true[0, :, 0]).all()


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert turn_repair.digest(turn_repair.repair(turn_repair.damage(df))).count() == 0
