"""Mixing overlapping sources to target token quotas by min-cost flow.

1. Documents aggregate on Spark by membership pattern (the set of sources a document
   belongs to): one row per pattern with its size.
2. A min-cost flow routes every pattern's capacity to the quotas of its sources.  A
   pattern offers its size once for each permitted repetition and later repetitions
   cost more (1, 3, 5, ... : a convex cost), so nothing is repeated while a text not
   yet used can serve the quota.  The network has one node per pattern and source;
   documents never reach the driver.
3. Each pattern's share becomes whole copies for all its documents and one more copy
   for a seeded part: documents are ordered by a seeded hash, and the cut that keeps
   the running size within the share is found by two histograms of that hash (4096
   bins, then 65536 within the one bin that holds the cut), so no group is sorted or
   gathered, however many documents one source has.  What the cut leaves open (less
   than the next document) goes, in ``ROUNDS`` - 1 further cuts of the same kind, to
   documents not yet copied again that fit into it.

Inputs: null text has size 0; a null source is a source of its own; a document of no
source is never taken; null or repeated ids keep a row each (equal ids share one
draw); an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
FINE_BITS = 16          # bins of the second histogram, as a power of two
COARSE_BITS = 12        # bins of the first
FEW = 10_000            # patterns whose tables (one row each) are broadcast; more are joined by shuffle
ROUNDS = 4              # cuts; each leaves a small part of what the one before left open


def water_fill(sizes: list[float], weights: list[float], limit: float) -> list[float]:
    """Targets by weight that share the sum of ``sizes``; none above ``limit`` times its
    size, the excess reshared by weight among the others until none is above."""
    total = float(sum(sizes))
    caps = [limit * s for s in sizes]
    order = sorted(range(len(sizes)), key=lambda i: (caps[i] / weights[i], i))
    left, weight = total, float(sum(weights))
    out = [0.0] * len(sizes)
    for place, i in enumerate(order):
        if caps[i] * weight > left * weights[i]:
            level = left / weight
            for j in order[place:]:
                out[j] = level * weights[j]
            break
        out[i] = float(caps[i])
        left -= caps[i]
        weight -= weights[i]
    return out


def min_cost_flow(sizes: list[int], members: list[list[int]], quotas: list[int], repeats: int) -> list[int]:
    """Tokens taken of each pattern: a cheapest flow among the largest ones.

    Successive shortest paths from the patterns to the quotas; pattern i offers
    ``sizes[i]`` tokens at each of the costs 1, 3, 5, ... (``repeats`` of them)."""
    n, m = len(sizes), len(quotas)
    source, sink = n + m, n + m + 1
    arcs: list[list[int]] = []              # [to, capacity, cost]; arc k ^ 1 is its reverse
    leaving: list[list[int]] = [[] for _ in range(n + m + 2)]

    def arc(a: int, b: int, capacity: int, cost: int) -> None:
        leaving[a].append(len(arcs))
        arcs.append([b, capacity, cost])
        leaving[b].append(len(arcs))
        arcs.append([a, 0, -cost])

    for i, size in enumerate(sizes):
        for r in range(repeats):
            arc(source, i, size, 2 * r + 1)
        for s in members[i]:
            arc(i, n + s, repeats * size, 0)
    for s, quota in enumerate(quotas):
        arc(n + s, sink, quota, 0)
    while True:
        cost = [None] * (n + m + 2)
        came = [-1] * (n + m + 2)
        cost[source], queue, queued = 0, deque([source]), {source}
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for k in leaving[a]:
                b, capacity, price = arcs[k]
                if capacity > 0 and (cost[b] is None or cost[a] + price < cost[b]):
                    cost[b], came[b] = cost[a] + price, k
                    if b not in queued:
                        queue.append(b)
                        queued.add(b)
        if cost[sink] is None:
            break
        path, at = [], sink
        while at != source:
            path.append(came[at])
            at = arcs[came[at] ^ 1][0]
        amount = min(arcs[k][1] for k in path)
        for k in path:
            arcs[k][1] -= amount
            arcs[k ^ 1][1] += amount
    taken = [0] * n
    for k in leaving[source]:
        if k % 2 == 0:
            taken[arcs[k][0]] += arcs[k ^ 1][1]
    return taken


def seeded_draw(id_col: str, seed: int) -> Column:
    """28-bit number from the id and the seed, the same in every engine: the first seven
    hexadecimal digits of md5('seed:id')."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 7), 16, 10).cast("long")


def mix(docs: DataFrame, weights, repeats: int = 3, id_col: str = "doc_id", size_col: str = "size",
        members_col: str = "members", seed: int = 7) -> DataFrame:
    """(id, size, members, copies, taken) for every row of ``docs``.

    ``members_col`` is an array of source names (null is a name); ``weights`` maps the
    list of all names, sorted by code point with null last, to their weights.  Quotas
    are the weights' shares of the size of all documents, at most ``repeats`` times
    what a source holds; columns ``targets`` and ``source_sizes`` (arrays as
    ``members``) tell them."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = scratch.save(docs.select(
        F.col(id_col).alias("doc_id"), F.col(size_col).cast("long").alias("size"),
        F.coalesce(F.sort_array(F.array_distinct(members_col), asc=False), F.array().cast("array<string>"))
        .alias("members"),
        seeded_draw(id_col, seed).alias("draw")), "sizes")
    # one row per pattern: as many as there are combinations of sources in use
    patterns = rows.groupBy("members").agg(F.sum("size").alias("size")).collect()
    patterns = sorted(((list(p["members"]), p["size"]) for p in patterns), key=str)
    names = sorted({s for m, _ in patterns for s in m}, key=lambda s: (s is None, s or ""))
    place = {s: i for i, s in enumerate(names)}
    held = [sum(size for m, size in patterns if s in m) for s in names]
    targets = water_fill_total(held, weights(names), repeats, sum(size for m, size in patterns if m))
    taken = min_cost_flow([size for _, size in patterns], [[place[s] for s in m] for m, _ in patterns],
                          [round(t) for t in targets], repeats)
    plan = [(m, t // size if size else 0, t % size if size else 0,
             [targets[place[s]] for s in m], [held[place[s]] for s in m])
            for (m, size), t in zip(patterns, taken)]
    small = F.broadcast if len(plan) <= FEW else lambda df: df
    plan = spark.createDataFrame(
        plan, "members array<string>, whole long, rest long, targets array<double>, source_sizes array<long>")
    planned = rows.withColumn("more", F.lit(0)).join(small(plan), "members").withColumn(
        "coarse", F.shiftright("draw", FINE_BITS)).withColumn("fine", F.col("draw").bitwiseAND((1 << FINE_BITS) - 1))
    for turn in range(ROUNDS):
        planned = scratch.save(_cut(planned, scratch, turn, small), f"cut-{turn}")
    copies = F.col("whole") + F.col("more")
    return planned.select(
        F.col("doc_id").alias(id_col), F.col("size").alias(size_col), F.col("members").alias(members_col),
        "source_sizes", "targets", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _edge(frame: DataFrame, bins: str, room: str) -> DataFrame:
    """(members, ``bins``, before): of each pattern the first bin whose running size
    exceeds ``room``, and the size before it.  A pattern has at most 65536 bins."""
    run = Window.partitionBy("members").orderBy(bins)
    sums = frame.groupBy("members", bins).agg(F.sum("size").alias("held"), F.max(room).alias("room"))
    over = sums.withColumn("upto", F.sum("held").over(run)).where("upto > room")
    first = over.groupBy("members").agg(F.min(F.struct(bins, (F.col("upto") - F.col("held")).alias("before"))).alias("c"))
    return first.select("members", f"c.{bins}", "c.before")


def _cut(planned: DataFrame, scratch: Scratch, turn: int, small) -> DataFrame:
    """``planned`` with ``more`` = 1 for the rows that fit into ``rest`` in the seeded
    order, and ``rest`` reduced by them; ``small`` marks tables of one row a pattern."""
    fits = "more = 0 AND size > 0 AND size <= rest"
    open_rows = planned.where(fits)
    coarse = scratch.save(_edge(open_rows, "coarse", "rest").withColumnRenamed("coarse", "coarse_edge"),
                          f"coarse-{turn}")
    inside = open_rows.join(small(coarse), "members").where("coarse = coarse_edge").withColumn(
        "room", F.col("rest") - F.col("before"))
    fine = scratch.save(_edge(inside, "fine", "room").select("members", F.col("fine").alias("fine_edge")),
                        f"fine-{turn}")
    edges = coarse.select("members", "coarse_edge").join(fine, "members", "left")
    took = F.expr(f"{fits} AND (coarse_edge IS NULL OR coarse < coarse_edge"
                  " OR coarse = coarse_edge AND fine < coalesce(fine_edge, 0))")
    marked = planned.join(small(edges), "members", "left").withColumn("took", took)
    sums = scratch.save(marked.where("took").groupBy("members").agg(F.sum("size").alias("spent")), f"spent-{turn}")
    return marked.join(small(sums), "members", "left").select(
        *(c for c in planned.columns if c not in ("more", "rest")),
        F.expr("more + IF(took, 1, 0)").alias("more"), F.expr("rest - coalesce(spent, 0)").alias("rest"))


def water_fill_total(held: list[int], weights: list[float], limit: float, total: int) -> list[float]:
    """``water_fill`` for sources that share documents: ``total`` counts each document once."""
    out = water_fill(held, weights, limit)
    both = sum(held)
    return out if both == total or not both else [t * total / both for t in out]


def word_count(text_col: str = "text") -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
