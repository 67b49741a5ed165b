"""Near-duplicate vectors by collision-counting projections.

Every vector is projected on many random lines.  The lines are dealt to ``tables`` of
a few lines each; in a table two vectors collide if they lie in one randomly shifted
cell on every line but the last, and if the second lies in the window of half-width
``window`` centred on the first on the last line, which is sorted into bands so that a
window touches two of them.  Collisions are counted per pair over the tables; pairs
that reach the calibrated count are verified by their cosine in double precision.

Calibration: for a pair exactly at the threshold the difference of two projections is
normal with variance 2 - 2 cos, which gives the chance of one collision.  The lines
per table grow with the logarithm of the number of vectors, so that unrelated vectors
collide a bounded number of times, and the tables are as many as it takes for
``count`` collisions with probability ``recall``; pairs above the threshold collide
more often.  The work grows about as n ** 1.2 instead of n ** 2.

Copies collapse into one class before any projection and count as links of each other.
Vectors that are null, zero or hold null or non-finite components have no links, keep
their row and are kept; vectors of different lengths are never linked.  Null ids keep
a row with a null component.  Other columns are ignored."""

from __future__ import annotations

from math import comb, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch
from .workers import tidy

CELL = 2.0       # width of a cell; projections of unit vectors have a deviation of 1 or less
WINDOW = 0.7     # half-width of the window on the last line
COUNT = 2        # collisions that make a candidate
RECALL = 0.998   # of a pair exactly at the threshold
NEAR = 16        # unrelated vectors that may share all cells of a table, on average


def _together(sd: float) -> tuple[float, float]:
    """Chances that two projections differing by a normal deviate of ``sd`` share a cell,
    and that they share a window."""
    x = CELL / sd
    cdf = 0.5 * (1 + erf(x / sqrt(2)))
    same = (2 * cdf - 1) - 2 * (1 - exp(-x * x / 2)) / (x * sqrt(2 * pi))
    return same, erf(WINDOW / sd / sqrt(2))


def calibrate(n: int, cosine: float, recall: float = RECALL, count: int = COUNT) -> tuple[int, int]:
    """(lines per table besides the sorted one, tables) for ``n`` vectors."""
    cell, window = _together(sqrt(2 - 2 * cosine))
    far = _together(sqrt(2))[0]
    lines = max(2, round(log(max(n, 2) / NEAR) / -log(far))) if n > NEAR else 2
    p, tables = cell ** lines * window, count
    while sum(comb(tables, i) * p ** i * (1 - p) ** (tables - i) for i in range(count)) > 1 - recall:
        tables += 1
    return lines, tables


def _units(batch: pa.RecordBatch) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None where there is none."""
    out = []
    for value in batch.column(1):
        v = value.as_py()
        x = np.array([np.nan if y is None else y for y in v], float) if v else np.zeros(0)
        top = np.abs(x).max(initial=0.0)
        if not np.isfinite(x).all() or top == 0:
            out.append(None)
            continue
        x = x / top
        out.append(x / np.sqrt((x * x).sum()) + 0.0)
    return out


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, unit, digest) of ``vectors`` (vec_id, vector); unit is null if it has no direction."""
    def run(batches):
        import hashlib
        for batch in batches:
            units = _units(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(units, pa.list_(pa.float64())),
                 pa.array([None if u is None else hashlib.blake2b(u.tobytes(), digest_size=16).digest()
                           for u in units], pa.binary())], ["vec_id", "unit", "digest"])
    return vectors.mapInArrow(tidy(run), "vec_id long, unit array<double>, digest binary")


def _project(reps: DataFrame, lines: int, tables: int, seed: int) -> DataFrame:
    """(vec_id, cell, band, at): per table the hashed cell and the place on the sorted line."""
    def run(batches):
        made: dict[int, tuple] = {}
        for batch in batches:
            rows = batch.to_pydict()
            for dim in sorted({len(u) for u in rows["unit"]}):
                if dim not in made:
                    rng = np.random.default_rng([seed, dim])
                    made[dim] = (rng.standard_normal((dim, tables * (lines + 1))),
                                 rng.uniform(0, CELL, (tables, lines)),
                                 rng.integers(1, 2**63, (tables, lines + 1), dtype=np.uint64) | np.uint64(1))
                axes, shift, salt = made[dim]
                ids = [i for i, u in zip(rows["vec_id"], rows["unit"]) if len(u) == dim]
                x = np.array([u for u in rows["unit"] if len(u) == dim])
                y = (x @ axes).reshape(len(x), tables, lines + 1)
                cells = np.floor((y[:, :, :lines] + shift) / CELL).astype(np.int64).view(np.uint64)
                key = (cells * salt[:, :lines]).sum(axis=2) + salt[:, lines] * np.uint64(dim)
                key ^= key >> np.uint64(29)
                key *= np.uint64(0xBF58476D1CE4E5B9)
                at = y[:, :, lines]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.array(ids, np.int64), tables)), pa.array(key.view(np.int64).ravel()),
                     pa.array(np.floor(at / WINDOW).astype(np.int64).ravel()), pa.array(at.ravel())],
                    ["vec_id", "cell", "band", "at"])
    return reps.mapInArrow(tidy(run), "vec_id long, cell long, band long, at double")


def _dot(pairs: DataFrame) -> DataFrame:
    """(a, b, cosine) of pairs (a, b, ua, ub) of unit vectors of one length."""
    def run(batches):
        for batch in batches:
            ua, ub = batch.column(2), batch.column(3)
            sizes = np.diff(ua.offsets.to_numpy())
            products = ua.flatten().to_numpy(zero_copy_only=False) * ub.flatten().to_numpy(zero_copy_only=False)
            starts = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)
            sums = np.add.reduceat(products, starts) if len(starts) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums)], ["a", "b", "cosine"])
    return pairs.mapInArrow(tidy(run), "a long, b long, cosine double")


def near_vectors(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding",
                 seed: int = 11) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                          F.col(vector_col).cast("array<double>").alias("vector"))
    units = scratch.save(unit_vectors(rows), "units")
    classes = scratch.save(units.where("unit IS NOT NULL AND vec_id IS NOT NULL").groupBy("digest").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size")), "classes")
    reps = scratch.save(units.where("unit IS NOT NULL").join(
        classes.select("digest", F.col("rep").alias("vec_id")), ["digest", "vec_id"])
        .dropDuplicates(["digest", "vec_id"]).select("vec_id", "unit"), "reps")
    lines, tables = calibrate(reps.count(), cosine)
    places = scratch.save(_project(reps, lines, tables, seed), "places")

    # a window centred on a place reaches its own band and the next; each pair meets once a table
    left = places.select("cell", F.col("vec_id").alias("x"), F.col("at").alias("ax"), F.col("band").alias("own"),
                         F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"))
    right = places.select("cell", "band", F.col("vec_id").alias("y"), F.col("at").alias("ay"))
    met = left.join(right, ["cell", "band"]).where(
        f"x <> y AND abs(ax - ay) <= {WINDOW} AND (own <> band OR x < y)")
    often = met.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(
        F.count(F.lit(1)).alias("n")).where(f"n >= {COUNT}").select("a", "b")
    unit = lambda x: reps.select(F.col("vec_id").alias(x), F.col("unit").alias(f"u{x}"))
    pairs = often.join(unit("a"), "a").join(unit("b"), "b").where("size(ua) = size(ub)").select("a", "b", "ua", "ub")
    links = scratch.save(_dot(pairs).where(F.col("cosine") >= cosine).select("a", "b"), "links")
    scratch.drop("places", "reps")

    sizes = classes.groupBy(F.col("rep").alias("b")).agg(F.sum("size").alias("size"))
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(sizes, "b").groupBy(F.col("a").alias("rep")).agg(F.sum("size").alias("others"))
    component = connected_components(links, scratch).withColumnRenamed("node", "rep")
    named = scratch.save(classes.join(linked, "rep", "left").join(component, "rep", "left").select(
        "digest", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
        F.coalesce("component", "rep").alias("component")), "named")
    out = units.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("digest")).alias("digest"))
    own = F.coalesce("component", "vec_id")
    return out.join(named, "digest", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"),
        F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"))
