"""Secret scans: rules find candidates, a character convolutional network judges them.

Base findings (assignments, access keys, long hexadecimal runs) come from fixed
patterns and always stay.  Every other candidate (a pattern's match that fails its
length, or a run of token characters with a digit) is scored together with
its surrounding context by a small convolutional network in numpy: characters are
embedded beside a channel that marks the value, one convolution is pooled separately
over the value and over the context, and a dense layer gives a logit.

The network is trained on the labelled findings of the corpus: all candidates that the
rules confirm and all that they reject, each different one once.  In half of the
confirmed ones the context is exchanged with a rejected one's, so that it also learns
the value's shape.  One of three folds, by hash, is held back: Platt scaling makes the logit a
probability there, and the threshold is the highest that keeps ``RECALL`` of its
confirmed findings, but no less than one half.  Without labelled findings of both kinds
nothing is added to the base findings.

Training is a job an epoch: findings are dealt by hash to portions of about ``PORTION``,
each portion takes the network through its own findings once, and the networks (with the
moments of their steps) are averaged by the portions' sizes.  Scaling is a job a Newton
step; sums of portions and a few averaged networks reach the driver, findings never do.

Inputs: a null text is empty and has no findings; null ids, repeated rows and texts
of any length keep a row each; other columns are ignored."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranks
from ..session import ship_package
from .scratch import Scratch
from .workers import give_back, tidy

KINDS = ("assign", "access", "hex", "model")
CONTEXT, VALUE = 24, 48        # characters of either side and of the value that the network reads
WIDTH = 2 * CONTEXT + VALUE
EMBED, FILTERS, KERNEL = 8, 16, 5
RECALL, EPOCHS = 0.98, 12
PORTION, AVERAGES = 4000, 32   # findings that a task learns from at a time, about; averages that reach the driver
BATCH = 4096                   # candidates scored at a time


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


# The base patterns
NAMES = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = re.compile("(" + "|".join(map(_either_case, NAMES)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")     # the runs of [0-9a-f]+ that have 16 or more characters
HINTS = ("password", "passwd", "secret", "token", "api_key", "apikey")
RUN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-.@")
SHORTEST = 8                   # characters of a run that is a candidate
DIGITS = re.compile("[0-9]+")


def base_findings(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """((start, kind, end) of the confirmed matches in order, (start, end) of failing matches)."""
    good, failed = [], []
    lower = text.lower()
    if any(h in lower for h in HINTS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 12:
                good.append((m.start(), 0, m.end()))
            else:
                failed.append((m.start(2), m.end(2)))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 18:
                good.append((m.start(), 1, m.end()))
            else:
                failed.append(m.span())
    good += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(good), failed


def runs(text: str) -> list[tuple[int, int]]:
    """Runs of token characters that hold a digit (keys, but also addresses and numbers)."""
    out, end = [], 0
    for m in DIGITS.finditer(text):
        if m.start() < end:
            continue
        start, end = m.start(), m.end()
        while start > 0 and text[start - 1] in RUN:
            start -= 1
        while end < len(text) and text[end] in RUN:
            end += 1
        if end - start >= SHORTEST:
            out.append((start, end))
    return out


def candidates(text: str, good: list, failed: list) -> list[tuple[int, int]]:
    """Spans for the network: failing matches and runs that touch no base finding."""
    out = []
    for start, end in sorted(set(failed + runs(text))):
        if not any(s < end and start < e for s, _, e in good):
            out.append((start, end))
    return out


def window(text: str, start: int, end: int) -> tuple[str, str, str]:
    value = text[start:end]
    if len(value) > VALUE:
        value = value[:VALUE // 2] + value[-VALUE // 2:]
    return text[max(0, start - CONTEXT):start], value, text[end:end + CONTEXT]


def encode(windows: list[tuple[str, str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Character numbers (0 is padding, 1 is anything outside ASCII) and the mask of the value."""
    codes, mask = np.zeros((len(windows), WIDTH), np.int64), np.zeros((len(windows), WIDTH))
    for i, (left, value, right) in enumerate(windows):
        raw = np.frombuffer((left + value + right).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        at = CONTEXT - len(left)
        codes[i, at:at + len(raw)] = np.where(raw < 128, raw + 2, 1)
        mask[i, CONTEXT:CONTEXT + len(value)] = 1.0
    return codes, mask


class CharCNN:
    """One convolution over embedded characters, max-pooled over value and context."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.p = {"embed": rng.normal(0, 0.3, (130, EMBED)),
                  "conv": rng.normal(0, 1 / np.sqrt(KERNEL * (EMBED + 1)), (KERNEL * (EMBED + 1), FILTERS)),
                  "conv_b": np.zeros(FILTERS),
                  "out": rng.normal(0, 0.2, 2 * FILTERS), "out_b": np.zeros(1)}
        self.scale, self.threshold = (1.0, 0.0), 2.0

    def _forward(self, codes: np.ndarray, mask: np.ndarray):
        x = np.concatenate([self.p["embed"][codes], mask[:, :, None]], axis=2)
        n = WIDTH - KERNEL + 1
        cols = np.concatenate([x[:, k:k + n] for k in range(KERNEL)], axis=2)
        h = np.maximum(cols @ self.p["conv"] + self.p["conv_b"], 0)
        inside = mask[:, KERNEL // 2:KERNEL // 2 + n, None] > 0
        pools = []
        for part in (np.where(inside, h, -1.0), np.where(inside, -1.0, h)):
            at = part.argmax(axis=1)
            pools.append((at, np.maximum(np.take_along_axis(part, at[:, None], axis=1)[:, 0], 0)))
        pooled = np.concatenate([pools[0][1], pools[1][1]], axis=1)
        return pooled @ self.p["out"] + self.p["out_b"][0], (cols, pools, pooled)

    def logits(self, codes: np.ndarray, mask: np.ndarray) -> np.ndarray:
        parts = [self._forward(codes[i:i + 512], mask[i:i + 512])[0] for i in range(0, len(codes), 512)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def probabilities(self, codes: np.ndarray, mask: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.logits(codes, mask) + b, -40, 40)))

    def _gradients(self, codes, mask, truth):
        logit, (cols, pools, pooled) = self._forward(codes, mask)
        d = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - truth) / len(truth)
        g = {"out": pooled.T @ d, "out_b": np.array([d.sum()])}
        conv, conv_b = np.zeros_like(self.p["conv"]), np.zeros(FILTERS)
        embed = np.zeros_like(self.p["embed"])
        rows = np.arange(len(truth))[:, None]
        for part, (at, top) in enumerate(pools):
            # only the pooled place of each filter passes a gradient
            dh = d[:, None] * self.p["out"][part * FILTERS:(part + 1) * FILTERS] * (top > 0)
            seen = cols[rows, at]                                     # (n, filters, kernel * channels)
            conv += np.einsum("nfc,nf->cf", seen, dh)
            conv_b += dh.sum(axis=0)
            back = (dh[:, :, None] * self.p["conv"].T[None]).reshape(len(truth), FILTERS, KERNEL, EMBED + 1)
            for k in range(KERNEL):
                np.add.at(embed, codes[rows, at + k], back[:, :, k, :EMBED])
        return g | {"conv": conv, "conv_b": conv_b, "embed": embed}

    def blank(self) -> dict:
        """Moments of the steps before the first one."""
        return {"m": {k: np.zeros_like(v) for k, v in self.p.items()},
                "v": {k: np.zeros_like(v) for k, v in self.p.items()}, "step": 0.0}

    def epoch(self, codes, mask, truth, order: np.ndarray, moments: dict) -> None:
        """Adam on the logistic loss, once through the findings in ``order``."""
        m, v = moments["m"], moments["v"]
        for i in range(0, len(order), 64):
            part = order[i:i + 64]
            moments["step"] += 1
            step = moments["step"]
            for k, g in self._gradients(codes[part], mask[part], truth[part]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.p[k] = self.p[k] - 0.01 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)

    def fit(self, codes, mask, truth, epochs: int = EPOCHS, seed: int = 4) -> None:
        rng, moments = np.random.default_rng(seed), self.blank()
        for _ in range(epochs):
            self.epoch(codes, mask, truth, rng.permutation(len(truth)), moments)

    def flat(self, moments: dict) -> np.ndarray:
        """Weights, moments and steps in one row of numbers."""
        return np.concatenate([*(d[k].ravel() for d in (self.p, moments["m"], moments["v"]) for k in sorted(self.p)),
                               [moments["step"]]])

    def unflat(self, numbers: np.ndarray) -> dict:
        """The inverse of ``flat``: sets the weights, returns the moments."""
        out, at = [], 0
        for _ in range(3):
            out.append({})
            for k in sorted(self.p):
                out[-1][k] = numbers[at:at + self.p[k].size].reshape(self.p[k].shape).copy()
                at += self.p[k].size
        self.p = out[0]
        return {"m": out[1], "v": out[2], "step": float(numbers[at])}

    def scale_by(self, sums: Callable[[list], np.ndarray]) -> None:
        """Platt scaling by damped Newton steps; ``sums`` gives ``platt_sums`` over all held findings."""
        start = np.array([1.0, 0.0])

        def evaluate(ws: list) -> np.ndarray:
            # a weak pull to the raw logit keeps the fit finite if the labels separate
            pull = np.array([[0.5 * ((w - start) ** 2).sum(), *(w - start), 1.0, 0.0, 1.0] for w in ws])
            return sums(ws) + pull
        w, at = start, evaluate([start])[0]
        for _ in range(50):
            move = np.linalg.solve(np.array([[at[3], at[4]], [at[4], at[5]]]), at[1:3])
            tries = [w - move / 2 ** k for k in range(20)]
            found = evaluate(tries)
            better = np.flatnonzero(found[:, 0] <= at[0])
            if not len(better):
                break
            near = np.abs(tries[better[0]] - w).max() < 1e-10
            w, at = tries[better[0]], found[better[0]]
            if near:
                break
        self.scale = (float(w[0]), float(w[1]))

    def keep(self, logit: float | None) -> None:
        """The threshold from the logit of the least probable confirmed finding that has to stay."""
        if logit is None:
            self.threshold = 2.0
        else:
            a, b = self.scale
            self.threshold = max(0.5, float(1 / (1 + np.exp(-np.clip(a * logit + b, -40, 40)))))

    def calibrate(self, codes, mask, truth, recall: float = RECALL) -> None:
        """Platt scaling, then the recall-constrained threshold."""
        z, up, down = self.logits(codes, mask), int(truth.sum()), int((1 - truth).sum())
        self.scale_by(lambda ws: platt_sums(z, truth, up, down, ws))
        found = np.sort(z[truth > 0] * (1 if self.scale[0] >= 0 else -1))
        at = None if not len(found) else float(found[int((1 - recall) * len(found))])
        self.keep(at if at is None or self.scale[0] >= 0 else -at)


def platt_sums(z: np.ndarray, truth: np.ndarray, up: int, down: int, ws: list) -> np.ndarray:
    """Loss, gradient (2) and curvature (3) of the scaled logits ``z`` at each of ``ws``, a row each;
    ``up`` and ``down`` are the numbers of all confirmed and rejected findings, which smooth the targets."""
    goal, out = np.where(truth > 0, (up + 1) / (up + 2), 1 / (down + 2)), []
    for a, b in ws:
        y = a * z + b
        p = 1 / (1 + np.exp(-np.clip(y, -40, 40)))
        miss, bend = p - goal, p * (1 - p)
        out.append([(np.logaddexp(0, y) - goal * y).sum(), (miss * z).sum(), miss.sum(),
                    (bend * z * z).sum(), (bend * z).sum(), bend.sum()])
    return np.array(out)


def labelled(texts: DataFrame) -> DataFrame:
    """(left, value, right, good, draw) of every candidate and base finding in ``texts`` (text)."""
    def run(batches):
        for batch in batches:
            rows, labels = [], []
            for text in batch.column(0):
                t = text.as_py() or ""
                good, failed = base_findings(t)
                for start, kind, end in good:
                    if kind == 0:   # the value alone, as in the other kinds
                        start = ASSIGN.match(t, start).start(2)
                    rows.append(window(t, start, end))
                    labels.append(True)
                other = candidates(t, good, failed)
                rows += [window(t, *x) for x in other]
                labels += [False] * len(other)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([r[i] for r in rows], pa.string()) for i in range(3)), pa.array(labels, pa.bool_())],
                ["left", "value", "right", "good"])
    rows = texts.mapInArrow(tidy(run), "left string, value string, right string, good boolean")
    return rows.withColumn("draw", F.xxhash64("left", "value", "right"))


def _deal(salt: int, n: int) -> Column:
    """A number below ``n`` from a finding's hash."""
    return F.pmod(F.xxhash64("draw", F.lit(salt)), F.lit(n))


def lessons(found: DataFrame, scratch: Scratch) -> tuple[DataFrame, int, int]:
    """((part, held, draw, left, value, right, good) of every different finding, half of the confirmed ones
    with a rejected one's context; numbers of confirmed and of rejected findings)."""
    texts = ["left", "value", "right"]
    kept = scratch.save(found.dropDuplicates([*texts, "good"]), "different")
    up, down = kept.agg(F.count_if("good"), F.count_if(~F.col("good"))).first()
    parts = max(1, -(-(up + down) // PORTION))
    kept = kept.withColumn("part", _deal(1, parts)).withColumn("held", _deal(2, 3) == 0)
    if not up or not down:
        return scratch.save(kept, "lessons"), up, down
    # rejected ones by number: their place in their part after the parts before it
    rejected = kept.where(~F.col("good"))
    sizes = rejected.groupBy("part").agg(F.count(F.lit(1)).alias("size")).select(
        "part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))   # one row a part
    numbered = rejected.join(F.broadcast(sizes), "part").select(
        (F.row_number().over(Window.partitionBy("part").orderBy("draw", *texts)) - 1 + F.col("before")).alias("slot"),
        F.col("left").alias("other_left"), F.col("right").alias("other_right"))
    swaps = F.col("good") & (_deal(3, 2) == 0)
    swapped = kept.where(swaps).withColumn("slot", _deal(4, down)).join(numbered, "slot").select(
        *[F.col(f"other_{c}").alias(c) if c in ("left", "right") else F.col(c) for c in kept.columns])
    return scratch.save(kept.where(~swaps).unionByName(swapped), "lessons"), up, down


def _ordered(rows: pd.DataFrame):
    """Codes, masks and labels of a portion, whatever order its rows came in."""
    rows = rows.sort_values(["draw", "good", "left", "value", "right"])
    return *encode(list(zip(rows["left"], rows["value"], rows["right"]))), rows["good"].to_numpy(float)


def _epoch(rest: DataFrame, net: CharCNN, moments: dict, seed: int) -> dict:
    """Takes the network through every finding of ``rest`` once, a portion a task; returns the moments."""
    shared = rest.sparkSession.sparkContext.broadcast((net, net.flat(moments)))   # a few thousand numbers
    size = len(net.flat(moments))

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        model, numbers = shared.value
        part, (codes, mask, truth) = int(rows["part"].iloc[0]), _ordered(rows)
        mine = CharCNN()
        state = mine.unflat(numbers)
        mine.epoch(codes, mask, truth, np.random.default_rng([seed, part]).permutation(len(truth)), state)
        return pd.DataFrame({"part": [part], "n": [len(truth)], "total": [(mine.flat(state) * len(truth)).tobytes()]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        rows, total = rows.sort_values("part"), np.zeros(size)
        for x in rows["total"]:
            total += np.frombuffer(x)
        return pd.DataFrame({"part": [int(rows["part"].min())], "n": [int(rows["n"].sum())], "total": [total.tobytes()]})
    schema = "part long, n long, total binary"
    done = rest.groupBy("part").applyInPandas(learn, schema).groupBy(F.pmod("part", F.lit(AVERAGES))).applyInPandas(add, schema)
    rows = sorted(done.collect(), key=lambda r: r["part"])   # at most AVERAGES rows
    shared.unpersist()
    if not rows:
        return moments
    return net.unflat(sum(np.frombuffer(r["total"]) for r in rows) / sum(r["n"] for r in rows))


def _calibrate(held: DataFrame, net: CharCNN, scratch: Scratch) -> None:
    """Platt scaling and the threshold on every finding of ``held``."""
    shared = held.sparkSession.sparkContext.broadcast(net)

    def logit(rows: pd.DataFrame) -> pd.DataFrame:
        part, (codes, mask, truth) = int(rows["part"].iloc[0]), _ordered(rows)
        return pd.DataFrame({"part": part, "good": truth, "z": shared.value.logits(codes, mask)})
    found = scratch.save(held.groupBy("part").applyInPandas(logit, "part long, good double, z double"), "logits")
    up, down = found.agg(F.count_if(F.col("good") > 0), F.count_if(F.col("good") == 0)).first()

    def sums(ws: list) -> np.ndarray:
        def one(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["z", "good"])
            got = platt_sums(rows["z"].to_numpy(), rows["good"].to_numpy(), up, down, ws)
            return pd.DataFrame({"part": [int(rows["part"].iloc[0])], "sums": [got.ravel().tolist()]})
        rows = found.groupBy("part").applyInPandas(one, "part long, sums array<double>").collect()   # a row a portion
        total = np.zeros((len(ws), 6))
        for r in sorted(rows, key=lambda r: r["part"]):
            total += np.array(r["sums"]).reshape(len(ws), 6)
        return total
    net.scale_by(sums)
    if not up:
        return net.keep(None)
    sign, at = (1 if net.scale[0] >= 0 else -1), int((1 - RECALL) * up)
    counts = ranks.value_weights(found.where(F.col("good") > 0), [], F.col("z") * sign)
    least = ranks.with_cumulative(counts, [], "value", "w").where(
        (F.col("cum_before") <= at) & (F.col("cum_before") + F.col("w") > at)).first()
    net.keep(least["value"] * sign)


def train(docs: DataFrame, text_col: str = "text", seed: int = 3) -> CharCNN:
    """Network trained and calibrated on every different finding, confirmed or rejected, of the corpus."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.save(labelled(docs.select(F.col(text_col).alias("text"))), "findings")
    taught, up, down = lessons(found, scratch)
    net = CharCNN(seed)
    if up >= 8 and down >= 8:
        rest, moments = taught.where(~F.col("held")), net.blank()
        rest = rest.repartition(max(1, -(-(up + down) // PORTION)), "part")   # small rows: as many tasks as portions
        for epoch in range(EPOCHS):
            moments = _epoch(rest, net, moments, seed + 1 + epoch)
        _calibrate(taught.where("held"), net, scratch)
        scratch.drop("logits")
    scratch.drop("findings", "different", "lessons")
    give_back()
    return net


def scan(docs: DataFrame, net: CharCNN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of every row: spans as array of (kind, start, finish, score), by start and kind;
    code points, end exclusive; base findings have score 1."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(net)   # a few thousand weights

    def run(batches):
        model = shared.value
        for batch in batches:
            spans, windows, owners = [], [], []
            for row, text in enumerate(batch.column(1)):
                t = text.as_py() or ""
                good, failed = base_findings(t)
                spans.append([(s, k, e, 1.0) for s, k, e in good])
                for start, end in candidates(t, good, failed):
                    windows.append(window(t, start, end))
                    owners.append((row, start, end))
            for i in range(0, len(windows), BATCH):
                scores = model.probabilities(*encode(windows[i:i + BATCH]))
                for (row, start, end), score in zip(owners[i:i + BATCH], scores.tolist()):
                    if score >= model.threshold:
                        spans[row].append((start, 3, end, score))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([[{"kind": KINDS[k], "start": s, "finish": e, "score": p}
                                             for s, k, e, p in sorted(x)] for x in spans],
                                           pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()),
                                                               ("finish", pa.int64()), ("score", pa.float64())])))],
                ["doc_id", "spans"])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(
        tidy(run), "doc_id long, spans array<struct<kind:string,start:long,finish:long,score:double>>")


def redact(docs: DataFrame, net: CharCNN, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every finding in ``text_col`` replaced by ``mark``; overlapping findings by one
    mark.  All other columns pass unchanged; a null text stays null."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(net)
    place = docs.columns.index(text_col)

    def run(batches):
        model = shared.value
        for batch in batches:
            out = []
            for value in batch.column(place):
                t = value.as_py()
                if t:
                    good, failed = base_findings(t)
                    spans = [(s, e) for s, _, e in good]
                    other = candidates(t, good, failed)
                    if other:
                        scores = model.probabilities(*encode([window(t, *x) for x in other]))
                        spans += [x for x, score in zip(other, scores.tolist()) if score >= model.threshold]
                    t = _without(t, sorted(spans), mark)
                out.append(t)
            yield batch.set_column(place, batch.schema.field(place), pa.array(out, batch.schema.field(place).type))
    return docs.mapInArrow(tidy(run), docs.schema)


def _without(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    parts, at = [], 0
    for start, end in spans:
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])
