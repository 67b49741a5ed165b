"""Personal data: base patterns, and a skip-chain conditional random field that adds to them.

Base findings (e-mail addresses, IP addresses, card and telephone numbers) come from fixed
patterns and always stay.  The random field labels every token that holds a digit or an @
(no other token can belong to one of the four kinds): nothing, or beginning or inside of a
kind.  Tokens that stand side by side share a chain potential.  Tokens anywhere in the
document that are equal, or similar (the same last digits, or the local part of an
address), share a skip potential, so that a bare ``555-7710`` takes the label of the
complete number elsewhere.  Equal tokens are linked from one occurrence to the next, never
in all pairs.  Loopy message passing (sum-product, all messages at once, damped, until
they rest) gives every token's marginal; runs of tokens of a kind whose marginals pass the
threshold and that touch no base finding are added as ``crf_`` spans.

The weights are learned from labelled documents: the base findings are the labels of a
sample of ``SAMPLE`` documents in expectation, drawn by a hash of the text among those with
a digit or an @, and only those of at most ``NODES`` such tokens; documents with a run of
more than 19 digits are left out, since the patterns leave two cards side by side
unlabelled.  Executors send features, not texts.  Each document comes twice, the second
time with some tokens cut to partial mentions whose linked tokens stay whole, so that
consistency is learned.  The gradient is the difference of observed features and
those expected under the messages.  A third of the documents is held back: the threshold
is the lowest, from ``LEAST`` on, at which ``PRECISION`` of the tokens that pass it there
are labelled.  Without labelled tokens nothing is added.

Inputs: a null text is empty and has no findings; null ids, repeated rows and texts of any
length keep a row each (the field takes memory in proportion to a text's tokens with a
digit or @); findings of different kinds may overlap; of tokens that two base findings
touch the first kind listed counts; an empty table gives an empty result; other columns
are ignored."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .workers import give_back, tidy

KINDS = ("email", "ip", "card", "phone")
SAMPLE, NODES = 1500, 200       # labelled documents (in expectation) and tokens of each for the fit
BITS = 13                       # hashed features, as a power of two
LABELS = 1 + 2 * len(KINDS)     # 0 nothing, 2k+1 beginning and 2k+2 inside of kind k
STEPS, RATE, PULL = 60, 0.15, 1e-4
ROUNDS, DAMPING, REST = 30, 0.3, 1e-4
LEAST, PRECISION = 0.9, 0.99
BATCH_NODES = 50_000            # tokens whose messages are passed at a time

# The base patterns
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+){3,}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

SIGN = re.compile(r"[0-9@]+")
TOKEN = LOCAL | frozenset("@()")
LONG = 64                       # characters of a token that its shape and name read from either end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _small(part: str) -> bool:
    rest = part.lstrip("0")
    return len(rest) < 3 or (len(rest) == 3 and rest <= "255")


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base findings in order.  An address is looked for at its @ and an IP
    address in whole dotted runs, which finds what the patterns find in time linear in the text."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if not SIGN.search(text):
        return out
    for m in DOTTED.finditer(text):
        parts, start = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            end = start + sum(map(len, parts[i:i + 4])) + 3
            if all(map(_small, parts[i:i + 4])):
                out.append((start, 1, end))
            start = end + 1
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


# ------------------------------------------------------------------ tokens, features and links

def tokens(text: str) -> list[tuple[int, int]]:
    """Runs of address and number characters that hold a digit or an @, without punctuation at their ends."""
    out, end = [], 0
    for m in SIGN.finditer(text):
        if m.start() < end:
            continue
        start, stop = m.start(), m.end()
        while start > end and text[start - 1] in TOKEN:
            start -= 1
        while stop < len(text) and text[stop] in TOKEN:
            stop += 1
        end = stop
        while text[start] in "._%-)":
            start += 1
        while text[stop - 1] in "._%+-(":
            stop -= 1
        out.append((start, stop))
    return out


def _hash(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def _word(text: str) -> str:
    found = re.findall(r"[^\W\d_]+", text)
    return found[-1].lower() if found else ""


def surface(whole: str) -> list[int]:
    """Features of a token by itself."""
    token = whole if len(whole) <= 2 * LONG else whole[:LONG] + whole[-LONG:]
    digits = _digits(token)
    shape = re.sub(r"([9aA])\1+", r"\1", re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "9", token))))
    parts = token.split(".")
    named = [f"shape {shape[:24]}", f"digits {min(len(digits), 21)}", f"length {min(len(whole), 40) // 3}",
             f"at {token.count('@')}", f"dots {min(token.count('.'), 5)}", f"letters {any(c.isalpha() for c in token)}",
             f"plus {whole.startswith('+')}", f"only {len(digits)} {whole.isdigit()}"]
    if len(parts) == 4 and all(p.isdigit() for p in parts):
        named.append(f"parts {all(map(_small, parts))}")
    if 14 <= len(digits) <= 19 and len(whole) == len(token):
        named.append(f"luhn {luhn(digits)}")
    return [_hash(n) for n in named]


def context(text: str, start: int, end: int) -> list[int]:
    """Features of what stands beside a token."""
    left, right = text[max(0, start - 24):start], text[end:end + 24]
    return [_hash(n) for n in ("any", f"left {_word(left)}", f"right {_word(right[:12])}", f"mark {left[-1:]!r} {right[:1]!r}")]


def features(text: str, spans: list[tuple[int, int]]) -> list[list[int]]:
    return [surface(text[s:e]) + context(text, s, e) for s, e in spans]


def part_of(token: str) -> str:
    """A partial mention of a token: the local part of an address, the end of a number."""
    if "@" in token:
        return token.partition("@")[0] or token
    return token.partition(".")[2] or (token[-8:] if token.isdigit() else token)


def names(token: str) -> list[tuple[int, str]]:
    """(kind of link, key): tokens that share a key are linked; 1 equal, 2 similar."""
    low = token.lower()
    out = [(1, low)]
    digits = _digits(token)
    if len(digits) >= 7:
        out.append((2, digits[-7:]))
    out.append((2, "l:" + (low.partition("@")[0] if "@" in low else low)))
    return out


def links(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(kind, token, token): 0 side by side, 1 equal, 2 similar, each from an occurrence to the next."""
    out, seen, linked = [], {}, set()
    for i, (start, end) in enumerate(spans):
        if i and 0 <= start - spans[i - 1][1] <= 3 and not text[spans[i - 1][1]:start].strip(" ()-"):
            out.append((0, i - 1, i))
        for kind, key in names(text[start:end]):
            before = seen.get(key)
            if before is not None and (before, i) not in linked:
                linked.add((before, i))
                out.append((kind, before, i))
            seen[key] = i
    return out


def labels(spans: list[tuple[int, int]], found: list[tuple[int, int, int]]) -> list[int]:
    """The base finding that each token touches, as a label."""
    out, used, active, at = [], set(), [], 0
    for start, end in spans:
        while at < len(found) and found[at][0] < end:
            active.append(found[at])
            at += 1
        active = [f for f in active if f[2] > start]
        best = min(active, key=lambda f: (f[1], f[0]), default=None)
        if best is None:
            out.append(0)
        else:
            out.append(2 * best[1] + 1 + (best in used))
            used.add(best)
    return out


# ------------------------------------------------------------------ the random field

def _kind_of(label: np.ndarray) -> np.ndarray:
    return (label + 1) // 2     # 0 nothing, 1.. the kinds


class SkipChain:
    """Weights of the field: features by label, a chain matrix, and two skip matrices by kind."""

    def __init__(self):
        kinds = len(KINDS) + 1
        self.p = {"unary": np.zeros((1 << BITS, LABELS)), "chain": np.zeros((LABELS, LABELS)),
                  "equal": np.zeros((kinds, kinds)), "similar": np.zeros((kinds, kinds))}
        self.threshold = 2.0    # nothing passes before a fit

    def potentials(self) -> np.ndarray:
        """(kind of link, label, label)"""
        k = _kind_of(np.arange(LABELS))
        return np.stack([self.p["chain"], self.p["equal"][k][:, k], self.p["similar"][k][:, k]])

    def unary(self, rows: list[list[int]]) -> np.ndarray:
        flat = np.fromiter((f for r in rows for f in r), np.int64)
        starts = np.cumsum([0, *(len(r) for r in rows)])[:-1]
        return np.add.reduceat(self.p["unary"][flat], starts, axis=0) if len(rows) else np.zeros((0, LABELS))

    def marginals(self, unary: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Loopy sum-product over ``edges`` (kind, token, token): marginals of tokens and of links."""
        pot = self.potentials()
        if not len(edges):
            return _softmax(unary), np.zeros((0, LABELS, LABELS))
        source = np.r_[edges[:, 1], edges[:, 2]]
        target = np.r_[edges[:, 2], edges[:, 1]]
        factor = np.concatenate([pot[edges[:, 0]], pot[edges[:, 0]].transpose(0, 2, 1)])
        back = np.r_[np.arange(len(edges), 2 * len(edges)), np.arange(len(edges))]
        order = np.argsort(target, kind="stable")
        heads = np.flatnonzero(np.r_[True, np.diff(target[order]) != 0])
        told = target[order][heads]
        message = np.zeros((len(source), LABELS))
        for _ in range(ROUNDS):
            belief = unary.copy()
            belief[told] += np.add.reduceat(message[order], heads, axis=0)
            given = belief[source] - message[back]
            new = _logsum(given[:, :, None] + factor, 1)
            new -= _logsum(new, 1)[:, None]
            moved = float(np.abs(new - message).max())
            message = DAMPING * message + (1 - DAMPING) * new
            if moved < REST:
                break
        belief = unary.copy()
        belief[told] += np.add.reduceat(message[order], heads, axis=0)
        n = len(edges)
        pair = (belief[source[:n]] - message[n:])[:, :, None] + factor[:n] + (belief[target[:n]] - message[:n])[:, None, :]
        return _softmax(belief), _softmax(pair.reshape(n, -1)).reshape(n, LABELS, LABELS)

    def fit(self, rows: list[list[int]], edges: np.ndarray, truth: np.ndarray) -> None:
        """Adam on the Bethe likelihood: observed less expected features."""
        flat = np.fromiter((f for r in rows for f in r), np.int64)
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        used, place = np.unique(flat, return_inverse=True)
        own = np.eye(LABELS)[truth]
        kind = np.eye(len(KINDS) + 1)[_kind_of(np.arange(LABELS))]
        seen = own[edges[:, 1]][:, :, None] * own[edges[:, 2]][:, None, :]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for step in range(1, STEPS + 1):
            node, pair = self.marginals(self.unary(rows), edges)
            miss, gap = (node - own)[owner], pair - seen
            g = {"unary": np.zeros_like(self.p["unary"])}
            for label in range(LABELS):
                g["unary"][used, label] = np.bincount(place, miss[:, label], len(used))
            g["chain"] = gap[edges[:, 0] == 0].sum(axis=0)
            for i, name in ((1, "equal"), (2, "similar")):
                both = kind.T @ gap[edges[:, 0] == i].sum(axis=0) @ kind
                g[name] = both + both.T       # a link has no direction
            for k, grad in g.items():
                grad = grad / len(rows) + PULL * self.p[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.99 * v[k] + 0.01 * grad * grad
                self.p[k] -= RATE * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _joined(graphs: list[tuple[list, np.ndarray]]) -> tuple[list, np.ndarray]:
    """Feature rows and links of several documents as one graph."""
    rows, edges, base = [], [np.zeros((0, 3), np.int64)], 0
    for own, e in graphs:
        rows += own
        edges.append(e + [0, base, base])
        base += len(own)
    return rows, np.concatenate(edges)


# ------------------------------------------------------------------ fitting

def labelled(texts: DataFrame) -> DataFrame:
    """(draw, whole, partial, links, labels) of documents that may teach: at least one token, at most
    ``NODES``, and no run of more than 19 digits."""
    def run(batches):
        for batch in batches:
            out = []
            for draw, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = text.as_py() or ""
                spans = tokens(t)
                if 0 < len(spans) <= NODES and not any(len(_digits(m[0])) > 19 for m in CARD.finditer(t)):
                    partial = [surface(part_of(t[s:e])) + context(t, s, e) for s, e in spans]
                    out.append((draw, features(t, spans), partial, [list(x) for x in links(t, spans)], labels(spans, base_findings(t))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int64()), *(pa.array([o[i] for o in out], pa.list_(pa.list_(pa.int32()))) for i in (1, 2, 3)),
                 pa.array([o[4] for o in out], pa.list_(pa.int32()))], ["draw", "whole", "partial", "links", "labels"])
    nested = "array<array<int>>"
    return texts.mapInArrow(tidy(run), f"draw long, whole {nested}, partial {nested}, links {nested}, labels array<int>")


def train(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, seed: int = 11) -> SkipChain:
    """The field learned from ``sample`` documents, in expectation, of those with a digit or an @."""
    texts = docs.select(F.col(text_col).alias("text")).where(F.col("text").rlike("[0-9@]"))
    texts = texts.select(F.xxhash64("text").alias("draw"), "text")
    n = texts.count()
    share = F.pmod("draw", F.lit(1 << 30)) / float(1 << 30)
    rows = [] if not n else labelled(texts.where(share < min(1.0, sample / n)).dropDuplicates(["draw"])).collect()
    rows.sort(key=lambda r: (r["draw"], r["labels"]))
    field = SkipChain()
    rng = np.random.default_rng(seed)
    graphs = []
    for r in rows:
        edges = np.array(r["links"], np.int64).reshape(-1, 3)
        truth = np.array(r["labels"], np.int64)
        whole = [list(x) for x in r["whole"]]
        # hidden: labelled tokens shown as partial mentions, of which a skip link leads to a whole one
        hidden = np.zeros(len(truth), bool)
        for _, a, b in edges[edges[:, 0] > 0]:
            for x, y in ((a, b), (b, a)):
                if truth[x] and not hidden[y] and rng.random() < 0.5:
                    hidden[x] = True
        masked = [list(c) if h else w for w, c, h in zip(whole, r["partial"], hidden)]
        # a partial mention's links are similar ones
        partial = edges.copy()
        partial[(edges[:, 0] == 1) & (hidden[edges[:, 1]] | hidden[edges[:, 2]]), 0] = 2
        graphs.append(((whole, edges), (masked, partial), truth))
    order = rng.permutation(len(graphs))
    held, rest = order[: len(order) // 3], order[len(order) // 3:]
    parts = [g[i] for g in (graphs[j] for j in rest) for i in (0, 1)]
    truth = np.concatenate([np.zeros(0, np.int64), *(graphs[j][2] for j in rest for _ in (0, 1))])
    if (truth > 0).sum() < 8:
        return field
    field.fit(*_joined(parts), truth)
    own, edges = _joined([graphs[j][0] for j in held])
    truth = np.concatenate([np.zeros(0, np.int64), *(graphs[j][2] for j in held)])
    sure, _ = field.marginals(field.unary(own), edges)
    sure = 1 - sure[:, 0]
    order = np.argsort(-sure)
    right = np.cumsum(truth[order] > 0) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(right >= PRECISION)
    field.threshold = max(LEAST, float(sure[order][good[-1]])) if len(good) else 2.0
    del rows, graphs, parts
    give_back()
    return field


# ------------------------------------------------------------------ scanning

def added(spans: list[tuple[int, int]], edges: np.ndarray, marginal: np.ndarray, found: list, threshold: float) -> list[tuple]:
    """(start, kind, end, score) of runs of sure tokens of a kind, side by side, that touch no base finding."""
    kind = _kind_of(marginal.argmax(axis=1))
    sure = 1 - marginal[:, 0]
    beside = {int(b) for k, _, b in edges.tolist() if k == 0}
    taken = [x > 0 for x in labels(spans, found)]
    out, open_kind = [], 0
    for i, (start, end) in enumerate(spans):
        if taken[i] or kind[i] == 0 or sure[i] < threshold:
            open_kind = 0
            continue
        begins = marginal[i].argmax() % 2 == 1
        if open_kind == kind[i] and i in beside and not begins:
            s, k, _, score = out[-1]
            out[-1] = (s, k, end, min(score, float(sure[i])))
        else:
            out.append((start, len(KINDS) + int(kind[i]) - 1, end, float(sure[i])))
        open_kind = kind[i]
    return out


NAMES = (*KINDS, *(f"crf_{k}" for k in KINDS))


def scan(docs: DataFrame, field: SkipChain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of every row: spans as array of (kind, start, finish, score), by start and kind;
    code points, end exclusive; base findings have score 1."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)   # 2 ** BITS rows of a weight a label

    def run(batches):
        model = shared.value

        def solve(held, spans):
            rows, edges = _joined([(h[2], h[3]) for h in held])
            marginal, _ = model.marginals(model.unary(rows), edges)
            at = 0
            for row, places, own, e, found in held:
                spans[row] = sorted(spans[row] + added(places, e, marginal[at:at + len(own)], found, model.threshold))
                at += len(own)
        for batch in batches:
            spans, held, nodes = [], [], 0
            for row, text in enumerate(batch.column(1)):
                t = text.as_py() or ""
                found = base_findings(t)
                spans.append([(s, k, e, 1.0) for s, k, e in found])
                places = tokens(t) if model.threshold <= 1 else []
                if not places:
                    continue
                own = features(t, places)
                held.append((row, places, own, np.array(links(t, places), np.int64).reshape(-1, 3), found))
                nodes += len(places)
                if nodes >= BATCH_NODES:
                    solve(held, spans)
                    held, nodes = [], 0
            if held:
                solve(held, spans)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([[{"kind": NAMES[k], "start": s, "finish": e, "score": p} for s, k, e, p in x] for x in spans],
                                           pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()),
                                                               ("finish", pa.int64()), ("score", pa.float64())])))],
                ["doc_id", "spans"])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(
        tidy(run), "doc_id long, spans array<struct<kind:string,start:long,finish:long,score:double>>")
