"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams.

Features are hashed n-grams of 1 to 3 letters of the lower-cased text (every other
character is one boundary mark), weighted by their share of the text and the inverse
document frequency over ALL documents of the training side.  The classifier is fitted
on a bounded sample of labelled rows, ``sample`` documents a language in expectation,
drawn by a hash of the id: follow-the-regularised-leader with an elastic-net penalty
(an L1 part that leaves most weights at zero and an L2 part).  A fifth of the sample
is held back to fit one temperature, so that the score is a calibrated probability.

Inputs: a text that is null or has no letter is ``und`` with score 0; null ids are on
the training side like any other text but are never sampled; without labelled rows
every prediction is ``und``; texts of any length are read whole; repeated rows keep a
row each; other columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .workers import give_back, tidy

BITS = 15                  # hashed features, as a power of two
ORDERS = (1, 2, 3)
SAMPLE = 500               # labelled documents a language, in expectation
EPOCHS = 3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.0005, 0.0005
UNKNOWN = "und"


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that nothing is learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Ngrams:
    """Hashed character n-grams of a text as feature numbers."""

    def __init__(self):
        # letters by code point; beyond the table a character is looked up when it appears
        self.small = np.array([c if chr(c).isalpha() else 0 for c in range(0x3000)], np.uint64)

    def codes(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        low = raw < len(self.small)
        out = self.small[np.where(low, raw, 0)]
        if not low.all():
            far, back = np.unique(raw[~low], return_inverse=True)
            out[~low] = np.array([c if chr(c).isalpha() else 0 for c in far.tolist()], np.uint64)[back]
        return out

    def features(self, codes: np.ndarray) -> np.ndarray:
        """Feature numbers of all n-grams that hold a letter; runs of other characters are one mark."""
        keep = codes > 0
        keep[1:] |= codes[:-1] > 0
        c = np.concatenate([[0], codes[keep], [0]]).astype(np.uint64) + np.uint64(1)
        out = []
        for n in ORDERS:
            h = np.full(max(len(c) - n + 1, 0), n, np.uint64)
            for i in range(n):
                h = (h ^ c[i:len(c) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(32)
            out.append(h if n > 1 else h[c > 1])
        return (np.concatenate(out) >> np.uint64(11)).astype(np.int64) & ((1 << BITS) - 1)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """(documents that hold each feature, documents with a letter) over all rows of
    ``texts`` (text).  Tasks send one row a feature; 2 ** BITS rows reach the driver."""
    def run(batches):
        grams, seen, docs = Ngrams(), np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                codes = grams.codes(text.as_py() or "")
                if codes.any():
                    seen[np.unique(grams.features(codes))] += 1
                    docs += 1
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[found, -1]), pa.array(np.r_[seen[found], docs])],
                                         ["feature", "n"])
    rows = texts.mapInArrow(tidy(run), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(1 << BITS, np.int64)
    total = 0
    for feature, n in rows:
        if feature < 0:
            total = n
        else:
            df[feature] = n
    return df, total


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _sparse(features: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, counts = np.unique(features, return_counts=True)
    return found, counts / len(features) * idf[found]


def fit(rows: list[tuple[str, str]], idf: np.ndarray, seed: int = 5) -> dict:
    """Model from labelled texts (text, language): classes, weights with idf folded in, temperature."""
    grams = Ngrams()
    data = []
    for text, lang in rows:
        codes = grams.codes(text or "")
        if codes.any():
            data.append((*_sparse(grams.features(codes), idf), lang))
    classes = sorted({lang for *_, lang in data})
    k = len(classes)
    if not k:
        return {"classes": [], "weights": np.zeros((1 << BITS, 0)), "bias": np.zeros(0), "temperature": 1.0}
    place = {lang: i for i, lang in enumerate(classes)}
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(data))
    calibration, training = order[: len(data) // 5], order[len(data) // 5:]
    # the last row of the tables is the bias, which is not penalised
    z, n = np.zeros(((1 << BITS) + 1, k)), np.zeros(((1 << BITS) + 1, k))
    l1 = np.r_[np.full(1 << BITS, L1), 0.0][:, None]

    def weights(at: np.ndarray) -> np.ndarray:
        zi, li = z[at], l1[at]
        return np.where(np.abs(zi) <= li, 0.0, -(zi - np.sign(zi) * li) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))
    for _ in range(EPOCHS):
        for i in rng.permutation(training):
            at, x, lang = data[i]
            at, x = np.r_[at, 1 << BITS], np.r_[x, 1.0]
            w = weights(at)
            error = _softmax(x @ w)
            error[place[lang]] -= 1
            g = x[:, None] * error[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange((1 << BITS) + 1))
    logits = np.array([x @ w[at] + w[-1] for at, x, _ in (data[i] for i in calibration)]).reshape(-1, k)
    truth = np.array([place[data[i][2]] for i in calibration], int)

    def loss(t: float) -> float:
        p = _softmax(logits / t)[np.arange(len(truth)), truth]
        return -float(np.log(np.maximum(p, 1e-12)).mean()) if len(truth) else 0.0
    grid = np.exp(np.linspace(np.log(0.002), np.log(20), 185))
    temperature = float(min(grid, key=loss)) if len(truth) else 1.0
    return {"classes": classes, "weights": w[:-1] * idf[:, None], "bias": w[-1], "temperature": temperature}


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
          sample: int = SAMPLE) -> dict:
    """Model learned from the rows of ``docs`` that are not held out."""
    side = docs.where(~held_out(id_col)).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                                                F.col(label_col).cast("string").alias("label"))
    df, total = document_frequencies(side.select("text"))
    idf = np.log((1 + total) / (1 + df)) + 1
    labelled = side.where("label IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL")
    counts = labelled.groupBy("label").count().collect()  # one row a language
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.lit(None)
    for label, n in counts:
        rate = F.when(F.col("label") == label, min(1.0, sample / n)).otherwise(rate)
    rows = [] if not counts else labelled.where(share < rate.cast("double")).select("doc_id", "text", "label").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["text"], r["label"]))
    model = fit([(r["text"], r["label"]) for r in rows], idf)
    del rows
    give_back()
    return model


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text",
            keep: bool = False, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """(id, lang_pred, score) of every row of ``docs``; reads the text only.  With ``keep`` all
    columns of ``docs`` pass before the two, which take ``names`` (a column that has such a
    name is replaced)."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)   # 2 ** BITS rows of one weight a language
    rows = docs.drop(*names) if keep else docs.select(id_col, text_col)
    place = rows.columns.index(text_col)
    passed = [i for i, c in enumerate(rows.columns) if keep or c == id_col]

    def run(batches):
        m, grams = shared.value, Ngrams()
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(place):
                codes = grams.codes(text.as_py() or "")
                if not m["classes"] or not codes.any():
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                found, counts = np.unique(grams.features(codes), return_counts=True)
                logits = counts @ m["weights"][found] / counts.sum() + m["bias"]
                p = _softmax(logits / m["temperature"])
                langs.append(m["classes"][int(p.argmax())])
                scores.append(float(min(p.max(), 1.0)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in passed), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                [*(batch.schema.names[i] for i in passed), *names])
    schema = T.StructType([rows.schema[i] for i in passed]).add(names[0], "string").add(names[1], "double")
    return rows.mapInArrow(tidy(run), schema)
