"""Small tables with the awkward rows that every operator has to handle."""

from __future__ import annotations

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def edited(text: str, seed: int, share: float) -> str:
    rng = random.Random(seed)
    words = text.split()
    for i in range(len(words)):
        if rng.random() < share:
            words[i] = rng.choice(WORDS) + "x" + str(rng.randrange(1000))
    return " ".join(words)


def rows() -> list[tuple]:
    base, long = prose(1, 120), prose(2, 6000)
    texts = [base, base, base.upper(), edited(base, 3, 0.02), edited(base, 4, 0.03), edited(base, 5, 0.04),
             edited(base, 6, 0.3), long, edited(long, 7, 0.01), None, "", "   \n\t ", "one", "one two three",
             "ONE two three", "é à 日本語 テキスト 🙂", "a" * 9000, "!?" * 400, base, prose(8, 60), prose(9, 61)]
    out = [(i, t, ("en", "fr", None)[i % 3], ("s1", "s2", None)[i % 3], len(t or "")) for i, t in enumerate(texts)]
    out.append((3, texts[3], "en", "s1", 0))               # a repeated row
    out.append((None, base, None, None, None))             # no id
    return out


def table(spark, extra: str = ""):
    """The rows, with columns whose names operators use inside."""
    df = spark.createDataFrame(rows(), SCHEMA)
    for name in ("size", "members", "kept", "component_id", "n", "score", "draw", "copies", "rest", "value", "id"):
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
