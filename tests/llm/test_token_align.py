import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from cases import empty, rows, table
from tokenizers import Tokenizer

from tabloom.llm import queries, token_align
from tabloom.session import table as load

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def brute(texts):
    """Every pair of tokens compared by its byte end; one row a text."""
    a, b = Tokenizer.from_file(JSON), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    a.encode_special_tokens = True
    chars = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(c): c for c in chars} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in chars)}
    out, counts = [], Counter()
    for text in texts:
        text = text or ""
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        raw_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        whole = (" " + text).encode()
        if not text or b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            out.append(([], [], "", []))
            continue
        ends_a = [sum(map(len, raw_a[:i + 1])) for i in range(len(ids_a))]
        ends_b = [sum(map(len, raw_b[:i + 1])) for i in range(len(ids_b))]
        groups, p, q = [], 0, 0
        links = [(i, ends_b.index(e)) for i, e in enumerate(ends_a) if e in ends_b]
        for i, j in links:
            groups.append(",".join(map(str, ids_a[p:i + 1])) + "|" + ",".join(map(str, ids_b[q:j + 1])))
            p, q = i + 1, j + 1
        pairs = [(ids_a[i], ids_b[j]) for i, j in links]
        counts.update(pairs)
        out.append((ids_a, ids_b, ";".join(groups), pairs))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(len(x), len(y), len(p), len(p), sum(counts[z] == best[z[1]] for z in p), sum(counts[z] for z in p),
             hashlib.sha256(g.encode()).hexdigest() if x else "") for x, y, g, p in out]


TEXTS = [t if t is None or len(t) < 9001 else t[:900] for _, t, *_ in rows()] + [
    "<|endoftext|> and <s> </s> <unk>", "▁ odd", "tabs\tand  two  spaces\n\n", "日本語の文章です。 नमस्ते 🙂🙂", "a", " ", "\0x", "naïve café", "a" + " " * 30000 + "b"]


@pytest.mark.parametrize("frequent", [1 << 18, 40, 0])
def test_equals_brute_force(spark, frequent):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in
           token_align.cross_alignment(docs, JSON, MODEL, public_tokenizers.PATTERN, frequent=frequent).collect()}
    assert [got[i] for i in range(len(TEXTS))] == brute(TEXTS)


def test_query_over_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted((r["doc_id"], r["text"]) for r in load(spark, sf, "documents").select("doc_id", "text").collect())
    got = {r["doc_id"]: tuple(r[c] for c in [*COLUMNS[:-1], "groups_sha256"]) for r in
           queries.QUERIES["op12_token_alignment"](spark, sf).collect()}
    assert [got[i] for i, _ in docs] == brute([t for _, t in docs])


def test_awkward_rows(spark):
    got = token_align.cross_alignment(table(spark), JSON, MODEL, public_tokenizers.PATTERN, digest=False).collect()
    assert len(got) == len(rows())
    assert {r["groups"] for r in got if r["doc_id"] in (9, 10)} == {""}
    assert len([r for r in got if r["doc_id"] is None]) == 1 and len([r for r in got if r["doc_id"] == 3]) == 2
    assert token_align.cross_alignment(empty(spark), JSON, MODEL, public_tokenizers.PATTERN).count() == 0
