"""Ids against the tokenizer library itself."""

import random

import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")

from chronoweave.llm import tokens as tk  # noqa: E402


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(f"{tk.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def encoded(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, word string")
    return tk.encode_corpus(df, F.col("doc_id"), F.col("text"))


TEXTS = ["", None, "a", " a  b\n\n c\t", "don't we'll I'VE", "<|endoftext|> x", "naïve façade — “q” ½²①٣ Ж漢字 \U0001f389", "\r\nx y z　 ", "_a_b", "%% \\emph{x}^2", "�\x80\x00", "é" * 50, "x" * 5000, " " * 300, "a b " * 2000]


def test_edge_texts(spark, library):
    rows = [(i, t, "clash", "clash") for i, t in enumerate(TEXTS)] + [(3, "again", None, None), (None, "no id", None, None)]
    got = encoded(spark, rows).collect()
    assert len(got) == len(rows)
    want = sorted(((r[0], library(r[1]) if r[1] else []) for r in rows), key=str)
    assert sorted(((r["doc_id"], list(r["ids"])) for r in got), key=str) == want
    assert encoded(spark, []).count() == 0


def test_blocks_and_slices(spark, library, monkeypatch):
    rng = random.Random(5)
    pool = list("abcdefgh  \n\t'ÀéЖ漢_1½.,") + [" the", " a", "  ", "'s"]
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randint(0, 400))), None, None) for i in range(200)]
    monkeypatch.setattr(tk, "BLOCK_CHARS", 3000)
    monkeypatch.setattr(tk, "SLICE_CHARS", 50)
    assert all(sum(tk.pre_tokens(r[1]), []) == tk.splitters()[0](r[1]) for r in rows)
    got = {r["doc_id"]: list(r["ids"]) for r in encoded(spark, rows).collect()}
    assert got == {r[0]: library(r[1]) for r in rows}


def test_fuzz_against_library(library):
    rng = random.Random(2)
    pool = [chr(i) for i in range(0x3100) if not 0xD800 <= i < 0xE000] + list("  \n\t'sll1½²①٣ÀéЖ漢_a ") * 60 + ["\U0001f389"]
    encode = tk.word_encoder(tk.TOKENIZERS, "byte_bpe_50k")
    for _ in range(3000):
        t = "".join(rng.choice(pool) for _ in range(rng.randint(1, 40)))
        assert [i for part in tk.pre_tokens(t) for w in part for i in encode(w)] == library(t)


def test_decode(spark, library):
    rows = [(i, t, None, None) for i, t in enumerate(TEXTS)]
    back = {r["doc_id"]: r["text"] for r in tk.decode_corpus(encoded(spark, rows)).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    odd = spark.createDataFrame([(1, None), (2, []), (3, [255, 220])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["text"] for r in tk.decode_corpus(odd).collect()}
    assert got[1] is None and got[2] == "" and got[3] is not None
