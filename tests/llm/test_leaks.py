"""Leaked passages against a search for all runs of 12 words."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import leaks as lk

WORDS = [f"w{i}" for i in range(60)] + ["flask", "turbine", "beaker", "mirror"]


def corpus():
    rng = random.Random(11)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(8, 60)))) for i in range(25)]
    docs = []
    for d in range(150):
        parts = [rng.choice(WORDS) for _ in range(rng.randint(0, 120))]
        if d % 3:
            w = rng.choice(items)[1].split()
            n = rng.randint(6, len(w))
            at = rng.randint(0, len(w) - n)
            piece = w[at : at + n]
            if d % 4 == 0:
                piece = [f"{x}," if k % 3 else f"\\emph{{{x}}}" for k, x in enumerate(piece)]
            if d % 5 == 0:
                piece = [x.upper() + ("\n%% " if k % 4 == 3 else "") for k, x in enumerate(piece)]
            if d % 7 == 0:
                piece[len(piece) // 2] += " \\cite{smith2001}"
            parts[len(parts) // 2 : len(parts) // 2] = piece
        docs.append((d, " ".join(parts)))
    docs += [(1000, None), (1001, ""), (1002, items[3][1]), (1003, items[3][1]), (1004, "one two"), (1005, docs[1][1] + " x" * 100_000 + " " + items[4][1] * 2)]
    return docs, items + [(900, None), (901, ""), (902, items[3][1])]


def brute(docs, items):
    grams = {}
    for i, t in items:
        w = lk.words(t or "")
        for k in range(len(w) - 11):
            grams.setdefault(tuple(w[k : k + 12]), set()).add(i)
    out = set()
    for d, t in docs:
        w = lk.words(t or "")
        for k in range(len(w) - 11):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + 12]), ())}
    return out


@pytest.mark.parametrize("block_chars", [lk.BLOCK_CHARS, 900])
def test_found_in_one_block_and_in_several(spark, block_chars):
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)).withColumn("hash", F.lit("x"))
    t = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(7))
    got = lk.leaks(d, t, block_chars=block_chars).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got if r["exact_words"] >= 12} == brute(docs, items)
    assert len({(r["doc_id"], r["item_id"]) for r in got}) == len(got)
    assert all(r["tolerant_words"] >= r["exact_words"] for r in got)


def test_empty_sides(spark):
    none = spark.createDataFrame([], "doc_id long, item_id long, text string")
    some = spark.createDataFrame([(1, 1, " ".join(WORDS[:20]))], "doc_id long, item_id long, text string")
    assert lk.leaks(none, some).count() == 0 and lk.leaks(some, none).count() == 0


def test_substitutions_are_met_by_the_seeds(spark):
    item = [f"a{i}" for i in range(40)]
    doc = list(item)
    doc[8] = doc[19] = doc[30] = "other"  # no run of 12 is left whole
    d = spark.createDataFrame([(1, " ".join(doc))], "doc_id long, text string")
    t = spark.createDataFrame([(2, " ".join(item))], "item_id long, text string")
    r = lk.leaks(d, t).first()
    assert (r["exact_words"], r["tolerant_words"]) == (10, 31)


@pytest.mark.parametrize("block_chars", [lk.BLOCK_CHARS, 900])
def test_every_placement_of_two_substitutions_is_found(spark, block_chars):
    items, docs = [], []
    for k, (a, b) in enumerate((a, b) for a in range(12) for b in range(a, 12)):
        w = [f"i{k}x{j}" for j in range(12)]
        items.append((k, " ".join(w)))
        w[a] = w[b] = "other"
        docs.append((k, " ".join(["left"] * 5 + w + ["right"] * 5)))
    w = [f"long{j}" for j in range(60)]
    items.append((500, " ".join(w)))
    docs.append((500, " ".join("other" if j % 6 == 5 else x for j, x in enumerate(w))))
    three = [f"three{j}" for j in range(12)]
    items.append((501, " ".join(three)))
    docs.append((501, " ".join("other" if j in (1, 5, 9) else x for j, x in enumerate(three))))
    d, t = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["tolerant_words"] for r in lk.leaks(d, t, block_chars=block_chars).collect()}
    assert got == {(k, k): 12 for k in range(78)} | {(500, 500): 17}


@pytest.mark.parametrize("block_chars", [lk.BLOCK_CHARS, 900])
def test_rows_without_an_id_count(spark, block_chars):
    a, b = " ".join(f"a{j}" for j in range(20)), " ".join(f"b{j}" for j in range(20))
    big = 2**60 + 1  # not a whole float
    d = spark.createDataFrame([(None, a), (None, b), (big, a), (None, None)], "doc_id long, text string")
    t = spark.createDataFrame([(None, a), (big, b), (None, None)], "item_id long, text string")
    got = sorted((tuple(r) for r in lk.leaks(d, t, block_chars=min(block_chars, 90)).collect()), key=str)
    assert got == sorted([(None, None, 20, 20), (None, big, 20, 20), (big, None, 20, 20)], key=str)


def test_words():
    text = "The bi-\n%% nary~\\textbf{Tree}\\label{sec:x} of \\citep[see][p. 3]{knuth1973,other} size\\,5 dis\\-play \\begin{center}a_b\\end{center} semi-\r\n colon re- mark \\ref{fig:y}"
    assert lk.words(text) == ["the", "binary", "tree", "of", "size", "5", "display", "a", "b", "semicolon", "re", "mark"]
    assert lk.words("see \\hyperref[sec:a]{that part} and \\href{http://x.y}{here}") == ["see", "that", "part", "and", "here"]
    assert lk.words("") == []


def test_overlap():
    a, b = np.arange(30, dtype=np.uint64), np.arange(30, dtype=np.uint64)
    b = b.copy()
    b[[10, 20]] = 99
    assert lk.overlap(a, b, 0, 0) == (10, 10) and lk.overlap(a, b, 0, 1) == (10, 20) and lk.overlap(a, b, 0, 2) == (10, 30)
    assert lk.overlap(a, b[:5], 3, 2)[0] == 0
