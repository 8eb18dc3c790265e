"""Passages of held-out test items inside a corpus, by spaced-seed hashing.

Texts become word sequences; a mask over a window of words keeps some positions and ignores the others, and the kept words
give the window's hash, so windows still meet when ignored words were substituted. Hashes of all windows of the corpus are
joined with those of the test items. Around each hit the two word sequences are laid over each other on the hit's
diagonal; the overlap tells the longest exact run and the longest run with few substitutions.

The test side is held in blocks of bounded size, read from the driver one after the other; each block is broadcast and the
corpus scanned against it, so no window of the corpus is shuffled, no hash gathers rows, and every size of the test side is
treated alike. One block holds `BLOCK_CHARS` characters of items, so only large test sets need several scans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The masks, 1 for a kept word. Wherever two words of 12 were substituted, one of the masks, moved within the
# 12, keeps none of the two; so any such run is hit.
MASKS = ("11011111", "1111100011", "1110011011", "1101011011")
SPAN = 12

#: Characters of items in one block (an item is never split); its tables take some 10 bytes a character in every worker.
BLOCK_CHARS = 2_000_000

_KEYED = r"(?:[A-Za-z]*cite[A-Za-z]*|label|bibitem|[A-Za-z]*ref)\*?(?:\s*\[[^\]]*\])*\s*\{[^{}]*\}"
_MARKUP = re.compile(rf"\\(?:hyperref\s*\[[^\]]*\]|{_KEYED}|(?:begin|end)\s*\{{[^{{}}]*\}}|[A-Za-z@]+\*?)")
_BROKEN = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t]*%*[ \t]*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """The words of a text: runs of letters and digits in lower case, without markup commands and the keys of citing,
    labelling and referring ones; a word broken by a hyphen at a line's end is one word, also where the next line begins
    with comment signs."""
    if "-" in text:
        text = _BROKEN.sub("", text)
    if "\\" in text:
        text = _MARKUP.sub(" ", text.replace("\\-", ""))
    return _WORD.findall(text.lower())


class _Hashes(dict):
    """Word -> 64-bit hash, computed when first asked for; emptied when it holds many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(text: str, cache: _Hashes) -> np.ndarray:
    w = words(text)
    return np.fromiter(map(cache.__getitem__, w), np.uint64, len(w))


def window_hashes(h: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """Hash of every window of the mask's length under the mask."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, salt, np.uint64)
    for at, bit in enumerate(mask):
        if bit == "1":
            out = (out ^ h[at : at + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int, substitutions: int) -> tuple[int, int]:
    """Longest run of equal words on the diagonal (document position minus item position), and with so many substitutions
    inside it."""
    lo, hi = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    same = item[lo:hi] == doc[lo + diagonal : hi + diagonal]
    miss = np.r_[-1, np.flatnonzero(~same), hi - lo]
    exact = int((np.diff(miss) - 1).max()) if len(miss) > 1 else 0
    k = min(substitutions + 1, len(miss) - 1)
    loose = int((miss[k:] - miss[:-k] - 1).max())
    return exact, loose


class ItemSide:
    """Word hashes of the items and the sorted hashes of their windows."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        cache = _Hashes()
        self.ids = [i for i, _ in items]
        self.seqs = [word_hashes(t, cache) for _, t in items]
        table = []
        for m, mask in enumerate(MASKS):
            for k, s in enumerate(self.seqs):
                w = window_hashes(s, mask, m)
                table.append((w, np.full(len(w), k), np.arange(len(w))))
        hashes = np.concatenate([t[0] for t in table]) if table else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.item = np.concatenate([t[1] for t in table])[order] if table else np.zeros(0, np.int64)
        self.offset = np.concatenate([t[2] for t in table])[order] if table else np.zeros(0, np.int64)

    def hits(self, doc: np.ndarray) -> set[tuple[int, int]]:
        """(item, diagonal) of all hits in a document."""
        found: set[tuple[int, int]] = set()
        if not len(self.hashes):
            return found
        for m, mask in enumerate(MASKS):
            w = window_hashes(doc, mask, m)
            lo = np.searchsorted(self.hashes, w)
            lo[lo == len(self.hashes)] = 0
            for p in np.flatnonzero(self.hashes[lo] == w):
                j = lo[p]
                while j < len(self.hashes) and self.hashes[j] == w[p]:
                    found.add((int(self.item[j]), int(p) - int(self.offset[j])))
                    j += 1
        return found


_LEAKS = "doc_id long, item_id long, exact_words int, tolerant_words int"


def _rows(doc_id: list, item_id: list, exact: list, loose: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(item_id, pa.int64()), pa.array(exact, pa.int32()), pa.array(loose, pa.int32())], names=["doc_id", "item_id", "exact_words", "tolerant_words"])


_SIDE: list = []


def _side(block: Broadcast) -> ItemSide:
    """The tables of a block, built once in a worker; those of the block before are dropped."""
    if not _SIDE or _SIDE[0] is not block.value:
        _SIDE[:] = [block.value, ItemSide(block.value)]
    return _SIDE[1]


def _scan(block: Broadcast, substitutions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side, cache = _side(block), _Hashes()
        for b in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                h = word_hashes(text.as_py() or "", cache)
                best: dict[int, tuple[int, int]] = {}
                for k, diagonal in side.hits(h):
                    e, s = overlap(h, side.seqs[k], diagonal, substitutions)
                    a, c = best.get(k, (0, 0))
                    best[k] = (max(a, e), max(c, s))
                for k, (e, s) in best.items():
                    if s >= SPAN:
                        for col, v in zip(out, (doc, side.ids[k], e, s), strict=True):
                            col.append(v)
            if out[0]:
                yield _rows(*out)

    return run


def item_blocks(items: DataFrame, most: int) -> Iterator[list[tuple[int, str]]]:
    """(id, text) of the items in blocks of at most `most` characters, or of one item; the driver holds one block."""
    held: list[tuple[int, str]] = []
    size = 0
    for r in items.toLocalIterator(prefetchPartitions=False):
        if held and size + len(r["item_text"]) > most:
            yield held
            held, size = [], 0
        held.append((r["item_id"], r["item_text"]))
        size += len(r["item_text"])
    if held:
        yield held


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", item_text: str = "text", substitutions: int = 2, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Overlaps of documents with test items: doc_id, item_id, exact_words (longest run of equal words), tolerant_words
    (longest run with at most `substitutions` differing words inside); one row per pair with tolerant_words >= 12.

    With up to two substitutions, wherever they lie, no such pair is missing; with more, those without a run of 12 words
    with two may be. Null and empty texts, and those of less than 12 words, have no hits. Documents
    and items with equal texts count each for itself; rows that repeat a doc_id give their rows again, and so do those whose id is null. Texts may have any
    length. Other columns take no part. Without items or documents the result is empty.
    """
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    t = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("item_text")).where("item_text is not null")
    sc = docs.sparkSession.sparkContext
    out = None
    for block in item_blocks(t, block_chars):
        found = d.mapInArrow(_scan(sc.broadcast(block), substitutions), _LEAKS)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else d.where(F.lit(False)).mapInArrow(_scan(sc.broadcast([]), substitutions), _LEAKS)
