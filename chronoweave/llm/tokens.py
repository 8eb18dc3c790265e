"""Encoding of a corpus with a public byte-level BPE tokenizer by a shuffle of distinct words.

1. Documents are read in blocks. Each block splits its texts into pre-tokens, lists its distinct words and keeps every
   document as the positions' word numbers.
2. The words of all blocks are aggregated to the distinct words of the corpus, and each is encoded once.
3. Ids are joined back to the blocks' words. The join's key is the word and a salt, one for 2^`SALT_BITS` partitions of the input,
   so a word that every block has is no hot key. The documents are reassembled by position.

What is shuffled per word occurrence is one small number inside the document's row; words and ids travel once per block.
Decoding joins the fixed table of token bytes by position, an Arrow batch at a time.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.plans.scale import keep

#: The folder of the vocabulary files; a parameter of every function here.
TOKENIZERS = "/opt/tokenizers"

#: Characters of text that one block holds (a longer text is a block of its own), and that are split at a time.
BLOCK_CHARS = 4_000_000
SLICE_CHARS = 1_000_000

#: Partitions of the input that share a salt, as a power of two: some thousand blocks.
SALT_BITS = 7

# The public pattern that splits text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# The ASCII characters with the Unicode property White_Space.
BLANKS = r"\t-\r "


@cache
def splitters() -> tuple[Callable[[str], list[str]], Callable[[str], list[str]]]:
    """The pattern for any text, and the same for ASCII in the standard library's engine, which is faster there."""
    import regex

    plain = PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^{BLANKS}A-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]").replace(r"\S", rf"[^{BLANKS}]").replace(r"\s", f"[{BLANKS}]")
    return regex.compile(PATTERN).findall, re.compile(plain).findall


#: Before white space that follows something else a pre-token always begins, so there a text may be cut.
_CUT, _LINE = re.compile(r"(?<=\S)(?=[\t-\r ])"), re.compile(r"(?<=\S)(?=\n)")


def pre_tokens(text: str) -> Iterator[list[str]]:
    """The pre-tokens of a text, in lists of about `SLICE_CHARS` characters; ASCII lines go to the faster engine."""
    wide, plain = splitters()
    at = 0
    while at < len(text):
        m = _CUT.search(text, at + SLICE_CHARS) if len(text) - at > SLICE_CHARS else None
        end = m.start() if m else len(text)
        part = text[at:end]
        if part.isascii():
            yield plain(part)
        else:
            yield [w for line in _LINE.split(part) for w in (plain(line) if line.isascii() else wide(line))]
        at = end


class _Numbers(dict):
    """Word -> its number, in the order in which they were first asked for."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


@cache
def ranks(folder: str, name: str) -> dict[bytes, int]:
    """Token bytes -> id of a rank file."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def token_table(folder: str, name: str) -> pa.Array:
    """Token bytes by id."""
    tokens: list[bytes | None] = [None] * (max(ranks(folder, name).values()) + 1)
    for b, i in ranks(folder, name).items():
        tokens[i] = b
    return pa.array(tokens, pa.binary())


@cache
def word_encoder(folder: str, name: str):
    """A function from a pre-token to its ids."""
    import tiktoken

    codec = tiktoken.Encoding(name, pat_str=r"[\s\S]+", mergeable_ranks=ranks(folder, name), special_tokens={})
    return lambda word: codec.encode_ordinary(word)


_SPLIT = pa.schema([("block", pa.int64()), ("kind", pa.int8()), ("key", pa.int64()), ("word", pa.string()), ("data", pa.binary())])
_DICT = pa.schema([("block", pa.int64()), ("kind", pa.int8()), ("key", pa.int64()), ("data", pa.binary())])
WORD, DOC = 0, 1


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId() << 32
    words = _Numbers()
    docs: list[tuple[int | None, bytes]] = []
    size, number = 0, 0

    def flush() -> Iterator[pa.RecordBatch]:
        block = part + number
        n, m = len(words), len(docs)
        yield pa.RecordBatch.from_arrays([pa.array([block] * m, pa.int64()), pa.array([DOC] * m, pa.int8()), pa.array([d for d, _ in docs], pa.int64()), pa.nulls(m, pa.string()), pa.array([x for _, x in docs], pa.binary())], schema=_SPLIT)
        yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.array([WORD] * n, pa.int8()), pa.array(range(n), pa.int64()), pa.array(list(words), pa.string()), pa.nulls(n, pa.binary())], schema=_SPLIT)

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            parts = []
            for tokens in pre_tokens(text) if text else ():
                parts.append(np.fromiter(map(words.__getitem__, tokens), np.uint32, len(tokens)))
            ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
            small = len(ids) == 0 or int(ids.max()) < 1 << 16
            docs.append((doc, b"\2" + ids.astype("<u2").tobytes() if small else b"\4" + ids.astype("<u4").tobytes()))
            size += len(text or "") + 64
            if size >= BLOCK_CHARS:
                yield from flush()
                words, docs, size, number = _Numbers(), [], 0, number + 1
    if docs:
        yield from flush()


def _encode_words(folder: str, name: str):
    """Distinct words with their salts -> one row per word and salt, with the word's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(folder, name)
        for b in batches:
            data = pa.array([np.array(encode(w), "<u4").tobytes() for w in b.column(0).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), data], names=["word", "salts", "data"])

    return run


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    block, flat, start, count = None, None, None, None
    held: list[bytes] = []
    for b in batches:  # sorted by block, words before documents, words by number
        ids, docs = [], []
        for k, kind, key, data in zip(*(b.column(c).to_pylist() for c in ("block", "kind", "key", "data")), strict=True):
            if k != block:
                block, held, flat = k, [], None
            if kind == WORD:
                held.append(data)
                continue
            if flat is None:
                count = np.array([len(d) >> 2 for d in held], np.int64)
                start = np.r_[0, np.cumsum(count)[:-1]] if held else np.zeros(0, np.int64)
                flat, held = np.frombuffer(b"".join(held), "<u4").astype(np.int32), []
            at = np.frombuffer(data, "<u2" if data[:1] == b"\2" else "<u4", offset=1).astype(np.int64)
            n = count[at]
            first = np.cumsum(n) - n
            total = int(n.sum())
            ids.append(flat[np.repeat(start[at] - first, n) + np.arange(total)] if total else np.zeros(0, np.int32))
            docs.append(key)
        if docs:
            offsets = np.r_[0, np.cumsum([len(i) for i in ids])].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.ListArray.from_arrays(offsets, np.concatenate(ids))], schema=schema)


def encode_corpus(df: DataFrame, doc_id: Column, text: Column, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """doc_id BIGINT, ids ARRAY<INT>: the ids of every text without special tokens, one row per row of `df`.

    Empty and null texts give an empty list; strings of special tokens in a text are ordinary text. Rows with equal or
    null doc_id stay separate rows. Texts may have any length; an empty table gives an empty result. Other columns of
    `df` take no part, whatever their names.
    """
    split = keep(df.select(doc_id.cast("long").alias("doc_id"), text.cast("string").alias("text")).mapInArrow(_split, "block long, kind byte, key long, word string, data binary"))
    salt = F.shiftright("block", 32 + SALT_BITS).cast("int").alias("salt")
    words = split.where(F.col("kind") == WORD).select("block", "key", "word", salt)
    distinct = words.groupBy("word").agg(F.collect_set("salt").alias("salts"))
    coded = distinct.mapInArrow(_encode_words(folder, name), "word string, salts array<int>, data binary").select("word", F.explode("salts").alias("salt"), "data")
    ids = words.join(coded, ["word", "salt"]).select("block", F.lit(WORD).cast("byte").alias("kind"), "key", "data")
    docs = split.where(F.col("kind") == DOC).select("block", "kind", "key", "data")
    both = docs.unionByName(ids).repartition("block").sortWithinPartitions("block", "kind", "key")
    return both.mapInArrow(_assemble, "doc_id long, ids array<int>")


def decode_corpus(df: DataFrame, doc_id: str = "doc_id", ids: str = "ids", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """The texts of `ids`, as doc_id, text: the ids are joined with the table of token bytes, which is fixed per tokenizer and held
    by every worker, so ids are looked up by their place in it and none is shuffled.

    Byte sequences that are not UTF-8 decode with U+FFFD; a null list gives a null text, an empty one an empty text. Ids
    without a token raise an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_table(folder, name)
        for batch in batches:
            lists = batch.column(1)
            found = table.take(lists.flatten())
            if found.null_count:
                raise ValueError("an id without a token")
            ends = np.frombuffer(found.buffers()[1], np.int32, len(found) + 1, found.offset * 4)
            data = found.buffers()[2]
            data = memoryview(data) if data is not None else memoryview(b"")
            first = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())]
            cut = ends[first].tolist()
            texts = [None if n else str(data[a:b], "utf-8", "replace") for a, b, n in zip(cut[:-1], cut[1:], lists.is_null().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[doc_id, "text"])

    return df.select(doc_id, ids).mapInArrow(run, f"`{doc_id}` {df.schema[doc_id].dataType.simpleString()}, text string")
