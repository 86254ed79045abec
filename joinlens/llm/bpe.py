"""Byte-level BPE with a public vocabulary (problem 7), written for corpora.

A text is cut into words by the tokenizer's pattern; a word's bytes are merged by a priority queue of merge ranks over a
doubly linked list of symbols. An entry whose symbols have changed since it was queued is stale and skipped, so a word of n
bytes costs O(n log n), whatever its shape. Words recur, so every Python worker keeps the ids of the words it has met, up
to a bound. Decoding concatenates the vocabulary's byte strings.

Defined cases: null and empty texts have no ids (an empty list); text that looks like a special token is plain text; lone
surrogates are encoded as U+FFFD; control characters and any length are ordinary input; rows keep their other columns, of
which one that has the name of the new column is replaced.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from joinlens.session import spread

#: Fixed value: how the byte_bpe vocabularies cut a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_DIR = "/opt/tokenizers"
#: Words whose ids a worker keeps, and the longest such word.
CACHE_WORDS, CACHE_CHARS = 250_000, 64


class _Words(dict):
    """Ids of words, computed when first asked for."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, word: str):
        made = self.make(word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = made
        return made


class BytePairEncoder:
    """Encoder and decoder of one vocabulary (the bytes of a file with a base64 token and its rank a line)."""

    def __init__(self, vocabulary: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, vocabulary.splitlines()))}
        self.strings = {rank: token for token, rank in self.ranks.items()}
        self.words = regex.compile(PATTERN).findall
        self.ids = _Words(self._word)
        self.sizes = _Words(lambda word: len(self._word(word)))

    def _word(self, word: str) -> tuple[int, ...]:
        return self.merge(word.encode("utf-8", "replace") if word.isascii() else _utf8(word))

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Token ids of one word's bytes."""
        ranks, n = self.ranks, len(piece)
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        after, before = list(range(1, n + 1)), list(range(-1, n))  # of symbol starts; after[i] < 0: merged away
        queue = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
        heapify(queue)
        while queue:
            _, i, end = heappop(queue)
            middle = after[i]
            if middle < 0 or middle >= n or after[middle] != end:
                continue  # stale
            after[i], after[middle] = end, -1
            before[end] = i
            if end < n and (rank := ranks.get(piece[i : after[end]])) is not None:
                heappush(queue, (rank, i, after[end]))
            left = before[i]
            if left >= 0 and (rank := ranks.get(piece[left:end])) is not None:
                heappush(queue, (rank, left, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return tuple(out)

    def encode(self, text: str | None) -> array:
        return array("i", chain.from_iterable(map(self.ids.__getitem__, self.words(text)))) if text else array("i")

    def count(self, text: str | None) -> int:
        """Number of tokens of a text."""
        return sum(map(self.sizes.__getitem__, self.words(text))) if text else 0

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.strings.__getitem__, ids))

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def _utf8(word: str) -> bytes:
    try:
        return word.encode("utf-8")
    except UnicodeEncodeError:
        return word.encode("utf-16", "surrogatepass").decode("utf-16", "replace").encode("utf-8")


def _vocabulary(tokenizer: str, directory: str) -> bytes:
    with open(os.path.join(directory, f"{tokenizer}.tiktoken"), "rb") as file:
        return file.read()


@lru_cache(maxsize=4)
def encoder(tokenizer: str = "byte_bpe_50k", directory: str = DEFAULT_DIR) -> BytePairEncoder:
    """The encoder of a vocabulary file of this machine."""
    return BytePairEncoder(_vocabulary(tokenizer, directory))


#: Encoders of a Python worker, by the digest of their vocabulary.
_BUILT: dict[bytes, BytePairEncoder] = {}


def shipped(spark: SparkSession, tokenizer: str, directory: str) -> Callable[[], BytePairEncoder]:
    """A function for tasks that gives the encoder. The file is read by the driver alone and its bytes (about a megabyte)
    are broadcast; every worker builds its encoder once."""
    raw = _vocabulary(tokenizer, directory)
    digest, shared = blake2b(raw, digest_size=16).digest(), spark.sparkContext.broadcast(raw)

    def get() -> BytePairEncoder:
        if digest not in _BUILT:
            _BUILT[digest] = BytePairEncoder(shared.value)
        return _BUILT[digest]

    return get


def _chunks(batch: pa.RecordBatch, column: int, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of about most bytes of text, at least one row each, so that ids of a batch never pile up."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, room = 0, most
    for row, size in enumerate(sizes):
        room -= int(size)
        if room <= 0:
            yield batch.slice(at, row + 1 - at)
            at, room = row + 1, most
    if at < batch.num_rows:
        yield batch.slice(at)


def encode_column(df: DataFrame, text: str, output: str = "ids", tokenizer: str = "byte_bpe_50k", directory: str = DEFAULT_DIR, keep_text: bool = False) -> DataFrame:
    """df with the token ids of column text as a list of integers; the text itself is dropped unless kept."""
    columns = [c for c in df.columns if c not in (text, output)] + [text]
    at = len(columns) - 1
    kept = at + keep_text
    narrow = df.select(*columns)
    schema = StructType([*narrow.schema.fields[:kept], StructField(output, ArrayType(IntegerType()))])

    get = shipped(df.sparkSession, tokenizer, directory)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = get()
        for batch in batches:
            for part in _chunks(batch, at):
                ids, offsets = array("i"), [0]
                for value in part.column(at).to_pylist():
                    if value:
                        ids.extend(chain.from_iterable(map(coder.ids.__getitem__, coder.words(value))))
                    offsets.append(len(ids))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(ids, np.int32) if ids else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns[:kept], lists], [*part.schema.names[:kept], output])

    return spread(narrow).mapInArrow(run, schema)


def count_column(df: DataFrame, text: str, output: str = "n_tokens", tokenizer: str = "byte_bpe_50k", directory: str = DEFAULT_DIR) -> DataFrame:
    """df without text, with its size in tokens as a long; 0 for null and empty texts."""
    columns = [c for c in df.columns if c not in (text, output)] + [text]
    at = len(columns) - 1
    narrow = df.select(*columns)
    schema = StructType([*narrow.schema.fields[:at], StructField(output, LongType())])

    get = shipped(df.sparkSession, tokenizer, directory)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = get()
        for batch in batches:
            sizes = pa.array([coder.count(value) for value in batch.column(at).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], sizes], [*batch.schema.names[:at], output])

    return spread(narrow).mapInArrow(run, schema)
