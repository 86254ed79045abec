"""Splitting oversized texts at natural boundaries (problem 9).

Every token boundary has a strength: 4 after a paragraph, 3 after a line, 2 after a sentence, 1 between words, 0 between
other words of the tokenizer, -1 within one. A sparse table of range maxima, built over stretches of bounded length, gives
the strongest cut in the window of permissible piece lengths (from half the limit to the limit), ties to the right. If it
has no natural boundary, the window is widened down to the overlap; if there is none at all, the cut falls at the limit, at
the end of a whole character. The next piece starts the overlap before the cut. A piece's own text is encoded again and
never exceeds the limit; where it would (a cut can change how white space is read) the window is shortened.

Defined cases: null and empty texts are one piece without tokens; texts within the limit stay whole; a start inside a
character moves left to its beginning, so an overlap may be up to three tokens longer; where the overlap would leave no
progress (a piece that had to be cut shorter than it) the next piece shares half of the piece;
`shared` tells the tokens each piece has in common with the one before; repeated rows are split each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from joinlens.llm.bpe import DEFAULT_DIR, BytePairEncoder, shipped
from joinlens.session import spread

#: Tokens over which one sparse table reaches, beyond a piece.
STRETCH = 1 << 16
_ENDS = np.array([ord(c) for c in ".!?…。！？"], np.uint32)
_CJK_ENDS = np.array([ord(c) for c in "。！？"], np.uint32)
_CLOSERS = np.array([ord(c) for c in "\"')]}»“”’"], np.uint32)
_SPACES = np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288], np.uint32)


class RangeMax:
    """Sparse table: position of the largest value of any range, the rightmost of equal ones."""

    def __init__(self, values: np.ndarray, longest: int):
        at = np.arange(len(values), dtype=np.int32)
        self.values, self.levels, step = values, [at], 1
        while 2 * step <= min(longest, len(values)):
            a, b = self.levels[-1][:-step], self.levels[-1][step:]
            self.levels.append(np.where(values[b] >= values[a], b, a))
            step *= 2

    def query(self, low: int, high: int) -> int:
        """In low..high, both included."""
        level = (high - low + 1).bit_length() - 1
        a, b = self.levels[level][low], self.levels[level][high - (1 << level) + 1]
        return int(b if self.values[b] >= self.values[a] else a)


def boundary_strengths(text: str, starts: np.ndarray) -> np.ndarray:
    """Strength of a cut before each of the character positions starts (0 < start < length)."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = np.isin(chars, _SPACES)
    newline = (chars == 10) | (chars == 0x2028) | (chars == 0x2029) | ((chars == 13) & np.append(chars[1:] != 10, True))
    lines = np.concatenate(([0], np.cumsum(newline)))
    last = np.maximum.accumulate(np.where(space, -1, np.arange(len(chars))))  # last character that is no space
    closer = np.isin(chars, _CLOSERS)
    before = last[starts - 1]
    breaks = lines[starts] - lines[before + 1]
    ends_at = np.where((before > 0) & closer[before], before - 1, before)  # "He said so." ends at the full stop
    ended = np.isin(chars[ends_at], _ENDS) & (before >= 0)
    spaced = space[starts - 1] | space[starts]
    strength = np.where(spaced, np.where(ended, 2, 1), np.where(ended & np.isin(chars[ends_at], _CJK_ENDS), 2, 0))
    return np.where(breaks >= 2, 4, np.where(breaks == 1, 3, strength)).astype(np.int8)


def split_text(text: str, coder: BytePairEncoder, limit: int, overlap: int) -> list[tuple[int, int, int, int, int]]:
    """(token_from, token_to, char_from, char_to, n_tokens) of each piece; token positions in the text's own encoding."""
    if limit < overlap + 8:
        raise ValueError("the limit must exceed the overlap by 8 tokens or more")
    words = coder.words(text)
    if len(text.encode("utf-8", "surrogatepass")) <= limit:  # a token holds a byte or more: whole, only counted
        n = sum(map(coder.sizes.__getitem__, words))
        return [(0, n, 0, len(text), n)]
    sizes = np.fromiter(map(coder.sizes.__getitem__, words), np.int64, len(words))
    ends = np.cumsum(sizes)
    n = int(ends[-1]) if len(ends) else 0
    if n <= limit:
        return [(0, n, 0, len(text), n)]
    chars = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    begins, char_begins = ends - sizes, np.concatenate(([0], chars[:-1]))
    strength = np.full(n + 1, -1, np.int8)
    strength[begins[1:]] = boundary_strengths(text, char_begins[1:])

    def char_at(token: int) -> int | None:
        """The character at which a token starts; None within a character."""
        word = int(np.searchsorted(ends, token, "right"))
        if word == len(words):
            return len(text)
        inner = token - int(begins[word])
        if inner == 0:
            return int(char_begins[word])
        raw = coder.decode_bytes(coder.ids[words[word]][:inner])
        whole = raw.decode("utf-8", "ignore")
        return int(char_begins[word]) + len(whole) if len(whole.encode()) == len(raw) else None

    def whole_left(token: int) -> int:
        while char_at(token) is None:
            token -= 1
        return token

    base, table = 0, None

    def strongest(low: int, high: int) -> int:
        nonlocal base, table
        if table is None or low < base or high >= base + len(table.values):
            base = low
            table = RangeMax(strength[base : base + STRETCH + 2 * limit], limit)
        return base + table.query(low - base, high - base)

    pieces, start = [], 0
    while True:
        char_from, high = char_at(start), min(start + limit, n)
        while True:
            if high == n:
                cut = n
            else:
                least = start + overlap + 4
                cut = strongest(max(least, start + limit // 2) if high > start + limit // 2 else min(least, high), high)
                if strength[cut] < 1 and least < high:
                    wider = strongest(least, high)
                    cut = wider if strength[wider] >= 1 else cut
                if strength[cut] < 0:
                    cut = whole_left(high)
            char_to = char_at(cut)
            size = coder.count(text[char_from:char_to])
            if size <= limit:
                break
            high = min(min(high, cut) - 1, start + (min(high, cut) - start) * limit // size)
        pieces.append((start, cut, char_from, char_to, size))
        if cut == n:
            return pieces
        begins_at = (whole_left(cut - overlap), whole_left(cut - (cut - start) // 2), cut)
        start = next(x for x in begins_at if x > start)


def split_column(
    df: DataFrame, item_id: str, text: str, limit: int, overlap: int, tokenizer: str = "byte_bpe_50k",
    directory: str = DEFAULT_DIR, with_text: bool = True,
) -> DataFrame:
    """The pieces of each text: id, piece, n_pieces, token_from, token_to, char_from, char_to, n_tokens, shared, piece_text.

    piece_text is left out unless with_text. Every text is encoded in whole.
    """
    narrow = df.select(item_id, text)
    ints = ["piece", "n_pieces", "token_from", "token_to", "char_from", "char_to", "n_tokens", "shared"]
    more = StructType.fromDDL(", ".join(f"{c} long" for c in ints) + (", piece_text string" if with_text else ""))
    schema = StructType([narrow.schema.fields[0], *more.fields])

    get = shipped(df.sparkSession, tokenizer, directory)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = get()
        for batch in batches:
            bytes_ = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            rows: list[list] = [[] for _ in ints]
            source, texts, held = [], [], 0
            for at in range(batch.num_rows):
                value = batch.column(1)[at].as_py()
                pieces, upto = split_text(value or "", coder, limit, overlap), 0
                for k, piece in enumerate(pieces):
                    source.append(at)
                    for into, x in zip(rows, (k, len(pieces), *piece, max(0, upto - piece[0])), strict=True):
                        into.append(x)
                    upto = piece[1]
                    if with_text:
                        texts.append(value and value[piece[2] : piece[3]])
                held += int(bytes_[at])
                if held > 1 << 23 or at == batch.num_rows - 1:
                    made = [batch.column(0).take(pa.array(source)), *(pa.array(r, pa.int64()) for r in rows)]
                    if with_text:
                        made.append(pa.array(texts, pa.string()))
                    yield pa.RecordBatch.from_arrays(made, names=[f.name for f in schema])
                    rows, source, texts, held = [[] for _ in ints], [], [], 0

    return spread(narrow).mapInArrow(run, schema)
