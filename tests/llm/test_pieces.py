import os
import random

import numpy as np
import pytest

from joinlens.llm import bpe
from joinlens.llm import pieces as P

pytestmark = pytest.mark.skipif(not os.path.exists(f"{bpe.DEFAULT_DIR}/byte_bpe_50k.tiktoken"), reason="no vocabulary files")


def test_range_max():
    rng = random.Random(1)
    values = np.array([rng.randint(0, 4) for _ in range(300)], np.int8)
    table = P.RangeMax(values, 128)
    for _ in range(2000):
        low = rng.randrange(300)
        high = min(299, low + rng.randrange(128))
        want = max(range(low, high + 1), key=lambda i: (values[i], i))
        assert table.query(low, high) == want


def test_boundary_strengths():
    text = "One. Two words\nline\n\npara 你好。世界"
    at = [text.index(x) for x in (" Two", " words", "line", "para", "世")]
    assert list(P.boundary_strengths(text, np.array(at))) == [2, 1, 3, 4, 2]
    quoted = 'He said "so." Then\r\n\r\nnext'
    assert list(P.boundary_strengths(quoted, np.array([quoted.index(" Then"), quoted.index("next")]))) == [2, 4]


def check(text, limit, overlap):
    coder = bpe.encoder()
    made = P.split_text(text, coder, limit, overlap)
    assert made[0][2] == 0 and made[-1][3] == len(text)
    assert all(m[4] == coder.count(text[m[2] : m[3]]) <= limit for m in made)
    for a, b in zip(made, made[1:]):
        assert a[2] < b[2] <= a[3] < b[3]
        assert overlap <= a[1] - b[0] <= overlap + 3
    return made


def test_pieces_cover_overlap_and_fit():
    rng = random.Random(2)
    for limit, overlap in ((40, 6), (64, 0), (100, 30)):
        for _ in range(30):
            parts = [rng.choice(["word", "Number 123.", "日本語", "👍🏽", "\n", "\n\n", "    ", "é", "x" * rng.randint(1, 80), "…"]) for _ in range(rng.randint(1, 200))]
            check(rng.choice([" ", ""]).join(parts), limit, overlap)


@pytest.mark.parametrize("text", ["a" * 20000, "日" * 5000, "👩‍👩‍👧" * 2000, " " * 9000, "\n" * 9000, "-" * 9000, "ab " * 9000, "x́" * 4000])
def test_long_texts_of_one_shape(text):
    assert len(check(text, 256, 32)) >= 1


def test_natural_boundaries_win():
    sentence = "This is a sentence of some words. "
    paragraphs = "\n\n".join(sentence * 6 for _ in range(30))
    coder = bpe.encoder()
    for m in check(paragraphs, 120, 10)[:-1]:
        assert paragraphs[: m[3]].endswith("\n\n")
    lines = "\n".join("some words of a line" for _ in range(300))
    assert all(lines[: m[3]].endswith("\n") for m in check(lines, 50, 5)[:-1])
    assert P.split_text("short", coder, 100, 10) == [(0, 1, 0, 5, 1)]
    with pytest.raises(ValueError):
        P.split_text("x", coder, 10, 8)


def test_column(spark):
    rows = [(1, "word " * 500, 0), (2, "short", 0), (3, "", 0), (4, None, 0), (5, "y" * 101, 0), (1, "word " * 500, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece int")
    made = P.split_column(df, "doc_id", "text", 100, 10).collect()
    assert sorted({r.doc_id for r in made}) == [1, 2, 3, 4, 5]
    assert [(r.n_pieces, r.n_tokens, r.piece_text) for r in made if r.doc_id in (3, 4)] == [(1, 0, ""), (1, 0, None)]
    assert {r.n_pieces for r in made if r.doc_id == 1} == {sum(r.doc_id == 1 for r in made) // 2}
    assert all((r.shared == 0) if r.piece == 0 else (10 <= r.shared <= 13) for r in made)
    plain = P.split_column(df, "doc_id", "text", 100, 10, with_text=False).collect()
    assert [tuple(r) for r in plain] == [tuple(r)[:-1] for r in made]
    assert P.split_column(df.limit(0), "doc_id", "text", 100, 10).count() == 0


def test_a_piece_shorter_than_the_overlap_still_shares():
    """An encoder whose pieces come out larger than their stretch of the text, so that pieces must be cut short."""

    class Growing(bpe.BytePairEncoder):
        def count(self, text):
            return 0 if not text else super().count(text) * 3

    coder = Growing(open(f"{bpe.DEFAULT_DIR}/byte_bpe_50k.tiktoken", "rb").read())
    text = "one two three " * 60
    made = P.split_text(text, coder, 40, 30)
    assert made[0][2] == 0 and made[-1][3] == len(text)
    for a, b in zip(made, made[1:]):
        assert a[2] < b[2] <= a[3] and a[0] < b[0] < a[1] < b[1]  # progress, and an overlap
