import os
import random
import time

import pytest

from joinlens.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(f"{bpe.DEFAULT_DIR}/byte_bpe_50k.tiktoken"), reason="no vocabulary files")

ODD = [
    "", "a", " ", "  a  b ", "\r\n\t \n", "<|endoftext|> text", "don't 'Tis we'll I'VE", "naïve Ünïcode ẞ", "日本語のテキスト、漢字。", "👩‍👩‍👧‍👦 🏳️‍🌈", "\x00\x01\x1b[31m", "a" * 5000,
    "ab" * 3000, "1" * 4000, " " * 4000 + "x", "  　x", "مرحبا بالعالم", "١٢٣ ४५६ Ⅷ", "x́̂" * 50, "  \x85", "-" * 3000, "'s't're", "﻿bom", "ﬃ ǅ ª",
]


def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{bpe.DEFAULT_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_ids_and_round_trip():
    want, coder, rng = reference(), bpe.encoder(), random.Random(1)
    alphabet = "abcXYZ019 _-.,'\n\té日👍 "
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 200))) for _ in range(400)]
    for text in texts:
        ids = list(coder.encode(text))
        assert ids == want(text) and coder.decode(ids) == text and coder.count(text) == len(ids)


def test_other_vocabulary():
    import base64

    import tiktoken

    path = f"{bpe.DEFAULT_DIR}/byte_bpe_multi_50k.tiktoken"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    other = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = bpe.encoder("byte_bpe_multi_50k")
    assert all(list(coder.encode(t)) == other.encode_ordinary(t) for t in ODD)


def test_long_words_take_linear_time_nearly():
    coder = bpe.encoder()
    began = time.perf_counter()
    coder.encode("qz" * 200_000)
    assert time.perf_counter() - began < 20


def test_bounded_cache(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 10)
    coder = bpe.BytePairEncoder(open(f"{bpe.DEFAULT_DIR}/byte_bpe_50k.tiktoken", "rb").read())
    text = " ".join(f"word{i}" for i in range(200))
    assert coder.decode(coder.encode(text)) == text and len(coder.ids) <= 10


def test_columns(spark):
    want = reference()
    rows = [(i, t, "keep", 7) for i, t in enumerate([*ODD, None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, `select` string, ids int")
    made = {r.doc_id: r for r in bpe.encode_column(df, "text").collect()}
    assert all(made[i].ids == (want(t) if t else []) and made[i]["select"] == "keep" for i, t, _, _ in rows)
    kept = bpe.encode_column(df, "text", keep_text=True)
    assert kept.columns == ["doc_id", "select", "text", "ids"]
    sizes = {r.doc_id: r.n_tokens for r in bpe.count_column(df, "text").collect()}
    assert all(sizes[i] == (len(want(t)) if t else 0) for i, t, _, _ in rows)
    assert bpe.encode_column(df.limit(0), "text").count() == 0


def test_only_the_driver_needs_the_file(spark, tmp_path):
    """The folder is gone when the tasks run."""
    folder = tmp_path / "vocabulary"
    folder.mkdir()
    (folder / "own.tiktoken").write_bytes(open(f"{bpe.DEFAULT_DIR}/byte_bpe_50k.tiktoken", "rb").read() + b"\n")
    made = bpe.encode_column(spark.createDataFrame([(1, "some text")], "i int, t string"), "t", tokenizer="own", directory=str(folder))
    (folder / "own.tiktoken").unlink()
    assert made.first().ids == list(bpe.encoder().encode("some text"))
