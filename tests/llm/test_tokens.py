"""Both tokenizers against the library, on the driver and through Spark."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from docketry.llm import bpe, tokencount

BYTE, WORD = bpe.tokenizer_path("byte_bpe_50k.json"), bpe.tokenizer_path("word_bpe_49k.json")


def texts():
    rng = random.Random(1)
    anything = lambda: rng.choice([rng.randrange(32, 127), rng.randrange(1, 0x2FFF), rng.randrange(0x10000, 0x1F9FF)])
    bits = ["the", "ing", "ab", "a", " ", "re", "'s", "--", "\n", "12", "er", "ß", "É", "  "]
    return [
        "", " ", "a<|endoftext|>b  <|endoftext|>  c", "<|startoftext|> <|EndOfText|>", "  \n\n x", "\x1c\x1d a\x85b　c​d",
        "İΣς ǅ ΑΣ", "日本語テキスト 😀😀", "a" * 3000, "aaaa bbbb" * 500, "x'S 'll 'LL", "٣٤½²", "é ẛ̣", "!" * 24, "haha" * 9,
        *("".join(chr(anything()) for _ in range(60)) for _ in range(1000)),
        *("".join(rng.choice(bits) for _ in range(50)) for _ in range(500)),
    ]


def test_byte_bpe_is_the_librarys():
    ours, lib = bpe.load(BYTE), Tokenizer.from_file(BYTE)
    for t in texts():
        want = lib.encode(t, add_special_tokens=False).ids
        ids = ours.encode(t)
        assert ids.tolist() == want, t
        assert ours.decode(ids.astype(np.int64)) == lib.decode(want, skip_special_tokens=False)


def test_every_token_encodes_to_itself():
    ours = bpe.load(BYTE)
    assert all(ours.encode_piece(s) == ours._merge(s) for s in ours.text)


def test_word_counts_are_the_librarys(monkeypatch):
    ours, lib = tokencount.RankMerger(WORD), Tokenizer.from_file(WORD)
    want = [len(lib.encode(t, add_special_tokens=False).ids) for t in texts()]
    assert ours.count_texts(texts()).tolist() == want
    monkeypatch.setattr(tokencount, "KEPT_WORDS", 100)
    assert [n for t in texts() for n in ours.count_texts([t]).tolist()] == want


def test_queries_on_odd_rows(spark):
    rows = [(i, t, "clash") for i, t in enumerate(texts()[:40])] + [(None, "x y", "c"), (7, None, "c"), (7, None, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(2)
    lib = Tokenizer.from_file(BYTE)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t, _ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, bpe.encode_and_decode(df, BYTE).collect()), key=key) == sorted(want, key=key)
    lib = Tokenizer.from_file(WORD)
    want = [(i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows]
    assert sorted(map(tuple, tokencount.count_tokens(df, WORD).collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("op", [lambda d: bpe.encode_and_decode(d, BYTE), lambda d: tokencount.count_tokens(d, WORD)])
def test_empty_table(spark, op):
    assert op(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_frequent_piece_is_encoded_once(monkeypatch):
    """Rare pieces fill what is kept again and again; one that is asked for in between stays."""
    monkeypatch.setattr(bpe, "KEPT_PIECES", 8)
    ours, asked, whole = bpe.ByteBpe(BYTE), [], bpe.ByteBpe.encode_piece
    monkeypatch.setattr(bpe.ByteBpe, "encode_piece", lambda self, s: asked.append(s) or whole(self, s))
    text = "".join(f" frequent x{'abcdefghij'[n // 10]}{'klmnopqrst'[n % 10]}q" for n in range(100))
    assert ours.decode(ours.encode(text).astype(np.int64)) == text
    assert asked.count(" frequent") == 1 and len(asked) == 101
    assert len(ours.kept) + len(ours.kept.older) <= 16
