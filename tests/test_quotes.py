"""Quotes in documents by fingerprints, against every pair compared."""

import random

import numpy as np
import pytest

from docketry.operators import quotes, verify


def test_what_two_texts_share_has_a_fingerprint_in_common():
    rng = random.Random(1)
    for _ in range(200):
        shared = "".join(rng.choice("ab é😀") for _ in range(24))
        a, b = ("".join(rng.choice("ab ") for _ in range(rng.randrange(40))) for _ in "ab")
        mine = quotes.winnowed(quotes._codes(shared))
        assert len(mine) == 1 and set(mine.tolist()) <= set(quotes.fingerprints(a + shared + b).tolist())
    assert len(quotes.winnowed(quotes._codes("x" * 23))) == 0 and len(quotes.fingerprints("")) == 0


def test_long_texts_are_hashed_in_parts(monkeypatch):
    text = "".join(random.Random(2).choice("abcdef ") for _ in range(5000))
    whole = quotes.fingerprints(text, (5,))
    monkeypatch.setattr(quotes, "CHARS", 100)
    assert np.array_equal(quotes.fingerprints(text, (5,)), whole)


@pytest.mark.parametrize("seed,bits", [(3, 15), (4, 27)])
def test_every_pair(spark, seed, bits):
    rng = random.Random(seed)
    words = ["care", "the", "Is", "needed", "nüß", "“quoted”", "a—b", "ﬁle", "re­entry", "x​", "　", "Ω", "don’t", "…"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(rng.choice([None, i, 3]), say(rng.randrange(1, 120))) for i in range(60)] + [(900, None), (901, ""), (902, "care the " * 30_000 + "needle at the very end of it"), (903, "​" * 30 + "ab")]
    asked = [(i, say(rng.randrange(3, 9))) for i in range(60)]
    for i in range(40):  # stretches of documents, in another spelling
        text = rng.choice(docs[:60])[1]
        at = rng.randrange(len(text))
        asked.append((100 + i, text[at : at + rng.randrange(24, 90)].swapcase().replace("—", "-")))
    asked += [(None, "needle at the very end of it"), (7, "needle at the very end of it"), (8, None), (9, ""), (10, "short"), (11, "a" + "​" * 30 + "b"), (12, "​" * 40), (13, " " * 40)]
    want = []
    for d, text in docs:
        for q, quote in asked:
            reason, a, b = verify.place_of(quote, text) if quote and len(quote) >= 24 else ("short", None, None)
            if reason is None:
                want.append((d, q, a, b))
    d = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id int, text string, _text string").repartition(3)
    q = spark.createDataFrame([(*r, 1) for r in asked], "item_id long, text string, _quote int").repartition(2)
    got = quotes.quoted_by(d, q, bits=bits).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and len(want) > 15


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "some words that are long enough to quote")], "doc_id int, text string"), spark.createDataFrame([], "item_id int, text string")
    assert quotes.quoted_by(docs, none).collect() == []
    assert quotes.quoted_by(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).collect() == []
