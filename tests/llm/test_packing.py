"""Best-fit packing against packing one piece after another, and whole sequences against the library."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from docketry.llm import packing
from docketry.llm.bpe import tokenizer_path
from tests.llm.test_tokens import texts as odd_texts

PATH = tokenizer_path("byte_bpe_50k.json")


def one_by_one(lengths, room):
    """How many sequences of best fit decreasing are filled how far; which of two with equal room is taken changes their contents only."""
    bins = []
    for x in sorted(lengths, reverse=True):
        fit = [b for b in bins if room - sum(b) >= x]
        if fit:
            min(fit, key=lambda b: room - sum(b)).append(x)
        else:
            bins.append([x])
    return Counter(map(sum, bins))


def whole(rows, room):
    """The sequences of placed rows (length, sequence, offset), which must have no gap and no overlap."""
    bins = {}
    for length, s, offset in sorted(rows, key=lambda r: (r[1], r[2])):
        assert offset == sum(bins.setdefault(s, []))
        bins[s].append(length)
    assert all(sum(b) <= room for b in bins.values())
    return Counter(map(sum, bins.values()))


@pytest.mark.parametrize("room,n,seed", [(10, 200, 1), (37, 500, 2), (64, 900, 3), (1, 5, 4), (100, 1, 5), (1024, 1500, 6)])
def test_plan_is_best_fit_decreasing(room, n, seed):
    rng = random.Random(seed)
    lengths = [min(room, 1 + int(rng.expovariate(3 / room))) for _ in range(n)] + [1] * (n // 3)
    counts = Counter(lengths)
    plan = packing.best_fit_decreasing(counts, room)
    length = np.array(sorted(lengths), np.int64)
    number = np.concatenate([np.arange(counts[x]) for x in sorted(counts)])
    where, offset = plan.places(length, number)
    assert whole(zip(length.tolist(), where.tolist(), offset.tolist()), room) == one_by_one(lengths, room)
    assert sorted(set(where.tolist())) == list(range(plan.sequences))


def test_plan_does_not_grow_with_the_pieces():
    rng = random.Random(9)
    few = {x: rng.randrange(1, 50) for x in range(1, 1025)}
    many = {x: rng.randrange(1, 50_000_000_000) for x in range(1, 1025)}
    assert len(packing.best_fit_decreasing(few).length) < 20_000
    plan = packing.best_fit_decreasing(many)
    assert len(plan.length) < 20_000
    assert plan.sequences * 1024 < 1.03 * sum(x * n for x, n in many.items())


@pytest.mark.parametrize("need,want", [(1, 3), (3, 3), (4, 8), (8, 8), (9, None)])
def test_tightest(need, want):
    open_ = packing.OpenSequences(12)
    for left in (8, 3, 12):
        open_.add(left, 0, 1)
    open_.take(12)
    assert open_.tightest(need) == want


def test_lots_are_encoded_as_the_library_does(monkeypatch):
    lib, lot = Tokenizer.from_file(PATH), packing.LotEncoder(PATH)
    odd = odd_texts()
    want = [lib.encode(t, add_special_tokens=False).ids for t in odd]
    assert [np.frombuffer(b, np.uint32).tolist() for b in lot.encode(odd)] == want
    monkeypatch.setattr(packing, "KEPT_PIECES", 50)
    assert [np.frombuffer(lot.encode([t])[0], np.uint32).tolist() for t in odd] == want
    assert lot.encode([]) == []


def texts():
    return ["", None, "a", "word " * 3000, "x" * 9000, "tail " * 1023, "tail " * 1022, "é日本 😀 <|endoftext|> a"] + [f"text {i} " * (i % 300) for i in range(400)]


def test_documents_by_brute_force(spark):
    lib = Tokenizer.from_file(PATH)
    rows = [(i, t, "clash", i) for i, t in enumerate(texts())] + [(None, "a b", "x", 1), (3, "a", "x", 1), (3, "a", "x", 1)]
    want, lengths = [], []
    for i, t, *_ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((i, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
            lengths.append(b - a)
    df = spark.createDataFrame(rows, "doc_id long, text string, offset string, piece int").repartition(3)
    got = packing.pack(packing.cut_documents(df, PATH)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r[:5]) for r in got), key=key) == sorted(want, key=key)
    assert whole([(r["length"], r["sequence_id"], r["offset"]) for r in got], 1024) == one_by_one(lengths, 1024)


def test_sequences_hold_the_ids(spark):
    df = spark.createDataFrame(list(enumerate(texts()[:40])), "doc_id long, text string").repartition(3)
    packed = packing.pack(packing.cut_documents(df, PATH, with_ids=True))
    made = {r["sequence_id"]: r for r in packing.sequences(packed).collect()}
    assert all(len(r["ids"]) <= 1024 for r in made.values())
    for r in packed.collect():
        ids = made[r["sequence_id"]]["ids"][r["offset"] : r["offset"] + r["length"]]
        assert ids == r["ids"] and zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"]


def test_lengths_that_do_not_fit_and_clashing_names(spark):
    rows = [(1, 5, "a"), (2, None, "b"), (3, 0, "c"), (4, 11, "d"), (5, 10, "e"), (6, 5, "f"), (7, -1, "g")]
    df = spark.createDataFrame(rows, "_part int, length int, offset string")
    got = sorted(map(tuple, packing.pack(df.repartition(3), 10).select("_part", "sequence_id", "offset").collect()))
    assert [r[0] for r in got] == [1, 2, 3, 4, 5, 6, 7]
    assert [r[0] for r in got if r[1] is None and r[2] is None] == [2, 3, 4, 7]
    assert whole([(5, *got[0][1:]), (10, *got[4][1:]), (5, *got[5][1:])], 10) == Counter({10: 2})


def test_empty(spark):
    assert packing.pack(packing.cut_documents(spark.createDataFrame([], "doc_id long, text string"), PATH)).collect() == []
