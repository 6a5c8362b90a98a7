"""Spelling variants against all pairs compared one by one."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docketry.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


def counted(rows):
    found = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                p = h % len(run)
                run = run[:p] + run[p + 1 :]
            if len(run) >= 7:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[p:] == b[p + 1 :] or len(a) == len(b) and a[p + 1 :] == b[p + 1 :]


def brute(counts):
    near = {w: [] for w in counts}
    for a, b in itertools.combinations(counts, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return sorted(out)


def run(spark, counts):
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    return sorted(map(tuple, spelling.variants(df).collect()))


@pytest.mark.parametrize("letters", ["ab", "abc", "aéz", "abcdefghijklmnopqrstuvwxyzàÿ×"])
def test_all_pairs_of_random_words(spark, letters):
    rng = random.Random(len(letters))
    counts = {}
    for _ in range(60):
        word = "".join(rng.choice(letters) for _ in range(rng.randrange(7, 12)))
        counts[word] = rng.choice([2, 30, 400, 5000])
        for _ in range(6):  # edits of edits, so that chains and ties come up
            p, kind, c = rng.randrange(len(word)), rng.randrange(3), rng.choice(letters)
            word = word[:p] + (c if kind else "") + word[p + (kind != 1) :]
            if len(word) >= 7:
                counts[word] = rng.choice([2, 2, 30, 400, 5000])
    want = brute(counts)
    assert run(spark, counts) == want
    assert any(r[4] > 1 for r in want) and any(r[1] for r in want)


def test_words_of_one_letter_and_chains(spark):
    counts = {"a" * n: 10**k * 2 for k, n in enumerate(range(7, 13))} | {"b" * 7: 2, "c" * 20: 3, "lonelyword": 9}
    want = brute(counts)
    assert run(spark, counts) == want
    assert ("a" * 7, "a" * 8, "a" * 12, 2, 1, 20) in want


def test_counts_of_whole_texts(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeÉéÀ×") for _ in range(rng.randrange(6, 10))) for _ in range(40)] + ["Grossschreibung", "GROSSSCHREIBUNG"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(200)), "clash") for i in range(60)]
    rows += [(None, "nullidword nullidword", "x"), (3, None, "x"), (4, "", "x"), (5, "wörter7wörters WÖRTERS_wörters Ωmegaωmega", "x"), (6, "shortbt " * 30_000, "x"), (6, "repeated row", "x"), (6, "repeated row", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string").repartition(3)
    want = counted([r[:2] for r in rows])
    got = {r["word"]: r["n"] for r in spelling.words(df).where(F.col("n") >= 2).collect()}
    assert got == want
    found = sorted(map(tuple, spelling.variants(spelling.words(df).where(F.col("n") >= 2)).collect()))
    assert found == brute(want)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.words(none)).collect() == []
