import hashlib
import random
from fractions import Fraction

from pyspark.sql import functions as F

from docketry.llm import mixing

WEIGHTS = {("a",): 3, ("b",): 1, ("c",): 0, ("a", "x"): 5, ("a", "y"): 1, ("a", "x", "s"): 2}


def share_out(budget, children):
    """children: name to (weight, supply); real shares by raising a common level until the budget is spent."""
    left, open_, got = Fraction(budget), {k for k, (w, s) in children.items() if w}, {}
    got = {k: Fraction(0) for k in children}
    while open_ and left > 0:
        total = sum(children[k][0] for k in open_)
        full = {k for k in open_ if children[k][1] <= left * children[k][0] / total}
        if not full:
            for k in open_:
                got[k] = left * children[k][0] / total
            return got
        for k in full:
            got[k] = Fraction(children[k][1])
            left -= children[k][1]
        open_ -= full
    return got


def brute_targets(supply, budget):
    """supply: path to tokens; whole-number targets may differ from these by one a level."""
    total = {}
    for path, s in supply.items():
        for i in range(len(path) + 1):
            total[path[:i]] = total.get(path[:i], 0) + s
    got = {(): Fraction(min(budget, total.get((), 0)))}
    for depth in range(3):
        for parent in [p for p in got if len(p) == depth]:
            kids = {p: (WEIGHTS.get(p, 1), s) for p, s in total.items() if len(p) == depth + 1 and p[:-1] == parent}
            got.update(share_out(got[parent], kids))
    return {p: g for p, g in got.items() if len(p) == 3}


def rows_of(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        d, lang, s = rng.choice("aaabc"), rng.choice(["x", "y", "z", None]), rng.choice(["s", "t", "u", "u", None, "n\n=s"])
        text = rng.choice([None, "", " \t\n", " ".join(["w"] * rng.choice([1, 3, 50])), "é, è\x0bz"])
        rows.append((i if i % 50 else None, text, d, lang, s))
    return rows + rows[:30]


def check(spark, rows, budget, epochs, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, domain string, lang string, source string, copies int")
    levels = {c: F.col(c) for c in ("domain", "lang", "source")}
    got = mixing.mixture(df, levels, weights=WEIGHTS, epochs=epochs, budget=budget).collect()
    assert len(got) == len(rows)
    leaves = {}
    for r in got:
        leaves.setdefault((r.domain, r.lang, r.source), []).append(r)
    supply = {p: epochs * sum(r.n_tokens for r in rs) for p, rs in leaves.items()}
    want = brute_targets(supply, budget)
    assert sum(r.n_tokens for r in got) == sum(len((t or "").split()) for _, t, *_ in rows)
    for p, rs in leaves.items():
        tokens = sum(r.n_tokens for r in rs)
        fit = {}
        for target in range(max(0, int(want[p]) - 3), int(want[p]) + 4):
            whole = target // tokens if tokens else 0
            mark = lambda r: "null" if r.doc_id is None else f"={r.doc_id}"
            key = lambda r: hashlib.md5(f"{mixing.SEED}:{whole}:{mark(r)}".encode()).hexdigest()
            copies, room = [], target - whole * tokens
            for r in rs:
                upto = sum(x.n_tokens for x in rs if key(x) <= key(r))
                copies.append(whole + (1 if room > 0 and upto <= room else 0))
            fit[target] = copies
        assert [r.copies for r in rs] in fit.values(), (p, want[p], [r.copies for r in rs])


def test_against_brute_force(spark, monkeypatch):
    for seed, budget, epochs, bucket in ((1, 900, 2, 4096), (2, 5000, 3, 5), (3, 10**12, 2, 3)):
        check(spark, rows_of(seed), budget, epochs, monkeypatch, bucket)


def test_small_cases(spark):
    schema = "doc_id long, text string, lang string, source string"
    assert mixing.mixture(spark.createDataFrame([], schema)).collect() == []
    assert mixing.apply_mixture(spark.createDataFrame([], schema)).collect() == []
    only_empty = spark.createDataFrame([(1, None, None, None), (2, "", "en", "src0")], schema)
    assert {r.copies for r in mixing.mixture(only_empty).collect()} == {0}


def test_rows_come_as_often_as_their_copies(spark):
    rows = [(i, "w " * (i % 7), "en" if i % 3 else None, f"src{i % 4}", i) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, copies long")
    copies = {r.doc_id: r.copies for r in mixing.mixture(df).collect()}
    taken = mixing.apply_mixture(df)
    assert taken.columns == df.columns
    got = [tuple(r) for r in taken.collect()]
    assert sorted(got, key=str) == sorted((r for r in rows for _ in range(copies[r[0]])), key=str)
