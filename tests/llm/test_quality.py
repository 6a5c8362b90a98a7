import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from docketry.llm import quality


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 9)))
    rows = []
    for i in range(400):
        words = [word() for _ in range(rng.randrange(60, 400))]
        if i % 40 == 0:
            words = [w + "%%%" for w in words]
        text = "".join(w + rng.choice(["\n", " ", " ", " ", "\t", "  "]) for w in words)
        rows.append((i, text, rng.choice(["en", None]), rng.choice(["a", "b", None])))
    odd = ["", None, " \n\x0b", "a", "a b", "a b c", "a b c a b c", "x x x x x", "x x x x", "l\nl\n\nl\n \n \n l", "|<>|", "a b c d " * 5000, "日本 語 " * 90]
    return rows + [(1000 + i, t, "en", "a") for i, t in enumerate(odd)] + [(None, "n", None, None), rows[0], rows[0]]


def test_counts_and_verdicts(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, lang string, source string, kept boolean").repartition(3)
    got = quality.quality_rules(df).collect()
    key = lambda x: tuple(map(str, x))
    counts = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=key)
    assert counts == sorted(((i, *brute(t)) for i, t, _, _ in rows), key=key)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    junk = {i for i in range(0, 400, 40)}
    verdict = {r.doc_id: r.kept for r in got}
    assert all(verdict[i] == (i not in junk) for i in range(400))


def test_estimate_ignores_a_minority_that_mean_and_covariance_follow(spark):
    rng = random.Random(3)
    rows = [("g", *(rng.gauss(0, 1) for _ in range(quality.P))) for _ in range(400)]
    rows += [("g", *(rng.gauss(30, 0.1) for _ in range(quality.P))) for _ in range(80)]
    rows += [("few", 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, ["grp", *(f"x{i}" for i in range(quality.P))])
    e = {r.grp: r for r in quality.minimum_determinants(df).collect()}
    assert {g: r.n for g, r in e.items()} == {"g": 480, "few": 1}
    assert all(abs(e["g"][f"m{i}"]) < 0.3 and e["g"][f"c{i}{i}"] < 3 for i in range(quality.P))
    far = df.join(quality._factored(quality.minimum_determinants(df)), "grp").withColumn("d2", quality._squared_distance())
    assert far.where("x0 > 20").agg(F.min("d2")).first()[0] > 150


def brute_estimate(x):
    """n, mean and scaled covariance of a group by numpy: shares and medians by the same bins."""
    floor = np.diag(np.square(quality.FLOOR))

    def binned(v):
        """Per bin of log1p: mean value and count."""
        at, n = np.unique(np.floor(64 * np.log1p(v)), return_counts=True)
        return np.array([v[np.floor(64 * np.log1p(v)) == b].mean() for b in at]), n

    def half(values, n):
        order = np.argsort(values, kind="stable")
        return values[order][np.flatnonzero(2 * np.cumsum(n[order]) >= n.sum())[0]]

    ends, starts = [], []
    middle = np.array([half(*binned(c)) for c in x.T])
    spread = np.array([half(np.abs(binned(c)[0] - m), binned(c)[1]) for c, m in zip(x.T, middle)])
    for name, m, sd in (("mean", x.mean(0), x.std(0)), ("median", middle, spread)):
        starts.append((name, m, np.diag(np.maximum(sd, quality.FLOOR) ** 2)))
    for name, m, cov in starts:
        before = None
        while True:
            d = x - m
            d2 = np.maximum(np.einsum("ij,ij->i", d, np.linalg.solve(cov, d.T).T), 2.0**-20)
            bins = np.floor(quality.BINS * np.log2(d2))
            rank = lambda p: np.sort(bins)[int(np.ceil(p * len(x))) - 1]
            near, scale = x[bins <= rank(quality.H)], 2 ** ((rank(0.5) + 0.5) / quality.BINS)
            to, wide = near.mean(0), np.cov(near.T, bias=True) + floor
            det = 0.5 * np.linalg.slogdet(wide)[1]
            if before is not None and det >= before - quality.FALL:
                ends.append((before, name, m, cov * max(scale, 0.1) / quality.MEDIAN))
                break
            m, cov, before = to, wide, det
    return min(ends, key=lambda e: e[:2])[2:]


def brute_distances(points, languages, groups):
    """Distances of all points by numpy, each by its group's estimate joined with wider ones."""
    out = np.zeros(len(points))

    def joined(at, wider):
        (m, c), own = brute_estimate(points[at]), (at.sum() / quality.SHRINK) ** 2
        return tuple((own * a + b) / (own + 1) for a, b in zip((m, c), wider))

    whole = brute_estimate(points)
    for lng, g in set(zip(languages, groups)):
        of = np.array(languages) == lng
        at = of & (np.array(groups) == g)
        m, cov = joined(at, joined(of, whole))
        d = points[at] - m
        out[at] = np.einsum("ij,ij->i", d, np.linalg.solve(cov, d.T).T)
    return out


def test_distances_and_verdicts_match_numpy(spark):
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 9)))
    rows = []
    for i in range(500):
        g = i % 3
        words = [word() + "%" * rng.choice([0, 0, 0, g]) for _ in range(int(math.exp(rng.gauss(5.2 + 0.3 * g, 0.4))) + 50)]
        if i % 25 == 0:
            words = [w * 5 + "###" for w in words]
        words += words[: len(words) * (i % 7) // 20]
        rows.append((i, " ".join(words), "en" if i % 11 else "de", f"s{g}" if i % 50 else "tail"))
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)).collect()}
    assert all(not r.base_failed for r in got.values())
    counts = np.array([brute(t) for _, t, _, _ in rows], float)
    points = np.stack([np.log1p(counts[:, 0]), counts[:, 1] / counts[:, 0], np.log1p(10 * counts[:, 2] / counts[:, 0]), counts[:, 4] / counts[:, 0]], 1)
    want = brute_distances(points, [r[2] for r in rows], [r[3] for r in rows])
    have = np.array([got[i].distance2 for i in range(500)])
    assert np.allclose(have, want, rtol=1e-6)
    assert [got[i].kept for i in range(500)] == (want <= quality.CUTOFF).tolist()
    assert 10 <= sum(not got[i].kept for i in range(500)) <= 20


def test_an_id_by_the_name_of_an_inner_column(spark):
    rows = corpus()[:60]
    got = {c: sorted(map(tuple, quality.quality_rules(spark.createDataFrame(rows, f"{c} long, text string, lang string, source string"), c).collect())) for c in ("doc_id", "grp", "x0")}
    assert got["grp"] == got["doc_id"] == got["x0"]


def test_empty_table(spark):
    assert quality.quality_rules(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).collect() == []


def test_windows_of_one_hash_count_only_with_the_same_words(spark, monkeypatch):
    whole = F.xxhash64
    monkeypatch.setattr(quality.F, "xxhash64", lambda *c: F.shiftleft(F.pmod(whole(*c), F.lit(5)), 50))
    rows = [(i, t) for i, (_, t, _, _) in enumerate(corpus()) if len(t or "") < 4000]
    got = quality.text_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_repeat_words for r in got} == {i: brute(t)[4] for i, t in rows}


def test_documents_of_small_groups_are_judged(spark):
    rng = random.Random(11)
    text = lambda junk=False: " ".join("".join(rng.choice("abcde") for _ in range(rng.randrange(2, 9))) + "%%%" * junk for _ in range(rng.randrange(60, 300)))
    rows = [(i, text(), "en", "hot") for i in range(120)] + [(200 + i, text(), None, "x") for i in range(60)]
    rows += [(1000 + i, text(), "en", f"tail{i % 20}") for i in range(60)] + [(2000 + i, text(), f"rare{i % 4}", None) for i in range(12)]
    junk = [(3000, text(True), "en", "tail1"), (3001, text(True), "rare1", None), (3002, text(True), None, "y"), (3003, text(True), "alone", "z")]
    got = quality.quality_rules(spark.createDataFrame(rows + junk, "doc_id long, text string, lang string, source string")).collect()
    assert len(got) == len(rows + junk) and all(r.distance2 is not None for r in got)
    assert {r.doc_id for r in got if not r.kept} == {i for i, *_ in junk}


def test_a_group_grows_without_a_leap(spark):
    """The same odd document in a uniform source beside a mixed one, with 49 and with 50 documents in its group."""
    rng = random.Random(23)
    word = lambda least, most: "".join(rng.choice("abcde") for _ in range(rng.randrange(least, most)))
    mixed = [(i, " ".join(word(2, 6 + i % 40) for _ in range(151)), "en", "mixed") for i in range(300)]
    uniform = [(1000 + i, " ".join(word(4, 6) for _ in range(150)), "en", "uniform") for i in range(49)]
    odd = (2000, " ".join(word(40, 48) for _ in range(150)), "en", "uniform")
    frame = lambda rows, n: spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(n)
    far = [quality.quality_rules(frame([*mixed, *uniform[:n], odd], 3)).where("doc_id = 2000").first().distance2 for n in (48, 49)]
    assert abs(far[0] - far[1]) < 0.2 * far[0]


def test_verdicts_do_not_depend_on_partitions(spark):
    rows = [(*r[:3], r[3]) for r in corpus()]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    one, many = ([(r.doc_id, r.kept, r.distance2) for r in quality.quality_rules(frame.repartition(n)).collect()] for n in (1, 7))
    key = lambda x: (str(x[0]), str(x[1]), x[2] or 0.0)
    for x, y in zip(sorted(one, key=key), sorted(many, key=key), strict=True):
        assert x[:2] == y[:2] and math.isclose(x[2], y[2], rel_tol=1e-9)


def test_all_rows_fail(spark):
    got = quality.quality_rules(spark.createDataFrame([(1, "a b", "en", "a"), (2, None, None, None)], "doc_id long, text string, lang string, source string")).collect()
    assert [(r.base_failed, r.kept, r.distance2) for r in got] == [(True, False, None)] * 2
