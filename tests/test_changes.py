"""Inserts and upserts against the same done row by row."""

import datetime
import random
import time

import pytest

from docketry.operators import changes, graph


def one_by_one(target, new, keys):
    taken = [{tuple(r[i] for i in k) for r in target if None not in [r[i] for i in k]} for k in keys]
    out = []
    for row in new:
        marks = [tuple(row[i] for i in k) for k in keys]
        if all(None in m or m not in t for m, t in zip(marks, taken)):
            out.append(row)
            for m, t in zip(marks, taken):
                t.add(m)
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,values", [(1, 400), (2, 150), (3, 40), (4, 900)])
def test_insert_ignore_by_brute_force(spark, seed, values):
    rng = random.Random(seed)
    value = lambda: rng.choice([None, *range(values)]) if rng.random() < 0.7 else rng.randrange(3)
    row = lambda i: (i, value(), value(), rng.randrange(2))
    target, new = [row(-i) for i in range(1, 9)], [row(i) for i in range(500)]
    schema = "id int, a int, b int, c int"
    got = changes.insert_ignore(spark.createDataFrame(target, schema), spark.createDataFrame(new, schema).repartition(5), ["a"], ["b", "c"], order=["id"])
    assert sorted(map(tuple, got.collect()), key=str) == one_by_one(target, new, [(1,), (2, 3)])


def test_a_long_chain_is_folded_once(spark):
    n = 10_000
    rows = [(i, i // 2, (i + 1) // 2 + n) for i in range(n)]  # each shares a key with the one before and another with the one after
    df = spark.createDataFrame(rows, "id int, a int, b int").repartition(4)
    began = time.perf_counter()
    got = sorted(map(tuple, changes.insert_ignore(df.limit(0), df, ["a"], ["b"], order=["id"]).collect()))
    assert sorted(got, key=str) == one_by_one([], rows, [(1,), (2,)])
    assert time.perf_counter() - began < 120


def test_rows_that_differ_by_a_microsecond_share_a_key(spark):
    at = datetime.datetime(2024, 1, 1)
    rows = [(1, at + datetime.timedelta(microseconds=m)) for m in (2, 1, 1)]
    df = spark.createDataFrame(rows, "k int, at timestamp")
    got = changes.insert_ignore(df.limit(0), df, ["k"]).collect()
    assert [tuple(r) for r in got] == [(1, at + datetime.timedelta(microseconds=1))]
    last = changes.upsert(df.limit(0), df, "k").collect()
    assert [tuple(r) for r in last] == [(1, at + datetime.timedelta(microseconds=2))]


def test_nulls_clashing_names_and_maps(spark):
    rows = [(1, 5, {"x": 1}), (1, 6, {"x": 2}), (None, None, {"y": 1}), (None, None, {"y": 1}), (2, None, None), (2, 7, None)]
    df = spark.createDataFrame(rows, "_place int, `_its_place` int, m map<string,int>")
    got = changes.insert_ignore(df.limit(0), df, ["_place"], ["_its_place"]).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, [rows[0], rows[2], rows[3], rows[5]]))
    none = changes.insert_ignore(df.limit(0), df.limit(0), ["_place"], ["_its_place"])
    assert none.collect() == [] and none.columns == df.columns
    t = spark.createDataFrame([(1, "a", "b"), (None, "n", None)], "k int, v string, _v string")
    new = spark.createDataFrame([(1, "c", 9), (None, "p", 9), (None, "p", 9), (2, None, 9)], "k int, v string, extra int")
    assert sorted(map(str, (tuple(r) for r in changes.upsert(t, new, "k").collect()))) == sorted(
        map(str, [(1, "c", "b"), (None, "n", None), (None, "p", None), (None, "p", None), (2, None, None)])
    )


def test_upsert_of_a_composite_key(spark):
    rng = random.Random(7)
    schema = "a int, b string, v int, w string"
    draw = lambda i: (rng.choice([None, 1, 2, 3]), rng.choice([None, "x", "y"]), rng.choice([None, i]), rng.choice([None, f"w{i}"]))
    target = {(a, b): (a, b, 0, None) for a in (1, 2) for b in ("x", "y")}
    new = [(*draw(i), i) for i in range(60)]
    want, loose = dict(target), []
    for a, b, v, w, _ in new:
        if a is None or b is None:
            loose.append((a, b, v, w))
            continue
        old = want.get((a, b), (a, b, None, None))
        want[(a, b)] = (a, b, old[2] if v is None else v, old[3] if w is None else w)
    got = changes.upsert(spark.createDataFrame(list(target.values()), schema), spark.createDataFrame(new, f"{schema}, at int").repartition(3), "a", "b", order=["at"])
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [*want.values(), *loose]))


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(200)] + [(5, 5), (999, 999)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in links:
        if u != v:
            a, b = sorted((find(u), find(v)))
            root[b] = a
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert graph.components(spark.createDataFrame([], "u long, v long")).collect() == []
