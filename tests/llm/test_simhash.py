import random
import re

import numpy as np
import xxhash

from docketry.llm import simhash


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    comp = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 4 and comp[i] != comp[j]:
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
    low = {}
    for c, (i, _) in zip(comp, rows):
        if i is not None:
            low[c] = min(low.get(c, i), i)
    return sorted(((i, f"{f:016x}", low.get(c)) for (i, _), f, c in zip(rows, fps, comp)), key=str)


def test_matches_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)] + ["É", "ÀB", "x y"]
    rows = []
    for i in range(60):
        words = [rng.choice(vocab) for _ in range(rng.choice([2, 5, 40, 400]))]
        rows.append((i + 10, " ".join(words)))
        for _ in range(rng.choice([0, 0, 1, 5])):
            near = list(words)
            near[rng.randrange(len(near))] = "changed"
            rows.append((len(rows) + 1000, "\t".join(near).upper() if rng.random() < 0.3 else "\n".join(near)))
    rows += [(1, None), (2, ""), (3, " \t\r\n\x0b\x0c"), (None, rows[0][1]), (rows[0][0], rows[0][1]), (None, "all alone here"), (5, "a b c d")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, fingerprint string").repartition(3)
    assert sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_forest_links_what_pairs_link(monkeypatch):
    monkeypatch.setattr(simhash, "LEAF_PAIRS", 64)
    monkeypatch.setattr(simhash, "PAIRS", 50)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 40, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 62, (40, 30, 3), dtype=np.uint64)
    fps = np.unique(base[:, None] ^ flips[..., 0] ^ flips[..., 1] ^ flips[..., 2])
    u, v = simhash.forest(np.zeros(len(fps), np.int64), fps)
    place = {int(f): i for i, f in enumerate(fps)}
    ours = simhash.merge_labels(np.arange(len(fps)), np.array([place[int(x)] for x in u]), np.array([place[int(x)] for x in v]))
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= 4)
    assert (ours == simhash.merge_labels(np.arange(len(fps)), i, j)).all() and len(u) < len(fps)


def test_shards_never_part_a_link():
    rng = np.random.default_rng(6)
    for n in (1, 10**5, 10**7, 10**9, 10**11):
        keys = simhash.shard_keys(n)
        for _ in range(200):
            a = int(rng.integers(0, 1 << 62))
            b = a
            for bit in rng.choice(64, 4, replace=False):
                b ^= 1 << int(bit)
            assert any(all((a >> at ^ b >> at) & ((1 << size) - 1) == 0 for at, size in pieces) for pieces in keys)


def test_components_of_a_long_chain(spark):
    from docketry.llm.graph import components

    n = 200
    order = list(range(n))
    random.Random(2).shuffle(order)
    links = [(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1001, 1000), (7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(n)}, 1000: 1000, 1001: 1000}


def test_keep_first_of_rows_with_maps(spark):
    """Rows that differ in the order of a map's entries are one row; rows of one id whose maps differ are not."""
    text = " ".join(f"w{i}" for i in range(40))
    kind = "doc_id long, text string, m map<string, int>, deep struct<a: array<map<int, map<string, string>>>>, _row int"
    one, turned = [{2: {"x": "y", "z": None}, 1: None}], [{1: None, 2: {"z": None, "x": "y"}}]
    rows = [(1, text, {"a": 1, "b": None}, (one,), 0), (1, text, {"b": None, "a": 1}, (turned,), 0), (2, text, None, None, 0), (3, "other words", {}, ([None],), 1), (3, None, {"a": 2}, (None,), 1)]
    got = simhash.keep_first(spark.createDataFrame(rows, kind))
    assert got.columns == ["doc_id", "text", "m", "deep", "_row"]
    assert sorted((r.doc_id, r.text) for r in got.collect() if r.text) == [(1, text), (3, "other words")] and got.count() == 3
