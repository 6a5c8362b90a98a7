"""Each stage of the pipeline against brute force, on rows with nulls, ties, repeats and clashing columns."""

import collections
import random
import re

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from docketry.llm import bpe, mixing, simhash, suffix, toxicity
from tests.llm.test_suffix import corpus

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows():
    rows = [(i, t, random.Random(i).choice(["en", "de", None]), f"src{i % 3}" if i else None, len(t or "")) for i, t in corpus(4)]
    return [*rows, rows[0], rows[0], rows[7]]


def frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, SCHEMA + extra).repartition(3)


def test_toxic_documents_go(spark):
    docs = frame(spark, [(*r, "x") for r in odd_rows()], ", score string")
    machine = toxicity.FactorizationMachine(np.array(sorted(toxicity.buckets(b"ab")), np.int64))
    machine.w[:] = 3.0
    machine.bias = -2.0
    scores = {(r.doc_id, r.score) for r in toxicity.score_documents(docs, machine).collect()}
    got = toxicity.keep_clean(docs, machine)
    assert got.columns == docs.columns
    assert sorted(map(str, got.collect())) == sorted(str(r) for r in docs.collect() if (r.doc_id, next(s for i, s in scores if i == r.doc_id)) and scorer(machine, r.text) < 0.3)
    assert toxicity.keep_clean(docs, None).count() == docs.count()


def scorer(machine, text):
    at = sorted({i for w in toxicity.words(text or "") for b in toxicity.buckets(w) for i in np.flatnonzero(machine.features == b)})
    return 1 / (1 + np.exp(-machine.margins([np.array(at, np.int64)])[0]))


def shingle_texts(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    return tuple(words), {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def long_fingerprint(text):
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingle_texts(text)[1]]
    mask = (1 << 64) - 1
    mixed = [(h ^ h >> 29) * 0x9E3779B97F4A7C15 & mask for h in hashes]
    both = [h | (m ^ m >> 32) << 64 for h, m in zip(hashes, mixed)]
    return sum(1 << b for b in range(128) if 2 * sum(x >> b & 1 for x in both) > len(both))


def brute_kept(rows):
    """Ids that stay where all rows meet in one shard; ids are distinct or rows repeat."""
    first = {}
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(shingle_texts(r[1])[0], r)
    leaders, kept = [], []
    for i, t, *_ in first.values():
        fp, own = long_fingerprint(t), shingle_texts(t)[1]
        d, _, other = min([((fp ^ f).bit_count(), n, o) for n, (f, o) in enumerate(leaders)], default=(255, 0, set()), key=lambda x: x[:2])
        if d > simhash.CLOSE:
            leaders.append((fp, own))
        if d > simhash.APART or len(own & other) < 0.8 * len(own | other) - 1e-9:
            kept.append(i)
    return sorted(kept, key=str)


def changed(rng, words, share):
    return [f"new{rng.random()}" if rng.random() < share else w for w in words]


def test_one_document_of_each_group_stays(spark):
    rng = random.Random(8)
    rows = [(i, None if i == 3 else " ".join(f"w{rng.randrange(900)}" for _ in range(rng.choice([3, 30, 200]))), "en", None, i) for i in range(1, 60)]
    for i in range(200):
        rows.append((1000 + i, " ".join(changed(rng, (rows[i % 59][1] or "").split(" "), rng.choice([0, 0.01, 0.03, 0.1]))), "de", "s", 1))
    rows += [rows[6], rows[6], (None, rows[6][1], "en", "s", 1), (None, "nobody else", None, None, None), (40_000, " \t", None, None, 0), (39_999, rows[9][1].upper(), "x", "s", 1)]
    got = [r.doc_id for r in simhash.keep_first(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == brute_kept(rows) and len(got) < len(rows) - 60
    ties = [(41, "tie", "a", "s", 1), (41, "tie", "b", "s", 1), (41, "tie", "a", "s", 1)]
    assert len(simhash.keep_first(frame(spark, ties)).collect()) == 1


@pytest.mark.parametrize("low, high, least", [(0.8, 0.85, 0.9), (0.85, 0.95, 0.95), (0.95, 1.0, 0.98), (0.3, 0.8, 0.0)])
def test_near_copies_go_and_others_stay(spark, monkeypatch, low, high, least):
    monkeypatch.setattr(simhash, "SHARD", 16)
    rng = random.Random(5)
    rows, copies = [], []
    while len(copies) < 300:
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([60, 150, 400]))]
        near = changed(rng, words, rng.choice([0.005, 0.02, 0.03, 0.05]))
        a, b = shingle_texts(" ".join(words))[1], shingle_texts(" ".join(near))[1]
        if a != b and low <= len(a & b) / len(a | b) < high:
            copies.append(100_000 + len(copies))
            rows += [(len(copies), " ".join(words), "en", "s", 1), (copies[-1], " ".join(near), "en", "s", 1)]
    kept = {r.doc_id for r in simhash.keep_first(frame(spark, rows)).collect()}
    gone = len(copies) - len(kept & set(copies))
    print(low, high, gone / len(copies))
    assert kept >= set(range(1, 301)) and (gone >= least * len(copies) if least else gone == 0)


def test_every_near_copy_goes(spark, monkeypatch):
    """Against all pairs: whatever the shards and fingerprints miss is found by the rarest shingles."""
    monkeypatch.setattr(simhash, "APART", 10)
    rng = random.Random(6)
    often = [" ".join(f"c{rng.randrange(50)}" for _ in range(12)) for _ in range(4)]
    rows = [(0, "", "en", None, 0), (1, "one two", "en", None, 0), (2, "One\ttwo three four five six", "en", None, 0), (3, "one two three four five six", "en", None, 0)]
    while len(rows) < 400:
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([4, 7, 30, 60, 150]))] + rng.choice(often).split()
        rows.append((len(rows), " ".join(words), "en", "s", 1))
        for _ in range(rng.choice([0, 1, 4])):
            rows.append((len(rows), " ".join(changed(rng, words, rng.choice([0.005, 0.01, 0.02, 0.03]))), "en", "s", 1))
    sets = [shingle_texts(t)[1] for _, t, *_ in rows]
    gone = {i for i in range(len(rows)) if any(sets[i] == o or len(sets[i] & o) >= 0.8 * len(sets[i] | o) - 1e-9 for o in sets[:i])}
    kept = {r.doc_id for r in simhash.keep_first(frame(spark, rows)).collect()}
    assert kept == set(range(len(rows))) - gone and len(gone) > 100


@pytest.mark.parametrize("apart", [simhash.APART, 10])
def test_one_document_of_a_connected_group_stays(spark, monkeypatch, apart):
    """Against all pairs: chains in any order of ids, and families of which later members link earlier ones."""
    monkeypatch.setattr(simhash, "APART", apart)
    rng = random.Random(11)
    texts = []
    for _ in range(6):
        words = [f"w{rng.randrange(3000)}" for _ in range(100)]
        for at in range(5, 95, 8):
            texts.append(" ".join(words))
            words[at] = f"new{rng.random()}"
    for _ in range(3):
        base = [f"w{rng.randrange(3000)}" for _ in range(150)]
        texts += [" ".join(changed(rng, base, 0.022)) for _ in range(60)]
    rng.shuffle(texts)
    rows = [*((i, t, "en", "s", 1) for i, t in enumerate(texts)), (900, texts[7], "en", "s", 1), (901, None, "en", "s", 1), (902, " ", "en", "s", 1), (None, texts[8].upper(), "en", "s", 1)]
    sets = [shingle_texts(t)[1] for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    group = list(range(len(sets)))
    while lower := [(i, j) for i, j in links if group[i] != group[j]]:
        for i, j in lower:
            group[i] = group[j] = min(group[i], group[j])
    want = {i for i in group if group[i] == i} | {901}
    docs = frame(spark, rows)
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == want
    assert len(want) < len({r.doc_id for r in simhash.keep_first(docs).collect()}) - 10


def test_pairs_of_one_group_do_not_meet(spark):
    rows = [(no, True, no // 2, 10, [1, 2, 3]) for no in range(4)]
    met = simhash.meeting(spark.createDataFrame(rows, "no long, probe boolean, group long, size int, rare array<long>"), 0.8)
    assert sorted(map(tuple, met.collect())) == [(2, 0), (2, 1), (3, 0), (3, 1)]


def test_a_shard_of_close_copies_keeps_few_leaders():
    rng = np.random.default_rng(4)
    fps = np.repeat(rng.integers(0, 1 << 62, (1, 2), dtype=np.uint64), 5000, 0)
    for _ in range(3):
        fps[:, 0] ^= np.uint64(1) << rng.integers(0, 64, 5000, dtype=np.uint64)
    leaders, far = simhash.Leaders(), []
    for at in range(0, 5000, simhash.BLOCK):
        far.append(leaders.join(np.arange(at, min(5000, at + simhash.BLOCK)), fps[at : at + simhash.BLOCK])[0])
    assert len(leaders.no) == 1 and (np.concatenate(far)[1:] <= 6).all()


def test_repeats_are_cut(spark):
    rows = odd_rows()
    got = suffix.without_repeats(frame(spark, rows))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    spans = {(r.doc_id, r.whole): r.spans for r in suffix.remove_repeats(frame(spark, rows).selectExpr("doc_id", "text", "text as whole"), carry=["whole"]).collect()}
    want = []
    for i, t, lang, source, _ in rows:
        raw, kept = (t or "").encode(), ""
        at = 0
        for c in t or "":
            n = len(c.encode())
            kept += "" if any(s.start < at + n and at < s.end for s in spans[i, t]) else c
            at += n
        assert at == len(raw)
        want.append((i, kept, lang, source, len(kept)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_tokens_of_every_row(spark):
    rows = odd_rows()
    from tokenizers import Tokenizer

    path = bpe.tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = bpe.tokenized(frame(spark, rows), path).collect()
    want = [(i, tuple(library.encode(t or "", add_special_tokens=False).ids), lang, source, n) for i, t, lang, source, n in rows]
    assert sorted(((r.doc_id, tuple(r.ids), r.lang, r.source, r.n_chars) for r in got), key=str) == sorted(want, key=str)
    assert all(r.same and r.n_tokens == len(r.ids) for r in got)


def test_stages_are_empty_on_empty_tables(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_whole_run(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, sf)
        if name != "bpe":
            assert docs.columns == before.columns
        if name == "simhash_near_dedup":
            assert [r.doc_id for r in docs.orderBy("doc_id").collect()] == sorted(brute_kept([(r.doc_id, r.text) for r in before.collect()]))
        if name == "mixing":
            copies = {r.doc_id: r.copies for r in mixing.mixture(before).collect() if r.copies}
            assert dict(collections.Counter(r.doc_id for r in docs.collect())) == copies
    result = docs.collect()
    assert result and all(r.same for r in result)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_spans_widen_to_characters(n):
    text = np.frombuffer("aé日😀b".encode(), np.uint8)
    a, b = suffix.whole_characters(text, np.array([n]), np.array([n + 1]))
    assert bytes(text[a[0] : b[0]]).decode() in "aé日😀b"


def test_columns_by_any_name_pass_through(spark):
    names = ["_id", "_tag", "_copies", "_leaf", "ids", "n_tokens", "same", "kept", "spans", "row", "rank", "score", "fp", "grp"]
    rows = [(*r, *[f"{i} {n}" for n in names]) for i, r in enumerate(odd_rows())]
    docs = frame(spark, rows, "".join(f", `{n}` string" for n in names))
    labels = spark.createDataFrame([(r[0], i % 2) for i, r in enumerate(rows) if r[0]], "doc_id long, toxic int")
    for stage in (lambda d: toxicity.keep_clean(d, toxicity.train(d, labels), threshold=2.0), simhash.keep_first, suffix.without_repeats, mixing.apply_mixture):
        whole = {tuple(r[n] for n in names) for r in docs.collect()}
        docs = stage(docs)
        kept = [tuple(r[n] for n in names) for r in docs.collect()]
        assert docs.columns == [*(x.split()[0] for x in SCHEMA.split(", ")), *names] and kept and set(kept) <= whole
    done = bpe.tokenized(docs, bpe.tokenizer_path("byte_bpe_50k.json"))
    assert all(r.same is True and r.n_tokens == len(r.ids) and r.row.endswith(" row") for r in done.collect())


def test_fewer_of_a_family_meet_all(spark, monkeypatch):
    """Of a family about as alike as asked, comparing with several nearest leaves fewer for the search among all; the result is the same."""
    monkeypatch.setattr(simhash, "SHARD", 16)
    rng = random.Random(7)
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    rows = [(i, " ".join(changed(rng, base, 0.018)), "en", "s", 1) for i in range(400)]
    sets = [shingle_texts(t)[1] for _, t, *_ in rows]
    stay = {i for i in range(len(rows)) if not any(len(sets[i] & o) >= 0.8 * len(sets[i] | o) - 1e-9 for o in sets[:i])}
    asked, whole = [], simhash.meeting
    monkeypatch.setattr(simhash, "meeting", lambda texts, similarity: asked.append(texts.where("probe").count()) or whole(texts, similarity))
    for nearest in (1, simhash.NEAREST):
        monkeypatch.setattr(simhash, "NEAREST", nearest)
        assert {r.doc_id for r in simhash.keep_first(frame(spark, rows)).collect()} == stay
    print(asked, len(stay))
    assert len(stay) <= asked[1] < asked[0]


def joined_rows(df):
    """df's rows, and the most rows that one of its joins made."""
    rows, most, plans = df.collect(), [0], [df._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        if "Join" in plan.nodeName():
            most.append(plan.metrics().apply("numOutputRows").value())
        plans += [plan.children().apply(i) for i in range(plan.children().size())]
    return rows, max(most)


def test_a_family_that_is_not_alike_does_not_meet(spark):
    """Members of 144 shingles have 20 of their own, so any two share 124 of the 128 asked for: they meet no more often than they are many."""
    lists = [(no, True, 144, [1_000_000 + 100 * no + k for k in range(20)] + list(range(9))) for no in range(300)]
    near = [(no, True, 144, [2_000_000 + 100 * no + k for k in range(8)] + list(range(500, 521))) for no in (300, 301)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        texts = spark.createDataFrame([*lists, *near], "no long, probe boolean, size int, rare array<long>")
        rows, most = joined_rows(simhash.meeting(texts, 0.8))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert [tuple(r) for r in rows] == [(301, 300)] and most <= 300


def test_few_texts_of_a_family_are_read(spark, monkeypatch):
    """Of members that meet but are less alike than asked, the texts of few pairs are compared; the result is that of all pairs."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    rows = [(i, " ".join(changed(rng, base, 0.02)), "en", "s", 1) for i in range(200)]
    sets = [shingle_texts(t)[1] for _, t, *_ in rows]
    stay = {i for i in range(len(rows)) if not any(len(sets[i] & o) >= 0.8 * len(sets[i] | o) - 1e-9 for o in sets[:i])}
    met, read, meeting, similar = [], [], simhash.meeting, simhash.similar
    monkeypatch.setattr(simhash, "meeting", lambda *a: met.append((df := meeting(*a)).count()) or df)
    monkeypatch.setattr(simhash, "similar", lambda pairs, *a: read.append(pairs.count()) or similar(pairs, *a))
    assert {r.doc_id for r in simhash.keep_first(frame(spark, rows)).collect()} == stay
    print(met, read, len(stay))
    assert met[0] > 500 and read[-1] < 0.2 * met[0]


def test_parities_leave_no_pair_out(spark):
    """Pairs about as alike as asked, of all sizes: those of the similarity pass, most of the others do not, those far from it never."""
    rng = np.random.default_rng(10)
    rows, alike = [], {}
    for k in range(400):
        a = int(rng.choice([1, 4, 9, 60, 400, 3000]))
        gone, new = rng.binomial(a, rng.choice([0, 0.08, 0.11, 0.14, 0.3]), 2).tolist()
        pool = rng.permutation(rng.integers(0, 1 << 63, a + new, dtype=np.uint64))
        for no, own in ((2 * k, pool[:a]), (2 * k + 1, pool[gone:])):
            rows.append((no, len(own), np.frombuffer(simhash.parities(own), np.int64).tolist()))
        alike[2 * k + 1] = (a - gone) / (a + new), a
    texts = spark.createDataFrame(rows, "no long, size long, odd array<long>")
    pairs = spark.createDataFrame([(no, no - 1) for no in alike], "no long, before long")
    passed = {r.no for r in simhash.sifted(pairs, texts, 0.8).collect()}
    assert passed >= {no for no, (s, _) in alike.items() if s >= 0.8 - 1e-9} and len(passed) < len(alike)
    assert not [no for no in passed if alike[no][0] < 0.7 and 60 <= alike[no][1] <= 400]
