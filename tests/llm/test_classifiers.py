"""Language identification and toxicity: held-out accuracy, folds and odd rows."""

import random
import zlib

import numpy as np
import pytest

from docketry.llm import langid, toxicity

SF = "/root/testdata/sf0.01"


def kept_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in langid.op4_language_id(spark, SF).collect()}
    rows = docs.select("doc_id", "lang").collect()
    assert len(got) == len(rows) and all(got[r.doc_id].held_out == kept_out(r.doc_id) for r in rows)
    out = [got[r.doc_id].lang_pred == r.lang for r in rows if kept_out(r.doc_id)]
    assert np.mean(out) > 0.97


def test_toxicity_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    got = {r.doc_id: r for r in toxicity.op9_toxicity(spark, "/root/testdata/sf0.1").collect()}
    assert len(got) == 10000 and all(r.predicted == (r.score >= 0.3) for r in got.values())
    held = [r for r in labels if kept_out(r.doc_id)]
    caught = [got[r.doc_id].predicted for r in held if r.toxic == 1]
    spared = [1 - got[r.doc_id].predicted for r in held if r.toxic == 0]
    assert np.mean(caught) > 0.8 and np.mean(spared) > 0.98


ODD = [(1, None, None), (2, "", "en"), (3, "123 ;;", "en"), (None, "hello there", "en"), (4, "word " * 20000, "en"), (4, "word " * 20000, "en"), (5, "ein wort", None)]


@pytest.mark.parametrize("rows", [ODD, []])
def test_odd_rows(spark, rows):
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1), (9, 0), (None, 1), (5, None), (3, 0)], "doc_id long, toxic int")
    net = langid.train(docs)
    got = langid.identify(docs, net).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    assert all(0 <= r.score <= 1 and (r.lang_pred == "und") == (r.doc_id in (1, 2, 3)) for r in got)
    scored = toxicity.score_documents(docs, toxicity.train(docs, labels)).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    assert all(r.score == 0 for r in toxicity.score_documents(docs, None).collect())


def test_no_language_is_left_out(spark):
    rng = random.Random(6)
    rows = [(i, "".join(chr(0x3400 + 40 * (i % 250) + rng.randrange(3)) for _ in range(30)), f"l{i % 250:03}") for i in range(2500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.train(docs)
    assert len(net.languages) == 250


def test_every_window_counts():
    net = langid.ByteNet(["a", "b"]).tables()
    rng = np.random.default_rng(1)
    texts = [rng.integers(1, 256, n, dtype=np.uint8) for n in (0, 1, 3, 255, 256, 257, 5000)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = net.texts(np.concatenate(texts), offsets, rows=3)
    for t, row in zip(texts[1:], got[1:]):
        total = np.zeros(2)
        for at in range(0, len(t), langid.WINDOW):
            x = np.zeros((1, langid.WINDOW), np.uint8)
            part = t[at : at + langid.WINDOW]
            x[0, : len(part)] = part
            e = net.p["e"][x]
            tops = []
            for w in langid.WIDTHS:
                patch = np.concatenate([e[:, o : o + langid.WINDOW - w + 1] for o in range(w)], 2)
                tops.append((patch @ net.p[f"w{w}"] + net.p[f"b{w}"]).max(1))
            z = np.maximum(np.concatenate(tops, 1), 0) @ net.p["u"] + net.p["c"]
            total += np.exp(z)[0] / np.exp(z).sum() * len(part)
        assert np.allclose(row, total / len(t), atol=1e-5)


@pytest.mark.parametrize("vocabulary,length", [(200, 20), (2000, 30)])
def test_pairs_say_what_single_terms_do_not(spark, vocabulary, length):
    """Toxic if exactly one of an insult and a group is there: no linear weights can part these."""
    rng = random.Random(vocabulary)
    noise = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(vocabulary)]
    rows = []
    for i in range(4000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        text = [rng.choice(noise) for _ in range(length)] + ["insulting"] * a + ["foreigners"] * b
        rng.shuffle(text)
        rows.append((i, " ".join(text), int(a != b)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    machine = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    got = {r.doc_id: r.score for r in toxicity.score_documents(df, machine).collect()}
    out = [(got[i] > 0.5) == y for i, _, y in rows if kept_out(i)]
    assert np.mean(out) > 0.9
    machine.v[:] = 0
    alone = {r.doc_id: r.score for r in toxicity.score_documents(df, machine).collect()}
    assert np.mean([(alone[i] > 0.5) == y for i, _, y in rows if kept_out(i)]) < 0.8


def test_vectors_follow_the_gradient_of_the_loss():
    """One step without shrinking moves every vector against the numeric derivative of the batch's loss."""
    rng = np.random.default_rng(5)
    m = toxicity.FactorizationMachine(np.arange(9), 0.3)
    m.v, m.w = rng.normal(0, 0.5, m.v.shape), rng.normal(0, 0.5, 9)
    rows, y = [np.flatnonzero(rng.random(9) < 0.5) for _ in range(6)], np.array([0, 1, 0, 1, 1, 0.0])

    def loss(v):
        out = 0
        for r, label in zip(rows, y):
            z = m.bias + m.w[r].sum() + sum(v[i] @ v[j] for n, i in enumerate(r) for j in r[:n])
            out += np.logaddexp(0, -z if label else z)
        return out / len(rows)

    slope = np.zeros_like(m.v)
    for i in np.ndindex(m.v.shape):
        for sign in (1, -1):
            v = m.v.copy()
            v[i] += sign * 1e-6
            slope[i] += sign * loss(v) / 2e-6
    before, pull = m.v.copy(), np.full(9, 1e-2)
    m._step(rows, y, toxicity._Leader(9), pull)
    want = before - toxicity.PAIR_RATE / np.sqrt(pull)[:, None] * slope
    want *= (1 - toxicity.PAIR_RATE * toxicity.SHRINK / np.sqrt(pull))[:, None]
    assert np.allclose(m.v, want, atol=1e-6)


def test_documents_that_repeat_a_labelled_id_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "DOCS_EACH", 20)
    rows = [(i % 7, f"word{i} and more {i % 13}", None) for i in range(3000)] + [(7, "same", None)] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int")
    fitted = []
    whole = toxicity.FactorizationMachine.fit
    monkeypatch.setattr(toxicity.FactorizationMachine, "fit", lambda self, x, y: (fitted.append(len(x)), whole(self, x, y))[1])
    assert toxicity.train(docs, labels) is not None and fitted[0] < 120
