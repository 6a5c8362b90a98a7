"""Toxicity: a factorization machine over hashed terms.

Terms are words and word beginnings, hashed into a fixed number of buckets; every bucket
is a feature, whatever it says alone. The machine gives each feature a weight and a short
vector; the products of vectors are learned weights of pairs, so two terms can say
together what neither says alone. It is trained in numpy on a bounded sample of labelled
documents: first the weights, as follow-the-regularized-leader steps, which leave those of
rare terms at zero; then weights and vectors together, the vectors shrinking unless a pair
keeps pulling them. A part of the sample decides after which round to stop. Features that
end without weight and vector are left out of the machine, which then scores whole texts.
"""

from __future__ import annotations

import copy
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.columns import field, released
from docketry.llm.sampling import held_out, per_class, sized
from docketry.runtime import checkpoint, table

BUCKETS, PREFIXES = 1 << 17, (4, 5)
#: Bounds of the sample that is learned from: documents of each label, features in all.
DOCS_EACH, TERMS = 4000, 20_000_000
FACTORS, BATCH = 6, 32
#: Rounds over weights alone, rounds over weights and vectors, every how manyth document decides.
WEIGHT_ROUNDS, PAIR_ROUNDS, DECIDES = 10, 8, 5
#: Step and threshold of the weights; step, start and shrinking of the vectors; features
#: beyond which a document pulls at its vectors in proportion less.
RATE, SPARSE, PAIR_RATE, START, SHRINK, LARGE = 0.3, 20.0, 0.1, 0.02, 0.01, 64
#: Scores from here on are predicted toxic.
THRESHOLD = 0.3
KEPT_WORDS = 300_000

#: All bytes that are no part of a word become spaces; capitals become small.
_OTHER = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def words(text: str) -> set[bytes]:
    return set(text.lower().encode().translate(_OTHER).split())


def buckets(word: bytes) -> list[int]:
    """Buckets of a word and its beginnings of a few characters."""
    found = [zlib.crc32(word) % BUCKETS]
    chars = word.decode("utf-8", "ignore")
    for n in PREFIXES:
        if len(chars) > n:
            found.append(zlib.crc32(b"^" + chars[:n].encode()) % BUCKETS)
    return found


class FactorizationMachine:
    def __init__(self, features: np.ndarray, bias: float = 0.0, seed: int = 11):
        self.features = features
        self.bias = bias
        self.w = np.zeros(len(features))
        self.v = np.random.default_rng(seed).normal(0, START, (len(features), FACTORS))

    def margins(self, rows: list[np.ndarray], pairs: bool = True) -> np.ndarray:
        """Of rows that list the places of their features, each once."""
        some = range(0, max(1, len(rows)), 4 * BATCH)
        return np.concatenate([_margins(rows[at : at + 4 * BATCH], self.w, self.v if pairs else None, self.bias)[0] for at in some])

    def fit(self, rows: list[np.ndarray], y: np.ndarray, seed: int = 11) -> FactorizationMachine:
        """Weights and vectors after the round in which the deciding rows lose least."""
        decide = np.arange(len(rows)) % DECIDES == 0
        learn = np.flatnonzero(~decide) if not decide.all() else np.arange(len(rows))
        check, of_check = [rows[i] for i in np.flatnonzero(decide)], y[decide]
        loss = lambda pairs: np.logaddexp(0, np.where(of_check == 1, -1, 1) * self.margins(check, pairs)).mean()
        rng, leader = np.random.default_rng(seed), _Leader(len(self.w))
        pull = np.full(len(self.v), 1e-2)
        start, best = self.v.copy(), (loss(False), self.w.copy(), np.zeros_like(self.v), self.bias)
        kept = copy.deepcopy(leader)
        for n in range(WEIGHT_ROUNDS + PAIR_ROUNDS):
            pairs = n >= WEIGHT_ROUNDS
            if n == WEIGHT_ROUNDS:
                leader, self.w, self.v, self.bias = kept, best[1].copy(), start, best[3]
            for at in np.split(rng.permutation(learn), range(BATCH, len(learn), BATCH)):
                self._step([rows[i] for i in at], y[at], leader, pull if pairs else None)
            now = loss(pairs)
            if now < best[0]:
                best = now, self.w.copy(), self.v.copy() if pairs else np.zeros_like(self.v), self.bias
                kept = copy.deepcopy(leader)
        _, self.w, self.v, self.bias = best
        return self

    def _step(self, rows: list[np.ndarray], y: np.ndarray, leader: _Leader, pull: np.ndarray | None) -> None:
        margins, flat, doc, sums = _margins(rows, self.w, None if pull is None else self.v, self.bias)
        if not len(flat):
            return
        d = 1 / (1 + np.exp(-np.clip(margins, -30, 30))) - y
        there, place = np.unique(flat, return_inverse=True)
        self.w[there] = leader.step(there, np.bincount(place, d[doc], len(there)), self.w[there])
        self.bias -= 0.05 * d.mean()
        if pull is not None:
            d = d * np.minimum(1, LARGE / np.maximum(np.bincount(doc, minlength=len(rows)), 1)) / len(rows)
            by_sums = [np.bincount(place, (d * sums[:, k])[doc], len(there)) for k in range(FACTORS)]
            g = np.stack(by_sums, 1) - np.bincount(place, d[doc], len(there))[:, None] * self.v[there]
            pull[there] += (g * g).mean(1)
            self.v[there] -= (PAIR_RATE / np.sqrt(pull[there]))[:, None] * g
            self.v *= (1 - PAIR_RATE * SHRINK / np.sqrt(pull))[:, None]

    def trimmed(self) -> FactorizationMachine:
        """The machine of the features that have a weight or a vector."""
        live = (self.w != 0) | ((self.v**2).sum(1) > 1e-6)
        small = FactorizationMachine(self.features[live], self.bias)
        small.w, small.v = self.w[live], self.v[live]
        return small


class _Leader:
    """Follow the regularized leader: weights whose summed gradients stay small are zero."""

    def __init__(self, n: int):
        self.z, self.n = np.zeros(n), np.zeros(n)

    def step(self, at: np.ndarray, g: np.ndarray, w: np.ndarray) -> np.ndarray:
        before = np.sqrt(self.n[at])
        self.n[at] += g * g
        after = np.sqrt(self.n[at])
        self.z[at] += g - (after - before) / RATE * w
        z = self.z[at]
        return -np.sign(z) * np.maximum(np.abs(z) - SPARSE, 0) * RATE / (1 + after)


def _margins(rows: list[np.ndarray], w: np.ndarray, v: np.ndarray | None, bias: float):
    """Margins, the features of all rows one after the other, their rows, and the rows' summed vectors."""
    n = len(rows)
    flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    doc = np.repeat(np.arange(n), [len(r) for r in rows])
    out = bias + np.bincount(doc, w[flat], n)
    if v is None:
        return out, flat, doc, None
    vectors = v[flat]
    sums = np.stack([np.bincount(doc, vectors[:, k], n) for k in range(FACTORS)], 1)
    return out + 0.5 * ((sums**2).sum(1) - np.bincount(doc, (vectors**2).sum(1), n)), flat, doc, sums


class Featurizer:
    """Features of a text, with the features of words seen before at hand."""

    def __init__(self, features: np.ndarray):
        self.at = {int(b): i for i, b in enumerate(features)}
        self.kept: dict[bytes, tuple[int, ...]] = {}

    def __call__(self, text: str) -> set[int]:
        found: set[int] = set()
        kept = self.kept
        for word in words(text):
            hit = kept.get(word)
            if hit is None:
                hit = tuple(self.at[b] for b in buckets(word) if b in self.at)
                if len(word) <= 64:
                    if len(kept) >= KEPT_WORDS:
                        kept.clear()
                    kept[word] = hit
            if hit:
                found.update(hit)
        return found


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> FactorizationMachine | None:
    """A machine from labelled documents outside the held-out fold; None without both labels.

    A document with several label rows counts as toxic if any says so. Learns from at
    most about DOCS_EACH documents of each label and TERMS features in all, whichever is
    less; rows of one id with the same features count once. The bias is then moved to the
    shares of the labels among all labelled rows.
    """
    marked = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
        .where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("id"))
        .groupBy("id")
        .agg(F.max("y").alias("y"))
    )
    counts = {r.y: r["count"] for r in marked.groupBy("y").count().collect()}
    if set(counts) != {0, 1}:
        return None
    chosen = sized(per_class(marked, "y", DOCS_EACH, "id"))
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id").select("text", "y")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(np.fromiter((b for w in words(t or "") for b in buckets(w)), np.int32)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f.tobytes() for f in found], pa.binary()), batch.column(1)], ["x", "y"])

    rows = checkpoint(sample.mapInArrow(hashed, "x binary, y int").distinct())
    size = {r.y: (r.n, r.terms) for r in rows.groupBy("y").agg(F.count("*").alias("n"), F.sum(F.length("x") / 4).alias("terms")).collect()}
    if set(size) != {0, 1}:
        return None
    rate = min(1.0, *(2 * DOCS_EACH / n for n, _ in size.values()), TERMS / max(1, sum(t for _, t in size.values())))
    few = rows.where(F.pmod(F.xxhash64(F.lit("thin"), "x"), F.lit(1 << 20)) < int(rate * (1 << 20)))
    chosen_rows = sorted((r.y, bytes(r.x)) for r in few.collect())
    y = np.array([label for label, _ in chosen_rows], np.float64)
    if len(set(y)) < 2:
        return None
    found = [np.frombuffer(x, np.int32) for _, x in chosen_rows]
    features = np.unique(np.concatenate(found)).astype(np.int64)
    odds = float(np.log(y.sum() / (len(y) - y.sum())))
    machine = FactorizationMachine(features, odds).fit([np.searchsorted(features, f) for f in found], y).trimmed()
    machine.bias += float(np.log(counts[1] / counts[0])) - odds
    return machine


def _scorer(machine: FactorizationMachine | None):
    """A function from a column of texts to scores."""
    of = Featurizer(machine.features) if machine else None

    def score(texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        if of:
            for i, t in enumerate(texts):
                at = list(of(t.as_py() or ""))
                v = machine.v[at]
                s = v.sum(0)
                m = machine.bias + machine.w[at].sum() + 0.5 * ((s * s).sum() - (v * v).sum())
                out[i] = 1 / (1 + np.exp(-np.clip(m, -30, 30)))
        return out

    return score


def score_documents(docs: DataFrame, machine: FactorizationMachine | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column and ``score``, the chance that a text is toxic.

    A null or empty text has no terms and gets the bias alone; without a machine every
    score is 0. Repeated rows and null ids are kept, an empty table gives an empty
    result, and further columns are not carried, so their names cannot clash.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(machine)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(batch.column(1)))], ["id", "score"])

    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .mapInArrow(apply, f"{field(docs.schema, id_col, 'id')}, score double")
        .withColumnRenamed("id", id_col)
    )


def keep_clean(docs: DataFrame, machine: FactorizationMachine | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose texts score below the threshold, with all their columns."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(machine)
        for batch in batches:
            yield batch.filter(pa.array(score(batch.column(text_col)) < threshold))

    return docs.mapInArrow(released(clean), docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLE: dict[str, str] = {}
