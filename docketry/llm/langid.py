"""Language identification by a byte convolutional network.

Filters of several widths run over the bytes of fixed-length windows, each keeps its
maximum, and a softmax layer turns the maxima into languages. The network is trained
in numpy on windows of a bounded sample of labelled documents. A text is cut into
windows from end to end; its language is that of the highest mean probability, windows
weighted by their bytes. For the pass over all documents each filter is folded with the
embedding into tables indexed by byte pairs, so a position costs a few lookups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.columns import field, utf8
from docketry.llm.sampling import held_out, per_class
from docketry.runtime import table

WINDOW, WIDTHS, FILTERS, DIMS = 256, (2, 3, 4), 8, 8
#: Bounds of the sample that is learned from: documents of a language, windows of a
#: document, windows in all, which many languages share.
DOCS_EACH, WINDOWS_EACH, SAMPLE = 400, 4, 400_000
EPOCHS, BATCH, RATE = 4, 64, 0.01


def windows(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows of WINDOW bytes, zeros after the end."""
    at = starts[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < sizes[:, None]
    return np.where(inside, flat[np.minimum(at, max(0, len(flat) - 1))], 0).astype(np.uint8)


class ByteNet:
    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.p = {"e": rng.normal(0, 0.5, (256, DIMS))}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, (w * DIMS) ** -0.5, (w * DIMS, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p["u"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages)))
        self.p["c"] = np.zeros(len(languages))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, rows = self.p, np.arange(len(x))
        e = p["e"][x]
        tops, places, patches = [], [], []
        for w in WIDTHS:
            n = WINDOW - w + 1
            patch = np.concatenate([e[:, o : o + n] for o in range(w)], 2)
            z = patch @ p[f"w{w}"] + p[f"b{w}"]
            place = z.argmax(1)
            tops.append(np.take_along_axis(z, place[:, None], 1)[:, 0])
            places.append(place)
            patches.append(patch[rows[:, None], place])
        z = np.concatenate(tops, 1)
        h = np.maximum(z, 0)
        out = h @ p["u"] + p["c"]
        out = np.exp(out - out.max(1, keepdims=True))
        out /= out.sum(1, keepdims=True)
        out[rows, y] -= 1
        out /= len(x)
        g = {"u": h.T @ out, "c": out.sum(0), "e": np.zeros_like(p["e"])}
        back = (out @ p["u"].T) * (z > 0)
        for k, w in enumerate(WIDTHS):
            d = back[:, k * FILTERS : (k + 1) * FILTERS]
            g[f"w{w}"] = np.einsum("bf,bfi->if", d, patches[k])
            g[f"b{w}"] = d.sum(0)
            de = (d[:, :, None] * p[f"w{w}"].T).reshape(len(x), FILTERS, w, DIMS)
            at = x[rows[:, None, None], places[k][:, :, None] + np.arange(w)]
            np.add.at(g["e"], at.reshape(-1), de.reshape(-1, DIMS))
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 7) -> ByteNet:
        rng, step = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(v) for k, v in self.p.items()}
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                step += 1
                pick = order[at : at + BATCH]
                for k, g in self._gradient(x[pick], y[pick]).items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.p[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def tables(self) -> ByteNet:
        """Fold embedding and filters into lookups by byte pair."""
        e = self.p["e"]
        fold = lambda w, o: e @ self.p[f"w{w}"][o * DIMS : (o + 1) * DIMS]
        self.lookup = {}
        for w in WIDTHS:
            parts = []
            for o in range(0, w - 1, 2):
                parts.append((o, True, (fold(w, o)[:, None] + fold(w, o + 1)[None]).reshape(65536, FILTERS)))
            if w % 2:
                parts.append((w - 1, False, fold(w, w - 1)))
            self.lookup[w] = parts
        return self

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        pair = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        tops = []
        for w in WIDTHS:
            z = None
            for o, paired, values in self.lookup[w]:
                index = pair if paired else x
                got = values.take(index[:, o : o + WINDOW - w + 1], 0)
                z = got if z is None else np.add(z, got, z)
            tops.append(z.max(1) + self.p[f"b{w}"])
        out = np.maximum(np.concatenate(tops, 1), 0) @ self.p["u"] + self.p["c"]
        out = np.exp(out - out.max(1, keepdims=True))
        return out / out.sum(1, keepdims=True)

    def texts(self, flat: np.ndarray, offsets: np.ndarray, rows: int = 512) -> np.ndarray:
        """Mean probabilities of each text, over all of its windows."""
        lengths = np.diff(offsets)
        n = -(-lengths // WINDOW)
        owner = np.repeat(np.arange(len(lengths)), n)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        starts = offsets[:-1][owner] + nth * WINDOW
        sizes = np.minimum(WINDOW, offsets[1:][owner] - starts)
        out = np.zeros((len(lengths), len(self.languages)))
        for at in range(0, len(owner), rows):
            s = slice(at, at + rows)
            np.add.at(out, owner[s], self.probabilities(windows(flat, starts[s], sizes[s])) * sizes[s, None])
        return out / np.maximum(lengths, 1)[:, None]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteNet | None:
    """A network from documents outside the held-out fold; None if none has a language.

    Learns from at most about DOCS_EACH documents of each language that a document
    with a text has, fewer where the languages are so many that SAMPLE would be
    exceeded, and WINDOWS_EACH windows of each, spread over its text. Windows alike in
    language and bytes count once.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(
        F.col("lang").isNotNull() & ~held_out("id")
    )
    known = known.where(F.length("text") > 0)
    languages = known.select("lang").distinct().count()
    each = max(1, min(DOCS_EACH, SAMPLE // (2 * WINDOWS_EACH * max(1, languages))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = utf8(batch.column(0))
            langs, parts = [], []
            for lang, a, b in zip(batch.column(1).to_pylist(), offsets[:-1], offsets[1:]):
                for s in np.unique(np.linspace(a, max(a, b - WINDOW), WINDOWS_EACH).astype(np.int64)):
                    langs.append(lang)
                    parts.append(flat[s : min(b, s + WINDOW)].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(parts, pa.binary())], ["lang", "part"])

    sample = per_class(known, "lang", each, "id", "text").select("text", "lang").mapInArrow(cut, "lang string, part binary").distinct()
    most = 2 * each * WINDOWS_EACH * max(1, languages)
    rows = sorted((r.lang, bytes(r.part)) for r in sample.orderBy(F.xxhash64("part", "lang"), "part", "lang").limit(most).collect())
    if not rows:
        return None
    languages = sorted({lang for lang, _ in rows})
    flat = np.frombuffer(b"".join(p for _, p in rows), np.uint8)
    sizes = np.array([len(p) for _, p in rows], np.int64)
    place = {lang: i for i, lang in enumerate(languages)}
    y = np.array([place[lang] for lang, _ in rows])
    return ByteNet(languages).fit(windows(flat, np.cumsum(sizes) - sizes, sizes), y)


def identify(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column, ``lang_pred`` and ``score``, the probability of that language.

    A text that is null or has no letter is ``und`` with score 0, as is every text if
    there is no network. Repeated rows and null ids are kept, an empty table gives an
    empty result, and further columns are not carried, so their names cannot clash.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = net.tables() if net else None
        names = np.array(net.languages if net else [], object)
        for batch in batches:
            known = np.asarray(batch.column(2), bool) & bool(names.size)
            lang, score = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            if known.any():
                mean = model.texts(*utf8(batch.column(1)))
                lang[known] = names[mean.argmax(1)][known]
                score[known] = np.minimum(mean.max(1), 1)[known]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .withColumn("letters", letters)
        .mapInArrow(apply, f"{field(docs.schema, id_col, 'id')}, lang_pred string, score double")
        .withColumnRenamed("id", id_col)
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_language_id": op4_language_id}
ORACLE: dict[str, str] = {}
