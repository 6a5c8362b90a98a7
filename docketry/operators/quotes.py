"""Which documents hold which quotes, by winnowed fingerprints.

Texts and quotes are folded as ``verify`` compares them. Of every WINDOW hashes of GRAM
characters in a row the least is a fingerprint, so what two texts share over LEAST_QUOTE
characters gives them a fingerprint in common, wherever it stands. Each quote waits at
the rarest of its fingerprints; a document's are looked up in a bit map of fixed size
before they leave the task that reads it, and only documents with a hit go on. Quotes
and documents meet in an equi-join and are then compared. No task holds the quotes, so
their number is not bounded by its memory, and the plan is the same for any number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.operators.verify import LEAST_QUOTE, WHITE, fold, fold_each, fold_with_places
from docketry.runtime import checkpoint

#: Characters of a hash and hashes of a window; a quote of LEAST_QUOTE characters is a window.
GRAM = LEAST_QUOTE // 2
WINDOW = LEAST_QUOTE - GRAM + 1
#: Logarithm of the bits of the map that documents' fingerprints are looked up in: 16 MB.
MAP_BITS = 27
#: Characters of a text that are hashed at once.
CHARS = 1 << 20
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_BUCKET = 1 << 15  # bits that bitmap_construct_agg puts into one row


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def grams(codes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all stretches of so many characters."""
    n = len(codes) - length + 1
    h = np.full(max(n, 0), length, np.uint64)
    for j in range(length if n > 0 else 0):
        h = h * _BASE + codes[j : j + n]
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def winnowed(codes: np.ndarray) -> np.ndarray:
    """The fingerprints of a text: the least hash of every window. Texts shorter than LEAST_QUOTE have none."""
    h = grams(codes, GRAM)
    if len(h) < WINDOW:
        return h[:0]
    width = 1
    while 2 * width <= WINDOW:
        h, width = np.minimum(h[:-width], h[width:]), 2 * width
    if width < WINDOW:
        h = np.minimum(h[: len(h) - (WINDOW - width)], h[WINDOW - width :])
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def fingerprints(folded: str, lengths: tuple[int, ...] = ()) -> np.ndarray:
    """Winnowed fingerprints of a text of any length, and the hashes of all its stretches of some lengths, each once."""
    codes, found = _codes(folded), []
    for at in range(0, max(1, len(codes)), CHARS):
        part = codes[at : at + CHARS + LEAST_QUOTE - 1]
        found += [winnowed(part), *(grams(part, n) for n in lengths)]
    return np.unique(np.concatenate(found))


def _waiting(quotes: DataFrame, quote_id: str, text_col: str) -> DataFrame:
    """(_quote_id, _quote, _length, _anchor): where each quote waits, and its folded length if that is below LEAST_QUOTE, else 0.

    Quotes that are blank, or shorter than LEAST_QUOTE before they are folded, are left
    out. What folds to less waits at the hash of its whole.
    """
    kind = quotes.schema[quote_id].dataType.simpleString()
    schema = pa.schema([("_quote", pa.string()), ("_length", pa.int32()), ("_anchors", pa.list_(pa.int64()))])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for row, quote in enumerate(batch.column(1).to_pylist()):
                if not quote or len(quote.strip()) < LEAST_QUOTE or not WHITE.sub(" ", quote).strip(" "):
                    continue
                form = fold(quote)
                short = len(form) if len(form) < LEAST_QUOTE else 0
                if form:
                    rows.append(row)
                    hashes = grams(_codes(form), short) if short else fingerprints(form)
                    out.append((quote, short, hashes.astype(np.int64).tolist()))
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else ((), (), ()), schema.types)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *columns], ["_quote_id", *schema.names])

    named = quotes.select(F.col(quote_id).alias("_quote_id"), F.col(text_col).alias("_quote"))
    marked = named.mapInArrow(mark, f"_quote_id {kind}, _quote string, _length int, _anchors array<long>")
    marked = checkpoint(marked.withColumn("_n", F.monotonically_increasing_id()))
    each = marked.select("_n", F.explode("_anchors").alias("_anchor"))
    often = each.groupBy("_anchor").agg(F.count("*").alias("_often"))
    rarest = each.join(often, "_anchor").groupBy("_n").agg(F.min(F.struct("_often", "_anchor")).alias("_best"))
    return checkpoint(marked.drop("_anchors").join(rarest, "_n").select("_quote_id", "_quote", "_length", F.col("_best._anchor").alias("_anchor")))


def _bit_map(anchors: DataFrame, bits: int) -> dict[int, bytes]:
    """The filled rows of the bit map of all anchors: at most 2 ** bits bits in all."""
    slot = F.shiftrightunsigned("_anchor", 64 - bits) + 1
    rows = anchors.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    return {r["bucket"] - 1: bytes(r["bits"]) for r in rows.collect()}


def _candidates(docs: DataFrame, id_type: str, filled: dict[int, bytes], bits: int, lengths: tuple[int, ...]) -> DataFrame:
    """(_id, _text, _anchors) of the documents with fingerprints in the bit map."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(1, (1 << bits) // _BUCKET) * _BUCKET // 8
        there = np.zeros(size, np.uint8)
        for bucket, raw in filled.items():
            there[bucket * _BUCKET // 8 :][: len(raw)] = np.frombuffer(raw, np.uint8)
        for batch in batches:
            rows, anchors = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                found = fingerprints(fold_each(text), lengths)
                slot = (found >> np.uint64(64 - bits)).astype(np.int64)
                found = found[(there[slot >> 3] >> (slot & 7)) & 1 == 1]
                if len(found):
                    rows.append(row)
                    anchors.append(found.astype(np.int64))
            taken = [c.take(pa.array(rows, pa.int64())) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(anchors, pa.list_(pa.int64()))], ["_id", "_text", "_anchors"])

    return docs.mapInArrow(look, f"_id {id_type}, _text string, _anchors array<long>")


def _compared(pairs: DataFrame, id_type: str, quote_type: str) -> DataFrame:
    """(_id, _quote_id, char_start, char_end) of the pairs whose text holds the quote. Pairs of one document come one after the other and fold it once."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hay, places = None, "", None
        for batch in batches:
            rows, starts, ends = [], [], []
            for row, (key, quote) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist())):
                if key != now:
                    now, places = key, None
                    text = batch.column(2)[row].as_py()
                    hay = fold_each(text)
                needle = fold(quote)
                at = hay.find(needle)
                if at >= 0:
                    if places is None:
                        places = fold_with_places(text)[1]
                    rows.append(row)
                    starts.append(places[at])
                    ends.append(places[at + len(needle) - 1] + 1)
            which = pa.array(rows, pa.int64())
            found = [batch.column(1).take(which), batch.column(4).take(which), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())]
            yield pa.RecordBatch.from_arrays(found, ["_id", "_quote_id", "char_start", "char_end"])

    return pairs.mapInArrow(compare, f"_id {id_type}, _quote_id {quote_type}, char_start int, char_end int")


def quoted_by(docs: DataFrame, quotes: DataFrame, id_col: str = "doc_id", quote_id: str = "item_id", text_col: str = "text", bits: int = MAP_BITS) -> DataFrame:
    """(id, quote id, char_start, char_end) of the quotes that each row of docs holds, at their first places.

    Quotes of fewer than LEAST_QUOTE characters are not looked for. Rows that repeat an
    id, of docs and of quotes, count each; null ids stay; null texts hold nothing; other
    columns are not carried. Empty tables give no rows. ``bits`` is how large the bit map
    is (15 to 32): a fuller one lets more documents go on to the join, never fewer pairs.
    """
    id_type, quote_type = docs.schema[id_col].dataType.simpleString(), quotes.schema[quote_id].dataType.simpleString()
    waiting = _waiting(quotes, quote_id, text_col)
    lengths = tuple(sorted(r[0] for r in waiting.where("_length > 0").select("_length").distinct().collect()))  # below LEAST_QUOTE
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_text").isNotNull())
    found = checkpoint(_candidates(texts, id_type, _bit_map(waiting, bits), bits, lengths).withColumn("_key", F.monotonically_increasing_id()))
    pairs = found.select("_key", F.explode("_anchors").alias("_anchor")).join(waiting.select("_anchor", "_quote_id", "_quote"), "_anchor")
    pairs = pairs.join(found.select("_key", "_id", "_text"), "_key").select("_key", "_id", "_text", "_quote", "_quote_id")
    return _compared(pairs, id_type, quote_type).withColumnsRenamed({"_id": id_col, "_quote_id": quote_id})
