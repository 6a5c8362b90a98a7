"""Token counts by rank-synchronous array merging.

All new words of a batch lie in one ragged numpy array of symbols. In a round every
word merges all places of its own lowest-ranked pair, all words at once; a word
without a pair that merges leaves the array, and its surviving symbols are its count.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.bpe import LibrarySplit, byte_letters, is_plain, tokenizer_path
from docketry.llm.columns import field
from docketry.runtime import table

#: Words kept with their counts in a worker, and words of more characters are not kept.
KEPT_WORDS, KEPT_CHARS = 400_000, 48
#: Documents, and characters of them, whose new words are merged together.
ROWS, CHARS = 1024, 2_000_000
NONE = np.int64(1) << 40


class RankMerger:
    """Counts of a lower-casing word-end BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.size = np.int64(len(vocab) + 2)
        letters = {b: c for c, b in byte_letters().items()}
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[letters[b] + suffix] for b in range(256)], np.int64)
        pairs = {}
        for n, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            pairs.setdefault(vocab[a] * int(self.size) + vocab[b], (n, vocab[a + b]))
        keys = np.array(list(pairs), np.int64)
        self._table(keys, np.array(list(pairs.values()), np.int64))
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.specials = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        self.library_split = LibrarySplit(path)
        self.kept: dict[str, int] = {}

    def _table(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing: each key at its slot or one of the next few."""
        self.shift = np.uint64(64 - 19)
        self.slots = np.full((1 << 19) + 64, -1, np.int64)
        self.rank = np.full(len(self.slots), NONE, np.int64)
        self.result = np.zeros(len(self.slots), np.int64)
        self.probes = 1
        for key, slot, (rank, result) in zip(keys.tolist(), self._slot(keys).tolist(), values.tolist()):
            probe = 0
            while self.slots[slot + probe] != -1:
                probe += 1
            self.slots[slot + probe], self.rank[slot + probe], self.result[slot + probe] = key, rank, result
            self.probes = max(self.probes, probe + 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each pair in the table; the last place, whose rank is NONE, if it is no merge."""
        slot, out = self._slot(keys), np.full(len(keys), len(self.slots) - 1, np.int64)
        left = np.arange(len(keys))
        for _ in range(self.probes):
            there = self.slots[slot]
            hit = there == keys
            out[left[hit]] = slot[hit]
            go = ~hit & (there != -1)
            if not go.any():
                break
            left, slot, keys = left[go], slot[go] + 1, keys[go]
        return out

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each word, which must not be empty."""
        raw = [w.encode() for w in words]
        lengths = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(lengths)
        symbol = self.inner[data]
        symbol[ends - 1] = self.final[data[ends - 1]]
        word = np.repeat(np.arange(len(raw)), lengths)
        out = np.ones(len(raw), np.int64)
        while len(symbol) > 1:
            pair = np.flatnonzero(word[1:] == word[:-1])
            if not len(pair):
                break
            place = self.find(symbol[pair] * self.size + symbol[pair + 1])
            rank = self.rank[place]
            owner = word[pair]
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            lowest = np.minimum.reduceat(rank, first)
            pairs = np.diff(np.concatenate([first, [len(owner)]]))
            done = lowest == NONE
            out[owner[first[done]]] = pairs[done] + 1
            best = np.repeat(np.where(done, -1, lowest), pairs)
            hit = np.flatnonzero(rank == best)
            if not len(hit):
                break
            # of pairs that overlap, as in aaa, every other one merges, from the left
            joined = np.concatenate([[False], (pair[hit[1:]] == pair[hit[:-1]] + 1) & (owner[hit[1:]] == owner[hit[:-1]])])
            run = np.flatnonzero(~joined)
            since = np.arange(len(hit)) - np.repeat(run, np.diff(np.concatenate([run, [len(hit)]])))
            hit = hit[since % 2 == 0]
            symbol[pair[hit]] = self.result[place[hit]]
            keep = np.zeros(len(symbol), bool)
            keep[pair[np.repeat(~done, pairs)]] = True  # words that go on
            keep[pair[np.repeat(~done, pairs)] + 1] = True
            keep[pair[hit] + 1] = False
            symbol, word = symbol[keep], word[keep]
        return out

    def split(self, text: str) -> tuple[list[str], int]:
        """The words of a text, and how many special tokens' strings it holds."""
        n, parts = 0, [text]
        if any(t in text for t in self.special):
            n, parts = len(self.specials.findall(text)), self.specials.split(text)
        words: list[str] = []
        plain = is_plain(text)
        for part in parts:
            if not plain:
                words += self.library_split(part)
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # no final form in lower case
            words += self.words.findall(part.lower())
        return words, n

    def count_texts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        kept, split = self.kept, [self.split(t) for t in texts]
        new: set[str] = set()
        for words, _ in split:
            new.update(words)
        fresh = [w for w in new if w not in kept]
        found = dict(zip(fresh, self.count(fresh).tolist())) if fresh else {}
        if len(kept) + len(found) > KEPT_WORDS:
            kept.clear()
            found.update(zip(old := [w for w in new if w not in found], self.count(old).tolist() if old else []))
        kept.update(found)
        out = np.array([sum(map(kept.__getitem__, words)) + n for words, n in split], np.int64)
        for w in found:
            if len(w) > KEPT_CHARS:
                del kept[w]
        return out


@lru_cache(maxsize=2)
def load(path: str) -> RankMerger:
    return RankMerger(path)


def groups(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of at most ROWS rows and about CHARS characters."""
    at, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > at and (total + n > CHARS or i - at >= ROWS):
            yield at, i
            at, total = i, 0
        total += n
    if at < len(lengths):
        yield at, len(lengths)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column, ``n_bytes`` of each whole text in UTF-8 and ``n_tokens``.

    A null or empty text has 0 of both. Repeated rows and null ids are kept as they
    are, an empty table gives an empty result, and further columns are not carried,
    so their names cannot clash.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = load(path)
        for batch in batches:
            lengths = np.asarray(batch.column(1), np.int64)
            out = [merger.count_texts([t or "" for t in batch.column(2).slice(a, b - a).to_pylist()]) for a, b in groups(lengths)]
            n = np.concatenate(out) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    n_bytes = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    return (
        docs.select(F.col(id_col).alias("id"), n_bytes.alias("n_bytes"), F.col(text_col).alias("text"))
        .mapInArrow(count, f"{field(docs.schema, id_col, 'id')}, n_bytes long, n_tokens long")
        .withColumnRenamed("id", id_col)
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


QUERIES = {"op7_token_counts": op7_token_counts}
ORACLE: dict[str, str] = {}
