"""Byte-level BPE: a backtracking encoder and an offset-table decoder.

The encoder takes the longest token that starts at each place, found by an
Aho-Corasick automaton over the vocabulary, and keeps it if the pair it forms with
the token before is compatible: merging by rank would leave the two side by side.
Otherwise it tries the next shorter token, and steps back when none is left. Places
found to be dead ends are marked, so a piece is read in linear time, and the result
is that of merging by rank. Compatibility of a pair is worked out once, by undoing
merges on both sides of the seam, and kept in a table.

The decoder gathers bytes through one offset table over all tokens' bytes.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.columns import field, ragged, released
from docketry.runtime import table

#: Fixed value: how byte-level BPE of this family cuts a text into pieces. Its white
#: space is Unicode's White_Space.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: Pieces kept with their ids in a worker, and as many older ones; pieces of more characters are not kept.
KEPT_PIECES, KEPT_CHARS = 1 << 16, 48
#: Pairs of tokens whose compatibility is kept.
KEPT_PAIRS = 1 << 18
#: Documents in a batch that is given back.
ROWS = 256


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable bytes are their own."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {chr(b): b for b in own}
    for n, b in enumerate(b for b in range(256) if b not in own):
        letters[chr(256 + n)] = b
    return letters


@lru_cache(maxsize=1)
def unassigned() -> regex.Pattern:
    """Characters that Python's Unicode tables do not know yet; other tables may class them otherwise."""
    codes = [c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn"]
    at = np.flatnonzero(np.diff(codes, prepend=-2) > 1)
    ends = np.append(at[1:], len(codes)) - 1
    return regex.compile("[" + "".join(f"{chr(codes[a])}-{chr(codes[b])}" for a, b in zip(at, ends)) + "]")


def is_plain(text: str) -> bool:
    """Whether all tables class the characters of a text alike."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return unassigned().search(text) is None


class LibrarySplit:
    """The library's own normalizer and splitter, for texts whose characters are newer than ours."""

    def __init__(self, path: str):
        self.path, self.letters = path, byte_letters()

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __call__(self, text: str) -> list[str]:
        t = self.tokenizer
        text = t.normalizer.normalize_str(text) if t.normalizer else text
        return [bytes(self.letters[c] for c in piece).decode() for piece, _ in t.pre_tokenizer.pre_tokenize_str(text)]


class ByteBpe:
    """A vocabulary file with encoder and decoder; tokens count by rank inside, by id outside."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        raw = lambda t: "".join(chr(letters[c]) for c in t)
        self.text = [chr(b) for b in range(256)]
        self.split: list[tuple[int, int]] = [(b, b) for b in range(256)]
        rank = {t: b for b, t in enumerate(self.text)}
        self.merged: dict[tuple[int, int], int] = {}
        for m in merges:
            a, b = m if isinstance(m, list) else m.split(" ")
            a, b = raw(a), raw(b)
            if a + b not in rank:
                rank[a + b] = len(self.text)
                self.text.append(a + b)
                self.split.append((rank[a], rank[b]))
            self.merged.setdefault((rank[a], rank[b]), rank[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        by_text = {raw(t): i for t, i in vocab.items() if t not in self.special}
        self.ids = np.array([by_text[t] for t in self.text], np.uint32)
        self._pairs: dict[tuple[int, int], bool] = {}
        self._automaton()
        self._offsets(by_text)
        self.pieces = regex.compile(PIECES)
        self.specials = regex.compile("|".join(regex.escape(t) for t in self.special) or r"(?!)")
        self.kept = _Kept(self)
        self.library_split = LibrarySplit(path)

    def _automaton(self) -> None:
        """All tokens that merging can reach, and for each the longest token it starts with."""
        self.lengths = [len(t) for t in self.text]
        reached = [True] * 256
        for t in range(256, len(self.text)):
            a, b = self.split[t]
            reached.append(reached[a] and reached[b] and self._merge(self.text[t]) == [t])
        self.automaton = ahocorasick.Automaton()
        for t, s in enumerate(self.text):
            if reached[t]:
                self.automaton.add_word(s, t)
        self.automaton.make_automaton()
        at = {s: t for t, s in enumerate(self.text) if reached[t]}
        self.shorter = [next((at[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in at), -1) for s in self.text]

    def _merge(self, s: str) -> list[int]:
        """Merging by rank, for checking the vocabulary's own tokens."""
        parts = [ord(c) for c in s]
        while len(parts) > 1:
            best = min((self.merged.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:])))
            if best[0] == 1 << 30:
                break
            parts[best[1] : best[1] + 2] = [best[0]]
        return parts

    def _offsets(self, by_text: dict[str, int]) -> None:
        last = max([*by_text.values(), *self.special.values()])
        tokens = [b""] * (last + 1)
        for t, i in by_text.items():
            tokens[i] = t.encode("latin-1")
        for t, i in self.special.items():
            tokens[i] = t.encode()
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_at = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging by rank leaves a and b as neighbours.

        Merges are undone on both sides of the seam, the later one first; if at some
        point the tokens that touch the seam would have merged before the merge just
        undone, a and b cannot both have come about.
        """
        known = self._pairs.get((a, b))
        if known is not None:
            return known
        left, right, before, ok = a, b, 1 << 30, True
        while True:
            if self.merged.get((left, right), 1 << 30) < before:
                ok = False
                break
            if left < 256 and right < 256:
                break
            if left > right and left >= 256:
                before, left = left, self.split[left][1]
            elif right >= 256:
                before, right = right + 1, self.split[right][0]
            else:
                before, left = left, self.split[left][1]
        if len(self._pairs) > KEPT_PAIRS:
            self._pairs.clear()
        self._pairs[(a, b)] = ok
        return ok

    def encode_piece(self, s: str) -> list[int]:
        """Ranks of the tokens of one piece, given as one character for each byte."""
        n = len(s)
        longest, shorter, lengths, pairs = self.automaton.iter_long, self.shorter, self.lengths, self._pairs
        out: list[int] = []
        open_ = bytearray(b"\1") * (n + 1)
        found = longest(s)  # goes on behind the token it has given
        at, token = 0, next(found)[1]
        while True:
            end = at + lengths[token]
            ok = open_[end]
            if ok and out:
                ok = pairs.get((out[-1], token))
                if ok is None:
                    ok = self.compatible(out[-1], token)
            if ok:
                out.append(token)
                at = end
                if at == n:
                    return out
                if found is None:
                    found = longest(s, at)
                token = next(found)[1]
                continue
            found = None
            token = shorter[token]
            while token < 0:  # a dead end
                open_[at] = 0
                token = out.pop()
                at -= lengths[token]
                token = shorter[token]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; special tokens' strings become their ids."""
        kept, cut = self.kept.__getitem__, self.pieces.findall if is_plain(text) else self.library_split
        parts, at = [], 0
        for m in self.specials.finditer(text) if any(t in text for t in self.special) else ():
            parts += map(kept, cut(text[at : m.start()]))
            parts.append(np.uint32(self.special[m[0]]).tobytes())
            at = m.end()
        parts += map(kept, cut(text[at:] if at else text))
        return np.frombuffer(b"".join(parts), np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        starts = self.token_at[ids]
        return self.token_bytes[ragged(starts, self.token_at[ids + 1] - starts)].tobytes().decode("utf-8", "replace")


class _Kept(dict):
    """Piece to the bytes of its ids; when full, what was not asked for since it was last full goes."""

    def __init__(self, bpe: ByteBpe):
        super().__init__()
        self.bpe, self.older = bpe, {}
        self.id_bytes = [i.tobytes() for i in bpe.ids]

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            letters = piece if piece.isascii() else piece.encode("utf-8").decode("latin-1")
            of = self.id_bytes
            found = b"".join([of[t] for t in self.bpe.encode_piece(letters)])
        if len(piece) <= KEPT_CHARS:
            if len(self) >= KEPT_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def _string_list(values: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.uint32)
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.astype(np.int32), pa.int32()))


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column and ``ids``, the token ids of each whole text.

    A null or empty text has no ids. Repeated rows and null ids are kept as they
    are, an empty table gives an empty result, and further columns are not carried,
    so their names cannot clash. A text of any length is read piece by piece.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = [bpe.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), _string_list(ids)], ["id", "ids"])

    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .mapInArrow(released(encode), f"{field(docs.schema, id_col, 'id')}, ids array<int>")
        .withColumnRenamed("id", id_col)
    )


def decode_documents(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The id and ids columns and ``decoded``; null ids decode to an empty text.

    Bytes that are no UTF-8 turn into U+FFFD. Ids outside the vocabulary raise.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [bpe.decode(np.asarray(x.values, np.int64) if x.is_valid else np.zeros(0, np.int64)) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["id", "ids", "decoded"])

    return (
        tokens.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
        .mapInArrow(released(decode), f"{field(tokens.schema, id_col, 'id')}, ids array<int>, decoded string")
        .withColumnRenamed("id", id_col)
        .withColumnRenamed("ids", ids_col)
    )


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """Digests of what encoding and then decoding give."""
    done = decode_documents(encode_documents(docs, path), path)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def tokenized(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """All columns of docs but the text; ``ids``, ``n_tokens``, and ``same``, whether the ids decode to the text.

    Columns of docs by one of the three names give way to the results.
    """
    others = [c for c in docs.columns if c != text_col and c.lower() not in ("ids", "n_tokens", "same")]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [t or "" for t in part.column(text_col).to_pylist()]
                ids = [bpe.encode(t) for t in texts]
                same = [bpe.decode(i.astype(np.int64)) == t for i, t in zip(ids, texts)]
                n = pa.array([len(i) for i in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in others], _string_list(ids), n, pa.array(same, pa.bool_())], [*others, "ids", "n_tokens", "same"])

    kept = ", ".join(field(docs.schema, c) for c in others)
    return docs.mapInArrow(released(apply), ", ".join(x for x in (kept, "ids array<int>, n_tokens long, same boolean") if x))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


QUERIES = {"op2_bpe": op2_bpe}
ORACLE: dict[str, str] = {}
