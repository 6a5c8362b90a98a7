"""Best-fit packing: documents cut into pieces, pieces packed into sequences of a fixed room.

Best fit decreasing takes the pieces from the longest to the shortest and puts each into
the open sequence with the least room that still holds it. Which pieces of one length go
where makes no difference to it, so it is run on how many pieces there are of each
length, and sequences that have had the same pieces are one group. A segment tree over
the rooms left finds the tightest group in logarithmic time. The plan has some thousand
runs (so many pieces of a length, into these sequences, from this offset) at any number
of documents and is that of packing all documents on one machine. Pieces get their
number among those of their length from counts by task, and their places from the plan.

The ids are made in lots: the pieces of text that a lot has anew are merged together in
one ragged array, by the rounds of ``tokencount``.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.llm.bpe import PIECES, LibrarySplit, byte_letters, is_plain, tokenizer_path
from docketry.llm.columns import field, fresh, released
from docketry.llm.sampling import sized
from docketry.llm.tokencount import NONE, RankMerger, groups
from docketry.runtime import checkpoint, table

#: Tokens of a sequence, and the id behind each document.
ROOM, END = 1024, 2
#: Pieces kept with their ids in a worker; pieces of more characters are not kept.
KEPT_PIECES, KEPT_CHARS = 1 << 18, 48


class LotEncoder(RankMerger):
    """Ids of whole texts by a byte-level vocabulary file, many texts at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.size = np.int64(len(vocab))
        letters = {b: c for c, b in byte_letters().items()}
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        pairs: dict[int, tuple[int, int]] = {}
        for n, m in enumerate(merges):
            a, b = m if isinstance(m, list) else m.split(" ")
            pairs.setdefault(vocab[a] * len(vocab) + vocab[b], (n, vocab[a + b]))
        self._table(np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64))
        self.pieces = regex.compile(PIECES)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {t: np.uint32(i).tobytes() for t, i in special.items()}
        self.specials = regex.compile("|".join(map(regex.escape, special)) or r"(?!)")
        self.library_split = LibrarySplit(path)
        self.kept: dict[str, bytes] = {}

    def merge(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece, as the bytes of 32-bit numbers; no piece is empty."""
        raw = [p.encode() for p in pieces]
        symbol = self.inner[np.frombuffer(b"".join(raw), np.uint8)]
        owner = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
        ended: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            inside = owner[1:] == owner[:-1]
            place = np.full(len(symbol), len(self.slots) - 1, np.int64)  # of the pair that starts here
            at = np.flatnonzero(inside)
            place[at] = self.find(symbol[at] * self.size + symbol[at + 1])
            rank = self.rank[place]
            first = np.flatnonzero(np.concatenate([[True], ~inside]))
            lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(symbol))))
            over = lowest == NONE
            ended.append((owner[over], symbol[over]))
            hit = (rank == lowest) & ~over
            where = np.flatnonzero(hit)
            # of pairs that overlap, as in aaa, every other one merges, from the left
            run = np.flatnonzero(np.diff(where, prepend=-2) != 1)
            odd = (np.arange(len(where)) - np.repeat(run, np.diff(np.append(run, len(where))))) % 2 == 1
            where = where[~odd]
            symbol[where] = self.result[place[where]]
            stay = ~over
            stay[where + 1] = False
            symbol, owner = symbol[stay], owner[stay]
        owner, symbol = (np.concatenate(c) for c in zip(*ended))
        order = np.argsort(owner, kind="stable")
        flat, ends = symbol[order].astype("<u4").tobytes(), 4 * np.cumsum(np.bincount(owner, minlength=len(raw)))
        return [flat[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]

    def split(self, text: str) -> list[str]:
        """The pieces of a text; strings of special tokens are pieces of their own."""
        cut = self.pieces.findall if is_plain(text) else self.library_split
        if not any(t in text for t in self.special):
            return cut(text)
        parts, at = [], 0
        for m in self.specials.finditer(text):
            parts += [*cut(text[at : m.start()]), m[0]]
            at = m.end()
        return parts + cut(text[at:])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as the bytes of 32-bit numbers."""
        split = [self.split(t) for t in texts]
        there = set().union(*split)
        kept = self.kept
        new = [p for p in there if p not in kept and p not in self.special]
        if len(kept) + len(new) > KEPT_PIECES:
            kept = {p: kept[p] for p in there if p in kept}
        kept |= self.special
        if new:
            kept.update(zip(new, self.merge(new)))
        out = [b"".join(map(kept.__getitem__, pieces)) for pieces in split]
        for p in new:
            if len(p) > KEPT_CHARS:
                del kept[p]
        self.kept = kept
        return out


@lru_cache(maxsize=2)
def load(path: str) -> LotEncoder:
    return LotEncoder(path)


class OpenSequences:
    """Groups of sequences by the room left in them: a segment tree says which rooms have any."""

    def __init__(self, room: int):
        self.leaves = 1 << room.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.groups: list[list[tuple[int, int]]] = [[] for _ in range(room + 1)]

    def add(self, left: int, first: int, n: int) -> None:
        """n sequences, numbered from first, with room left in each."""
        if n and left:
            self.groups[left].append((first, n))
            at = self.leaves + left
            while at and not self.any[at]:
                self.any[at] = 1
                at >>= 1

    def take(self, left: int) -> tuple[int, int]:
        """A group with just this room, which is closed."""
        group = self.groups[left].pop()
        at = self.leaves + left
        if not self.groups[left]:
            self.any[at] = 0
            at >>= 1
            while at:
                self.any[at] = self.any[2 * at] | self.any[2 * at + 1]
                at >>= 1
        return group

    def tightest(self, need: int) -> int | None:
        """The least room of any open sequence that holds ``need``."""
        at = self.leaves + need
        while not self.any[at]:
            while at & 1:
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at *= 2
            at += not self.any[at]
        return at - self.leaves


@dataclass
class Plan:
    """Runs of pieces in the order of (length, first): piece i of a run goes to sequence ``start + i // each`` at ``offset + i % each * length``."""

    length: np.ndarray
    first: np.ndarray
    start: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    sequences: int

    def places(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces, given by length and number among those of their length."""
        order = np.searchsorted(self.length, length, "left")
        last = np.searchsorted(self.length, length, "right")
        while (wide := last - order > 1).any():  # halve each piece's range of runs until one is left
            mid = (order + last) // 2
            right = wide & (self.first[np.minimum(mid, len(self.first) - 1)] <= number)
            order, last = np.where(right, mid, order), np.where(wide & ~right, mid, last)
        i = number - self.first[order]
        return self.start[order] + i // self.each[order], self.offset[order] + i % self.each[order] * length


def best_fit_decreasing(counts: Mapping[int, int], room: int = ROOM) -> Plan:
    """The plan for so many pieces of each length, from 1 to room."""
    open_, runs, sequences = OpenSequences(room), [], 0
    for length in sorted(counts, reverse=True):
        placed, count = 0, counts[length]
        while placed < count:
            left = open_.tightest(length)
            new = left is None
            if new:
                left, first = room, sequences
            # a sequence that took one piece is the tightest for the next, until it is too full
            each = left // length
            if new:
                n = -(-(count - placed) // each)
                sequences += n
            else:
                first, n = open_.take(left)
            fill = min(count - placed, n * each)
            full, over = divmod(fill, each)
            runs.append((length, placed, first, each, room - left))
            open_.add(left - each * length, first, full)
            if over:
                open_.add(left - over * length, first + full, 1)
            open_.add(left, first + full + (over > 0), n - full - (over > 0))
            placed += fill
    runs.sort()
    return Plan(*(np.array(c, np.int64) for c in (zip(*runs) if runs else [()] * 5)), sequences)


def cut_documents(docs: DataFrame, path: str, room: int = ROOM, end: int = END, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id column, piece, start, length, ids_crc32) of the pieces of every whole text's token ids, with ``end`` behind them.

    A document of more than ``room`` ids is cut into pieces of room ids, of which the
    first may be shorter; others are one piece. ``with_ids`` adds the ``ids`` themselves.
    A null text is empty and gives the end alone; repeated rows and null ids stay, an
    empty table gives none, further columns are not carried.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end_id = load(path), np.array([end], "<u4").tobytes()
        for batch in batches:
            sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0), np.int64)
            for at, to in groups(sizes):
                part = batch.slice(at, to - at)
                owner, piece, start, length, crc, kept = [], [], [], [], [], []
                for row, raw in enumerate(encoder.encode([t or "" for t in part.column(1).to_pylist()])):
                    ids = np.frombuffer(raw + end_id, "<u4")
                    cuts = [0, *range(len(ids) % room or room, len(ids) + 1, room)]
                    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        owner.append(row), piece.append(n), start.append(a), length.append(b - a)
                        crc.append(zlib.crc32(ids[a:b]))
                        if with_ids:
                            kept.append(ids[a:b].astype(np.int32))
                cols = [part.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"{field(docs.schema, id_col, 'id')}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(released(cut), schema).withColumnRenamed("id", id_col)


def _numbered(pieces: DataFrame, length_col: str, part: str, nth: str) -> DataFrame:
    """pieces with the task that wrote them and their number among its pieces of their length; written, so a task that runs again is read whole or not at all."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        task = TaskContext.get().partitionId()
        for batch in batches:
            lengths = np.asarray(batch.column(length_col).cast(pa.int64()).fill_null(0), np.int64)
            order = np.argsort(lengths, kind="stable")
            values, starts, counts = np.unique(lengths[order], return_index=True, return_counts=True)
            nth_ = np.empty(len(lengths), np.int64)
            before = np.array([seen.get(v, 0) for v in values.tolist()], np.int64)
            nth_[order] = np.arange(len(lengths)) - np.repeat(starts, counts) + np.repeat(before, counts)
            seen.update(zip(values.tolist(), (before + counts).tolist()))
            columns = [*batch.columns, pa.array(np.full(len(lengths), task), pa.int64()), pa.array(nth_)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, part, nth])

    schema = ", ".join([*(field(pieces.schema, c) for c in pieces.columns), f"`{part}` long, `{nth}` long"])
    return checkpoint(pieces.mapInArrow(released(number), schema))


def pack(pieces: DataFrame, room: int = ROOM, length_col: str = "length") -> DataFrame:
    """pieces with ``sequence_id`` and ``offset``, by best fit decreasing over all of them.

    Rows whose length is null, below 1 or above room have no place: both are null. Other
    columns stay; those by one of the two names give way. Sequences are numbered from 0
    and filled from 0 without gaps. Only the counts of the lengths, at most ``room``
    rows, go to the driver; counts by task and length are broadcast if they are few when counted.
    """
    pieces = pieces.select(*[c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")])
    part, nth, before = (fresh(pieces.columns, n) for n in ("_part", "_nth", "_before"))
    rows = _numbered(pieces, length_col, part, nth)
    counts = rows.where(F.col(length_col).between(1, room)).groupBy(part, length_col).agg(F.count("*").alias("n"))
    counts = checkpoint(counts)
    plan = best_fit_decreasing({int(r[0]): r[1] for r in counts.groupBy(length_col).agg(F.sum("n")).collect()}, room)
    upto = Window.partitionBy(length_col).orderBy(part)
    bases = counts.select(part, length_col, (F.sum("n").over(upto) - F.col("n")).alias(before))
    rows = rows.join(sized(bases), [part, length_col], "left").select(*pieces.columns, (F.col(before) + F.col(nth)).alias(before))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(before)
            fit = np.asarray(number.is_valid())
            where, offset = np.zeros(len(fit), np.int64), np.zeros(len(fit), np.int64)
            if fit.any():
                lengths = np.asarray(batch.column(length_col).cast(pa.int64()).fill_null(0), np.int64)
                where[fit], offset[fit] = plan.places(lengths[fit], np.asarray(number.fill_null(0), np.int64)[fit])
            columns = [*batch.columns[:-1], pa.array(where, mask=~fit), pa.array(offset, mask=~fit)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "sequence_id", "offset"])

    schema = ", ".join([*(field(pieces.schema, c) for c in pieces.columns), "sequence_id long, offset long"])
    return rows.mapInArrow(released(place), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, n_pieces) of packed pieces with their ids: the ids of each sequence in order, at most its room."""
    each = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    rows = packed.where(F.col("sequence_id").isNotNull()).groupBy("sequence_id").agg(each.alias("each"))
    return rows.select("sequence_id", F.flatten("each.ids").alias("ids"), F.size("each").alias("n_pieces"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(cut_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")))


QUERIES = {"op13_best_fit_packing": op13_best_fit_packing}
ORACLE: dict[str, str] = {}
