"""Suffix-array dedup: bytes covered by strings that repeat across documents go.

Every window of LENGTH bytes is keyed by its minimizer, the smallest hash among its
k-grams, so equal windows share a key wherever they stand. Neighbouring windows with
one key form a block; only blocks travel, packed as arrays, and each task sends a block
once however often it meets it.

0. crowds: keys under which very many blocks differ, as at the ends of a passage that a
   large share of all documents hold. Their blocks are dealt as single windows keyed by
   their own hash, so no key gathers more than a row of each task. The same pass counts
   the bytes, from which the number of parts follows.
1. blocks: windows to blocks of (key, two block hashes, document, place), dealt by key.
2. match: equal blocks are decided whole by their smallest document. Where a key has
   blocks that differ, at the ends of a repeated passage, their bytes are asked for.
3. fetch: the documents cut out those bytes, dealt by key again.
4. resolve: a suffix sort of these passages. Suffixes start out ordered by key and first
   bytes; a bottom-up mergesort then compares suffixes by their common extension, found
   with prefix polynomial hashes and binary search, and one byte after it. Neighbours
   that the hashes call equal are verified byte by byte.
5. cut: each document drops the union of its repeated windows.

Equality of whole blocks, and of the windows of crowded keys, rests on the key, a hash of
48 bits and one of 32 of another base and other values, and not on a check of their bytes.
Only blocks of one key are compared, and crowds bound these: with 6e12 blocks, as 100 TB
have, at most 2e19 pairs, of which 80 bits call 2e-5 falsely equal. Equality of suffixes
rests on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.columns import ragged, released, released_groups, utf8
from docketry.runtime import checkpoint, partitions, table

LENGTH, GRAM = 50, 20
#: Bytes hashed at once, blocks sent at once, longest block, bytes that start out a sort,
#: bytes sorted at once (or all that share a key).
PIECE, FLUSH, LONGEST, HEAD, SORTED = 1 << 19, 500_000, 1024, 8, 1 << 21
#: Unlike blocks of a key among those sent at once that are worth counting; a key is crowded
#: if it has more than CROWDED, or than a millionth of all blocks where these are so many
#: that MOST_CROWDS keys might. A key that is not has fewer than that, and at most one
#: block more of each lot sent at once.
CROWD, CROWDED, MOST_CROWDS = 2, 10_000, 1_000_000
#: Bytes of text that a part should hold.
PART = 512 << 20
#: Rank of a document without an id: after all others.
LAST = (1 << 63) - 1

#: Kinds of numbers and the bytes kept of each.
BLOCK = (("u8", 5), ("u8", 6), ("u4", 4), ("u4", 4), ("u4", 2))  # key, two hashes, step from the place before, windows
OWNER = (("u8", 8), ("i8", 6), ("u4", 4), ("u4", 4))  # step from the rank before, tag, chunk, blocks
COVER = (("i8", 8), ("i8", 6), ("u4", 4), ("u4", 4))  # rank, tag, first window, windows
WANTED = (("i8", 8), ("i8", 6), ("u4", 4), ("u4", 4), ("u8", 5))  # rank, tag, first window, windows, key
ROW = "kind int, part int, data binary"
BLOCKS, COVERS, WANTS, PASSAGES = 0, 1, 2, 3


def pack(layout, arrays) -> bytes:
    """Arrays of one length as compressed byte planes."""
    planes = [np.ascontiguousarray(np.asarray(a).astype(f"<{kind}").view(np.uint8).reshape(-1, int(kind[1]))[:, :kept].T) for (kind, kept), a in zip(layout, arrays)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in planes))


def unpack(layout, data: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n, out, at = len(raw) // sum(kept for _, kept in layout), [], 0
    for kind, kept in layout:
        wide = np.zeros((n, int(kind[1])), np.uint8)
        wide[:, :kept] = raw[at : at + n * kept].reshape(kept, n).T
        out.append(wide.reshape(-1).view(f"<{kind}"))
        at += n * kept
    return out


def unpack_all(layout, datas: list[bytes]) -> list[np.ndarray]:
    parts = [unpack(layout, d) for d in datas]
    return [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, f"<{kind}") for kind, _ in layout]


def pack_blocks(arrays) -> bytes:
    """Blocks in the order of their documents; what they share with their document goes once."""
    key, block, second, rank, tag, chunk, place, size = arrays
    new = np.concatenate([[True], (rank[1:] != rank[:-1]) | (tag[1:] != tag[:-1]) | (chunk[1:] != chunk[:-1])])[: len(key)]
    first = np.flatnonzero(new)
    steps = np.diff(rank[first].view(np.uint64), prepend=np.uint64(0))
    owners = pack(OWNER, (steps, tag[first], chunk[first], np.diff(np.append(first, len(key)))))
    return len(owners).to_bytes(4, "little") + owners + pack(BLOCK, (key, block, second, np.diff(place.astype(np.uint32), prepend=np.uint32(0)), size))


def unpack_blocks(data: bytes) -> list[np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    steps, tag, chunk, count = unpack(OWNER, data[4 : 4 + n])
    rank = np.cumsum(steps, dtype=np.uint64).view(np.int64)
    key, block, second, step, size = unpack(BLOCK, data[4 + n :])
    return [key, block, second, *(np.repeat(x, count) for x in (rank, tag, chunk)), np.cumsum(step, dtype=np.uint32), size]


def rows(kind: int, parts, datas) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * len(datas), pa.int32()), pa.array(parts, pa.int32()), pa.array(datas, pa.binary())], ["kind", "part", "data"]
    )


def dealt(kind: int, packed, part: np.ndarray, arrays) -> pa.RecordBatch:
    """One packed row of each part."""
    order = np.argsort(part, kind="stable")
    part, arrays = part[order], [a[order] for a in arrays]
    at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    ends = np.append(at[1:], len(part))
    return rows(kind, part[at], [packed([a[i:j] for a in arrays]) for i, j in zip(at, ends)])


def covers(chunk: np.ndarray, arrays) -> pa.RecordBatch:
    return dealt(COVERS, partial(pack, COVER), chunk.astype(np.int64), arrays)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least the first n powers of a base and of its inverse; a worker keeps the longest so far."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p))
        _POWERS[base] = out[0], out[1]
    return _POWERS[base]


class Hashes:
    """Prefix polynomial hashes modulo 2^64 over random values of the bytes."""

    SEED = 20

    def __init_subclass__(cls) -> None:
        cls._draw()

    @classmethod
    def _draw(cls) -> None:
        rng = np.random.default_rng(cls.SEED)
        cls.VALUE = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        cls.BASE = int(rng.integers(1 << 40, 1 << 62)) | 1

    def __init__(self, data: np.ndarray):
        size = max(1 << 20, -(-len(data) >> 20) << 20)
        power, self.inverse = powers(self.BASE, size)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.VALUE[data] * power[: len(data)], out=self.prefix[1:])

    def of(self, start, length):
        """Hashes of ranges, alike wherever they stand."""
        return (self.prefix[start + length] - self.prefix[start]) * self.inverse[start]


Hashes._draw()


class OtherHashes(Hashes):
    """Hashes of another base and other values."""

    SEED = 21


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def single_windows(h: Hashes, other: Hashes, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Key, two hashes and place of each window of some blocks; the key is a part of a hash of its bytes."""
    at = ragged(first, size)
    second = mix(other.of(at, LENGTH) + np.uint64(1))
    return mix(second) >> np.uint64(24), mix(h.of(at, LENGTH) + np.uint64(1)) >> np.uint64(16), second & np.uint64(0xFFFFFFFF), at


def find_blocks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, crowds: np.ndarray | None = None):
    """key, two hashes, piece, first window and windows of each block of several pieces of data.

    Blocks whose key is among crowds, sorted, come as blocks of a single window.
    """
    n = len(data) - LENGTH + 1
    none = np.zeros(0, np.int64)
    if n < 1:
        return (*[none.astype(np.uint64)] * 3, none, none, none)
    h = Hashes(data)
    grams = mix((h.prefix[GRAM:] - h.prefix[:-GRAM]) * h.inverse[: len(data) - GRAM + 1])
    width, span, least = LENGTH - GRAM + 1, 1, grams
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    edge = np.empty(n, bool)
    edge[0] = True
    np.not_equal(least[1:], least[:-1], out=edge[1:])
    edge[starts[starts < n]] = True
    after = ends - LENGTH + 1
    edge[after[(after >= 0) & (after < n)]] = True
    first = np.flatnonzero(edge)
    size = np.diff(np.append(first, n))
    piece = np.searchsorted(starts, first, "right") - 1
    whole = first + LENGTH <= ends[piece]
    first, size, piece = first[whole], size[whole], piece[whole]
    if len(size) and size.max() > LONGEST:  # periodic text
        cuts = -(-size // LONGEST)
        nth = np.arange(int(cuts.sum())) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        left = np.repeat(size, cuts) - nth * LONGEST
        first, piece = np.repeat(first, cuts) + nth * LONGEST, np.repeat(piece, cuts)
        size = np.minimum(left, LONGEST)
    key = mix(least[first]) >> np.uint64(24)
    other = OtherHashes(data)
    block, second = (mix(x.of(first, size + (LENGTH - 1)) + size.astype(np.uint64)) >> np.uint64(bits) for x, bits in ((h, 16), (other, 32)))
    if crowds is not None and len(crowds):
        crowded = crowds[np.minimum(np.searchsorted(crowds, key), len(crowds) - 1)] == key
        if crowded.any():
            k, b, c, at = single_windows(h, other, first[crowded], size[crowded])
            owner = np.repeat(piece[crowded], size[crowded])
            plain = ~crowded
            key, block, second, piece = (np.concatenate([x[plain], y]) for x, y in ((key, k), (block, b), (second, c), (piece, owner)))
            first, size = np.concatenate([first[plain], at]), np.concatenate([size[plain], np.ones(len(at), size.dtype)])
    return key, block, second, piece, first, size


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key is there more than once."""
    s = np.sort(keys)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    return twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys


def later_copies(key, block, second, rank) -> np.ndarray:
    """Places of blocks that a document of smaller rank has too."""
    there = np.flatnonzero(repeated(key))
    order = there[np.lexsort((rank[there], second[there], block[there], key[there]))]
    if not len(order):
        return order
    k, b, c, r = key[order], block[order], second[order], rank[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])])
    least = r[np.flatnonzero(new)][np.cumsum(new) - 1]
    return order[r > least]


def _send(held: list, buckets: int) -> Iterator[pa.RecordBatch]:
    """Blocks dealt by key; copies within the task are decided here, so each block goes once."""
    key, block, second, rank, tag, chunk, place, size = (np.concatenate(x) for x in zip(*held))
    held.clear()
    copies = later_copies(key, block, second, rank)
    if len(copies):
        yield covers(chunk[copies], [a[copies] for a in (rank, tag, place, size)])
    go = np.ones(len(key), bool)
    go[copies] = False
    yield dealt(BLOCKS, pack_blocks, (key[go] % np.uint64(buckets)).astype(np.int64), [a[go] for a in (key, block, second, rank, tag, chunk, place, size)])


def _batches_of_blocks(batches: Iterator[pa.RecordBatch], crowds: np.ndarray | None = None) -> Iterator[list]:
    """Lists of (key, block, second, rank, tag, chunk, place, size) arrays, about FLUSH blocks each."""
    held, n = [], 0
    for batch in batches:
        rank, tag, chunk = (np.asarray(batch.column(i), np.int64) for i in range(3))
        flat, offsets = utf8(batch.column(3))
        doc = 0
        while doc < batch.num_rows:
            upto = max(doc + 1, int(np.searchsorted(offsets, offsets[doc] + PIECE, "right")) - 1)
            a, b = int(offsets[doc]), int(offsets[upto])
            for at in range(a, max(a + 1, b), PIECE):  # more than one only for a long document
                end = min(b, at + PIECE + LENGTH - 1)
                if b - a <= PIECE:
                    starts, ends = offsets[doc:upto] - a, offsets[doc + 1 : upto + 1] - a
                else:
                    starts, ends = np.array([0]), np.array([end - at])
                key, block, second, piece, first, size = find_blocks(flat[at:end], starts, ends, crowds)
                if b - a > PIECE:
                    inside = first < PIECE  # later windows belong to the next piece
                    size = np.minimum(size, PIECE - first)
                    if not inside.all() or (first + size > PIECE).any():
                        key, block, second, piece, first, size = (x[inside] for x in (key, block, second, piece, first, size))
                d = doc + piece
                held.append((key, block, second, rank[d], tag[d], chunk[d], at + first - offsets[d], size))
                n += len(key)
                if n >= FLUSH:
                    yield held
                    held, n = [], 0
            doc = upto
    if n:
        yield held


def _blocks(buckets: int, crowds: np.ndarray | None = None):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _batches_of_blocks(batches, crowds):
            yield from _send(held, buckets)

    return blocks


def _crowds(crowd: int):
    """Keys with unlike blocks, and their number; key -1 has the number of all blocks, key -2 of all bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_bytes = 0

        def measured() -> Iterator[pa.RecordBatch]:
            nonlocal n_bytes
            for batch in batches:
                n_bytes += int(utf8(batch.column(3))[1][-1])
                yield batch

        row = lambda keys, n: pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (keys, n)], ["key", "n"])
        for held in _batches_of_blocks(measured()):
            key, block = (np.concatenate(x) for x in list(zip(*held))[:2])
            total, many = len(key), repeated(key)
            key, block = key[many], block[many]
            order = np.lexsort((block, key))
            key, block = key[order], block[order]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])])[: len(key)]
            keys, n = np.unique(key[new], return_counts=True)
            large = n >= crowd
            yield row(np.append(keys[large].astype(np.int64), -1), np.append(n[large], total))
        yield row([-2], [n_bytes])

    return count


def crowded_keys(sent: DataFrame, crowd: int, crowded: int) -> tuple[np.ndarray, int]:
    """The keys whose unlike blocks are more than crowded and than a part of all, sorted, and the bytes of all texts."""
    counts = checkpoint(sent.mapInArrow(released(_crowds(crowd)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    totals = {r.key: r.n for r in counts.where("key < 0").collect()}
    least = max(crowded, totals.get(-1, 0) // MOST_CROWDS)
    found = counts.where((F.col("key") >= 0) & (F.col("n") > least)).select("key").collect()  # at most MOST_CROWDS
    return np.sort(np.array([r.key for r in found], np.uint64)), totals.get(-2, 0)


def _gather(batches: Iterator[pa.RecordBatch], kind: int) -> tuple[list[bytes], list[pa.RecordBatch]]:
    """Data of one kind, and the rows of the others."""
    own, others = [], []
    for batch in batches:
        is_own = np.asarray(batch.column(0)) == kind
        own += [x.as_py() for x in batch.column(2).filter(pa.array(is_own))]
        if not is_own.all():
            others.append(batch.filter(pa.array(~is_own)))
    return own, others


def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    datas, others = _gather(batches, BLOCKS)
    yield from others
    parts = [unpack_blocks(d) for d in datas]
    if not parts:
        return
    shared = repeated(np.concatenate([p[0] for p in parts]))
    cut = np.split(shared, np.cumsum([len(p[0]) for p in parts])[:-1])
    key, block, second, rank, tag, chunk, place, size = (np.concatenate(x) for x in zip(*[[a[s] for a in p] for p, s in zip(parts, cut)]))
    del parts
    copies = later_copies(key, block, second, rank)
    if len(copies):
        yield covers(chunk[copies], [a[copies] for a in (rank, tag, place, size)])
    go = np.ones(len(key), bool)
    go[copies] = False
    left = np.flatnonzero(go)
    order = left[np.lexsort((rank[left], block[left], key[left]))]
    if not len(order):
        return
    k, b, r = key[order], block[order], rank[order]
    new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    n = np.diff(np.append(new, len(k)))
    unlike = (np.minimum.reduceat(b, new) != np.maximum.reduceat(b, new)) & (np.minimum.reduceat(r, new) != np.maximum.reduceat(r, new))
    asked = order[np.repeat(unlike, n)]
    if len(asked):
        asked = asked[np.lexsort((place[asked], rank[asked]))]
        yield dealt(WANTS, partial(pack, WANTED), chunk[asked].astype(np.int64), [a[asked] for a in (rank, tag, place, size, key)])


def _by_document(rank, tag):
    """Order by document, and a lookup of a document's range."""
    order = np.lexsort((tag, rank))
    r, t = rank[order], tag[order]
    new = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (t[1:] != t[:-1])])) if len(r) else np.zeros(0, np.int64)
    at = {(int(r[i]), int(t[i])): (i, j) for i, j in zip(new, np.append(new[1:], len(r)))}
    return order, at


def _fetch(buckets: int):
    def fetch(key, docs: pa.Table, wanted: pa.Table) -> pa.Table:
        schema = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("data", pa.binary())])
        rank, tag, place, size, keys = unpack_all(WANTED, wanted.column("data").to_pylist())
        order, ranges = _by_document(rank, tag)
        flat, offsets = utf8(docs.column("_text"))
        seen, picked, at = set(), [], []
        for i, doc in enumerate(zip(docs.column("_rank").to_pylist(), docs.column("_tag").to_pylist())):
            if doc in ranges and doc not in seen:
                seen.add(doc)
                a, b = ranges[doc]
                picked.append(order[a:b])
                at.append(offsets[i] + place[order[a:b]].astype(np.int64))
        if not picked:
            return schema.empty_table()
        pick, at = np.concatenate(picked), np.concatenate(at)
        part = (keys[pick] % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        pick, at, part = pick[by], at[by], part[by]
        new = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        datas = []
        for i, j in zip(new, np.append(new[1:], len(part))):
            p = pick[i:j]
            text = flat[ragged(at[i:j], size[p].astype(np.int64) + LENGTH - 1)].tobytes()
            head = pack((*WANTED, ("u4", 4)), [rank[p], tag[p], place[p], size[p], keys[p], np.full(len(p), key[0].as_py())])
            datas.append(len(head).to_bytes(4, "little") + head + zstandard.ZstdCompressor(level=1).compress(text))
        return pa.Table.from_batches([rows(PASSAGES, part[new], datas)])

    return fetch


class SuffixSorter:
    """Windows of a buffer ordered as strings of LENGTH bytes, within groups that share key and head."""

    def __init__(self, data: np.ndarray):
        self.data, self.hashes = data, Hashes(data)

    def extension(self, x: np.ndarray, y: np.ndarray, known: int) -> np.ndarray:
        """Length of the common extension of two windows, at least known, at most LENGTH."""
        p, inv = self.hashes.prefix, self.hashes.inverse
        px, py, ix, iy = p[x], p[y], inv[x], inv[y]
        low = np.full(len(x), known, np.int64)
        high = np.full(len(x), LENGTH, np.int64)
        for _ in range((LENGTH - known).bit_length()):
            mid = (low + high + 1) >> 1
            same = (p[x + mid] - px) * ix == (p[y + mid] - py) * iy
            low = np.where(same, mid, low)
            high = np.where(same, high, np.maximum(mid - 1, low))
        return low

    def before(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each x sorts before its y, and whether they are equal."""
        n = self.extension(x, y, HEAD)
        equal = n >= LENGTH
        n = np.minimum(n, LENGTH - 1)
        return ~equal & (self.data[x + n] < self.data[y + n]), equal

    def sort(self, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A permutation of windows ``at`` that sorts each of the groups that begin at ``starts``."""
        n = len(at)
        order = np.arange(n)
        ends = np.append(starts[1:], n)
        width = 1
        while True:
            large = ends - starts > width
            if not large.any():
                return order
            a, b = starts[large], ends[large]
            pos = ragged(a, b - a)
            group = np.repeat(np.arange(len(a)), b - a)
            run = (pos - a[group]) // width
            mine = a[group] + run * width
            other = np.where(run % 2 == 0, mine + width, mine - width)
            other_end = np.minimum(other + width, b[group])
            low, high = np.minimum(other, b[group]), np.maximum(other_end, np.minimum(other, b[group]))
            floor = low.copy()
            x, left = at[order[pos]], run % 2 == 0
            live = np.flatnonzero(low < high)
            while len(live):
                mid = (low[live] + high[live]) >> 1
                less, equal = self.before(at[order[mid]], x[live])
                go = less | (equal & ~left[live])  # equal ones of the left run stay in front
                low[live[go]] = mid[go] + 1
                high[live[~go]] = mid[~go]
                live = live[low[live] < high[live]]
            to = np.minimum(mine, other) + (pos - mine) + (low - floor)
            moved = order[pos]
            order[to] = moved
            width *= 2


def equal_runs(data: np.ndarray, at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that are not alone, sorted, and whether each begins a run of equal ones."""
    head = np.zeros(len(at), np.uint64)
    for i in range(HEAD):
        head = (head << np.uint64(8)) | data[at + i]
    order = np.lexsort((head, key))
    k, h = key[order], head[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (h[1:] != h[:-1])])
    n = np.diff(np.append(np.flatnonzero(new), len(k)))
    many = np.repeat(n > 1, n)
    order, n = order[many], n[n > 1]
    if not len(order):
        return order, np.zeros(0, bool)
    starts = np.cumsum(n) - n
    windows = at[order]
    sorter = SuffixSorter(data)
    by = sorter.sort(windows, starts)
    order, windows = order[by], windows[by]
    begins = np.zeros(len(order), bool)
    begins[starts] = True
    pair = np.flatnonzero(~begins)
    alike = sorter.extension(windows[pair - 1], windows[pair], HEAD) >= LENGTH
    begins[pair[~alike]] = True
    step = np.arange(LENGTH)
    doubted = pair[alike]
    for i in range(0, len(doubted), 1 << 15):
        p = doubted[i : i + (1 << 15)]
        if (data[windows[p - 1][:, None] + step] != data[windows[p][:, None] + step]).any():
            # a collision: order this data's windows by their bytes instead
            whole = np.ascontiguousarray(data[windows[:, None] + step]).view(f"V{LENGTH}")[:, 0]
            group = np.repeat(np.arange(len(n)), n)
            _, code = np.unique(whole, return_inverse=True)
            by = np.lexsort((code, group))
            order, code, group = order[by], code[by], group[by]
            return order, np.concatenate([[True], (code[1:] != code[:-1]) | (group[1:] != group[:-1])])
    return order, begins


def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    datas, _ = _gather(batches, PASSAGES)
    heads, texts = [], []
    for d in datas:
        n = int.from_bytes(d[:4], "little")
        heads.append(d[4 : 4 + n])
        texts.append(zstandard.ZstdDecompressor().decompress(d[4 + n :]))
    rank, tag, place, size, key, chunk = unpack_all((*WANTED, ("u4", 4)), heads)
    if not len(rank):
        return
    flat, size = np.frombuffer(b"".join(texts), np.uint8), size.astype(np.int64)
    del texts, datas
    span = size + LENGTH - 1
    start = np.cumsum(span) - span
    order = np.argsort(key, kind="stable")
    done = np.cumsum(span[order])
    at, found = 0, []
    while at < len(order):  # whole keys, some MB at once
        upto = max(at + 1, int(np.searchsorted(done, done[at] - span[order[at]] + SORTED, "right")))
        while upto < len(order) and key[order[upto]] == key[order[upto - 1]]:
            upto += 1
        p = order[at:upto]
        at = upto
        which, first, count = repeated_windows(flat[ragged(start[p], span[p])], size[p], key[p], rank[p])
        if len(which):
            p = p[which]
            found.append((chunk[p], rank[p], tag[p], place[p] + first, count))
    if found:
        part, *arrays = (np.concatenate(x) for x in zip(*found))
        yield covers(part, arrays)


def repeated_windows(data: np.ndarray, size: np.ndarray, key: np.ndarray, rank: np.ndarray):
    """Passage, first window and windows of each run that a smaller rank's passage holds too."""
    span = size + LENGTH - 1
    windows = ragged(np.cumsum(span) - span, size)
    passage = np.repeat(np.arange(len(size)), size)
    order, begins = equal_runs(data, windows, key[passage])
    none = np.zeros(0, np.int64)
    if not len(order):
        return none, none, none
    r = rank[passage[order]]
    least = np.minimum.reduceat(r, np.flatnonzero(begins))[np.cumsum(begins) - 1]
    hit = np.sort(order[r > least])
    if not len(hit):
        return none, none, none
    new = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (passage[hit[1:]] != passage[hit[:-1]])])
    first = hit[new]
    which = passage[first]
    return which, first - (np.cumsum(size) - size)[which], np.diff(np.append(np.flatnonzero(new), len(hit)))


def removed_spans(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes under ranges of windows."""
    if not len(first):
        return first, first
    order = np.argsort(first, kind="stable")
    a, b = first[order], first[order] + count[order] - 1 + LENGTH
    reach = np.maximum.accumulate(b)
    new = np.concatenate([[True], a[1:] > reach[:-1]])
    last = np.append(np.flatnonzero(new)[1:], len(a)) - 1
    return a[new], reach[last]


def whole_characters(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of UTF-8 widened to the characters that they touch; those that then meet stay apart."""
    if not len(a):
        return a, b
    at = np.append(np.flatnonzero((text & 0xC0) != 0x80), len(text))  # where characters begin
    return at[np.searchsorted(at, a, "right") - 1], at[np.searchsorted(at, b, "left")]


def _cut(names: list[str], as_text: bool = False):
    def cut(key, docs: pa.Table, covers: pa.Table) -> pa.Table:
        rank, tag, first, count = unpack_all(COVER, covers.column("data").to_pylist())
        order, ranges = _by_document(rank, tag)
        first, count = first[order].astype(np.int64), count[order].astype(np.int64)
        flat, offsets = utf8(docs.column("_text"))
        n_bytes, n_removed, spans_a, spans_b, kept = np.diff(offsets), [], [], [], []
        for i, doc in enumerate(zip(docs.column("_rank").to_pylist(), docs.column("_tag").to_pylist())):
            text = flat[offsets[i] : offsets[i + 1]]
            i, j = ranges.get(doc, (0, 0))
            a, b = removed_spans(first[i:j], count[i:j])
            if len(a):
                keep = np.ones(len(text), bool)
                wide_a, wide_b = whole_characters(text, a, b) if as_text else (a, b)
                keep[ragged(wide_a, wide_b - wide_a)] = False
                text = text[keep]
            n_removed.append(int((b - a).sum()))
            spans_a.append(a)
            spans_b.append(b)
            kept.append(text.tobytes())
        lists = np.concatenate([[0], np.cumsum([len(a) for a in spans_a])])
        ab = pa.StructArray.from_arrays([pa.array(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64)) for x in (spans_a, spans_b)], ["start", "end"])
        return pa.table(
            [docs.column(c) for c in names]
            + [pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.ListArray.from_arrays(pa.array(lists, pa.int32()), ab), pa.array(kept, pa.binary()).cast(pa.string() if as_text else pa.binary())],
            [*names, "n_bytes", "n_removed", "spans", "kept"],
        )

    return cut


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, as_text: bool = False,
    crowd: int = CROWD, crowded: int = CROWDED,
) -> DataFrame:
    """The id column and those to carry, ``n_bytes``, ``n_removed``, ``spans`` and ``kept``.

    kept holds the bytes of a text that no LENGTH-byte string of a document with a
    smaller id covers, spans the maximal runs that went, as byte offsets. Matches never
    cross documents and are judged on the input. With as_text kept is a string, without
    the characters of which a part went. A null text is empty; texts shorter
    than LENGTH bytes keep everything. Rows that repeat an id are documents of equal
    rank: they never remove each other. A null id ranks after all others. An empty
    table gives an empty result; columns are carried only by name, and those by the name
    of a result give way to it.
    """
    carried = [c for c in carry or [] if c != id_col and c.lower() not in ("n_bytes", "n_removed", "spans", "kept")]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rank, tag = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), F.shiftrightunsigned(F.xxhash64(text), 16)
    crowds, n_bytes = crowded_keys(docs.select(rank.alias("_rank"), tag.alias("_tag"), F.lit(0).alias("_chunk"), text.alias("_text")), crowd, crowded)
    buckets = max(partitions(docs.sparkSession), -(-n_bytes // PART))
    prepared = docs.select(
        F.col(id_col).alias(id_col),
        *carried,
        rank.alias("_rank"),
        tag.alias("_tag"),
        F.pmod(F.xxhash64(F.col(id_col), text), F.lit(2 * buckets)).cast("int").alias("_chunk"),
        text.alias("_text"),
    )
    sent = prepared.select("_rank", "_tag", "_chunk", "_text").mapInArrow(released(_blocks(buckets, crowds)), ROW)
    matched = checkpoint(sent.repartitionById(buckets, F.pmod("part", F.lit(buckets)).cast("int")).mapInArrow(released(match), ROW))
    by_chunk = prepared.groupBy("_chunk")
    of_chunk = lambda df, kind: df.where(F.col("kind") == kind).select(F.col("part").alias("_chunk"), "data").groupBy("_chunk")
    passages = by_chunk.cogroup(of_chunk(matched, WANTS)).applyInArrow(released_groups(_fetch(buckets)), ROW)
    resolved = passages.repartitionById(buckets, F.col("part")).mapInArrow(released(resolve), ROW)
    names = [id_col, *carried]
    out = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return by_chunk.cogroup(of_chunk(matched.union(resolved), COVERS)).applyInArrow(
        released_groups(_cut(names, as_text)), f"{out}, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept {'string' if as_text else 'binary'}"
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns of docs; texts without their repeats, a null one empty, and their lengths anew.

    A text that repeats from end to end stays as an empty one.
    """
    whole = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(*docs.columns).dropFields(text_col).alias("row"))
    done = remove_repeats(whole, "id", "text", ["row"], as_text=True)
    new = {text_col: F.col("kept"), length_col: F.length("kept").cast("long")}
    return done.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
ORACLE: dict[str, str] = {}
