"""SimHash near-duplicates: exact Hamming links from vantage-point trees.

Fingerprints that differ in at most r bits agree on some b - r of b blocks, so the
distinct fingerprints are dealt into shards by the first bits of those blocks. Planting
the trees in shards rather than in the whole space keeps boundaries thin: for random
64-bit fingerprints a ball of radius 4 crosses most median boundaries. Within a shard
fingerprints are split by their distance to a vantage point; by the triangle bound a
query within r of the boundary visits both sides, any other only its own, down to
leaves that are compared bit by bit. A shard gives back a spanning forest of its links,
not its pairs, and components join the forests.

Removing near copies (``keep_first``) asks for more than these links: sets of five-word
shingles of similarity 0.8 differ in a seventh of all bits, a radius at which neither
blocks that must agree nor triangle bounds leave anything out. There fingerprints have
128 bits and are dealt into shards by bits drawn at random, as often as it takes to
meet; the nearest earlier ones are looked for and the shingles of both texts decide. That
finds most near copies at a few comparisons each. Those that are left meet all earlier texts
by the rarest of their shingles, of which two sets of the similarity share some for
certain, so none is missed. Where whole groups are asked for, all texts meet in this way
but those that are known to be of one group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.columns import comparable, field, fresh, released
from docketry.llm.graph import components
from docketry.llm.sampling import sized
from docketry.runtime import checkpoint, partitions, table

WORDS, SEED, RADIUS = 4, 42, 4
#: Fingerprints a shard should hold, pairs compared at once in a leaf, pairs held.
SHARD, LEAF_PAIRS, PAIRS = 512, 1 << 14, 1 << 21
#: Removal of near copies: words of a shingle and least similarity of two sets of them.
SHINGLE, SIMILARITY = 5, 0.8
#: Bits of 128 within which a pair is checked (19 are expected at the similarity) and
#: within which a text is no leader; chance to meet in no shard; rows compared at once.
APART, CLOSE, MISSED, BLOCK = 27, 12, 0.01, 512
#: Bits of a set's parities, by which pairs that meet are sifted before their texts are read.
PARITIES = 1024
#: Nearest earlier leaders, of as many shards, with which a text is compared before it meets all.
NEAREST = 8
#: Texts whose shingles tell which are common, and common shingles that are known: they bear on speed alone.
SAMPLE, COMMON = 20_000, 1 << 17
#: Shingles and characters of texts whose sets a task keeps while it compares pairs.
HELD = 1 << 22
#: Links a file, and files at least, of the tables by which groups are joined.
LINKS, FILES = 1 << 16, 12


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """The runs of ``size`` words, repeats included, space-joined; of fewer words, all of them."""
    joined = b" ".join(words)
    if len(words) <= size:
        return [joined]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - size] + 1).tolist()]
    return [joined[a:b] for a, b in zip(starts, ends[size - 1 :].tolist())]


def majority(hashes: np.ndarray) -> bytes:
    """For each bit whether over half the rows of bytes have it, packed."""
    ones = np.zeros(8 * hashes.shape[1], np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)], axis=1).sum(0, dtype=np.int32)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def fingerprint(text: bytes) -> bytes:
    """Eight bytes, the highest bit first; zero for a text without words."""
    words = text.lower().split()
    if not words:
        return bytes(8)
    return majority(np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles(words, WORDS), repeat(SEED))), np.uint8).reshape(-1, 8))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tag: Column | None = None) -> DataFrame:
    """The id column, ``fp``, the fingerprint as a signed long, and ``tag``, a hash of the row."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = b"".join(fingerprint((t.as_py() or "").encode()) for t in batch.column(1))
            fp = np.frombuffer(raw, ">u8").astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), batch.column(2)], ["id", "fp", "tag"])

    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.lit(0) if tag is None else tag).cast("long").alias("tag"))
        .mapInArrow(released(apply), f"{field(docs.schema, id_col, 'id')}, fp long, tag long")
        .withColumnRenamed("id", id_col)
    )


def shard_keys(n: int, radius: int = RADIUS) -> list[list[tuple[int, int]]]:
    """For each way to keep some blocks: the (shift, bits) pieces that make its shard.

    The more fingerprints, the more blocks; pieces are cut so that a shard of n
    random fingerprints would hold SHARD.
    """
    want = max(0, int(np.log2(max(1, n) / SHARD)))
    blocks = radius + 1
    while blocks < 12 and 64 * (blocks - radius) // blocks < want:
        blocks += 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for kept in combinations(range(blocks), blocks - radius):
        left, pieces = want, []
        for b in kept:
            size = min(left, edges[b + 1] - edges[b])
            if size:
                pieces.append((edges[b], size))
            left -= size
        keys.append(pieces)
    return keys


def merge_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels, each a smallest index of its set, after joining the sets of each pair."""
    while True:
        a, b = labels[i], labels[j]
        differ = a != b
        if not differ.any():
            return labels
        np.minimum.at(labels, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while True:
            above = labels[labels]
            if (above == labels).all():
                break
            labels = above


def vantage_pairs(fps: np.ndarray, homes: np.ndarray, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (home, query) of fingerprints within radius, leaf by leaf."""
    todo = [(homes, queries)]
    while todo:
        homes, queries = todo.pop()
        if not len(homes) or not len(queries):
            continue
        if len(homes) * len(queries) > LEAF_PAIRS and len(homes) > 8:
            vantage = fps[homes[len(homes) // 2]]
            dh, dq = np.bitwise_count(fps[homes] ^ vantage), np.bitwise_count(fps[queries] ^ vantage)
            cut = int(np.median(dh))
            inside = dh <= cut
            if not inside.all():
                todo.append((homes[inside], queries[dq.astype(np.int16) <= cut + radius]))
                todo.append((homes[~inside], queries[dq.astype(np.int16) > cut - radius]))
                continue
        step = max(1, (8 * LEAF_PAIRS) // len(queries))
        for at in range(0, len(homes), step):
            h = homes[at : at + step]
            i, j = np.nonzero(np.bitwise_count(fps[h][:, None] ^ fps[queries][None]) <= radius)
            keep = h[i] < queries[j]
            if keep.any():
                yield h[i[keep]], queries[j[keep]]


def forest(shard: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the shards' pairs join: each fingerprint to the first of its set."""
    order = np.argsort(shard, kind="stable")
    fps, shard = fps[order], shard[order]
    starts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(0, np.int64)
    labels, held, n = np.arange(len(fps)), [], 0
    for a, b in zip(starts, np.append(starts[1:], len(fps))):
        if b - a > 1:
            members = np.arange(a, b)
            for pair in vantage_pairs(fps, members, members, radius):
                held.append(pair)
                n += len(pair[0])
                if n > PAIRS:
                    labels, held, n = merge_labels(labels, *map(np.concatenate, zip(*held))), [], 0
    if held:
        labels = merge_labels(labels, *map(np.concatenate, zip(*held)))
    linked = np.flatnonzero(labels != np.arange(len(labels)))
    return fps[linked], fps[labels[linked]]


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``u``, ``v`` that join all distinct ``fp`` of nodes within radius of each other."""
    keys = []
    for k, pieces in enumerate(shard_keys(nodes.count(), radius)):
        parts = [F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << size) - 1)) for at, size in pieces]
        keys.append(F.xxhash64(F.lit(k), *parts))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches]
        if got:
            u, v = forest(np.concatenate([s for s, _ in got]), np.concatenate([f for _, f in got]).view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return (
        nodes.select(F.explode(F.array(*keys)).alias("shard"), "fp")
        .repartition(partitions(nodes.sparkSession), "shard")
        .mapInArrow(link, "u long, v long")
    )


def linked_nodes(rows: DataFrame, id_col: str, radius: int) -> tuple[DataFrame, DataFrame]:
    """The distinct fp of rows with their ``first`` id, and node and root of those that have links."""
    nodes = checkpoint(rows.groupBy("fp").agg(F.min(id_col).alias("first")))
    return nodes, components(fingerprint_links(nodes, radius))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The id column, ``fingerprint`` and ``component_id``, the smallest id reachable by links.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows
    have one result each; a null id never names a component unless all its members' are
    null. An empty table gives an empty result; further columns are not carried, so
    their names cannot clash.
    """
    rows = checkpoint(fingerprints(docs, id_col, text_col))
    nodes, roots = linked_nodes(rows, id_col, radius)
    members = roots.join(nodes, roots.node == nodes.fp).select("fp", "root", "first")
    lowest = members.groupBy("root").agg(F.min("first").alias("lowest"))
    linked = members.join(lowest, "root").select("fp", "lowest")
    component = checkpoint(nodes.join(linked, "fp", "left").select("fp", F.coalesce("lowest", "first").alias("component_id")))
    return rows.join(component, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_set(words: list[bytes], size: int) -> np.ndarray:
    """The distinct shingles as sorted 64-bit hashes; none for no words."""
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles(words, size), repeat(SEED))), ">u8").astype(np.uint64))


def parities(own: np.ndarray) -> bytes:
    """For each of PARITIES classes of shingles whether a set has an odd number of them, packed.

    Every class in which two sets differ holds a shingle that only one of them has, so they
    have at least as many of these as there are bits in which their parities differ.
    """
    return np.packbits(np.bincount((own % PARITIES).astype(np.int64), minlength=PARITIES) & 1).tobytes()


def sketch(text: bytes, size: int) -> bytes:
    """32 bytes: a hash of the words, which tells texts apart, and a fingerprint of 128 bits of the set of shingles; 8 of its size and its parities."""
    words = text.lower().split()
    first = shingle_set(words, size)
    second = (first ^ first >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)
    second ^= second >> np.uint64(32)
    long = majority(np.stack([first, second], 1).view(np.uint8).reshape(-1, 16))
    return xxhash.xxh3_128_digest(b" ".join(words)) + long + np.int64(len(first)).tobytes() + parities(first)


def sketches(docs: DataFrame, id_col: str, text_col: str, tag: Column, size: int) -> DataFrame:
    """``id``, ``tag``, the hash of the words ``c0``, ``c1``, the long fingerprint ``f0``, ``f1``, and of the set of shingles ``size`` and ``odd``, its parities."""
    wide = PARITIES // 64

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            longs = np.frombuffer(b"".join(sketch((t.as_py() or "").encode(), size) for t in batch.column(1)), np.int64).reshape(-1, 5 + wide)
            columns = [batch.column(0), batch.column(2), *(pa.array(np.ascontiguousarray(longs[:, k])) for k in range(5))]
            odd = pa.ListArray.from_arrays(pa.array(np.arange(0, wide * len(longs) + 1, wide, dtype=np.int32)), pa.array(longs[:, 5:].ravel()))
            yield pa.RecordBatch.from_arrays([*columns, odd], ["id", "tag", "c0", "c1", "f0", "f1", "size", "odd"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), tag.alias("tag")).mapInArrow(
        released(apply), f"{field(docs.schema, id_col, 'id')}, tag long, c0 long, c1 long, f0 long, f1 long, size long, odd array<long>"
    )


def bit_masks(n: int, similarity: float) -> list[tuple[int, int]]:
    """For each way to deal n long fingerprints into shards of about SHARD: masks of the bits that name the shard.

    A bit of two sets of one size and Jaccard similarity s differs with probability
    acos(2s / (1 + s)) / pi. There are as many ways, each with bits drawn anew, as it
    takes to deal two such sets into no common shard with probability MISSED at most.
    """
    want = min(60, max(0, int(np.ceil(np.log2(max(1, n) / SHARD)))))
    agree = (1 - np.arccos(min(1.0, 2 * similarity / (1 + similarity))) / np.pi) ** want
    rng = np.random.default_rng(SEED)
    masks = []
    for _ in range(int(np.ceil(np.log(MISSED) / np.log1p(-agree))) if agree < 1 else 1):
        bits = rng.choice(128, want, replace=False).tolist()
        both = np.array([sum(1 << b for b in bits if b < 64), sum(1 << b - 64 for b in bits if b >= 64)], np.uint64).view(np.int64)
        masks.append((int(both[0]), int(both[1])))
    return masks


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The bits in which each fingerprint of x differs from each of y."""
    return np.bitwise_count(x[:, None, 0] ^ y[None, :, 0]) + np.bitwise_count(x[:, None, 1] ^ y[None, :, 1])


class Leaders:
    """The leaders of one shard, which rows join in order: a row is one unless an earlier one is within CLOSE."""

    def __init__(self) -> None:
        self.no, self.fps = np.zeros(0, np.int64), np.zeros((0, 2), np.uint64)

    def join(self, no: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the nearest leader before it, the first of equals, and how far off it is (255: none)."""
        best, before = np.full(len(no), 255, np.uint8), np.zeros(len(no), np.int64)

        def improve(d: np.ndarray, of: np.ndarray) -> None:
            at = d.argmin(1)
            low = d[np.arange(len(d)), at]
            nearer = low < best
            best[nearer], before[nearer] = low[nearer], of[at[nearer]]

        for at in range(0, len(self.no), BLOCK):
            improve(apart(fps, self.fps[at : at + BLOCK]), self.no[at : at + BLOCK])
        d = apart(fps, fps)
        d[np.triu_indices(len(d))] = 255
        close, leads = d <= CLOSE, best > CLOSE
        for i in np.flatnonzero(close.any(1) & leads):
            leads[i] = not (close[i] & leads).any()
        d[:, ~leads] = 255
        improve(d, no)
        self.no, self.fps = np.concatenate([self.no, no[leads]]), np.concatenate([self.fps, fps[leads]])
        return best, before


def nearest_earlier(texts: DataFrame, n: int, similarity: float) -> DataFrame:
    """``no`` and ``nearest``: for rows of texts (``no``, ``f0``, ``f1``) the nearest leaders before them within APART bits, NEAREST at most and a shard's nearest only.

    A shard is read in order and in blocks; only its leaders are held, so a large group
    of close copies costs one comparison a row.
    """
    keys = [F.xxhash64(F.lit(k), F.col("f0").bitwiseAND(F.lit(a)), F.col("f1").bitwiseAND(F.lit(b))) for k, (a, b) in enumerate(bit_masks(n, similarity))]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, leaders = None, Leaders()
        for batch in batches:
            s, no = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            fps = np.stack([np.asarray(batch.column(2)), np.asarray(batch.column(3))], 1).view(np.uint64)
            cuts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])).tolist() if len(s) else []
            found = []
            for a, b in zip(cuts, [*cuts[1:], len(s)]):
                if s[a] != shard:
                    shard, leaders = s[a], Leaders()
                for at in range(a, b, BLOCK):
                    rows = slice(at, min(b, at + BLOCK))
                    best, before = leaders.join(no[rows], fps[rows])
                    near = best <= APART
                    if near.any():
                        found.append((no[rows][near], before[near], best[near]))
            if found:
                x, y, d = map(np.concatenate, zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(d.astype(np.int32))], ["no", "before", "d"])

    return (
        texts.select(F.explode(F.array(*keys)).alias("shard"), "no", "f0", "f1")
        .repartition(partitions(texts.sparkSession), "shard")
        .sortWithinPartitions("shard", "no")
        .mapInArrow(released(scan), "no long, before long, d int")
        .groupBy("no")
        .agg(F.slice(F.array_sort(F.collect_set(F.struct("d", "before"))), 1, NEAREST).getField("before").alias("nearest"))
    )


def similar(pairs: DataFrame, size: int, similarity: float) -> DataFrame:
    """``no`` and ``before`` of those pairs (also ``text``, ``other``) whose sets of shingles have the Jaccard similarity."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[str, np.ndarray] = {}
        room = HELD

        def of(text: str) -> np.ndarray:
            nonlocal room
            found = sets.get(text)
            if found is None:
                found = shingle_set(text.encode().lower().split(), size)
                room -= len(found) + len(text)
                if room < 0:
                    sets.clear()
                    room = HELD
                sets[text] = found
            return found

        for batch in batches:
            keep = []
            for text, other in zip(batch.column(1), batch.column(2)):
                own, held = of(text.as_py() or ""), of(other.as_py() or "")
                both = len(np.intersect1d(own, held, assume_unique=True))
                keep.append(both >= similarity * (len(own) + len(held) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 3)], ["no", "before"])

    return pairs.select("no", "text", "other", "before").mapInArrow(released(check), "no long, before long")


def common_shingles(texts: DataFrame, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that most of about SAMPLE texts share, sorted, and how many of these texts have each."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set((t.as_py() or "").encode().lower().split(), size) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], ["shingle"])

    drawn = texts.where(F.pmod(F.xxhash64("tag"), F.lit(max(1, n // SAMPLE))) == 0).select("text")
    often = drawn.mapInArrow(released(sets), "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 2")
    rows = often.orderBy(F.desc("n"), "shingle").limit(COMMON).toArrow()
    shingle, count = (np.asarray(rows.column(c), np.int64) for c in ("shingle", "n"))
    order = np.argsort(shingle.view(np.uint64))
    return shingle.view(np.uint64)[order], count[order]


def rarest(own: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first shingles of a sorted set in an order all sets share, rare ones first: so many that a set of the similarity has one among its own."""
    often = np.zeros(len(own), np.int64)
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], own), len(common[0]) - 1)
        often = np.where(common[0][at] == own, common[1][at], 0)
    return own[np.argsort(often, kind="stable")[: len(own) - _least(similarity * len(own)) + 1]]


def _least(share: float) -> int:
    """The least whole number that is a share or more, where rounding may not lose one."""
    return int(np.ceil(share - 1e-6))


def rare_shingles(docs: DataFrame, n: int, size: int, similarity: float) -> DataFrame:
    """Of docs (``id``, ``tag``, ``text``) the two first columns, ``size``, the number of shingles, and ``rare``, the first of them by ``rarest``."""
    common = common_shingles(docs, n, size)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                sets = [shingle_set((t.as_py() or "").encode().lower().split(), size) for t in part.column(2)]
                first = [rarest(own, common, similarity) if len(own) else own for own in sets]
                ends = np.cumsum([0, *map(len, first)]).astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(first).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.fromiter(map(len, sets), np.int32, len(sets))), rare], ["id", "tag", "size", "rare"])

    return docs.select("id", "tag", "text").mapInArrow(released(lists), f"{field(docs.schema, 'id', 'id')}, tag long, size int, rare array<long>")


def meeting(texts: DataFrame, similarity: float) -> DataFrame:
    """``no`` and ``before``: of texts (``no``, ``probe``, ``size``, ``rare``) the pairs of a probe and an earlier text that may have the similarity.

    Sets of a and b shingles of the similarity share o = s / (1 + s) * (a + b) or more, so one
    of them is among the first a - o + 1 of the one and the first b - o + 1 of the other. Of two
    sets the smaller, of b, needs its first (1 - s) / (1 + s) * b alone: what a family of texts not
    quite as alike as asked has in common is mostly behind these. No pair of the similarity is left out,
    but for pairs of one ``group``, where texts have this column.
    """
    least = lambda share: F.ceil(share - 1e-6)
    shared = lambda sizes: least(sizes * (similarity / (1 + similarity)))
    # a number tells by its sign whether its text is a probe
    signed = F.when(F.col("probe"), F.col("no")).otherwise(-1 - F.col("no"))
    group = [c for c in texts.columns if c == "group"]
    entries = texts.select(F.posexplode("rare").alias("at", "shingle"), signed.alias("no"), "size", *group)
    small = entries.where(F.col("at") <= F.col("size") - shared(F.col("size") * 2)).toDF("at_", "shingle_", "no_", "b", *(f"{c}_" for c in group))
    number = lambda c: F.greatest(F.col(c), -1 - F.col(c))
    later = (number("no_") < F.col("no")) | (number("no") < F.col("no_"))
    order = (F.col("b") < F.col("a")) | ((F.col("b") == F.col("a")) & (number("no_") < number("no")))
    alike = F.col("b") >= F.col("a") * similarity - 1e-6
    both = shared(F.col("a") + F.col("b"))
    first = (F.col("at") <= F.col("a") - both) & (F.col("at_") <= F.col("b") - both)
    fits = later & order & alike & first
    for c in group:
        fits = fits & (F.col(c) != F.col(f"{c}_"))
    met = entries.withColumnRenamed("size", "a").join(small, (F.col("shingle") == F.col("shingle_")) & fits)
    return met.select(F.greatest(number("no"), number("no_")).alias("no"), F.least(number("no"), number("no_")).alias("before")).distinct()


def sifted(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (``no``, ``before``) of texts (``no``, ``size``, ``odd``) that may have the similarity by their parities; none that has it is left out.

    Sets of a and b shingles of similarity s differ in (1 - s) / (1 + s) * (a + b) shingles at most.
    """
    side = lambda no, n: texts.select(F.col("no").alias(no), F.col("size").alias(f"size{n}"), F.col("odd").alias(f"odd{n}"))
    bits = F.zip_with("odd0", "odd1", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    apart = F.aggregate(bits, F.lit(0), lambda total, n: total + n)
    both = pairs.join(side("no", 0), "no").join(side("before", 1), "before")
    return both.where(apart <= (F.col("size0") + F.col("size1")) * ((1 - similarity) / (1 + similarity)) + 1e-6).select("no", "before")


def keep_first(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, similarity: float = SIMILARITY, groups: bool = False
) -> DataFrame:
    """One row of docs of each group of near-duplicates, with all its columns: that of the smallest id.

    Texts are compared as words, split and lower-cased as for the fingerprint. Of texts
    of the same words the first stays. Of the others, a text goes if its set of shingles
    of ``words`` words has Jaccard ``similarity`` or more with that of any earlier text,
    whether that stays or not. With ``groups`` it also goes if later texts link it to an
    earlier one, over any number of them: of each connected group one stays. Most links are
    found by the nearest long fingerprint, the rest by the rarest shingles, which leave none
    out that changes the result. Null and empty texts are alike. A null
    id counts as larger than any other. Of several rows of one id, those come first
    whose hash is smaller; of repeated rows one stays. Maps in other columns are compared
    by their entries, in any order. An empty table stays empty.
    """
    whole = {f.name: comparable(F.col(f"`{f.name}`"), f.dataType) for f in docs.schema.fields}
    tag = F.xxhash64(*whole.values())
    rows = checkpoint(sketches(docs, id_col, text_col, tag, words))
    if not rows.groupBy("id", "tag").count().where("count > 1").isEmpty():
        row = fresh(docs.columns, "_row")
        docs = docs.withColumn(row, F.struct(*[v.alias(k) for k, v in whole.items()])).dropDuplicates([row]).drop(row)
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "tag")
    # rows of the same words have the same set of shingles
    first = rows.groupBy("c0", "c1", "f0", "f1").agg(F.min(order).alias("first"), F.first("size").alias("size"), F.first("odd").alias("odd")).orderBy("first")
    texts = checkpoint(first.select(F.monotonically_increasing_id().alias("no"), "f0", "f1", "first.id", "first.tag", "size", "odd"))
    n = texts.count()
    links = checkpoint(nearest_earlier(texts.select("no", "f0", "f1"), n, similarity))

    own_id, own_tag, no = (fresh(docs.columns, c) for c in ("_id", "_tag", "_no"))
    named = texts.select(F.col("no").alias(no), F.col("id").alias(own_id), F.col("tag").alias(own_tag))
    same = F.col(id_col).eqNullSafe(F.col(own_id)) & (tag == F.col(own_tag))

    def of(numbers: DataFrame) -> DataFrame:
        return docs.join(sized(named.join(numbers, no, "left_semi")), same).select(F.col(no).alias("no"), F.col(text_col).alias("text"))

    def joined(pairs: DataFrame) -> DataFrame:
        return components(pairs.toDF("u", "v"), max(FILES, pairs.count() // LINKS))

    def confirmed(pairs: DataFrame) -> DataFrame:
        own = of(pairs.select(F.col("no").alias(no)).distinct()).join(sized(pairs), "no")
        other = of(pairs.select(F.col("before").alias(no)).distinct()).select(F.col("no").alias("before"), F.col("text").alias("other"))
        return checkpoint(similar(own.join(other, "before"), words, similarity).distinct())

    near = confirmed(links.select("no", F.get("nearest", 0).alias("before")))
    # in a family of texts about as alike as asked, most have a fellow among a few; asked of all, they would meet by the square
    further = links.where(F.size("nearest") > 1).join(near, "no", "left_anti")
    near = near.union(confirmed(checkpoint(further.select("no", F.explode(F.slice("nearest", 2, NEAREST)).alias("before")))))
    if groups:
        # texts of one group need not meet
        near = joined(near).toDF("no", "before")
        known, default = near.select(F.col("no").alias(no), F.lit(True).alias("probe"), F.col("before").alias("group")), {"probe": F.lit(True), "group": F.col(no)}
    else:
        known, default = near.select(F.col("no").alias(no), F.lit(False).alias("probe")).distinct(), {"probe": F.lit(True)}
    asked = sized(named.join(known, no, "left").withColumns({c: F.coalesce(c, value) for c, value in default.items()}))
    lists = rare_shingles(docs.select(F.col(id_col).alias("id"), tag.alias("tag"), F.col(text_col).alias("text")), n, words, similarity)
    listed = lists.join(asked, F.col("id").eqNullSafe(F.col(own_id)) & (F.col("tag") == F.col(own_tag))).select(F.col(no).alias("no"), *default, "size", "rare")
    # members of a family not quite as alike as asked meet often; few of their texts need to be read
    found = near.union(confirmed(checkpoint(sifted(checkpoint(meeting(listed, similarity)), texts, similarity))))
    gone = joined(found).where("node != root").select(F.col("node").alias("no")) if groups else found.select("no")
    stay = named.join(gone.select(F.col("no").alias(no)), no, "left_anti").drop(no)
    keys = rows.select(F.col("id").alias("left_id"), F.col("tag").alias("left_tag")).distinct()
    left = keys.join(stay, F.col("left_id").eqNullSafe(F.col(own_id)) & (F.col("left_tag") == F.col(own_tag)), "left_anti")
    return docs.join(sized(left.toDF(own_id, own_tag)), same, "left_anti")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op3_simhash": op3_simhash}
ORACLE: dict[str, str] = {}
