"""The hit-anchored rate limit, spread over all tasks however the hits are shared among keys.

A key's first hit opens a window; the first hit after its end opens the next. Hits are
sorted by range over (key, time), so a hot key lies in many tasks. Where a key goes on
from one task to the next, the later task has to know which window is open:

* In every such task each hit points to the next opener, and pointers are doubled inside
  the task until they end at the last opener the hit leads to, an exit.
* Exits and the hits they may open are sorted together by time; the hit that follows an
  exit's end leads to that task's own exit. So exits point to exits, of which a key has
  few reached in each task.
* Pointers between exits are doubled from each key's first exit on, in as many rounds as
  the logarithm of the number of tasks, and tell for every task the window that is open.

With that, every task folds its hits in streamed batches. What goes through the driver is
a few numbers for each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.runtime import checkpoint, fresh, partitions

_MICROS = 1_000_000
_PART_BITS = 33  # monotonically_increasing_id has the partition above these bits


class Bucket:
    """A hit-anchored window of one key: the first hit opens it, later ones count until it is over."""

    def __init__(self, opened: int | None = None, hits: int = 0):
        self.opened, self.hits = opened, hits

    def hit(self, at: int, limit: int, window: int) -> tuple[bool, int, int]:
        """allowed, remaining and seconds to wait, for a hit at a time in microseconds."""
        if self.opened is None or at - self.opened > window * _MICROS:
            self.opened, self.hits = at, 0
        self.hits += 1
        if self.hits <= limit:
            return True, limit - self.hits, 0
        return False, 0, max(1, -(-(window * _MICROS - (at - self.opened)) // _MICROS))


def next_openers(micros: np.ndarray, segment: np.ndarray, window: int) -> np.ndarray:
    """For each hit the first of its segment that is more than window behind it, len(micros) if there is none.

    Segments are numbered upwards and sorted by time inside. As many of them are searched at once as 64 bits can order.
    """
    n = len(micros)
    if not n:
        return np.zeros(0, np.int64)
    low = int(micros.min())
    span = int(micros.max()) - low + window + 2
    at_once = max(1, (1 << 62) // span)
    cuts = np.searchsorted(segment, np.arange(segment[0], segment[-1] + at_once + 1, at_once)) if segment[-1] - segment[0] >= at_once else np.array([0, n])
    out = np.empty(n, np.int64)
    for a, b in zip(cuts[:-1], cuts[1:]):
        line = (segment[a:b] - segment[a]) * span + (micros[a:b] - low) if b > a else np.zeros(0, np.int64)
        out[a:b] = a + np.searchsorted(line, line + window, "right")
    inside = out < n
    inside[inside] = segment[out[inside]] == segment[inside]
    return np.where(inside, out, n)


def reached(following: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which places are reached from the starts by following pointers; len(following) is the end."""
    n = len(following)
    seen, jump = np.zeros(n + 1, bool), np.append(following, n)
    seen[starts] = True
    while (jump[:n] < n).any():
        seen[jump[np.flatnonzero(seen)]] = True
        jump = jump[jump]
    return seen[:n]


def ends_of(following: np.ndarray) -> np.ndarray:
    """For each place the last that following pointers leads to."""
    n = len(following)
    jump = np.where(following < n, following, np.arange(n))
    while True:
        again = jump[jump]
        if (again == jump).all():
            return jump
        jump = again


def _fold(micros: np.ndarray, changes: np.ndarray, open_: tuple[int, int] | None, limit: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[int, int]]:
    """allowed, remaining and seconds to wait of sorted hits, and the window open at the end.

    ``changes`` tells where a key begins. The first hits go on with ``open_``, the opening time and the hits
    so far, unless a key begins with them.
    """
    n, places = len(micros), np.arange(len(micros))
    segment = np.cumsum(changes)
    starts = np.flatnonzero(changes)
    if not changes[0]:
        first = starts[0] if len(starts) else n
        held = int(np.searchsorted(micros[:first], open_[0] + window * _MICROS, "right"))
        starts = np.append(starts, held) if held < first else starts
    opens = reached(next_openers(micros, segment, window * _MICROS), starts)
    by = np.maximum.accumulate(np.where(opens, places, -1))
    since = np.where(by < 0, open_[0] if open_ else 0, micros[by])
    hits = np.where(by < 0, (open_[1] if open_ else 0) + places + 1, places - by + 1)
    allowed = hits <= limit
    wait = np.maximum(1, -(-(window * _MICROS - (micros - since)) // _MICROS))
    return allowed, np.where(allowed, limit - hits, 0), np.where(allowed, 0, wait), (int(since[-1]), int(hits[-1]))


def _begins(keys: pa.Array, before: str | None) -> np.ndarray:
    """Where a key begins in a sorted column without nulls that follows on ``before``."""
    changes = np.ones(len(keys), bool)
    if len(keys) > 1:
        changes[1:] = np.asarray(pc.not_equal(keys[1:], keys[:-1]))
    changes[0] = keys[0].as_py() != before
    return changes


def _spanning(ends: list) -> tuple[set[int], set[int], dict[int, int]]:
    """Of the tasks' (part, n, first, last) in order: those whose first key, and whose last key, goes over a border, and how many hits there are before each."""
    into, out, before, total = set(), set(), {}, 0
    for i, e in enumerate(ends):
        before[e["part"]] = total
        total += e["n"]
        if i and ends[i - 1]["last"] == e["first"]:
            into.add(e["part"])
            out.add(ends[i - 1]["part"])
    return into, out, before


def _exits(hits: DataFrame, into: set[int], out: set[int], window: int) -> DataFrame:
    """(key, t, probe, pos, exit, exit_t, start): hits that an exit may open, at their times, and exits, at their windows' ends.

    Only keys that go over a border of tasks have any. A task's keys and times are held by it at once.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if cols is None or not cols.num_rows:
            return
        keys, micros, pos = cols.column(0).combine_chunks(), np.asarray(cols.column(1), np.int64), np.asarray(cols.column(2), np.int64)
        if isinstance(keys, pa.ChunkedArray):
            keys = pa.concat_arrays(keys.chunks)
        part, segment = int(pos[0]) >> _PART_BITS, np.cumsum(_begins(keys, None))
        a = int(np.searchsorted(segment, segment[0], "right")) if part in into else 0
        b = int(np.searchsorted(segment, segment[-1], "left")) if part in out else len(pos)
        for lo, hi, comes, goes in [(0, len(pos), True, True)] if a > b else [(0, a, True, False), (b, len(pos), False, True)]:
            if hi <= lo:
                continue
            m, p = micros[lo:hi], pos[lo:hi]
            last = ends_of(next_openers(m, np.zeros(len(m), np.int64), window))
            key = keys[lo].as_py()
            rows = []
            if comes:
                rows.append((m, np.zeros(len(m), bool), p, p[last], m[last], np.zeros(len(m), bool)))
            if goes:
                x = np.unique(last) if comes else last[:1]
                rows.append((m[x] + window, np.ones(len(x), bool), p[x], p[x], m[x], np.full(len(x), not comes)))
            for row in rows:
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(row[0]), pa.string()), *map(pa.array, row)], ["key", "t", "probe", "pos", "exit", "exit_t", "start"])

    return hits.mapInArrow(find, "key string, t long, probe boolean, pos long, exit long, exit_t long, start boolean")


def _followers(rows: DataFrame, n: int) -> DataFrame:
    """(exit, exit_t, start, to, to_t) of every exit: the exit that the first hit after its window leads to, null if there is none.

    Rows are sorted by range over key and time, a hit before the ends that equal it. An
    exit whose hit lies in a later task finds it among the tasks' first hits.
    """
    rows = checkpoint(rows.repartitionByRange(n, "key", "t", "probe").sortWithinPartitions("key", "t", "probe").withColumn("part", F.spark_partition_id()))
    first_key = rows.groupBy("part").agg(F.min("key").alias("key"), F.max("key").alias("last"))
    heads = first_key.join(rows, ["part", "key"], "left").groupBy("part", "key", "last").agg(F.min(F.when(~F.col("probe"), F.struct("t", "exit", "exit_t"))).alias("hit"))
    ahead: dict[int, tuple[str, int, int]] = {}
    known: tuple[str, int, int] | None = None
    for h in sorted(heads.collect(), key=lambda h: -h["part"]):  # one row a task
        ahead[h["part"]] = known
        if h["hit"] is not None:
            known = (h["key"], h["hit"]["exit"], h["hit"]["exit_t"])
        elif h["last"] != h["key"]:
            known = None

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = list(batches)
        if not whole or not sum(map(len, whole)):
            return
        pdf = pd.concat(whole, ignore_index=True)
        later = ahead[int(pdf["part"].iloc[0])]
        probe = pdf["probe"].to_numpy(bool)
        key = pd.factorize(pdf["key"])[0]
        hits = np.flatnonzero(~probe)
        at = np.flatnonzero(probe)
        i = np.searchsorted(hits, at)
        found = i < len(hits)
        place = hits[np.minimum(i, max(0, len(hits) - 1))] if len(hits) else np.zeros(len(at), np.int64)
        found &= key[place] == key[at] if len(hits) else False
        to = pd.array(pdf["exit"].to_numpy()[place], "Int64")
        to_t = pd.array(pdf["exit_t"].to_numpy()[place], "Int64")
        beyond = ~found & (key[at] == key[-1]) if later and later[0] == pdf["key"].iloc[-1] else np.zeros(len(at), bool)
        to[~found], to_t[~found] = pd.NA, pd.NA
        if beyond.any():
            to[beyond], to_t[beyond] = later[1], later[2]
        own = pdf.iloc[at]
        yield pd.DataFrame({"exit": own["exit"].to_numpy(), "exit_t": own["exit_t"].to_numpy(), "start": own["start"].to_numpy(), "to": to, "to_t": to_t})

    return rows.mapInPandas(follow, "exit long, exit_t long, start boolean, to long, to_t long")


def _reached_exits(exits: DataFrame) -> list[tuple[int, int]]:
    """(place, time) of the exits that keys' first hits lead to, in order: at most one in each task.

    A round doubles the pointers and adds what the known exits point to.
    """
    exits = checkpoint(exits)
    jumps = exits.where("to is not null").select(F.col("exit").alias("a"), F.col("to").alias("b"), F.col("to_t").alias("b_t"))
    known = exits.where("start").select(F.col("exit").alias("pos"), F.col("exit_t").alias("t"))
    while not jumps.isEmpty():
        led = known.join(jumps, known["pos"] == jumps["a"]).select(F.col("b").alias("pos"), F.col("b_t").alias("t"))
        known = checkpoint(known.union(led).distinct())
        far = jumps.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("b_t").alias("c_t"))
        jumps = checkpoint(jumps.drop("b_t").join(far, "b").select("a", F.col("c").alias("b"), F.col("c_t").alias("b_t")))
    return sorted((r["pos"], r["t"]) for r in known.collect())


def rate_limit(hits: DataFrame, limit: int, window_seconds: int, key: str = "key", at: str = "at", order: str = "hit_id") -> DataFrame:
    """hits with allowed, remaining and retry_after_seconds.

    A window ends more than window_seconds after its opener, so a hit at its very end
    still counts. Hits of one key and time go by ``order``. Null keys share one window; a
    hit without a time raises. Columns of hits by one of the three names give way. No hits
    give no rows. However many hits one key has, all tasks share them.
    """
    hits = hits.select(*[c for c in hits.columns if c.lower() not in ("allowed", "remaining", "retry_after_seconds")])
    k, m, pos = (fresh(hits.columns, c) for c in ("_key", "_micros", "_pos"))
    n, window = partitions(hits.sparkSession), window_seconds * _MICROS
    timed = F.when(F.col(at).isNull(), F.raise_error("a hit has no time")).otherwise(F.unix_micros(at))
    rows = hits.withColumn(k, F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))).withColumn(m, timed)
    rows = rows.repartitionByRange(n, k, m, order).sortWithinPartitions(k, m, order)
    rows = checkpoint(rows.withColumn(pos, F.monotonically_increasing_id()))
    part = F.shiftright(pos, _PART_BITS).cast("int")
    ends = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min(k).alias("first"), F.max(k).alias("last"))
    into, out, before = _spanning(sorted(ends.collect(), key=lambda r: r["part"]))  # one row a task
    kept, opened = hits.columns, {}
    if into:
        found = _reached_exits(_followers(_exits(rows.select(k, m, pos), into, out, window), n))
        places = [p for p, _ in found]
        for p in into:
            place, time = found[int(np.searchsorted(places, p << _PART_BITS)) - 1]  # the last before p is of its first key
            opened[p] = (time, before[p] - before[place >> _PART_BITS] - (place & ((1 << _PART_BITS) - 1)))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_ = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            keys, micros = batch.column(names.index(k)), np.asarray(batch.column(names.index(m)), np.int64)
            if now is None:
                p = batch.column(names.index(pos))[0].as_py() >> _PART_BITS
                now, open_ = (keys[0].as_py(), opened[p]) if p in opened else (None, None)
            allowed, remaining, wait, open_ = _fold(micros, _begins(keys, now), open_, limit, window_seconds)
            now = keys[-1].as_py()
            columns = [batch.column(names.index(c)) for c in kept]
            found = [pa.array(allowed), pa.array(remaining.astype(np.int32)), pa.array(wait.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*columns, *found], [*kept, "allowed", "remaining", "retry_after_seconds"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema)
    return rows.mapInArrow(fold, f"{schema}, allowed boolean, remaining int, retry_after_seconds int")
