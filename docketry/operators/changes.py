"""Changes to tables as new DataFrames: Spark rewrites, it does not update in place.

Every function takes the table as it is and what should happen, and returns the table as
it is afterwards, or the rows to append. Keys are compared null-safe only where said.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from docketry.operators.graph import components
from docketry.runtime import checkpoint, fresh, partitions


def _ordered(df: DataFrame, order: Sequence[str]) -> list[Column]:
    """The columns that order rows: those asked for, then all; maps by their sorted entries, since Spark does not order maps."""
    rest = [f.name for f in df.schema if f.name not in order]
    return [F.array_sort(F.map_entries(F.col(f"`{c}`"))) if isinstance(df.schema[c].dataType, MapType) else F.col(f"`{c}`") for c in [*order, *rest]]


def _whole(key: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"`{c}`").isNotNull() for c in key))


def _fold(open_: DataFrame, keys: Sequence[Sequence[str]]) -> DataFrame:
    """The places of rows that go in, of rows (place and key columns) that may all wait for one another.

    Rows that share a value of a key are linked to the first that has it. A component of
    links is read in order by one task, which holds the values that the component's
    inserted rows have taken, as 128-bit hashes. Components stream one after the other.
    """
    links = []
    for key in keys:
        of = open_.where(_whole(key))
        links.append(of.join(of.groupBy(*key).agg(F.min("place").alias("v")), list(key)).select(F.col("place").alias("u"), "v"))
    root = components(reduce(DataFrame.union, links)).withColumnRenamed("node", "place")
    marks = [F.when(_whole(key), F.concat(*[F.hex(F.xxhash64(F.lit(f"{seed}{i}"), *key)) for seed in "ab"])) for i, key in enumerate(keys)]
    rows = open_.select("place", F.array_compact(F.array(*marks)).alias("marks")).join(root, "place", "left")
    rows = rows.select(F.coalesce("root", "place").alias("root"), "place", "marks").repartition("root").sortWithinPartitions("root", "place")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, taken = None, set()
        for batch in batches:
            won = []
            for root_, place, marks_ in zip(*(c.to_pylist() for c in batch.columns)):
                if root_ != now:
                    now, taken = root_, set()
                if taken.isdisjoint(marks_):
                    taken.update(marks_)
                    won.append(place)
            yield pa.RecordBatch.from_arrays([pa.array(won, pa.int64())], ["place"])

    return rows.mapInArrow(go, "place long")


def insert_ignore(target: DataFrame, new: DataFrame, *unique: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The rows of new that are there after they are inserted one by one, each only if it breaks no unique key.

    Rows go in by ``order``, then by all their columns as they are typed, nulls last; of
    equal rows with a key one goes in. A row that loses blocks no other: one that meets only losers
    goes in. A key with a null in it never conflicts, as in SQL, so rows without a whole
    key all go in. Empty tables give what is left.

    Rows are decided in parallel rounds as long as a round settles half of those that are
    open: those that come first in all their keys go in, those that then conflict are
    out. So there are at most the logarithm of the rows. What is left waits in chains;
    each component of those is folded once, in order.
    """
    columns = new.columns
    place = fresh(columns, "_place")
    keyed = reduce(lambda a, b: a | b, map(_whole, unique))
    taken = [new.where(~keyed)]
    rows = new.where(keyed)
    for key in unique:
        theirs = [fresh(columns, f"_its_{c}") for c in key]
        there = target.where(_whole(key)).select(*[F.col(f"`{c}`").alias(t) for c, t in zip(key, theirs)]).distinct()
        rows = rows.join(there, reduce(lambda a, b: a & b, (F.col(f"`{c}`") == F.col(f"`{t}`") for c, t in zip(key, theirs))), "left_anti")
    by = [c if i < len(order) else c.asc_nulls_last() for i, c in enumerate(_ordered(new, order))]
    rows = rows.repartitionByRange(partitions(new.sparkSession), *by).sortWithinPartitions(*by)
    rows = checkpoint(rows.withColumn(place, F.monotonically_increasing_id()))

    def inserted(places: DataFrame) -> DataFrame:
        return rows.join(places.select(F.col("place").alias(place)), place, "left_semi").select(*columns)

    named = {c: f"k{i}" for i, c in enumerate(sorted({c for key in unique for c in key}))}  # beside these nothing but places travels
    keys = [[named[c] for c in key] for key in unique]
    open_ = rows.select(F.col(place).alias("place"), *[F.col(f"`{c}`").alias(k) for c, k in named.items()])
    count = open_.count()
    while count:
        firsts = open_.select("place")
        for key in keys:
            of = open_.where(_whole(key))
            first = of.groupBy(*key).agg(F.min("place").alias("first"))
            firsts = firsts.join(of.join(first, key).where("place > first").select("place"), "place", "left_anti")
        won = checkpoint(open_.join(firsts, "place"))
        left = open_.join(won.select("place"), "place", "left_anti")
        for key in keys:
            left = left.join(won.where(_whole(key)).select(*key).distinct(), key, "left_anti").select(*open_.columns)
        taken.append(inserted(won))
        open_, before = checkpoint(left), count
        count = open_.count()
        if count and 2 * count > before:
            taken.append(inserted(checkpoint(_fold(open_, keys))))
            break
    return reduce(DataFrame.unionByName, taken)


def upsert(target: DataFrame, new: DataFrame, *key: str, order: Sequence[str] = ()) -> DataFrame:
    """target after new: rows of a known key take the new values that are not null, others are added.

    Rows of new that repeat a key are applied by ``order``, then by all their columns as
    they are typed: of each value the last that is not null counts. A key with a null in
    it is no key: such rows of target stay as they are, such rows of new are added each.
    Columns that target lacks are left out.
    """
    values = [c for c in target.columns if c not in key and c in new.columns]
    named = {c: fresh([*target.columns, *new.columns], f"_new_{c}") for c in values}
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(_ordered(new, order))])
    last = [F.max_by(f"`{c}`", F.when(F.col(f"`{c}`").isNotNull(), place)).alias(named[c]) for c in values]
    known = new.where(_whole(key))
    known = known.groupBy(*key).agg(*last) if last else known.select(*key).distinct()
    merged = target.join(known, list(key), "full_outer")
    merged = merged.select(*[F.coalesce(f"`{named[c]}`", f"`{c}`").alias(c) if c in named else F.col(f"`{c}`") for c in target.columns])
    unkeyed = new.where(~_whole(key)).select(*key, *values)
    return merged.unionByName(unkeyed, allowMissingColumns=True)


def update_where(target: DataFrame, when: Column, **values: Column) -> DataFrame:
    """target with new values in the rows where a condition holds."""
    return target.withColumns({c: F.when(when, v).otherwise(F.col(c)) for c, v in values.items()})


def update_keys(target: DataFrame, keys: DataFrame, key: str, **values: Column) -> DataFrame:
    """target with new values in the rows whose key is listed."""
    listed = keys.select(key).distinct().withColumn("_listed", F.lit(True))
    return update_where(target.join(listed, key, "left"), F.coalesce("_listed", F.lit(False)), **values).select(*target.columns)


def replace_children(target: DataFrame, new: DataFrame, parent: str, parents: DataFrame | None = None) -> DataFrame:
    """target after all rows of some parents are replaced by new ones; parents name those that end up empty too."""
    gone = (parents if parents is not None else new).select(parent).distinct()
    return target.join(gone, parent, "left_anti").select(*target.columns).unionByName(new.select(*target.columns))


def delete_where(target: DataFrame, when: Column) -> DataFrame:
    """target without the rows where a condition holds; rows where it is null stay."""
    return target.where(~F.coalesce(when, F.lit(False)))


def erase(tables: dict[str, DataFrame], tree: Sequence[tuple[str, str, str | None, str]], roots: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Erase everything below some roots: the count of rows per root and table, and the tables without them.

    tree lists (table, key, parent table, parent key) with parents first; the first
    parent is None for tables that hang off roots, whose one column is the parent key.
    """
    root = roots.columns[0]
    doomed: dict[str, DataFrame] = {}
    counts: list[DataFrame] = []
    left: dict[str, DataFrame] = {}
    for name, key, parent, via in tree:
        above = roots.select(F.col(root).alias("_root"), F.col(root).alias("_via")) if parent is None else doomed[parent].select("_root", F.col("_key").alias("_via"))
        t = tables[name]
        doomed[name] = t.join(above, t[via] == above["_via"]).select("_root", F.col(key).alias("_key"))
        counts.append(doomed[name].groupBy("_root").agg(F.count("*").alias("n")).select(F.col("_root").alias(root), F.lit(name).alias("table_name"), "n"))
        left[name] = t.join(above.select(F.col("_via").alias(via)).distinct(), via, "left_anti").select(*t.columns)
    found = reduce(DataFrame.unionByName, counts)
    names = roots.select(root, F.explode(F.array(*[F.lit(n) for n, *_ in tree])).alias("table_name"))
    return names.join(found, [root, "table_name"], "left").select(root, "table_name", F.coalesce("n", F.lit(0)).alias("n")), left


def receipts(counts: DataFrame, at: Column, reason: Column) -> DataFrame:
    """What stays of an erasure: for each root when, why, how many rows of each table went, and how many in all.

    counts are those of erase. The receipt is a row of its own and hangs off nothing that was erased.
    """
    root = counts.columns[0]
    each = F.map_from_entries(F.array_sort(F.collect_list(F.struct("table_name", "n"))))
    return counts.groupBy(root).agg(each.alias("tables"), F.sum("n").alias("total")).select(root, at.alias("erased_at"), reason.alias("reason"), "tables", "total")


def violations(df: DataFrame, *unique: str) -> DataFrame:
    """Keys that are there more than once, with their counts; a check Spark does not make itself."""
    return df.groupBy(*unique).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of child whose key is not null and has no parent."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti").select(*child.columns)
