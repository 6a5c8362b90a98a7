"""Bounded samples for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.runtime import checkpoint

#: crc32(id as text) mod FOLDS is HELD_OUT for documents that no model may learn from.
FOLDS, HELD_OUT = 4, 2


def held_out(id_col: str) -> Column:
    """Whether a document is kept from learning; a null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


#: Rows of classes or sampled ids that may be broadcast.
MOST_BROADCAST = 100_000


def sized(small: DataFrame) -> DataFrame:
    """Written once; broadcast if its rows are few enough when counted, else left to the optimizer."""
    small = checkpoint(small)
    return F.broadcast(small) if small.count() <= MOST_BROADCAST else small


def per_class(rows: DataFrame, class_col: str, size: int, *drawn_by: str) -> DataFrame:
    """About ``size`` rows of each class, chosen by a hash of some columns, so the same in every run.

    The rate of a class is size over its count; rows that are alike in those columns
    stand or fall together.
    """
    rates = sized(rows.groupBy(class_col).agg((F.lit(float(size)) / F.count("*")).alias("_rate")))
    draw = F.pmod(F.xxhash64(F.lit("sample"), *drawn_by), F.lit(1 << 20))
    return rows.join(rates, class_col).where(draw < F.col("_rate") * (1 << 20)).drop("_rate")
