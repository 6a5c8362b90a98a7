"""The rate limit over many tasks against one bucket after another."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.operators import limits


@pytest.fixture
def many_tasks(spark):
    names = {"spark.sql.shuffle.partitions": "13", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def brute(rows, limit, window):
    out, buckets = [], {}
    for key, micros, i in sorted(rows, key=lambda r: (r[1], r[2])):
        out.append((i, *buckets.setdefault(key, limits.Bucket()).hit(micros, limit, window)))
    return sorted(out)


def run(spark, rows, limit, window):
    df = spark.createDataFrame(rows, "key string, micros long, hit_id int").select("key", F.timestamp_micros("micros").alias("at"), "hit_id", F.lit("x").alias("allowed"), F.lit(1).alias("_pos"))
    return sorted(tuple(r) for r in limits.rate_limit(df.repartition(5), limit, window).select("hit_id", "allowed", "remaining", "retry_after_seconds").collect())


@pytest.mark.parametrize("seed,hot,window", [(1, 1.0, 1), (2, 1.0, 60), (3, 0.4, 7), (4, 0.8, 100_000), (5, 0.9, 3)])
def test_hot_keys_lie_in_many_tasks(spark, many_tasks, seed, hot, window):
    rng = random.Random(seed)
    time = lambda: rng.choice([rng.randrange(300_000_000), rng.randrange(300) * 1_000_000, 5_000_000])
    rows = [("hot" if rng.random() < hot else rng.choice([None, "", "a", "zz", str(rng.randrange(50))]), time(), i) for i in range(1200)]
    assert run(spark, rows, 3, window) == brute(rows, 3, window)


def test_gaps_between_tasks_and_windows_over_several(spark, many_tasks):
    rows = [("k", 1_000_000 * t, t) for t in [*range(200), *range(5000, 5010), *range(9000, 9300)]]
    for window in (10, 250, 4900, 20_000):
        assert run(spark, rows, 20, window) == brute(rows, 20, window)
    spread = limits.rate_limit(spark.createDataFrame([("k", t, t) for t in range(2000)], "key string, s int, hit_id int").select("key", F.timestamp_seconds("s").alias("at"), "hit_id"), 3, 10)
    assert spread.select(F.spark_partition_id().alias("p")).distinct().count() == 13


def test_no_hits_and_a_hit_without_a_time(spark):
    assert run(spark, [], 3, 1) == []
    with pytest.raises(Exception, match="no time"):
        run(spark, [("k", None, 1)], 3, 1)


def test_next_openers_of_many_segments():
    rng = np.random.default_rng(3)
    segment = np.sort(rng.integers(0, 40, 500))
    micros = rng.integers(-(10**14), 10**14, 500)
    micros = micros[np.lexsort((micros, segment))]
    for window in (1, 10**13, 10**18):
        got = limits.next_openers(micros, segment, window)
        want = [next((j for j in range(i + 1, 500) if segment[j] == segment[i] and micros[j] > micros[i] + window), 500) for i in range(500)]
        assert got.tolist() == want
