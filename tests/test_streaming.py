"""Stateful streams: windows that end with their timers, stages that take what is new or changed."""

import datetime
import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from docketry.operators.limits import Bucket
from docketry.plans import events, stored
from docketry.streaming import incremental

BASE = datetime.datetime(2024, 1, 1)


def test_windows_go_on_between_batches_and_end_with_their_timers(spark, tmp_path):
    src, cp, out = (str(tmp_path / x) for x in ("src", "cp", "out"))
    rng = random.Random(4)
    seconds = sorted(rng.randrange(0, 40_000) for _ in range(400))
    hits = [(rng.choice(["a", "b", None]), s, i) for i, s in enumerate(seconds)] + [("quiet", 1, 1000), ("a", None, 1001)]
    batches = [hits[:150] + hits[400:], hits[150:300], hits[300:400], [("b", 40_000 + 30 * 3600, 2000)], [("b", 40_000 + 90 * 3600, 2001)]]
    for rows in batches:
        made = [(k, s if s is None else BASE + datetime.timedelta(seconds=s), i) for k, s, i in rows]
        spark.createDataFrame(made, "key string, at timestamp, hit_id long").repartition(2).write.mode("append").parquet(src)
        stream = incremental.rate_limit_stream(spark.readStream.schema("key string, at timestamp, hit_id long").parquet(src), 3, 3600)
        stream.writeStream.format("parquet").option("checkpointLocation", cp).trigger(availableNow=True).start(out).awaitTermination()
    found = {r.hit_id: (r.allowed, r.remaining, r.retry_after_seconds) for r in spark.read.parquet(out).collect()}
    buckets, want = {}, {}
    for k, s, i in sorted((h for b in batches for h in b if h[1] is not None), key=lambda h: (h[1], h[2])):
        want[i] = buckets.setdefault(k, Bucket()).hit(s * 1_000_000, 3, 3600)
    assert found == want
    left = spark.read.format("statestore").option("stateVarName", "bucket").load(cp).select("key.key").collect()
    assert [r.key for r in left] == ["b"]


def test_changed_documents_make_new_versions(spark, tmp_path):
    src, cp, out = (str(tmp_path / x) for x in ("src", "cp", "out"))
    schema = "doc_id long, text string, at timestamp"
    cut = lambda text: [{"ordinal": n, "part": p} for n, p in enumerate(text.split()) if p]

    def run(n, rows):
        if rows:
            made = [(i, t, None if s is None else BASE + datetime.timedelta(seconds=s)) for i, t, s in rows]
            spark.createDataFrame(made, schema).repartition(2).write.mode("append").parquet(src)
        incremental.run_versions(spark, src, schema, out, cp, cut, "ordinal int, part string", run=F.lit(n)).awaitTermination()

    run(1, [(1, "a b", 1), (2, None, 1), (3, "", 1), (4, "x", None), (4, "y", 2), (4, "z", 1), (None, "lost", 1), (2**60 + 1, "w" * 300_000, 1), (5, "p", 3), (5, "q", 3)])
    run(2, [])
    run(3, [(1, "a b", 2), (2, "late", 2), (4, "y z", 3), (3, None, 2)])
    run(4, [(1, "c", 3), (4, "y z", 4), (5, "", 9)])
    rows = spark.read.parquet(out)
    found = sorted((r.run, r.doc_id, r.version, r.part) for r in rows.collect())
    assert found == [
        (1, 1, 1, "a"), (1, 1, 1, "b"), (1, 4, 1, "y"), (1, 5, 1, "q"), (1, 2**60 + 1, 1, "w" * 300_000),
        (3, 2, 1, "late"), (3, 4, 2, "y"), (3, 4, 2, "z"), (4, 1, 2, "c"),
    ]
    now = sorted((r.doc_id, r.part) for r in incremental.current(rows).collect())
    assert now == [(1, "c"), (2, "late"), (4, "y"), (4, "z"), (5, "q"), (2**60 + 1, "w" * 300_000)]


def test_forgotten_documents_start_anew(spark, tmp_path):
    src, cp, out = (str(tmp_path / x) for x in ("src", "cp", "out"))
    cut = lambda text: [{"part": text}]
    for n in (1, 2, 3):
        spark.createDataFrame([(7, "same", BASE)], "doc_id long, text string, at timestamp").write.mode("append").parquet(src)
        incremental.run_versions(spark, src, "doc_id long, text string, at timestamp", out, cp, cut, "part string", forget_after=0.001, run=F.lit(n)).awaitTermination()
    assert sorted((r.run, r.version) for r in spark.read.parquet(out).collect()) == [(1, 1), (2, 1), (3, 1)]


def test_both_halves_are_cut_at_one_moment(spark, tmp_path, monkeypatch):
    """An approximate median depends on the order in which tasks' summaries arrive: no hit may be lost or taken twice for that."""
    made = [(i, i % 7, BASE + datetime.timedelta(minutes=i)) for i in range(600)]
    spark.createDataFrame(made, "event_id long, user_id long, ts timestamp").write.parquet(str(tmp_path / "events.parquet"))
    median, elsewhere = F.percentile_approx, F.udf(lambda m: m + random.SystemRandom().randrange(-(10**10), 10**10), "long")
    monkeypatch.setattr(stored.F, "percentile_approx", lambda c, p: elsewhere(median(c, p)))
    kept = ["key", "hit_id", "allowed", "remaining", "retry_after_seconds"]
    found = sorted((int(r[0]), *r[1:]) for r in stored.limited_stream(spark, str(tmp_path)).select(kept).collect())
    assert found == sorted(tuple(r) for r in events.rate_limits(spark, str(tmp_path)).select(kept).collect())


def test_a_stage_makes_no_frame_of_a_document():
    """A frame for each document took more than half of a run's time."""

    class Kept:
        value = None
        exists, get = lambda self: self.value is not None, lambda self: self.value

        def update(self, value):
            self.value = value

    work = incremental.Versions(lambda text: [{"part": p, "ordinal": n} for n, p in enumerate(text.split())], ["ordinal", "part"], None)
    work.last = Kept()
    ask = lambda *rows: [tuple(r) for r in work.handleInputRows((7,), iter([Row(document=7, content=c, landed=at) for c, at in rows]), None)]
    assert ask(("a", 1), ("b c", 2), (None, 2)) == [(7, 1, 0, "b"), (7, 1, 1, "c")]
    assert ask(("b c", 3)) == ask((None, 4)) == []
    assert ask(("d", 5)) == [(7, 2, 0, "d")]
