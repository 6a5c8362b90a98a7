"""Wrapped lines and crawl delays against plain Python."""

import random
import re
import time

from pyspark.sql import functions as F

from docketry.functions import texts
from docketry.sources import documents


def lines_of(text, width):
    lines, line = [], ""
    for word in re.findall(r"\S+", text):
        if line and len(line) + 1 + len(word) > width:
            lines.append(line)
            line = word
        else:
            line = f"{line} {word}" if line else word
    return [*lines, line] if line else lines


def test_wrap_is_greedy(spark):
    rng = random.Random(4)
    made = ["", " \n\t ", "x" * 200, "a " * 80, "y" * 76, "y" * 77 + " z", " lead", "é😀 " * 60]
    made += [" ".join("w" * rng.choice([1, 2, 3, 9, 75, 76, 77, 150]) for _ in range(rng.randrange(60))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(made)), "i int, t string")
    for width in (1, 20, 76):
        got = df.orderBy("i").select(texts.wrap(F.col("t"), width).alias("l")).collect()
        assert [r.l for r in got] == [lines_of(t, width) for t in made]
    assert spark.sql("select cast(null as string) as t").select(texts.wrap(F.col("t")).alias("l")).first().l is None


def test_wrap_takes_time_in_proportion(spark):
    took = []
    for n in (100_000, 100_000, 400_000):
        df = spark.range(1).select(F.repeat(F.lit("some words "), n // 2).alias("t"))
        began = time.perf_counter()
        assert df.select(F.size(texts.wrap(F.col("t"))).alias("n")).first().n > n // 14
        took.append(time.perf_counter() - began)
    assert took[2] < 4.5 * took[1] + 1


def test_the_last_crawl_delay_that_is_a_number_counts(spark):
    bodies = {
        "last": "User-agent: *\nCrawl-delay: 5\nCrawl-delay: 2",
        "infinite": "User-agent: *\nCrawl-delay: 3\nCrawl-delay: Infinity\nCrawl-delay: NaN\nCrawl-delay: 1e300\nCrawl-delay: 5d",
        "none": "User-agent: *\nCrawl-delay: soon\nCrawl-delay: -1",
        "own": "User-agent: *\nCrawl-delay: 9\nUser-agent: me\nCrawl-delay: .5\nUser-agent: *\nCrawl-delay: 8",
        "zero": "User-agent: *\nCrawl-delay: 1\nCrawl-delay: 0",
    }
    files = spark.createDataFrame(list(bodies.items()), "host string, body string")
    got = dict(map(tuple, documents.crawl_delays(documents.robots_rules(files, "me/1.0")).collect()))
    assert got == {"last": 2000, "infinite": 3000, "own": 500, "zero": 0}


def test_passages_of_more_documents_than_are_cut_at_once(spark):
    from docketry.operators import spans

    texts = [None if i % 50 == 0 else f"A. Part {i}\n\n{'some words of a passage ' * 3}{i}\n\n\fshort\n\n{'x' * (i % 80)}" for i in range(4 * spans.ROWS)]
    rows = spark.createDataFrame([(i, f"k{i}", t) for i, t in enumerate(texts)], "_text long, b string, body string").coalesce(1)
    got = sorted((r["_text"], r.b, r.ordinal, r.page, r.char_start, r.char_end, r.text, r.heading_path) for r in spans.spanify(rows, "body", "_text", "b").collect())
    assert got == [(i, f"k{i}", *s.values()) for i, t in enumerate(texts) for s in spans.spans_of(t or "")]


def test_replace_many_gives_what_spark_gives(spark):
    made = [None, "", "aé b\n𝄞x`~", "é" * 3000, "no match", "a  b \t c"]
    rows = spark.createDataFrame([(t,) for t in made], "t string")
    for form, to in ((r"[^\x20-\x5f\x61-\x7e\n]", "x"), ("[^A-Za-z0-9]+", " ")):
        assert all(a == b for a, b in rows.select(texts.replace_many(F.col("t"), form, to), F.regexp_replace("t", form, to)).collect())
    assert rows.select(texts.replace_many(F.col("t"), "b", r"\1")).collect()[2][0] == "aé \\1\n𝄞x`~"
