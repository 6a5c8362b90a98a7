"""Fill-in-middle against a plain Python version, and back."""

import hashlib
import re

import pyarrow as pa
import pytest

from docketry.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def brute(i, text):
    text = text or ""
    units = UNIT.findall(text)
    n, digest = len(units), sha(f"42:{'' if i is None else i}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:lo], units[lo:hi], units[hi:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return i, n, "plain", None, None, sha(text), sha(text)
    form, out = ("spm", f"<S>{suffix}<P>{prefix}<M>{middle}") if h[3] % 100 < 80 else ("psm", f"<P>{prefix}<S>{suffix}<M>{middle}")
    return i, n, form, len(prefix), len(middle), sha(out), sha(text)


def texts():
    odd = ["", " ", "\n\n\t", "one", " lead and trail \x0b\x0c ", "nul\0in\x1cside\x85 nbsp\xa0 x", "<P> marked", "a <S", "S> b", "a<M>b", "<", "<<P <S <M >>", "日本語 テキスト 😀 é", None]
    near = ["<P <S <M " * 3, "x <S y <P z <M w <", "<< <<< S> P> M>"]
    return (odd + near) * 12 + ["word " * 40_000 + "ende", " " * 200_000, "y" * 300_000]


def test_brute_force(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts())] + [(None, "a b c d e f", "x", 2), (3, "again and again", "x", 3), (3, "again and again", "x", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string, n int").repartition(3)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, fim.digests(df).collect()), key=key) == sorted((brute(i, t) for i, t, *_ in rows), key=key)
    assert {r[2] for r in (brute(i, t) for i, t, *_ in rows)} == {"plain", "spm", "psm"}


def test_every_output_goes_back(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    filled = fim.fill_in_middle(df, rearranged=100)
    assert sorted(map(tuple, fim.restore(filled).collect())) == [(i, t or "") for i, t in rows]
    first = filled.where("form = 'spm'").first()
    assert first.output == f"<S>{first.suffix}<P>{first.prefix}<M>{first.middle}"


def test_empty_table_and_other_names(spark):
    assert fim.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = fim.fill_in_middle(spark.createDataFrame([("k", "a b")], "key string, body string"), "key", "body", rearranged=0).collect()
    assert [tuple(r) for r in got] == [("k", 2, "plain", None, None, None, "a b")]


@pytest.mark.parametrize("most", [1, 7, 1000])
def test_lots_hold_all_rows(most):
    batch = pa.record_batch([pa.array(range(9)), pa.array(["abc", None, "", "x" * 50, "ab", "cd", "ef", "g", ""])], ["id", "text"])
    got = list(fim.lots(batch, 1, 4, most))
    assert [i for b in got for i in b.column(0).to_pylist()] == list(range(9))
    assert all(b.num_rows == 1 or b.num_rows <= 4 and sum(len(t or "") for t in b.column(1).to_pylist()) <= most for b in got)
