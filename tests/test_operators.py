"""Billing, sources, changes, streams and governance, case by case."""

import datetime
import random
import zlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from docketry.functions import access, numbers, texts, vectors
from docketry.operators import billing, changes, events, governance, limits, workflow
from docketry.sources import contacts, documents

FEES = [(1842000, 1500, 276300), (100000, 1250, 12500), (1, 1500, 0), (7, 1500, 1), (3, 5000, 1), (100000, 10000, 100000), (1842000, 0, 0), (0, 1500, 0), (-50000, 1500, 0),
        (1000003, 1500, 150000), (999999999, 1234, 999999999 * 1234 // 10000), (9_000_000_000_000_000_000, 9999, 9_000_000_000_000_000_000 * 9999 // 10000)]


def test_fees(spark):
    df = spark.createDataFrame([f[:2] for f in FEES], "c long, r long")
    assert [r[0] for r in df.select(numbers.fee_cents(F.col("c"), F.col("r"))).collect()] == [f[2] for f in FEES]


@pytest.mark.parametrize("rate", [-1, 10001])
def test_rates_that_are_none(spark, rate):
    with pytest.raises(PySparkException):
        spark.createDataFrame([(100000, rate)], "c long, r long").select(numbers.fee_cents(F.col("c"), F.col("r"))).collect()


def test_money_as_text(spark):
    df = spark.createDataFrame([(1500, "$1,842.5", "12.5"), (1250, "7", "101"), (1234, "1.234", "x"), (1205, "", "")], "r long, t string, p string")
    rows = df.select(numbers.rate_text(F.col("r")), numbers.cents_of(F.col("t")), numbers.cents_of(F.col("t"), True), numbers.bps_of(F.col("p"))).collect()
    assert [tuple(r) for r in rows] == [("15%", 184250, 184250, 1250), ("12.5%", 700, 700, None), ("12.34%", None, None, None), ("12.05%", None, 0, 0)]
    n = spark.range(1).select(numbers.invoice_number(F.lit("mercy"), F.lit("2026-11-05").cast("timestamp"), F.lit(42)), numbers.invoice_number(F.lit("a"), F.lit("2026-01-05").cast("timestamp"), F.lit(1234))).first()
    assert tuple(n) == ("MERCY-202611-042", "A-202601-1234")


def outcome(i, result="won", cents=1842000, at="2026-01-15", invoice=None):
    return (i, 1, result, cents, datetime.datetime.fromisoformat(at), invoice, 1500)


def test_invoices(spark):
    rows = [outcome(1), outcome(2, "lost", 0), outcome(3, "withdrawn", 0), outcome(4, cents=0), outcome(5, at="2026-02-01"), outcome(6, invoice=9), outcome(7, "partial", 333), outcome(8, cents=333), outcome(9, cents=333)]
    df = spark.createDataFrame(rows, "outcome_id int, organization_id int, result string, recovered_cents long, decided_at timestamp, invoice_id int, rate_bps long")
    t = lambda s: F.lit(s).cast("timestamp")
    lines = billing.billed_lines(df, t("2026-01-01"), t("2026-01-31 23:59:59"))
    got = {r.outcome_id: (r.excluded_reason, r.fee_cents) for r in lines.collect()}
    assert got[1] == (None, 276300) and got[7] == got[8] == got[9] == (None, 49)
    assert [got[i][0].split(",")[0] for i in (2, 3, 4, 5, 6)] == ["lost", "withdrawn", "no dollars recovered", "decided outside this period", "already billed on an earlier invoice"]
    org = spark.createDataFrame([(1, "northgate", 1500)], "organization_id int, slug string, rate_bps long")
    done = billing.issue_invoices(lines, org, t("2026-01-01")).first()
    assert (done.number, done.fee_cents, done.lines) == ("NORTHGATE-202601-001", 276300 + 147, 4)


CSV = 'Work Email,First Name,"Last, Name",Company\r\n\r\nA@B.co,Ann,"O""Neil, Jr",Mercy\r\n,x,y,z\nnope,x,y,z\na@b.co,Again,,\n c@d.org , , ,\n'


def test_contacts(spark):
    files = spark.createDataFrame([("f", CSV), ("g", "name\nx"), ("h", " \n ")], "file string, value string")
    good, bad = contacts.parse_contacts(contacts.number_lines(files, "file", "value"))
    got = [(r.line_no, r.email, r.first_name, r.org_name) for r in good.orderBy("line_no").collect()]
    assert got == [(2, "a@b.co", "Ann", "Mercy"), (6, "c@d.org", None, None)]
    assert [(r.file, r.line_no) for r in bad.orderBy("file", "line_no").collect()] == [("f", 3), ("f", 4), ("f", 5), ("g", 1)]
    cells = spark.range(1).select(contacts.cells(F.lit('a,"b,""c""",,""," d"'))).first()[0]
    assert cells == ["a", 'b,"c"', "", "", " d"]


def pdf():
    page = b"BT (Hello \\(you\\)) Tj T* [(Wor) 20 (ld) -300 (again\\041)] TJ ET"
    return b"%PDF-1.4\n1 0 obj <</Filter /FlateDecode>> stream\n" + zlib.compress(page) + b"\nendstream endobj\n2 0 obj <</Length 9>> stream\nBT (Two) ' ET\n(x) Tj\nendstream\n3 0 obj <</Filter /DCTDecode>> stream\n(no) Tj endstream"


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(pdf())
    (tmp_path / "b.txt").write_bytes(b"plain\r\ntext \xff")
    rows = {r.path.rsplit("/", 1)[1]: r for r in documents.uploaded_text(documents.read_files(spark, str(tmp_path))).collect()}
    assert rows["a.pdf"].text == "Hello (you)\nWorld again!\n\fTwo\n\nx" and rows["a.pdf"].format == "pdf" and rows["b.txt"].text == "plain\ntext �"
    assert documents.text_of_pdf(b"nothing") == ""
    (tmp_path / "c.csv").write_text("Email\nq@r.st\n")
    assert contacts.read_lines(spark, str(tmp_path / "c.csv")).count() == 2


def test_open_data_and_catalogs(spark, tmp_path):
    (tmp_path / "rows.json").write_text('{"docket_number":"7","url":"u","date":"2001-02-03","subject":" "}\n{"decision_number":"DAB 8","link":"v","decision_date":"?"}\n{"url":"w"}\n')
    got = {r.citation: (r.title, r.url, str(r.decided_at)) for r in documents.read_open_data(spark, str(tmp_path / "rows.json")).collect()}
    assert got == {"DAB No. 7": ("7", "u", "2001-02-03 00:00:00"), "DAB 8": ("DAB 8", "v", "None")}
    assert documents.read_open_data(spark, str(tmp_path / "rows.json"), "2001-01-01").count() == 1
    assert documents.catalogs(spark, "2026-01-01").count() == 6


def test_changes(spark):
    t = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "id int, v string, w string")
    new = spark.createDataFrame([(2, None, "y"), (3, "c", None)], "id int, v string, w string")
    assert sorted(map(tuple, changes.upsert(t, new, "id").collect())) == [(1, "a", None), (2, "b", "y"), (3, "c", None)]
    more = spark.createDataFrame([(5, "b", None), (6, "z", None), (7, "z", None), (8, None, None), (9, None, None)], "id int, v string, w string")
    assert sorted(r.id for r in changes.insert_ignore(t, more, ["id"], ["v"], order=["id"]).collect()) == [6, 8, 9]
    assert [r.id for r in changes.delete_where(t, F.col("w") == "x").collect()] == [1]
    assert changes.violations(more, "v").count() == 2 and changes.orphans(more, "id", t, "id").count() == 5


def test_workflow(spark):
    rows = [("intake", "parsing", True), ("intake", "approved", False), ("invoiced", "intake", False), ("generating", "clinical_review", True), (None, "intake", False)]
    df = spark.createDataFrame([r[:2] for r in rows], "a string, b string")
    assert [r[0] for r in df.select(workflow.can_transition(F.col("a"), F.col("b"))).collect()] == [r[2] for r in rows]
    acts = [(1, 1, "clinical", "approved", 1), (2, 1, "legal", "approved", 2), (3, 1, "clinical", "edited", 3), (4, 2, "clinical", "rejected", 1), (5, 2, "clinical", "approved", 2), (6, 2, "legal", "approved", 2)]
    a = spark.createDataFrame(acts, "review_id int, draft_id int, review_type string, action string, created_at int")
    assert {r.draft_id: r.both for r in workflow.latest_verdicts(a).collect()} == {1: False, 2: True}
    assert {r.draft_id: r.clinical_approved for r in workflow.ever_approved(a).collect()} == {1: True, 2: True}


def test_rate_limit_is_anchored_at_the_first_hit(spark):
    base = datetime.datetime(2024, 1, 1)
    hits = [("k", base + datetime.timedelta(seconds=s), i) for i, s in enumerate((0, 3599, 3600, 3601, 3602))] + [("j", base + datetime.timedelta(seconds=s), 10 + s) for s in range(6)]
    got = {r.hit_id: r for r in limits.rate_limit(spark.createDataFrame(hits, "key string, at timestamp, hit_id int"), 2, 3600).collect()}
    assert [got[i].allowed for i in range(5)] == [True, True, False, True, True] and got[2].retry_after_seconds == 1
    assert [got[10 + i].allowed for i in range(6)] == [True, True, False, False, False, False] and got[12].retry_after_seconds == 3598


def test_streams(spark, tmp_path):
    from docketry.streaming import incremental

    base = datetime.datetime(2024, 1, 1)
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    schema = "key string, at timestamp, hit_id long"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    put([("k", base + datetime.timedelta(seconds=i), i) for i in range(4)])
    stage = lambda df: df.select("hit_id", F.upper("key").alias("key"))
    for n in (4, 4, 6):
        if n == 6:
            put([("k", base + datetime.timedelta(seconds=i), i) for i in (4, 5)])
        incremental.run_stage(spark, src, schema, out, cp, stage).awaitTermination()
        assert spark.read.parquet(out).count() == n
    hits = spark.readStream.schema(schema).parquet(src)
    q = incremental.rate_limit_stream(hits, 3, 3600).writeStream.format("memory").queryName("limited").option("checkpointLocation", cp + "2").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {r.hit_id: r.allowed for r in limits.rate_limit(spark.read.parquet(src), 3, 3600).collect()}
    assert {r.hit_id: r.allowed for r in spark.table("limited").collect()} == want
    incremental.drain_jobs_stream(spark, src, schema, out + "3", cp + "3", stage).awaitTermination()
    assert spark.read.parquet(out + "3").count() == 6


def test_governance(spark, tmp_path):
    key = governance.encryption_key("secret")
    assert len(key) == 32 and key == governance.encryption_key("secret")
    rows = [("line\nüñ",), ("",), (None,)]
    df = spark.createDataFrame(rows, "s string").withColumn("e", governance.encrypt(F.col("s"), key)).withColumn("f", governance.encrypt(F.col("s"), key))
    got = df.select(governance.decrypt(F.col("e"), key).alias("d"), "e", "f").collect()
    assert [r.d for r in got] == [r[0] for r in rows] and got[0].e.startswith("v1.") and got[2].e is None
    sealed = got[0].e
    bad = sealed[:-6] + ("A" if sealed[-6] != "A" else "B") + sealed[-5:]
    with pytest.raises(PySparkException):
        spark.createDataFrame([(bad,)], "e string").select(governance.decrypt(F.col("e"), key)).collect()
    for name in ("denial", "invoice"):
        spark.range(3).write.parquet(str(tmp_path / name))
    tables = {n: spark.read.parquet(str(tmp_path / n)) for n in ("denial", "invoice")}
    governance.analytics_safe(tables["invoice"].groupBy("id").count(), tables)
    with pytest.raises(governance.RestrictedTableError):
        governance.analytics_safe(tables["invoice"].join(tables["denial"], "id"), tables)


def test_permissions(spark):
    df = spark.createDataFrame([("superadmin", None), ("none", "readonly"), ("legal_reviewer", None), ("none", None), (None, "org_admin")], "p string, o string")
    sizes = [len(r[0]) for r in df.select(access.permissions(F.col("p"), F.col("o"))).collect()]
    assert sizes == [26, 4, 5, 0, 13]


def test_vectors(spark):
    df = spark.createDataFrame([("Skilled nursing care!",), ("",), (None,), ("ab",)], "t string").withColumn("v", vectors.embed(F.col("t")))
    rows = df.select("v", vectors.cosine(F.col("v"), F.col("v")).alias("c"), vectors.cosine(F.col("v"), F.array(F.lit(1.0))).alias("z")).collect()
    assert abs(rows[0].c - 1) < 1e-12 and not any(rows[1].v) and rows[2].c == 0 and all(r.z == 0 for r in rows) and len(rows[3].v) == 384


def test_templates(spark):
    r = spark.range(1).select(
        texts.substitute(F.lit("{{a}} {{ b }} {{c}}"), {"a": F.lit("$1 {{b}}"), "b": F.lit(None).cast("string")}), texts.placeholders(F.lit("{{b}}{{a}}{{b}}")),
        texts.wrap(F.lit("aa bb cccccc d"), 5), texts.embedded_json(F.lit("x [1, 2] y")), texts.embedded_json(F.lit("no")),
    ).first()
    assert tuple(r) == ("$1 {{b}}  {{c}}", ["b", "a"], ["aa bb", "cccccc", "d"], "[1, 2]", None)


def test_functions_in_sql(spark):
    from docketry.operators import sql

    sql.register(spark)
    text = "ANALYSIS\n\nThis paragraph is long enough to be a passage of its own."
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")
    rows = spark.sql("select d.doc_id, s.ordinal, s.heading_path from {d} d, lateral spans_of(d.text) s", d=docs).collect()
    assert [tuple(r) for r in rows] == [(1, 1, ["ANALYSIS"])]
    r = spark.sql("select verify_quote('is LONG enough to be a passage', text).char_start a, fold_text(text) f, size(embed_text('abc')) n from {d} where doc_id = 1", d=docs).first()
    assert (r.a, r.n) == (text.index("is long"), 384) and r.f.startswith("analysis this")


def test_contact_imports_build_no_list_in_one_row(spark, monkeypatch):
    from docketry.plans.text import contact_imports

    plan = contact_imports(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "collect_list" not in plan
    monkeypatch.setattr(contacts, "RANGE", 3)
    rows = [("a", i, f"l{i}") for i in range(1, 11)] + [("a", 11, None), ("a", 12, "l12"), ("b", 5, "only"), ("b", 5, "again")]
    df = spark.createDataFrame(rows, "file string, id long, l string").repartition(3)
    got = sorted(map(tuple, contacts.export_lines(df, "file", "id", F.col("l"), "head").select("line_no", "file", "line").collect()))
    want = {"a": ["head", *[f"l{i}" for i in range(1, 11)], "l12"], "b": ["head", "again", "only"]}
    assert got == sorted((n, f, line) for f, lines in want.items() for n, line in enumerate(lines, 1))


def insert_one_by_one(target, new, keys):
    """The definition: rows go in by id, each only if none that is there shares a whole key."""
    there, taken = list(target), []
    for row in sorted(new, key=lambda r: r[0]):
        whole = [[row[i] for i in key] for key in keys]
        if not any(None not in v and any([r[i] for i in key] == v for r in there) for v, key in zip(whole, keys)):
            there.append(row)
            taken.append(row)
    return sorted(taken)


@pytest.mark.parametrize("seed", range(4))
def test_insert_ignore_goes_row_by_row(spark, seed):
    rng = random.Random(seed)
    value = lambda n: rng.choice([None, *range(n)])
    row = lambda i: (i, value(12), value(9), rng.randrange(2))
    target, new = [row(-i) for i in range(1, 4)], [row(i) for i in range(40)]
    schema = "id int, a int, b int, c int"
    got = changes.insert_ignore(spark.createDataFrame(target, schema), spark.createDataFrame(new, schema).repartition(3), ["a"], ["b", "c"], order=["id"])
    assert sorted(map(tuple, got.collect())) == insert_one_by_one(target, new, [(1,), (2, 3)])


def test_a_row_that_loses_blocks_no_other(spark):
    t = spark.createDataFrame([], "a int, b int")
    new = spark.createDataFrame([(1, 5), (2, 5), (2, 6), (None, 5), (None, None), (None, None)], "a int, b int")
    assert sorted(map(tuple, changes.insert_ignore(t, new, ["a"], ["b"]).collect()), key=str) == sorted([(1, 5), (2, 6), (None, None), (None, None)], key=str)


def test_upsert_applies_repeated_keys_in_order(spark):
    t = spark.createDataFrame([(1, "a", "b"), (2, "c", None)], "id int, x string, y string")
    new = spark.createDataFrame([(1, "first", "kept", 1), (1, "last", None, 2), (3, None, "n", 1)], "id int, x string, y string, at int")
    assert sorted(map(tuple, changes.upsert(t, new, "id", order=["at"]).collect())) == [(1, "last", "kept"), (2, "c", None), (3, None, "n")]


def test_equal_paths_are_judged_each(spark):
    paths = spark.createDataFrame([("h", "/a"), ("h", "/a"), ("h", "/ab"), ("other", "/a")], "host string, path string")
    rules = spark.createDataFrame([("h", "disallow", "/a"), ("h", "allow", "/ab"), ("h", "crawl-delay", "1.5"), ("h", "crawl-delay", "x")], "host string, kind string, value string")
    assert sorted(map(tuple, documents.robots_permit(paths, rules).collect())) == [("h", "/a", False), ("h", "/a", False), ("h", "/ab", True), ("other", "/a", True)]
    assert list(map(tuple, documents.crawl_delays(rules).collect())) == [("h", 1500)]


@pytest.mark.parametrize("kind", ["int", "string", "double"])
def test_null_keys_share_a_window(spark, kind):
    rows = [(None if i % 2 else "1", i, i) for i in range(10)]
    hits = spark.createDataFrame(rows, "key string, s int, hit_id int").selectExpr(f"cast(key as {kind}) as key", "timestamp_seconds(s) as at", "hit_id")
    got = {r.hit_id: r.allowed for r in limits.rate_limit(hits, 3, 60).collect()}
    assert got == {i: i < 6 for i in range(10)}


def test_numeric_entities_of_any_length(spark):
    import time

    made = ["&#0000000233;", "&#233;&#128512;", "&#99999999999999;x", "&#55296;", "&#x41; &#; &#12", "", None, "a&#10;b&#0065;"]
    want = ["é", "é😀", "&#99999999999999;x", "&#55296;", "&#x41; &#; &#12", "", None, "a\nbA"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "i int, t string")
    assert [r.t for r in df.orderBy("i").select(texts.decode_numeric_entities(F.col("t")).alias("t")).collect()] == want
    took = []
    for n in (20_000, 20_000, 80_000):
        long = spark.createDataFrame([("x&#233;y" * n,)], "t string").select(F.length(texts.decode_numeric_entities(F.col("t"))).alias("n"))
        began = time.perf_counter()
        assert long.first().n == 3 * n
        took.append(time.perf_counter() - began)
    assert took[2] < 10 * took[1] + 5


def test_work_mail_and_dates(spark):
    df = spark.createDataFrame([("a@Gmail.com",), ("a@gmail.com.org",), ("a@b@c.org",), ("nobody",), (None,)], "m string")
    assert [r.w for r in df.select(texts.is_work_email(F.col("m")).alias("w")).collect()] == [False, True, False, False, None]
    d = spark.sql("select * from values (date'2024-01-02', date'2024-01-01'), (date'2024-01-01', date'2024-01-01'), (null, date'2024-01-01'), (null, null) as t(a, b)")
    assert [r.o for r in d.select(numbers.dates_in_order(F.col("a"), F.col("b")).alias("o")).collect()] == [False, True, True, True]
