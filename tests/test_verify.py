"""Quotes, passages and text forms, case by case."""

import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from docketry.functions import texts
from docketry.operators import spans, verify
from docketry.operators.quotes import quoted_by

DECISION = "The plan may not deny coverage based on internal criteria.\nIt applied a stricter standard than Medicare’s own rules allow. We find the services were reasonable."
NOTE = "01/14 Patient required skilled nursing daily. Wound care was per­formed by the nurse twice each day. No falls."
CASES = [
    ("plan may not deny coverage based on", DECISION, None),
    ("based on internal criteria. It applied", DECISION, None),
    ("stricter standard than Medicare's own", DECISION, None),
    ("THE PLAN MAY NOT DENY COVERAGE", DECISION, None),
    ("Wound care was per-formed by the nurse", NOTE, None),
    ("The plan violated every rule that exists", DECISION, "not_found_in_source"),
    ("The plan may deny coverage based on internal", DECISION, "not_found_in_source"),
    ("plan may not deny coverage based on internal criteria!", DECISION, "not_found_in_source"),
    ("The plan", DECISION, "quote_too_short"),
    ("", DECISION, "empty_quote"),
    ("    ", DECISION, "empty_quote"),
    (None, DECISION, "empty_quote"),
    ("plan may not deny coverage based on", "", "source_missing"),
    ("plan may not deny coverage based on", None, "source_missing"),
]


def heading(block):
    """Level of a block that reads as a heading, by hand: numbered parts, sections, Roman parts, capital letters, capitals."""
    if not 1 <= len(block) <= 120 or "\n" in block and not block[:1].isupper():
        return None
    head, _, tail = block.partition(" ")
    digits = head.replace(".", "", 1)
    if digits.isdigit() and len(digits) <= 6 and tail[:1] in "-–—" and tail[1:].strip():
        return 1
    if head.endswith(".") and tail.strip() and "\n" not in tail:
        if head[:-1] and set(head[:-1]) <= set("IVXLC") and len(head) <= 7:
            return 1
        if len(head) == 2 and "A" <= head[0] <= "Z":
            return 2
    if block[0].isalpha() and block[0].isascii() and 4 <= len(block) <= 61 and all(c in " \n\t,'()-" or "A" <= c <= "Z" for c in block):
        return 1
    return None


def test_quotes(spark):
    df = spark.createDataFrame([(i, q, s) for i, (q, s, _) in enumerate(CASES)], "i int, quote string, source string")
    got = {r.i: r.v for r in df.select("i", verify.verified_quote(F.col("quote"), F.col("source")).alias("v")).collect()}
    for i, (quote, source, reason) in enumerate(CASES):
        assert got[i].reason == reason, quote
        if reason is None:
            assert verify.fold(source[got[i].char_start : got[i].char_end]) == verify.fold(quote)


@pytest.mark.parametrize("s", ["aé\n b—c", "“x” ‘y’ z…", "​a﻿b­c", "ﬁne Å ½"])
def test_both_ways_to_fold_agree_on_composed_text(s):
    assert verify.fold_with_places(s)[0] == verify.fold(s)


def test_drafts_are_all_or_nothing(spark):
    rows = [(1, "holding", "h1", CASES[0][0]), (1, "clinical_fact", "f1", CASES[4][0]), (2, "holding", "h1", CASES[0][0]), (2, "holding", "gone", CASES[0][0])]
    a = spark.createDataFrame(rows, "draft_id int, source_kind string, source_id string, verbatim_quote string")
    table = lambda i, t: spark.createDataFrame([(i, t)], "id string, t string")
    sources = verify.source_texts(table("h1", DECISION), table("s1", "x"), table("f1", NOTE))
    checked = verify.verify_assertions(a, sources)
    assert sorted(str(r.reason) for r in checked.collect()) == ["None", "None", "None", "source_missing"]
    assert {r.draft_id: (r.ok, r.failure_rate) for r in verify.draft_verdicts(checked).collect()} == {1: (True, 0.0), 2: (False, 0.5)}


def test_first_accepted_attempt(spark):
    rows = [(1, 1, "x", "legal", "holding"), (1, 2, None, "legal", "clinical_fact"), (1, 3, None, "legal", "holding"), (2, 1, "x", "legal", "holding"), (2, 4, None, "legal", "holding")]
    df = spark.createDataFrame(rows, "denial_id int, attempt int, reason string, kind string, source_kind string")
    assert {r.denial_id: (r.accepted, r.tried) for r in verify.first_accepted_attempts(df).collect()} == {1: (3, 3), 2: (None, 1)}


def test_malformed_assertions(spark):
    rows = [(1, "s", "q", "t"), (0, "s", "q", "t"), (1, " ", "q", "t"), (1, "s", None, "t"), (1, "s", "q", ""), (None, "s", "q", "t")]
    df = spark.createDataFrame(rows, "ordinal int, source_id string, verbatim_quote string, text string")
    assert [r.e for r in df.select(verify.assertion_errors().alias("e")).collect()] == [None, "ordinals start at 1", "no source", "no quote", "no text", "ordinals start at 1"]


def test_quoted_by_finds_long_and_short_quotes(spark):
    docs = spark.createDataFrame([(1, DECISION), (2, NOTE), (3, None), (4, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa b")], "doc_id int, text string")
    quotes = spark.createDataFrame([(7, "not deny coverage based on internal"), (8, "a" * 26), (9, "short"), (10, "Patient required  skilled nursing daily.")], "item_id int, text string")
    assert sorted((r.doc_id, r.item_id) for r in quoted_by(docs, quotes).collect()) == [(1, 7), (2, 10), (4, 8)]


LONG = "This paragraph is long enough to be a passage of its own."


def test_passages(spark):
    text = f"B. Level two first\n\n{LONG}\n\nIV. Analysis\n\n  {LONG} é\n \nA. The criteria\n\n{LONG}\f12\n\nshort\n\n{LONG}"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, LONG)], "doc_id int, text string")
    got = sorted(spans.spanify(df, "text", "doc_id").collect(), key=lambda r: (r.doc_id, r.ordinal))
    assert [(r.doc_id, r.ordinal, r.page, r.heading_path) for r in got] == [
        (1, 1, 1, [None, "B. Level two first"]), (1, 2, 1, ["IV. Analysis"]), (1, 3, 1, ["IV. Analysis", "A. The criteria"]),
        (1, 4, 2, ["IV. Analysis", "A. The criteria"]), (4, 1, None, []),
    ]
    assert all(text[r.char_start : r.char_end] == r.text for r in got if r.doc_id == 1)


def test_passages_query_covers_its_texts(spark):
    from docketry.plans.text import _paragraphs, passages

    source = {r.doc_id: r.text for r in _paragraphs(spark, "/root/testdata/sf0.001").collect()}
    import hashlib

    rows = passages(spark, "/root/testdata/sf0.001").collect()
    for r in rows:
        body = source[r.doc_id][r.char_start : r.char_end]
        assert hashlib.sha256(body.encode()).hexdigest() == r.text_sha256 and len(body) >= 40 and r.headings.startswith(f"II. Part {r.doc_id}")
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, t in source.items():
        blocks = [b.strip() for page in t.split("\f") for b in page.split("\n")]
        want = [b for b in blocks if len(b) >= 40 and heading(b) is None]
        assert len(by_doc.get(i, [])) == len(want)


def test_text_forms(spark):
    html = "<html><script>x</script><p>A&amp;B &#233;&#128512;&nbsp;c</p><br/>d<div>e &lt;f&gt;</div> &#1114112;"
    xml = '<?xml version="1.0"?><DIV5><HEAD>Part 1</HEAD><P>x &amp; y</P></DIV5>'
    df = spark.createDataFrame([(html, xml, "a\r\nb  \n\n\n\n\nc \f")], "h string, x string, t string")
    r = df.select(
        texts.clean_text(texts.html_to_text(F.col("h"))), texts.clean_text(texts.regulation_xml_to_text(F.col("x"))), texts.clean_text(F.col("t")),
        texts.document_text(F.lit("manual"), F.lit("u.xml"), F.col("x")),
    ).first()
    assert r[0] == "A&B é😀 c\n\n\nde <f>\n\n &#1114112;" and r[1] == "Part 1\n\nx & y" and r[2] == "a\nb\n\n\nc" and r[3] == r[1]


REDACTED = [
    ("SSN 123-45-6789, call (555) 123-4567", "SSN [redacted:ssn], call ([redacted:phone]"),
    ("mrn: AB-1234 seen", "[redacted:mrn] seen"),
    ("id 1EG4TE5MK73 ok", "id [redacted:medicare-id] ok"),
    ("write a.b+c@d-e.org now", "write [redacted:email] now"),
    ("DOB 04/12/1947 end", "[redacted:dob] end"),
    ("on 1-2-1999 end", "on [redacted:date] end"),
    ("x" * 200, "[redacted:200 chars]"),
    ("plain", "plain"),
]


def test_redaction(spark):
    df = spark.createDataFrame([(a,) for a, _ in REDACTED], "a string")
    assert [r[0] for r in df.select(texts.redact(F.col("a"))).collect()] == [b for _, b in REDACTED]


def test_quotes_meet_documents_that_differ_only_by_folding(spark):
    plain = "An official file's re-entry into the Office was late"
    forms = ["file\u2019s re-entry", "file's re\u2013entry", "file's re\u00adentry", "fi\u200ble's re-entry", "\ufb01le's re-entry", "file's\u2009re-entry", "file's\u202fre-entry", "file's\u3000\u2003re-entry", "FILE\u2032S \uff52\uff45-entry"]
    texts = [plain] + [plain.replace("file's re-entry", f) for f in forms]
    docs = spark.createDataFrame([(i, f"Before. {t}, and after \u00e9.") for i, t in enumerate(texts)] + [(99, "An official file re-entry into the Office was late"), (98, None)], "doc_id long, text string")
    quotes = spark.createDataFrame(list(enumerate([*texts, plain.replace("file's", "wait\u2026 file's")])), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in quoted_by(docs, quotes).collect()}
    assert got == {(d, q) for d in range(len(texts)) for q in range(len(texts))}
    greek = spark.createDataFrame([(1, "\u03a4\u0391 \u039f\u0394\u039f\u03a3 \u039f\u0394\u039f\u03a3 \u039f\u0394\u039f\u03a3 and more words here")], "doc_id long, text string")
    low = spark.createDataFrame([(1, "\u03c4\u03b1 \u03bf\u03b4\u03bf\u03c3 \u03bf\u03b4\u03bf\u03c3 \u03bf\u03b4\u03bf\u03c3 and more words here")], "item_id long, text string")
    assert quoted_by(greek, low).count() == 1
    for s in ("\u039f\u0394\u039f\u03a3 x\u00a0\ufeffy e\u0301 \ufb01\u2026 \u0130\u00ad", "", " \u3000", plain):
        assert verify.fold_each(s) == verify.fold_with_places(s)[0]


@pytest.mark.parametrize("bits", [15, 27])
def test_quotes_of_rows_that_repeat_an_id(spark, bits):
    quotes = [(1, "the standard is whether the care is needed"), (2, "Rehabilitationsmaßnahmen notwendigerweise"), (3, "too short"), (4, "\u201cmedically necessary\u201d means reasonable care"), (None, "the standard is whether the care is needed"), (5, None)]
    texts = [(7, "So THE standard  is\nwhether the care is needed."), (7, "nothing at all"), (7, "So THE standard  is\nwhether the care is needed."), (None, 'x "medically necessary" means reasonable care y'), (8, None), (9, ""), (10, "der Rehabilitationsmaßnahmen notwendigerweise wegen")]
    docs = spark.createDataFrame([(*r, "clash") for r in texts], "doc_id long, text string, _text string").repartition(2)
    got = quoted_by(docs, spark.createDataFrame(quotes, "item_id int, text string"), bits=bits).collect()
    want = []
    for i, t in texts:
        for q, quote in quotes:
            reason, a, b = verify.place_of(quote, t)
            if reason is None:
                want.append((i, q, a, b))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and len(want) == 6


def test_entry_without_a_library(tmp_path):
    """The other queries are there when a library of the training-data operators is not."""
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op1_') for k in e.queries()))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 100 and out[1] == "False"


def test_places_of_plain_text_are_found_without_a_list_of_all(monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdE'’–  \n\t-.") for _ in range(rng.randrange(1, 400))) for _ in range(300)] + ["… aﬁx", "​ zero"]
    asked = 0
    for text in texts:
        hay, places = verify.fold_with_places(text)
        assert hay == verify.fold_each(text)
        for at in {rng.randrange(len(hay)) for _ in range(5)} if hay else ():
            found = verify.place_in(text, hay, at)
            asked += found is not None
            assert found in (None, places[at]) and (found is not None or hay[at] == " " or "…" in text or "​" in text)
    assert asked > 500
    monkeypatch.setattr(verify, "fold_with_places", None)
    assert verify.place_of("the quick brown fox jumps over", "So\n‘the  quick brown fox jumps over’ it") == (None, 4, 35)
