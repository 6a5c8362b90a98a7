"""Redaction works shared parts of an expression out once, and masks lines together as it masks each alone."""

from pyspark.sql import functions as F

from docketry.functions import texts
from docketry.operators import governance


def test_an_error_is_parsed_once(spark):
    rows = spark.createDataFrame([('{"message":"m a@b.org","stack":"x\\ny","cause":{"message":"n"}}',)] * 8, "j string")
    found = rows.select(governance.redact_error(F.col("j")).alias("r"))
    assert found.first().r == '{"message":"m [redacted:email]","stack":"x\\ny","cause":{"message":"n"}}'
    text = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert text.count("parse_json") + text.count("parsejson") == 1


def test_lines_together_as_each_alone(spark):
    lines = ["", "mrn", "MRN: AB12", "call 555-123", "4567 or 555-123-4567", "DOB:", "next", "dob 1/2/1999 a@b.org", "ssn 123-45-6789x", "123-45-6789", "x" * 200, "1EG4TE5MK73", "é@b.org", "a@b.", "org", "on 12/31/2020", ""]
    made = [("\n".join(lines[n:] + lines[:n]),) for n in range(len(lines))] + [("",), (None,), ("\n\n",), ("plain",)]
    rows = spark.createDataFrame(made, "t string")
    for most in (3, 12, 40):
        each = F.array_join(F.transform(F.slice(F.split("t", "\n"), 1, most), texts.redact), "\n")
        for r in rows.select(texts.redact_first_lines(F.col("t"), most).alias("found"), each.alias("want")).collect():
            assert r.found == r.want
