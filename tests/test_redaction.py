"""Redaction of free JSON and of errors, against a walk in Python; what principals see."""

import json
import random
import re

from pyspark.sql import functions as F

from docketry.functions.texts import LONG_TEXT, PERSONAL
from docketry.operators import governance

RULES = [(re.compile(p, re.ASCII), f"[redacted:{k}]") for k, p in PERSONAL.items()]


def scrubbed(v):
    for p, label in RULES:
        v = p.sub(label, v)
    return f"[redacted:{len(v)} chars]" if len(v) > LONG_TEXT else v


def clean(v, depth=0):
    if isinstance(v, str):
        return scrubbed(v)
    if not isinstance(v, (list, dict)):
        return v
    if depth >= governance.DEEPEST:
        return "[truncated:depth]"
    if isinstance(v, list):
        more = len(v) - governance.MOST_ITEMS
        return [clean(x, depth + 1) for x in v[: governance.MOST_ITEMS]] + ([f"[+{more} more]"] if more > 0 else [])
    return {k: "[redacted]" if governance.is_sensitive(k) else clean(x, depth + 1) for k, x in v.items()}


def clean_error(v, causes=0):
    out = {}
    for k, x in v.items():
        if k == "name" and isinstance(x, str):
            out[k] = x
        elif k == "message" and isinstance(x, str):
            out[k] = scrubbed(x)
        elif k == "stack" and isinstance(x, str):
            out[k] = "\n".join(scrubbed(line) for line in x.split("\n")[: governance.STACK_LINES])
        elif k == "cause" and isinstance(x, dict) and isinstance(x.get("message"), str):
            out[k] = clean_error(x, causes + 1) if causes < governance.DEEPEST else "[truncated:depth]"
        else:
            out[k] = "[redacted]" if governance.is_sensitive(k) else clean(x, 1)
    return out


def some(rng, depth):
    kind = rng.randrange(9 if depth else 6)
    if kind == 8:
        return [some(rng, depth - 1) for _ in range(rng.choice((0, 2, 33)))] if depth < 3 else [some(rng, depth - 1)]
    if kind > 5:
        return {rng.choice(("a", "né", "E-mail", "Patient_Name", "k\"q", "", "z z")): some(rng, depth - 1) for _ in range(3)}
    return (None, True, rng.randrange(-9, 10**12), 2.5, rng.choice(("", "null", "[null]", "ü\n\t\"q\"\x01", "x" * 200)), f"mail a{rng.randrange(9)}@b.org or 123-45-6789")[kind]


def got(spark, rows, apply):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i long, j string")
    return [r[0] for r in df.select("i", apply(F.col("j")).alias("r")).orderBy("i").select("r").collect()]


def test_json_as_by_a_walk(spark):
    rng = random.Random(5)
    values = [some(rng, 8) for _ in range(200)] + [[[[[[[[1]]]]]]], {"a": {"a": {"a": {"a": {"a": {"a": {"ssn": 1}}}}}}}, [], {}, list(range(40))]
    found = got(spark, [json.dumps(v) for v in values], governance.redact_json)
    assert [json.loads(r) for r in found] == [clean(v) for v in values]


def test_what_is_no_json_is_null(spark):
    assert got(spark, [None, "", "nope", '{"a":1,"a":2}', "NaN"], governance.redact_json) == [None] * 5


def test_redaction_stays_in_the_jvm(spark):
    plan = spark.range(1).select(governance.redact_json(F.lit("{}")), governance.redact_error(F.lit("{}")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "pythonUDF" not in plan


def test_errors_as_by_a_walk(spark):
    deep = {"message": "last 123-45-6789"}
    for n in range(9):
        deep = {"name": f"E{n}", "message": f"m{n} a@b.org", "cause": deep}
    stack = "\n".join(f"at {n} of a{n}@b.org" for n in range(20))
    errors = [
        {"name": "E", "message": "x" * 200, "stack": stack, "row": {"ssn": 1, "n": [1, "a@b.org"]}, "ssn": "q", "code": 5},
        {"cause": {"message": "a@b.org"}}, {"message": "m", "cause": "plain"}, {"message": "m", "cause": {"code": 7}}, {"name": 7, "message": 8, "stack": None}, {}, deep,
    ]
    found = [json.loads(r) for r in got(spark, [json.dumps(e) for e in errors], governance.redact_error)]
    for f, e in zip(found[:4] + found[5:], errors[:4] + errors[5:]):
        assert f == clean_error(e)
    assert found[4] == {"name": "[redacted]", "message": "[redacted]", "stack": None}
    assert got(spark, [None, "no", "5"], governance.redact_error) == [None, None, "5"]


def test_what_principals_see(spark):
    rows = spark.createDataFrame([(1, 5), (1, 6), (2, 7), (None, 9)], "organization_id long, n long")
    who = spark.createDataFrame([("s", True, None), ("a", False, [1, 1, 3]), ("b", False, [2]), ("c", None, [1]), ("d", False, None)], "user_id string, superadmin boolean, scope array<long>")
    seen = sorted(tuple(r) for r in governance.visible_to(rows, who).select("user_id", "organization_id", "n").collect())
    assert seen == [("a", 1, 5), ("a", 1, 6), ("b", 2, 7), ("c", 1, 5), ("c", 1, 6), ("s", 1, 5), ("s", 1, 6), ("s", 2, 7)]
    assert sorted(map(tuple, governance.totals_visible_to(rows, who, ["n"]).collect())) == [("a", 11), ("b", 7), ("c", 11), ("s", 18)]
    assert governance.totals_visible_to(rows.limit(0), who, ["n"]).collect() == [] and governance.visible_to(rows.limit(0), who).collect() == []
