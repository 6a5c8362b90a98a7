"""Source documents: files with their hashes and text, PDF included, catalogs, and rows of open-data exports."""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.functions.texts import clean_text, document_text, strip, upload_format

#: The columns of open-data rows that may hold each field, the first that is there counts.
FIELDS = {
    "citation": ("decision_number", "docket_number", "case_number", "decision_id"),
    "url": ("url", "link", "document_url"),
    "decided": ("decision_date", "date_decided", "date"),
    "title": ("title", "subject", "case_name"),
}
#: Regulation parts and manual chapters that are always in the corpus.
REGULATIONS = (
    ("422", "Medicare Advantage Program"),
    ("409", "Hospital Insurance Benefits, including skilled nursing facility coverage"),
    ("412", "Prospective Payment Systems, including inpatient rehabilitation criteria"),
    ("405", "Federal Health Insurance for the Aged and Disabled, appeals procedures"),
)
MANUALS = (
    ("Ch. 8", "Coverage of Extended Care (SNF) Services Under Hospital Insurance"),
    ("Ch. 1", "Inpatient Hospital Services Covered Under Part A"),
)


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, content, content_hash) of the files below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "content", F.sha2("content", 256).alias("content_hash"))


def uploaded_text(files: DataFrame) -> DataFrame:
    """files with ``format`` and ``text``: PDF by its content streams, anything else as UTF-8."""
    kind = upload_format(F.col("path"), F.col("content"))
    text = F.when(kind == "pdf", pdf_text(F.when(kind == "pdf", F.col("content")))).otherwise(F.make_valid_utf8(F.col("content").cast("string")))
    return files.withColumn("format", kind).withColumn("text", clean_text(text))


def corpus_text(documents: DataFrame) -> DataFrame:
    """documents (source_type, url, content as text) with their clean ``text``."""
    return documents.withColumn("text", document_text(F.col("source_type"), F.col("url"), F.col("content")))


def open_data_rows(rows: DataFrame) -> DataFrame:
    """Citations of an open-data export, whatever its columns are called.

    Blank means missing. Rows without a citation or a url are dropped; a date that is
    none becomes null.
    """
    there = set(rows.columns)

    def first(field: str) -> Column:
        found = [F.nullif(strip(F.col(c).cast("string")), F.lit("")) for c in FIELDS[field] if c in there]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    named = rows.select(*[first(f).alias(f"_{f}") for f in FIELDS]).where(F.col("_citation").isNotNull() & F.col("_url").isNotNull())
    citation = F.when(F.col("_citation").startswith("DAB"), F.col("_citation")).otherwise(F.concat(F.lit("DAB No. "), F.col("_citation")))
    return named.select(
        F.lit("dab_decision").alias("source_type"), citation.alias("citation"), F.coalesce("_title", "_citation").alias("title"), F.col("_url").alias("url"),
        F.try_to_timestamp("_decided").alias("decided_at"),
    )


def read_open_data(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """open_data_rows of JSON files, with columns as strings; later than a date if one is given."""
    names = [c for field in FIELDS.values() for c in field]
    rows = open_data_rows(spark.read.schema(", ".join(f"`{c}` string" for c in names)).json(path))
    return rows.where(F.col("decided_at") > F.lit(since).cast("timestamp")) if since else rows


def catalogs(spark: SparkSession, as_of: str) -> DataFrame:
    """The regulations and manual chapters, at a date."""
    rows = [("regulation", f"42 CFR Part {p}", t, f"https://www.ecfr.gov/api/versioner/v1/full/{as_of}/title-42.xml?part={p}") for p, t in REGULATIONS]
    rows += [("manual", f"Medicare Benefit Policy Manual, {c}", t, None) for c, t in MANUALS]
    return spark.createDataFrame(rows, "source_type string, citation string, title string, url string")


# --- PDF ---

#: Tokens of a content stream: literal strings, numbers, array brackets, operator names.
_TOKEN = re.compile(r"\((?P<string>(?:[^()\\]|\\.)*)\)|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+))|(?P<open>\[)|(?P<close>\])|(?P<name>/?[A-Za-z*'\"][A-Za-z0-9*]*)", re.S)
_ESCAPE = re.compile(r"\\(?:([0-7]{1,3})|(.))", re.S)
_NAMED = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}
_PICTURES = (b"DCTDecode", b"JPXDecode", b"CCITTFaxDecode", b"JBIG2Decode")
#: A kern at least this far back is a space between words.
SPACE_KERN = -180


def _unescape(s: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1], 8)) if m[1] else _NAMED.get(m[2], m[2]), s)


def _inflate(raw: bytes) -> bytes | None:
    for bits in (zlib.MAX_WBITS, -zlib.MAX_WBITS, 32 + zlib.MAX_WBITS):
        try:
            return zlib.decompressobj(bits).decompress(raw)
        except zlib.error:
            pass
    return None


def _contents(data: bytes) -> list[str]:
    """The streams of a file that are neither pictures nor broken, inflated."""
    found = []
    for part in data.split(b"endstream")[:-1]:
        head, mark, raw = part.partition(b"stream")
        if not mark:
            continue
        about = head[head.rfind(b"<<") :] if b"<<" in head else head
        raw = raw.removeprefix(b"\r").removeprefix(b"\n")
        body = _inflate(raw) if b"FlateDecode" in about else None if any(p in about for p in _PICTURES) else raw
        if body:
            found.append(body.decode("latin-1"))
    return found


def _shown(content: str) -> tuple[str, bool]:
    """What a content stream shows, and whether it has an operator that shows text.

    Operands gather until an operator takes them, as a PDF reader does.
    """
    out: list[str] = []
    operands: list[str | float] = []
    shows = False
    for m in _TOKEN.finditer(content):
        if m["string"] is not None:
            operands.append(_unescape(m["string"]))
        elif m["number"] is not None:
            operands.append(float(m["number"]))
        elif m["name"] is not None:
            op, texts = m["name"], [x for x in operands if isinstance(x, str)]
            if op == "TJ":
                texts = [x if isinstance(x, str) else " " for x in operands if isinstance(x, str) or x < SPACE_KERN]
            if op in ("Tj", "TJ", "'"):
                shows = shows or op != "'"
                out += texts
            if op in ("'", "T*", "Td", "TD", "ET"):
                out.append("\n")
            operands = []
    return "".join(out), shows


def text_of_pdf(data: bytes) -> str:
    """The text a PDF shows, with a form feed between content streams; empty if none can be read."""
    pages = [t for t, shows in map(_shown, _contents(data)) if shows and t.strip()]
    text = re.sub(r"\r\n?", "\n", "\f".join(pages))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]{2,}", " ", text))


def pdf_text(content: Column) -> Column:
    @F.pandas_udf("string")
    def apply(files: pd.Series) -> pd.Series:
        return files.map(lambda b: None if b is None else text_of_pdf(bytes(b)))

    return apply(content)


# --- robots.txt ---


def robots_rules(files: DataFrame, agent: str, key: str = "host", body_col: str = "body") -> DataFrame:
    """(key, kind, value, line) of the rules that hold for an agent: those of groups that name it, else of *.

    The group of a line is the last user-agent line before it, found by a running maximum.
    """
    lines = files.select(key, F.posexplode(F.split(F.coalesce(body_col, F.lit("")), r"\r?\n")).alias("_i", "_raw"))
    plain = F.trim(F.regexp_replace("_raw", "#.*$", ""))
    lines = lines.select(key, "_i", F.lower(F.trim(F.split_part(plain, F.lit(":"), F.lit(1)))).alias("kind"), F.trim(F.regexp_replace(plain, "^[^:]*:?", "")).alias("value"))
    lines = lines.where("kind <> ''")
    named = F.when(F.col("value") == "*", "any").when(F.contains(F.lit(agent.lower()), F.lower("value")), "own").otherwise("other")
    upto = Window.partitionBy(key).orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = F.last(F.when(F.col("kind") == "user-agent", named), ignorenulls=True).over(upto)
    rules = lines.withColumn("_group", group)
    own = F.max(F.coalesce(F.col("_group") == "own", F.lit(False))).over(Window.partitionBy(key))
    rules = rules.withColumn("_own", own).where(F.col("_group") == F.when(F.col("_own"), "own").otherwise("any"))
    return rules.where(F.col("kind").isin("allow", "disallow", "crawl-delay") & (F.col("value") != "")).select(key, "kind", "value", F.col("_i").alias("line"))


def crawl_delays(rules: DataFrame, key: str = "host") -> DataFrame:
    """(key, delay_ms) of the rules of robots_rules: the last crawl-delay that is a number of seconds, in milliseconds.

    What is no finite number, is negative, or is more milliseconds than 64 bits hold is no
    delay; a host without any is left out. Rules without a ``line`` count in the order of their delays.
    """
    number = F.when(F.rlike("value", F.lit(r"^[+]?(\d+[.]?\d*|[.]\d+)([eE][+-]?\d+)?$")), F.expr("try_cast(value as double)"))
    millis = F.round(number * 1000).try_cast("long")
    delays = rules.where(F.col("kind") == "crawl-delay").withColumn("_ms", millis).where(F.col("_ms").isNotNull())
    place = F.struct("line", "_ms") if "line" in rules.columns else F.col("_ms")
    return delays.groupBy(key).agg(F.max_by("_ms", place).alias("delay_ms"))


def robots_permit(paths: DataFrame, rules: DataFrame, key: str = "host") -> DataFrame:
    """paths with ``permitted``: the longest matching rule decides, and allowing wins a tie.

    The rules of a host meet each of its paths as one list, so equal rows stay apart.
    """
    listed = rules.where(F.col("kind").isin("allow", "disallow")).groupBy(key).agg(F.collect_set(F.struct("kind", "value")).alias("_rules"))
    fits = lambda kind: F.filter("_rules", lambda r: (r["kind"] == kind) & F.startswith(F.col("path"), r["value"]))
    longest = lambda kind: F.array_max(F.transform(fits(kind), lambda r: F.length(r["value"])))
    d, a = longest("disallow"), F.coalesce(longest("allow"), F.lit(-1))
    return paths.join(listed, key, "left").select(*paths.columns, (d.isNull() | (a >= d)).alias("permitted"))


def new_documents(target: DataFrame, fetched: DataFrame, keep_changed: bool = False) -> DataFrame:
    """fetched documents with ``action``: insert, same (its content is there) or changed (its citation is there).

    Changed documents are not inserted unless keep_changed is set.
    """
    by_hash = target.select("content_hash").distinct().withColumn("_same", F.lit(True))
    by_name = target.select("source_type", "citation").distinct().withColumn("_named", F.lit(True))
    action = F.when(F.col("_same"), "same").when(F.col("_named"), "insert" if keep_changed else "changed").otherwise("insert")
    return fetched.join(by_hash, "content_hash", "left").join(by_name, ["source_type", "citation"], "left").select(*fetched.columns, action.alias("action"))

