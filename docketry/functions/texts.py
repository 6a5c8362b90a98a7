"""Text cleaning, markup removal, normalising, masking and templates as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as JavaScript and Unicode-aware readers see it.
SPACE = r"[\s\x0B\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def _replace_all(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda x, rule: F.regexp_replace(x, *rule), rules, c)


def replace_many(c: Column, form: str, to: str) -> Column:
    """regexp_replace for forms that match all over a text, in Arrow batches: Spark's own takes long over each match.

    The form is one that Java and RE2 read alike; ``to`` is taken as it is.
    """

    @F.arrow_udf("string")
    def apply(texts: pa.Array) -> pa.Array:
        return pc.replace_substring_regex(texts, pattern=form, replacement=to.replace("\\", "\\\\"))

    return apply(c)


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


#: What cleaning, HTML and regulations in XML are rewritten by, each in the order in which it is applied.
CLEANING = [(r"\r\n?", "\n"), (r"[ \t]+\n", "\n"), (r"\n{4,}", "\n\n\n")]
HTML_RULES = [
    (r"(?is)<script\b.*?</script>", ""),
    (r"(?is)<style\b.*?</style>", ""),
    (r"(?i)</(?:p|div|section|article|li|tr|h[1-6]|blockquote)>", "\n\n"),
    (r"(?i)<br\s*/?>", "\n"),
    (r"<[^>]+>", ""),
    ("&nbsp;", " "),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
]
XML_RULES = [
    (r"(?s)<\?xml.*?\?>", ""),
    (r"(?is)<HEAD>(.*?)</HEAD>", "\n\n$1\n\n"),
    (r"(?i)</(?:P|DIV\d?|SECTION|HEAD)>", "\n\n"),
    (r"<[^>]+>", ""),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
]


def clean_text(raw: Column) -> Column:
    """One kind of line end, no blanks before it, at most two empty lines in a row, no white space around."""
    return strip(_replace_all(raw, CLEANING))


def decode_numeric_entities(c: Column) -> Column:
    """&#233; as its character; code points beyond Unicode stay as they are.

    The text is cut at its entities, each of which is decoded once, so the work is in
    proportion to its length.
    """
    entity = r"&#(\d+);"
    gaps, codes = F.split(c, entity), F.regexp_extract_all(c, F.lit(entity), 1)
    beyond = "1114112"
    digits = F.transform(codes, lambda code: F.regexp_replace(code, r"^0+(?=\d)", ""))
    numbers = F.transform(digits, lambda d: F.when(F.length(d) <= 7, d).otherwise(beyond).cast("int"))

    def char(n: Column, code: Column) -> Column:
        octet = lambda x: F.lpad(F.hex(x), 2, "0")
        low = lambda shift: octet(F.lit(0x80) + F.shiftright(n, shift).bitwiseAND(F.lit(0x3F)))
        utf8 = (
            F.when(n < 0x80, octet(n))
            .when(n < 0x800, F.concat(octet(F.lit(0xC0) + F.shiftright(n, 6)), low(0)))
            .when(n < 0x10000, F.concat(octet(F.lit(0xE0) + F.shiftright(n, 12)), low(6), low(0)))
            .otherwise(F.concat(octet(F.lit(0xF0) + F.shiftright(n, 18)), low(12), low(6), low(0)))
        )
        known = (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        return F.when(known, F.unhex(utf8).cast("string")).otherwise(F.concat(F.lit("&#"), code, F.lit(";")))

    return F.when(c.contains("&#"), _woven(gaps, F.zip_with(numbers, codes, char))).otherwise(c)


def _woven(gaps: Column, between: Column) -> Column:
    """The gaps of a text with what stands between them."""
    return F.array_join(F.zip_with(gaps, between, lambda g, x: F.concat(g, F.coalesce(x, F.lit("")))), "")


def html_to_text(html: Column) -> Column:
    """Markup gone, the ends of blocks as empty lines, entities decoded; not yet cleaned."""
    return decode_numeric_entities(_replace_all(html, HTML_RULES))


def regulation_xml_to_text(xml: Column) -> Column:
    """Like HTML, for regulations in XML: headings stand alone, fewer entities are known."""
    return decode_numeric_entities(_replace_all(xml, XML_RULES))


def text_format(source_type: Column, url: Column, text: Column) -> Column:
    """xml, html or text by kind of source and url, else by tags in the first 2000 characters."""
    return (
        F.when((source_type == "regulation") | url.endswith(".xml"), "xml")
        .when(F.substring(text, 1, 2000).rlike("(?i)<html|<body|<div"), "html")
        .otherwise("text")
    )


def document_text(source_type: Column, url: Column, text: Column) -> Column:
    """Clean text of a source document whatever its format."""
    kind = text_format(source_type, url, text)
    return clean_text(F.when(kind == "xml", regulation_xml_to_text(text)).when(kind == "html", html_to_text(text)).otherwise(text))


def upload_format(name: Column, content: Column) -> Column:
    """pdf by file name or by the first bytes of the content, else text."""
    return F.when(F.lower(name).endswith(".pdf") | (F.substring(content, 1, 5) == F.lit(b"%PDF-")), "pdf").otherwise("text")


LONGEST_HEADING = 120
#: What reads as a heading, with its level; the first form that fits decides.
HEADINGS = [
    (1, r"\d{1,3}(?:\.\d{1,3})?\s*[-–—]\s*\S.{0,110}"),
    (1, r"§+\s*\d+\.\d+.{0,110}"),
    (1, r"[IVXLC]{1,6}\.\s+\S.{0,110}"),
    (2, r"[A-Z]\.\s+\S.{0,110}"),
    (1, r"[A-Z][A-Z\s,'()-]{3,60}"),
]


def heading_level(line: Column) -> Column:
    """1 or 2 for lines that read as headings, else null."""
    line = strip(line)
    forms = [F.when(line.rlike(f"^{form}$"), level) for level, form in HEADINGS]
    return F.when(F.length(line).between(1, LONGEST_HEADING), F.coalesce(*forms))


#: What identifies a person, by label, in the order in which it is masked.
PERSONAL = {
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "mrn": r"(?i)\bMRN[:#\s-]*[A-Z0-9-]{4,}\b",
    "medicare-id": r"\b[1-9][A-Z][0-9A-Z]\d[A-Z][0-9A-Z]\d[A-Z]{2}\d{2}\b",
    "email": r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b",
    "phone": r"\b(?:\+?1[\s.-]?)?\(?\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}\b",
    "date": r"\b(?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12]\d|3[01])[/-](?:19|20)\d{2}\b",
    "dob": r"(?i)\bDOB[:\s]*\S+",
}
#: What every match of a mask holds; cheap to look for.
CORE = {
    "ssn": r"\d-\d{2}-\d", "mrn": "(?i)mrn", "medicare-id": r"[1-9][A-Z][0-9A-Z]\d[A-Z]", "email": "@",
    "phone": r"\d{3}[\s.-]\d{4}", "date": r"[/-](?:19|20)\d{2}", "dob": "(?i)dob",
}
LONG_TEXT = 160
#: An edge between ASCII letters, digits or underscores and anything else; Java's own edge
#: also knows other letters on some versions.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of c, which is worked out once however often it is used: Spark shares nothing inside lambdas."""
    return F.get(F.transform(F.array(c), use), 0)


def _marked(c: Column, name: str) -> Column:
    return F.regexp_replace(c, PERSONAL[name].replace(r"\b", EDGE), f"[redacted:{name}]")


def _mask(lines: Column, name: str) -> Column:
    return F.transform(lines, lambda x: F.when(x.rlike(CORE[name]), _marked(x, name)).otherwise(x))


def _masked(lines: Column) -> Column:
    """Personal data of each line masked; a mask's costly edges are looked for only where its core is."""
    return reduce(_mask, PERSONAL, lines)


def _masked_lines(text: Column) -> Column:
    """A text whose lines are masked each by itself: those masks are at work whose cores the text holds.

    A core that is not in the text comes into it by no mask: no mark holds another's core.
    What a mask without white space finds lies in one line.
    """

    def step(text: Column, n: int, name: str, has: Column) -> Column:
        by_line = lambda x: F.array_join(_mask(F.split(x, "\n"), name), "\n")
        apart = r"\s" in PERSONAL[name] or r"\S" in PERSONAL[name]
        return once(text, lambda x: F.when(F.get(has, n), by_line(x) if apart else _marked(x, name)).otherwise(x))

    cores = lambda x: F.array(*[x.rlike(core) for core in CORE.values()])
    steps = lambda x, has: reduce(lambda done, at: step(done, *at, has), enumerate(CORE), x)
    return once(text, lambda x: once(cores(x), lambda has: steps(x, has)))


def mask_personal(c: Column) -> Column:
    return F.get(_masked(F.array(c)), 0)


def _short(m: Column) -> Column:
    return F.when(F.length(m) > LONG_TEXT, F.concat(F.lit("[redacted:"), F.length(m).cast("string"), F.lit(" chars]"))).otherwise(m)


def redact_lines(lines: Column) -> Column:
    """Personal data masked in place; lines that are still long are replaced by their lengths."""
    return F.transform(_masked(lines), _short)


def redact_first_lines(text: Column, most: int) -> Column:
    """The first lines of a text, each redacted as ``redact`` does."""
    first = F.array_join(F.slice(F.split(text, "\n"), 1, most), "\n")
    return F.array_join(F.transform(F.split(_masked_lines(first), "\n"), _short), "\n")


def redact(c: Column) -> Column:
    """One text, redacted as a line is."""
    return F.get(redact_lines(F.array(c)), 0)


PLACEHOLDER = r"\{\{\s*([a-z_]+)\s*\}\}"


def substitute(template: Column, values: Mapping[str, Column]) -> Column:
    """{{ name }} filled in; names without a value stay. Values are never read as templates."""
    gaps, names = F.split(template, PLACEHOLDER), F.regexp_extract_all(template, F.lit(PLACEHOLDER), 1)
    whole = F.regexp_extract_all(template, F.lit(PLACEHOLDER), 0)
    known = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.coalesce(v, F.lit("")))])
    filled = F.zip_with(names, whole, lambda name, as_is: F.coalesce(F.element_at(known, name), as_is))
    return _woven(gaps, filled)


#: What stands in a message for what is not known of its reader, and its last lines.
UNKNOWN = {"first_name": "there", "last_name": "", "title": "your role", "org_name": "your organisation"}
FOOTER_RULE, FOOTER_LINK, FOOTER_PATH = "\n\n---\n", "To stop receiving these, unsubscribe here: ", "/unsubscribe/"


def contact_values(first_name: Column, last_name: Column, title: Column, org_name: Column, email: Column) -> dict[str, Column]:
    """The values of campaign templates, with neutral words for what is missing."""
    known = {"first_name": first_name, "last_name": last_name, "title": title, "org_name": org_name}
    return {k: F.coalesce(F.nullif(strip(c), F.lit("")), F.lit(UNKNOWN[k])) for k, c in known.items()} | {"email": email}


def placeholders(template: Column) -> Column:
    """Distinct names in a template in the order in which they first appear."""
    return F.array_distinct(F.regexp_extract_all(template, F.lit(PLACEHOLDER), 1))


def campaign_footer(base_url: Column, token: Column, address: Column) -> Column:
    """The lines every campaign message ends with."""
    link = F.concat(F.lit(FOOTER_RULE + FOOTER_LINK), base_url, F.lit(FOOTER_PATH), token)
    return F.concat(link, F.lit("\n"), F.coalesce(address, F.lit("")))


def wrap(c: Column, width: int = 76) -> Column:
    """Lines of at most width characters, broken between words; longer words stand alone.

    Words are put one space apart; then each line is the longest stretch of at most width
    characters that ends with a word, found by one pass of a pattern that looks back no further than a line.
    """
    words = F.trim(F.regexp_replace(c, SPACE + "+", " "))
    return F.regexp_extract_all(words, F.lit(rf"(?s)[^ ].{{0,{width - 1}}}(?= |\z)|[^ ]+"), F.lit(0))


def safe_filename(name: Column) -> Column:
    """The last part of a path with plain characters only, at most 120 of them."""
    base = F.regexp_extract(name, r"([^/\\]*)$", 1)
    plain = F.substring(F.regexp_replace(base, r"[^A-Za-z0-9._-]", "_"), 1, 120)
    return F.coalesce(F.nullif(plain, F.lit("")), F.lit("document"))


def storage_key(organization: Column, case: Column, kind: Column, token: Column, name: Column) -> Column:
    """Where an uploaded document is kept."""
    return F.concat_ws("/", F.lit("org"), organization, F.lit("denial"), case, kind, F.concat(token, F.lit("-"), safe_filename(name)))


def spoken(label: Column) -> Column:
    """snake_case as words."""
    return F.replace(label, F.lit("_"), F.lit(" "))


def first_name(name: Column) -> Column:
    return F.split_part(name, F.lit(" "), F.lit(1))


def is_email(c: Column) -> Column:
    return c.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")


#: Domains of mail for everybody, from which no request for a demonstration is taken.
CONSUMER_MAIL = ("gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "aol.com", "icloud.com", "proton.me", "protonmail.com", "live.com", "msn.com")


def is_work_email(c: Column) -> Column:
    """An address whose domain is not one of mail for everybody, whatever its case."""
    return is_email(c) & ~F.lower(F.regexp_extract(c, "@([^@]*)$", 1)).isin(*CONSUMER_MAIL)


def term_hits(text: Column, terms: Sequence[str]) -> Column:
    """How many of the terms a text holds, whatever their case."""
    low = F.lower(text)
    return sum((low.contains(t.lower()).cast("int") for t in terms), F.lit(0))


def embedded_json(c: Column) -> Column:
    """The JSON in a chatty answer: of a fenced block or the whole text, as it is or from the
    first bracket to the last; null if neither parses."""
    c = strip(c)
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(c.rlike(r"(?s)```(?:json)?\s*.*?```"), strip(fenced)).otherwise(c)
    inner = F.regexp_extract(body, r"(?s)([\[{].*[\]}])", 1)
    valid = lambda x: F.try_parse_json(x).isNotNull()
    return F.when(valid(body), body).when(valid(inner), inner)
