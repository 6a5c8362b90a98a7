"""Document text: markup, cleaning, passages, quotes, masking, templates, hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.functions import texts
from docketry.operators import quotes, spans, verify
from docketry.runtime import table
from docketry.sources import contacts, documents


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean text of every page, by its digest."""
    t = texts.clean_text(texts.html_to_text(F.col("html")))
    return table(spark, sf_dir, "pages").select("page_id", F.length(t).cast("long").alias("chars"), F.sha2(t, 256).alias("text_sha256"))


def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = texts.clean_text(F.concat(F.lit("\r\n"), F.replace(F.col("text"), F.lit(". "), F.lit(". \t\r\n\n\n\n")), F.lit("  ")))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce(t, F.lit("")), 256).alias("text_sha256"))


def page_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("page_id") % 3 == 0, "regulation").otherwise("decision")
    return table(spark, sf_dir, "pages").select("page_id", texts.text_format(kind, F.col("url"), F.col("html")).alias("format"))


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with every line a paragraph, a heading first and a page break half way down some."""
    head = F.concat(F.lit("II. Part "), F.col("doc_id").cast("string"), F.lit("\n\nB. About "), F.col("lang"), F.lit("\n\n"))
    body = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n \n"))
    paged = F.when(F.col("doc_id") % 3 == 0, F.concat(body, F.lit("\f"), body)).otherwise(body)
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(head, paged).alias("text"))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Located passages of every document."""
    s = spans.chunks(spans.spanify(_paragraphs(spark, sf_dir), "text", "doc_id"))
    return s.select("doc_id", "ordinal", "page", "char_start", "char_end", F.sha2("text", 256).alias("text_sha256"), F.array_join("heading_path", " > ").alias("headings"), "chunk")


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents that read as headings, by level, with a few made ones in each."""
    made = F.array(F.lit("30.2 - Skilled care"), F.lit("§ 409.31 Level of care."), F.lit("IV. Analysis"), F.lit("C. The criteria"), F.lit("FINDINGS OF FACT"), F.lit("just prose."))
    lines = F.concat(F.split(F.coalesce("text", F.lit("")), "\n"), made)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(lines).alias("line"))
    return rows.withColumn("level", texts.heading_level(F.col("line"))).where("level is not null").groupBy("doc_id").agg(
        F.count_if(F.col("level") == 1).alias("first"), F.count_if(F.col("level") == 2).alias("second")
    )


def redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked documents, each with a last line of made personal data: lines with a label, and a digest of the result."""
    made = "SSN 123-45-6789, DOB: 1/2/1950, call (555) 123-4567 or a.b@c-d.org"
    lines = F.split(F.concat(F.coalesce("text", F.lit("")), F.lit("\n" + made)), "\n")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(texts.redact_lines(lines))).alias("m"))
    return rows.select(
        "doc_id", F.size(F.filter("m", lambda x: x.contains("[redacted:"))).cast("long").alias("masked_lines"),
        F.aggregate("m", F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("chars"), F.sha2(F.array_join("m", "\n"), 256).alias("sha256"),
    )


def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose exact content another document of a smaller id has."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    first = rows.groupBy("content_hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    return rows.join(first.where("copies > 1"), "content_hash").where("doc_id <> first_id").select("doc_id", "first_id", "content_hash")


def quotes_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which benchmark passages each document quotes, whatever its case and spacing."""
    return quotes.quoted_by(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id")


def quote_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against a quote made from it: exact, shouted, with other spaces, changed, or too short."""
    source = texts.replace_many(F.coalesce("text", F.lit("")), r"[^\x20-\x5f\x61-\x7e\n]", "x")
    t = F.col("source")
    q = F.substring(t, 5, 60)
    k = F.col("doc_id") % 5
    quote = F.when(k == 0, q).when(k == 1, F.upper(q)).when(k == 2, F.replace(q, F.lit(" "), F.lit(" \n "))).when(k == 3, F.concat(q, F.lit("~~"))).otherwise(F.substring(t, 5, 20))
    rows = table(spark, sf_dir, "documents").select("doc_id", source.alias("source")).select("doc_id", "source", quote.alias("quote"))
    return rows.select("doc_id", verify.verified_quote(F.col("quote"), F.col("source")).alias("v")).select("doc_id", "v.reason")


def quote_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document holds a quote from its middle; the source has curly quotes, dashes and hard spaces, the quote plain ones."""
    t = F.trim(texts.replace_many(texts.replace_many(F.coalesce("text", F.lit("")), r"[^\x20-\x5f\x61-\x7e\n]", "x"), r"\s+", " "))
    plain = F.replace(F.replace(t, F.lit("an"), F.lit("a'n")), F.lit("er"), F.lit("e-r"))
    source = F.translate(plain, "'-", "\u2019\u2013")
    source = F.replace(source, F.lit(". "), F.lit(".\u00a0"))
    middle = (F.length(plain) / 2).cast("int")
    quote = F.when(F.col("doc_id") % 7 != 0, F.upper(F.substr(plain, middle, F.lit(90)))).otherwise(F.concat(F.substr(plain, middle, F.lit(60)), F.lit("~")))
    rows = table(spark, sf_dir, "documents").select("doc_id", source.alias("source"), quote.alias("quote"))
    return rows.select("doc_id", verify.verified_quote(F.col("quote"), F.col("source")).alias("v")).select("doc_id", "v.*")


def draft_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a language as drafts: accepted only if the quotes of all are verified."""
    checked = quote_checks(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "lang", "source").alias("draft_id")), "doc_id")
    return verify.draft_verdicts(checked).select("draft_id", "ok", "total", "rejected", F.round("failure_rate", 9).alias("failure_rate"))


def normalized_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in the form in which texts are compared; letters beyond ASCII are taken out first."""
    t = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x20-\x5f\x61-\x7e\n\t]", "")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(verify.normalized(t), 256).alias("sha256"))


def campaign_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template filled for every customer, the names in it, and the footer."""
    template = F.lit("Dear {{ first_name }} of {{org_name}}, {{ unknown }} {{title}} {{email}}{{ first_name }}")
    name = F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit(" "), F.substring("c_name", 1, 8), F.lit(" ")))
    values = texts.contact_values(name, F.lit(None).cast("string"), F.lit("  "), F.col("c_mktsegment"), F.lower("c_name"))
    footer = texts.campaign_footer(F.lit("https://example.org"), F.sha2("c_name", 256), F.when(F.col("c_custkey") % 2 == 0, "1 Main Street"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", texts.substitute(template, values).alias("message"), F.array_join(texts.placeholders(template), ",").alias("names"), F.sha2(footer, 256).alias("footer_sha256")
    )


def wrapped_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How turns wrap at 76 characters: the lines, their digest, and the longest."""
    lines = texts.wrap(F.col("text"), 76)
    rows = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", "text", lines.alias("l"))
    longest = F.coalesce(F.array_max(F.transform("l", F.length)), F.lit(0))
    return rows.select("conv_id", "turn", F.size("l").alias("lines"), longest.alias("longest"), F.sha2(F.array_join("l", "\n"), 256).alias("sha256"))


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe names and keys made from urls."""
    name = texts.safe_filename(F.col("url"))
    key = texts.storage_key(F.lit("7"), F.col("page_id").cast("string"), F.lit("eob"), F.sha2("url", 256), F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", name.alias("name"), key.alias("storage_key"))


def chatty_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON in answers that wrap it in prose, fences, or break it."""
    k, p = F.col("event_id") % 4, F.col("props")
    answer = F.when(k == 0, p).when(k == 1, F.concat(F.lit("Sure:\n```json\n"), p, F.lit("\n```\nDone."))).when(k == 2, F.concat(F.lit("Here it is "), p, F.lit(" as asked"))).otherwise(F.lit("none {"))
    return table(spark, sf_dir, "events").select("event_id", texts.embedded_json(answer).alias("json"))


def contact_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV export for each market segment: contacts and complaints in one table."""
    mail = F.when(F.col("c_custkey") % 11 == 0, "").when(F.col("c_custkey") % 13 == 0, "nobody").when(F.col("c_custkey") % 17 == 0, "Same@Example.com").otherwise(F.concat(F.col("c_custkey").cast("string"), F.lit("@Example.com")))
    line = F.concat(F.lit('"'), F.substring("c_name", 1, 8), F.lit(', ""X"""'), F.lit(","), mail, F.lit(","), F.col("c_nationkey").cast("string"))
    rows = table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "file")
    good, bad = contacts.parse_contacts(contacts.export_lines(rows, "file", "c_custkey", line, "Last Name,E-mail,Job Title"))
    kept = good.select("file", "line_no", "email", F.col("last_name").alias("name_or_message"))
    return kept.unionByName(bad.select("file", "line_no", F.lit(None).cast("string").alias("email"), F.col("message").alias("name_or_message")))


def open_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations from rows whose fields have other names from row to row."""
    k = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select(
        F.when(k % 4 == 0, F.concat(F.lit(" DAB"), k.cast("string"))).when(k % 4 == 1, "  ").alias("decision_number"),
        F.when(k % 4 == 1, k.cast("string")).alias("case_number"),
        F.when(k % 5 != 0, F.col("url")).alias("link"),
        F.when(k % 3 == 0, "1999-02-03").when(k % 3 == 1, "not a date").alias("date_decided"),
        F.when(k % 2 == 0, F.lit("A title")).alias("subject"),
    )
    return documents.open_data_rows(rows).withColumn("decided_at", F.date_format("decided_at", "yyyy-MM-dd"))


def uploaded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of uploaded files: documents as they are, and every third one's words as a PDF of one line each."""
    pdf = F.col("doc_id") % 3 == 0
    shown = F.concat(F.lit("BT ("), F.array_join(F.split(_words(), " "), ") Tj T* ("), F.lit(") Tj ET"))
    body = F.concat(F.lit("%PDF-1.4\n1 0 obj << /Length 9 >> stream\n"), shown, F.lit("\nendstream endobj"))
    files = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.when(pdf, body).otherwise(_words()).cast("binary").alias("content"))
    return documents.uploaded_text(files).select("doc_id", "format", F.sha2("text", 256).alias("text_sha256"))


def _words() -> Column:
    return F.trim(texts.replace_many(F.coalesce("text", F.lit("")), "[^A-Za-z0-9]+", " "))


def robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the path of each page is open to an agent under its host's rules."""
    host, path = F.regexp_extract("url", "://([^/]+)", 1), F.concat(F.lit("/"), F.regexp_extract("url", "://[^/]+/([^?]*)", 1))
    pages = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    own = "# rules\nUser-agent: *\nDisallow: /\n\nUser-agent: Reader\nDisallow: /de # not these\nAllow: /de/1\nDisallow: /fr/\nCrawl-delay: 2"
    other = "User-agent: somebody\nDisallow: /\nUser-agent: *\nDisallow: /en/\nAllow: /en/\nDisallow:"
    files = pages.select("host").distinct().select("host", F.when(F.length("host") % 2 == 0, own).otherwise(other).alias("body"))
    return documents.robots_permit(pages, documents.robots_rules(files, "my-reader/1.0")).select("page_id", "path", "permitted")


def latest_of_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happens to fetched pages when every third is known by content and every fifth by citation."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.lit("manual").alias("source_type"), F.concat(F.lit("P-"), F.col("page_id").cast("string")).alias("citation"), F.sha2("html", 256).alias("content_hash"))
    known = pages.where("page_id % 3 = 0 or page_id % 5 = 0")
    old = known.select("source_type", "citation", F.when(F.col("page_id") % 3 == 0, F.col("content_hash")).otherwise(F.lit("other")).alias("content_hash"))
    return documents.new_documents(old, pages).select("page_id", "action")


def speaker_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations numbered without gaps, with the first of each role marked."""
    c = table(spark, sf_dir, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn")
    first = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn")) == 1
    return c.select("conv_id", "turn", F.row_number().over(order).alias("place"), first.alias("first_of_role"))


QUERIES = {
    "html_text": html_text,
    "clean_documents": clean_documents,
    "page_formats": page_formats,
    "passages": passages,
    "headings": headings,
    "redacted_documents": redacted_documents,
    "content_hashes": content_hashes,
    "quotes_in_documents": quotes_in_documents,
    "quote_checks": quote_checks,
    "quote_places": quote_places,
    "draft_verification": draft_verification,
    "normalized_conversations": normalized_conversations,
    "campaign_messages": campaign_messages,
    "wrapped_turns": wrapped_turns,
    "file_names": file_names,
    "chatty_json": chatty_json,
    "contact_imports": contact_imports,
    "open_data": open_data,
    "robots": robots,
    "uploaded_texts": uploaded_texts,
    "fetched_documents": latest_of_hash,
    "speaker_order": speaker_order,
}
_W = r"[\s\x0B]"
_HTML = r"html"
for _p, _r in (
    (r"<script\b.*?</script>", ""), (r"<style\b.*?</style>", ""), (r"</(?:p|div|section|article|li|tr|h[1-6]|blockquote)>", r"\n\n"), (r"<br\s*/?>", r"\n"), (r"<[^>]+>", ""),
):
    _HTML = f"regexp_replace({_HTML}, '(?is){_p}', {'chr(10) || chr(10)' if _r == chr(92) + 'n' + chr(92) + 'n' else 'chr(10)' if _r else chr(39) * 2}, 'g')"
for _e, _c in (("&nbsp;", "' '"), ("&amp;", "'&'"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)")):
    _HTML = f"replace({_HTML}, '{_e}', {_c})"


def _clean(c: str) -> str:
    c = f"regexp_replace({c}, '\\r\\n?', chr(10), 'g')"
    c = f"regexp_replace({c}, '[ \\t]+\\n', chr(10), 'g')"
    c = f"regexp_replace({c}, '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g')"
    return f"regexp_replace({c}, '^[\\s\\x{{0B}}\\x{{A0}}\\x{{FEFF}}]+|[\\s\\x{{0B}}\\x{{A0}}\\x{{FEFF}}]+$', '', 'g')"


# Fixed values, restated for DuckDB: the rules, masks and headings of functions/texts.py.
_MASKS = [
    (r"\b\d{3}-\d{2}-\d{4}\b", "ssn"), (r"(?i)\bMRN[:#\s-]*[A-Z0-9-]{4,}\b", "mrn"), (r"\b[1-9][A-Z][0-9A-Z]\d[A-Z][0-9A-Z]\d[A-Z]{2}\d{2}\b", "medicare-id"),
    (r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b", "email"), (r"\b(?:\+?1[\s.-]?)?\(?\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}\b", "phone"),
    (r"\b(?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12]\d|3[01])[/-](?:19|20)\d{2}\b", "date"), (r"(?i)\bDOB[:\s]*\S+", "dob"),
]
_MASKED = "l"
for _p, _k in _MASKS:
    _MASKED = f"regexp_replace({_MASKED}, '{_p}', '[redacted:{_k}]', 'g')"
_CHECKS = r"""with t as (select doc_id, lang, source, regexp_replace(coalesce(text, ''), '[^\x20-\x5f\x61-\x7e\n]', 'x', 'g') as s from documents),
q as (select *, case doc_id % 5 when 0 then substr(s, 5, 60) when 1 then upper(substr(s, 5, 60)) when 2 then replace(substr(s, 5, 60), ' ', ' ' || chr(10) || ' ')
  when 3 then substr(s, 5, 60) || '~~' else substr(s, 5, 20) end as q from t),
n as (select *, lower(trim(regexp_replace(q, '\s+', ' ', 'g'))) as nq, lower(trim(regexp_replace(s, '\s+', ' ', 'g'))) as ns, regexp_replace(q, '^\s+|\s+$', '', 'g') as tq from q),
v as (select doc_id, lang, source, case when nq = '' then 'empty_quote' when ns = '' then 'source_missing' when length(tq) < 24 then 'quote_too_short'
  when contains(ns, nq) then null else 'not_found_in_source' end as reason from n)"""
#: Passages by windows over blocks: where each begins, its page, and the last headings above it.
_PASSAGES = f"""with d as (select doc_id, 'II. Part ' || doc_id || e'\\n\\nB. About ' || lang || e'\\n\\n' as head, replace(coalesce(text, ''), chr(10), e'\\n \\n') as body from documents),
t as (select doc_id, head || body || case when doc_id % 3 = 0 then chr(12) || body else '' end as t from d),
s as (select doc_id, contains(t, chr(12)) as paged, string_split_regex(t, '\\f|\\n[ \\t]*\\n+') as blocks, regexp_extract_all(t, '\\f|\\n[ \\t]*\\n+') as seps from t),
b as (select doc_id, paged, i, blocks[i] as block, seps[i] as sep from (select *, unnest(range(1, len(blocks) + 1)) as i from s)),
p as (select doc_id, i, block, regexp_replace(regexp_replace(block, '^[{spans.WHITE}]+', ''), '[{spans.WHITE}]+$', '') as body, length(block) - length(regexp_replace(block, '^[{spans.WHITE}]+', '')) as lead,
  coalesce(sum(length(block) + coalesce(length(sep), 0)) over above, 0) as pos, case when paged then 1 + coalesce(count_if(sep = chr(12)) over above, 0) end as page
  from b window above as (partition by doc_id order by i rows between unbounded preceding and 1 preceding)),
l as (select *, case when length(body) between 1 and {texts.LONGEST_HEADING} then case {" ".join(f"when regexp_full_match(body, '{spans.exact(form).replace(chr(39), chr(39) * 2)}') then {level}" for level, form in texts.HEADINGS)} end end as level from p),
h as (select *, max(case when level = 1 then i end) over above as i1, max(case when level = 2 then i end) over above as i2, last_value(case when level = 1 then body end ignore nulls) over above as h1,
  last_value(case when level = 2 then body end ignore nulls) over above as h2 from l window above as (partition by doc_id order by i rows between unbounded preceding and current row)),
n as (select *, row_number() over (partition by doc_id order by i) as ordinal from h where level is null and length(body) >= {spans.LEAST_SPAN})
select doc_id, ordinal::integer as ordinal, page::integer as page, (pos + lead)::integer as char_start, (pos + lead + length(body))::integer as char_end, sha256(body) as text_sha256,
  concat_ws(' > ', h1, case when i2 > coalesce(i1, 0) then h2 end) as headings, ((ordinal - 1) // 25)::integer as chunk from n"""
ORACLE = {
    "uploaded_texts": r"""with w as (select doc_id, trim(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g')) as w from documents)
select doc_id, case when doc_id % 3 = 0 then 'pdf' else 'text' end as format, sha256(case when doc_id % 3 = 0 then replace(w, ' ', chr(10)) else w end) as text_sha256 from w""",
    "passages": _PASSAGES,
    "html_text": f"with t as (select page_id, {_clean(_HTML)} as t from pages) select page_id, length(t) as chars, sha256(t) as text_sha256 from t",
    "clean_documents": "select doc_id, sha256(coalesce("
    + _clean("chr(13) || chr(10) || replace(text, '. ', '. ' || chr(9) || chr(13) || chr(10) || chr(10) || chr(10) || chr(10)) || '  '")
    + ", '')) as text_sha256 from documents",
    "page_formats": "select page_id, case when page_id % 3 = 0 or ends_with(url, '.xml') then 'xml' when regexp_matches(substr(html, 1, 2000), '(?i)<html|<body|<div') then 'html' else 'text' end as format from pages",
    "headings": r"""with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10)) || ['30.2 - Skilled care', '§ 409.31 Level of care.', 'IV. Analysis', 'C. The criteria', 'FINDINGS OF FACT', 'just prose.']) as l from documents),
t as (select doc_id, regexp_replace(l, '^[\s\x{0B}\x{A0}\x{FEFF}]+|[\s\x{0B}\x{A0}\x{FEFF}]+$', '', 'g') as t from l),
v as (select doc_id, case when length(t) not between 1 and 120 then null when regexp_matches(t, '^\d{1,3}([.]\d{1,3})?\s*[-–—]\s*\S.{0,110}$') or regexp_matches(t, '^§+\s*\d+[.]\d+.{0,110}$')
  or regexp_matches(t, '^[IVXLC]{1,6}[.]\s+\S.{0,110}$') then 1 when regexp_matches(t, '^[A-Z][.]\s+\S.{0,110}$') then 2 when regexp_matches(t, '^[A-Z][A-Z\s,''()-]{3,60}$') then 1 end as level from t)
select doc_id, count(*) filter (where level = 1) as first, count(*) filter (where level = 2) as second from v where level is not null group by doc_id""",
    "redacted_documents": f"""with s as (select doc_id, string_split(coalesce(text, '') || chr(10) || 'SSN 123-45-6789, DOB: 1/2/1950, call (555) 123-4567 or a.b@c-d.org', chr(10)) as a from documents), u as (select doc_id, unnest(range(len(a))) as line_no, unnest(a) as line from s),
m as (select doc_id, line_no, line as l from u),
r as (select doc_id, line_no, {_MASKED} as r from m), f as (select doc_id, line_no, case when length(r) > 160 then '[redacted:' || length(r) || ' chars]' else r end as r from r)
select doc_id, count(*) filter (where contains(r, '[redacted:')) as masked_lines, sum(length(r))::bigint as chars, sha256(string_agg(r, chr(10) order by line_no)) as sha256 from f group by doc_id""",
    "content_hashes": """with h as (select doc_id, sha256(coalesce(text, '')) as content_hash from documents), f as (select *, min(doc_id) over (partition by content_hash) as first_id from h)
select doc_id, first_id, content_hash from f where doc_id <> first_id""",
    "quotes_in_documents": r"""with d as (select doc_id, lower(regexp_replace(text, '\s+', ' ', 'g')) as t from documents), b as (select item_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) as t from benchmark)
select doc_id, item_id from b join d on contains(d.t, b.t) where length(b.t) >= 24""",
    "quote_checks": _CHECKS + " select doc_id, reason from v",
    "quote_places": r"""with t as (select doc_id, replace(replace(trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20-\x5f\x61-\x7e\n]', 'x', 'g'), '\s+', ' ', 'g')), 'an', 'a''n'), 'er', 'e-r') as s from documents),
q as (select doc_id, lower(s) as s, lower(trim(case when doc_id % 7 <> 0 then substr(s, length(s) // 2, 90) else substr(s, length(s) // 2, 60) || '~' end)) as q from t),
r as (select *, case when q = '' then 'empty_quote' when s = '' then 'source_missing' when length(q) < 24 then 'quote_too_short' when not contains(s, q) then 'not_found_in_source' end as reason from q)
select doc_id, reason, case when reason is null then instr(s, q) - 1 end::integer as char_start, case when reason is null then instr(s, q) - 1 + length(q) end::integer as char_end from r""",
    "draft_verification": _CHECKS + """ select concat_ws('/', lang, source) as draft_id, count(reason) = 0 as ok, count(*) as total, count(reason) as rejected,
  round(count(reason) / count(*)::double, 9) as failure_rate from v group by 1""",
    "normalized_conversations": r"""select conv_id, turn, sha256(lower(trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20-\x5f\x61-\x7e\n\t]', '', 'g'), '\s+', ' ', 'g')))) as sha256 from conversations""",
    "campaign_messages": """select c_custkey, 'Dear ' || case when c_custkey % 3 <> 0 then substr(c_name, 1, 8) else 'there' end || ' of ' || c_mktsegment || ', {{ unknown }} your role ' || lower(c_name)
  || case when c_custkey % 3 <> 0 then substr(c_name, 1, 8) else 'there' end as message, 'first_name,org_name,unknown,title,email' as names,
  sha256(chr(10) || chr(10) || '---' || chr(10) || 'To stop receiving these, unsubscribe here: https://example.org/unsubscribe/' || sha256(c_name) || chr(10) || case when c_custkey % 2 = 0 then '1 Main Street' else '' end) as footer_sha256 from customer""",
    "wrapped_turns": r"""with w as (select conv_id, turn, list_filter(regexp_split_to_array(text, '[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+'), lambda x: x <> '') as w
  from conversations where text is not null), j as (select conv_id, turn, case when len(w) = 0 then '' else list_reduce(w, lambda a, x:
  case when length(string_split(a, chr(10))[-1]) + 1 + length(x) <= 76 then a || ' ' || x else a || chr(10) || x end) end as t from w)
select conv_id, turn, case when t = '' then 0 else len(string_split(t, chr(10))) end::integer as lines, list_max(list_transform(string_split(t, chr(10)), lambda x: length(x)))::integer as longest, sha256(t) as sha256 from j""",
    "file_names": r"""with n as (select page_id, url, substr(regexp_replace(regexp_extract(url, '([^/\\]*)$', 1), '[^A-Za-z0-9._-]', '_', 'g'), 1, 120) as n from pages), s as (select page_id, url, case when n = '' then 'document' else n end as name from n)
select page_id, name, 'org/7/denial/' || page_id || '/eob/' || sha256(url) || '-' || name as storage_key from s""",
    "chatty_json": "select event_id, case when event_id % 4 < 3 then props end as json from events",
    "contact_imports": """with l as (select c_mktsegment as file, 1 + row_number() over (partition by c_mktsegment order by c_custkey) as line_no, substr(c_name, 1, 8) || ', "X"' as last_name,
  case when c_custkey % 11 = 0 then null when c_custkey % 13 = 0 then 'nobody' when c_custkey % 17 = 0 then 'same@example.com' else c_custkey || '@example.com' end as email from customer),
n as (select *, row_number() over (partition by file, email order by line_no) as n from l)
select file, line_no::integer as line_no, case when email like '%@%' and n = 1 then email end as email, case when email is null then 'Row ' || line_no || ': no email, skipped.'
  when email = 'nobody' then 'Row ' || line_no || ': nobody is not an email address, skipped.' when n > 1 then 'Row ' || line_no || ': ' || email || ' appears more than once, kept the first.' else last_name end as name_or_message from n""",
    "open_data": """select 'dab_decision' as source_type, case page_id % 4 when 0 then 'DAB' || page_id else 'DAB No. ' || page_id end as citation,
  case when page_id % 2 = 0 then 'A title' when page_id % 4 = 1 then page_id::varchar end as title, url, case when page_id % 3 = 0 then '1999-02-03' end as decided_at
from pages where page_id % 4 in (0, 1) and page_id % 5 <> 0""",
    "robots": """with p as (select page_id, regexp_extract(url, '://([^/]+)', 1) as host, '/' || regexp_extract(url, '://[^/]+/([^?]*)', 1) as path from pages)
select page_id, path, case when length(host) % 2 = 0 then not (starts_with(path, '/fr/') or starts_with(path, '/de') and not starts_with(path, '/de/1')) else true end as permitted from p""",
    "fetched_documents": """with p as (select page_id, sha256(html) as h from pages), k as (select distinct h from p where page_id % 3 = 0)
select page_id, case when h in (select h from k) then 'same' when page_id % 3 = 0 or page_id % 5 = 0 then 'changed' else 'insert' end as action from p""",
    "speaker_order": """select conv_id, turn, row_number() over (partition by conv_id order by turn)::integer as place, row_number() over (partition by conv_id, role order by turn) = 1 as first_of_role from conversations""",
}
