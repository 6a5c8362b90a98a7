"""Passages with what they lie in, checks of intakes, receipts of erasures, host rules, texts of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import numbers, texts, vectors
from docketry.operators import changes, letters, retrieval, spans
from docketry.plans.adapters import view, with_views
from docketry.runtime import table
from docketry.sources import documents


def holding_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every verified holding with its document and its passage."""
    rows = retrieval.holding_passages(view(spark, sf_dir, "holding").where("verified"), view(spark, sf_dir, "source_document"), view(spark, sf_dir, "source_span"))
    return rows.select("holding_id", "citation", "source_type", "url", F.sha2("passage", 256).alias("passage_sha256"))


def fact_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every clinical fact with the passage and the uploaded document that it was taken from."""
    rows = retrieval.fact_passages(view(spark, sf_dir, "clinical_fact"), view(spark, sf_dir, "denial_span"), view(spark, sf_dir, "denial_document"))
    return rows.select("fact_id", "fact_type", "denial_id", "filename", "page", "passage")


def letter_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of each case's denial letter, in order."""
    rows = retrieval.passages_of_kind(view(spark, sf_dir, "denial_span"), view(spark, sf_dir, "denial_document"), "denial_letter")
    return rows.select("denial_id", "place", "span_id", "ordinal", "text")


def intake_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as intakes: their period as a phrase, whether its dates are in order, and whether the sender's address is one of work."""
    k = F.col("o_orderkey")
    first, last = F.when(k % 5 != 0, F.col("o_orderdate")), F.when(k % 7 != 0, F.date_add("o_orderdate", (k % 9 - 4).cast("int")))
    domain = F.element_at(F.array(*map(F.lit, ("Hospital.org", "GMail.com", "clinic.example.com", "proton.me", "gmail.com.example.org"))), (k % 5 + 1).cast("int"))
    mail = F.when(k % 11 != 0, F.concat(F.lit("a."), k.cast("string"), F.lit("@"), domain)).otherwise("nobody")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", numbers.date_range(first, last).alias("period"), numbers.dates_in_order(first, last).alias("in_order"), texts.is_work_email(mail).alias("work_mail")
    )


def erasure_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays when all that hangs off every fifth organization is erased."""
    tables = {n: view(spark, sf_dir, n) for n in ("denial", "draft", "assertion")}
    roots = view(spark, sf_dir, "organization").where("organization_id % 5 = 0").select("organization_id")
    tree = [("denial", "denial_id", None, "organization_id"), ("draft", "draft_id", "denial", "denial_id"), ("assertion", "assertion_id", "draft", "draft_id")]
    counts, _ = changes.erase(tables, tree, roots)
    kept = changes.receipts(counts, F.lit("2024-02-01").cast("timestamp"), F.lit("end of contract"))
    return kept.select("organization_id", F.date_format("erased_at", "yyyy-MM-dd").alias("erased_on"), "reason", *[F.col("tables")[n].alias(f"{n}_rows") for n in tables], "total")


def crawl_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long to wait between two requests to each host, where its rules say so."""
    hosts = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/]+)", 1).alias("host")).distinct()
    k = F.length("host") % 4
    delay = F.when(k == 0, "2").when(k == 1, "0.75 # slowly").when(k == 2, "soon").otherwise("-1")
    files = hosts.select("host", F.concat(F.lit("User-agent: *\nCrawl-delay: "), delay, F.lit("\nDisallow: /x\nUser-agent: other\nCrawl-delay: 9\nUser-agent: *\nCrawl-delay: Infinity"), F.when(k == 0, F.lit("\nCrawl-delay: 1.5")).otherwise("")).alias("body"))
    return documents.crawl_delays(documents.robots_rules(files, "reader"))


def holding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that each holding's vector is made from, by its digest, and the vector's first dimension that is not zero."""
    rows = view(spark, sf_dir, "holding").join(view(spark, sf_dir, "source_span"), "span_id")
    t = vectors.holding_text(F.col("denial_basis"), F.col("service_type"), F.col("text"))
    return rows.select("holding_id", F.length(t).cast("long").alias("chars"), F.sha2(t, 256).alias("text_sha256"))


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of uploaded documents of which some have page breaks."""
    t = F.when(F.col("doc_id") % 3 != 0, F.replace("text", F.lit("\n"), F.lit("\f"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", spans.page_count(t).cast("long").alias("pages"))


def draft_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each draft's ordinals by section, as text."""
    rows = letters.ordinals_by_section(view(spark, sf_dir, "assertion"))
    listed = F.transform(F.array_sort(F.map_entries("sections")), lambda e: F.concat(e["key"], F.lit(":"), F.array_join(e["value"].cast("array<string>"), ",")))
    return rows.select("draft_id", F.array_join(listed, " ").alias("sections"))


def regulation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as regulations in XML: headings alone, tags gone, numeric entities of any length decoded."""
    body = F.concat(F.lit('<?xml version="1.0"?>\n<DIV8><HEAD>Sec. '), F.col("page_id").cast("string"), F.lit("</HEAD><P>A &#0000000233; &#233;&#x; &lt;b&gt; &#99999999999;</P>"), F.lit("<P>"), F.coalesce("url", F.lit("")), F.lit("</P></DIV8>"))
    t = texts.clean_text(texts.regulation_xml_to_text(body))
    return table(spark, sf_dir, "pages").select("page_id", t.alias("text"))


QUERIES = {
    "holding_passages": holding_passages,
    "fact_passages": fact_passages,
    "letter_passages": letter_passages,
    "intake_checks": intake_checks,
    "erasure_receipts": erasure_receipts,
    "crawl_delays": crawl_delays,
    "holding_texts": holding_texts,
    "document_pages": document_pages,
    "draft_sections": draft_sections,
    "regulation_text": regulation_text,
}
ORACLE = {
    "holding_passages": f"""{with_views("holding", "source_document", "source_span")} select holding_id, citation, source_type, url, sha256(text) as passage_sha256
from holding h join source_document d on d.source_document_id = h.source_document_id join source_span s on s.span_id = h.span_id where verified""",
    "fact_passages": f"""{with_views("clinical_fact", "denial_span", "denial_document")} select fact_id, fact_type, denial_id, filename, page, text as passage
from clinical_fact f join denial_span s on s.span_id = f.span_id join denial_document d on d.denial_document_id = s.denial_document_id""",
    "letter_passages": f"""{with_views("denial_span", "denial_document")} select denial_id, row_number() over (partition by denial_id order by ordinal, span_id)::integer as place, span_id, ordinal, text
from denial_span join denial_document using (denial_document_id) where kind = 'denial_letter'""",
    "intake_checks": """with o as (select o_orderkey, case when o_orderkey % 5 <> 0 then o_orderdate::date end as a, case when o_orderkey % 7 <> 0 then o_orderdate::date + (o_orderkey % 9 - 4)::integer end as b from orders)
select o_orderkey, case when a is null and b is null then 'not stated' when a is null then strftime(b, '%Y-%m-%d') when b is null then strftime(a, '%Y-%m-%d')
  else strftime(a, '%Y-%m-%d') || ' to ' || strftime(b, '%Y-%m-%d') end as period, a is null or b is null or a <= b as in_order, o_orderkey % 11 <> 0 and o_orderkey % 5 not in (1, 3) as work_mail from o""",
    "erasure_receipts": f"""{with_views("organization", "denial", "draft", "assertion")}, r as (select organization_id from organization where organization_id % 5 = 0),
d as (select denial_id, organization_id from denial where organization_id in (select organization_id from r)), f as (select draft_id, organization_id from draft join d using (denial_id)),
a as (select assertion_id, organization_id from assertion join f using (draft_id))
select organization_id, '2024-02-01' as erased_on, 'end of contract' as reason, coalesce(x.n, 0) as denial_rows, coalesce(y.n, 0) as draft_rows, coalesce(z.n, 0) as assertion_rows,
  coalesce(x.n, 0) + coalesce(y.n, 0) + coalesce(z.n, 0) as total from r left join (select organization_id, count(*) as n from d group by 1) x using (organization_id)
  left join (select organization_id, count(*) as n from f group by 1) y using (organization_id) left join (select organization_id, count(*) as n from a group by 1) z using (organization_id)""",
    "crawl_delays": """with h as (select distinct regexp_extract(url, '://([^/]+)', 1) as host from pages)
select host, case length(host) % 4 when 0 then 1500 else 750 end::bigint as delay_ms from h where length(host) % 4 < 2""",
    "holding_texts": f"""{with_views("holding", "source_span")}, t as (select holding_id, concat_ws(' ', denial_basis, service_type, text) as t from holding join source_span using (span_id))
select holding_id, length(t) as chars, sha256(t) as text_sha256 from t""",
    "document_pages": "select doc_id, case when doc_id % 3 <> 0 and contains(text, chr(10)) then length(text) - length(replace(text, chr(10), '')) + 1 end as pages from documents",
    "draft_sections": f"""{with_views("assertion")}, s as (select draft_id, section, section || ':' || string_agg(ordinal::varchar, ',' order by ordinal) as s from assertion group by draft_id, section)
select draft_id, string_agg(s, ' ' order by section) as sections from s group by draft_id""",
    "regulation_text": "select page_id, 'Sec. ' || page_id || chr(10) || chr(10) || 'A é é&#x; <b> &#99999999999;' || chr(10) || chr(10) || coalesce(url, '') as text from pages",
}
