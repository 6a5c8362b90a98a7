"""Drafts, assertions, exports and letters; corpus health; the backlogs of document stages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.texts import spoken
from docketry.operators import changes, letters, workflow
from docketry.operators.verify import source_kind_fits
from docketry.plans.adapters import SECTIONS, text, view, with_views
from docketry.plans.reporting import moment, verdict_sql


def current_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.current_drafts(view(spark, sf_dir, "draft")).select("denial_id", "draft_id", "version", "status")


def next_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.next_versions(view(spark, sf_dir, "denial"), view(spark, sf_dir, "draft"))


def export_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every draft against its own case, and against the next one, which must fail."""
    drafts, cases = view(spark, sf_dir, "draft"), view(spark, sf_dir, "denial")
    requests = drafts.select((F.col("denial_id") + F.col("draft_id") % 2).alias("denial_id"), "draft_id")
    return workflow.export_checks(requests, cases, drafts, view(spark, sf_dir, "review_action"))


def transition_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each case may go to the next stage or back to drafting."""
    verdict = workflow.latest_verdicts(view(spark, sf_dir, "review_action"))
    drafts = workflow.current_drafts(view(spark, sf_dir, "draft")).select("denial_id", "draft_id").join(verdict, "draft_id", "left")
    rows = view(spark, sf_dir, "denial").join(drafts, "denial_id", "left").join(view(spark, sf_dir, "outcome").select("denial_id", "result"), "denial_id", "left")
    rows = rows.withColumn("to_status", F.explode(F.array(*map(F.lit, ("approved", "decided", "ready_for_generation")))))
    error = workflow.transition_error(F.col("status"), F.col("to_status"), F.coalesce("both", F.lit(False)), F.col("result").isNotNull())
    return rows.select("denial_id", "to_status", error.alias("error"))


def superseded_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts by status after every tenth case got a new one."""
    drafts, cases = view(spark, sf_dir, "draft"), view(spark, sf_dir, "denial").where("denial_id % 10 = 0")
    new = workflow.next_versions(cases, drafts).select(
        (F.col("denial_id") * 10 + F.col("next_version")).alias("draft_id"), "denial_id", F.col("next_version").alias("version"),
        F.lit("ready").alias("status"), F.lit(0).cast("long").alias("gap_count"), F.lit("1998-01-01").cast("timestamp").alias("created_at"),
    )
    return workflow.supersede(drafts, new).groupBy("status").agg(F.count("*").alias("drafts"), F.max("version").alias("newest"))


def assertion_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each draft's ordinals by section, sections in the order of a letter."""
    placed = letters.in_letter_order(view(spark, sf_dir, "assertion"))
    grouped = placed.groupBy("draft_id", "section", "heading").agg(F.min("place").alias("first_place"), F.sort_array(F.collect_list("ordinal")).alias("o"))
    return grouped.select("draft_id", "section", "heading", "first_place", F.array_join(F.col("o").cast("array<string>"), ",").alias("ordinals"))


def citation_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return letters.citation_numbers(view(spark, sf_dir, "assertion")).select("draft_id", "source_kind", "source_id", "citation", "first_ordinal")


def resolved_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that every assertion rests on, whichever table it lies in; null where there is none."""
    from docketry.operators.verify import source_texts

    named = lambda df, key, out: df.select(key, out)
    holdings = view(spark, sf_dir, "holding").select("holding_id", F.concat_ws(" ", "denial_basis", "service_type").alias("t"))
    spans = named(view(spark, sf_dir, "source_span"), "span_id", "heading")
    facts = view(spark, sf_dir, "contact").select("contact_id", "full_name")
    a = view(spark, sf_dir, "assertion").withColumn("source_id", F.col("source_id").cast("string"))
    rows = a.join(source_texts(holdings, spans, facts), ["source_kind", "source_id"], "left")
    return rows.select("assertion_id", "source_kind", "source_id", "source_text", source_kind_fits(F.col("kind"), F.col("source_kind")).alias("fits"))


def letters_of_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letter of every ready draft, as its digest and number of lines."""
    drafts = view(spark, sf_dir, "draft").where("status = 'ready'").select("draft_id", "denial_id")
    org = view(spark, sf_dir, "organization").select("organization_id", F.col("name").alias("organization_name"))
    head = drafts.join(view(spark, sf_dir, "denial"), "denial_id").join(org, "organization_id").select(
        "draft_id", "organization_name", F.lit("1998-01-01").alias("today"), "payer_name", "internal_ref", "service_type", F.lit("not stated").alias("service_dates"),
        F.col("claim_cents").cast("string").alias("claim_amount"), F.date_format("deadline", "yyyy-MM-dd").alias("deadline"),
    )
    a = view(spark, sf_dir, "assertion").join(drafts.select("draft_id"), "draft_id").select(
        "draft_id", "section", "ordinal", F.col("body").alias("text"), "source_kind", "source_id", spoken(F.col("source_kind")).alias("label"),
        F.lit("").alias("detail"), F.lit(None).cast("string").alias("url"), F.concat(F.lit("quoted words of source "), F.col("source_id").cast("string")).alias("verbatim_quote"),
    )
    done = letters.letter_texts(head, a)
    return done.select("draft_id", F.sha2("letter", 256).alias("letter_sha256"), F.size(F.split("letter", "\n")).cast("long").alias("lines"))


def corpus_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus in (measure, key, value) rows: totals, counts by null-able facets, rates."""
    h = view(spark, sf_dir, "holding")
    row = lambda m, k, v: F.struct(F.lit(m).alias("measure"), k.alias("key"), v.cast("double").alias("value"))
    total, verified, embedded = F.count("*"), F.count_if("verified"), F.count_if("embedded")
    rate = lambda part, whole: F.when(whole == 0, 0.0).otherwise(F.round(part / whole, 6))
    none = F.lit(None).cast("string")
    totals = h.agg(
        F.array(
            row("holdings", none, total), row("verified", none, verified), row("embedded", none, embedded),
            row("unverified_rate", none, rate(total - verified, total)), row("embedding_coverage", none, rate(embedded, verified)),
        ).alias("r")
    )
    by = [h.where("verified").groupBy(c).agg(F.count("*").alias("n")).select(F.array(row(f"by_{c}", F.col(c), F.col("n"))).alias("r")) for c in ("service_type", "denial_basis")]
    docs = view(spark, sf_dir, "source_document").groupBy("source_type").agg(F.count("*").alias("n"), F.max("retrieved_day").alias("last"))
    by.append(docs.select(F.array(row("documents", F.col("source_type"), F.col("n")), row("last_retrieved", F.col("source_type"), F.col("last"))).alias("r")))
    return reduce(DataFrame.unionByName, by, totals).select(F.explode("r").alias("r")).select("r.*")


def stage_backlogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much each document stage has before it."""
    d, h = view(spark, sf_dir, "source_document"), view(spark, sf_dir, "holding")
    spans = view(spark, sf_dir, "source_span").select("source_document_id").distinct()
    count = lambda df, name: df.agg(F.count("*").alias("pending")).select(F.lit(name).alias("stage"), "pending")
    return reduce(
        DataFrame.unionByName,
        [
            count(d.where("not parsed"), "parse"),
            count(d.where("parsed and not extracted").join(spans, "source_document_id", "left_semi"), "extract"),
            count(h.where("not verified"), "verify"),
            count(h.where("verified and not embedded"), "embed"),
        ],
    )


def erasure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows below each organization, table by table, that its erasure would remove."""
    names = ("denial", "draft", "assertion", "assertion_review", "review_action", "submission", "outcome", "invoice", "member", "reviewer_assignment")
    tables = {n: view(spark, sf_dir, n) for n in names}
    counts, _ = changes.erase(tables, ERASURE, view(spark, sf_dir, "organization").select("organization_id"))
    return counts


def erased_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each table once every fifth organization is erased."""
    tables = {n: view(spark, sf_dir, n) for n, *_ in ERASURE}
    _, left = changes.erase(tables, ERASURE, view(spark, sf_dir, "organization").where("organization_id % 5 = 0").select("organization_id"))
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n") for n, df in left.items()]
    return reduce(DataFrame.unionByName, counts)


#: Which table hangs on which: parents first.
ERASURE = (
    ("denial", "denial_id", None, "organization_id"),
    ("draft", "draft_id", "denial", "denial_id"),
    ("assertion", "assertion_id", "draft", "draft_id"),
    ("assertion_review", "assertion_id", "assertion", "assertion_id"),
    ("review_action", "review_id", "draft", "draft_id"),
    ("submission", "draft_id", "draft", "draft_id"),
    ("outcome", "denial_id", "denial", "denial_id"),
    ("invoice", "invoice_id", None, "organization_id"),
    ("member", "user_id", None, "organization_id"),
    ("reviewer_assignment", "user_id", None, "organization_id"),
)
_PATHS = {
    "denial": "denial t",
    "draft": "draft t join denial d using (denial_id)",
    "assertion": "assertion t join draft f using (draft_id) join denial d using (denial_id)",
    "assertion_review": "assertion_review t join assertion a using (assertion_id) join draft f using (draft_id) join denial d using (denial_id)",
    "review_action": "review_action t join draft f using (draft_id) join denial d using (denial_id)",
    "submission": "submission t join draft f using (draft_id) join denial d using (denial_id)",
    "outcome": "outcome t join denial d using (denial_id)",
    "invoice": "invoice t",
    "member": "member t",
    "reviewer_assignment": "reviewer_assignment t",
}


def schema_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken keys: repeated drafts and outcomes, review actions and assertions without a parent."""
    v = lambda n: view(spark, sf_dir, n)
    found = {
        "draft repeats": changes.violations(v("draft"), "denial_id", "version"),
        "outcome repeats": changes.violations(v("outcome"), "denial_id"),
        "review without draft": changes.orphans(v("review_action"), "draft_id", v("draft"), "draft_id"),
        "assertion without holding": changes.orphans(v("assertion").where("source_kind = 'holding'"), "source_id", v("holding"), "holding_id"),
        "case without organization": changes.orphans(v("denial"), "organization_id", v("organization"), "organization_id"),
    }
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("check_name"), "n") for k, df in found.items()])


QUERIES = {
    "current_drafts": current_drafts,
    "next_versions": next_versions,
    "export_checks": export_checks,
    "transition_checks": transition_checks,
    "superseded_drafts": superseded_drafts,
    "assertion_sections": assertion_sections,
    "citation_numbers": citation_numbers,
    "resolved_sources": resolved_sources,
    "letters_of_drafts": letters_of_drafts,
    "corpus_health": corpus_health,
    "stage_backlogs": stage_backlogs,
    "erasure_counts": erasure_counts,
    "erased_rows": erased_rows,
    "schema_checks": schema_checks,
}
_LABEL = (
    "case stage when 'ready_for_generation' then 'Ready to draft' when 'generating' then 'Drafting' when 'submitted' then 'Filed' when 'intake' then 'Intake' "
    "when 'parsing' then 'Parsing' when 'clinical_review' then 'Clinical review' when 'legal_review' then 'Legal review' when 'approved' then 'Approved' "
    "when 'decided' then 'Decided' else 'Invoiced' end"
)
_ALLOWED = (
    "(stage, to_status) in (('generating', 'ready_for_generation'), ('parsing', 'ready_for_generation'), ('clinical_review', 'ready_for_generation'), "
    "('legal_review', 'ready_for_generation'), ('approved', 'ready_for_generation'), ('legal_review', 'approved'), ('submitted', 'decided'))"
)
_HEAD = "case section when 'identification' then 'The claim and the denial' when 'standard' then 'The applicable standard' when 'application' then 'The record against each criterion' when 'argument' then 'Argument' else 'Relief requested' end"
ORACLE = {
    "current_drafts": f"""{with_views("draft")} select denial_id, draft_id, version, status from draft
qualify row_number() over (partition by denial_id order by status = 'ready' desc, version desc) = 1""",
    "next_versions": f"{with_views('denial', 'draft')} select denial_id, coalesce((select max(version) from draft d where d.denial_id = c.denial_id), 0) + 1 as next_version from denial c",
    "export_checks": f"""{with_views("denial", "draft", "review_action")}, v as ({verdict_sql()}),
r as (select d.draft_id, d.denial_id + d.draft_id % 2 as denial_id, d.denial_id as owner, d.status as draft_status from draft d),
x as (select r.*, c.status as stage, c.denial_id is null as unknown, coalesce(v.clinical, false) as clinical, coalesce(v.legal, false) as legal
  from r left join denial c on c.denial_id = r.denial_id left join v on v.draft_id = r.draft_id)
select denial_id, draft_id, case when unknown then 'That denial does not exist.' when owner <> denial_id then 'That draft belongs to a different denial.'
  when draft_status = 'superseded' then 'This draft has been superseded by a newer version. Export that one.'
  when not (clinical and legal) then 'This appeal still needs ' || case when clinical then 'legal review' when legal then 'clinical review' else 'clinical review and legal review' end || ' before it can be exported.'
  when stage not in ('approved', 'submitted', 'decided', 'invoiced') then 'This appeal is at ' || {_LABEL} || '. Export opens once it is approved.' end as reason from x""",
    "transition_checks": f"""{with_views("denial", "draft", "review_action", "outcome")}, v as ({verdict_sql()}),
cur as (select denial_id, draft_id from draft qualify row_number() over (partition by denial_id order by status = 'ready' desc, version desc) = 1),
x as (select c.denial_id, c.status as stage, to_status, coalesce(v."both", false) as approved, o.result is not null as decided from denial c
  left join cur using (denial_id) left join v using (draft_id) left join outcome o using (denial_id), (select unnest(['approved', 'decided', 'ready_for_generation']) as to_status))
select denial_id, to_status, case when stage = to_status then null when not {_ALLOWED} then 'no way from ' || stage || ' to ' || to_status
  when to_status = 'approved' and not approved then 'needs clinical and legal approval' when to_status = 'decided' and not decided then 'needs an outcome' end as error from x""",
    "superseded_drafts": f"""{with_views("draft", "denial")}, n as (select denial_id, coalesce(max(version), 0) + 1 as version from denial left join draft using (denial_id) where denial_id % 10 = 0 group by denial_id),
a as (select version, case when status = 'ready' and denial_id % 10 = 0 then 'superseded' else status end as status from draft union all select version, 'ready' from n)
select status, count(*) as drafts, max(version) as newest from a group by status""",
    "assertion_sections": f"""{with_views("assertion")}, p as (select *, {_HEAD} as heading,
  row_number() over (partition by draft_id order by list_position([{text(SECTIONS)}], section), ordinal) as place from assertion)
select draft_id, section, heading, min(place)::integer as first_place, string_agg(ordinal::varchar, ',' order by ordinal) as ordinals from p group by draft_id, section, heading""",
    "citation_numbers": f"""{with_views("assertion")}, f as (select draft_id, source_kind, source_id, min(ordinal) as first_ordinal from assertion group by all)
select *, row_number() over (partition by draft_id order by first_ordinal, source_kind, source_id)::integer as citation from f""",
    "resolved_sources": f"""{with_views("assertion", "holding", "source_span", "contact")} select assertion_id, source_kind, a.source_id::varchar as source_id,
  case source_kind when 'holding' then concat_ws(' ', h.denial_basis, h.service_type) when 'source_span' then s.heading else c.full_name end as source_text,
  case when kind = 'legal' then source_kind in ('holding', 'source_span') else source_kind = 'clinical_fact' end as fits
from assertion a left join holding h on source_kind = 'holding' and h.holding_id = a.source_id left join source_span s on source_kind = 'source_span' and s.span_id = a.source_id
left join contact c on source_kind = 'clinical_fact' and c.contact_id = a.source_id""",
    "letters_of_drafts": f"""{with_views("draft", "denial", "organization", "assertion")},
h as (select draft_id, concat_ws(chr(10), upper(o.name), '', '1998-01-01', '', payer_name, '', 'RE: Appeal of denied claim', '    Reference:      ' || internal_ref,
    '    Service:        ' || replace(service_type, '_', ' '), '    Dates:          not stated', '    Amount:         ' || claim_cents,
    '    Appeal due:     ' || strftime(deadline, '%Y-%m-%d'), chr(10) || 'To the Appeals Department:' || chr(10)) as top
  from draft f join denial c on c.denial_id = f.denial_id join organization o on o.organization_id = c.organization_id where f.status = 'ready'),
b as (select draft_id, section, upper({_HEAD}) || chr(10) || chr(10) || string_agg(ordinal || '. ' || body || chr(10), chr(10) order by ordinal) as t from assertion group by draft_id, section),
s as (select draft_id, string_agg(t, chr(10) order by list_position([{text(SECTIONS)}], section)) as body from b group by draft_id),
f as (select draft_id, source_kind, source_id, min(ordinal) as o from assertion group by all),
n as (select *, row_number() over (partition by draft_id order by o, source_kind, source_id) as i from f),
c as (select draft_id, string_agg('[' || i || '] ' || replace(source_kind, '_', ' ') || chr(10) || chr(10) || '    "quoted words of source ' || source_id || '"' || chr(10), chr(10) order by i) as notes from n group by draft_id),
l as (select draft_id, concat_ws(chr(10), top, body, 'ENCLOSURES' || chr(10) || chr(10) || '  1. The denial letter at issue' || chr(10) || '  2. The clinical record supporting this appeal' || chr(10)
    || '  3. Citation appendix, below' || chr(10) || chr(10) || 'CITATION APPENDIX' || chr(10) || chr(10) || 'Every assertion above rests on one of the sources below. The quoted passage is' || chr(10)
    || 'reproduced so this appeal can be checked against its sources without our software.' || chr(10), notes) as letter from h left join s using (draft_id) left join c using (draft_id))
select draft_id, sha256(letter) as letter_sha256, length(letter) - length(replace(letter, chr(10), '')) + 1 as lines from l""",
    "corpus_health": f"""{with_views("holding", "source_document")}
select 'holdings' as measure, null::varchar as key, count(*)::double as value from holding union all select 'verified', null, count(*) filter (where verified) from holding
union all select 'embedded', null, count(*) filter (where embedded) from holding
union all select 'unverified_rate', null, round(count(*) filter (where not verified) / count(*)::double, 6) from holding
union all select 'embedding_coverage', null, round(count(*) filter (where embedded) / (count(*) filter (where verified))::double, 6) from holding
union all select 'by_service_type', service_type, count(*) from holding where verified group by service_type
union all select 'by_denial_basis', denial_basis, count(*) from holding where verified group by denial_basis
union all select 'documents', source_type, count(*) from source_document group by source_type
union all select 'last_retrieved', source_type, max(retrieved_day) from source_document group by source_type""",
    "stage_backlogs": f"""{with_views("source_document", "source_span", "holding")} select 'parse' as stage, count(*) as pending from source_document where not parsed
union all select 'extract', count(*) from source_document d where parsed and not extracted and exists (select 1 from source_span s where s.source_document_id = d.source_document_id)
union all select 'verify', count(*) from holding where not verified union all select 'embed', count(*) from holding where verified and not embedded""",
    "erasure_counts": f"""{with_views("organization", *_PATHS)}, c as ({" union all ".join(f"select organization_id, '{n}' as table_name, count(*) as n from {p} group by organization_id" for n, p in _PATHS.items())}),
o as (select organization_id, unnest([{text(tuple(_PATHS))}]) as table_name from organization)
select organization_id, table_name, coalesce(n, 0) as n from o left join c using (organization_id, table_name)""",
    "erased_rows": f"""{with_views("organization", *_PATHS)} {" union all ".join(
        f"select '{n}' as table_name, (select count(*) from {n}) - (select count(*) from {p} where organization_id % 5 = 0) as n" for n, p in _PATHS.items())}""",
    "schema_checks": f"""{with_views("draft", "outcome", "review_action", "assertion", "holding", "denial", "organization")}
select 'draft repeats' as check_name, count(*) as n from (select 1 from draft group by denial_id, version having count(*) > 1)
union all select 'outcome repeats', count(*) from (select 1 from outcome group by denial_id having count(*) > 1)
union all select 'review without draft', count(*) from review_action r where not exists (select 1 from draft d where d.draft_id = r.draft_id)
union all select 'assertion without holding', count(*) from assertion a where source_kind = 'holding' and not exists (select 1 from holding h where h.holding_id = a.source_id)
union all select 'case without organization', count(*) from denial d where not exists (select 1 from organization o where o.organization_id = d.organization_id)""",
}
