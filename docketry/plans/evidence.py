"""Retrieval queries: local vectors, similarity, weighted ranking, controlling authority."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.functions.texts import term_hits
from docketry.functions.vectors import cosine, embed
from docketry.operators import retrieval, verify, workflow
from docketry.plans.adapters import BASES, PAYERS, SERVICES, text, view, with_views
from docketry.runtime import table

SPREAD = 32
TERMS = ("skilled", "the", "and", "care", "ou", "sch")


def document_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trigram vector of every turn of a conversation, as its dimensions that are not zero."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(embed(F.col("text"))).alias("bucket", "w"))
    return rows.where("w <> 0").select("conv_id", "turn", "bucket", F.round("w", 6).alias("weight"))


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A retrieval request for every hundredth vector: facets by number, some of them open, and the vector."""
    k = F.expr("vec_id div 100")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(
        k.alias("query_id"), F.when(k % 3 != 0, pick(BASES, k % 7)).alias("q_denial_basis"), F.when(k % 4 != 0, pick(PAYERS, k % 5)).alias("q_payer_type"),
        F.when(k % 5 != 0, pick(SERVICES, k % 8)).alias("q_service_type"), F.col("embedding").alias("q_embedding"),
    )


def retrieved_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    holdings = view(spark, sf_dir, "holding").withColumn("embedding", F.when(F.col("embedded"), F.col("embedding")))
    best = retrieval.retrieve(_queries(spark, sf_dir), holdings)
    return best.select("query_id", "rank", "holding_id", F.round("score", 5).alias("score"), F.round("similarity", 5).alias("similarity"), F.array_join("reasons", "; ").alias("reasons"))


def similar_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest holdings of the same label for every hundredth vector.

    Requests meet the holdings of a label in as many parts as SPREAD, so a frequent label
    is no single task's; a task keeps its three best of each before these are shuffled.
    """
    part = F.pmod("vec_id", F.lit(SPREAD))
    e = table(spark, sf_dir, "embeddings").withColumn("part", part)
    q = table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("q"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))).alias("part"))
    pairs = e.join(q, ["label", "part"]).where("vec_id <> query_id").select("query_id", "vec_id", F.round(cosine(F.col("q"), F.col("embedding")), 6).alias("similarity"))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where("rank <= 3").select("query_id", "rank", "vec_id", "similarity")


def controlling_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retrieval.controlling_spans(view(spark, sf_dir, "source_span"), view(spark, sf_dir, "source_document"), "skilled_nursing", TERMS)
    return rows.select("span_id", "citation", "hits")


def controlling_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What controls the service of each case."""
    service = F.when(F.col("denial_id") % 9 == 0, "unheard_of").otherwise(F.col("service_type"))
    cites = F.array_join(retrieval.controlling_citations(service), "; ")
    return view(spark, sf_dir, "denial").select("denial_id", cites.alias("citations"))


def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", term_hits(F.coalesce("text", F.lit("")), TERMS).alias("hits"))


def documentation_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Criteria of each case, cited by the payer or of the service, that no fact supports."""
    cases = view(spark, sf_dir, "denial").select("denial_id", "service_type")
    statutory = spark.createDataFrame([(s, i, f"{s} criterion {i}") for s in SERVICES[:2] for i in range(1, 6)], "service_type string, place long, criterion string")
    k = F.col("denial_id")
    cited = cases.where(k % 4 == 0).select("denial_id", F.explode(F.sequence(F.lit(1), k % 3 + 1)).alias("place"))
    cited = cited.select("denial_id", F.col("place").cast("long").alias("place"), F.concat(F.lit("cited criterion "), F.col("place").cast("string")).alias("criterion"))
    criteria = workflow.criteria_for(cases, cited, statutory)
    facts = cases.select("denial_id", F.explode(F.array(F.concat("service_type", F.lit(" criterion 2")), F.lit("skilled_nursing criterion 3"), F.lit("cited criterion 1"), F.lit(None).cast("string"))).alias("supports"))
    facts = facts.withColumn("verified", F.col("denial_id") % 2 == 0)
    return workflow.documentation_gaps(criteria, facts, verified_only=True).select("denial_id", "place", "criterion")


def assertion_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps drafted assertions, some of them incomplete, from being assertions."""
    k = F.col("assertion_id")
    rows = view(spark, sf_dir, "assertion").select(
        k, F.when(k % 7 != 0, F.col("source_id")).alias("source_id"), F.when(k % 11 != 0, F.col("body")).otherwise("  ").alias("verbatim_quote"),
        F.when(k % 13 != 0, F.col("body")).alias("text"), F.when(k % 17 != 0, F.col("ordinal")).when(k % 2 == 0, 0).alias("ordinal"),
    )
    return rows.select("assertion_id", verify.assertion_errors().alias("error"))


def accepted_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each draft taken as a case, the first of four attempts, one of them too many, whose assertions all hold."""
    k = F.col("assertion_id")
    tries = F.explode(F.sequence(F.lit(1), F.lit(4))).alias("attempt")
    rows = view(spark, sf_dir, "assertion").select(F.col("draft_id").alias("denial_id"), "kind", "source_kind", k, tries)
    kind = F.when(F.col("attempt") >= 2, F.when(F.col("source_kind") == "clinical_fact", "clinical").otherwise("legal")).otherwise(F.col("kind"))
    rows = rows.withColumn("kind", kind).withColumn("reason", F.when((k + F.col("attempt")) % 5 == 0, "not_found_in_source"))
    return verify.first_accepted_attempts(rows)


QUERIES = {
    "assertion_checks": assertion_checks,
    "accepted_attempts": accepted_attempts,
    "document_vectors": document_vectors,
    "retrieved_authority": retrieved_authority,
    "similar_holdings": similar_holdings,
    "controlling_spans": controlling_spans,
    "controlling_citations": controlling_citations,
    "term_counts": term_counts,
    "documentation_gaps": documentation_gaps,
}


def _fnv(h: str, byte: str) -> str:
    return f"((xor({h}, {byte}::bigint) * 16777619) & 4294967295)"


_HASH = _fnv(_fnv(_fnv("2166136261::bigint", "ascii(substr(g, 1, 1))"), "ascii(substr(g, 2, 1))"), "ascii(substr(g, 3, 1))")
_HITS = " + ".join(f"contains(lower(t), '{t}')::integer" for t in TERMS)
_COS = "list_sum(list_transform(list_zip({0}, {1}), lambda p: p[1]::double * p[2]::double))"
_SAME = {f: f"coalesce(q_{f} = {f}, false)" for f in ("denial_basis", "payer_type", "service_type")}
ORACLE = {
    "assertion_checks": f"""{with_views("assertion")} select assertion_id, case when assertion_id % 7 = 0 then 'no source' when assertion_id % 11 = 0 then 'no quote' when assertion_id % 13 = 0 then 'no text'
  when assertion_id % 17 = 0 or ordinal < 1 then 'ordinals start at 1' end as error from assertion""",
    "accepted_attempts": f"""{with_views("assertion")}, a as (select draft_id, assertion_id, kind, source_kind, unnest([1, 2, 3]) as attempt from assertion),
g as (select draft_id, attempt, bool_and((assertion_id + attempt) % 5 <> 0 and (attempt >= 2 or (kind = 'legal') = (source_kind <> 'clinical_fact'))) as ok from a group by all)
select draft_id as denial_id, min(case when ok then attempt end) as accepted, max(attempt) as tried from g group by draft_id""",
    "document_vectors": f"""with n as (select conv_id, turn, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) as n from conversations),
g as (select conv_id, turn, unnest(list_transform(range(1, greatest(length(n) - 1, 1)), lambda i: substr(n, i, 3))) as g from n),
h as (select conv_id, turn, {_HASH} as h from g), s as (select conv_id, turn, (h % 384)::integer as bucket, sum(case when {_fnv("h", "35")} % 2 = 0 then 1 else -1 end) as s from h group by all),
m as (select *, sqrt(sum(s * s) over (partition by conv_id, turn)) as m from s)
select conv_id, turn, bucket, round(s::double / m, 6) as weight from m where s <> 0""",
    "retrieved_authority": f"""{with_views("holding")}, q as (select k as query_id, case when k % 3 <> 0 then ([{text(BASES)}])[k % 7 + 1] end as q_denial_basis,
  case when k % 4 <> 0 then ([{text(PAYERS)}])[k % 5 + 1] end as q_payer_type, case when k % 5 <> 0 then ([{text(SERVICES)}])[k % 8 + 1] end as q_service_type, embedding as q_embedding
  from (select *, vec_id // 100 as k from embeddings where vec_id % 100 = 0)),
p as (select *, case when embedded then {_COS.format("q_embedding", "embedding")} else 0 end as sim from q, holding
  where verified and ({_SAME["denial_basis"]} or {_SAME["payer_type"]} or {_SAME["service_type"]} or coalesce(denial_basis = 'proprietary_criteria', false))),
s as (select *, case when {_SAME["denial_basis"]} then 3.0 else 0 end + case when {_SAME["payer_type"]} then 2.0 else 0 end + case when {_SAME["service_type"]} then 1.5 else 0 end
  + case outcome when 'claimant_favorable' then 1.0 when 'plan_favorable' then -0.75 else 0 end + sim * 2.5 as score from p),
r as (select *, row_number() over (partition by query_id order by score desc, holding_id)::integer as rank from s)
select query_id, rank, holding_id, round(score, 5) as score, round(sim, 5) as similarity, concat_ws('; ', case when {_SAME["denial_basis"]} then 'same denial basis: ' || replace(denial_basis, '_', ' ') end,
  case when {_SAME["payer_type"]} then 'same payer type: ' || replace(payer_type, '_', ' ') end, case when {_SAME["service_type"]} then 'same service type: ' || replace(service_type, '_', ' ') end,
  case outcome when 'claimant_favorable' then 'the appellant prevailed' when 'plan_favorable' then 'the plan prevailed, so this is contrary authority' end,
  case when denial_basis = 'proprietary_criteria' and coalesce(q_denial_basis, '') <> 'proprietary_criteria' then 'addresses proprietary criteria, which travels across service types' end,
  case when sim > 0.2 then 'language closely matches the denial' end) as reasons from r where rank <= 12""",
    "similar_holdings": f"""with p as (select q.vec_id as query_id, e.vec_id, round({_COS.format("q.embedding", "e.embedding")}, 6) as similarity from embeddings q join embeddings e using (label)
  where q.vec_id % 100 = 0 and e.vec_id <> q.vec_id)
select query_id, row_number() over (partition by query_id order by similarity desc, vec_id)::integer as rank, vec_id, similarity from p qualify rank <= 3""",
    "controlling_spans": f"""{with_views("source_span", "source_document")}, t as (select span_id, citation, heading || ' ' || text as t from source_span join source_document using (source_document_id)
  where citation in ('42 CFR Part 409', '42 CFR Part 422')), h as (select span_id, citation, {_HITS} as hits from t)
select span_id, citation, hits from h where hits > 0 order by hits desc, span_id limit 10""",
    "controlling_citations": f"""{with_views("denial")} select denial_id, case when denial_id % 9 = 0 then '42 CFR Part 422' else case service_type
  when 'skilled_nursing' then '42 CFR Part 409; 42 CFR Part 422; Medicare Benefit Policy Manual, Ch. 8' when 'inpatient_rehab' then '42 CFR Part 412; 42 CFR Part 422; Medicare Benefit Policy Manual, Ch. 1'
  when 'home_health' then '42 CFR Part 409; 42 CFR Part 422' when 'long_term_care_hospital' then '42 CFR Part 412; 42 CFR Part 422' when 'inpatient_acute' then '42 CFR Part 412; 42 CFR Part 422'
  else '42 CFR Part 422' end end as citations from denial""",
    "term_counts": f"select doc_id, {_HITS} as hits from (select doc_id, coalesce(text, '') as t from documents)",
    "documentation_gaps": f"""{with_views("denial")}, c as (select denial_id, unnest(range(1, denial_id % 3 + 2)) as place, 'cited criterion ' as stem, service_type from denial where denial_id % 4 = 0
  union all select denial_id, unnest(range(1, 6)), case when service_type = 'inpatient_rehab' then 'inpatient_rehab' else 'skilled_nursing' end || ' criterion ', service_type from denial where denial_id % 4 <> 0)
select denial_id, place, stem || place as criterion from c
where not (denial_id % 2 = 0 and stem || place in (service_type || ' criterion 2', 'skilled_nursing criterion 3', 'cited criterion 1'))""",
}
