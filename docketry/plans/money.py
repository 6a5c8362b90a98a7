"""Billing queries: fees, invoices with explained exclusions, typed amounts, model cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import numbers
from docketry.operators import billing, changes
from docketry.plans.adapters import view, with_views

START, END = "1996-01-01 00:00:00", "1996-12-31 23:59:59"


def _moment(s: str) -> Column:
    return F.lit(s).cast("timestamp")


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = view(spark, sf_dir, "denial").select("denial_id", "organization_id")
    org = view(spark, sf_dir, "organization").select("organization_id", "rate_bps")
    return view(spark, sf_dir, "outcome").join(cases, "denial_id").join(org, "organization_id")


def fees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _outcomes(spark, sf_dir)
    fee = numbers.fee_cents(F.col("recovered_cents") - 500_000, F.col("rate_bps"))
    return rows.select("denial_id", "rate_bps", numbers.rate_text(F.col("rate_bps")).alias("rate"), fee.alias("fee_cents"))


def invoice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every outcome of 1996 and around: billed with its fee, or excluded with the reason."""
    lines = billing.billed_lines(_outcomes(spark, sf_dir), _moment(START), _moment(END))
    return lines.select("organization_id", "denial_id", "recovered_cents", "fee_cents", "excluded_reason")


def issued_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The invoices of 1996, numbered after those that each organization has."""
    lines = billing.billed_lines(_outcomes(spark, sf_dir), _moment(START), _moment(END))
    org = view(spark, sf_dir, "organization")
    done = billing.issue_invoices(lines, org, _moment(START), view(spark, sf_dir, "invoice"))
    return done.select("organization_id", "number", "total_recovered_cents", "fee_cents", "rate_bps", "lines")


def billed_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many outcomes are billed once the invoices of 1996 are out."""
    lines = billing.billed_lines(_outcomes(spark, sf_dir), _moment(START), _moment(END)).where("excluded_reason is null")
    after = changes.update_keys(view(spark, sf_dir, "outcome"), lines, "denial_id", invoice_id=F.lit(-1).cast("long"))
    return after.groupBy("result").agg(F.count("*").alias("outcomes"), F.count("invoice_id").alias("billed"))


def typed_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts as people type them, in cents; null where they are none."""
    key = F.col("denial_id")
    plain = F.col("claim_cents").cast("string")
    typed = (
        F.when(key % 5 == 0, F.concat(F.lit("$ "), F.format_number(F.expr("claim_cents div 100"), 0)))
        .when(key % 5 == 1, F.concat(F.expr("cast(claim_cents div 100 as string)"), F.lit("."), F.expr("cast(claim_cents % 10 as string)")))
        .when(key % 5 == 2, F.concat(plain, F.lit(".125")))
        .when(key % 5 == 3, F.lit(""))
        .otherwise(F.concat(F.lit(" "), plain, F.lit(".07 ")))
    )
    rows = view(spark, sf_dir, "denial").select("denial_id", typed.alias("typed"))
    return rows.select("denial_id", "typed", numbers.cents_of(F.col("typed")).alias("cents"), numbers.cents_of(F.col("typed"), True).alias("cents_or_zero"))


def typed_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = F.when(F.col("denial_id") % 4 == 0, F.concat((F.col("denial_id") % 130).cast("string"), F.lit(".25"))).when(F.col("denial_id") % 4 == 1, " 12.5 ")
    typed = typed.when(F.col("denial_id") % 4 == 2, "ten").otherwise("")
    rows = view(spark, sf_dir, "denial").select("denial_id", typed.alias("typed"))
    return rows.select("denial_id", numbers.bps_of(F.col("typed")).alias("bps"))


def outcome_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would be wrong with each outcome if its amount were another's."""
    rows = view(spark, sf_dir, "outcome").withColumn("tried", F.when(F.col("denial_id") % 9 == 0, F.lit(0)).otherwise(F.col("denial_id") % 7 - 1).cast("long"))
    return rows.select("denial_id", "result", "tried", billing.outcome_errors(F.col("result"), F.col("tried")).alias("error"))


def model_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "llm_call")
    cost = numbers.model_cost_cents(F.col("prompt_tokens") * 100, F.col("completion_tokens") * 10)
    return rows.groupBy("stage").agg(F.sum(cost).cast("long").alias("cents"), F.max(cost).cast("long").alias("dearest"))


def amounts_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.col("claim_cents") * F.when(F.col("denial_id") % 6 == 0, -1).otherwise(1)
    return view(spark, sf_dir, "denial").select("denial_id", numbers.format_cents(cents).alias("exact"), numbers.format_dollars(F.col("claim_cents")).alias("rounded"))


QUERIES = {
    "fees": fees,
    "invoice_lines": invoice_lines,
    "issued_invoices": issued_invoices,
    "billed_outcomes": billed_outcomes,
    "typed_amounts": typed_amounts,
    "typed_rates": typed_rates,
    "outcome_errors": outcome_errors,
    "model_costs": model_costs,
    "amounts_as_text": amounts_as_text,
}
_RATE = "case when rate_bps % 100 = 0 then (rate_bps // 100) || '%' else (rate_bps // 100) || '.' || rtrim(lpad((rate_bps % 100)::varchar, 2, '0'), '0') || '%' end"
_LINES = f"""{with_views("outcome", "denial", "organization", "invoice")},
l as (select organization_id, denial_id, result, recovered_cents, rate_bps, slug, case when invoice_id is not null then 'already billed on an earlier invoice'
  when decided_at < timestamp '{START}' or decided_at > timestamp '{END}' then 'decided outside this period'
  when result in ('lost', 'withdrawn') then result || ', so nothing was recovered and nothing is owed' when recovered_cents <= 0 then 'no dollars recovered' end as excluded_reason
  from outcome join denial using (denial_id) join organization o using (organization_id)),
f as (select *, case when excluded_reason is null then recovered_cents * rate_bps // 10000 else 0 end as fee_cents from l)"""
_DOLLARS = "format('{:,}', abs(c) // 100)"
ORACLE = {
    "fees": f"""{with_views("outcome", "denial", "organization")} select denial_id, rate_bps, {_RATE} as rate,
  greatest(0, (recovered_cents - 500000) * rate_bps // 10000)::bigint as fee_cents from outcome join denial using (denial_id) join organization using (organization_id)""",
    "invoice_lines": f"{_LINES} select organization_id, denial_id, recovered_cents, fee_cents, excluded_reason from f",
    "issued_invoices": f"""{_LINES} select organization_id, upper(any_value(slug)) || '-199601-' ||
  lpad(((select count(*) from invoice i where i.organization_id = f.organization_id) + 1)::varchar, 3, '0') as number,
  sum(recovered_cents)::bigint as total_recovered_cents, sum(fee_cents)::bigint as fee_cents, any_value(rate_bps) as rate_bps, count(*) as lines
from f where excluded_reason is null group by organization_id""",
    "billed_outcomes": f"""{_LINES} select result, count(*) as outcomes, count(*) filter (where excluded_reason is null or excluded_reason = 'already billed on an earlier invoice') as billed
from f group by result""",
    "typed_amounts": f"""{with_views("denial")}, t as (select denial_id, case denial_id % 5 when 0 then '$ ' || format('{{:,}}', claim_cents // 100)
  when 1 then (claim_cents // 100) || '.' || (claim_cents % 10) when 2 then claim_cents || '.125' when 3 then '' else ' ' || claim_cents || '.07 ' end as typed from denial),
p as (select *, regexp_replace(typed, '[$,\\s]', '', 'g') as plain from t),
c as (select *, case when regexp_matches(plain, '^\\d+([.]\\d{{1,2}})?$') then split_part(plain, '.', 1)::bigint * 100 + rpad(split_part(plain, '.', 2), 2, '0')::bigint end as cents from p)
select denial_id, typed, cents, case when plain = '' then 0 else cents end as cents_or_zero from c""",
    "typed_rates": f"""{with_views("denial")} select denial_id, case denial_id % 4 when 0 then case when denial_id % 130 < 100 then (denial_id % 130) * 100 + 25 end
  when 1 then 1250 when 3 then 0 end::bigint as bps from denial""",
    "outcome_errors": f"""{with_views("outcome")}, t as (select denial_id, result, (case when denial_id % 9 = 0 then 0 else denial_id % 7 - 1 end)::bigint as tried from outcome)
select *, case when result in ('lost', 'withdrawn') and tried <> 0 then 'a lost or withdrawn appeal recovers nothing'
  when result in ('won', 'partial') and tried <= 0 then 'a won or partial appeal recovers something' end as error from t""",
    "model_costs": f"""{with_views("llm_call")}, c as (select stage, ceil(prompt_tokens * 100 / 1e6::double * 300 + completion_tokens * 10 / 1e6::double * 1500) as cost from llm_call)
select stage, sum(cost)::bigint as cents, max(cost)::bigint as dearest from c group by stage""",
    "amounts_as_text": f"""{with_views("denial")}, c as (select denial_id, claim_cents, case when denial_id % 6 = 0 then -claim_cents else claim_cents end as c from denial)
select denial_id, case when c < 0 then '-$' else '$' end || {_DOLLARS} || '.' || lpad((abs(c) % 100)::varchar, 2, '0') as exact, '$' || format('{{:,}}', (claim_cents + 50) // 100) as rounded from c""",
}
