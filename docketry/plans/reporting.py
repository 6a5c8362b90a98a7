"""Operational reporting: fused conditional aggregates per organization, case lists, review queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.numbers import average_days, days_until, deadline_tone, half_up, rate_text
from docketry.operators.workflow import current_drafts, ever_approved, latest_verdicts
from docketry.plans.adapters import AS_OF, LIVE_STAGES, OPEN_STAGES, text, view, with_views

LIVE, OPEN = text(LIVE_STAGES), text(OPEN_STAGES)
NOW = f"timestamp '{AS_OF}'"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def moment(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def dashboard_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of every organization: one pass over cases with outcomes, one over invoices."""
    cases = view(spark, sf_dir, "denial").join(view(spark, sf_dir, "outcome"), "denial_id", "left")
    result, won = F.col("result"), F.col("result").isin("won", "partial")
    live = F.col("status").isin(*LIVE_STAGES)
    recovered = F.col("recovered_cents")
    zero = lambda c: F.coalesce(c, F.lit(0))
    figures = cases.groupBy("organization_id").agg(
        F.count("*").alias("cases"),
        zero(F.sum(recovered)).alias("recovered_cents"),
        zero(F.sum(F.when(F.col("decided_at") >= F.date_trunc("month", as_of()), recovered))).alias("recovered_month_cents"),
        zero(F.sum(F.when(F.col("status").isin(*OPEN_STAGES), F.col("claim_cents")))).alias("at_risk_cents"),
        *[F.count_if(result == r).alias(r) for r in ("won", "lost", "partial", "withdrawn")],
        half_up(F.try_divide(F.count_if(won), F.count(result)) * 100).alias("win_rate_percent"),
        half_up(average_days(F.col("decided_at"), F.col("created_at"))).alias("average_days"),
        F.count_if(live & F.col("deadline").between(as_of(), as_of() + F.expr("INTERVAL 7 DAYS"))).alias("due_in_7_days"),
        F.count_if(live & (F.col("deadline") < as_of())).alias("deadlines_passed"),
    )
    fees = view(spark, sf_dir, "invoice").groupBy("organization_id").agg(F.sum("fee_cents").alias("fees"))
    return figures.join(fees, "organization_id", "left").withColumn("fees_billed_cents", zero(F.col("fees"))).drop("fees")


def cases_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "denial").groupBy("organization_id", "status").agg(F.count("*").alias("cases"), F.sum("claim_cents").alias("claim_cents"))


def outcome_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of each organization by result, all four results as columns."""
    rows = view(spark, sf_dir, "outcome").join(view(spark, sf_dir, "denial").select("denial_id", "organization_id"), "denial_id")
    return rows.groupBy("organization_id").pivot("result", ["won", "lost", "partial", "withdrawn"]).count().na.fill(0)


def case_list(
    spark: SparkSession, sf_dir: str, organization: int | None = None, status: str | None = None, payer: str | None = None, window: str | None = None
) -> DataFrame:
    """Cases by deadline, optionally of one organization, stage, payer or deadline window (overdue, week, month)."""
    ahead = {"week": 7, "month": 30}
    where = [
        F.col("organization_id") == organization if organization is not None else None,
        F.col("status") == status if status else None,
        F.col("payer_name") == payer if payer else None,
        F.col("deadline") <= as_of() if window == "overdue" else None,
        F.col("deadline").between(as_of(), as_of() + F.make_dt_interval(days=F.lit(ahead[window]))) if window in ahead else None,
    ]
    cases = view(spark, sf_dir, "denial")
    for condition in where:
        cases = cases if condition is None else cases.where(condition)
    ready = current_drafts(view(spark, sf_dir, "draft").where(F.col("status") == "ready")).select("denial_id", "draft_id")
    rows = cases.join(ready, "denial_id", "left").join(view(spark, sf_dir, "outcome").select("denial_id", "recovered_cents"), "denial_id", "left")
    rows = rows.orderBy(F.col("deadline").asc_nulls_last(), F.desc("created_at"), "denial_id")
    return rows.select(
        "denial_id", "internal_ref", "payer_name", "service_type", "claim_cents", moment("deadline"), "status",
        F.col("draft_id").isNotNull().alias("has_draft"), "recovered_cents",
        days_until(F.col("deadline"), as_of()).alias("days_left"), deadline_tone(days_until(F.col("deadline"), as_of())).alias("tone"),
    )


def _case_list_sql(where: str = "true") -> str:
    days = f"cast(ceil((epoch_us(deadline) - epoch_us({NOW})) / 86400000000.0) as bigint)"
    return f"""{with_views("denial", "draft", "outcome")}
select denial_id, internal_ref, payer_name, service_type, claim_cents, strftime(deadline, '%Y-%m-%d %H:%M:%S') as deadline, status,
  exists (select 1 from draft where draft.denial_id = denial.denial_id and draft.status = 'ready') as has_draft, recovered_cents,
  {days} as days_left, case when {days} <= 7 then 'denied' else 'neutral' end as tone
from denial left join outcome using (denial_id) where {where}"""


def payers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "denial").select("organization_id", "payer_name").distinct().orderBy("organization_id", "payer_name")


def review_queue(spark: SparkSession, sf_dir: str, kind: str, scope: list[int] | None = None) -> DataFrame:
    """Ready drafts at a review stage, of some organizations or of all, with counts and flags."""
    stage = "clinical_review" if kind == "clinical" else "legal_review"
    cases = view(spark, sf_dir, "denial").where(F.col("status") == stage)
    if scope is not None:
        cases = cases.where(F.col("organization_id").isin(*scope)) if scope else cases.where("false")
    drafts = view(spark, sf_dir, "draft").where(F.col("status") == "ready").drop("status", "created_at")
    n = view(spark, sf_dir, "assertion").groupBy("draft_id").agg(F.count("*").alias("n"))
    rows = drafts.join(cases, "denial_id").join(view(spark, sf_dir, "organization").select("organization_id", "name"), "organization_id")
    rows = rows.join(n, "draft_id", "left").join(ever_approved(view(spark, sf_dir, "review_action")), "draft_id", "left")
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return rows.orderBy(F.col("deadline").asc_nulls_last(), "draft_id").select(
        "draft_id", "denial_id", "internal_ref", F.col("name").alias("organization_name"), "claim_cents", moment("deadline"), "version", "gap_count",
        F.coalesce("n", F.lit(0)).alias("assertions"), flag("clinical_approved"), flag("legal_approved"),
    )


def _review_queue_sql(stage: str, scope: str = "true") -> str:
    ever = lambda kind: f"exists (select 1 from review_action r where r.draft_id = d.draft_id and r.review_type = '{kind}' and r.action = 'approved')"
    return f"""{with_views("denial", "draft", "assertion", "review_action", "organization")}
select d.draft_id, d.denial_id, internal_ref, o.name as organization_name, claim_cents, strftime(deadline, '%Y-%m-%d %H:%M:%S') as deadline, version, gap_count,
  (select count(*) from assertion a where a.draft_id = d.draft_id) as assertions, {ever("clinical")} as clinical_approved, {ever("legal")} as legal_approved
from draft d join denial c on c.denial_id = d.denial_id join organization o on o.organization_id = c.organization_id
where d.status = 'ready' and c.status = '{stage}' and {scope}"""


def review_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reviewer's marks on a draft, by assertion."""
    a = view(spark, sf_dir, "assertion").select("assertion_id", "draft_id")
    marks = view(spark, sf_dir, "assertion_review").join(a, "assertion_id")
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("assertion_id", "verified"))))
    grouped = marks.groupBy("draft_id", "reviewer_id").agg(entries.alias("m"), F.count_if("verified").alias("verified"))
    return grouped.select("draft_id", "reviewer_id", "verified", F.to_json("m").alias("marks"))


def review_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejections in the order in which they came."""
    rows = view(spark, sf_dir, "review_action").where(F.col("action") == "rejected").orderBy("draft_id", "created_at", "review_id")
    return rows.select("draft_id", "review_id", "review_type", "reviewer_id", moment("created_at"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_verdicts(view(spark, sf_dir, "review_action"))


def team(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "member").join(view(spark, sf_dir, "app_user"), "user_id")
    return rows.orderBy("organization_id", "name", "role").select("organization_id", "user_id", "name", "email", "role", "status")


def invoice_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "invoice").orderBy("organization_id", F.desc("period_start"), "invoice_id")
    return rows.select("organization_id", "number", moment("period_start"), "total_recovered_cents", rate_text(F.col("rate_bps")).alias("rate"), "fee_cents", "status")


def unbilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recoveries of each organization that no invoice bills yet."""
    open_ = view(spark, sf_dir, "outcome").where(F.col("invoice_id").isNull() & (F.col("recovered_cents") > 0))
    rows = open_.join(view(spark, sf_dir, "denial").select("denial_id", "organization_id"), "denial_id")
    return rows.groupBy("organization_id").agg(F.coalesce(F.sum("recovered_cents"), F.lit(0)).alias("unbilled_cents"), F.count("*").alias("outcomes"))


def verdict_sql() -> str:
    last = lambda kind: f"coalesce(arg_max(action, (created_at, review_id)) filter (where review_type = '{kind}') = 'approved', false)"
    return f"select draft_id, {last('clinical')} as clinical, {last('legal')} as legal, {last('clinical')} and {last('legal')} as \"both\" from review_action group by draft_id"


QUERIES = {
    "dashboard_figures": dashboard_figures,
    "cases_by_stage": cases_by_stage,
    "outcome_pivot": outcome_pivot,
    "case_list": case_list,
    "case_list_of_payer_and_stage": lambda s, d: case_list(s, d, 3, "submitted", "1-URGENT"),
    "case_list_overdue": lambda s, d: case_list(s, d, 3, window="overdue"),
    "case_list_week": lambda s, d: case_list(s, d, window="week"),
    "case_list_month": lambda s, d: case_list(s, d, window="month"),
    "payers": payers,
    "review_queue_clinical": lambda s, d: review_queue(s, d, "clinical"),
    "review_queue_legal_scoped": lambda s, d: review_queue(s, d, "legal", [1, 2, 3, 5, 8, 13, 21]),
    "review_queue_without_scope": lambda s, d: review_queue(s, d, "legal", []),
    "review_marks": review_marks,
    "review_history": review_history,
    "latest_verdicts": verdicts,
    "team": team,
    "invoice_list": invoice_list,
    "unbilled": unbilled,
}
ORACLE = {
    "dashboard_figures": f"""{with_views("denial", "outcome", "invoice")}
select organization_id, count(*) as cases, coalesce(sum(recovered_cents), 0)::bigint as recovered_cents,
  coalesce(sum(recovered_cents) filter (where decided_at >= date_trunc('month', {NOW})), 0)::bigint as recovered_month_cents,
  coalesce(sum(claim_cents) filter (where status in ({OPEN})), 0)::bigint as at_risk_cents,
  count(*) filter (where result = 'won') as won, count(*) filter (where result = 'lost') as lost,
  count(*) filter (where result = 'partial') as partial, count(*) filter (where result = 'withdrawn') as withdrawn,
  floor(count(*) filter (where result in ('won', 'partial')) / nullif(count(result), 0)::double * 100 + 0.5)::bigint as win_rate_percent,
  floor(avg((epoch_us(decided_at) - epoch_us(created_at)) / 86400000000.0) + 0.5)::bigint as average_days,
  count(*) filter (where status in ({LIVE}) and deadline between {NOW} and {NOW} + interval 7 days) as due_in_7_days,
  count(*) filter (where status in ({LIVE}) and deadline < {NOW}) as deadlines_passed,
  coalesce((select sum(fee_cents) from invoice i where i.organization_id = denial.organization_id), 0)::bigint as fees_billed_cents
from denial left join outcome using (denial_id) group by organization_id""",
    "cases_by_stage": f"{with_views('denial')} select organization_id, status, count(*) as cases, sum(claim_cents)::bigint as claim_cents from denial group by all",
    "outcome_pivot": f"""{with_views("denial", "outcome")} select organization_id, count(*) filter (where result = 'won') as won, count(*) filter (where result = 'lost') as lost,
  count(*) filter (where result = 'partial') as partial, count(*) filter (where result = 'withdrawn') as withdrawn from outcome join denial using (denial_id) group by organization_id""",
    "case_list": _case_list_sql(),
    "case_list_of_payer_and_stage": _case_list_sql("organization_id = 3 and status = 'submitted' and payer_name = '1-URGENT'"),
    "case_list_overdue": _case_list_sql(f"organization_id = 3 and deadline <= {NOW}"),
    "case_list_week": _case_list_sql(f"deadline between {NOW} and {NOW} + interval 7 days"),
    "case_list_month": _case_list_sql(f"deadline between {NOW} and {NOW} + interval 30 days"),
    "payers": f"{with_views('denial')} select distinct organization_id, payer_name from denial",
    "review_queue_clinical": _review_queue_sql("clinical_review"),
    "review_queue_legal_scoped": _review_queue_sql("legal_review", "c.organization_id in (1, 2, 3, 5, 8, 13, 21)"),
    "review_queue_without_scope": _review_queue_sql("legal_review", "false"),
    "review_marks": f"""{with_views("assertion", "assertion_review")} select draft_id, reviewer_id, count(*) filter (where verified) as verified,
  '{{' || string_agg('"' || assertion_id || '":' || verified, ',' order by assertion_id) || '}}' as marks
from assertion_review join assertion using (assertion_id) group by draft_id, reviewer_id""",
    "review_history": f"""{with_views("review_action")} select draft_id, review_id, review_type, reviewer_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at
from review_action where action = 'rejected'""",
    "latest_verdicts": f"{with_views('review_action')} {verdict_sql()}",
    "team": f"{with_views('member', 'app_user')} select organization_id, user_id, name, email, role, status from member join app_user using (user_id)",
    "invoice_list": f"""{with_views("invoice")} select organization_id, number, strftime(period_start, '%Y-%m-%d %H:%M:%S') as period_start, total_recovered_cents,
  case when rate_bps % 100 = 0 then (rate_bps // 100) || '%' else (rate_bps // 100) || '.' || rtrim(lpad((rate_bps % 100)::varchar, 2, '0'), '0') || '%' end as rate, fee_cents, status from invoice""",
    "unbilled": f"""{with_views("denial", "outcome")} select organization_id, sum(recovered_cents)::bigint as unbilled_cents, count(*) as outcomes
from outcome join denial using (denial_id) where invoice_id is null and recovered_cents > 0 group by organization_id""",
}
