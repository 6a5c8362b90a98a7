"""The operator's console: spend, jobs, organizations, users, mail, corpus, requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.numbers import format_cents, half_even, share
from docketry.plans.adapters import EVENTS_AS_OF, ORG_ROLES, text, view, with_views
from docketry.plans.reporting import moment

NOW = f"timestamp '{EVENTS_AS_OF}'"


def spend_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "llm_call").groupBy("stage").agg(
        F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("failed"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"), F.sum("cost_cents").alias("cost_cents"),
        half_even(F.percentile("latency_ms", 0.5)).alias("median_latency_ms"),
    )


def spend_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("created_at", "yyyy-MM-dd").alias("day")
    return view(spark, sf_dir, "llm_call").groupBy(day).agg(F.sum("cost_cents").alias("cost_cents"), F.count("*").alias("calls")).orderBy(F.desc("day")).limit(30)


def spend_per_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of a case; calls without a case count into the cost but not into the cases."""
    t = view(spark, sf_dir, "llm_call").agg(F.count_distinct("denial_id").alias("cases"), F.sum("cost_cents").alias("cost_cents"))
    return t.withColumn("cents_per_case", F.floor(share(F.col("cost_cents"), F.col("cases")) + 0.5))


def job_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by status; the limiter's own entries are no work."""
    return view(spark, sf_dir, "job").where(F.col("kind") != "rate_limit").groupBy("status").agg(F.count("*").alias("jobs"))


def recent_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "job").where(F.col("kind") != "rate_limit").orderBy(F.desc("created_at"), "job_id").limit(50)
    return rows.select("job_id", "kind", "status", "attempts", F.get_json_object("payload", "$.k").alias("payload_k"), moment("created_at"))


def jobs_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = (F.col("status") == "pending") & (F.col("run_after") <= F.lit(EVENTS_AS_OF).cast("timestamp"))
    return view(spark, sf_dir, "job").agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(due).alias("due"))


def organizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every organization with its members and fees, zeros included."""
    members = view(spark, sf_dir, "member").groupBy("organization_id").agg(F.count("*").alias("m"))
    fees = view(spark, sf_dir, "invoice").groupBy("organization_id").agg(F.sum("fee_cents").alias("f"))
    rows = view(spark, sf_dir, "organization").join(members, "organization_id", "left").join(fees, "organization_id", "left").orderBy("name")
    return rows.select("organization_id", "name", "status", "rate_bps", F.coalesce("m", F.lit(0)).alias("members"), F.coalesce("f", F.lit(0)).alias("fee_cents"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with their memberships and review assignments as text, in order of names."""
    names = view(spark, sf_dir, "organization").select("organization_id", "name")
    listed = lambda rows, item, out: (
        rows.join(names.withColumnRenamed("name", "org"), "organization_id")
        .groupBy("user_id")
        .agg(F.array_join(F.array_sort(F.collect_list(item)), ", ").alias(out))
    )
    member = listed(view(spark, sf_dir, "member"), F.concat(F.col("org"), F.lit(" ("), F.col("role"), F.lit(")")), "memberships")
    reviews = listed(view(spark, sf_dir, "reviewer_assignment"), F.col("org"), "reviews")
    rows = view(spark, sf_dir, "app_user").join(member, "user_id", "left").join(reviews, "user_id", "left").orderBy("name")
    return rows.select("user_id", "name", "email", "platform_role", "status", "memberships", "reviews")


def campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    sends = view(spark, sf_dir, "email_send").groupBy("campaign_id").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("queued", "sent", "failed")], F.count("sent_at").alias("with_time")
    )
    rows = view(spark, sf_dir, "campaign").join(sends, "campaign_id", "left").na.fill(0)
    return rows.select("campaign_id", "name", "queued", "sent", "failed", "with_time")


def contact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "contact").agg(F.count("*").alias("contacts"), F.count_if("unsubscribed").alias("unsubscribed"))


def contact_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "email_send").where("contact_id = 7").orderBy(F.desc("created_at"), "send_id")
    return rows.select("send_id", "campaign_id", "subject", "status", moment("created_at"))


def all_cases(spark: SparkSession, sf_dir: str, status: str | None = None) -> DataFrame:
    cases = view(spark, sf_dir, "denial")
    cases = cases.where(F.col("status") == status) if status else cases
    rows = cases.join(view(spark, sf_dir, "organization").select("organization_id", "name"), "organization_id")
    rows = rows.join(view(spark, sf_dir, "outcome").select("denial_id", "result", "recovered_cents"), "denial_id", "left")
    rows = rows.orderBy(F.desc("created_at"), "denial_id").limit(500)
    return rows.select("denial_id", F.col("name").alias("organization_name"), "status", "claim_cents", format_cents(F.col("claim_cents")).alias("claim"), "result", "recovered_cents")


def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of five tables."""
    names = ("organization", "app_user", "denial", "source_document", "demo_request")
    counts = [view(spark, sf_dir, n).select(F.lit(n).alias("table_name")).groupBy("table_name").agg(F.count("*").alias("n")) for n in names]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def demo_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "demo_request").orderBy(F.desc("request_id")).limit(200)
    return rows.select("request_id", "email", "org_name", "status", "notified")


def undelivered_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "demo_request").agg(F.count_if(~F.col("notified")).alias("undelivered"), F.count("*").alias("requests"))


def bootstrap_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "app_user").agg((F.count("*") == 0).alias("bootstrap_needed"))


def principals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active users with the organizations that they belong to (active ones, known roles) and may review."""
    active = view(spark, sf_dir, "organization").where("status = 'active'").select("organization_id")
    ids = lambda rows, out: rows.groupBy("user_id").agg(F.array_sort(F.collect_set("organization_id")).alias(out))
    member = ids(view(spark, sf_dir, "member").where(F.col("role").isin(*ORG_ROLES)).join(active, "organization_id"), "m")
    reviews = ids(view(spark, sf_dir, "reviewer_assignment"), "r")
    rows = view(spark, sf_dir, "app_user").where("status = 'active'").join(member, "user_id", "left").join(reviews, "user_id", "left")
    joined = lambda c: F.coalesce(F.array_join(F.col(c).cast("array<string>"), ","), F.lit(""))
    return rows.select("user_id", "platform_role", joined("m").alias("member_of"), joined("r").alias("reviews"))


QUERIES = {
    "spend_by_stage": spend_by_stage,
    "spend_daily": spend_daily,
    "spend_per_case": spend_per_case,
    "job_counts": job_counts,
    "recent_jobs": recent_jobs,
    "jobs_left": jobs_left,
    "organizations": organizations,
    "users": users,
    "campaigns": campaigns,
    "contact_counts": contact_counts,
    "contact_history": contact_history,
    "all_cases": all_cases,
    "all_cases_decided": lambda s, d: all_cases(s, d, "decided"),
    "overview": overview,
    "demo_requests": demo_requests,
    "undelivered_requests": undelivered_requests,
    "bootstrap_needed": bootstrap_needed,
    "principals": principals,
}


def _all_cases_sql(where: str = "true") -> str:
    return f"""{with_views("denial", "organization", "outcome")} select denial_id, o.name as organization_name, denial.status, claim_cents,
  '$' || format('{{:,}}', claim_cents // 100) || '.' || lpad((claim_cents % 100)::varchar, 2, '0') as claim, result, recovered_cents
from denial join organization o using (organization_id) left join outcome using (denial_id) where {where} order by created_at desc, denial_id limit 500"""


ORACLE = {
    "spend_by_stage": f"""{with_views("llm_call")} select stage, count(*) as calls, count(*) filter (where not ok) as failed, sum(prompt_tokens)::bigint as prompt_tokens,
  sum(completion_tokens)::bigint as completion_tokens, sum(cost_cents)::bigint as cost_cents, round_even(quantile_cont(latency_ms, 0.5), 0)::bigint as median_latency_ms
from llm_call group by stage""",
    "spend_daily": f"""{with_views("llm_call")} select strftime(created_at, '%Y-%m-%d') as day, sum(cost_cents)::bigint as cost_cents, count(*) as calls
from llm_call group by 1 order by 1 desc limit 30""",
    "spend_per_case": f"""{with_views("llm_call")} select count(distinct denial_id) as cases, sum(cost_cents)::bigint as cost_cents,
  floor(sum(cost_cents) / nullif(count(distinct denial_id), 0)::double + 0.5)::bigint as cents_per_case from llm_call""",
    "job_counts": f"{with_views('job')} select status, count(*) as jobs from job where kind <> 'rate_limit' group by status",
    "recent_jobs": f"""{with_views("job")} select job_id, kind, status, attempts, payload->>'$.k' as payload_k, strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at
from job where kind <> 'rate_limit' order by job.created_at desc, job_id limit 50""",
    "jobs_left": f"{with_views('job')} select count(*) filter (where status = 'pending') as pending, count(*) filter (where status = 'pending' and run_after <= {NOW}) as due from job",
    "organizations": f"""{with_views("organization", "member", "invoice")} select organization_id, name, status, rate_bps,
  (select count(*) from member m where m.organization_id = o.organization_id) as members,
  coalesce((select sum(fee_cents) from invoice i where i.organization_id = o.organization_id), 0)::bigint as fee_cents from organization o""",
    "users": f"""{with_views("app_user", "member", "reviewer_assignment", "organization")} select user_id, name, email, platform_role, status,
  (select string_agg(o.name || ' (' || m.role || ')', ', ' order by o.name || ' (' || m.role || ')') from member m join organization o using (organization_id) where m.user_id = u.user_id) as memberships,
  (select string_agg(o.name, ', ' order by o.name) from reviewer_assignment m join organization o using (organization_id) where m.user_id = u.user_id) as reviews from app_user u""",
    "campaigns": f"""{with_views("campaign", "email_send")} select campaign_id, name,
  (select count(*) from email_send e where e.campaign_id = c.campaign_id and status = 'queued') as queued, (select count(*) from email_send e where e.campaign_id = c.campaign_id and status = 'sent') as sent,
  (select count(*) from email_send e where e.campaign_id = c.campaign_id and status = 'failed') as failed, (select count(sent_at) from email_send e where e.campaign_id = c.campaign_id) as with_time
from campaign c""",
    "contact_counts": f"{with_views('contact')} select count(*) as contacts, count(*) filter (where unsubscribed) as unsubscribed from contact",
    "contact_history": f"{with_views('email_send')} select send_id, campaign_id, subject, status, strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at from email_send where contact_id = 7",
    "all_cases": _all_cases_sql(),
    "all_cases_decided": _all_cases_sql("denial.status = 'decided'"),
    "overview": with_views("organization", "app_user", "denial", "source_document", "demo_request")
    + " union all ".join(f" select '{n}' as table_name, count(*) as n from {n}" for n in ("organization", "app_user", "denial", "source_document", "demo_request")),
    "demo_requests": f"{with_views('demo_request')} select request_id, email, org_name, status, notified from demo_request order by request_id desc limit 200",
    "undelivered_requests": f"{with_views('demo_request')} select count(*) filter (where not notified) as undelivered, count(*) as requests from demo_request",
    "bootstrap_needed": f"{with_views('app_user')} select count(*) = 0 as bootstrap_needed from app_user",
    "principals": f"""{with_views("app_user", "member", "reviewer_assignment", "organization")} select user_id, platform_role,
  coalesce((select string_agg(m.organization_id::varchar, ',' order by m.organization_id) from (select distinct organization_id from member x join organization o using (organization_id)
    where x.user_id = u.user_id and o.status = 'active' and x.role in ({text(ORG_ROLES)})) m), '') as member_of,
  coalesce((select string_agg(organization_id::varchar, ',' order by organization_id) from reviewer_assignment r where r.user_id = u.user_id), '') as reviews
from app_user u where status = 'active'""",
}
