"""Event-like queries: rate limits, job drains, deadline warnings, schedules, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.numbers import backoff_minutes
from docketry.functions.texts import first_name
from docketry.operators import events, governance, limits
from docketry.plans.adapters import AS_OF, EVENTS_AS_OF, LIVE_STAGES, text, view, with_views
from docketry.plans.reporting import moment
from docketry.runtime import table

NOW, CASES_NOW = f"timestamp '{EVENTS_AS_OF}'", f"timestamp '{AS_OF}'"
LIMIT, WINDOW = 3, 6 * 3600


def _now(s: str = EVENTS_AS_OF):
    return F.lit(s).cast("timestamp")


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("hit_id"))


def rate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each event is within its user's limit, in windows that the first hit opens."""
    return limits.rate_limit(_hits(spark, sf_dir), LIMIT, WINDOW).select("key", "hit_id", "allowed", "remaining", "retry_after_seconds")


def kept_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.prune_buckets(_hits(spark, sf_dir), _now()).agg(F.count("*").alias("hits"), F.count_distinct("key").alias("keys"))


def due_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.due_jobs(view(spark, sf_dir, "job"), _now()).select("job_id", "kind", "attempts", moment("run_after"))


def drained_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the next batch of jobs becomes if every third handler fails."""
    due = events.due_jobs(view(spark, sf_dir, "job"), _now(), 200)
    failures = due.where("job_id % 3 = 0").select("job_id", F.lit("mailbox full").alias("error"))
    return events.drained(due, failures, _now()).select("job_id", "status", "attempts", "last_error", moment("run_after"))


def backoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "job").select("attempts").distinct()
    return rows.select("attempts", backoff_minutes(F.col("attempts")).alias("minutes"))


def deadline_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    recipients = view(spark, sf_dir, "member").where(F.col("role").isin("org_admin", "appeal_specialist")).join(
        view(spark, sf_dir, "app_user").where("status = 'active'").select("user_id", "email"), "user_id"
    )
    rows = events.deadline_warnings(
        view(spark, sf_dir, "denial"), view(spark, sf_dir, "organization"), recipients.select("organization_id", "email"), view(spark, sf_dir, "email_send"), _now(AS_OF), LIVE_STAGES
    )
    return rows.select("denial_id", "days", "subject", "email")


def campaign_recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who a campaign still has to reach, and when, one message every two minutes."""
    rows = events.send_schedule(view(spark, sf_dir, "contact"), [0, 1, 2, 3, 4], view(spark, sf_dir, "email_send"), _now())
    return rows.select("campaign_id", "contact_id", "place", moment("run_after"))


def audit_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = governance.audit_rows(view(spark, sf_dir, "audit_log")).where(F.col("created_at") >= _now()).orderBy(F.desc("created_at"), "audit_id").limit(200)
    return rows.select("audit_id", "user_id", "action", "entity_type", "entity_id", "phi", moment("created_at"))


def audit_of_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = governance.audit_rows(view(spark, sf_dir, "audit_log")).where("entity_type = 'denial' and entity_id = 15").orderBy(F.desc("created_at"), "audit_id")
    return rows.select("audit_id", "action", "phi", moment("created_at"))


def case_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty latest events about each case, with who did them."""
    from pyspark.sql import Window

    rows = view(spark, sf_dir, "audit_log").where("entity_type = 'denial'")
    order = Window.partitionBy("entity_id").orderBy(F.desc("created_at"), F.desc("audit_id"))
    last = rows.withColumn("n", F.row_number().over(order)).where("n <= 50")
    named = last.join(view(spark, sf_dir, "app_user").select("user_id", "name"), "user_id", "left")
    return named.select(F.col("entity_id").alias("denial_id"), "audit_id", "action", first_name(F.translate("name", "#", " ")).alias("who"), moment("created_at"))


QUERIES = {
    "rate_limits": rate_limits,
    "kept_buckets": kept_buckets,
    "due_jobs": due_jobs,
    "drained_jobs": drained_jobs,
    "backoffs": backoffs,
    "deadline_warnings": deadline_warnings,
    "campaign_recipients": campaign_recipients,
    "audit_recent": audit_recent,
    "audit_of_entity": audit_of_entity,
    "case_timeline": case_timeline,
}
_DUE = f"select * from job where status = 'pending' and run_after <= {NOW} order by run_after, job_id limit"
ORACLE = {
    "rate_limits": f"""with recursive h as (select user_id as key, event_id as hit_id, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as n from events),
f as (select key, hit_id, n, t, t as opened, 1 as hits from h where n = 1
  union all select h.key, h.hit_id, h.n, h.t, case when h.t - f.opened > {WINDOW}000000 then h.t else f.opened end, case when h.t - f.opened > {WINDOW}000000 then 1 else f.hits + 1 end
  from f join h on h.key = f.key and h.n = f.n + 1)
select key, hit_id, hits <= {LIMIT} as allowed, greatest({LIMIT} - hits, 0)::integer as remaining,
  case when hits <= {LIMIT} then 0 else greatest(1, ceil({WINDOW} - (t - opened) / 1e6::double)) end::integer as retry_after_seconds from f""",
    "kept_buckets": f"select count(*) as hits, count(distinct user_id) as keys from events where ts >= {NOW} - interval 24 hours",
    "due_jobs": f"{with_views('job')}, d as ({_DUE} 20) select job_id, kind, attempts, strftime(run_after, '%Y-%m-%d %H:%M:%S') as run_after from d",
    "drained_jobs": f"""{with_views("job")}, d as ({_DUE} 200), x as (select *, kind = 'campaign_send' as known, job_id % 3 = 0 as raised, attempts + 1 as tried from d)
select job_id, case when not known then 'failed' when not raised then 'done' when tried >= max_attempts then 'failed' else 'pending' end as status, tried as attempts,
  case when not known then 'No handler for job kind ' || kind || '.' when raised then 'mailbox full' end as last_error,
  strftime(case when known and raised then {NOW} + to_minutes(least(2 ** tried, 60)::bigint) else run_after end, '%Y-%m-%d %H:%M:%S') as run_after from x""",
    "backoffs": f"{with_views('job')} select distinct attempts, least(2 ** attempts, 60)::bigint as minutes from job",
    "deadline_warnings": f"""{with_views("denial", "organization", "member", "app_user", "email_send")}, n as (select unnest([14, 7]) as days),
x as (select denial_id, c.organization_id, days, 'Appeal due in ' || days || ' days: ' || internal_ref as subject from denial c, n, organization o
  where o.organization_id = c.organization_id and o.status = 'active' and c.status in ({text(LIVE_STAGES)}) and deadline between {CASES_NOW} + to_days(days - 1) and {CASES_NOW} + to_days(days))
select denial_id, days, subject, u.email from x join member m using (organization_id) join app_user u using (user_id)
where m.role in ('org_admin', 'appeal_specialist') and u.status = 'active' and subject not in (select subject from email_send)""",
    "campaign_recipients": f"""{with_views("contact", "email_send", "campaign")}, p as (select campaign_id, contact_id from campaign, contact where not unsubscribed
  and not exists (select 1 from email_send e where e.campaign_id = campaign.campaign_id and e.contact_id = contact.contact_id)),
n as (select *, row_number() over (partition by campaign_id order by contact_id) - 1 as place from p)
select campaign_id::integer as campaign_id, contact_id, place, strftime({NOW} + to_minutes(2 * place), '%Y-%m-%d %H:%M:%S') as run_after from n""",
    "audit_recent": f"""{with_views("audit_log")} select audit_id, user_id, action, entity_type, entity_id, entity_type in ('denial', 'appeal_draft', 'outcome') as phi,
  strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at from audit_log where audit_log.created_at >= {NOW} order by audit_log.created_at desc, audit_id limit 200""",
    "audit_of_entity": f"{with_views('audit_log')} select audit_id, action, true as phi, strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at from audit_log where entity_type = 'denial' and entity_id = 15",
    "case_timeline": f"""{with_views("audit_log", "app_user")}, r as (select *, row_number() over (partition by entity_id order by created_at desc, audit_id desc) as n from audit_log where entity_type = 'denial')
select entity_id as denial_id, audit_id, action, split_part(translate(name, '#', ' '), ' ', 1) as who, strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at from r left join app_user using (user_id) where n <= 50""",
}
