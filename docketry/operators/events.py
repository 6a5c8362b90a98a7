"""Decisions over event streams: job drains, deadline warnings, send schedules, what rate limits keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.numbers import backoff_minutes

#: Minutes between two messages of a campaign, jobs drained at once, kinds of jobs that have a handler.
STAGGER_MINUTES = 2
JOB_BATCH, HANDLED = 20, ("campaign_send",)


def prune_buckets(hits: DataFrame, as_of: Column, at: str = "at", hours: int = 24) -> DataFrame:
    """Hits young enough to matter to any limit."""
    return hits.where(F.col(at) >= as_of - F.make_dt_interval(hours=F.lit(hours)))


def due_jobs(jobs: DataFrame, as_of: Column, batch: int = JOB_BATCH) -> DataFrame:
    """The next pending jobs that are due, the longest overdue first."""
    return jobs.where((F.col("status") == "pending") & (F.col("run_after") <= as_of)).orderBy("run_after", "job_id").limit(batch)


def drained(due: DataFrame, failures: DataFrame, as_of: Column, handled: tuple[str, ...] = HANDLED) -> DataFrame:
    """What due jobs become: done, or pending again with a backoff, or failed.

    failures (job_id, error) are the jobs whose handler raised. A kind without a handler
    fails at once; a handler's failure fails the job at its last attempt.
    """
    attempts = F.col("attempts") + 1
    known, raised = F.col("kind").isin(*handled), F.col("error").isNotNull()
    status = F.when(~known, "failed").when(~raised, "done").when(attempts >= F.col("max_attempts"), "failed").otherwise("pending")
    error = F.when(~known, F.concat(F.lit("No handler for job kind "), F.col("kind"), F.lit("."))).otherwise(F.col("error"))
    again = as_of + F.make_dt_interval(mins=backoff_minutes(attempts))
    rows = due.join(failures.select("job_id", "error"), "job_id", "left")
    return rows.select(
        "job_id", "kind", status.alias("status"), attempts.alias("attempts"), error.alias("last_error"),
        F.when(known & raised, again).otherwise(F.col("run_after")).alias("run_after"),
    )


def deadline_warnings(
    cases: DataFrame, organizations: DataFrame, recipients: DataFrame, sent: DataFrame, as_of: Column, live: tuple[str, ...], days: tuple[int, ...] = (14, 7)
) -> DataFrame:
    """(denial_id, days, subject, email) of warnings that are due and have not been sent.

    A case is due n days ahead if its deadline lies within [n - 1, n] days, both ends
    included, it is at a live stage and its organization is active. Whether a warning
    was sent is told by its subject, which names the case and the days.
    """
    ahead = lambda n: as_of + F.make_dt_interval(days=n)
    soon = cases.where(F.col("status").isin(*live) & F.col("deadline").between(as_of, ahead(F.lit(max(days)))))
    each = soon.withColumn("days", F.explode(F.array(*map(F.lit, days)))).where(F.col("deadline").between(ahead(F.col("days") - 1), ahead(F.col("days"))))
    active = organizations.where(F.col("status") == "active").select("organization_id")
    subject = F.concat(F.lit("Appeal due in "), F.col("days").cast("string"), F.lit(" days: "), F.col("internal_ref"))
    due = each.join(active, "organization_id").withColumn("subject", subject)
    due = due.join(sent.select("subject").distinct(), "subject", "left_anti")
    return due.join(recipients, "organization_id").select("denial_id", "days", "subject", "email")


def send_schedule(contacts: DataFrame, campaigns: list[int], sent: DataFrame, start: Column, minutes: int = STAGGER_MINUTES) -> DataFrame:
    """(campaign_id, contact_id, place, run_after) of messages to subscribed contacts not yet sent.

    Each campaign sends one message every few minutes, in the order of contact ids. The
    places are counted in two steps, by ranges of ids, so that a campaign with very many
    contacts is not numbered in one task.
    """
    pairs = contacts.where(~F.col("unsubscribed")).select("contact_id", F.explode(F.array(*[F.lit(c) for c in campaigns])).alias("campaign_id"))
    left = pairs.join(sent.select("campaign_id", "contact_id").distinct(), ["campaign_id", "contact_id"], "left_anti")
    left = left.withColumn("_range", F.floor(F.col("contact_id") / 10_000))
    before = left.groupBy("campaign_id", "_range").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy("campaign_id").orderBy("_range")
    before = before.select("campaign_id", "_range", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("campaign_id", "_range").orderBy("contact_id"))
    placed = left.withColumn("_i", inside).join(before, ["campaign_id", "_range"]).withColumn("place", F.col("_before") + F.col("_i") - 1)
    return placed.select("campaign_id", "contact_id", "place", (start + F.make_dt_interval(mins=F.col("place").cast("int") * minutes)).alias("run_after"))
