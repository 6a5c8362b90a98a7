"""Contingency billing: which outcomes are billed, what each costs, and the invoices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.numbers import fee_cents, invoice_number


#: Why an outcome is not billed.
EXCLUDED = {
    "billed": "already billed on an earlier invoice",
    "outside": "decided outside this period",
    "nothing": ", so nothing was recovered and nothing is owed",
    "no dollars": "no dollars recovered",
}


def exclusion_reason(result: Column, recovered_cents: Column, decided_at: Column, invoice_id: Column, start: Column, end: Column) -> Column:
    """Why an outcome is not billed in a period, null if it is; both ends of the period belong to it."""
    return (
        F.when(invoice_id.isNotNull(), EXCLUDED["billed"])
        .when((decided_at < start) | (decided_at > end), EXCLUDED["outside"])
        .when(result.isin("lost", "withdrawn"), F.concat(result, F.lit(EXCLUDED["nothing"])))
        .when(recovered_cents <= 0, EXCLUDED["no dollars"])
    )


def billed_lines(outcomes: DataFrame, start: Column, end: Column) -> DataFrame:
    """outcomes with ``excluded_reason`` and ``fee_cents``, 0 for those excluded.

    outcomes need result, recovered_cents, decided_at, invoice_id and rate_bps.
    """
    reason = exclusion_reason(F.col("result"), F.col("recovered_cents"), F.col("decided_at"), F.col("invoice_id"), start, end)
    fee = F.when(F.col("excluded_reason").isNull(), fee_cents(F.col("recovered_cents"), F.col("rate_bps"))).otherwise(F.lit(0).cast("long"))
    return outcomes.withColumn("excluded_reason", reason).withColumn("fee_cents", fee)


def invoice_totals(lines: DataFrame, *keys: str) -> DataFrame:
    """Totals of the billed lines of each key: the fee is the sum of whole-cent line fees."""
    billed = F.col("excluded_reason").isNull()
    return lines.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(billed, F.col("recovered_cents"))), F.lit(0)).alias("total_recovered_cents"),
        F.sum("fee_cents").alias("fee_cents"),
        F.count_if(billed).alias("lines"),
        F.count_if(~billed).alias("excluded"),
    )


def issue_invoices(lines: DataFrame, organizations: DataFrame, start: Column, earlier: DataFrame | None = None) -> DataFrame:
    """One numbered invoice per organization that has billed lines.

    Numbers go on from the invoices an organization had before; several periods of one
    organization are numbered in their order.
    """
    totals = invoice_totals(lines.where(F.col("excluded_reason").isNull()).withColumn("period_start", start), "organization_id", "period_start")
    order = F.row_number().over(Window.partitionBy("organization_id").orderBy("period_start"))
    numbered = totals.withColumn("_n", order)
    if earlier is not None:
        before = earlier.groupBy("organization_id").agg(F.count("*").alias("_before"))
        numbered = numbered.join(before, "organization_id", "left")
        numbered = numbered.withColumn("_n", F.col("_n") + F.coalesce("_before", F.lit(0))).drop("_before")
    named = numbered.join(organizations.select("organization_id", "slug", "rate_bps"), "organization_id")
    return named.withColumn("number", invoice_number(F.col("slug"), F.col("period_start"), F.col("_n"))).drop("_n", "slug", "excluded")


def outcome_errors(result: Column, recovered_cents: Column) -> Column:
    """What is wrong with a recorded outcome, null if nothing is."""
    return (
        F.when(~result.isin("won", "lost", "partial", "withdrawn"), "unknown result")
        .when(result.isin("lost", "withdrawn") & (recovered_cents != 0), "a lost or withdrawn appeal recovers nothing")
        .when(result.isin("won", "partial") & ~F.coalesce(recovered_cents > 0, F.lit(False)), "a won or partial appeal recovers something")
    )
