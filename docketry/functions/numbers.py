"""Money, rounding and time as Column expressions. Money is whole cents throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000
BPS = 10_000


def half_up(c: Column) -> Column:
    """Nearest whole number, halves towards positive infinity."""
    return F.floor(c + 0.5)


def half_even(c: Column) -> Column:
    """Nearest whole number, halves to even ones, as a cast from double to int rounds in SQL databases."""
    return F.rint(c).cast("long")


def fee_cents(recovered_cents: Column, rate_bps: Column) -> Column:
    """floor(cents * rate / 10000); nothing on takebacks. A rate that is no share raises."""
    checked = F.when(rate_bps.between(0, BPS), rate_bps).otherwise(
        F.raise_error(F.concat(F.lit("not a rate between 0 and 10000 basis points: "), rate_bps.cast("string"))).cast("long")
    )
    product = recovered_cents.cast("decimal(19,0)") * checked.cast("decimal(5,0)")
    return F.when(recovered_cents <= 0, F.lit(0).cast("long")).otherwise(F.floor(product / BPS).cast("long"))


def rate_text(rate_bps: Column) -> Column:
    """1250 as 12.5%."""
    fraction = F.regexp_replace(F.lpad((rate_bps % 100).cast("string"), 2, "0"), "0$", "")
    whole = F.floor(rate_bps / 100).cast("string")
    return F.when(rate_bps % 100 == 0, F.concat(whole, F.lit("%"))).otherwise(F.concat(whole, F.lit("."), fraction, F.lit("%")))


def invoice_number(slug: Column, period_start: Column, sequence: Column) -> Column:
    """SLUG-YYYYMM-NNN; a sequence above 999 keeps all its digits."""
    n = sequence.cast("string")
    return F.concat_ws("-", F.upper(slug), F.date_format(period_start, "yyyyMM"), F.lpad(n, F.greatest(F.length(n), F.lit(3)), F.lit("0")))


def cents_of(text: Column, empty_is_zero: bool = False) -> Column:
    """Typed dollars to cents; null if they do not look like an amount."""
    plain = F.regexp_replace(text, r"[$,\s]", "")
    whole = F.regexp_extract(plain, r"^(\d+)", 1)
    fraction = F.rpad(F.regexp_extract(plain, r"\.(\d{1,2})$", 1), 2, "0")
    amount = F.when(plain.rlike(r"^\d+(\.\d{1,2})?$"), whole.cast("long") * 100 + fraction.cast("long"))
    return F.when(plain == "", F.lit(0).cast("long")).otherwise(amount) if empty_is_zero else amount


def bps_of(text: Column) -> Column:
    """A typed percentage to basis points; null outside 0 to 100. Blank text counts as 0."""
    plain = F.trim(text)
    number = F.when(plain == "", F.lit(0.0)).otherwise(plain.try_cast("double"))
    return F.when(number.between(0, 100), half_up(number * 100).cast("long"))


def _dollar(amount: Column, digits: int) -> Column:
    return F.concat(F.when(amount < 0, F.lit("-$")).otherwise(F.lit("$")), F.format_number(F.abs(amount), digits))


def format_cents(cents: Column) -> Column:
    """1234567 as $12,345.67."""
    return _dollar((cents / 100).cast("decimal(18,2)"), 2)


def format_dollars(cents: Column) -> Column:
    """1234567 as $12,346: halves up."""
    return _dollar(half_up(cents / 100), 0)


def model_cost_cents(prompt_tokens: Column, completion_tokens: Column) -> Column:
    """Fixed prices of 300 and 1500 cents a million tokens, rounded up."""
    return F.ceil(prompt_tokens / 1e6 * 300 + completion_tokens / 1e6 * 1500)


def backoff_minutes(attempts: Column) -> Column:
    return F.least(F.pow(F.lit(2), attempts), F.lit(60)).cast("long")


def days_until(deadline: Column, as_of: Column) -> Column:
    """Whole days left, a part of a day counts as one; null without a deadline."""
    return F.ceil((F.unix_micros(deadline) - F.unix_micros(as_of)) / F.lit(DAY_MICROS)).cast("long")


def deadline_tone(days: Column) -> Column:
    """Urgent within a week or after the deadline, else neutral, as are cases without one."""
    return F.when(days <= 7, "denied").otherwise("neutral")


def average_days(later: Column, earlier: Column) -> Column:
    return F.avg((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(float(DAY_MICROS)))


def share(part: Column, whole: Column) -> Column:
    """part / whole, null if there is no whole."""
    return F.when(whole != 0, part / whole)


def date_range(first: Column, last: Column) -> Column:
    """Two dates as one phrase; a missing one leaves the other alone."""
    a, b = F.date_format(first, "yyyy-MM-dd"), F.date_format(last, "yyyy-MM-dd")
    return F.when(a.isNull() & b.isNull(), "not stated").otherwise(F.concat_ws(" to ", a, b))


def dates_in_order(first: Column, last: Column) -> Column:
    """Whether a period does not end before it begins; a missing date is no fault."""
    return F.coalesce(first <= last, F.lit(True))
