"""Verbatim quotes against their sources, with offsets into the original text.

Both sides are put into one form: Unicode compatibility form, one kind of quotation mark,
dash and space, no zero-width characters, single spaces, small letters. Offsets count
code points. Candidates meet their sources in an equi-join on the source's key; the
normalising itself has no built-in and runs in Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.runtime import give_back

LEAST_QUOTE = 24
VERIFIED = "reason string, char_start int, char_end int"
#: Characters that mean the same, by what they become.
SAME = {
    "'": "\u2018\u2019\u201a\u201b\u2032\u00b4`",
    '"': "\u201c\u201d\u201e\u201f\u2033",
    "-": "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\u00ad",
    "...": "\u2026",
    " ": "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000",
    "": "\u200b\u200c\u200d\ufeff",
}
TABLE = str.maketrans({c: to for to, chars in SAME.items() for c in chars})
WHITE = re.compile(r"[ \t\n\r\x0b\x0c\u0085\u2028\u2029\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000\ufeff]+")
INK = re.compile(r"[^ \t\n\r\x0b\x0c\u0085\u2028\u2029\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000\ufeff]+")


def fold(s: str) -> str:
    """The form in which texts are compared."""
    return WHITE.sub(" ", unicodedata.normalize("NFKC", s).translate(TABLE)).strip(" ").lower()


def fold_with_places(s: str) -> tuple[str, list[int]]:
    """The form of a source, each character folded for itself, and where each comes from.

    Runs of white space count as one wherever they come from, so for composed text this
    gives what fold gives.
    """
    pieces = [unicodedata.normalize("NFKC", c).translate(TABLE).lower() for c in s]
    flat, origin = "".join(pieces), [i for i, p in enumerate(pieces) for _ in p]
    words = [m.span() for m in INK.finditer(flat)]
    places = [i for n, (a, b) in enumerate(words) for i in (origin[a - 1 : b] if n else origin[a:b])]
    return " ".join(flat[a:b] for a, b in words), places


class _Each(dict):
    """What each character turns into when it is folded for itself."""

    def __missing__(self, c: int) -> str:
        self[c] = to = unicodedata.normalize("NFKC", chr(c)).translate(TABLE).lower()
        return to


EACH = _Each()


def fold_each(s: str) -> str:
    """The form that fold_with_places gives, without the places."""
    return " ".join(INK.findall(s.translate(EACH)))


def place_of(quote: str | None, source: str | None) -> tuple[str | None, int | None, int | None]:
    """Reason, start and end: no reason and the offsets of the first match, or a reason alone."""
    if not quote or not WHITE.sub(" ", quote).strip(" "):
        return "empty_quote", None, None
    if not source or not WHITE.sub(" ", source).strip(" "):
        return "source_missing", None, None
    if len(quote.strip()) < LEAST_QUOTE:
        return "quote_too_short", None, None
    needle = fold(quote)
    if not needle:
        return "empty_quote", None, None
    hay = fold_each(source)
    at = hay.find(needle)
    if at < 0:
        return "not_found_in_source", None, None
    start, end = place_in(source, hay, at), place_in(source, hay, at + len(needle) - 1)
    if start is None or end is None:
        places = fold_with_places(source)[1]
        start, end = places[at], places[at + len(needle) - 1]
    return None, start, end + 1


def place_in(source: str, hay: str, at: int) -> int | None:
    """Where the character at a place of fold_each's form comes from, none if it is a space or characters of the source turn into others than one each."""
    if hay[at] == " " or any(len(EACH[ord(c)]) != 1 for c in set(source)):
        return None
    word = next(islice(INK.finditer(source.translate(EACH)), hay.count(" ", 0, at), None))
    return word.start() + at - hay.rfind(" ", 0, at) - 1


def normalized(c: Column, form: Callable[[str], str] = fold) -> Column:
    @F.pandas_udf("string")
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else form(t))

    return apply(c)


def verified_quote(quote: Column, source: Column) -> Column:
    """struct<reason, char_start, char_end>; reason is null for a verified quote."""

    @F.arrow_udf(VERIFIED)
    def apply(quotes: pa.Array, sources: pa.Array) -> pa.Array:
        found = [place_of(q.as_py(), s.as_py()) for q, s in zip(quotes, sources)]
        give_back()
        columns = zip(*found) if found else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32()))], ["reason", "char_start", "char_end"])

    return apply(quote, source)


def source_texts(holdings: DataFrame, spans: DataFrame, facts: DataFrame) -> DataFrame:
    """(source_kind, source_id, source_text) of everything an assertion may rest on.

    Each input needs an id in its first column and a text in its second.
    """
    tagged = [
        df.select(F.lit(kind).alias("source_kind"), F.col(df.columns[0]).cast("string").alias("source_id"), F.col(df.columns[1]).alias("source_text"))
        for kind, df in (("holding", holdings), ("source_span", spans), ("clinical_fact", facts))
    ]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


def verify_assertions(assertions: DataFrame, sources: DataFrame) -> DataFrame:
    """assertions with ``reason``, ``char_start`` and ``char_end``; a source that is not there is a failure."""
    rows = assertions.withColumn("source_id", F.col("source_id").cast("string")).join(sources, ["source_kind", "source_id"], "left")
    return rows.withColumn("_v", verified_quote(F.col("verbatim_quote"), F.col("source_text"))).select(*assertions.columns, "_v.*")


def draft_verdicts(verified: DataFrame, key: str = "draft_id") -> DataFrame:
    """ok only if a draft has assertions and all are verified; the rate of failures."""
    bad = F.col("reason").isNotNull()
    return verified.groupBy(key).agg(
        (F.count("*") > 0).alias("any"), F.count("*").alias("total"), F.count_if(bad).alias("rejected"), F.avg(bad.cast("double")).alias("failure_rate")
    ).select(key, (F.col("any") & (F.col("rejected") == 0)).alias("ok"), "total", "rejected", "failure_rate")


def assertion_errors() -> Column:
    """What keeps a row from being an assertion at all, null if nothing does."""
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    return (
        F.when(blank("source_id"), "no source")
        .when(blank("verbatim_quote"), "no quote")
        .when(blank("text"), "no text")
        .when(~F.coalesce(F.col("ordinal") >= 1, F.lit(False)), "ordinals start at 1")
    )


def source_kind_fits(kind: Column, source_kind: Column) -> Column:
    """Legal claims rest on holdings and regulations, clinical ones on the record."""
    return F.when(kind == "legal", source_kind.isin("holding", "source_span")).otherwise(source_kind == "clinical_fact")


def first_accepted_attempts(attempts: DataFrame, most: int = 3) -> DataFrame:
    """Of verified assertions with (denial_id, attempt): the first attempt of each case, up to most,
    in which every assertion verifies and cites the right kind of source."""
    good = F.col("reason").isNull() & source_kind_fits(F.col("kind"), F.col("source_kind"))
    each = attempts.where(F.col("attempt") <= most).groupBy("denial_id", "attempt").agg(F.bool_and(good).alias("ok"))
    return each.groupBy("denial_id").agg(F.min(F.when(F.col("ok"), F.col("attempt"))).alias("accepted"), F.max("attempt").alias("tried"))
