"""The Python-backed functions under names for SQL: fold_text, verify_quote, embed_text, spans_of."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docketry.functions.vectors import hash_trigrams
from docketry.operators.spans import spans_of
from docketry.operators.verify import fold, place_of


def register(spark: SparkSession) -> None:
    """Make the functions known to a session's SQL.

    ``select d.doc_id, s.* from docs d, lateral spans_of(d.text) s`` gives located passages.
    embed_text takes text that is small letters, digits and single spaces already.
    """

    @F.pandas_udf("string")
    def fold_text(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else fold(t))

    @F.pandas_udf("reason string, char_start int, char_end int")
    def verify_quote(quotes: pd.Series, sources: pd.Series) -> pd.DataFrame:
        found = pd.DataFrame([place_of(q, s) for q, s in zip(quotes, sources)], columns=["reason", "char_start", "char_end"])
        return found.astype({"char_start": "Int32", "char_end": "Int32"})

    @F.pandas_udf("array<double>")
    def embed_text(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hash_trigrams((t or "").encode("ascii", "ignore")))

    @F.udtf(returnType="ordinal int, page int, char_start int, char_end int, text string, heading_path array<string>")
    class Spans:
        def eval(self, text: str) -> Iterator[tuple]:
            for s in spans_of(text or ""):
                yield tuple(s.values())

    spark.udf.register("fold_text", fold_text)
    spark.udf.register("verify_quote", verify_quote)
    spark.udf.register("embed_text", embed_text)
    spark.udtf.register("spans_of", Spans)
