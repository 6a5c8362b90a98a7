"""Fill-in-middle transformation: whole batches rewritten by DuckDB inside mapInArrow.

Every Arrow batch is registered as a view of an in-memory database and one SQL statement
turns it into the result, which goes back as Arrow: no Python code sees a row. A text is
cut into units by ``regexp_extract_all``; two units drawn from a hash of the document's
id bound the middle; ``list_slice`` and ``array_to_string`` put the parts together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.columns import field, released
from docketry.runtime import table

#: Units of a text, and the marks before prefix, suffix and middle.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Seed of the draws, documents that are rearranged in 100, and those of them with the suffix first.
SEED, REARRANGED, SUFFIX_FIRST = 42, 50, 80
#: A batch goes to the database in lots of so many rows, and of so many bytes of text or one row.
ROWS, BYTES = 512, 8 << 20


def filled_sql(seed: int = SEED, rearranged: int = REARRANGED, suffix_first: int = SUFFIX_FIRST) -> str:
    """SQL of (id, text, n, form, prefix, middle, suffix, output) over a view ``batch`` of (id, text)."""
    marked = " OR ".join(f"contains(text, '{m}')" for m in (PREFIX, SUFFIX, MIDDLE))
    draws = ", ".join(f"('0x' || substr(draw, {8 * i + 1}, 8))::BIGINT AS h{i + 1}" for i in range(4))
    return f"""
        WITH units AS (
            SELECT id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{UNIT}') AS units,
                sha256('{seed}:' || coalesce(id::VARCHAR, '')) AS draw
            FROM batch
        ), drawn AS (SELECT *, len(units) AS n, {draws} FROM units
        ), bounds AS (
            SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                CASE WHEN text = '' OR {marked} OR h3 % 100 >= {rearranged} THEN 'plain'
                    WHEN h4 % 100 < {suffix_first} THEN 'spm' ELSE 'psm' END AS form
            FROM drawn
        ), parts AS (
            SELECT id, text, n, form,
                CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, 1, a), '') END AS prefix,
                CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, a + 1, b), '') END AS middle,
                CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, b + 1, n), '') END AS suffix
            FROM bounds
        )
        SELECT *, CASE form WHEN 'plain' THEN text
            WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
            ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END AS output
        FROM parts"""


def restored_sql(output: str = "output", form: str = "form") -> str:
    """SQL of the text that an output of a form was made from.

    A rearranged text has no mark of its own and no mark overlaps another, so each mark is in the output once.
    """
    head, middle = f"split_part({output}, '{MIDDLE}', 1)", f"split_part({output}, '{MIDDLE}', 2)"
    psm = f"substr(split_part({head}, '{SUFFIX}', 1), {len(PREFIX) + 1}) || {middle} || split_part({head}, '{SUFFIX}', 2)"
    spm = f"split_part({head}, '{PREFIX}', 2) || {middle} || substr(split_part({head}, '{PREFIX}', 1), {len(SUFFIX) + 1})"
    return f"CASE {form} WHEN 'psm' THEN {psm} WHEN 'spm' THEN {spm} ELSE {output} END"


def lots(batch: pa.RecordBatch, texts: int, rows: int = ROWS, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most so many rows, and of at most so many bytes of text or one row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(texts)), 0), np.int64)
    upto = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        fit = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")) - at
        n = max(1, min(fit, rows))
        yield batch.slice(at, n)
        at += n


def in_duckdb(df: DataFrame, sql: str, schema: str, texts: int = 1) -> DataFrame:
    """The rows of SQL over each batch of df, which it knows as the view ``batch``; ``texts`` is the place of the long column.

    A task has one database in memory, with one thread, no files and no extensions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(":memory:", config={"threads": 1, "temp_directory": "", "autoinstall_known_extensions": False}) as con:
            for batch in batches:
                for lot in lots(batch, texts):
                    con.register("batch", pa.Table.from_batches([lot]))
                    yield from con.sql(sql).to_arrow_table().to_batches()
                    con.unregister("batch")

    return df.mapInArrow(released(run), schema)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **draws: int) -> DataFrame:
    """(id column, n, form, prefix, middle, suffix, output) of every document; ``draws`` are the arguments of filled_sql.

    n is the number of units. Plain documents are their own output and have null parts:
    empty ones, those that contain a mark, and those that the draw leaves as they are. A
    null text is empty; a null id draws as an empty one. Repeated rows draw alike and
    stay, an empty table gives an empty result, and further columns are not carried, so
    names cannot clash. Texts of any length are cut whole.
    """
    schema = f"{field(docs.schema, id_col, 'id')}, n long, form string, prefix string, middle string, suffix string, output string"
    sql = f"SELECT id, n, form, prefix, middle, suffix, output FROM ({filled_sql(**draws)})"
    return in_duckdb(_texts(docs, id_col, text_col), sql, schema).withColumnRenamed("id", id_col)


def restore(filled: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id column, text) of outputs and their forms: what fill_in_middle was given. A null output gives a null text."""
    schema = f"{field(filled.schema, id_col, 'id')}, text string"
    rows = filled.select(F.col(id_col).alias("id"), "output", "form")
    return in_duckdb(rows, f"SELECT id, {restored_sql()} AS text FROM batch", schema).withColumnRenamed("id", id_col)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n, form, lengths of prefix and middle, and hashes of output and restored text; made in one pass, so no text comes back."""
    sql = f"""SELECT id, n, form, length(prefix) AS prefix_chars, length(middle) AS middle_chars,
        sha256(output) AS output_sha256, sha256({restored_sql()}) AS restored_sha256 FROM ({filled_sql()})"""
    schema = f"{field(docs.schema, id_col, 'id')}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return in_duckdb(_texts(docs, id_col, text_col), sql, schema).withColumnRenamed("id", id_col)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op11_fill_in_middle": op11_fill_in_middle}
#: Bounds counted in characters instead of units; the restored text is the text.
ORACLE = {
    "op11_fill_in_middle": rf"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, list_transform(regexp_extract_all(coalesce(text, ''), '{UNIT}'), lambda u: length(u)) AS lengths,
                list_transform([0, 1, 2, 3], lambda i: ('0x' || sha256('42:' || doc_id)[8 * i + 1 : 8 * i + 8])::BIGINT) AS h
            FROM documents
        ), b AS (
            SELECT *, len(lengths) AS n, least(h[1] % (n + 1), h[2] % (n + 1)) AS lo, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS hi,
                coalesce(list_sum(lengths[1 : lo]), 0)::BIGINT AS p, coalesce(list_sum(lengths[1 : hi]), 0)::BIGINT AS q,
                t <> '' AND NOT regexp_matches(t, '<[PSM]>') AND h[3] % 100 < 50 AS moved, h[4] % 100 < 80 AS spm
            FROM d
        )
        SELECT doc_id, n, CASE WHEN NOT moved THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
            CASE WHEN moved THEN p END AS prefix_chars, CASE WHEN moved THEN q - p END AS middle_chars,
            sha256(CASE WHEN NOT moved THEN t
                WHEN spm THEN concat('<S>', substr(t, q + 1), '<P>', left(t, p), '<M>', substr(t, p + 1, q - p))
                ELSE concat('<P>', left(t, p), '<S>', substr(t, q + 1), '<M>', substr(t, p + 1, q - p)) END) AS output_sha256,
            sha256(t) AS restored_sha256
        FROM b"""
}
