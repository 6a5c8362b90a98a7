"""Contact lists in CSV exports of any column order, with numbered complaints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.functions.texts import is_email, strip

#: The header spellings of each column, letters only.
HEADERS = {
    "email": ("email", "emailaddress", "workemail"),
    "first_name": ("firstname", "first", "givenname"),
    "last_name": ("lastname", "last", "surname", "familyname"),
    "title": ("title", "jobtitle", "role"),
    "org_name": ("orgname", "organisation", "organization", "company", "hospital"),
}


def cells(line: Column) -> Column:
    """The cells of a CSV line: quotes may hold commas, doubled quotes stand for one."""
    found = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',((?:[^",]|"(?:[^"]|"")*"?)*)'), 1)
    unquote = lambda c: F.replace(F.replace(F.replace(c, F.lit('""'), F.lit("\0")), F.lit('"'), F.lit("")), F.lit("\0"), F.lit('"'))
    return F.transform(found, lambda c: F.when(c == '""', "").otherwise(unquote(c)))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of the lines of text files that are not blank, numbered from 1 in each file."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return number_lines(files, "file", "value")


def number_lines(files: DataFrame, key: str, text_col: str) -> DataFrame:
    kept = F.filter(F.split(strip(F.col(text_col)), r"\r?\n"), lambda x: strip(x) != "")
    return files.select(key, F.posexplode(kept).alias("_p", "line")).select(key, (F.col("_p") + 1).alias("line_no"), "line")


#: Ids that are numbered in one task.
RANGE = 10_000


def export_lines(rows: DataFrame, key: str, id_col: str, line: Column, header: str) -> DataFrame:
    """(key, line_no, line) of a list for each key: the header, then the lines that are not null in the order of ids.

    Places are counted in two steps, by ranges of ids, so no list is built or numbered in one task.
    """
    left = rows.select(key, F.col(id_col).alias("_id"), line.alias("line")).where(F.col("line").isNotNull())
    left = left.withColumn("_range", F.floor(F.col("_id") / RANGE))
    before = left.groupBy(key, "_range").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(key).orderBy("_range")
    before = before.select(key, "_range", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(key, "_range").orderBy("_id", "line"))
    placed = left.withColumn("_i", inside).join(before, [key, "_range"])
    heads = before.select(key).distinct().select(key, F.lit(1).alias("line_no"), F.lit(header).alias("line"))
    return placed.select(key, (F.col("_before") + F.col("_i") + 1).cast("int").alias("line_no"), "line").unionByName(heads)


#: Complaints about rows and files.
COMPLAINTS = {
    "row": "Row ",
    "empty": "no email, skipped.",
    "unlike": " is not an email address, skipped.",
    "again": " appears more than once, kept the first.",
    "file": "No email column. The header needs one called email.",
}


def parse_contacts(lines: DataFrame, key: str = "file") -> tuple[DataFrame, DataFrame]:
    """Contacts (key, line_no, email, names, ...) and errors (key, line_no, message).

    Within a file the first of several rows with one address stays. A file without an
    email column has one error and no contacts.
    """
    rows = lines.withColumn("_c", cells(F.col("line")))
    letters = F.transform("_c", lambda c: F.regexp_replace(F.lower(strip(c)), "[^a-z]", ""))
    at = lambda names: F.coalesce(*[F.nullif(F.array_position("_h", n), F.lit(0).cast("long")) for n in names])
    heads = rows.where("line_no = 1").withColumn("_h", letters).select(key, *[at(names).alias(f"_{c}") for c, names in HEADERS.items()])
    body = rows.where("line_no > 1").join(heads, key)
    value = lambda c: F.nullif(strip(F.try_element_at("_c", F.col(f"_{c}").cast("int"))), F.lit(""))
    body = body.where(F.col("_email").isNotNull()).select(
        key, "line_no", F.lower(value("email")).alias("email"), *[value(c).alias(c) for c in HEADERS if c != "email"]
    )
    good = F.coalesce(is_email(F.col("email")), F.lit(False))
    place = F.row_number().over(Window.partitionBy(key, "email").orderBy("line_no"))
    body = body.withColumn("_n", F.when(good, place))
    row = F.concat(F.lit(COMPLAINTS["row"]), F.col("line_no").cast("string"), F.lit(": "))
    message = (
        F.when(F.col("email").isNull(), F.concat(row, F.lit(COMPLAINTS["empty"])))
        .when(F.col("_n").isNull(), F.concat(row, F.col("email"), F.lit(COMPLAINTS["unlike"])))
        .when(F.col("_n") > 1, F.concat(row, F.col("email"), F.lit(COMPLAINTS["again"])))
    )
    errors = body.select(key, "line_no", message.alias("message")).where("message is not null")
    missing = heads.where(F.col("_email").isNull()).select(key, F.lit(1).alias("line_no"), F.lit(COMPLAINTS["file"]).alias("message"))
    contacts = body.where("_n = 1").drop("_n").withColumn("source", F.lit("csv"))
    return contacts, errors.unionByName(missing)
