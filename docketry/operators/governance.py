"""Rules over data: restricted tables in plans, redacted records, encrypted columns, audit rows."""

from __future__ import annotations

import base64
import hashlib
import hmac
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.functions.access import PHI_TABLES, is_phi
from docketry.functions.texts import once, redact, redact_first_lines
from docketry.runtime import fresh, partitions

#: Names of fields that hold clinical or personal content, in small letters and digits.
SENSITIVE = (
    "text", "body", "bodyjson", "content", "rawtext", "notes", "note", "quote", "verbatimquote",
    "denialbasistext", "clinicalrecord", "narrative", "diagnosis", "diagnoses", "medication",
    "medications", "patient", "patientname", "membername", "beneficiary", "beneficiaryname",
    "firstname", "lastname", "name", "dob", "dateofbirth", "address", "phone", "email", "ssn", "mrn",
    "memberid", "claimnumber", "filename", "prompt", "completion", "message", "messages", "input",
    "output", "buffer", "file", "password", "passwordhash", "secret", "token", "totpsecret", "apikey",
    "authorization", "cookie",
)
DEEPEST, MOST_ITEMS, STACK_LINES = 6, 32, 12


class RestrictedTableError(Exception):
    pass


def analytics_safe(df: DataFrame, tables: dict[str, DataFrame], restricted: tuple[str, ...] = PHI_TABLES) -> DataFrame:
    """df itself, or an error if it reads files of a restricted table, whatever was declared."""
    read = set(df.inputFiles())
    found = sorted(name for name, t in tables.items() if name in restricted and read & set(t.inputFiles()))
    if found:
        raise RestrictedTableError(f"reads restricted tables: {', '.join(found)}")
    return df


def is_sensitive(name: str) -> bool:
    return re.sub("[^a-z0-9]", "", name.lower()) in SENSITIVE


def sensitive_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "").isin(*SENSITIVE)


def redact_record(df: DataFrame) -> DataFrame:
    """df with every value redacted by the schema: sensitive fields whole, strings by pattern and
    length, arrays cut, binary values by size, what lies too deep dropped."""
    return df.select(*[_redacted(F.col(f"`{f.name}`"), f.dataType, 0, is_sensitive(f.name)).alias(f.name) for f in df.schema])


def _redacted(c: Column, kind: T.DataType, depth: int, sensitive: bool) -> Column:
    if sensitive:
        return F.lit("[redacted]")
    if isinstance(kind, T.StringType):
        return redact(c)
    if isinstance(kind, T.BinaryType):
        return F.concat(F.lit("[binary:"), F.octet_length(c).cast("string"), F.lit(" bytes]"))
    if not isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return c
    if depth >= DEEPEST:
        return F.lit("[truncated:depth]")
    if isinstance(kind, T.StructType):
        parts = [_redacted(c.getField(f.name), f.dataType, depth + 1, is_sensitive(f.name)).alias(f.name) for f in kind]
        return F.when(c.isNotNull(), F.struct(*parts))
    if isinstance(kind, T.MapType):
        plain = F.transform_values(c, lambda k, v: _redacted(v, kind.valueType, depth + 1, False))
        if isinstance(kind.keyType, T.StringType) and isinstance(kind.valueType, T.StringType):
            return F.transform_values(plain, lambda k, v: F.when(sensitive_key(k), F.lit("[redacted]")).otherwise(v))
        if isinstance(kind.keyType, T.StringType):  # a value that is no text has no room for a mark
            return F.transform_values(plain, lambda k, v: F.when(~sensitive_key(k), v))
        return plain
    kept = F.transform(F.slice(c, 1, MOST_ITEMS), lambda x: _redacted(x, kind.elementType, depth + 1, False))
    if isinstance(kind.elementType, T.StringType):
        more = F.array(F.concat(F.lit("[+"), (F.size(c) - MOST_ITEMS).cast("string"), F.lit(" more]")))
        return F.when(F.size(c) > MOST_ITEMS, F.concat(kept, more)).otherwise(kept)
    return kept


def _quoted(c: Column) -> Column:
    """A text as JSON, null for null."""
    return F.get(F.transform(F.array(F.to_json(F.array(c))), lambda x: F.when(x != "[null]", F.substring(x, F.lit(2), F.length(x) - 2))), 0)


def _members(v: Column, depth: int, one: Callable[[Column, Column], Column], leaf: Column) -> Column:
    """JSON of a variant: of an object or array what ``one`` makes of (key, value) of each member, else ``leaf``.

    Keys of array items are null; members of which nothing is made are left out. An array keeps its first items and says how many more there were.
    """
    fields, items = F.try_variant_get(v, "$", "map<string, variant>"), F.try_variant_get(v, "$", "array<variant>")
    if depth >= DEEPEST:
        return F.when(fields.isNotNull() | items.isNotNull(), F.lit('"[truncated:depth]"')).otherwise(leaf)
    both = F.struct(fields.alias("fields"), items.alias("items"))
    return F.coalesce(once(both, lambda b: _inside(b["fields"], b["items"], one)), leaf)


def _inside(fields: Column, items: Column, one: Callable[[Column, Column], Column]) -> Column:
    """JSON of the fields of an object or the items of an array, see ``_members``; null if both are null."""
    kept = F.transform(F.slice(items, 1, MOST_ITEMS), lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value")))
    named = F.transform(F.map_entries(fields), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    parts = F.transform(F.coalesce(named, kept), lambda e: F.concat(F.coalesce(F.concat(_quoted(e["key"]), F.lit(":")), F.lit("")), one(e["key"], e["value"])))
    more = F.when(F.size(items) > MOST_ITEMS, F.concat(F.lit('"[+'), (F.size(items) - MOST_ITEMS).cast("string"), F.lit(' more]"')))
    inside = F.array_join(F.array_compact(F.concat(parts, F.array(more))), ",")
    # one mention of what is inside: with two, the expression would double at every level
    ends = lambda a, b: F.when(fields.isNotNull(), F.lit(a)).otherwise(F.lit(b))
    return F.concat(ends("{", "["), inside, ends("}", "]"))


def _string(v: Column) -> Column:
    """The text that a variant is; null if it is none."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _walked(v: Column, depth: int) -> Column:
    """Redacted JSON of a variant that lies so deep; null if there is none."""
    leaf = F.coalesce(_quoted(redact(_string(v))), F.to_json(v))
    return _members(v, depth, lambda k, x: F.when(sensitive_key(k), F.lit('"[redacted]"')).otherwise(_walked(x, depth + 1)), leaf)


def redact_json(c: Column) -> Column:
    """Free JSON redacted to the depth of DEEPEST, what lies deeper truncated; null if it is no JSON.

    A walk over a variant by Spark's own functions, unrolled level by level. Keys of an object
    come in the order of their characters. An object that names a key twice is no JSON.
    """
    return _walked(F.try_parse_json(c), 0)


def redact_error(c: Column) -> Column:
    """JSON of an error, {name, message, stack, cause and whatever else}, redacted; null if it is no JSON.

    Its name stays, its message is redacted as a text, of its stack the first STACK_LINES
    lines, each as a text. A cause that has a message is an error as well, up to DEEPEST of
    them, and comes last; all else is redacted as any JSON is.
    """
    return once(F.try_parse_json(c), lambda v: once(_causes(v), lambda n: _error(v, n)))


def _causes(v: Column) -> Column:
    """How many causes below the outermost error are errors, each the cause of the one before, up to one more than DEEPEST."""
    said = [F.schema_of_variant(F.try_variant_get(v, "$" + ".cause" * n + ".message", "variant")) == "STRING" for n in range(1, DEEPEST + 2)]
    found = F.array_position(F.array(*[F.coalesce(e, F.lit(False)) for e in said], F.lit(False)), False).cast("int") - 1
    return F.when(said[0], found).otherwise(0)  # most errors have no cause


def _error(v: Column, causes: Column) -> Column:
    """Redacted JSON of an error with so many causes."""
    # errors from the outermost on: so many of the causes that each holds the next
    chain = F.slice(F.array(*[F.try_variant_get(v, "$" + ".cause" * n, "variant") for n in range(DEEPEST + 1)]), 1, causes + 1)

    def own(key: Column, value: Column) -> Column:
        text = _string(value)
        lines = redact_first_lines(text, STACK_LINES)
        said = F.when(key == "name", _quoted(text)).when(key == "message", _quoted(redact(text))).when(key == "stack", _quoted(lines))
        return F.coalesce(said, F.when(sensitive_key(key), F.lit('"[redacted]"')).otherwise(_walked(value, 1)))

    caused = lambda x: F.coalesce(F.schema_of_variant(F.try_variant_get(x, "$.cause.message", "variant")) == "STRING", F.lit(False))
    levels = F.transform(chain, lambda x: _members(x, 0, lambda k, y: F.when(~((k == "cause") & caused(x)), own(k, y)), _walked(x, DEEPEST)))
    inner = F.when(causes > DEEPEST, F.lit('"[truncated:depth]"'))
    opened = lambda t: F.concat(F.substring(t, F.lit(1), F.length(t) - 1), F.when(t == "{}", F.lit("")).otherwise(F.lit(",")))
    return F.aggregate(F.reverse(levels), inner, lambda found, t: F.when(found.isNull(), t).otherwise(F.concat(opened(t), F.lit('"cause":'), found, F.lit("}"))))


def encryption_key(secret: str, info: str = "column-encryption") -> bytes:
    """32 bytes: a base64 key of that length as it is, anything else by HKDF-SHA256."""
    try:
        raw = base64.b64decode(secret, validate=True)
        if len(raw) == 32:
            return raw
    except ValueError:
        pass
    mid = hmac.new(bytes(32), secret.encode(), hashlib.sha256).digest()
    return hmac.new(mid, info.encode() + b"\x01", hashlib.sha256).digest()


def encrypt(c: Column, key: bytes) -> Column:
    """AES-256-GCM with a fresh nonce for each value, as v1.<base64>; null stays null."""
    return F.concat(F.lit("v1."), F.base64(F.aes_encrypt(c, F.lit(key), F.lit("GCM"))))


def decrypt(c: Column, key: bytes) -> Column:
    """The value that encrypt was given; raises if a single character was changed."""
    sealed = F.when(c.startswith("v1."), F.substring(c, 4, 1 << 30)).otherwise(F.raise_error(F.lit("not an encrypted value")).cast("string"))
    return F.aes_decrypt(F.unbase64(F.when(c.isNotNull(), sealed)), F.lit(key), F.lit("GCM")).cast("string")


def audit_rows(events: DataFrame) -> DataFrame:
    """events with ``phi``, told by the table they are about."""
    return events.withColumn("phi", F.coalesce(is_phi(F.col("entity_type")), F.lit(False)))


def visible_to(rows: DataFrame, principals: DataFrame, key: str = "organization_id") -> DataFrame:
    """(user_id, rows): what each principal may see: superadmins all, others the organizations in scope.

    principals: user_id, superadmin, scope (organization ids). Superadmins meet the keys in
    as many lots as there are shuffle partitions, so no task holds all keys. Every row comes
    once for each who sees it; for figures of what they see take ``totals_visible_to``.
    """
    keys = rows.select(key).distinct()
    lot, lots = fresh(keys.columns + ["user_id"], "lot"), partitions(rows.sparkSession)
    everywhere = _superadmins(principals).withColumn(lot, F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
    met = everywhere.join(keys.withColumn(lot, F.pmod(F.xxhash64(key), F.lit(lots)).cast("int")), lot).drop(lot)
    return rows.join(_scoped(principals, key).unionByName(met.select("user_id", key)), key)


def totals_visible_to(rows: DataFrame, principals: DataFrame, sums: Sequence[str], key: str = "organization_id") -> DataFrame:
    """(user_id, sums): sums over all rows that each principal may see, see ``visible_to``.

    Rows are summed by key first; superadmins get the one row of all sums, whatever the
    number of keys. Principals who see no row have none; rows without a key are nobody's.
    """
    by_key = rows.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.sum(c).alias(c) for c in sums], F.count("*").alias("_n"))
    whole = by_key.agg(*[F.sum(c).alias(c) for c in sums], F.sum("_n").alias("_n")).where("_n > 0").withColumn("_all", F.lit(True))
    everywhere = _superadmins(principals).withColumn("_all", F.lit(True)).join(whole, "_all").select("user_id", *sums)
    own = _scoped(principals, key).join(by_key, key).groupBy("user_id").agg(*[F.sum(c).alias(c) for c in sums])
    return own.unionByName(everywhere)


def _scoped(principals: DataFrame, key: str) -> DataFrame:
    return principals.where(~F.coalesce("superadmin", F.lit(False))).select("user_id", F.explode(F.array_distinct("scope")).alias(key))


def _superadmins(principals: DataFrame) -> DataFrame:
    return principals.where("superadmin").select("user_id")
