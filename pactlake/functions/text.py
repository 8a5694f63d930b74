"""Scalar functions as Column expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import ISO_DATE_TIME


def uuid5(namespace: uuid.UUID | str, name: Column) -> Column:
    """RFC 4122 version 5 ids, as Python's uuid.uuid5 makes them."""
    ns = F.unhex(F.lit(uuid.UUID(str(namespace)).hex))
    h = F.substring(F.sha1(F.concat(ns, F.encode(name, "UTF-8"))), 1, 32)
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)
    )


def anchored(pattern: str) -> str:
    """Anchored at the start only, as pattern clauses are."""
    return f"^(?:{pattern})"


def parse_time(col: Column) -> Column:
    """ISO-8601 text as a timestamp, null where it isn't one; without a zone it is UTC, whatever the session's zone.

    Columns of timestamps are the times that they are; those without a zone are UTC, too.
    """
    s = col.cast("string")
    # Spark wants seconds before an offset
    full = F.regexp_replace(s, r"^(.{10}[T ]\d{2}:\d{2})(Z|[+-]\d{2}:?\d{2})?$", "$1:00$2")
    utc = F.when(F.char_length(s) == 10, F.concat(s, F.lit("T00:00:00+00:00"))).when(
        s.rlike(r":\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})$"), full
    ).otherwise(F.concat(full, F.lit("+00:00")))
    # a timestamp's text is the session's wall time
    return F.when(s.rlike(ISO_DATE_TIME), F.try_to_timestamp(F.when(F.typeof(col) == "timestamp", s).otherwise(utc)))


def as_int(col: Column) -> Column:
    """int(): truncates numbers, reads digits, null for anything else."""
    return col.try_cast("bigint")


def shape_signature(col: Column, kind: str) -> Column:
    """A value's shape without the value: kind, length, and a short digest of strings."""
    if kind == "string":
        return F.when(col.isNull(), "null").otherwise(
            F.concat(
                F.lit("string(len="), F.char_length(col).cast("string"), F.lit(",sha8="),
                F.substring(F.sha2(col, 256), 1, 8), F.lit(")")
            )
        )
    name = {"boolean": "boolean", "float": "float", "double": "float"}.get(
        kind, "integer" if kind in ("tinyint", "smallint", "int", "bigint") else kind
    )
    return F.when(col.isNull(), "null").otherwise(F.lit(name))


def string_pattern(col: Column) -> Column:
    """The class of a string: the first that fits."""
    return (
        F.when(col.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), "uuid_like")
        .when(col.rlike("(?i)^[0-9a-f]{64}$"), "hex64_like").when(col.rlike(r"^\d+$"), "numeric_string").when(
            col.rlike(r"^\d{4}-\d{2}-\d{2}T"), "iso8601_prefix"
        ).otherwise("free_text")
    )


def field_token(col: Column) -> Column:
    """A failing field as registries name it: no [*] or [], single dots, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(col), r"\[\*?\]", ""), r"\.+", "."), F.lit("."))


def slug(col: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(col), "[^a-z0-9]+", "_"), F.lit("_"))


def recency_score(detected: Column, committed: Column, hops: Column) -> Column:
    """1 less a tenth for each whole day since the commit (0.35 if unknown), less a fifth for each hop; in [0, 1]."""
    days = F.greatest(F.lit(0), F.floor((detected.cast("timestamp").cast("double") - committed.cast("timestamp").cast("double")) / 86400))
    base = F.when(committed.isNull(), 0.35).otherwise(F.greatest(F.lit(0.0), 1.0 - days * 0.1))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base - hops * 0.2))


def strip_dirty(col: Column) -> Column:
    return F.regexp_replace(col, "-dirty$", "")


def relative_to(col: Column, root: str) -> Column:
    """``kind::/root/path`` -> ``kind::path``; other ids stay."""
    root = root.rstrip("/") + "/"
    kind = F.split_part(col, F.lit("::"), F.lit(1))
    path = F.substring(col, F.char_length(kind) + 3, F.char_length(col))
    return F.when(
        F.contains(col, F.lit("::")) & F.startswith(path, F.lit(root)),
        F.concat(kind, F.lit("::"), F.substring(path, F.lit(len(root) + 1), F.char_length(path)))
    ).otherwise(col)


def utc_z(col: Column) -> Column:
    """A time's text in UTC, to the second, whatever the session's zone: seconds since 1970 have none."""
    since = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.unix_seconds(parse_time(col)))
    wall = (F.lit("1970-01-01").cast("timestamp_ntz") + since).cast("string")
    return F.concat(F.translate(F.substring(wall, 1, 19), " ", "T"), F.lit("Z"))


def short_number(col: Column, digits: int) -> Column:
    """A number with so many significant digits at most, without trailing zeros."""
    said = F.format_string(f"%.{digits}g", col.cast("double"))
    return F.when(F.contains(said, F.lit(".")) & ~F.contains(said, F.lit("e")), F.regexp_replace(said, r"\.?0+$", "")).otherwise(said)
