"""Entity, time and bucket keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import CLUSTER_WINDOW, MICROS


def blank_to_null(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c != "", c)


def entity_feature() -> Column:
    """source.ip, then user.name, then 'unknown'; empty strings count as missing."""
    return F.coalesce(blank_to_null("source.ip"), blank_to_null("user.name"), F.lit("unknown"))


def entity_cluster() -> Column:
    """source.ip, then host.name, then user.name, then 'unknown'."""
    return F.coalesce(blank_to_null("source.ip"), blank_to_null("host.name"),
                      blank_to_null("user.name"), F.lit("unknown"))


def event_micros() -> Column:
    """Epoch microseconds: the numeric time if present, else the timestamp, else 0."""
    return F.coalesce(F.round(F.col("timestamp_unix") * MICROS).cast("bigint"),
                      F.unix_micros("timestamp"), F.lit(0).cast("bigint"))


def tie_breaker(id_col="id") -> Column:
    """Arrival order among equal timestamps as one bigint: numeric ids by value, else by hash."""
    c = F.col(id_col)
    return F.coalesce(F.expr(f"try_cast({id_col} as bigint)"), F.xxhash64(c))


def epoch_bucket(us, seconds: int = CLUSTER_WINDOW) -> Column:
    """floor(us / seconds), exact for times before 1970 too."""
    us = F.col(us) if isinstance(us, str) else us
    width = F.lit(seconds * MICROS).cast("bigint")
    return F.call_function("div", us - F.pmod(us, width), width)


def clock_bucket(text) -> Column:
    """'THH:MM' of the first HH:MM:SS in a text, floored to 5 minutes; 'T00:00' if none."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    pattern = r"(\d{2}):(\d{2}):(\d{2})"
    hh = F.regexp_extract(text, pattern, 1)
    mm = F.regexp_extract(text, pattern, 2)
    floored = F.floor(blank_to_null(mm).cast("int") / 5) * 5
    return F.when(hh != "", F.concat(F.lit("T"), hh, F.lit(":"),
                                     F.lpad(floored.cast("string"), 2, "0"))
                  ).otherwise(F.lit("T00:00"))
