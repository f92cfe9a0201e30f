"""Building, hashing and checking rows of the event schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import EVENT

RAW_LIMIT = 1000
SOURCE_TYPES = ["syslog", "cloudtrail", "auth_log", "cicids"]


def _struct(fields: T.StructType, values: dict, prefix: str) -> Column:
    parts = []
    for f in fields:
        path = f"{prefix}.{f.name}"
        if isinstance(f.dataType, T.StructType):
            parts.append(_struct(f.dataType, values, path).alias(f.name))
        else:
            value = values.pop(path, F.lit(None))
            parts.append(value.cast(f.dataType).alias(f.name))
    return F.struct(*parts)


def event_columns(values: dict[str, Column]) -> list[Column]:
    """All columns of the event schema from dotted paths; what is not given is null. ``log.raw`` is still
    the whole record, for ``with_custody_hash`` to hash and cut."""
    values = dict(values)
    out = []
    for f in EVENT:
        if isinstance(f.dataType, T.StructType):
            out.append(_struct(f.dataType, values, f.name).alias(f.name))
        else:
            out.append(values.pop(f.name, F.lit(None)).cast(f.dataType).alias(f.name))
    if values:
        raise ValueError(f"not in the event schema: {sorted(values)}")
    return out


def evaluated_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters and projections cannot expand again.

    Catalyst substitutes column definitions into filters it pushes down. For columns built from
    regular expressions that multiplies their work, so they pass through a one-row generator,
    which predicates on its output do not cross.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def with_custody_hash(events: DataFrame, skip: Column | None = None) -> DataFrame:
    """Fill ``related.hash`` with the SHA-256 of the event without its id and hash, the whole raw record
    included, and cut ``log.raw`` to its limit."""
    event = F.col("event").dropFields("id").alias("event")
    content = [event if f.name == "event" else F.col(f.name) for f in EVENT if f.name not in ("id", "related")]
    body = F.to_json(F.struct(*content))
    digest = F.concat(F.lit("sha256:"), F.sha2(body, 256))
    if skip is not None:
        digest = F.when(~skip, digest)
    return events.withColumns({"related": F.struct(digest.alias("hash")),
                               "log": F.col("log").withField("raw", F.substring("log.raw", 1, RAW_LIMIT))})


def filled_time(parsed: Column, ingest_time) -> tuple[Column, Column]:
    """A timestamp with its fallback, and the flag that says the fallback was taken."""
    fallback = F.lit(ingest_time).cast("timestamp")
    return F.coalesce(parsed, fallback), parsed.isNull()


def contract_violations(events: DataFrame) -> DataFrame:
    """Events that break the contract, each with the names of the rules it fails."""
    checks = {
        "timestamp": F.col("timestamp").isNotNull(),
        "action": F.coalesce(F.col("event.action"), F.lit("")) != "",
        "source_type": F.coalesce(F.col("log.source_type").isin(SOURCE_TYPES), F.lit(False)),
        "raw": F.coalesce(F.col("log.raw"), F.lit("")) != "",
        "raw_length": F.coalesce(F.length("log.raw"), F.lit(0)) <= RAW_LIMIT,
        "hash": F.coalesce(F.col("related.hash").startswith("sha256:"), F.lit(False)),
    }
    failed = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]))
    return evaluated_once(events, failed_rules=failed).filter(F.size("failed_rules") > 0)
