"""Cloud audit records (one JSON object per line) to events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .events import evaluated_once, event_columns, filled_time, with_custody_hash
from .normalize_text import iso_clock_time, with_line_id

# Event name -> action and categories, fixed values.
EVENT_NAMES = {
    "ConsoleLogin": ("console_login", ["authentication"]),
    "CreateUser": ("user_created", ["iam"]),
    "DeleteUser": ("user_deleted", ["iam"]),
    "AttachUserPolicy": ("policy_attached", ["iam", "configuration"]),
    "CreateAccessKey": ("access_key_created", ["iam"]),
    "AuthorizeSecurityGroupIngress": ("security_group_modified", ["network", "configuration"]),
    "RunInstances": ("instance_launched", ["host"]),
    "StopInstances": ("instance_stopped", ["host"]),
    "GetObject": ("s3_object_read", ["file"]),
    "PutObject": ("s3_object_write", ["file"]),
    "AssumeRole": ("role_assumed", ["authentication", "iam"]),
}


def lookup(table: dict, key: Column, index: int) -> Column:
    """A constant table as a map literal: no join, stays inside generated code."""
    pairs = []
    for name, row in table.items():
        value = row[index]
        value = F.array(*[F.lit(v) for v in value]) if isinstance(value, list) else F.lit(value)
        pairs += [F.lit(name), value]
    return F.try_element_at(F.create_map(*pairs), key)


# Field -> path in the record, fixed values.
PATHS = {
    "time": "$.eventTime", "service": "$.eventSource", "name": "$.eventName", "ip": "$.sourceIPAddress",
    "user": "$.userIdentity.userName", "principal": "$.userIdentity.principalId", "arn": "$.userIdentity.arn",
    "account": "$.userIdentity.accountId", "login": "$.responseElements.ConsoleLogin", "error": "$.errorCode",
}


def parsed_records(lines: DataFrame) -> DataFrame:
    """Add ``rec`` with the fields as text; ``bad`` marks lines that are not a JSON object.

    The record is parsed once, without a schema: a field of an unexpected type is just null and
    does not make the record malformed.
    """
    df = with_line_id(lines).withColumn("raw", strip(F.col("raw")))
    df = evaluated_once(df, _json=F.when(F.col("raw").startswith("{"), F.try_parse_json("raw")))
    rec = F.struct(*[F.try_variant_get("_json", path, "string").alias(name) for name, path in PATHS.items()])
    return evaluated_once(df, rec=rec, bad=F.col("_json").isNull()).drop("_json")


def normalize_cloudtrail(lines: DataFrame, ingest_time=None, emit_parse_errors: bool = False) -> DataFrame:
    """Malformed lines are left out, or become ``cloudtrail_parse_error`` events on request."""
    df = parsed_records(lines)
    if not emit_parse_errors:
        df = df.filter(~F.col("bad"))
    bad = F.col("bad")
    name = F.coalesce(F.col("rec.name"), F.lit("unknown_action"))
    outcome = (F.when(bad, "unknown")
               .when(F.coalesce(F.col("rec.error"), F.lit("")) != "", "failure")
               .when(F.col("rec.login") == "Failure", "failure").otherwise("success"))
    service = F.col("rec.service")
    time, fallback = filled_time(iso_clock_time(F.col("rec.time")), ingest_time)

    def unless_bad(c: Column) -> Column:
        return F.when(~bad, c)

    values = {
        "id": F.col("line_id"), "event.id": F.col("line_id"),
        "timestamp": time, "ts_fallback": fallback,
        "event.kind": F.lit("event"),
        "event.action": F.when(bad, "cloudtrail_parse_error").otherwise(
            F.coalesce(lookup(EVENT_NAMES, name, 0), F.lower(name))),
        "event.category": F.when(bad, F.array(F.lit("process"))).otherwise(
            F.coalesce(lookup(EVENT_NAMES, name, 1), F.array(F.lit("process")))),
        "event.outcome": outcome,
        "source.ip": F.col("rec.ip"),
        "destination.host": unless_bad(
            F.replace(F.coalesce(service, F.lit("")), F.lit(".amazonaws.com"), F.lit(""))),
        "user.name": unless_bad(F.coalesce("rec.user", "rec.principal", F.lit("unknown"))),
        "user.id": unless_bad(F.coalesce(F.col("rec.arn"), F.lit(""))),
        "user.domain": unless_bad(F.coalesce(F.col("rec.account"), F.lit(""))),
        "host.name": unless_bad(F.coalesce(service, F.lit("aws"))),
        "log.source_type": F.lit("cloudtrail"), "log.raw": F.col("raw"),
    }
    events = df.select(*event_columns(values))
    return with_custody_hash(events, skip=F.col("event.action") == "cloudtrail_parse_error")
