"""Validity of indicators of compromise, and indicator columns per incident."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.network import is_cidr, is_ip
from ..functions.text import (GENERIC_VALUE, INTEGER, USERNAME, is_hostname, is_hostname_loose,
                              is_safe_variable, strip)
from .events import evaluated_once
from .normalize_cloud import lookup

# Indicator name -> type, fixed values: by field name, and by playbook variable.
FIELD_TYPES = {
    **dict.fromkeys(["src_ip", "dst_ip", "source_ip", "destination_ip", "attacker_ip", "victim_ip"], "ip"),
    **dict.fromkeys(["src_cidr", "dst_cidr", "source_cidr", "destination_cidr"], "cidr"),
    **dict.fromkeys(["domain", "fqdn", "url"], "domain"),
    **dict.fromkeys(["port", "src_port", "dst_port"], "port"),
}
VARIABLE_TYPES = {
    **dict.fromkeys(["attacker_ip", "victim_ip", "source_ip", "destination_ip", "pivot_host_ip"], "ip"),
    **dict.fromkeys(["attacker_cidrs", "target_subnet"], "cidr"),
    **dict.fromkeys(["port", "exfil_port"], "port"),
    **dict.fromkeys(["victim_host", "pivot_host", "compromised_host"], "hostname"),
    **dict.fromkeys(["victim_user", "compromised_user", "user_id"], "username"),
}


def port_number(c: Column) -> Column:
    """Port 1..65535, else null."""
    digits = F.when(c.rlike(INTEGER), F.replace(F.replace(c, F.lit("_"), F.lit("")), F.lit("+"), F.lit("")))
    number = digits.try_cast("bigint")
    return F.when(number.between(1, 65535), number)


def clean_value(kind: Column, value: Column) -> Column:
    """The trimmed value if it is valid for its type, else null."""
    v = strip(value)
    control = v.rlike(r"[\n\r\x00\t]")
    checked = (F.when(kind == "ip", F.when(is_ip(v), v))
               .when(kind == "cidr", F.when(is_cidr(v), v))
               .when(kind == "port", port_number(v).cast("string"))
               .when(kind == "hostname", F.when(is_hostname(v), v))
               .when(kind == "username", F.when(v.rlike(USERNAME), v)))
    return F.when(~control, checked)


def validate_iocs(iocs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(type, value) rows split into valid ones with ``clean``, and the rest."""
    judged = evaluated_once(iocs, clean=clean_value(F.col("type"), F.col("value")))
    return judged.filter("clean is not null"), judged.filter("clean is null").drop("clean")


def url_host(value: Column) -> Column:
    full = F.when(value.contains("://"), value).otherwise(F.concat(F.lit("https://"), value))
    return F.lower(F.try_parse_url(full, F.lit("HOST")))


def is_valid_field(name: Column, value: Column) -> Column:
    """Validity by field name; unknown names need a safe variable. Values are not trimmed."""
    kind = lookup({k: (v,) for k, v in FIELD_TYPES.items()}, name, 0)
    ok = (F.when(kind == "ip", is_ip(value)).when(kind == "cidr", is_cidr(value))
          .when(kind == "domain", is_hostname_loose(url_host(value)))
          .when(kind == "port", port_number(strip(value)).isNotNull())
          .otherwise(is_safe_variable(value)))
    return F.coalesce((value != "") & ok, F.lit(False))


def clean_variable(key: Column, value: Column) -> Column:
    """Playbook variable by its hint; without a hint a generic pattern. Null if invalid."""
    kind = lookup({k: (v,) for k, v in VARIABLE_TYPES.items()}, key, 0)
    return F.when(kind.isNotNull(), clean_value(kind, value)).otherwise(
        F.when(value.rlike(GENERIC_VALUE), value))


def _last(column: str, when: Column, order: str) -> Column:
    """The last non-empty value by ``order``; combines before the shuffle."""
    usable = when & (F.col(column) != "")
    return F.max_by(F.when(usable, F.col(column)), F.when(usable, F.col(order)))


def incident_indicators(entities: DataFrame, order: str = "position") -> DataFrame:
    """Per incident: attacker address and victim host, address and user, with defaults."""
    role = F.coalesce("role", F.lit(""))
    attacker, victim = role == "attacker", role == "victim"
    return entities.groupBy("incident_id").agg(
        F.coalesce(_last("ip", attacker, order), F.lit("0.0.0.0")).alias("attacker_ip"),
        F.coalesce(_last("host", victim, order), F.lit("unknown-host")).alias("victim_host"),
        F.coalesce(_last("ip", victim, order), F.lit("127.0.0.1")).alias("victim_ip"),
        F.coalesce(_last("user", victim, order), F.lit("unknown-user")).alias("victim_user"))


def incident_indicators_any_role(entities: DataFrame, order: str = "position") -> DataFrame:
    """As above, but every role except the attacker's gives the victim address, and any role
    gives host and user."""
    role = F.coalesce("role", F.lit(""))
    attacker, anyone = role == "attacker", F.lit(True)
    return entities.groupBy("incident_id").agg(
        F.coalesce(_last("ip", attacker, order), F.lit("0.0.0.0")).alias("attacker_ip"),
        F.coalesce(_last("host", anyone, order), F.lit("unknown-host")).alias("victim_host"),
        F.coalesce(_last("ip", ~attacker, order), F.lit("127.0.0.1")).alias("victim_ip"),
        F.coalesce(_last("user", anyone, order), F.lit("nobody")).alias("victim_user"))
