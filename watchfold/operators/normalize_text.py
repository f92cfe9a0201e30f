"""System and authentication log lines to events, on native column functions only.

Input: a ``raw`` text column and, optionally, ``line_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .events import evaluated_once, event_columns, filled_time, with_custody_hash

# Line formats, fixed values; (?U): letters, digits and spaces of any script. The header patterns
# end where the message starts, so they never run over the message.
BSD_HEADER = r"(?U)^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+?)(?:\[\d+\])?\s*:\s*"
RFC5424_HEADER = r"(?U)^<\d{1,3}>(?:\d)?\s*(\S+)\s+(\S+)\s+(\S+)\s+\S+\s+\S+\s*"
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
SSH_FAILED = r"(?U)Failed password for (?:invalid user )?(\S+) from ([\d.]+) port (\d+)"
SSH_ACCEPTED = r"(?U)Accepted (?:password|publickey) for (\S+) from ([\d.]+) port (\d+)"
SSH_INVALID_USER = r"(?U)Invalid user (\S+) from ([\d.]+)"
SUDO = r"(?U)(\S+)\s*:\s*TTY=\S+\s*;\s*PWD=\S+\s*;\s*USER=\S+\s*;\s*COMMAND="
SU_SESSION = r"(?U)pam_unix\(su(?:-l)?:session\):\s*session (opened|closed) for user (\S+)"
PAM_FAILURE = r"(?U)pam_unix\(\S+:auth\):\s*authentication failure.*?user=(\S+)"


def has(text: Column, word: str, pattern: str) -> Column:
    """Pattern search that runs only where a word the pattern needs occurs."""
    return text.contains(word) & text.rlike(pattern)


def groups(text: Column, pattern: str, *indexes: int) -> Column:
    """Array of groups of a pattern that is known to match."""
    return F.array(*[F.regexp_extract(text, pattern, i) if i else F.lit(None).cast("string") for i in indexes])


def with_line_id(lines: DataFrame) -> DataFrame:
    """Add ``line_id``, a hash of the record (file path included, where known) and of its number among equal
    records, so that reading the same files again gives the same ids.

    Equal records are counted, which combines before the shuffle, and written out again by number; a record
    that makes up a third of all rows does not meet in one task. A stream cannot count, its ids are drawn.
    """
    if "line_id" in lines.columns:
        return lines
    if lines.isStreaming:
        return lines.withColumn("line_id", F.expr("uuid()"))
    # By position, as files may repeat a column name.
    names = [f"_{i}" for i in range(len(lines.columns))]
    counted = lines.toDF(*names).groupBy(*names).agg(F.count(F.lit(1)).alias("_count"))
    numbered = counted.select(*names, F.explode(F.sequence(F.lit(1).cast("bigint"), "_count")).alias("_number"))
    made = evaluated_once(numbered, line_id=F.md5(F.to_json(F.struct(*names, "_number"))))
    return made.drop("_number").toDF(*lines.columns, "line_id")


def bsd_time(parts: Column, year: Column) -> Column:
    """Time of [month, day, hour, minute, second] texts; the format carries no year."""
    at = F.instr(F.lit(MONTHS), F.lower(parts[0]))
    month = F.when(F.pmod(at, F.lit(3)) == 1, F.floor(at / 3).cast("int") + 1)
    day, hour, minute, second = (parts[i].try_cast("int") for i in range(1, 5))
    made = F.try_make_timestamp(year, month, day, hour, minute, second.cast("decimal(8,6)"))
    return F.when(parts.isNotNull() & (second < 60), made)


def iso_clock_time(text: Column) -> Column:
    """ISO 8601 time whose offset is dropped and whose clock time is kept."""
    offset = r"^(\d{4}-\d{2}-\d{2}.\d{2}.*?)(?:Z|[+-]\d{2}(?::?\d{2}){0,2})$"
    bare = F.regexp_replace(text, offset, "$1")
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}(?:.\d{2}.*)?$"), bare.try_cast("timestamp"))


def _header(lines: DataFrame, year, rfc5424: bool) -> DataFrame:
    """Add _host, _program, _message and _time. Each step is evaluated once per line, and only
    the first runs on the whole line."""
    year = F.year(F.current_date()) if year is None else F.lit(year)
    raw = F.col("raw")
    df = with_line_id(lines).withColumn("raw", strip(raw))
    df = evaluated_once(df, _head=F.regexp_extract(raw, BSD_HEADER, 0))
    fields = F.when(F.col("_head") != "", groups(F.col("_head"), BSD_HEADER, 1, 2, 3))
    if rfc5424:
        df = evaluated_once(df, _rfc=F.when((F.col("_head") == "") & raw.startswith("<"),
                                            F.regexp_extract(raw, RFC5424_HEADER, 0)).otherwise(""))
        fields = fields.when(F.col("_rfc") != "", groups(F.col("_rfc"), RFC5424_HEADER, 1, 2, 3))
    df = evaluated_once(df, _fields=fields)
    stamp, bsd = F.col("_fields")[0], F.col("_head") != ""
    df = evaluated_once(df, _parts=F.when(bsd, F.split(stamp, r"(?U)[\s:]+")))
    time, used = bsd_time(F.col("_parts"), year), F.length("_head")
    if rfc5424:
        time = F.coalesce(time, F.when(~bsd, iso_clock_time(stamp)))
        used = used + F.length("_rfc")
    return evaluated_once(df, _time=time, _message=F.substr(raw, used + 1),
                          _host=F.coalesce(F.col("_fields")[1], F.lit("unknown")),
                          _program=F.coalesce(F.col("_fields")[2], F.lit("unknown")))


def _strings(*names: str) -> Column:
    return F.array(*[F.lit(n) for n in names])


def _event(df: DataFrame, source_type: str, ctx: dict[str, Column], ingest_time) -> DataFrame:
    time, fallback = filled_time(F.col("_time"), ingest_time)
    values = {
        "id": F.col("line_id"), "timestamp": time, "ts_fallback": fallback,
        "event.kind": F.lit("event"), "event.category": ctx["category"],
        "event.action": ctx["action"], "event.outcome": ctx["outcome"], "event.id": F.col("line_id"),
        "source.ip": ctx["ip"], "source.port": ctx["port"].try_cast("int"),
        "destination.host": F.col("_host"), "destination.port": ctx.get("dest_port", F.lit(None)),
        "user.name": ctx["user"], "host.name": F.col("_host"), "host.os_family": F.lit("linux"),
        "log.source_type": F.lit(source_type), "log.raw": F.col("raw"),
    }
    return with_custody_hash(df.select(*event_columns(values)))


def normalize_syslog(lines: DataFrame, year: int | None = None, ingest_time=None) -> DataFrame:
    df = _header(lines, year, rfc5424=True)
    m = F.col("_message")
    df = evaluated_once(df, _kind=F.when(has(m, "Failed password for ", SSH_FAILED), "failed")
                        .when(has(m, "Accepted p", SSH_ACCEPTED), "accepted"))
    failed, accepted = F.col("_kind") == "failed", F.col("_kind") == "accepted"
    df = evaluated_once(df, _found=F.when(failed, groups(m, SSH_FAILED, 1, 2, 3))
                        .when(accepted, groups(m, SSH_ACCEPTED, 1, 2, 3)))
    found = F.col("_found")

    return _event(df, "syslog", {
        "action": F.when(failed, "ssh_login_failed").when(accepted, "ssh_login_success")
                   .otherwise("syslog_message"),
        "outcome": F.when(failed, "failure").when(accepted, "success").otherwise("unknown"),
        "category": F.when(F.col("_kind").isNotNull(), _strings("authentication"))
                     .otherwise(_strings("process")),
        "user": found[0], "ip": found[1], "port": found[2],
    }, ingest_time)


def normalize_auth_log(lines: DataFrame, year: int | None = None, ingest_time=None) -> DataFrame:
    """Eight ordered branches; the first that matches classifies the line."""
    df = _header(lines, year, rfc5424=False)
    m = F.col("_message")
    kind = (F.when(has(m, "Failed password for ", SSH_FAILED), "ssh_login_failed")
            .when(has(m, "Accepted p", SSH_ACCEPTED), "ssh_login_success")
            .when(has(m, "Invalid user ", SSH_INVALID_USER), "ssh_invalid_user")
            .when(has(m, "COMMAND=", SUDO), "sudo_command")
            .when(has(m, "pam_unix(su", SU_SESSION), F.concat(F.lit("su_session_"), F.regexp_extract(m, SU_SESSION, 1)))
            .when(has(m, "authentication failure", PAM_FAILURE), "pam_auth_failure")
            .when(F.upper("_program").contains("CRON"), "cron_session")
            .otherwise("auth_event"))
    df = evaluated_once(df, _action=kind)
    a = F.col("_action")
    su = a.startswith("su_session_")
    # User, address and port, where the branch has them.
    found = (F.when(a == "ssh_login_failed", groups(m, SSH_FAILED, 1, 2, 3))
             .when(a == "ssh_login_success", groups(m, SSH_ACCEPTED, 1, 2, 3))
             .when(a == "ssh_invalid_user", groups(m, SSH_INVALID_USER, 1, 2, 0))
             .when(a == "sudo_command", groups(m, SUDO, 1, 0, 0))
             .when(su, groups(m, SU_SESSION, 2, 0, 0))
             .when(a == "pam_auth_failure", groups(m, PAM_FAILURE, 1, 0, 0)))
    df = evaluated_once(df, _found=found)
    found = F.col("_found")
    return _event(df, "auth_log", {
        "action": a,
        "outcome": F.when(a.isin("ssh_login_failed", "ssh_invalid_user", "pam_auth_failure"), "failure")
                    .when(a == "auth_event", "unknown").otherwise("success"),
        "category": F.when(a == "sudo_command", _strings("process", "iam"))
                     .when(su, _strings("authentication", "session"))
                     .when(a == "cron_session", _strings("process"))
                     .otherwise(_strings("authentication")),
        "user": found[0], "ip": found[1], "port": found[2],
        "dest_port": F.when(a.contains("ssh"), 22),
    }, ingest_time)
