"""Sanitizing and checking text that goes into reports, graphs and playbooks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, fixed values.
ANSI = r"\x1b\[[0-9;]*m"
LOG_BREAKING = r"[<>{}\"\[\]|;`]"
LABEL_BREAKING = r"[<>\[\]{}|;\"'`]"
SAFE_VARIABLE = r"(?U)\A[\w.\-:/]+\z"
GENERIC_VALUE = r"(?U)\A[\w.\-:/ ]{1,200}\z"
HOST_LOOSE = r"\A[a-zA-Z0-9][a-zA-Z0-9\-\.]{0,253}\z"
HOST_LABEL = r"[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?"
HOST_STRICT = rf"\A(?:{HOST_LABEL}\.)*{HOST_LABEL}\z"
USERNAME = r"\A[a-z_][a-z0-9_\-]{0,31}\z"
INTEGER = r"\A\+?[0-9]+(?:_[0-9]+)*\z"

# All characters that count as white space at the ends of a text, fixed values.
BLANKS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
          "\u2009\u200a\u2028\u2029\u202f\u205f\u3000")

LOG_LIMIT, LABEL_LIMIT = 500, 80


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def html_escape(c: Column) -> Column:
    """Ampersand first, so that the entities themselves stay intact."""
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(mark), F.lit(entity))
    return c


def sanitize_log(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(c, ANSI, ""), LOG_BREAKING, "")
    return F.substring(html_escape(bare), 1, LOG_LIMIT)


def sanitize_label(c: Column) -> Column:
    bare = F.substring(strip(F.regexp_replace(F.coalesce(c, F.lit("")), LABEL_BREAKING, "")), 1, LABEL_LIMIT)
    return F.when(bare == "", F.lit('"unknown"')).otherwise(F.concat(F.lit('"'), bare, F.lit('"')))


def is_safe_variable(c: Column) -> Column:
    return F.coalesce(c.rlike(SAFE_VARIABLE), F.lit(False))


def is_hostname_loose(c: Column) -> Column:
    return F.coalesce(c.rlike(HOST_LOOSE), F.lit(False))


def is_hostname(c: Column) -> Column:
    """Labels of at most 63 characters, 253 in all."""
    return F.coalesce((F.length(c) <= 253) & c.rlike(HOST_STRICT), F.lit(False))
