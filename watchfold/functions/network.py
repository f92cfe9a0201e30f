"""Address predicates and parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Address patterns, fixed values. IPv4 octets carry no leading zeros.
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"(?:{OCTET}\.){{3}}{OCTET}"
HEX4 = r"[0-9a-fA-F]{1,4}"
INTERNAL = r"\A(?:10|127|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\."

# Address prefixes that count as internal in the literal form, fixed values.
INTERNAL_PREFIXES = ["10.", "172.16.", "172.17.", "172.18.", "172.19.", "172.2",
                     "172.30.", "172.31.", "192.168.", "127."]


def is_internal(ip: Column, literal: bool = False) -> Column:
    """RFC 1918 or loopback by octets; ``literal`` uses the plain prefix list instead."""
    if literal:
        hit = F.lit(False)
        for prefix in INTERNAL_PREFIXES:
            hit = hit | ip.startswith(prefix)
        return F.coalesce(hit, F.lit(False))
    return F.coalesce(ip.rlike(INTERNAL), F.lit(False))


def is_external(ip: Column, literal: bool = False) -> Column:
    return F.coalesce(ip != "", F.lit(False)) & ~is_internal(ip, literal)


def is_ipv4(text: Column) -> Column:
    return text.rlike(rf"\A{IPV4}\z")


def ipv6_patterns() -> list[str]:
    """All shapes of an IPv6 address without zone: full, one '::', and a trailing IPv4."""
    shapes = [rf"(?:{HEX4}:){{7}}{HEX4}", rf"(?:{HEX4}:){{6}}{IPV4}"]
    for left in range(0, 8):
        head = "" if left == 0 else rf"{HEX4}(?::{HEX4}){{{left - 1}}}"
        most = 7 - left
        tail = rf"(?:{HEX4}(?::{HEX4}){{0,{most - 1}}})?" if most > 0 else ""
        shapes.append(rf"{head}::{tail}")
        if left <= 5:
            room = 5 - left
            shapes.append(rf"{head}::(?:{HEX4}:){{0,{room}}}{IPV4}")
    return shapes


def is_ipv6(text: Column) -> Column:
    zone = r"(?:%[^%/]+)?"
    return text.rlike(rf"\A(?:{'|'.join(ipv6_patterns())}){zone}\z")


def is_ip(text: Column) -> Column:
    return is_ipv4(text) | is_ipv6(text)


def is_cidr(text: Column) -> Column:
    """A network, host bits allowed; IPv4 also takes a netmask or hostmask."""
    v6 = "|".join(ipv6_patterns())
    prefix4 = r"0*(?:3[0-2]|[12]?[0-9])"
    prefix6 = r"0*(?:12[0-8]|1[01][0-9]|[1-9]?[0-9])"
    run = r"(?:0|128|192|224|240|248|252|254|255)"
    netmask = (rf"(?:255\.){{3}}{run}|(?:255\.){{2}}{run}\.0|255\.{run}\.0\.0|{run}\.0\.0\.0")
    wild = r"(?:0|1|3|7|15|31|63|127|255)"
    hostmask = (rf"{wild}\.255\.255\.255|0\.{wild}\.255\.255|0\.0\.{wild}\.255|0\.0\.0\.{wild}")
    return text.rlike(rf"\A(?:{IPV4}(?:/(?:{prefix4}|{netmask}|{hostmask}))?|(?:{v6})(?:/{prefix6})?)\z")


def ipv4_to_long(ip: Column) -> Column:
    """Address as a number, null when it is not IPv4."""
    parts = F.when(is_ipv4(ip), F.split(ip, r"\."))
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda n, part: n * 256 + part.cast("bigint"))


def _hex_of_ipv4(ip: Column) -> Column:
    parts = F.split(ip, r"\.")
    return F.array_join(F.transform(parts, lambda p: F.lpad(F.hex(p.cast("bigint")), 2, "0")), "")


def address_key(ip: Column) -> Column:
    """17 bytes that order all addresses: the family (4 or 6), then the address as 128 bits; null for other texts.

    An IPv4 address mapped into IPv6 (::ffff:0:0/96) is the IPv4 address; a zone is ignored.
    """
    text = F.regexp_replace(ip, "%.*$", "")
    tail = F.regexp_extract(text, r"([0-9]+\.[0-9.]+)$", 1)
    digits = _hex_of_ipv4(tail)
    plain = F.when(tail == "", text).otherwise(F.concat(
        F.regexp_replace(text, r"[0-9]+\.[0-9.]+$", ""), F.substring(digits, 1, 4), F.lit(":"), F.substring(digits, 5, 4)))
    halves = F.split(plain, "::")
    left = F.filter(F.split(F.get(halves, F.lit(0)), ":"), lambda g: g != "")
    right = F.coalesce(F.filter(F.split(F.get(halves, F.lit(1)), ":"), lambda g: g != ""), F.array().cast("array<string>"))
    groups = F.concat(left, F.array_repeat(F.lit("0"), 8 - F.size(left) - F.size(right)), right)
    long = F.upper(F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), ""))
    mapped = "0" * 20 + "FFFF"
    v6 = F.when(long.startswith(mapped), F.concat(F.lit("04" + "0" * 24), F.substring(long, 25, 8))).otherwise(F.concat(F.lit("06"), long))
    return F.unhex(F.when(is_ipv4(ip), F.concat(F.lit("04" + "0" * 24), _hex_of_ipv4(ip))).when(is_ipv6(ip), v6))


def network_bounds(network: Column) -> Column:
    """First and last address key (start, end) of a CIDR network or single address; null for other texts."""
    base = F.regexp_extract(network, "^([^/]*)", 1)
    key = address_key(base)
    given = F.regexp_extract(network, "/([0-9]+)$", 1).try_cast("int")
    digits = F.hex(key)
    v4 = digits.startswith("04")
    width = F.when(v4, 32).otherwise(128)
    length = F.when(~network.contains("/"), width).when(given.between(0, width), given)
    bits = F.when(v4, length + 96).otherwise(length)

    def half(first: int, low: int) -> tuple[Column, Column]:
        """Lower and upper bound of 64 of the bits, as hexadecimal digits."""
        word = F.conv(F.substring(digits, first, 16), 16, -10).cast("bigint")
        free = F.greatest(F.lit(0), F.least(F.lit(64), F.lit(low + 64) - bits))
        ones = F.when(free >= 64, F.lit(-1).cast("bigint")).when(free == 0, F.lit(0).cast("bigint")).otherwise(
            F.call_function("shiftrightunsigned", F.lit(-1).cast("bigint"), 64 - free))
        return tuple(F.lpad(F.hex(w), 16, "0") for w in (word.bitwiseAND(F.bitwise_not(ones)), word.bitwiseOR(ones)))

    (high_start, high_end), (low_start, low_end) = half(3, 0), half(19, 64)
    family = F.substring(digits, 1, 2)
    # The 96 leading bits of IPv4 keys are zero, in the first as in the last address.
    start, end = F.concat(family, high_start, low_start), F.concat(family, F.when(v4, "0" * 16).otherwise(high_end), low_end)
    return F.when(key.isNotNull() & length.isNotNull(), F.struct(F.unhex(start).alias("start"), F.unhex(end).alias("end")))
