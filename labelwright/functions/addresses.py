"""Literal IP addresses as 8 (IPv4) or 32 hexadecimal digits, and lookups in ranges of them."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelwright.functions.text import let

# Ranges that are loopback, private, link-local, reserved, unspecified or multicast, and what is public inside them.
INTERNAL_V4 = ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24",
               "224.0.0.0/4", "240.0.0.0/4")
PUBLIC_V4 = ("192.0.0.9/32", "192.0.0.10/32")
INTERNAL_V6 = ("::/3", "2001::/23", "2001:db8::/32", "2002::/16", "4000::/2", "8000::/1")
PUBLIC_V6 = ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28", "fec0::/10")
_OCTET = r"(0|[1-9]\d{0,2})"
V4 = rf"{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}"


def v4_digits(host: Column) -> Column:
    """Eight digits of a dotted address; null for anything else."""
    octets = [F.regexp_extract(host, f"^{V4}$", i).try_cast("int") for i in (1, 2, 3, 4)]
    fine = octets[0].isNotNull()
    for o in octets:
        fine = fine & (o <= 255)
    return F.when(fine, F.lower(F.concat(*[F.lpad(F.hex(o), 2, "0") for o in octets])))


def v6_digits(literal: Column) -> Column:
    """Thirty-two digits of an IPv6 literal without brackets; null where it is none. ``::`` stands for at least one group
    of zeros, the last two groups may be dotted, and a zone behind ``%`` is left out."""
    bare = F.regexp_replace(F.lower(literal), r"%[^%]+$", "")
    tail = v4_digits(F.regexp_extract(bare, r":([^:]*\.[^:]*)$", 1))
    plain = F.when(bare.contains("."), F.concat(F.regexp_extract(bare, r"^(.*:)[^:]*$", 1), F.substring(tail, 1, 4), F.lit(":"), F.substring(tail, 5, 4))).otherwise(bare)

    def whole(halves: Column) -> Column:
        side = lambda i: F.when(F.get(halves, F.lit(i)) == "", F.array().cast("array<string>")).otherwise(F.split(F.get(halves, F.lit(i)), ":"))
        return let(side(0), lambda left: let(F.when(F.size(halves) == 2, side(1)).otherwise(F.array().cast("array<string>")), lambda right: filled(halves, left, right)))

    def filled(halves: Column, left: Column, right: Column) -> Column:
        missing = 8 - F.size(left) - F.size(right)
        fits = F.forall(F.concat(left, right), lambda g: g.rlike("^[0-9a-f]{1,4}$")) & F.when(F.size(halves) == 1, missing == 0).otherwise((F.size(halves) == 2) & (missing >= 1))
        groups = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), missing)), right)
        return F.when(fits, F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), ""))

    return let(F.split(plain, "::"), whole)


def _within(digits: Column, networks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for n in map(ipaddress.ip_network, networks):
        low, high = (format(int(a), f"0{n.max_prefixlen // 4}x") for a in (n[0], n[-1]))
        out = out | digits.between(low, high)
    return out


def is_internal(digits: Column) -> Column:
    """Whether an address of 8 (IPv4) or 32 digits lies in a range that is not public. Mapped addresses are in a reserved
    range whatever IPv4 address they hold."""
    return F.when(F.length(digits) == 8, _within(digits, INTERNAL_V4) & ~_within(digits, PUBLIC_V4)).otherwise(_within(digits, INTERNAL_V6) & ~_within(digits, PUBLIC_V6))
