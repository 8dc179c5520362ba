"""Addresses: text, 32-bit number and 16-byte key, all as built-in expressions.

The key is the IPv6 form (IPv4 as ``::ffff:a.b.c.d``). Spark compares binary unsigned and byte by byte, so one range
predicate on the key expresses a CIDR block of either family and can be answered from Parquet statistics.

IPv4 is the common case and costs one regular expression plus string slicing. IPv6 text takes the branch that binds
intermediate values with :func:`_let`, which keeps the expression tree small however often a value is used.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MAPPED_PREFIX = "::ffff:"
MAPPED_KEY_HEX = "0" * 20 + "ffff"
IPV4_FIRST = bytes.fromhex(MAPPED_KEY_HEX) + bytes(4)
UNKNOWN_IP = "::"

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_DOTTED = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
_MAPPED_OR_DOTTED = rf"^(?:::[fF]{{4}}:)?{_OCTET}(?:\.{_OCTET}){{3}}$"
_DOTTED_WITH_ZEROS = rf"^0*{_OCTET}(?:\.0*{_OCTET}){{3}}$"
_DOTTED_TAIL = r"^[0-9a-f:]*:[0-9]+\.[0-9.]+$"
_HEX_GROUPS = r"^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?$"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ipv4_text(number: Column) -> Column:
    """Dotted text of a 32-bit address number."""
    octets = [F.shiftright(number, 24), *[F.shiftright(number, s).bitwiseAND(255) for s in (16, 8, 0)]]
    return F.concat_ws(".", *[o.cast("string") for o in octets])


def _dotted_value(text: Column) -> Column:
    octets = (
        F.substring_index(text, ".", 1),
        F.substring_index(F.substring_index(text, ".", 2), ".", -1),
        F.substring_index(F.substring_index(text, ".", -2), ".", 1),
        F.substring_index(text, ".", -1),
    )
    a, b, c, d = (o.cast("long") for o in octets)
    return a * 16777216 + b * 65536 + c * 256 + d


def ipv4_number(text: Column) -> Column:
    """32-bit number of strictly dotted text (four octets up to 255, none empty), NULL for anything else.

    Leading zeros are allowed, as range files may carry them.
    """
    return F.when(text.rlike(_DOTTED_WITH_ZEROS), _dotted_value(text))


def plain_ipv4_number(text: Column) -> Column:
    """As :func:`ipv4_number` for address text proper: no leading zeros, and the IPv4-mapped form counts as IPv4."""
    return F.when(text.rlike(_MAPPED_OR_DOTTED), _dotted_value(F.substring_index(text, ":", -1)))


def _number_hex(number: Column) -> Column:
    return F.lpad(F.lower(F.hex(number)), 8, "0")


def _groups_hex(text: Column) -> Column:
    """32 hex digits of lower-case IPv6 text made of hex groups only, NULL when it does not parse."""

    def groups(half: Column) -> Column:
        return F.filter(F.split(half, ":"), lambda g: g != "")

    def pad(head: Column, rest: Column, shortened: Column) -> Column:
        given = F.size(head) + F.size(rest)
        fits = F.when(shortened, given <= 7).otherwise(given == 8)
        zeros = F.array_repeat(F.lit("0"), F.greatest(8 - given, F.lit(0)))
        digits = F.transform(F.concat(head, zeros, rest), lambda g: F.lpad(g, 4, "0"))
        return F.when(fits, F.array_join(digits, ""))

    def of_halves(halves: Column) -> Column:
        left, right = F.get(halves, F.lit(0)), F.coalesce(F.get(halves, F.lit(1)), F.lit(""))
        well_formed = (F.size(halves) <= 2) & left.rlike(_HEX_GROUPS) & right.rlike(_HEX_GROUPS)
        shortened = F.size(halves) == 2
        both = F.named_struct(F.lit("head"), groups(left), F.lit("rest"), groups(right))
        return F.when(well_formed, _let(both, lambda b: pad(b["head"], b["rest"], shortened)))

    return _let(F.split(text, "::"), of_halves)


def _ipv6_hex(text: Column) -> Column:
    """32 hex digits of IPv6 text, with or without a dotted tail, NULL when it does not parse."""

    def untailed(low: Column) -> Column:
        """The dotted tail, if any, replaced by two hex groups."""
        tail = F.substring_index(low, ":", -1)
        front = F.substr(low, F.lit(1), F.length(low) - F.length(tail))
        number = F.when(tail.rlike(_DOTTED), _dotted_value(tail))
        as_groups = _let(
            _number_hex(number), lambda h: F.concat(F.substring(h, 1, 4), F.lit(":"), F.substring(h, 5, 4))
        )
        return F.when(low.rlike(_DOTTED_TAIL), F.concat(front, as_groups)).otherwise(low)

    return _let(_let(F.lower(text), untailed), _groups_hex)


def ip_key(text: Column) -> Column:
    """16-byte key of address text; text that does not parse becomes the all-zero key."""
    number = plain_ipv4_number(text)
    v4 = F.concat(F.lit(MAPPED_KEY_HEX), F.lpad(F.hex(number), 8, "0"))
    v6 = F.when(text.contains(":"), _ipv6_hex(text))
    return F.unhex(F.coalesce(v4, v6, F.lit("0" * 32)))


def any_ipv4_number(text: Column) -> Column:
    """As :func:`plain_ipv4_number`, and IPv4-mapped addresses in every other spelling (``::ffff:a00:1``) as well."""
    digits = F.when(text.contains(":"), _ipv6_hex(text))
    mapped = _let(digits, lambda h: F.when(h.startswith(MAPPED_KEY_HEX), F.conv(F.substring(h, 25, 8), 16, 10).cast("long")))
    return F.coalesce(plain_ipv4_number(text), mapped)


def key_text(key: Column) -> Column:
    """Canonical text of a 16-byte key: dotted for IPv4, lower case with the longest zero run shortened for IPv6."""

    def shorten(groups: Column) -> Column:
        """Groups joined by colons, their first longest run of two or more zeros as ``::``."""
        zeros = F.array_join(F.transform(groups, lambda g: F.when(g == "0", "0").otherwise("x")), "")

        def cut(marks: Column) -> Column:
            run = F.lit(0)
            for length in range(2, 9):
                run = F.when(marks.contains("0" * length), length).otherwise(run)
            return _let(run, lambda n: around(F.call_function("instr", marks, F.repeat(F.lit("0"), n)), n))

        def around(start: Column, run: Column) -> Column:
            left, right = F.slice(groups, F.lit(1), start - 1), F.slice(groups, start + run, F.lit(8))
            both = F.concat(F.array_join(left, ":"), F.lit("::"), F.array_join(right, ":"))
            return F.when(run == 0, F.array_join(groups, ":")).otherwise(both)

        return _let(zeros, cut)

    def of_digits(digits: Column) -> Column:
        groups = F.transform(
            F.sequence(F.lit(0), F.lit(7)),
            lambda i: F.regexp_replace(F.substr(digits, i * 4 + 1, F.lit(4)), "^0{1,3}", ""),
        )
        v4 = _let(F.conv(F.substring(digits, 25, 8), 16, 10).cast("long"), ipv4_text)
        return F.when(digits.startswith(MAPPED_KEY_HEX), v4).otherwise(_let(groups, shorten))

    return _let(F.lower(F.hex(key)), of_digits)


def canonical_ip(text: Column) -> Column:
    """Address text in its one stored spelling; ``::`` when it does not parse."""
    return F.when(text.rlike(_DOTTED), text).otherwise(key_text(ip_key(text)))


def render_ip(text: Column) -> Column:
    """Address as people read it: the IPv4-mapped prefix removed."""
    return F.when(text.startswith(MAPPED_PREFIX), F.substr(text, F.lit(len(MAPPED_PREFIX) + 1))).otherwise(text)


def literal_ip(value: object) -> str:
    """Canonical spelling of one address given as an argument; raises ValueError when it is none."""
    address = ipaddress.ip_address(str(value))
    mapped = getattr(address, "ipv4_mapped", None)
    return str(mapped or address)


def cidr_bounds(value: object) -> tuple[bytes, bytes]:
    """First and last 16-byte key of a CIDR block of either family."""
    if "/" not in str(value):
        raise ValueError(f"{value!r} is no CIDR block: the prefix length is missing")
    block = ipaddress.ip_network(str(value), strict=False)
    first, last = int(block.network_address), int(block.broadcast_address)
    if block.version == 4:
        mapped = 0xFFFF << 32
        first, last = first | mapped, last | mapped
    return first.to_bytes(16, "big"), last.to_bytes(16, "big")


def ipv4_block(first: bytes, last: bytes) -> tuple[int, int, str] | None:
    """Bounds of a block of keys as IPv4 numbers and the dotted prefix they share, None when it is no IPv4 block."""
    mapped = bytes.fromhex(MAPPED_KEY_HEX)
    if not (first.startswith(mapped) and last.startswith(mapped)):
        return None
    low, high = first[12:], last[12:]
    shared = 0
    while shared < 3 and low[shared] == high[shared]:
        shared += 1
    prefix = "".join(f"{octet}." for octet in low[:shared])
    return int.from_bytes(low, "big"), int.from_bytes(high, "big"), prefix
