"""The IP address inside a peer address, as hex digits.

An IPv4 address becomes 8 hex digits and an IPv6 address 32, so the length tells the family
and a network prefix is a prefix of the digits. Anything that is not an IP gives NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
DOTTED = rf"{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}"
HEX = "0123456789abcdef"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _v4(text: Column) -> Column:
    def two_digits(octet: Column) -> Column:
        return F.lpad(F.lower(F.hex(octet.cast("int"))), 2, "0")

    digits = F.array_join(F.transform(F.split(text, r"\."), two_digits), "")
    return F.when(text.rlike(f"^{DOTTED}$"), digits)


def _v6(text: Column) -> Column:
    # A dotted tail stands for the last two groups.
    tail = F.regexp_extract(text, rf":({DOTTED})$", 1)

    def undotted(dotted: Column) -> Column:
        head = F.substring(text, F.lit(1), F.length(text) - F.length(dotted))
        groups = _let(_v4(dotted), lambda h: F.concat(F.substring(h, 1, 4), F.lit(":"), F.substring(h, 5, 4)))
        return F.when(dotted == "", text).otherwise(F.concat(head, groups))

    return F.when(text.contains(":"), _let(F.lower(_let(tail, undotted)), _v6_groups))


def _v6_groups(text: Column) -> Column:
    none = F.array().cast("array<string>")

    def groups(part: Column) -> Column:
        return F.when(part == "", none).otherwise(F.split(part, ":", -1))

    def join(halves: Column) -> Column:
        # One half: no "::" in the text. Two: the zeros between them are left out.
        left, right = groups(halves[0]), groups(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
        return _let(F.struct(left.alias("l"), right.alias("r"), F.size(halves).alias("n")), fill)

    def fill(h: Column) -> Column:
        given = F.size(h["l"]) + F.size(h["r"])
        sound = F.forall(F.concat(h["l"], h["r"]), lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        whole = ((h["n"] == 1) & (given == 8)) | ((h["n"] == 2) & (given < 8))
        zeros = F.array_repeat(F.lit("0"), 8 - given)
        parts = F.transform(F.concat(h["l"], zeros, h["r"]), lambda g: F.lpad(g, 4, "0"))
        return F.when(sound & whole, F.array_join(parts, ""))

    return _let(F.split(text, "::", -1), join)


def ip_hex(text: Column) -> Column:
    return _let(text, lambda t: F.coalesce(_v4(t), _v6(t)))


def peer_ip(addr: Column) -> Column:
    """``v4:port``, ``[v6]:port``, bare v4 and bare v6; NULL for onion, I2P and the empty text."""
    bracketed = F.regexp_extract(addr, r"^\[([^\]]*)", 1)
    host = F.regexp_extract(addr, r"^(.*):[0-9]*$", 1)
    forms = F.when(addr.startswith("["), F.array(bracketed)).otherwise(F.array(host, addr))
    parsed = F.transform(forms, ip_hex)
    return F.get(F.array_compact(parsed), F.lit(0))


def mask(digits: Column, bits: Column) -> Column:
    """The first ``bits`` bits of hex digits, as hex digits with the rest of the last one 0."""
    rest = F.pmod(bits, F.lit(4))
    whole = F.substring(digits, F.lit(1), F.floor(bits / 4).cast("int"))
    digit = F.substring(digits, F.floor(bits / 4).cast("int") + 1, F.lit(1))
    value = F.instr(F.lit(HEX), digit) - 1
    unit = F.call_function("shiftleft", F.lit(1), F.lit(4) - rest)
    kept = value - F.pmod(value, unit)
    last = F.substring(F.lit(HEX), kept.cast("int") + 1, F.lit(1))
    return F.when(rest == 0, whole).otherwise(F.concat(whole, last))


def last_address(net: Column, bits: Column, family: Column) -> Column:
    """The last address of a network that ``mask`` gave, as ``family`` hex digits."""
    rest = F.pmod(bits, F.lit(4))
    whole = F.substring(net, F.lit(1), F.floor(bits / 4).cast("int"))
    value = F.instr(F.lit(HEX), F.substring(net, F.floor(bits / 4).cast("int") + 1, F.lit(1))) - 1
    unit = F.call_function("shiftleft", F.lit(1), F.lit(4) - rest)
    last = F.substring(F.lit(HEX), (value + unit).cast("int"), F.lit(1))
    return F.rpad(F.when(rest == 0, whole).otherwise(F.concat(whole, last)), family, "f")
