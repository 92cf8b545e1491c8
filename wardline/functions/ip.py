"""IPv4 addresses, ranges and CIDR blocks as column expressions.

Addresses are compared as unsigned 32-bit numbers held in a bigint.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ADDRESS_BITS = 32
ADDRESS_COUNT = 1 << ADDRESS_BITS
BUCKET_BITS = 16

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
DOTTED_QUAD = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def power_of_two(exponent: Column) -> Column:
    return F.call_function("shiftleft", _long(1), exponent.cast("int"))


def clean_token(c: Column | str) -> Column:
    """Drop quotes, brackets and commas that surround pasted addresses."""
    return F.translate(_col(c), "'\"[](),", "")


def is_ipv4(c: Column | str) -> Column:
    """True for a strict dotted quad (four decimal octets, no leading zeros)."""
    return _col(c).rlike(DOTTED_QUAD)


def is_address(c: Column | str, pass_ipv6: bool = True) -> Column:
    """Address check; text holding ``:`` is passed through unchecked on request."""
    c = _col(c)
    return is_ipv4(c) | c.contains(":") if pass_ipv6 else is_ipv4(c)


def ip_to_long(c: Column | str) -> Column:
    """Dotted quad to number; NULL when the text is not a dotted quad."""
    c = _col(c)
    value = F.aggregate(F.split(c, r"\."), _long(0), lambda n, octet: n * 256 + octet.try_cast("bigint"))
    return F.when(is_ipv4(c), value)


def long_to_ip(c: Column | str) -> Column:
    c = _col(c)
    octets = [F.shiftright(c, shift).bitwiseAND(_long(255)).cast("string") for shift in (24, 16, 8, 0)]
    return F.when(c.isNotNull(), F.concat_ws(".", *octets))


def binary_to_ip(c: Column | str) -> Column:
    """Four address bytes (as stored by the warehouse) to dotted text."""
    c = _col(c)
    octets = [F.conv(F.hex(F.substring(c, i, 1)), 16, 10) for i in (1, 2, 3, 4)]
    return F.when(F.length(c) == 4, F.concat_ws(".", *octets))


def reverse_octets(c: Column | str) -> Column:
    """``1.2.3.4`` to ``4.3.2.1``, the key form of DNS block lists."""
    return F.array_join(F.reverse(F.split(_col(c), r"\.")), ".")


def cidr_bounds(c: Column | str) -> Column:
    """``a.b.c.d/n`` to ``struct(lo, hi)``; host bits are cleared, bad text gives NULL."""
    c = _col(c)
    base = ip_to_long(F.substring_index(c, "/", 1))
    prefix_len = F.when(c.rlike("/[0-9]{1,2}$"), F.substring_index(c, "/", -1).try_cast("int"))
    size = power_of_two(ADDRESS_BITS - prefix_len)
    lo = base - base % size
    usable = base.isNotNull() & prefix_len.between(0, ADDRESS_BITS)
    return F.when(usable, F.struct(lo.alias("lo"), (lo + size - 1).alias("hi")))


def range_bounds(c: Column | str) -> Column:
    """``1.1.1.1-10`` or ``1.1.1.1-1.1.1.10`` to ``struct(lo, hi)``, swapped if reversed."""
    c = _col(c)
    first = F.substring_index(c, "-", 1)
    last = F.substring_index(c, "-", -1)
    short_last = F.concat(F.regexp_replace(first, "[0-9]+$", ""), last)
    a = ip_to_long(first)
    b = ip_to_long(F.when(last.contains("."), last).otherwise(short_last))
    usable = a.isNotNull() & b.isNotNull() & c.contains("-")
    return F.when(usable, F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")))


def address_bounds(c: Column | str) -> Column:
    """Any accepted form (address, CIDR, range) to ``struct(lo, hi)``; NULL if unusable."""
    text = F.replace(clean_token(c), F.lit("–"), F.lit("-"))
    single = F.concat(text, F.lit("/32"))

    def bounds(t: Column) -> Column:
        return F.when(t.contains("-"), range_bounds(t)).otherwise(cidr_bounds(t))

    # The one-item array has the text worked out once for both forms.
    forms = F.array(F.when(text.contains("-") | text.contains("/"), text).otherwise(single))
    return F.get(F.transform(forms, bounds), F.lit(0))


def cidr_cover(lo: Column | str, hi: Column | str) -> Column:
    """Smallest ordered list of CIDR blocks covering ``lo..hi`` inclusive.

    At each block size ``2**k`` the covering needs at most two blocks: one where
    the left edge, rounded up to that size, sits on an odd multiple, and one
    where the right edge, rounded down, does.  So the list is an element-wise
    expression over the 33 sizes and needs no iteration.
    """
    lo, hi = _col(lo), _col(hi)

    def blocks(k: Column) -> Column:
        size = power_of_two(k)
        left = F.call_function("shiftright", lo + size - 1, k)
        right = F.call_function("shiftright", hi + 1, k)
        prefix_len = (F.lit(ADDRESS_BITS) - k).cast("int").alias("prefix_len")
        inside = left < right
        at_left = F.when(inside & (left % 2 == 1), F.struct((left * size).alias("network"), prefix_len))
        at_right = F.when(
            inside & (right % 2 == 1), F.struct(((right - 1) * size).alias("network"), prefix_len)
        )
        return F.array(at_left, at_right)

    sizes = F.sequence(F.lit(0), F.lit(ADDRESS_BITS))
    found = F.flatten(F.transform(sizes, blocks))
    return F.array_sort(F.filter(found, lambda b: b.isNotNull()))


def cidr_text(network: Column | str, prefix_len: Column | str) -> Column:
    return F.concat(long_to_ip(network), F.lit("/"), _col(prefix_len).cast("string"))


def bucket_of(c: Column | str) -> Column:
    """The /16 an address number lies in."""
    return F.shiftright(_col(c), BUCKET_BITS).cast("int")
