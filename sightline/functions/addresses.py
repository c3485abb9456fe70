"""Addresses of hosts as numbers, searched in sorted ranges, in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# IPv4 blocks that are not crawled.
BLOCKED_V4 = ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16", "198.18.0.0/15", "224.0.0.0/3")
# IPv6 blocks that are not crawled, by their first 16 bits; the two least addresses are blocked too.
BLOCKED_V6 = ("fc00/7", "fe80/10")


def v4_ranges(blocks=BLOCKED_V4) -> list[tuple[int, int]]:
    """(first, last) of each block as numbers, in order."""
    out = []
    for block in blocks:
        address, bits = block.split("/")
        size = 1 << (32 - int(bits))
        first = sum(int(x) << s for x, s in zip(address.split("."), (24, 16, 8, 0), strict=True))
        out.append((first, first + size - 1))
    return sorted(out)


def v6_ranges(blocks=BLOCKED_V6) -> list[tuple[int, int]]:
    return sorted((int(a, 16), int(a, 16) + (1 << (16 - int(bits))) - 1) for a, bits in (b.split("/") for b in blocks))


def in_ranges(number: Column, ranges: list[tuple[int, int]]) -> Column:
    """Whether a number lies in one of the sorted ranges that don't overlap: as many comparisons as their number has bits."""
    if not ranges:
        return F.lit(False)
    if len(ranges) == 1:
        return number.between(*ranges[0])
    middle = len(ranges) // 2
    return F.when(number < ranges[middle][0], in_ranges(number, ranges[:middle])).otherwise(in_ranges(number, ranges[middle:]))


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def v4_number(host: Column) -> Column:
    """The number of a dotted IPv4 address; null for other texts and parts above 255."""

    def number(parts: Column) -> Column:
        return F.when((F.size(parts) == 4) & F.forall(parts, lambda p: p <= 255), F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n * 256 + p))

    return bound(F.transform(F.split(F.regexp_extract(host, r"^(\d{1,9}\.\d{1,9}\.\d{1,9}\.\d{1,9})$", 1), r"\."), lambda p: p.try_cast("long")), number)


def v6_groups(host: Column) -> Column:
    """The eight 16-bit groups of an IPv6 address without brackets, with or without a zone; null for other texts."""
    none = F.array().cast("array<string>")
    groups = lambda part: F.filter(F.split(part, ":"), lambda g: g != "")
    hexed = lambda n: F.concat(F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(0xFFFF))))

    def plain(text: Column) -> Column:
        """With an IPv4 address at the end written as two groups."""
        return bound(v4_number(F.regexp_extract(text, r":(\d+\.\d+\.\d+\.\d+)$", 1)), lambda n: F.when(n.isNull(), text).otherwise(F.concat(F.regexp_replace(text, r"\d+\.\d+\.\d+\.\d+$", ""), hexed(n))))

    def whole(sides: Column) -> Column:
        """Both sides of ``::``, and the zeros between them."""
        short = F.size(sides) == 2
        parts = F.struct(groups(sides[0]).alias("left"), F.when(short, groups(F.get(sides, F.lit(1)))).otherwise(none).alias("right"))
        return bound(parts, lambda p: F.when(short & (F.size(p["left"]) + F.size(p["right"]) < 8), F.concat(p["left"], F.array_repeat(F.lit("0"), 8 - F.size(p["left"]) - F.size(p["right"])), p["right"])).when(~short, p["left"]))

    def read(text: Column) -> Column:
        form = text.rlike("^[0-9a-f:]*:[0-9a-f:]*$") & ~text.rlike(":::|::.*::|^:[^:]|[^:]:$")
        return F.when(form, bound(whole(F.split(text, "::")), lambda g: F.when((F.size(g) == 8) & F.forall(g, lambda x: F.length(x) <= 4), F.transform(g, lambda x: F.conv(x, 16, 10).try_cast("long")))))

    return bound(plain(F.lower(F.regexp_replace(host, "%.*$", ""))), read)


def blocked_address(host: Column) -> Column:
    """Whether a host (IPv6 with or without brackets) is an address that is not crawled; null if it is no address.

    IPv4 addresses mapped into IPv6 are judged as IPv4.
    """

    def judged(groups: Column) -> Column:
        leading = lambda n: F.forall(F.slice(groups, 1, n), lambda g: g == 0)
        mapped = leading(5) & (groups[5] == 0xFFFF)
        return F.when(groups.isNotNull(), F.when(mapped, in_ranges(groups[6] * 65536 + groups[7], v4_ranges())).otherwise(in_ranges(groups[0], v6_ranges()) | (leading(7) & (groups[7] <= 1))))

    def address(bare: Column) -> Column:
        return bound(v4_number(bare), lambda n: F.when(n.isNotNull(), in_ranges(n, v4_ranges())).otherwise(bound(v6_groups(bare), judged)))

    return bound(F.regexp_replace(F.lower(host), r"^\[|\]$|\.$", ""), address)
