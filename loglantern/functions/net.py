"""Address normalisation with built-in functions only.

Host names are never resolved: a network lookup per row has no place in a
distributed job, so a name reads as null.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from loglantern.functions.binding import let

_BYTE = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_CANONICAL_V4 = rf"^{_BYTE}(\.{_BYTE}){{3}}$"


def normalize_ip(text: Column) -> Column:
    """Canonical text of an IPv4 or IPv6 literal, null for everything else."""
    value = F.trim(text)
    return (
        F.when(value.rlike(_CANONICAL_V4), value)
        .when(value.rlike(r"^\d+(\.\d+){0,3}$"), _ipv4(value))
        .when(value.contains(":"), _ipv6(F.lower(F.regexp_replace(value, r"^\[(.*)\]$", "$1"))))
    )


def _power256(exponent: Column) -> Column:
    return F.pow(F.lit(256), exponent).cast("bigint")


def _dotted(number: Column) -> Column:
    """A 32-bit number as four decimal bytes."""
    return F.concat_ws(".", *[F.shiftright(number, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])


def _ipv4(value: Column) -> Column:
    """A literal of one to four numbers; the last one fills the bytes left open (``127.1``)."""

    def from_parts(parts: Column) -> Column:
        n = F.size(parts)
        head, last = F.slice(parts, 1, n - 1), F.element_at(parts, -1)
        fits = F.forall(head, lambda p: p.between(0, 255)) & last.between(0, _power256(F.lit(5) - n) - 1)
        shifted = F.transform(head, lambda p, i: p * _power256(F.lit(3) - i))
        return F.when(fits, let(F.aggregate(shifted, last, lambda a, p: a + p), _dotted))

    return let(F.transform(F.split(value, r"\."), lambda p: p.try_cast("bigint")), from_parts)


def _ipv6(value: Column) -> Column:
    """Eight groups without leading zeros; an IPv4-mapped address reads as IPv4."""

    def from_text(v: Column) -> Column:
        dotted = F.regexp_extract(v, r":(\d+\.\d+\.\d+\.\d+)$", 1)
        octets = F.transform(F.split(dotted, r"\."), lambda p: p.try_cast("int"))
        as_hex = let(
            octets,
            lambda o: F.concat_ws(
                ":",
                F.lower(F.hex(o[0] * 256 + o[1])),
                F.lower(F.hex(o[2] * 256 + o[3])),
            ),
        )
        # A dotted tail counts as two groups.
        groups_only = (
            F.when(dotted == "", v)
            .when(F.forall(octets, lambda o: o.between(0, 255)), F.regexp_replace(v, r"\d+\.\d+\.\d+\.\d+$", as_hex))
        )
        return let(F.split(groups_only, "::", -1), from_halves)

    def groups(part: Column) -> Column:
        return F.filter(F.split(part, ":", -1), lambda g: g != "")

    def from_halves(halves: Column) -> Column:
        intact = F.forall(halves, lambda h: (h == "") | h.rlike(r"^[0-9a-f]{1,4}(:[0-9a-f]{1,4})*$"))
        left = groups(F.element_at(halves, 1))
        right = F.coalesce(groups(F.try_element_at(halves, F.lit(2))), F.array().cast("array<string>"))
        open_groups = F.lit(8) - F.size(left) - F.size(right)
        full = F.when(
            (F.size(halves) == 2) & (open_groups >= 1),
            F.concat(left, F.array_repeat(F.lit("0"), F.greatest(open_groups, F.lit(0))), right),
        ).when((F.size(halves) == 1) & (open_groups == 0), left)
        return F.when(
            intact,
            let(F.transform(full, lambda g: F.regexp_replace(g, "^0+(?=.)", "")), written),
        )

    def written(short: Column) -> Column:
        def word(i: int) -> Column:
            return F.conv(F.element_at(short, i), 16, 10).cast("bigint")

        mapped = F.array_join(F.slice(short, 1, 6), ":") == "0:0:0:0:0:ffff"
        return F.when(mapped, let(word(7) * 65536 + word(8), _dotted)).otherwise(F.array_join(short, ":"))

    return let(value, from_text)
