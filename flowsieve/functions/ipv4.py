"""IPv4 text -> integer (0 .. 2**32-1) as native column expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowsieve.functions.util import as_col

# Strict dotted quad: four decimal octets 0..255 without leading zeros.
_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_PATTERN = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def ipv4_split(c) -> Column:
    """The dotted-quad parts; compute once (own projection) when several expressions use them."""
    return F.split(as_col(c), r"\.", -1)


def ipv4_parts_to_int(parts) -> Column:
    """Strict conversion from split parts (see ``ipv4_to_int``)."""
    parts = as_col(parts)
    octs = [F.get(parts, i) for i in range(4)]
    ints = [o.try_cast("int") for o in octs]
    ok = F.size(parts) == 4
    for o, i in zip(octs, ints):
        ok = ok & i.between(0, 255) & (i.cast("string") == o)
    value = (ints[0].cast("bigint") * F.lit(16777216) + ints[1].cast("bigint") * F.lit(65536)
             + ints[2].cast("bigint") * F.lit(256) + ints[3].cast("bigint"))
    return F.when(F.coalesce(ok, F.lit(False)), value).cast("bigint")


def ipv4_to_int(c) -> Column:
    """Strict conversion; anything that is not a dotted quad becomes null.

    Regex-free (same language as ``IPV4_PATTERN``): split on '.', and an octet is valid
    when it parses as an int in 0..255 and prints back to exactly the same text (which
    rejects signs, blanks and leading zeros). For wide projections prefer
    ``ipv4_split`` in one select and ``ipv4_parts_to_int`` in the next, so the split runs
    once per value (Catalyst keeps the two projections apart because the split is
    referenced many times)."""
    return ipv4_parts_to_int(ipv4_split(c))


def ipv4_to_int_null0(c, parts=None) -> Column:
    """Strict conversion with missing or invalid addresses mapped to 0."""
    v = ipv4_parts_to_int(parts) if parts is not None else ipv4_to_int(c)
    return F.coalesce(v, F.lit(0).cast("bigint"))


def ipv4_to_int_safe(c) -> Column:
    """Dotted quad -> int; numeric text -> truncated int; null or anything else -> 0."""
    s = as_col(c).cast("string")
    num = F.trim(s).try_cast("double")
    finite = num.isNotNull() & ~F.isnan(num) & (F.abs(num) < F.lit(9.2e18))
    return F.coalesce(ipv4_to_int(s), F.when(finite, num.cast("bigint")),
                      F.lit(0).cast("bigint"))
