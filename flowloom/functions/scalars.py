"""Scalar expressions for addresses, numbers and measurements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dotted(ip: Column) -> Column:
    return F.concat_ws(".", *(F.shiftright(ip, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)))


def radix_number(text: Column) -> Column:
    """Decimal, 0x hexadecimal or 0 octal text as BIGINT; null if it is none of them."""
    t = F.lower(text)
    number = (
        F.when(t.rlike("^0x[0-9a-f]+$"), F.conv(F.substring(t, 3, 64), 16, 10))
        .when(t.rlike("^0[0-7]+$"), F.conv(t, 8, 10))
        .when(t.rlike("^[0-9]+$"), t)
    )
    return number.try_cast("long")


def fold_destination(ip: Column) -> Column:
    """The four bytes of an address XORed, folded to 6 bits."""
    x = ip.bitwiseAND(F.lit(255))
    for s in (8, 16, 24):
        x = x.bitwiseXOR(F.shiftright(ip, s).bitwiseAND(F.lit(255)))
    return x.bitwiseXOR(F.shiftright(x, 2)).bitwiseAND(F.lit(63))


def median4(values: Column) -> Column:
    """Half the sum of the two middle ones of four, towards zero."""
    s = F.array_sort(values)
    total = s[1] + s[2]
    return F.when(total < 0, -F.floor(-total / 2)).otherwise(F.floor(total / 2)).cast("long")


def cycles_to_ns(cycles: Column, ghz: float = 2.2) -> Column:
    return cycles / F.lit(ghz)


def send_period(burst: int, length: int, hz: int, mbps: int) -> float:
    """Clock cycles between bursts at a link rate."""
    return burst * 8 * (length + 20) * hz / (mbps * 1e6)


def link_rate(packets: Column, seconds: Column, length: int) -> Column:
    """Mbit/s on the wire: 20 bytes of preamble and gap for each packet."""
    return packets * F.lit((length + 20) * 8) / seconds / F.lit(1e6)


def search_rate(lost, low: int = 200, high: int = 10_000, most: int = 1024, until: int = 100) -> list[tuple[int, int, bool]]:
    """Bisect the sending rate: lost(rate) is the number of packets lost at it. Each step: (rate, lost, accepted)."""
    steps = []
    while high - low > until:
        rate = (low + high) // 2
        n = lost(rate)
        steps.append((rate, n, n <= most))
        low, high = (rate, high) if n <= most else (low, rate)
    return steps
