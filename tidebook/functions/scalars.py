"""Prices and times. Times are nanoseconds past midnight of a session date, without a zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_NS = 86_400_000_000_000


def price(raw: Column, decimals: int = 4) -> Column:
    """Raw fixed point as DOUBLE; one division, so the nearest double."""
    return raw.cast("double") / F.lit(float(10**decimals))


def price_decimal(raw: Column, decimals: int = 4) -> Column:
    """Exact: DECIMAL(14,4) or DECIMAL(28,8)."""
    kind = f"decimal({14 if decimals == 4 else 28},{decimals})"
    return (raw.cast("decimal(20,0)") * F.lit(f"1e-{decimals}").cast(f"decimal({decimals},{decimals})")).cast(kind)


def price_text(raw: Column, decimals: int = 4) -> Column:
    """With all decimals, as 150.0000."""
    return price_decimal(raw, decimals).cast("string")


def make_price(c: Column, decimals: int = 4) -> Column:
    """Raw value of a price in currency units, half up."""
    return F.floor(c.cast("decimal(28,10)") * F.lit(10**decimals) + F.lit("0.5").cast("decimal(2,1)")).cast("long")


def time_text(ns: Column) -> Column:
    """HH:MM:SS.nnnnnnnnn; hours go on beyond 23."""
    s = F.floor(ns / 1_000_000_000).cast("long")
    return F.when(ns.isNotNull(), F.format_string("%02d:%02d:%02d.%09d", (s / 3600).cast("long"), (s / 60).cast("long") % 60, s % 60, ns % 1_000_000_000))


def moment_text(date: Column, ns: Column) -> Column:
    """Date and time; whole days of ``ns`` carry into the date."""
    days = (ns / F.lit(float(DAY_NS))).cast("int")
    return F.concat(F.date_format(F.date_add(date, days), "yyyy-MM-dd"), F.lit(" "), time_text(ns % DAY_NS))


def moment(date: Column, ns: Column) -> Column:
    """TIMESTAMP_NTZ for display: cut to microseconds."""
    return date.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.floor(ns / 1000) / 1_000_000).cast("decimal(18,6)"))


def split_timestamp(ns: Column) -> tuple[Column, Column]:
    """High and low 32 bits."""
    return F.shiftright(ns, 32), ns.bitwiseAND(F.lit(0xFFFFFFFF))


def join_timestamp(high: Column, low: Column) -> Column:
    """From both parts, masked to 48 bits."""
    return (F.shiftleft(high.cast("long"), 32).bitwiseOR(low)).bitwiseAND(F.lit((1 << 48) - 1))
