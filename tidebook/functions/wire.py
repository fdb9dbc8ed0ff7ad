"""Big-endian fields of a binary body as column expressions, both ways; no Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidebook.functions.layout import Field
from tidebook.functions.text import trim_fixed


def uint(body: Column, offset: int, size: int) -> Column:
    """Unsigned big-endian of ``size`` bytes at ``offset`` as bigint; of 8 bytes, two's complement,
    so ids keep all bits. Null for null or too short bodies."""
    raw = F.substring(body, offset + 1, size)
    return F.when(F.octet_length(body) >= offset + size, F.conv(F.hex(raw), 16, -10).cast("long"))


def uint_decimal(body: Column, offset: int) -> Column:
    """An 8-byte unsigned as DECIMAL(20,0), for order and arithmetic beyond 2**63."""
    return F.when(F.octet_length(body) >= offset + 8, F.conv(F.hex(F.substring(body, offset + 1, 8)), 16, 10).cast("decimal(20,0)"))


def text(body: Column, offset: int, size: int, trim: bool = True) -> Column:
    """Latin-1 text; trimmed of trailing spaces and NULs unless one byte long or ``trim`` is off."""
    raw = F.decode(F.substring(body, offset + 1, size), "ISO-8859-1")
    return trim_fixed(raw) if trim and size > 1 else raw


def read_sql(f: Field, body: str = "body") -> str:
    """SQL of a field: texts STRING, two-byte fields INT, others (prices raw) BIGINT; null where the body
    ends before the field does. As one parsed text per column, a whole registry is built in milliseconds."""
    raw = f"substring({body}, {f.offset + 1}, {f.size})"
    if f.kind == "a":
        plain = f"decode({raw}, 'ISO-8859-1')"
        value = plain if f.size == 1 else f"trim(TRAILING concat(' ', char(0)) FROM {plain})"
    else:
        value = f"CAST(conv(hex({raw}), 16, -10) AS {'INT' if f.size == 2 else 'BIGINT'})"
    return f"CASE WHEN octet_length({body}) >= {f.offset + f.size} THEN {value} END"


def put_uint(c: Column, size: int) -> Column:
    """The lowest ``size`` bytes of a bigint, big-endian: greater values are masked, as timestamps are."""
    return F.unhex(F.right(F.lpad(F.hex(c.cast("long")), 16, "0"), F.lit(2 * size)))


def write_sql(f: Field) -> str:
    """SQL of a field's bytes: integers as ``put_uint``; texts Latin-1, cut or padded with spaces."""
    if f.kind == "a":
        return f"encode(rpad(`{f.name}`, {f.size}, ' '), 'ISO-8859-1')"
    return f"unhex(right(lpad(hex(CAST(`{f.name}` AS BIGINT)), 16, '0'), {2 * f.size}))"
