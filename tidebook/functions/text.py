"""Fixed-width text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAD = " \x00"


def trim_fixed(c: Column | str) -> Column:
    """``c`` without trailing spaces and NULs; leading blanks stay. Null gives null."""
    return F.rtrim(F.col(c) if isinstance(c, str) else c, F.lit(PAD))
