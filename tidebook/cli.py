"""python -m tidebook.cli stats|inspect|filter|convert FILE [--types A,E] [--limit N] [--to csv|parquet] [--out PATH]"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from tidebook.operators.messages import filter_types, histogram, inspect, parse_types
from tidebook.sources.export import write_csv, write_parquet
from tidebook.sources.feed import read_frames, read_messages


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, or 1 for a missing or empty file. A truncated tail ends the feed; stats shows it."""
    p = argparse.ArgumentParser(prog="tidebook", description=__doc__)
    p.add_argument("command", choices=["stats", "inspect", "filter", "convert"])
    p.add_argument("file")
    p.add_argument("--types", default="")
    p.add_argument("--limit", type=int, default=20)
    p.add_argument("--to", choices=["csv", "parquet"], default="csv")
    p.add_argument("--out", default="out")
    a = p.parse_args(argv)
    if not os.path.exists(a.file) or not os.path.getsize(a.file):
        print(f"{a.file}: missing or empty", file=sys.stderr)
        return 1
    spark = spark or SparkSession.builder.appName("tidebook").getOrCreate()
    read = read_frames if a.command == "inspect" else read_messages
    columns = {"inspect": {"columns": "seq,message_type,body"}, "stats": {"fields": [], "columns": ["seq"]}}.get(a.command, {"columns": ["seq"]})
    frames = read(spark, a.file, mode="dropmalformed", **columns)
    if a.types:
        frames = filter_types(frames, parse_types(a.types))
    if a.command == "stats":
        for r in sorted(histogram(frames).collect(), key=lambda r: (r.message_type == "TOTAL", r.message_type)):
            print(f"{r.message_type:>5} {r.n}")
    elif a.command == "inspect":
        for r in inspect(frames, a.limit).orderBy("seq").collect():
            print(r.text)
    else:
        (write_csv if a.to == "csv" else write_parquet)(frames, a.out, mode="overwrite")
    return 0


if __name__ == "__main__":
    sys.exit(main())
