"""Sinks: part files in order, one ordered file, or standard output."""

from __future__ import annotations

import sys
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = ("file_no", "line_no", "sent_id")


def write_parts(out: DataFrame, path: str, order: tuple[str, ...] = ORDER) -> None:
    """Text files whose names sort as the lines do; the way to write much."""
    by = [c for c in order if c in out.columns]
    ended = F.when(F.col("out").endswith("\n"), F.substring("out", 1, F.length("out") - 1)).otherwise(F.col("out"))
    out.repartitionByRange(*by).sortWithinPartitions(*by).select(ended.alias("out")).write.text(path)


def write_one(out: DataFrame, to: TextIO | None = None, json: bool = False, order: tuple[str, ...] = ORDER) -> int:
    """Everything in order to one stream, a partition at a time; JSON becomes one list. The number of items written."""
    to = to or sys.stdout
    by = [c for c in order if c in out.columns]
    n = 0
    if json:
        to.write("[")
    for row in out.orderBy(*by).select("out").toLocalIterator(prefetchPartitions=True):
        if json:
            to.write(",\n" if n else "\n")
        to.write(row.out)
        n += 1
    if json:
        to.write("\n]\n")
    return n


def merge_meta(left: dict, right: dict) -> dict:
    """Fields of both; the left one's count where both have one."""
    return {**right, **left}
