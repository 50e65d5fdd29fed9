"""Places in a total order of any number of rows, without a window over all of them.

Rows are dealt into ranges of the order and sorted there.  A row's place is the number of rows in the ranges before its
own and its index in its range, so that a task sees one range and the driver one count a range.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ``monotonically_increasing_id`` holds the range above these bits and the row's index in it below.
INDEX_BITS = 33


def in_ranges(rows: DataFrame, order: list[Column], ranges: int | None = None) -> DataFrame:
    """``rows`` dealt into ranges of ``order``, sorted, with ``_at``: the range and the index in it. To be written once."""
    ranges = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())


def which_range() -> Column:
    return F.shiftright("_at", INDEX_BITS)


def rows_before(counts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(range, rows in earlier ranges) of (range, rows)."""
    counts = sorted(counts)
    return [(which, before) for (which, _), before in zip(counts, accumulate((n for _, n in counts), initial=0))]


def with_places(rows: DataFrame, order: list[Column], keep: Callable[[DataFrame], DataFrame], ranges: int | None = None, place: str = "place") -> DataFrame:
    """``rows`` with ``place`` (long, from 0) in ``order``; ``keep`` writes a DataFrame once and reads it back.

    The order should tell rows apart: only rows that are equal in it have to meet in one range, and their places are as
    Spark leaves them.  ``ranges`` is the number of ranges, by default that of the shuffle partitions.
    """
    kept = keep(in_ranges(rows, order, ranges))
    counts = kept.groupBy(which_range().alias("part")).agg(F.count("*").alias("n")).collect()
    # a row for each range
    known = rows.sparkSession.createDataFrame(rows_before([(r.part, r.n) for r in counts]), "_part long, _before long")
    index = F.col("_at").bitwiseAND(F.lit((1 << INDEX_BITS) - 1))
    return kept.withColumn("_part", which_range()).join(F.broadcast(known), "_part").withColumn(place, F.col("_before") + index).drop("_at", "_part", "_before")
