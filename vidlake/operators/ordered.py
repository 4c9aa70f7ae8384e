"""Order along a key whose rows may be most of a table: ranges in place of one window a key.

Rows are dealt by ranges of the key and the order, so a key with a third of all rows is
many tasks. Ranges are written with each row's place in its range; what crosses from a
range to the next is one row for each range and key that it holds.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from vidlake.operators.storage import written

#: Helper columns: the range, the place in it.
RANGE, PLACE = "_range", "_place"


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    return reduce(Column.__and__, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)])


def in_ranges(rows: DataFrame, keys: Sequence[str], order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """rows, written sorted by keys and order, with their range (numbered in that order) and their place in it."""
    n = ranges or max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    columns = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    sorted_rows = rows.repartitionByRange(n, *columns).sortWithinPartitions(*columns)
    # the low 33 bits count the rows of a task
    counted = sorted_rows.withColumn(RANGE, F.spark_partition_id()).withColumn(PLACE, F.monotonically_increasing_id() % (1 << 33))
    return written(counted, "ranges")


def busy_frames(targets: DataFrame) -> DataFrame:
    """(channel_index, frame_index): the distinct frames that targets are on, but those of no number.

    A channel's frames are gathered as words of 64, a bit a frame, so a task that holds
    whole tracks hands on some words a track and not each of its frames.
    """
    frame = F.col("frame_index")
    words = targets.where(frame.isNotNull()).groupBy("channel_index", F.shiftright(frame, 6).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(frame_index & 63 as int)))").alias("_bits"))
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.call_function("getbit", "_bits", k) == 1)
    spread = words.select("channel_index", "_word", F.explode(places).alias("_k"))
    return spread.select("channel_index", (F.col("_word") * 64 + F.col("_k")).cast(targets.schema["frame_index"].dataType).alias("frame_index"))


def _ends(ranged: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> tuple[DataFrame, list[str]]:
    """A row for each range and key, with renamed keys; a range holds few keys, or a key few ranges."""
    names = [f"_k{n}" for n in range(len(keys))]
    ends = ranged.groupBy(*keys, RANGE).agg(*[v.alias(c) for c, v in values.items()])
    return ends.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(RANGE).alias("_r"), *values), names


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, ranges: int | None = None) -> DataFrame:
    """rows with `name`: their number within keys by order, from 0 up.

    A row's number is its place in its range, less the key's first place there, and the
    rows that the key has in earlier ranges.
    """
    ranged = in_ranges(rows, keys, order, ranges)
    ends, names = _ends(ranged, keys, {"_first": F.min(PLACE), "_n": F.count(F.lit(1))})
    before = F.sum("_n").over(Window.partitionBy(*names).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    starts = ends.select(*names, "_r", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    both = ranged.join(starts.hint("merge"), _same([*keys, RANGE], [*names, "_r"]))
    return both.select(*rows.columns, (F.col(PLACE) + F.col("_shift")).alias(name))


def previous(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, ranges: int | None = None) -> DataFrame:
    """rows with `name`: value at the row before within keys by order, null at a key's first row.

    Within a range the row before is its neighbour; a range's first row of a key takes
    the last row of the range before that holds the key.
    """
    ranged = in_ranges(rows.withColumn("_value", value), keys, order, ranges)
    last = F.max_by(F.struct(F.col("_value").alias("v")), PLACE)
    ends, names = _ends(ranged, keys, {"_first": F.min(PLACE), "_last": last})
    carried = F.lag("_last").over(Window.partitionBy(*names).orderBy("_r"))
    starts = ends.select(*names, "_r", "_first", carried.alias("_carried"))
    here = F.lag("_value").over(Window.partitionBy(*keys, RANGE).orderBy(PLACE))
    both = ranged.withColumn("_here", here).join(starts.hint("merge"), _same([*keys, RANGE], [*names, "_r"]))
    return both.select(*rows.columns, F.when(F.col(PLACE) == F.col("_first"), F.col("_carried.v")).otherwise(F.col("_here")).alias(name))
