"""Order-dependent operators that never put the whole table into one window.

Rows are range-partitioned by the order columns and written once, so that every row knows its range
and its position in it for good. Each range is handled on its own, and a carry table with one row per
range (or per group that crosses a range border) connects them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.session import materialise, materialise_bucketed

RANGE, POSITION = "_range", "_position"
_IN_PARTITION = (1 << 33) - 1  # low bits of monotonically_increasing_id


def ranged(df: DataFrame, order_by: Sequence[str], ranges: int | None = None, bucketed: bool = False) -> DataFrame:
    """``df`` plus its range number and its position in the range, both stored, on demand in hash buckets of the range.

    ``order_by`` has to be a total order (end it with a unique key): it makes the result repeatable and
    lets the range sampler split a value that many rows share. Without ``ranges`` their number is that of
    the shuffle partitions, less what adaptive execution merges; it merges neighbours, which keeps order.
    """
    placed = (
        (df.repartitionByRange(ranges, *order_by) if ranges else df.repartitionByRange(*order_by))
        .sortWithinPartitions(*order_by)
        .withColumn(RANGE, F.spark_partition_id())
        .withColumn(POSITION, F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION)))
    )
    if bucketed:
        # Each range is one task's and goes to one file; twice as many buckets as ranges keep most ranges apart.
        return materialise_bucketed(placed, "ranged", RANGE, 2 * (ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return materialise(placed, "ranged")


def with_row_index(
    df: DataFrame, order_by: Sequence[str], name: str = "row_index", ranges: int | None = None
) -> DataFrame:
    """Dense 0-based index in ``order_by`` order; without one, in the order in which the rows are stored."""
    if order_by:
        placed = ranged(df, order_by, ranges)
    else:
        spots = {RANGE: F.spark_partition_id(), POSITION: F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION))}
        placed = materialise(df.withColumns(spots), "placed")
    sizes = placed.groupBy(RANGE).agg(F.count("*").alias("_rows"))
    before = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    # At most one row per range, hence the broadcast and the unpartitioned window.
    offsets = sizes.select(RANGE, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    indexed = placed.join(F.broadcast(offsets), RANGE)
    return indexed.withColumn(name, F.col("_offset") + F.col(POSITION)).drop(RANGE, POSITION, "_offset")


def fill_directional(
    df: DataFrame,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    columns: Sequence[str] | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Forward fill, then backward fill, in ``order_by`` order (within ``partition_by`` if given).

    The table is shuffled once, into its ranges; the windows below read them as they are stored.
    """
    groups = list(partition_by)
    columns = list(columns) if columns else [c for c in df.columns if c not in {*order_by, *groups}]
    placed = ranged(df, [*groups, *order_by], ranges, bucketed=True)
    segment = [*groups, RANGE]

    per_segment = []
    for i, c in enumerate(columns):
        known = F.when(F.col(c).isNotNull(), F.col(POSITION))
        per_segment += [F.min_by(c, known).alias(f"_first{i}"), F.max_by(c, known).alias(f"_last{i}")]
    edges = placed.groupBy(*segment).agg(*per_segment)

    # Only groups that cross a range border need a carry. A border is crossed by one group at most, so
    # the carry table has fewer than two rows per range.
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    earlier = whole.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    later = whole.orderBy(F.col(RANGE).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carries = []
    for i in range(len(columns)):
        carries += [
            F.last(f"_last{i}", ignorenulls=True).over(earlier).alias(f"_before{i}"),
            F.last(f"_first{i}", ignorenulls=True).over(later).alias(f"_after{i}"),
        ]
    # Without groups every range has its row, which also tells its first known values.
    crossing = edges.withColumn("_segments", F.count("*").over(whole)).filter("_segments > 1") if groups else edges
    firsts = [] if groups else [f"_first{i}" for i in range(len(columns))]
    carry = crossing.select(*[F.col(g).alias(f"_g{j}") for j, g in enumerate(segment)], *carries, *firsts)

    same = F.lit(True)
    for j, g in enumerate(segment):
        same &= placed[g].eqNullSafe(carry[f"_g{j}"])
    joined = placed.join(F.broadcast(carry), same, "left")

    in_segment = Window.partitionBy(*segment).orderBy(POSITION)
    so_far = in_segment.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_rows = in_segment.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = {
        c: F.coalesce(
            F.last(c, ignorenulls=True).over(so_far),
            F.col(f"_before{i}"),
            F.first(c, ignorenulls=True).over(all_rows) if groups else F.col(f"_first{i}"),
            F.col(f"_after{i}"),
        )
        for i, c in enumerate(columns)
    }
    return joined.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])
