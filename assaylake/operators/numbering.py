"""Row numbers within groups of any size, over many tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.sources.tables import stash


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "number", ranges: int | None = None) -> DataFrame:
    """The rows with their number, from 1, in each group when sorted by ``order``, nulls first.

    Rows are split into ranges of (group, order) and sorted in each; a row's place in its range, less the place at which its group begins
    there, plus what earlier ranges hold of the group, is its number. So no task holds a group: a group of all rows is spread over all
    ranges. Rows that are equal in group and order lie in one range and are numbered in any order; an order that ends with a unique
    column leaves no such choice, and then a repeated run gives the same numbers.

    :param ranges: as many as there are shuffle partitions, if not given.
    """
    spark = rows.sparkSession
    taken = {c.lower() for c in rows.columns}
    part, place, first, before, n = (next(f"{'_' * k}{stem}" for k in range(1, 99) if f"{'_' * k}{stem}" not in taken) for stem in ("part", "place", "first", "before", "n"))
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    split = rows.repartitionByRange(ranges, *by, *order).sortWithinPartitions(*by, *order)
    # the id counts rows of a partition in its lower 33 bits
    placed = stash(split.withColumns({part: F.spark_partition_id(), place: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    pieces = placed.groupBy(*by, part).agg(F.min(place).alias(first), F.count("*").alias(n))
    earlier = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a group's ranges, not its rows
    keys = [f"_key{i}{part}" for i in range(len(by))]
    offsets = pieces.withColumn(before, F.coalesce(F.sum(n).over(earlier), F.lit(0))).select(*(F.col(b).alias(k) for b, k in zip(by, keys, strict=True)), F.col(part).alias(f"_{part}"), first, before)
    same: list[Column] = [placed[part] == offsets[f"_{part}"], *(placed[b].eqNullSafe(offsets[k]) for b, k in zip(by, keys, strict=True))]
    found = placed.join(offsets, reduce(lambda a, b: a & b, same))
    return found.select(*(placed[c] for c in rows.columns if c.lower() != name.lower()), (F.col(place) - F.col(first) + F.col(before) + 1).alias(name))
