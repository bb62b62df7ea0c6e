"""Ranges of whole numbers: points in ranges by equal keys, and unions of ranges, whatever their lengths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A block of the lowest level has 2 ** BITS numbers, one of each further level 2 ** BITS blocks of the level below.
BITS, LEVELS = 6, 5


def _bounds(start: Column, end: Column) -> tuple[Callable[[int], Column], Callable[[int], Column]]:
    """The blocks of a level that lie in the range as a whole: from the first to before the last."""
    low, high = F.shiftright(start.cast("long"), BITS), F.shiftright(end.cast("long"), BITS) + 1
    return lambda level: -F.shiftright(-low, BITS * level), lambda level: F.shiftright(high, BITS * level)


def top_level(start: Column, end: Column) -> Column:
    """The highest level in the range's ``cover``, told without making it; null if it is empty."""
    first, last = _bounds(start, end)
    return F.when(start <= end, F.coalesce(*[F.when(first(level) < last(level), level) for level in range(LEVELS, -1, -1)]))


def cover(start: Column, end: Column) -> Column:
    """Blocks (level, block) that the range from ``start`` to ``end``, ints and both included, lies in; none if it is empty or null.

    They are the largest that make up all blocks of the lowest level that the range touches: at most 63 of each level at its start, 63 at its
    end, and what is between on the highest level. No two hold the same number; those at the ends hold numbers outside the range, too.
    """
    first, last = _bounds(start, end)
    empty = F.array().cast("array<struct<level:int,block:bigint>>")

    def blocks(level: int, a: Column, b: Column) -> Column:
        return F.when(a < b, F.transform(F.sequence(a, F.greatest(a, b - 1)), lambda x: F.struct(F.lit(level).alias("level"), x.alias("block")))).otherwise(empty)

    parts = [blocks(LEVELS, first(LEVELS), last(LEVELS))]
    for level in range(LEVELS):
        inner = first(level + 1) < last(level + 1)
        up, down = F.shiftleft(first(level + 1), BITS), F.shiftleft(last(level + 1), BITS)
        parts += [blocks(level, first(level), F.when(inner, up).otherwise(last(level))), F.when(inner, blocks(level, down, last(level))).otherwise(empty)]
    return F.when(start <= end, F.concat(*parts)).otherwise(empty)


def in_ranges(points: DataFrame, ranges: DataFrame, by: str, point: str, start: str, end: str, key: list[str]) -> DataFrame:
    """Rows of ``points`` with each row of ``ranges`` whose range they lie in, ``by`` being equal; the ranges' columns come last.

    Points and ranges meet in blocks of numbers, so that a key with very many of both costs no product of them and has many tasks: a range is in one
    or two blocks, or if it is long in some of each level. If any range is, points look for larger blocks, too; then only ``key``, which identifies
    a point, takes part, and other columns are brought to the pairs that were found. Neither side is broadcast.
    """
    top = ranges.agg(F.max(top_level(F.col(start), F.col(end)))).first()[0] or 0
    blocks = ranges.select("*", F.inline(cover(F.col(start), F.col(end))))
    others = [c for c in points.columns if c not in {by, point, *key}]
    slim = points if not top else points.select(*dict.fromkeys([by, *key, point]))
    level = lambda k: F.struct(F.lit(k).alias("level"), F.shiftright(F.col(point).cast("long"), BITS * (k + 1)).alias("block"))
    at = slim.select("*", F.inline(F.array(*[level(k) for k in range(top + 1)])))
    same = [F.col(f"p.{c}") == F.col(f"r.{c}") for c in (by, "level", "block")]
    on = same[0] & same[1] & same[2] & F.col(f"p.{point}").between(F.col(f"r.{start}"), F.col(f"r.{end}"))
    # Blocks are many times as large as what Spark takes their size from, the files that ranges are read from: left to itself it sends them whole through the driver.
    found = at.alias("p").join(blocks.hint("merge").alias("r"), on).select(*[f"p.{c}" for c in slim.columns], *[f"r.{c}" for c in ranges.columns if c != by])
    if not top or not others:
        return found
    return found.join(points.select(*dict.fromkeys([by, *key, *others])), list(dict.fromkeys([by, *key])))


def union(ranges: DataFrame, by: str, start: str, end: str) -> DataFrame:
    """(``by``, ``start``, ``end``): the ranges put together where they meet or overlap; empty ones are left out."""
    order = Window.partitionBy(by).orderBy(start, end)
    reached = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = ranges.where(F.col(start) <= F.col(end)).select(by, F.col(start).cast("long").alias(start), F.col(end).cast("long").alias(end))
    new = F.when(reached.isNull() | (F.col(start) > reached + 1), 1).otherwise(0)
    numbered = rows.withColumn("_new", new).withColumn("_n", F.sum("_new").over(order))
    return numbered.groupBy(by, "_n").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_n")
