"""Spans of any length: a tree over line numbers instead of cells.

Line numbers are cut into blocks of 1, 4, 16, ... A span is the disjoint union of at most 6 blocks of each width, and a line lies in one
block of each width: so a line and a span that holds it meet in exactly one block. A join on the block finds every pair once, without
false candidates, whether spans are one line long or open-ended; and where only the best span counts, each block keeps its best before
the join, so that any number of spans over one line cost that line one row a width.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks of one width that make one of the next: 2 ** BITS; widths reach from 1 to FARTHEST / 2 ** BITS.
BITS = 2
#: Line numbers are below this; an open-ended span ends here.
FARTHEST = 1 << 42
TOP = 42 // BITS - 1


def _shift(way: str, x: Column, by: Column) -> Column:
    return F.call_function(f"shift{way}", x, by)


def covered(spans: DataFrame, start: Column, end: Column) -> DataFrame:
    """Spans once for each block (``_lv``, ``_bl``) of the disjoint union that is start..end, inclusive; none if end < start. Bounds are clipped to 0..FARTHEST - 1."""
    first, last = F.greatest(start.cast("long"), F.lit(0).cast("long")), F.least(end.cast("long"), F.lit(FARTHEST - 1)) + 1
    bounded = spans.where(start <= end).withColumn("_a", first).withColumn("_b", last).where("_a < _b")
    widest = F.least(F.lit(TOP), F.floor(F.log2(F.col("_b") - F.col("_a")) / BITS).cast("int") + 1)
    at = bounded.withColumn("_lv", F.explode(F.sequence(F.lit(0), widest)))
    # whole blocks of this width between the bounds are _x.._y - 1; those that make a block of the next width, _u.._w - 1, go to that one
    low, high, one = F.col("_lv") * BITS, F.col("_lv") * BITS + BITS, F.lit(1).cast("long")
    runs = at.withColumn("_x", _shift("right", F.col("_a") + _shift("left", one, low) - 1, low)).withColumn("_y", _shift("right", F.col("_b"), low)).where("_x < _y")
    wider = runs.withColumn("_u", _shift("right", F.col("_a") + _shift("left", one, high) - 1, high) * (1 << BITS)).withColumn("_w", _shift("right", F.col("_b"), high) * (1 << BITS))
    none = F.array().cast("array<bigint>")
    inner = (F.col("_u") < F.col("_w")) & (F.col("_lv") < TOP)
    left = F.when(F.col("_x") < F.col("_u"), F.sequence("_x", F.col("_u") - 1)).otherwise(none)
    right = F.when(F.col("_w") < F.col("_y"), F.sequence("_w", F.col("_y") - 1)).otherwise(none)
    every = F.when(inner, F.concat(left, right)).otherwise(F.sequence("_x", F.col("_y") - 1))
    return wider.withColumn("_bl", F.explode(every)).drop("_a", "_b", "_x", "_y", "_u", "_w")


def used_levels(blocks: DataFrame) -> Column:
    """The widths that occur among blocks: an array of at most 21, as a scalar subquery."""
    return F.coalesce(blocks.agg(F.array_sort(F.collect_set("_lv"))).scalar(), F.array().cast("array<int>"))


def _looking(points: DataFrame, line: str, blocks: DataFrame) -> DataFrame:
    """Points once for each width that spans use, as ``_level`` and ``_block``."""
    at_levels = points.withColumn("_levels", used_levels(blocks)).withColumn("_level", F.explode("_levels")).drop("_levels")
    return at_levels.withColumn("_block", _shift("right", F.col(line).cast("long"), F.col("_level") * BITS))


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x) == F.col(y) for x, y in zip(left, right)])


def holding(points: DataFrame, spans: DataFrame, key: list[str], line: str, start: str, end: str) -> DataFrame:
    """Pairs of a point and a span of its key that holds it: all columns of both, each pair once. Column names must differ but for ``key``."""
    own = spans.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], *[c for c in spans.columns if c not in key])
    blocks = covered(own, F.col(start), F.col(end))
    on = _same(key, [f"_k{i}" for i in range(len(key))]) & (F.col("_level") == F.col("_lv")) & (F.col("_block") == F.col("_bl"))
    return _looking(points, line, blocks).join(blocks, on).drop("_level", "_block", "_lv", "_bl", *[f"_k{i}" for i in range(len(key))])


def best_holding(points: DataFrame, spans: DataFrame, key: list[str], line: str, best: Column) -> DataFrame:
    """``points(id, *key, line)``, ``spans(*key, _start, _end, ...)`` -> ``id, _best``: of the spans that hold a point the least ``best`` (a struct)."""
    own = spans.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], best.alias("_b0"), F.col("_start").alias("_s0"), F.col("_end").alias("_e0"))
    blocks = covered(own, F.col("_s0"), F.col("_e0"))
    names = [f"_k{i}" for i in range(len(key))]
    ahead = blocks.groupBy(*names, "_lv", "_bl").agg(F.min("_b0").alias("_b0"))
    on = _same(key, names) & (F.col("_level") == F.col("_lv")) & (F.col("_block") == F.col("_bl"))
    return _looking(points.select("id", *key, line), line, blocks).join(ahead, on).groupBy("id").agg(F.min("_b0").alias("_best"))
