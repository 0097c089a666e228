"""Mixing sources to target weights along a time-varying curriculum (DataFrame functions only).

Each source has a weight and a schedule: how strongly it is wanted at training time t in [0, 1].
Targets share all words by weight and stop at ``max_repeats`` times the source. A source is laid out
``repeats`` times in a seeded order; the part of it that meets the target is taken. The schedule is
integrated; inverting the integral at a row's cumulative words gives its training position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenant.llm.common import WORD, drop_path, running_sum, stored, uniform_buckets

#: (time, relative demand) knots of the default schedule: flat for weight 1, rising for 2, falling for 3.
SCHEDULES: dict[int, Sequence[tuple[float, float]]] = {
    1: ((0.0, 1.0), (1.0, 1.0)),
    2: ((0.0, 0.5), (1.0, 1.5)),
    3: ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
}


def n_words(text: str = "text") -> Column:
    """Number of words of the text; null has none."""
    return F.coalesce(F.expr(f"regexp_count({text}, r'{WORD}')"), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cycle: int = 3, max_repeats: float = 3.0) -> DataFrame:
    """``sizes(source, source_size)`` -> adds ``weight`` and ``target``.

    Sources by code point, null last, weigh 1, 2, .., ``cycle``, repeating. All words are shared by weight;
    a target above ``max_repeats`` times its source stops there and the excess is shared again among
    the others, until none is above. Sorted by cap / weight, the sources that stop are the first ones: with prefix sums of caps
    and weights, the level of the others is that of the first source which does not stop when all before it do.
    """
    ranked = _prefix_sums(sizes.withColumn("_one", F.lit(1)), [F.col("source").isNull(), F.col("source")], {"_rank": F.col("_one")}, "ranks")
    weighed = ranked.withColumn("weight", (F.pmod(F.col("_rank"), F.lit(cycle)) + 1).cast("double")).drop("_one", "_rank")
    capped = weighed.withColumn("_cap", F.lit(float(max_repeats)) * F.col("source_size"))
    ratio = F.col("_cap") / F.col("weight")
    laid = _prefix_sums(capped, [ratio, F.col("source").isNull(), F.col("source")], {"_caps": F.col("_cap"), "_weights": F.col("weight")}, "caps")
    total = laid.agg(F.sum("source_size").cast("double").alias("all"), F.sum("weight").alias("w")).first()
    level = (F.lit(total["all"]) - F.col("_caps")) / (F.lit(total["w"]) - F.col("_weights"))
    first = laid.where(level <= ratio).agg(F.min_by(level, F.struct(ratio, F.col("source").isNull(), "source"))).first()[0]
    share = F.col("_cap") if first is None else F.least(F.lit(first) * F.col("weight"), F.col("_cap"))
    return laid.withColumn("target", share.cast("double")).drop("_cap", "_caps", "_weights")


def _prefix_sums(table: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """Adds to each row the sums over the rows before it in the order, without gathering the rows in one task.

    Rows are dealt by range into partitions, summed inside them, and shifted by the totals of the
    partitions before; the table is stored first, so both readings see the same ranges.
    """
    placed = table.withColumns({f"_o{i}": c for i, c in enumerate(order)})
    by = [f"_o{i}" for i in range(len(order))]
    dealt, path = stored(placed.repartitionByRange(8, *by).withColumn("_p", F.spark_partition_id()), name)
    inside = Window.partitionBy("_p").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(F.col("_p").alias("_q")).agg(*[F.sum(c).alias(f"_t{k}") for k, c in sums.items()])
    starts = totals.select("_q", *[F.coalesce(F.sum(f"_t{k}").over(before), F.lit(0)).alias(f"_s{k}") for k in sums])
    both = dealt.join(starts, F.col("_p") == F.col("_q"))
    summed = both.withColumns({k: F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_s{k}") for k, c in sums.items()})
    out, _ = stored(summed.drop("_p", "_q", *by, *[f"_s{k}" for k in sums]), name)
    drop_path(table.sparkSession, path)
    return out


def _inverse_schedule(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time by which the share of the integral of a piecewise linear schedule is used up."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    total, used, out = sum(areas), 0.0, None
    for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas):
        left = share * F.lit(total) - F.lit(used)
        slope = (w1 - w0) / (t1 - t0)
        if abs(slope) < 1e-12:
            t = F.lit(t0) + left / F.lit(w0 or 1.0)
        else:
            root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * left, F.lit(0.0)))
            t = F.lit(t0) + (root - F.lit(w0)) / F.lit(slope)
        used += area
        t = F.least(F.lit(float(t1)), F.greatest(F.lit(float(t0)), t))
        out = F.when(share * F.lit(total) <= F.lit(used), t) if out is None else out.when(share * F.lit(total) <= F.lit(used), t)
    return out.otherwise(F.lit(float(knots[-1][0])))


def mix(
    docs: DataFrame,
    cycle: int = 3,
    max_repeats: float = 3.0,
    schedules: dict[int, Sequence[tuple[float, float]]] | None = None,
    seed: int = 7,
) -> DataFrame:
    """``docs(doc_id, source, size)`` -> adds ``source_size, weight, target, taken, position, positions``.

    ``taken``: the words of the document that the mix uses, repeats counted. A source's rows are laid
    end to end in a seeded order; the target takes whole passes and the first part of one more, so a
    source's taken words meet its target to the word and at most one document is cut.
    ``positions``: training time in [0, 1] of each use of the document, the one cut short included; ``position``: of the first
    (documents that take nothing have no positions, and in ``position`` the place they lie at).
    Null sources form one source, last in order; empty documents take nothing; repeated rows are rows of
    their own; ``size`` must not be null. An empty table gives an empty table. Other columns stay, whatever their names; those named like
    one that is added are replaced.
    A source with most of the rows is spread over buckets of a hash for its running sum.
    """
    kinds = schedules or SCHEDULES
    added = ["source_size", "weight", "target", "taken", "position", "positions"]
    kept = [c for c in docs.columns if c not in added]
    slim = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), "doc_id", "source", "size")
    sizes = slim.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    targets = source_targets(sizes, cycle, max_repeats)
    most = targets.agg(F.max("_rows")).first()[0] or 0
    targets = targets.drop("_rows").withColumnRenamed("source", "_source")
    laid = running_sum(slim, "source", ["doc_id", "size"], "size", "_before", uniform_buckets(most), seed)
    with_target = laid.join(targets, F.col("source").eqNullSafe(F.col("_source")))
    goal = F.round(F.col("target")).cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long")
    rest = goal - whole * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before")))

    def at(use: Column) -> Column:
        """The training time of a use, counted from 0: passes of a source follow each other."""
        share = F.when(goal > 0, F.least(F.lit(1.0), (use * F.col("source_size") + F.col("_before")) / goal)).otherwise(0.0).cast("double")
        out = None
        for weight, knots in sorted(kinds.items()):
            here, time = F.col("weight") == float(weight), _inverse_schedule(share, knots)
            out = F.when(here, time) if out is None else out.when(here, time)
        return out.otherwise(share)

    uses = F.ceil(F.col("taken") / F.col("size")).cast("long")
    each = F.when(F.col("taken") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), uses - 1)), at))
    done = (
        with_target.withColumn("taken", (F.col("size") * whole + part).cast("long"))
        .withColumn("position", at(F.lit(0)))
        .withColumn("positions", F.coalesce(each, F.array().cast("array<double>")))
    )
    return done.select(*[F.col("row").getField(c).alias(c) for c in kept], *added)


def schedule(mixed: DataFrame) -> DataFrame:
    """Range-sort by training position; documents that take nothing come last."""
    by = [F.col("taken") <= 0, F.col("position"), F.col("doc_id")]
    return mixed.repartitionByRange(*by).sortWithinPartitions(*by)
