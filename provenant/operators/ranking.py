"""Samples, pages, budgets and ranked search."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def balanced_sample(df: DataFrame, area: str, order: list[str], limit: int) -> DataFrame:
    """At most ``limit`` rows: one of each area per pass, areas in order. Adds ``truncated``: the area has rows that were left out.

    The rank inside an area needs no more than its first ``limit`` rows, which a top-k keeps small before the global pick.
    """
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(area).orderBy(*order))).where(F.col("_rn") <= limit)
    chosen = ranked.orderBy("_rn", area).limit(limit)
    kept = chosen.groupBy(F.col(area).alias("_a")).agg(F.count(F.lit(1)).alias("_kept"))
    sizes = df.groupBy(F.col(area).alias("_b")).agg(F.count(F.lit(1)).alias("_all"))
    flags = sizes.join(kept, F.col("_a") == F.col("_b")).select("_b", (F.col("_all") > F.col("_kept")).alias("truncated"))
    return chosen.join(flags, F.col(area) == F.col("_b")).drop("_rn", "_b")


def demote_past(df: DataFrame, key: str, score: str, order: list[str], budget: int, state: str, demoted: str) -> DataFrame:
    """Rank each key's rows by score, highest first; rows past the budget keep their place but get the demoted state. Adds ``rank``."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), *order)))
    return ranked.withColumn(state, F.when(F.col("rank") > budget, F.lit(demoted)).otherwise(F.col(state)))


def heaviest(df: DataFrame, key: str, weight: str, order: list[str], n: int) -> DataFrame:
    """The n heaviest rows of each key; keys with n rows or fewer are unchanged."""
    w = Window.partitionBy(key).orderBy(F.desc(weight), *order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def page(df: DataFrame, order: list[str], offset: int, size: int) -> DataFrame:
    """Rows offset + 1 to offset + size of the order, with ``total, returned, truncated``. The page is a top-k; the total is one count."""
    rows = df.orderBy(*order).limit(offset + size).offset(offset) if offset else df.orderBy(*order).limit(size)
    total = df.agg(F.count(F.lit(1)).alias("total"))
    returned = F.greatest(F.lit(0), F.least(F.lit(size), F.col("total") - offset)).cast("long")
    return rows.join(F.broadcast(total)).withColumn("returned", returned).withColumn("truncated", F.col("total") > offset + size)


def first_n(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """First n rows of each key, with ``omitted``: how many were left out."""
    w = Window.partitionBy(key)
    ranked = df.withColumn("_rn", F.row_number().over(w.orderBy(*order))).withColumn("_all", F.count(F.lit(1)).over(w))
    return ranked.where(F.col("_rn") <= n).withColumn("omitted", F.greatest(F.lit(0), F.col("_all") - n)).drop("_rn", "_all")


def newest_exploded(runs: DataFrame, key: str, at: list[str], n: int, items: str) -> DataFrame:
    """The findings of the newest n runs of each key, flattened in their order: ``key, run_rank, pos, item``."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in at])
    newest = runs.withColumn("run_rank", F.row_number().over(w)).where(F.col("run_rank") <= n)
    return newest.select(key, "run_rank", F.posexplode(items).alias("pos", "item"))


def search_terms(query: str, stop_words: list[str], least: int = 4) -> list[str]:
    """A query's words of at least ``least`` characters that are no stop words, and the whole query."""
    import re

    words = [w for w in re.findall(r"[a-z0-9_]+", query.lower()) if len(w) >= least and w not in stop_words]
    return list(dict.fromkeys([*words, query.lower().strip()]))


def ranked_search(df: DataFrame, terms: list[str], columns: list[str], order: list[Column], limit: int) -> DataFrame:
    """Rows that contain a term in any of the columns (case-insensitive; % and _ act as wildcards), by number of terms, then ``order``.

    One pass over the rows, no join: the terms are part of the expression; the result is a top-k.
    """
    def hit(term: str) -> Column:
        out = F.lit(False)
        for c in columns:
            out = out | F.coalesce(F.col(c).ilike(f"%{term}%"), F.lit(False))
        return out.cast("int")

    score = sum((hit(t) for t in terms[1:]), hit(terms[0]))
    return df.withColumn("score", score.cast("long")).where("score > 0").orderBy(F.desc("score"), *order).limit(limit)


def prefix_within(df: DataFrame, key: str, order: list[str], size: str, budget: int) -> DataFrame:
    """Rows of each key, in order, while their running size stays within the budget; the first that does not fit ends it. Adds ``used``."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)


def _filled(batches: Iterator[pa.RecordBatch], key: str, size: str, budget: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of key and place -> those that still fit, with what is used then. Of a key only that number is kept."""
    at, used = object(), 0
    for batch in batches:
        kept, totals = [], []
        for i, (k, n) in enumerate(zip(batch.column(key).to_pylist(), batch.column(size).to_pylist())):
            if k != at:
                at, used = k, 0
            if n is not None and used + n <= budget:
                used += n
                kept.append(i)
                totals.append(used)
        yield batch.take(pa.array(kept, type=pa.int64())).append_column("used", pa.array(totals, type=pa.int64()))


def fill_within(df: DataFrame, key: str, order: list[str], size: str, budget: int) -> DataFrame:
    """As prefix_within, but a row that does not fit is skipped and the next is tried."""

    kind = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "used long"])
    ordered = df.repartition(key).sortWithinPartitions(key, *[F.col(c).asc_nulls_last() for c in order])
    return ordered.mapInArrow(lambda batches: _filled(batches, key, size, budget), kind)


def truncate_within(df: DataFrame, key: str, order: list[str], text: str, budget: int) -> DataFrame:
    """As prefix_within, but the row that would pass the budget is cut to what is left; nothing after it stays."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(budget) - F.coalesce(F.sum(F.length(text)).over(w), F.lit(0))
    return df.withColumn("_left", left).where("_left > 0").withColumn(text, F.expr(f"left({text}, int(_left))")).drop("_left")
