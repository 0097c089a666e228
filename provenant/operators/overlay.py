"""Versioned layers: deltas, effective states, upserts, immutable writes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenant.operators.graphs import ancestors


def delta(old: DataFrame, new: DataFrame, key: list[str], compared: list[str]) -> DataFrame:
    """``key, change`` (added, removed, changed) between two versions; null-safe."""
    o = old.select(*key, F.struct(*compared).alias("_o"))
    n = new.select(*key, F.struct(*compared).alias("_n"))
    both = o.join(n, key, "full_outer")
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(~F.col("_o").eqNullSafe(F.col("_n")), "changed")
    return both.select(*key, change.alias("change")).where("change IS NOT NULL")


def set_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Whole rows added and removed; equal rows count once."""
    # one pass over both sides: a bit says where a row was seen, so repeats need no pass of their own
    g = old.withColumn("_t", F.lit(1)).unionByName(new.withColumn("_t", F.lit(2))).groupBy(*old.columns).agg(F.bit_or("_t").alias("_t"))
    return g.where("_t <> 3").select(*old.columns, F.when(F.col("_t") == 2, "added").otherwise("removed").alias("change"))


def effective(base: DataFrame, overlay: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Base rows, replaced by the overlay's active rows, removed by its tombstones (state: active or deleted)."""
    b = base.select(key, F.struct(*columns).alias("_b"))
    o = overlay.select(key, F.col("state").alias("_s"), F.struct(*columns).alias("_o"))
    both = b.join(o, key, "full_outer").where("_s IS NULL OR _s <> 'deleted'")
    return both.select(key, F.when(F.col("_s") == "active", F.col("_o")).otherwise(F.col("_b")).alias("_r")).select(key, "_r.*")


def effective_chain(layers: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``layers(key, depth, state, ...)``, depth rising from the root: the deepest row of each key counts; a tombstone there removes it."""
    last = layers.groupBy(key).agg(F.max_by(F.struct("state", *columns), "depth").alias("_r"))
    return last.where("_r.state <> 'deleted'").select(key, *[F.col(f"_r.{c}").alias(c) for c in columns])


def layer_depths(parents: DataFrame, leaf: str) -> DataFrame:
    """``parents(snapshot_id, parent_id)`` -> ``snapshot_id, depth`` of the leaf's chain, 0 at the root. A cycle raises.

    The chain is found by doubled pointers, in as many rounds as its length has binary digits.
    """
    leaves = parents.sparkSession.createDataFrame([(leaf,)], "revision string")
    chain = ancestors(parents.select(F.col("snapshot_id").alias("revision"), F.col("parent_id").alias("parent")), leaves)
    deepest = chain.agg(F.max("distance")).scalar()
    return chain.select(F.col("ancestor").alias("snapshot_id"), (deepest - F.col("distance")).cast("int").alias("depth"))


def sparse_layer(base: DataFrame, wanted: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The layer that turns ``base`` into ``wanted``: differing rows as active, missing ones as deleted."""
    b = base.select(key, F.struct(*columns).alias("_b"))
    w = wanted.select(key, F.struct(*columns).alias("_w"))
    both = b.join(w, key, "full_outer").where(~F.col("_b").eqNullSafe(F.col("_w")))
    return both.select(key, F.when(F.col("_w").isNull(), "deleted").otherwise("active").alias("state"), "_w.*")


def insert_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows and those new ones whose key is not there; of new rows with one key an arbitrary equal one."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti"))


def replace_rows(old: DataFrame, writes: DataFrame, key: list[str], order: str, place: str | None = None) -> DataFrame:
    """Whole rows replaced; of several writes to a key the last in ``order`` counts, of equal ones the first in ``place``, if given."""
    ties = [] if place is None else [place]
    w = Window.partitionBy(*key).orderBy(F.desc(order), *ties)
    last = writes.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", order, *ties)
    return old.join(last.select(*key), key, "left_anti").unionByName(last)


def update_columns(old: DataFrame, new: DataFrame, key: list[str], updated: list[str]) -> DataFrame:
    """Insert, or overwrite only the listed columns of the row that is there."""
    rest = [c for c in old.columns if c not in key]
    o = old.select(*key, F.struct(*rest).alias("_o"))
    n = new.select(*key, F.struct(*rest).alias("_n"))
    both = o.join(n, key, "full_outer")

    def pick(c: str) -> Column:
        fresh = F.col(f"_n.{c}")
        here = F.col(f"_o.{c}")
        if c in updated:
            return F.when(F.col("_n").isNotNull(), fresh).otherwise(here).alias(c)
        return F.when(F.col("_o").isNotNull(), here).otherwise(fresh).alias(c)

    return both.select(*key, *[pick(c) for c in rest])


def version_bumps(writes: DataFrame, key: str, order: list[str], compared: list[str]) -> DataFrame:
    """A stream of writes per key: adds ``version``, which starts at 1 and rises where a compared column changed."""
    w = Window.partitionBy(key).orderBy(*order)
    now = F.struct(*compared)
    before = F.lag(now).over(w)
    step = (before.isNotNull() & ~before.eqNullSafe(now)).cast("long")
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return writes.withColumn("_step", step).withColumn("version", F.sum("_step").over(running) + 1).drop("_step")


def upsert_version(old: DataFrame, new: DataFrame, key: list[str], compared: list[str]) -> DataFrame:
    """One batch: rows written or overwritten, ``version`` + 1 where a compared column changed, 1 for new rows."""
    rest = [c for c in old.columns if c not in (*key, "version")]
    both = old.select(*key, "version", F.struct(*rest).alias("_o")).join(new.select(*key, F.struct(*rest).alias("_n")), key, "full_outer")
    same = reduce(lambda a, b: a & b, [F.col(f"_o.{c}").eqNullSafe(F.col(f"_n.{c}")) for c in compared])
    version = F.when(F.col("_o").isNull(), 1).when(F.col("_n").isNull() | same, F.col("version")).otherwise(F.col("version") + 1)
    return both.select(*key, version.cast("long").alias("version"), F.coalesce("_n", "_o").alias("_r")).select(*key, "version", "_r.*")


def conflicts(stored: DataFrame, incoming: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Rows that make an immutable rewrite unequal: other values, or keys on one side only. Empty: the write may be repeated."""
    return delta(stored, incoming, key, columns)


def write_once(stored: DataFrame, incoming: DataFrame, parent: str, key: list[str], columns: list[str]) -> DataFrame:
    """Append parents that are new; parents that are there must come with equal rows, else an error."""
    there = stored.select(parent).distinct()
    again = incoming.join(there, parent, "left_semi")
    against = stored.join(incoming.select(parent).distinct(), parent, "left_semi")
    if conflicts(against, again, [parent, *key], columns).limit(1).count():
        raise ValueError(f"stored rows of a {parent} differ from what is written")
    return stored.unionByName(incoming.join(there, parent, "left_anti"))


def replace_children(children: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All children of the parents that are written are replaced."""
    return children.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def delete_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), on, "left_anti")


def guarded_update(df: DataFrame, guard: Column, values: dict[str, Column]) -> DataFrame:
    """Compare and set: the values where the guard holds. Adds ``updated``."""
    ok = F.coalesce(guard, F.lit(False))
    return df.select(*[F.when(ok, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns], ok.alias("updated"))


def capped_union(first: DataFrame, second: DataFrame, key: str, n: int) -> DataFrame:
    """Ids of the first list, then of the second, each once at its first place, the first n: ``key, ord`` (0-based)."""
    both = first.select(key, F.lit(0).alias("_src"), "ord").unionByName(second.select(key, F.lit(1).alias("_src"), "ord"))
    once = both.groupBy(key).agg(F.min(F.struct("_src", "ord")).alias("_p")).orderBy("_p", key).limit(n)
    return once.select(key, (F.row_number().over(Window.orderBy("_p", key)) - 1).cast("long").alias("ord"))


def fill_missing(df: DataFrame, lookup: DataFrame, key: list[str], column: str) -> tuple[DataFrame, DataFrame]:
    """A repair pass: the column filled from ``lookup`` where it is null; and one row with counts (missing, filled)."""
    found = lookup.select(*key, F.col(column).alias("_v")).dropDuplicates(key)
    both = df.join(found, key, "left")
    missing = F.col(column).isNull()
    done = both.withColumn(column, F.coalesce(column, "_v")).select(*df.columns)
    return done, both.agg(F.count_if(missing).alias("missing"), F.count_if(missing & F.col("_v").isNotNull()).alias("filled"))


def add_missing_columns(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Columns that an older table lacks, with their defaults."""
    return df.withColumns({c: v for c, v in defaults.items() if c not in df.columns})
