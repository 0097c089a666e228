"""Snapshots over a base: changed symbols, the packet for a review, and how a new commit is prepared."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.operators.aggregates import reuse_percentage
from provenant.operators.graphs import ancestors, reverse_reach
from provenant.operators.joins import overlay_lookup
from provenant.operators.overlay import capped_union, delta


def changed_symbols(base: DataFrame, current: DataFrame, changed_paths: DataFrame) -> DataFrame:
    """``symbols(symbol_id, path, content_hash)`` of two versions -> ``symbol_id, change`` within the changed paths."""
    paths = changed_paths.select("path").distinct()
    return delta(base.join(paths, "path", "left_semi"), current.join(paths, "path", "left_semi"), ["symbol_id"], ["content_hash"])


def packet(changed: DataFrame, affected: DataFrame, overlay: DataFrame, base: DataFrame, columns: list[str], most: int = 24) -> DataFrame:
    """The slices of the changed symbols, then the affected ones, the first so many, the overlay's row before the base's."""
    ids = capped_union(changed, affected, "symbol_id", most)
    return overlay_lookup(ids, overlay, base, "symbol_id", columns)


class Prepared(NamedTuple):
    reused: bool
    changed_paths: DataFrame
    changed_symbols: DataFrame | None
    affected: DataFrame | None
    reused_percent: int | None


def prepare(prior_files: DataFrame | None, prior_symbols: DataFrame | None, files: DataFrame, symbols: DataFrame, edges: DataFrame | None, exact: bool, hops: int = 12) -> Prepared:
    """An exact hit is reused; without a prior one all paths are new; unchanged files reuse it; else changed symbols and what reaches them."""
    none = files.select("path").limit(0)
    if exact:
        return Prepared(True, none, None, None, None)
    if prior_files is None:
        return Prepared(False, files.select("path"), None, None, None)
    paths = delta(prior_files, files, ["path"], ["content_hash"]).select("path")
    if paths.limit(1).count() == 0:
        return Prepared(True, none, None, None, None)
    moved = changed_symbols(prior_symbols, symbols, paths)
    affected = reverse_reach(edges, moved.select(F.col("symbol_id").alias("node")), hops)
    n, base = moved.count(), prior_symbols.count()
    percent = files.sparkSession.range(1).select(reuse_percentage(F.lit(base), F.lit(n)).alias("v")).first()["v"]
    return Prepared(False, paths, moved, affected, int(percent))


def tree_at(wanted: DataFrame, parents: DataFrame, changes: DataFrame) -> DataFrame:
    """``wanted(revision)``, ``changes(revision, path, content)`` (null content: deleted) -> the files of each wanted revision: ``revision, path, content, since``.

    A path has the version of the nearest revision at or above that changed it; of several changes in one revision the greatest content counts.
    """
    line = ancestors(parents, wanted)
    c = changes.groupBy(F.col("revision").alias("_r"), "path").agg(F.max("content").alias("content"))
    found = line.join(c, F.col("ancestor") == F.col("_r")).groupBy("revision", "path").agg(F.min_by(F.struct("content", "ancestor"), "distance").alias("_v"))
    return found.where("_v.content IS NOT NULL").select("revision", "path", F.col("_v.content").alias("content"), F.col("_v.ancestor").alias("since"))
