"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import drop_path, stored


def _mark(edges: DataFrame) -> tuple:
    """Count and checksum of a set of edges: equal marks mean that a round changed nothing."""
    h = F.xxhash64("u", "v")
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.shiftright(h, 32)), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF)))
    ).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` with any comparable node type -> ``(node, component)``, component = smallest node.

    Only nodes with an edge to another node come back; loops, repeats, both directions and nulls are
    allowed (an edge with a null end is ignored). Steps go on until one changes nothing. Every table is written to the shared folder, so the
    lineage stays short and a lost executor is harmless. A node with very many edges is reduced by a
    map-side minimum; the minima are a table of their own, so both sides of the join back are plain shuffles, which
    skew handling can split. Nothing is collected but a checksum.
    """
    spark = edges.sparkSession
    clean = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    now, path = stored(clean.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, least_path = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "least")
        large, large_path = stored(
            both.join(least, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large"
        )
        low, low_path = stored(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m"), "low")
        small = (
            large.join(low, F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()
        after, after_path = stored(small, "edges")
        for done in (path, least_path, large_path, low_path):
            drop_path(spark, done)
        now, path, before = after, after_path, mark
        mark = _mark(now)
        if mark == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def merge_labels(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Merge the classes of the pairs of rows, within one task; ``label`` has each row's lowest known row and is fully resolved on return."""
    while len(left):
        a, b = label[left], label[right]
        differ = a != b
        if not differ.any():
            return
        left, right, a, b = left[differ], right[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]
