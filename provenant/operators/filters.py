"""Filters and projections: scopes, wildcards, active rows, reusable results, evidence that still holds, compact context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_key(df: DataFrame, **keys) -> DataFrame:
    """Key lookup, tenant and all; the equalities reach the scan."""
    return df.where(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in keys.items()]))


def contains_any(columns: list[str], value: Column) -> Column:
    """Case-insensitive containment in any of the columns; % and _ inside the value act as wildcards. Null columns don't match."""
    pattern = F.concat(F.lit("%"), value, F.lit("%"))
    return reduce(lambda a, b: a | b, [F.coalesce(F.ilike(F.col(c), pattern), F.lit(False)) for c in columns])


def effective_scope(codebase: Column, own: Column, category: Column, wanted: str) -> Column:
    """Own or global (null) rows whose category is the wanted one or ``all``; ``*`` and ``all`` ask for every category."""
    scope = codebase.isNull() | (codebase == own)
    return scope if wanted in ("*", "all") else scope & category.isin(wanted, "all")


def active_capped(df: DataFrame, order: list[str], cap: int) -> DataFrame:
    return df.where("status = 'active'").orderBy(*order).limit(cap)


def touched(df: DataFrame, changed: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose path is among the changed ones."""
    return df.join(changed.select(F.col("path").alias(path)).distinct(), path, "left_semi")


LIVE = ("validated", "open", "in_progress")


def reusable(reports: DataFrame, scans: DataFrame, findings: DataFrame, workflow: str, scope: str, need_graph: bool = False) -> DataFrame:
    """Reports of successful scans of the same workflow and scope whose finding is live, with schema 1 and a path list.

    ``reports(scan_id, finding_id, schema_version, taint_path)``, ``scans(scan_id, status, workflow, scope)``, ``findings(finding_id, state, graph_complete)``.
    """
    s = scans.where((F.col("status") == "SUCCESSFUL") & (F.col("workflow") == workflow) & (F.col("scope") == scope)).select("scan_id")
    f = findings.where(F.col("state").isin(*LIVE))
    f = f.where("graph_complete") if need_graph else f
    good = (F.col("schema_version") == 1) & F.col("taint_path").isNotNull()
    return reports.where(good).join(s, "scan_id", "left_semi").join(f.select("finding_id"), "finding_id", "left_semi")


def evidence_present(reports: DataFrame, files: DataFrame) -> DataFrame:
    """``reports(report_id, locations: array<struct<path, start_line, end_line>>)`` of which every location lies in a file of ``files(path, line_count)``.

    Reports without locations are not kept. Hashes are not compared here; staleness is another question.
    """
    at = reports.select("report_id", F.explode("locations").alias("_l")).select("report_id", "_l.path", "_l.start_line", "_l.end_line")
    f = files.select(F.col("path").alias("_p"), "line_count")
    ok = F.col("_p").isNotNull() & (F.col("start_line") >= 1) & (F.col("start_line") <= F.col("end_line")) & (F.col("end_line") <= F.col("line_count"))
    kept = at.join(f, F.col("path") == F.col("_p"), "left").groupBy("report_id").agg(F.bool_and(ok).alias("_ok")).where("_ok")
    return reports.join(kept.select("report_id"), "report_id", "left_semi")


def compact(items: Column, focus: Column, cap: int) -> Column:
    """At most ``cap`` items of an array of texts. Only when there are more do those that mention the focus come first; order is kept otherwise."""
    ranked = F.array_sort(F.transform(items, lambda v, i: F.struct(F.when(F.instr(v, focus) > 0, 0).otherwise(1).alias("k"), i.alias("i"), v.alias("v"))))
    return F.when(F.size(items) <= cap, items).otherwise(F.transform(F.slice(ranked, 1, cap), lambda s: s["v"]))


def without_fields(df: DataFrame, column: str, dropped: list[str]) -> DataFrame:
    """A struct column without some of its fields."""
    return df.withColumn(column, F.col(column).dropFields(*dropped))
