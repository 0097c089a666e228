"""Region planning: from search queries and files to merged source regions, uncovered remainders, worksets and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.operators import aggregates as A
from provenant.operators import intervals as I
from provenant.operators import joins as J
from provenant.sources import readers as S


def plan_regions(queries: DataFrame, files: DataFrame, symbols: DataFrame, reach: int = 20, hits_per_query: int = 500, chunk: int = 200) -> dict[str, DataFrame]:
    """``queries(ord, query_id, terms, globs, task_ids)``, ``files(path, content)``, ``symbols(path, span_id, start_line, end_line, ord)``.

    Equal queries become one; each hit opens a window of ``reach`` lines around it, clipped to the file; its anchor is the narrowest symbol around it, else
    plain lines; windows of one anchor are merged; what no region covers is cut into chunks. -> ``regions``, ``uncovered``, ``invalid`` (queries).
    """
    canon = A.canonical_queries(queries)
    lines = S.text_lines(files)
    hits, invalid = S.search(lines, canon.select("query_id", "terms"), "path", hits_per_query)
    tagged = A.tagged_hits(hits.select("path", F.col("line_no").alias("line"), "query_id"))
    tasks = canon.select("query_id", "task_ids")
    split = files.select("path", F.split("content", "\n").alias("lines"))
    sized = tagged.join(split.select("path", F.size("lines").alias("n")), "path").withColumn("id", F.concat_ws(":", "path", F.col("line").cast("string")))
    anchored = J.enclosing_span(sized, symbols, ["path"])
    of_tasks = anchored.select("id", F.explode("query_ids").alias("query_id")).join(tasks, "query_id").groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("task_ids")))).alias("task_ids"))
    windows = anchored.join(of_tasks, "id").select(
        "path", F.greatest(F.lit(1), F.col("line") - reach).cast("int").alias("start_line"), F.least(F.col("n"), F.col("line") + reach).cast("int").alias("end_line"),
        F.when(F.col("span_id").isNull(), "line_range").otherwise("symbol").alias("anchor_type"), F.coalesce(F.col("span_id").cast("string"), F.lit("")).alias("anchor_id"), "task_ids",
    )
    regions = I.merge_anchored(windows, split)
    whole = split.select("path", F.lit(0).alias("id"), F.lit(1).alias("start"), F.size("lines").alias("end"))
    covered = regions.select("path", F.col("start_line").alias("start"), F.col("end_line").alias("end"))
    rest = I.subtract(whole, covered, "path").select("path", F.col("start").alias("start_line"), F.col("end").alias("end_line"))
    return {"regions": regions, "uncovered": I.chunk_lines(rest, chunk), "invalid": invalid}


def worksets(regions: DataFrame, files: DataFrame, most_slices: int = 8, most_chars: int = 24_000) -> DataFrame:
    """Regions as slices of worksets by anchor, in batches: ``workset_id, ord, chars, batch, batch_count, remaining``. Nothing is dropped."""
    split = files.select("path", F.split("content", "\n").alias("lines"))
    text = F.array_join(F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    rows = regions.join(split, "path").withColumn("_t", text).select(
        F.sha2(F.concat_ws(":", "anchor_type", "anchor_id", "path"), 256).alias("workset_id"), F.col("start_line").cast("long").alias("ord"), F.length("_t").alias("chars")
    )
    return I.pack_batches(rows, "workset_id", most_slices, most_chars)
