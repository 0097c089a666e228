"""Inclusive line intervals of files: merge, subtract, chunk, pack, map through hunks, cut out windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from provenant.functions.text import redact
from provenant.operators import joins as J


def merge_near(df: DataFrame, key: str, gap: int) -> DataFrame:
    """``df(key, start, end)`` -> islands ``key, start, end, n``: intervals whose start lies within ``gap`` after the furthest end so far."""
    before = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    # equal intervals are numbered together, in whatever order each pass meets them
    upto = Window.partitionBy(key).orderBy("start", "end").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    far = F.max("end").over(before)
    flagged = df.withColumn("_new", F.when(far.isNull() | (F.col("start") - far > gap), 1).otherwise(0))
    return flagged.withColumn("_i", F.sum("_new").over(upto)).groupBy(key, "_i").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n")
    ).drop("_i")


def _worked(batches: Iterator[pa.RecordBatch], key: str, work: Callable[[list[dict]], list[dict]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in order of key -> what the work makes of each key's rows; many small keys leave in one batch."""
    at, rows = None, []
    for batch in batches:
        out: list[dict] = []
        for row in batch.to_pylist():
            if rows and row[key] != at:
                out += work(rows)
                rows = []
            at = row[key]
            rows.append(row)
        yield pa.RecordBatch.from_pylist(out, schema)
    if rows:
        yield pa.RecordBatch.from_pylist(work(rows), schema)


def _grouped(df: DataFrame, key: str, work: Callable[[list[dict]], list[dict]], schema: str, first: list[str] | None = None) -> DataFrame:
    """An order-dependent pass over the rows of each key (``first``: columns that order them, if the work asks for an order); the key is the unit of scale (a file's windows)."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    ordered = df.repartition(key).sortWithinPartitions(key, *(first or []))
    return ordered.mapInArrow(lambda batches: _worked(batches, key, work, kinds), schema)


def _tags(*sets) -> list[str]:
    return sorted({x for s in sets for x in s})


def merge_windows(windows: DataFrame, gap: int = 20, limit: int = 16_000) -> DataFrame:
    """``windows(path, start_line, end_line, content, query_ids, task_ids)`` -> merged windows.

    In order of start, a window joins the current one if it starts at most ``gap`` lines after its end, and the length of the current one's
    first text and its own stay within ``limit`` together. The first text is not extended by merging.
    """

    def work(rows: list[dict]) -> list[dict]:
        out: list[dict] = []
        for w in sorted(rows, key=lambda r: (r["start_line"], r["end_line"], r["content"])):
            last = out[-1] if out else None
            if last and w["start_line"] - last["end_line"] <= gap and last["_chars"] + len(w["content"]) <= limit:
                last["end_line"] = max(last["end_line"], w["end_line"])
                last["query_ids"], last["task_ids"] = _tags(last["query_ids"], w["query_ids"]), _tags(last["task_ids"], w["task_ids"])
                last["n"] += 1
            else:
                out.append({**w, "query_ids": _tags(w["query_ids"]), "task_ids": _tags(w["task_ids"]), "n": 1, "_chars": len(w["content"])})
        return out

    return _grouped(windows, "path", work, "path string, start_line int, end_line int, query_ids array<string>, task_ids array<string>, n int")


def merge_anchored(regions: DataFrame, files: DataFrame, ratio: float = 0.5, gap: int = 20, limit: int = 16_000) -> DataFrame:
    """``regions(path, start_line, end_line, anchor_type, anchor_id, task_ids)``, ``files(path, lines)`` -> merged regions.

    Same anchor: enough overlap or a small gap; two plain line ranges: enough overlap; otherwise never. The size limit
    holds for the text of the merged span.
    """

    def work(rows: list[dict]) -> list[dict]:
        lines, at, total = rows[0]["_lengths"], [0], 0
        if lines is None:
            return []
        for n in lines:
            total += n + 1
            at.append(total)
        out: list[dict] = []
        for r in sorted((r for r in rows if r["_lengths"] is None), key=lambda r: (r["start_line"], r["end_line"], r["anchor_id"])):
            last = out[-1] if out else None
            if last is not None:
                shared = min(last["end_line"], r["end_line"]) - max(last["start_line"], r["start_line"]) + 1
                enough = max(0, shared) / max(1, r["end_line"] - r["start_line"] + 1) >= ratio
                same = (last["anchor_type"], last["anchor_id"]) == (r["anchor_type"], r["anchor_id"])
                plain = last["anchor_type"] == r["anchor_type"] == "line_range"
                join = enough or r["start_line"] - last["end_line"] <= gap if same else plain and enough
                low, high = min(last["start_line"], r["start_line"]), max(last["end_line"], r["end_line"])
                if join and at[min(high, len(lines))] - at[min(low - 1, len(lines))] - 1 <= limit:
                    last |= {"start_line": low, "end_line": high, "task_ids": _tags(last["task_ids"], r["task_ids"]), "n": last["n"] + 1}
                    continue
            out.append({**r, "task_ids": _tags(r["task_ids"]), "n": 1})
        return out

    # a file's line lengths come once, before its regions
    lengths = files.where("path IS NOT NULL AND lines IS NOT NULL").select("path", F.transform("lines", F.length).alias("_lengths"))
    both = lengths.unionByName(regions.select("path", "start_line", "end_line", "anchor_type", "anchor_id", "task_ids"), allowMissingColumns=True)
    known = both.withColumn("_late", F.col("_lengths").isNull())
    return _grouped(known, "path", work, "path string, start_line int, end_line int, anchor_type string, anchor_id string, task_ids array<string>, n int", ["_late"])


def subtract(ranges: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    """``ranges(key, id, start, end)`` minus ``covered(key, start, end)`` -> the uncovered parts ``key, id, start, end``.

    Covered intervals are merged first, in one sorted run whose last row of an island is the island; so each range meets disjoint ones, in order, and its
    gaps are their neighbours' ends, the last one's after it, too. Covered intervals without a line cover nothing.
    """
    run = Window.partitionBy("_k").orderBy("_s", "_e")
    c = covered.where("start <= end").select(F.col(key).alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    far = F.max("_e").over(run.rowsBetween(Window.unboundedPreceding, -1))
    flagged = c.withColumn("_far", far).withColumn("_new", F.col("_far").isNull() | (F.col("_s") - F.col("_far") > 1))
    begun = F.max(F.when(F.col("_new"), F.col("_s"))).over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    islands = flagged.select("_k", begun.alias("_first"), F.greatest("_far", "_e").alias("_end"), F.lead("_new", 1, True).over(run).alias("_last")).where("_last").select("_k", F.col("_first").alias("_s"), F.col("_end").alias("_e"))
    hit = ranges.join(islands, (F.col(key) == F.col("_k")) & (F.col("_s") <= F.col("end")) & (F.col("_e") >= F.col("start")), "left")
    w = Window.partitionBy(key, "id").orderBy("_s")
    gap = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    before = gap(F.coalesce(F.lag("_e").over(w) + 1, F.col("start")), F.coalesce(F.col("_s") - 1, F.col("end")))
    after = F.when(F.col("_s").isNotNull() & F.lead("_s").over(w).isNull(), gap(F.col("_e") + 1, F.col("end")))
    gaps = hit.select(key, "id", F.array(before, after).alias("_g")).select(key, "id", F.explode("_g").alias("_g")).where("_g.a <= _g.b")
    return gaps.select(key, "id", F.col("_g.a").alias("start"), F.col("_g.b").alias("end"))


def first_covering(segments: DataFrame, regions: DataFrame, key: str, ratio: float) -> DataFrame:
    """For each segment ``(key, id, start, end)`` the first region ``(key, region, ord, start, end)`` that covers at least the ratio of it; null: none."""
    met = J.overlapping(segments, regions.withColumn("id", F.struct("region", "ord", "start", "end")), key)
    shared = F.least("end", "right_id.end") - F.greatest("start", "right_id.start") + 1
    at = segments.select(F.col(key).alias("_k"), F.col("id").alias("_i"), "start", "end")
    enough = met.join(at, (F.col(key) == F.col("_k")) & (F.col("left_id") == F.col("_i"))).where(shared / (F.col("end") - F.col("start") + 1) >= ratio)
    best = enough.groupBy(key, F.col("left_id").alias("id")).agg(F.min_by("right_id.region", "right_id.ord").alias("region"))
    return segments.join(best, [key, "id"], "left")


def chunk_chars(lines: DataFrame, key: str, most: int = 1600) -> DataFrame:
    """``lines(key, line_no, text)`` -> ``key, start_line, end_line, chars``: as many whole lines as fit; one longer line stands alone."""
    kind = lines.schema[key].dataType.simpleString()

    def work(rows: list[dict]) -> list[dict]:
        out: list[dict] = []
        for r in sorted(rows, key=lambda r: r["line_no"]):
            n = len(r["text"]) + 1
            if out and out[-1]["chars"] + n <= most:
                out[-1] |= {"end_line": r["line_no"], "chars": out[-1]["chars"] + n}
            else:
                out.append({key: r[key], "start_line": r["line_no"], "end_line": r["line_no"], "chars": n})
        return out

    return _grouped(lines, key, work, f"{key} {kind}, start_line int, end_line int, chars int")


def chunk_lines(spans: DataFrame, size: int) -> DataFrame:
    """``spans(..., start_line, end_line)`` in pieces of ``size`` lines."""
    start = F.explode(F.sequence(F.col("start_line"), F.col("end_line"), F.lit(size)))
    rest = [c for c in spans.columns if c not in ("start_line", "end_line")]
    return spans.where("start_line <= end_line").select(*rest, "end_line", start.alias("start_line")).select(
        *rest, "start_line", F.least(F.col("end_line"), F.col("start_line") + size - 1).alias("end_line")
    )


def chunk_routes(lines: DataFrame, key: str, most_lines: int, most_chars: int) -> DataFrame:
    """As chunk_chars with a bound on lines too; a single line above the bound is an error."""
    if lines.where(F.length("text") > most_chars).limit(1).count():
        raise ValueError("one line is longer than a chunk may be")
    kind = lines.schema[key].dataType.simpleString()

    def work(rows: list[dict]) -> list[dict]:
        out: list[dict] = []
        for r in sorted(rows, key=lambda r: r["line_no"]):
            n = len(r["text"]) + 1
            last = out[-1] if out else None
            if last and last["chars"] + n <= most_chars and r["line_no"] - last["start_line"] < most_lines:
                last |= {"end_line": r["line_no"], "chars": last["chars"] + n}
            else:
                out.append({key: r[key], "start_line": r["line_no"], "end_line": r["line_no"], "chars": n})
        return out

    return _grouped(lines, key, work, f"{key} {kind}, start_line int, end_line int, chars int")


def pack_batches(slices: DataFrame, key: str, most_slices: int = 8, most_chars: int = 24_000) -> DataFrame:
    """``slices(key, ord, chars)`` -> adds ``batch, batch_count, remaining``: in order, nothing dropped; a slice above the bound is an error."""
    if slices.where(F.col("chars") > most_chars).limit(1).count():
        raise ValueError("one slice is larger than a batch may be")
    kind = slices.schema[key].dataType.simpleString()

    def work(rows: list[dict]) -> list[dict]:
        batch, n, chars, out = 0, 0, 0, []
        rows = sorted(rows, key=lambda r: r["ord"])
        for r in rows:
            if n and (n >= most_slices or chars + r["chars"] > most_chars):
                batch, n, chars = batch + 1, 0, 0
            n, chars = n + 1, chars + r["chars"]
            out.append({key: r[key], "ord": r["ord"], "chars": r["chars"], "batch": batch})
        ends = {o["batch"]: i + 1 for i, o in enumerate(out)}
        return [{**o, "batch_count": batch + 1, "remaining": len(out) - ends[o["batch"]]} for o in out]

    return _grouped(slices, key, work, f"{key} {kind}, ord long, chars int, batch int, batch_count int, remaining int")


HUNK = "struct<old_start:int,old_lines:int,new_start:int,new_lines:int>"


def map_lines(hunks: Column, start: Column, end: Column) -> Column:
    """A range of old lines after a diff's hunks: struct(start, end). Untouched lines shift; an edited line stands for its whole hunk."""
    ordered = F.sort_array(hunks)

    def one(line: Column) -> Column:
        def last(h: Column) -> Column:
            return h["old_start"] + h["old_lines"] - 1

        inside = F.filter(ordered, lambda h: (h["old_lines"] > 0) & line.between(h["old_start"], last(h)))
        shift = F.aggregate(
            F.filter(ordered, lambda h: ((h["old_lines"] > 0) & (line > last(h))) | ((h["old_lines"] == 0) & (line > h["old_start"]))),
            F.lit(0), lambda acc, h: acc + h["new_lines"] - h["old_lines"],
        )
        hit = F.get(inside, 0)
        new = F.when(hit["new_lines"] > 0, hit["new_start"]).otherwise(F.greatest(F.lit(1), hit["new_start"]))
        touched = F.struct(new.alias("a"), (new + F.greatest(hit["new_lines"], F.lit(1)) - 1).alias("b"), F.lit(True).alias("t"))
        moved = F.struct((line + shift).alias("a"), (line + shift).alias("b"), F.lit(False).alias("t"))
        return F.when(F.size(inside) > 0, touched).otherwise(moved)

    low, high = one(start), one(end)
    until = F.greatest(F.when(high["t"], high["b"]).otherwise(high["a"]), low["a"])
    until = F.when(low["t"], F.greatest(until, low["b"])).otherwise(until)
    return F.struct(F.greatest(F.lit(1), low["a"]).alias("start"), F.greatest(F.lit(1), until).alias("end"))


def touches_hunks(hunks: Column, start: Column, end: Column, deleted: Column) -> Column:
    """A range meets a hunk: on the new side, on the old side of a deleted file; an empty side counts as one line."""

    def meets(h: Column) -> Column:
        at = F.when(deleted, h["old_start"]).otherwise(h["new_start"])
        n = F.greatest(F.lit(1), F.when(deleted, h["old_lines"]).otherwise(h["new_lines"]))
        return (at <= end) & (at + n - 1 >= start)

    return F.exists(hunks, meets)


def context_window(lines: Column, line: Column, reach: int, most_chars: int) -> Column:
    """The lines around one, clipped to the file: struct(start_line, end_line, content, truncated); content is cut to a size."""
    first = F.greatest(F.lit(1), line - reach)
    last = F.least(F.size(lines), line + reach)
    text = F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), "\n")
    return F.struct(
        first.alias("start_line"), last.alias("end_line"), F.substring(text, 1, most_chars).alias("content"), (F.length(text) > most_chars).alias("truncated")
    )


def source_windows(requests: DataFrame, files: DataFrame, before: int, after: int, most_chars: int) -> DataFrame:
    """``requests(id, path, line, hash)`` (the hash that the snapshot has of the file; null: it has no such file), ``files(path, content)`` ->
    ``id, state, start_line, end_line, content``: the redacted text around a line, or why there is none.

    States: ok, unknown_path, unreadable (no such file or no text), stale_source (the file has another hash by now), invalid_range (no such line), over_budget (more
    than ``most_chars`` after redaction). Only ok comes with a text: it is never cut.
    """
    f = files.select(F.col("path").alias("_p"), "content", F.sha2("content", 256).alias("_h"), F.split("content", "\n").alias("_all"))
    n = F.size("_all") - F.col("content").endswith("\n").cast("int")
    got = requests.join(f, F.col("path") == F.col("_p"), "left").withColumn("_n", F.greatest(F.lit(1), n))
    first, last = F.greatest(F.lit(1), F.col("line") - before).cast("int"), F.least(F.col("_n"), F.col("line") + after).cast("int")
    exact = F.concat(F.array_join(F.slice("_all", F.col("_first"), F.greatest(F.lit(0), F.col("_last") - F.col("_first") + 1)), "\n"), F.when(F.col("_last") < F.size("_all"), "\n").otherwise(""))
    state = (
        F.when(F.col("hash").isNull(), "unknown_path").when(F.col("_h").isNull(), "unreadable").when(F.col("_h") != F.col("hash"), "stale_source")
        .when(F.coalesce((F.col("line") < 1) | (F.col("_last") < F.col("_first")), F.lit(True)), "invalid_range").otherwise("ok")
    )
    stated = got.withColumn("_first", first).withColumn("_last", last).withColumn("_s", state)
    read = stated.withColumn("_t", F.when(F.col("_s") == "ok", redact(exact)))
    final = F.when(F.length("_t") > most_chars, "over_budget").otherwise(F.col("_s"))
    fine = final == "ok"
    return read.select("id", final.alias("state"), F.when(fine, F.col("_first")).alias("start_line"), F.when(fine, F.col("_last")).alias("end_line"), F.when(fine, F.col("_t")).alias("content"))


def add_uncovered(registrations: DataFrame, regions: DataFrame, counters: Observation | None = None) -> DataFrame:
    """``registrations(path, id, start, end)`` of symbols, ``regions(path, start, end, anchor_type)`` -> the parts that no region covers, as regions to
    add: ``path, id, start, end``. Regions of routes cover nothing. ``counters``, if given, has ``added`` (parts) and ``lines`` once the result was computed."""
    parts = subtract(registrations, regions.where("anchor_type <> 'route'"), "path")
    return parts if counters is None else parts.observe(counters, F.count(F.lit(1)).alias("added"), F.coalesce(F.sum(F.col("end") - F.col("start") + 1), F.lit(0)).alias("lines"))


def group_worksets(regions: DataFrame) -> DataFrame:
    """``regions(region_id, surface_type, surface_id, path, start_line, end_line, content_id)`` -> worksets of slices, equal ones once.

    A workset's identity leaves content out; its version holds it.
    """
    slices = regions.groupBy("surface_type", "surface_id", "path", "content_id").agg(F.min(F.struct("start_line", "end_line", "region_id")).alias("_s"))
    grouped = slices.groupBy("surface_type", "surface_id", "path").agg(F.array_sort(F.collect_list(F.struct("_s.start_line", "_s.end_line", "content_id"))).alias("slices"))
    identity = F.concat_ws(":", "surface_type", "surface_id", "path")
    content = F.concat_ws(":", identity, F.array_join(F.transform("slices", lambda s: s["content_id"]), ","))
    return grouped.withColumn("workset_id", F.sha2(identity, 256)).withColumn("evidence_hash", F.sha2(content, 256))
