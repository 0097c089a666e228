"""Counts over fixed domains, quotas, obligation ledgers, metrics, telemetry, change flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def counts_by(df: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Rows per value, with zero for values of the domain that do not occur."""
    every = df.sparkSession.createDataFrame([(d,) for d in domain], f"{column} string")
    found = df.groupBy(F.col(column).alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    return every.join(found, F.col(column) == F.col("_c"), "left").select(column, F.coalesce("_n", F.lit(0)).alias("n"))


def sum_since(df: DataFrame, key: str, at: str, amount: str, since: Column, keys: DataFrame | None = None) -> DataFrame:
    """Sum of an amount from a time on, 0 where there is none (for the given keys, else those of ``df``)."""
    base = keys if keys is not None else df.select(key).distinct()
    got = df.where(F.col(at) >= since).groupBy(F.col(key).alias("_k")).agg(F.sum(amount).alias("_s"))
    return base.join(got, F.col(key) == F.col("_k"), "left").select(key, F.coalesce("_s", F.lit(0)).alias("total"))


def rolling_count(df: DataFrame, key: str, seconds: Column, span: int, limit: int) -> DataFrame:
    """Adds ``n_recent``: rows of the key in the trailing span, both ends included; ``over_quota``."""
    w = Window.partitionBy(key).orderBy(seconds).rangeBetween(-span, Window.currentRow)
    n = F.count(F.lit(1)).over(w)
    return df.withColumn("n_recent", n).withColumn("over_quota", F.col("n_recent") > limit)


RESOLVED = ("NO_ISSUE", "NOT_APPLICABLE", "CANDIDATE_FOUND")
PENDING = ("UNRESOLVED", "NEEDS_CONTEXT")


def obligation_groups(observations: DataFrame) -> DataFrame:
    """``observations(canonical_id, coverage_scope, status, importance)`` -> one row for each canonical id (and scope)."""
    status = F.col("status")
    return observations.groupBy("canonical_id", F.coalesce("coverage_scope", F.lit("")).alias("coverage_scope")).agg(
        F.bool_or(F.col("importance") == "REQUIRED").alias("required"), F.bool_or(status.isin(*RESOLVED)).alias("resolved"),
        F.bool_or(status.isin(*PENDING)).alias("pending"),
    )


def reconcile_obligations(observations: DataFrame) -> DataFrame:
    """One row: totals, required, unresolved by importance, and groups that a sibling has resolved."""
    g = obligation_groups(observations)
    open_ = ~F.col("resolved") & F.col("pending")
    return g.agg(
        F.count(F.lit(1)).alias("canonical_obligations_total"),
        F.count_if("required").alias("canonical_required_obligations"),
        F.count_if(open_ & F.col("required")).alias("canonical_required_unresolved"),
        F.count_if(open_ & ~F.col("required")).alias("canonical_supporting_unresolved"),
        F.count_if(F.col("resolved") & F.col("pending")).alias("obligations_reconciled_by_sibling"),
    )


def reconcile_batches(planned: DataFrame, observed: DataFrame) -> DataFrame:
    """``planned(workset_id, evidence_hash, canonical_id, region_id)``, ``observed(region_id, canonical_id, status)`` -> per planned obligation.

    Complete only if every planned region has exactly one answer and it is terminal. Adds ``status`` (CANDIDATE_FOUND over NO_ISSUE over
    NOT_APPLICABLE; UNRESOLVED if incomplete), ``missing`` (regions without an answer).
    """
    answers = observed.groupBy(F.col("region_id").alias("_r"), F.col("canonical_id").alias("_c")).agg(
        F.count(F.lit(1)).alias("_n"), F.collect_set("status").alias("_s")
    )
    rows = planned.distinct().join(answers, (F.col("region_id") == F.col("_r")) & (F.col("canonical_id") == F.col("_c")), "left")
    good = (F.coalesce("_n", F.lit(0)) == 1) & F.coalesce(F.arrays_overlap("_s", F.lit(list(RESOLVED))), F.lit(False))
    g = rows.groupBy("workset_id", "evidence_hash", "canonical_id").agg(
        F.bool_and(good).alias("complete"), F.count_if(F.col("_n").isNull()).alias("missing"),
        F.array_distinct(F.flatten(F.collect_list("_s"))).alias("_all"),
    )
    status = F.when(~F.col("complete"), "UNRESOLVED")
    for s in ("CANDIDATE_FOUND", "NO_ISSUE"):
        status = status.when(F.array_contains("_all", s), s)
    return g.select("workset_id", "evidence_hash", "canonical_id", "complete", "missing", status.otherwise("NOT_APPLICABLE").alias("status"))


def missing_batches(batches: DataFrame) -> DataFrame:
    """``batches(workset_id, batch_index, batch_count)`` -> worksets with absent indexes: ``workset_id, absent`` (array, ascending)."""
    g = batches.groupBy("workset_id").agg(F.max("batch_count").alias("_n"), F.collect_set("batch_index").alias("_have"))
    absent = F.array_except(F.sequence(F.lit(0).cast("long"), F.col("_n").cast("long") - 1), F.col("_have"))
    return g.select("workset_id", F.array_sort(absent).alias("absent")).where("size(absent) > 0")


def obligation_identity(kind: Column, fields: dict[str, Column], region: Column, question: Column) -> Column:
    """Hash of the type and its normalised, sorted, distinct field values; without any value, of type, region and question.

    ``fields``: name -> array of strings, already limited to those of the type.
    """
    from provenant.functions.ids import joined
    from provenant.functions.text import plain_text

    parts = []
    for name in sorted(fields):
        values = F.array_sort(F.array_distinct(F.filter(F.transform(fields[name], plain_text), lambda v: v != "")))
        parts.append(F.when(F.size(values) > 0, F.concat(F.lit(name + "="), F.array_join(values, "\x1f"))))
    semantic = F.concat_ws("\x1e", *parts)
    return F.sha2(F.when(semantic != "", joined([kind, semantic], "\x1d")).otherwise(joined([kind, region, plain_text(question)], "\x1d")), 256)


def quality_metrics(expected: Column, reported: Column, fingerprint: Column, df: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, recall, precision (1 if nothing is expected / reported), duplicate_rate (0 if nothing has a fingerprint)."""
    f = F.when(reported & (fingerprint != ""), fingerprint)
    g = df.agg(
        F.count_if(expected & reported).alias("tp"), F.count_if(~expected & reported).alias("fp"), F.count_if(expected & ~reported).alias("fn"),
        (F.count(f) - F.count_distinct(f)).alias("duplicates"), F.count_if(reported).alias("n_reported"),
    )

    def rate(top: Column, bottom: Column, empty: float) -> Column:
        return F.when(bottom == 0, F.lit(empty)).otherwise(F.bround(top / bottom, 4))

    return g.select(
        "tp", "fp", "fn", rate(F.col("tp"), F.col("tp") + F.col("fn"), 1.0).alias("recall"),
        rate(F.col("tp"), F.col("tp") + F.col("fp"), 1.0).alias("precision"),
        rate(F.col("duplicates"), F.col("n_reported"), 0.0).alias("duplicate_rate"),
    )


def failed_thresholds(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``metrics(name, actual)``, ``thresholds(name, maximum)`` -> those above their maximum; metrics without a threshold are not checked."""
    return metrics.join(thresholds.where("maximum IS NOT NULL"), "name").where("actual > maximum").select("name", "actual", "maximum")


def usage_by_model(events: DataFrame) -> DataFrame:
    """``events(model, cached, tokens, cost)`` -> per model: requests, hits, hit_rate, tokens, cost."""
    return events.groupBy("model").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if("cached").alias("hits"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"),
    ).withColumn("hit_rate", F.bround(F.col("hits") / F.col("requests"), 4))


def budget_cutoff(events: DataFrame, key: str, order: list[str], cost: str, limit: int) -> DataFrame:
    """Adds ``spent`` (running cost of the key) and ``allowed``: whether the limit had not been passed before this row."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("spent", F.sum(cost).over(w)).withColumn("allowed", F.col("spent") <= limit)


def canonical_queries(queries: DataFrame) -> DataFrame:
    """``queries(ord, query_id, terms, globs, task_ids)`` -> grouped by equal sets of terms (case-folded) and globs: first query's id, union of tasks."""
    t = F.array_sort(F.array_distinct(F.transform("terms", F.lower)))
    g = F.array_sort(F.array_distinct("globs"))
    return queries.groupBy(t.alias("terms"), g.alias("globs")).agg(
        F.min_by("query_id", "ord").alias("query_id"), F.min("ord").alias("ord"), F.count(F.lit(1)).alias("n"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("task_ids")))).alias("task_ids"),
    )


def tagged_hits(hits: DataFrame) -> DataFrame:
    """``hits(path, line, query_id)`` -> per line the sorted set of its queries."""
    return hits.groupBy("path", "line").agg(F.array_sort(F.collect_set("query_id")).alias("query_ids"))


def requirement_obligations(requirements: DataFrame) -> DataFrame:
    """``requirements(type, field, values)`` -> one obligation for each distinct normalised value of (type, field)."""
    from provenant.functions.text import plain_text

    v = requirements.select("type", "field", F.explode("values").alias("value")).select("type", "field", plain_text(F.col("value")).alias("value"))
    return v.where("value <> ''").distinct().withColumn("canonical_id", F.sha2(F.concat_ws("\x1d", "type", "field", "value"), 256))


def review_depth(files: DataFrame, key: str) -> DataFrame:
    """``files(key, tags, sensitive)`` -> change flags and the least review depth.

    DEEP if a security path or sensitive material changed; else FAST if all is docs, or all generated, or all tests without config,
    dependency or runtime changes; else STANDARD if any of these changed; else FAST.
    """

    def has(tag: str) -> Column:
        return F.array_contains("tags", tag)

    g = files.groupBy(key).agg(
        F.bool_and(has("docs")).alias("docs_only"), F.bool_and(has("generated")).alias("generated_only"), F.bool_and(has("test")).alias("test_only"),
        F.bool_or(has("config")).alias("config_changed"), F.bool_or(has("dependency")).alias("dependency_changed"),
        F.bool_or(has("source") & ~has("test")).alias("runtime_changed"), F.bool_or(has("security_path")).alias("security_changed"),
        F.bool_or("sensitive").alias("sensitive_changed"),
    )
    live = F.col("config_changed") | F.col("dependency_changed") | F.col("runtime_changed")
    depth = (
        F.when(F.col("security_changed") | F.col("sensitive_changed"), "DEEP")
        .when(F.col("docs_only") | F.col("generated_only") | (F.col("test_only") & ~live), "FAST").when(live, "STANDARD").otherwise("FAST")
    )
    return g.withColumn("depth", depth)


def first_by_precedence(df: DataFrame, key: str, decision: str, precedence: list[str], default: str) -> DataFrame:
    """Per key the decision that comes first in the list; ``default`` if none does."""
    place = F.array_position(F.lit(precedence), F.col(decision))
    best = F.min(F.when(place > 0, place))
    return df.groupBy(key).agg(F.coalesce(F.element_at(F.lit(precedence), best.cast("int")), F.lit(default)).alias("decision"))


def reuse_percentage(base: Column, changed: Column) -> Column:
    """round half to even(max(0, base - changed) * 100 / base); 100 for an empty base."""
    return F.when(base == 0, F.lit(100)).otherwise(F.bround(F.greatest(F.lit(0), base - changed) * 100 / F.when(base != 0, base)).cast("int"))
