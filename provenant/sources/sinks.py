"""Sinks: JSON, SARIF 2.1.0 and Markdown reports; table writes are in operators.overlay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.functions.ids import canonical_json
from provenant.functions.text import SEVERITIES, lookup

SARIF_LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}


def write_json(df: DataFrame, path: str) -> None:
    """One object a line, nulls kept."""
    df.select(canonical_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("errorifexists").text(path)


def _place(path, start, end):
    return F.struct(F.struct(F.struct(path.alias("uri")).alias("artifactLocation"), F.struct(start.alias("startLine"), end.alias("endLine")).alias("region")).alias("physicalLocation"))


def _result():
    return F.struct(
        F.col("rule_id").alias("ruleId"), lookup(F.lower("severity"), SARIF_LEVEL, "warning").alias("level"), F.struct(F.col("title").alias("text")).alias("message"),
        F.array(_place(F.col("path"), F.col("start_line"), F.col("end_line"))).alias("locations"),
        F.transform("others", lambda o: _place(o["path"], o["start_line"], o["end_line"])).alias("relatedLocations"),
        F.struct(F.col("fingerprint").alias("primary")).alias("partialFingerprints"),
    )


def sarif_lines(findings: DataFrame, tool: str, version: str) -> DataFrame:
    """``findings(ord, rule_id, title, severity, path, start_line, end_line, fingerprint, others)`` -> ``section, ord, value``: the lines of a SARIF 2.1.0 text.

    A rule is stated once, as first seen; ``others`` (array of path, start_line, end_line) become related locations. Each rule and each finding is a line
    of its own, made where it lies; in order of section and ord they are one document. Nothing is gathered: what follows another line of its section begins with a
    comma, and which one is first is all that is asked of the whole.
    """
    spark = findings.sparkSession
    rules = findings.groupBy("rule_id").agg(F.min(F.struct("ord", "title")).alias("_f")).select(
        F.lit(1).alias("section"), F.col("_f.ord").cast("long").alias("ord"), F.to_json(F.struct(F.col("rule_id").alias("id"), F.struct(F.col("_f.title").alias("text")).alias("shortDescription"))).alias("value"))
    results = findings.select(F.lit(3).alias("section"), F.col("ord").cast("long").alias("ord"), F.to_json(_result()).alias("value"))
    lines = rules.unionByName(results)
    first = F.when(F.col("section") == 1, rules.agg(F.min("ord")).scalar()).otherwise(results.agg(F.min("ord")).scalar())
    inner = lines.select("section", "ord", F.concat(F.when(F.col("ord") > first, ",").otherwise(""), "value").alias("value"))
    name, number = (F.to_json(F.struct(F.lit(x).alias("x"))) for x in (tool, version))
    text = lambda x: F.regexp_extract(x, r"^\{\"x\":(.*)\}$", 1)
    frame = spark.range(3).select(
        (F.col("id") * 2).cast("int").alias("section"), F.lit(0).cast("long").alias("ord"),
        F.when(F.col("id") == 0, F.concat(F.lit('{"version":"2.1.0","runs":[{"tool":{"driver":{"name":'), text(name), F.lit(',"version":'), text(number), F.lit(',"rules":['))).when(F.col("id") == 1, ']}},"results":[').otherwise("]}]}").alias("value"))
    return frame.unionByName(inner)


def write_sarif(findings: DataFrame, tool: str, version: str, path: str) -> None:
    """The document in parts that are ranges of its lines: the files of the folder, in the order of their names, one after another."""
    sarif_lines(findings, tool, version).orderBy("section", "ord").select("value").write.mode("errorifexists").text(path)


def sarif(findings: DataFrame, tool: str, version: str) -> DataFrame:
    """One row with the whole text of ``sarif_lines``, for reports of a size that one row may have."""
    lines = sarif_lines(findings, tool, version)
    return lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "ord", "value"))), lambda x: x["value"]), "").alias("value"))


def _cell(column: str):
    return F.regexp_replace(F.regexp_replace(F.coalesce(F.col(column).cast("string"), F.lit("")), r"\|", r"\\|"), r"[\r\n]+", " ")


def markdown(findings: DataFrame) -> DataFrame:
    """``findings(ord, severity, title, path, start_line)`` -> lines ``ord, value``: counts by severity, then a table of findings, worst first."""
    rank = lookup(F.lower("severity"), {s: i for i, s in enumerate(SEVERITIES)}, len(SEVERITIES))
    counts = findings.groupBy(F.lower("severity").alias("severity")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.select(F.struct(F.lit(0).alias("a"), rank.alias("b"), F.lit(0).cast("long").alias("c")).alias("ord"), F.concat(F.lit("- "), "severity", F.lit(": "), F.col("n").cast("string")).alias("value"))
    head = findings.sparkSession.createDataFrame([(1, "| Severity | Finding | Place |"), (2, "| --- | --- | --- |")], "n int, value string").select(
        F.struct(F.lit(1).alias("a"), F.col("n").alias("b"), F.lit(0).cast("long").alias("c")).alias("ord"), "value")
    rows = findings.select(
        F.struct(F.lit(2).alias("a"), rank.alias("b"), F.col("ord").cast("long").alias("c")).alias("ord"),
        F.concat(F.lit("| "), _cell("severity"), F.lit(" | "), _cell("title"), F.lit(" | "), _cell("path"), F.lit(":"), F.coalesce(F.col("start_line").cast("string"), F.lit("")), F.lit(" |")).alias("value"),
    )
    return top.unionByName(head).unionByName(rows)


def write_markdown(findings: DataFrame, path: str) -> None:
    markdown(findings).orderBy("ord").select("value").coalesce(1).write.mode("errorifexists").text(path)
