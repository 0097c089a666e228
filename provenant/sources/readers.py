"""Sources: source trees, bounded listings, text search, unified diffs, SARIF, JSON reports, extracted graphs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenant.operators.graphs import stored
from provenant.operators.snapshots import tree_at
from provenant.sources.terms import filter_words, may_hold, starts_of

#: Extensions and exact names that count as source, and folders that never do (the caller may pass others).
EXTENSIONS = (".py", ".js", ".ts", ".tsx", ".jsx", ".go", ".java", ".rb", ".rs", ".php", ".cs", ".c", ".cpp", ".h", ".kt", ".scala", ".sql", ".yaml", ".yml", ".json", ".toml")
NAMES = ("Dockerfile", "Makefile", "Gemfile")
IGNORED = (".git", "node_modules", "vendor", "dist", "build", "__pycache__", ".venv")


def glob_regex(pattern: str) -> str:
    """A file-name pattern whose * and ? match any character, / too, as a regex for the whole path."""
    import re

    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$"


def admitted(path: Column, size: Column, exclude: list[str], most_bytes: int, extensions=EXTENSIONS, names=NAMES, ignored=IGNORED) -> Column:
    """The predicate for one relative path: also that of a listing."""
    parts, name = F.split(path, "/"), F.element_at(F.split(path, "/"), -1)
    ok = (size <= most_bytes) & (F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).isin(*extensions) | name.isin(*names))
    ok = ok & ~F.arrays_overlap(parts, F.lit(list(ignored)))
    for pattern in exclude:
        ok = ok & ~path.rlike(glob_regex(pattern))
    return ok


def read_tree(spark: SparkSession, root: str, exclude: list[str] | None = None, most_bytes: int = 1_000_000) -> DataFrame:
    """``path, size_bytes, content_hash, content`` of the admitted files below a folder, on any store that Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    at = F.expr(f"substring(path, instr(path, '{base}') + {len(base) + 1})")
    rows = files.select(at.alias("path"), F.col("length").alias("size_bytes"), "content")
    kept = rows.where(admitted(F.col("path"), F.col("size_bytes"), exclude or [], most_bytes))
    return kept.select("path", "size_bytes", F.sha2("content", 256).alias("content_hash"), F.decode("content", "UTF-8").alias("content"))


def listing(files: DataFrame, n: int) -> DataFrame:
    return files.select("path").orderBy("path").limit(n)


def is_sensitive(path: Column) -> Column:
    """Environment files, keys and key stores."""
    return F.lower(F.element_at(F.split(path, "/"), -1)).rlike(r"^\.env(\..*)?$|\.(pem|key|p12|pfx|jks|keystore)$|^id_(rsa|dsa|ecdsa|ed25519)$|^(credentials|\.npmrc|\.pypirc|\.netrc)$")


def is_generated(path: Column) -> Column:
    return F.lower(path).rlike(r"(^|/)(dist|build|generated|__generated__)/|\.min\.(js|css)$|\.(lock|map)$|_pb2\.py$|\.g\.dart$")


def dedupe_references(refs: DataFrame, fields: list[str], cap: int, per: str) -> DataFrame:
    """References once each, at their first place, the first ``cap`` of each file."""
    once = refs.groupBy(*fields).agg(F.min("ord").alias("ord"))
    return once.withColumn("_rn", F.row_number().over(Window.partitionBy(per).orderBy("ord"))).where(F.col("_rn") <= cap).drop("_rn")


#: A route's registration: its method and path.
ROUTE = r"\b(?:app|router|api|server|routes)\.(get|post|put|patch|delete|head|options|all)\(\s*[\"']([^\"']+)"


def routes(lines: DataFrame) -> DataFrame:
    """``lines(path, line_no, text)`` -> route registrations ``path, line_no, route`` (METHOD path). Approximate: by text, not by syntax."""
    method, at = F.upper(F.regexp_extract("text", ROUTE, 1)), F.regexp_extract("text", ROUTE, 2)
    return lines.where(F.col("text").rlike(ROUTE)).select("path", "line_no", F.concat_ws(" ", method, at).alias("route"))


def text_lines(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """One row for each line, numbered from 1."""
    return files.select(path, F.posexplode(F.split(content, "\n")).alias("_n", "text")).select(path, (F.col("_n") + 1).alias("line_no"), "text")


MOST_TERMS, MOST_TERM_CHARS = 20, 2000
#: Bytes of terms that are broadcast together, as one automaton, and of the filter that stands for more (a power of two).
TERM_BYTES, FILTER_BYTES = 4 << 20, 32 << 20


def valid_query(terms: Column) -> Column:
    """One to twenty terms, none empty, too long or with a line end or NUL."""
    return F.size(terms).between(1, MOST_TERMS) & F.forall(terms, lambda t: F.length(t).between(1, MOST_TERM_CHARS) & ~t.rlike(r"[\r\n\x00]"))


def _term_batches(batches: Iterator[pa.RecordBatch], terms) -> Iterator[pa.RecordBatch]:
    """Texts -> each text's row number in the batch's ids and the terms that it holds, by one Aho-Corasick automaton."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for term in terms.value:
        automaton.add_word(term, term)
    automaton.make_automaton()
    for batch in batches:
        at, hits = [], []
        for i, text in enumerate(batch.column("_text").to_pylist()):
            if text:
                found = {term for _, term in automaton.iter(text)}
                at += [i] * len(found)
                hits += found
        rows = batch.take(pa.array(at, type=pa.int64())).drop_columns(["_text"])
        yield rows.append_column("_term", pa.array(hits, type=pa.string()))


def terms_in(texts: DataFrame, terms: DataFrame, text: str, at_once: int = TERM_BYTES, most: int = FILTER_BYTES) -> DataFrame:
    """``texts``, ``terms(term)`` -> the columns of ``texts`` but for ``text``, and ``term``: each distinct term that a text holds, as it stands.

    Up to about ``at_once`` bytes of terms are one automaton. More become a filter of their hashes, with a byte or more for each and each of their starts: a text is
    read once, and what passes is joined with the terms. Only terms beyond ``most`` bytes of filter are dealt by a hash into rounds of that size. So the work is
    that of the text and its hits, not of the number of terms. Null and empty texts and terms hit nothing.
    """
    spark = texts.sparkSession
    distinct = terms.where("term <> ''").select("term").distinct()
    kept = [c for c in texts.columns if c != text]
    kind = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name != text), "_term string"])
    rows = texts.select(*kept, F.col(text).alias("_text"))
    if (distinct.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0) <= at_once:
        known = spark.sparkContext.broadcast([r[0] for r in distinct.toLocalIterator()])  # about at_once bytes
        return rows.mapInArrow(lambda b: _term_batches(b, known), kind).withColumnRenamed("_term", "term")
    distinct = stored(distinct)
    sizes = {r[0]: r[1] for r in distinct.groupBy(F.octet_length("term")).count().collect()}
    lengths, starts = sorted(sizes), starts_of(sizes)
    entries = sum(n * (1 + sum(start <= size for start in starts)) for size, n in sizes.items())
    rounds = -(-entries // most)
    words = min(most >> 3, 1 << max(10, (entries // rounds // 4).bit_length()))  # 16 to 32 bits for an entry, 8 at least
    parts = []
    for i in range(rounds):
        own = distinct.where(F.pmod(F.xxhash64("term"), F.lit(rounds)) == i) if rounds > 1 else distinct
        ones = own.mapInArrow(lambda b: filter_words(b, starts, words), "word long, ones long").groupBy("word").agg(F.bit_or("ones").alias("ones")).toArrow()
        bits = np.zeros(words, dtype=np.uint64)
        bits[ones.column("word").to_numpy()] = ones.column("ones").to_numpy().view(np.uint64)
        known = spark.sparkContext.broadcast(bits)  # most bytes at the most
        found = rows.mapInArrow(lambda b, k=known: may_hold(b, starts, lengths, k), kind)
        parts.append(found.join(own, F.col("_term") == F.col("term")).drop("_term"))
    return reduce(DataFrame.unionByName, parts)


def search(lines: DataFrame, queries: DataFrame, path: str, cap: int, regex: bool = False) -> tuple[DataFrame, DataFrame]:
    """``lines(path, line_no, text)``, ``queries(query_id, terms)`` -> hits ``query_id, path, line_no, truncated`` and the invalid queries.

    Lines are read where they lie; hits are joined with the queries of their terms. A line that holds any term is a hit; the first ``cap`` of a query
    stay and say whether more were there. Patterns (``regex``) are tried one by one on every line, as no index serves them all.
    """
    good = queries.where(valid_query(F.col("terms")))
    terms = good.select("query_id", F.explode("terms").alias("term")).distinct()
    if regex:
        hits = lines.join(terms, F.regexp_like("text", F.col("term")))
    else:
        hits = terms_in(lines.select(path, "line_no", "text"), terms, "text").join(terms, "term")
    w = Window.partitionBy("query_id")
    ranked = hits.select("query_id", path, "line_no").distinct().withColumn("_rn", F.row_number().over(w.orderBy(path, "line_no"))).withColumn("truncated", F.count(F.lit(1)).over(w) > cap)
    return ranked.where(F.col("_rn") <= cap).drop("_rn"), queries.where(~F.coalesce(valid_query(F.col("terms")), F.lit(False)))


def name_status(lines: DataFrame) -> DataFrame:
    """``lines(line_no, text)`` of a name-status listing -> ``status, path, old_path``; renames and copies keep the old path."""
    parts = F.split("text", "\t")
    kind = F.left(parts[0], F.lit(1))
    moved = kind.isin("R", "C")
    names = F.create_map(*[F.lit(x) for p in (("A", "added"), ("M", "modified"), ("D", "deleted"), ("R", "renamed"), ("C", "copied"), ("T", "modified")) for x in p])
    return lines.where(F.size(parts) >= 2).select(
        F.coalesce(F.try_element_at(names, kind), F.lit("modified")).alias("status"), F.when(moved, F.get(parts, 2)).otherwise(parts[1]).alias("path"),
        F.when(moved, parts[1]).alias("old_path"),
    )


def diff_hunks(lines: DataFrame, key: str) -> DataFrame:
    """``lines(key, line_no, text)`` of unified diffs -> ``key, path, hunk, old_start, old_lines, new_start, new_lines, added, removed``.

    Lines are sessionised by running counts of file and hunk headers. A length left out means 1; a deleted file keeps its old path.
    """
    upto, file = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy(key, "_f")
    head = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    text = F.col("text")
    is_file, is_hunk = text.startswith("diff --git "), text.startswith("@@ -") & text.rlike(head)
    rows = lines.where(F.col(key).isNotNull()).withColumn("_f", F.count_if(is_file).over(upto)).withColumn("_h", F.count_if(is_hunk).over(upto))
    new = F.when(text.startswith("+++ ") & ~text.endswith("/dev/null"), F.regexp_replace("text", r"^\+\+\+ (b/)?", ""))
    old = F.when(text.startswith("--- ") & ~text.endswith("/dev/null"), F.regexp_replace("text", "^--- (a/)?", ""))

    def body(sign: str) -> Column:
        own = F.when(text.startswith(sign) & ~text.startswith(sign * 3), F.struct("line_no", F.expr("substring(text, 2)").alias("t")))
        return F.transform(F.array_sort(F.collect_list(own)), lambda s: s["t"])

    # what comes between two headers is one group, so lines are ordered and grouped once; a file's names are in one of its groups
    parts = rows.groupBy(key, "_f", "_h").agg(
        F.max(F.when(is_hunk, text)).alias("_head"), F.max(new).alias("_new"), F.max(old).alias("_old"), body("+").alias("added"), body("-").alias("removed"))
    hunks = parts.withColumn("path", F.coalesce(F.max("_new").over(file), F.max("_old").over(file))).where("_head IS NOT NULL")

    def part(i: int) -> Column:
        return F.regexp_extract("_head", head, i)

    def length(i: int) -> Column:
        return F.when(part(i) == "", 1).otherwise(part(i).try_cast("int"))

    return hunks.select(
        key, "path", F.col("_h").alias("hunk"), part(1).cast("int").alias("old_start"), length(2).alias("old_lines"), part(3).cast("int").alias("new_start"), length(4).alias("new_lines"), "added", "removed")


SARIF = """runs array<struct<tool:struct<driver:struct<name:string,rules:array<struct<id:string,name:string,helpUri:string>>>>,
results:array<struct<ruleId:string,level:string,message:struct<text:string>,
locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,endLine:int>>>>>>>>"""
LEVELS = {"error": "high", "warning": "medium", "note": "low", "none": "info"}


def read_sarif(spark: SparkSession, path: str, confidence: float = 0.70) -> DataFrame:
    """One row for each result: rule (by id), severity of its level, first location, default confidence. Malformed files fail."""
    from provenant.functions.text import lookup

    doc = spark.read.schema(SARIF).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    runs = doc.select(F.posexplode("runs").alias("run", "_r"))
    results = runs.select("run", F.posexplode("_r.results").alias("result", "_x"), F.col("_r.tool.driver.rules").alias("_rules"))
    rule = F.get(F.filter(F.coalesce("_rules", F.array()), lambda r: r["id"] == F.col("_x.ruleId")), 0)
    at = F.get(F.col("_x.locations"), 0)["physicalLocation"]
    return results.select(
        "run", "result", F.col("_x.ruleId").alias("rule_id"), rule["name"].alias("rule_name"),
        lookup(F.col("_x.level"), LEVELS, "medium").alias("severity"), F.col("_x.message.text").alias("title"),
        F.regexp_replace(at["artifactLocation"]["uri"], "^file://", "").alias("path"), at["region"]["startLine"].alias("start_line"),
        F.coalesce(at["region"]["endLine"], at["region"]["startLine"]).alias("end_line"), F.lit(confidence).alias("confidence"),
    )


def read_reports(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON objects, one a file, against a fixed schema; anything else fails."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def normalise_graph(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """Raw ``nodes(id, label, path, line)``, ``edges(source, target, relation, confidence)``, ``files(path, line_count)`` -> tables.

    ``nodes`` (located, portable ``node_id``), ``edges`` (both ends known), ``errors`` (id, reason: duplicate id, path not admitted, line outside the file),
    ``unresolved`` (edges with a missing end), ``unindexed`` (files without a node).
    """
    f = files.select(F.col("path").alias("_p"), "line_count")
    checked = nodes.join(f, F.col("path") == F.col("_p"), "left").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("id")))
    placed = F.col("path").isNotNull() & F.col("line").isNotNull()
    reason = F.when(F.col("_n") > 1, "duplicate id").when(placed & F.col("_p").isNull(), "path not admitted").when(placed & ~F.col("line").between(1, F.col("line_count")), "line outside the file")
    marked = checked.withColumn("reason", reason)
    w = Window.partitionBy("path", "label").orderBy("line", "id")
    good = marked.where(placed & F.col("reason").isNull()).withColumn("_occ", F.row_number().over(w) - 1)
    portable = F.concat(F.lit("node-"), F.left(F.sha2(F.concat_ws(":", "path", "label", F.col("_occ").cast("string")), 256), F.lit(32)))
    known = good.select("id", portable.alias("node_id"), "label", "path", "line")
    ids = known.select("id", "node_id")
    ends = edges.join(ids.select(F.col("id").alias("source"), F.col("node_id").alias("source_id")), "source", "left").join(
        ids.select(F.col("id").alias("target"), F.col("node_id").alias("target_id")), "target", "left")
    both = F.col("source_id").isNotNull() & F.col("target_id").isNotNull()
    edge_id = F.sha2(F.concat_ws("\x1d", "source_id", "target_id", "relation"), 256)
    return {
        "nodes": known.drop("id"), "edges": ends.where(both).select(edge_id.alias("edge_id"), "source_id", "target_id", "relation", "confidence"),
        "errors": marked.where("reason IS NOT NULL").select("id", "reason").distinct(), "unresolved": ends.where(~both).select("source", "target", "relation"),
        "unindexed": files.select("path").join(known.select("path").distinct(), "path", "left_anti"),
    }


def blobs(requests: DataFrame, parents: DataFrame, changes: DataFrame, most_chars: int) -> DataFrame:
    """``requests(revision, path)`` -> ``revision, path, content, truncated``: files as they were at a revision, cut to a size and saying so; none where
    there was no such file. ``parents(revision, parent)`` and ``changes(revision, path, content)`` as for ``snapshots.tree_at``."""
    wanted = requests.select("revision", "path").distinct()
    asked = wanted.select(F.col("path").alias("_p")).distinct()
    tree = tree_at(wanted, parents, changes.join(asked, F.col("path") == F.col("_p"), "left_semi"))
    return tree.join(wanted, ["revision", "path"], "left_semi").select("revision", "path", F.substring("content", 1, most_chars).alias("content"), (F.length("content") > most_chars).alias("truncated"))
