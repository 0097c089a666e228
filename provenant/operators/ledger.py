"""Records around a review: get-or-create, ledgers with revisions, links, reads, and what is handed from one stage to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenant.functions import text as T
from provenant.functions.ids import joined
from provenant.operators.joins import latest
from provenant.operators.overlay import insert_absent, update_columns


def get_or_create(stored: DataFrame, incoming: DataFrame, key: list[str], identity: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The stored rows with the first request of each new key; and the keys that came with another identity than the row they met.

    Serves codebases, snapshots, scans, bases by (repository, commit), plans and tasks: whoever comes first creates, equals reuse, others are refused.
    """
    rest = [c for c in stored.columns if c not in key]
    first = incoming.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")
    rows = stored.unionByName(first.join(stored.select(*key), key, "left_anti"))
    here = rows.select(*key, F.struct(*identity).alias("_here"))
    refused = incoming.select(*key, F.struct(*identity).alias("_new")).join(here, key).where(~F.col("_new").eqNullSafe(F.col("_here"))).select(*key).distinct()
    return rows, refused


def with_defaults(keys: DataFrame, stored: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Settings of each key, defaults where none are stored: tenant controls, versions of a policy."""
    s = stored.select(F.col(key).alias("_k"), *defaults)
    return keys.join(s, F.col(key) == F.col("_k"), "left").select(key, *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in defaults.items()])


def set_controls(stored: DataFrame, changes: DataFrame, key: str, limits: list[str]) -> DataFrame:
    """Upsert of limits; one that is not above zero is an error."""
    bad = " OR ".join(f"{c} <= 0" for c in limits)
    if changes.where(bad).limit(1).count():
        raise ValueError("limits must be above zero")
    return update_columns(stored, changes, [key], limits)


def over_quota(events: DataFrame, key: str, amount: str, limits: DataFrame) -> DataFrame:
    """``limits(key, limit)`` -> ``key, used, exceeded``: the limit counts as reached at equality; no usage is 0."""
    used = events.groupBy(F.col(key).alias("_k")).agg(F.sum(amount).alias("_u"))
    return limits.join(used, F.col(key) == F.col("_k"), "left").select(key, F.coalesce("_u", F.lit(0)).alias("used"), (F.coalesce("_u", F.lit(0)) >= F.col("limit")).alias("exceeded"))


def append_usage(stored: DataFrame, events: DataFrame, key: list[str], amounts: list[str]) -> DataFrame:
    """Usage events are appended once per key, over quota or not; a negative amount is an error."""
    if events.where(" OR ".join(f"{c} < 0" for c in amounts)).limit(1).count():
        raise ValueError("usage must not be negative")
    return insert_absent(stored, events, key)


def context_document(rows: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """``key, document, content_hash``: the parts as JSON in the order of their names, nulls kept, and its hash."""
    document = F.to_json(F.struct(*sorted(parts)), {"ignoreNullFields": "false"})
    return rows.select(key, document.alias("document"), F.sha2(document, 256).alias("content_hash"))


def advance(ledger: DataFrame, requests: DataFrame, key: str, order: list[str], moves: dict[str, tuple[str, ...]]) -> DataFrame:
    """``ledger(key, state, revision)``, ``requests(key, target, expected)`` -> ``key, state, revision, n_applied``.

    In order, a request counts only if it names the revision that stands and the state may be followed by its target; each such one raises the revision.
    """
    allowed = F.lit([f"{a}>{b}" for a, to in moves.items() for b in to])
    seq = F.transform(F.array_sort(F.collect_list(F.struct(*order, "target", "expected"))), lambda r: F.struct(r["target"].alias("t"), r["expected"].alias("e")))
    asked = requests.groupBy(F.col(key).alias("_k")).agg(seq.alias("_q"))
    zero = F.struct(F.col("state").alias("s"), F.col("revision").cast("long").alias("r"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, q: Column) -> Column:
        ok = (q["e"] == acc["r"]) & F.array_contains(allowed, F.concat_ws(">", acc["s"], q["t"]))
        return F.struct(F.when(ok, q["t"]).otherwise(acc["s"]).alias("s"), (acc["r"] + F.when(ok, 1).otherwise(0)).alias("r"), (acc["n"] + F.when(ok, 1).otherwise(0)).alias("n"))

    both = ledger.join(asked, F.col(key) == F.col("_k"), "left")
    none = F.array().cast("array<struct<t:string,e:bigint>>")
    return both.withColumn("_a", F.aggregate(F.coalesce("_q", none), zero, step)).select(key, F.col("_a.s").alias("state"), F.col("_a.r").alias("revision"), F.col("_a.n").alias("n_applied"))


def versions_conflicting(writes: DataFrame, key: list[str], content: str) -> DataFrame:
    """Idempotent version writes: ``*key, content, conflict``: a version that came again with the same content is one row, with other content a conflict."""
    return writes.groupBy(*key).agg(F.min(content).alias(content), (F.count_distinct(content) > 1).alias("conflict"))


def link_symbols(links: DataFrame, found: DataFrame, symbols: DataFrame) -> DataFrame:
    """``links`` and ``found(finding, symbol)`` -> links with the current hash of each known symbol; unknown ones are ignored."""
    known = found.select("finding", "symbol").distinct().join(symbols.select("symbol", "dependency_hash"), "symbol").select("finding", "symbol", "dependency_hash")
    return update_columns(links.select("finding", "symbol", "dependency_hash"), known, ["finding", "symbol"], ["dependency_hash"])


def reloaded_graphs(edges: DataFrame, stored: DataFrame) -> DataFrame:
    """``edges(graph, edge_id)``, ``stored(graph, identity)`` -> ``graph, matches``: whether the identity recomputed from the edges is the stored one.

    The identity is order-free: a count and sums of two independent hashes of the distinct ids, so that no graph is gathered in one task.
    """
    return stored.join(graph_identity(edges).withColumnRenamed("identity", "_i"), "graph", "left").select("graph", F.col("identity").eqNullSafe(F.col("_i")).alias("matches"))


def graph_identity(edges: DataFrame) -> DataFrame:
    """``graph, identity``."""
    digest = F.sha2(F.col("edge_id").cast("string"), 256)
    half = lambda at: F.conv(F.substring(digest, at, 12), 16, 10).cast("decimal(38,0)")
    once = edges.select("graph", "edge_id").distinct()
    g = once.groupBy("graph").agg(F.count(F.lit(1)).alias("n"), F.sum(half(1)).alias("a"), F.sum(half(13)).alias("b"))
    return g.select("graph", F.concat_ws(":", "n", "a", "b").alias("identity"))


def symbol_rows(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """``files(path, lines)``, ``symbols(path, name, start_line, end_line)`` -> ``path, name, start_line, end_line, content``: the lines of each symbol.

    A file without a symbol stands for one: itself, whole.
    """
    f = files.select(F.col("path").alias("_p"), "lines")
    start, end = F.greatest(F.lit(1), "start_line"), F.least(F.size("lines"), "end_line")
    text = F.array_join(F.slice("lines", start, F.greatest(F.lit(0), end - start + 1)), "\n")
    own = symbols.join(f, F.col("path") == F.col("_p")).select("path", "name", start.alias("start_line"), end.alias("end_line"), text.alias("content"))
    bare = files.join(symbols.select("path").distinct(), "path", "left_anti").select("path", F.col("path").alias("name"), F.lit(1).alias("start_line"), F.size("lines").alias("end_line"), F.array_join("lines", "\n").alias("content"))
    return own.unionByName(bare)


def fallback(requests: DataFrame, answers: DataFrame, otherwise: DataFrame) -> DataFrame:
    """``id, value, resolved``: the answers; for requests without one what the second look found, which stays unresolved."""
    rest = otherwise.join(answers.select("id").distinct(), "id", "left_anti").join(requests.select("id"), "id", "left_semi")
    return answers.select("id", "value", F.lit(True).alias("resolved")).unionByName(rest.select("id", "value", F.lit(False).alias("resolved")))


def summaries_for(summaries: DataFrame, paths: DataFrame, most_facts: int, most: int) -> DataFrame:
    """``summaries(summary_id, ord, facts: array<struct<path, fact>>)`` -> the first ``most`` with their facts in the given paths, at most ``most_facts`` each."""
    first = summaries.orderBy("ord").limit(most)
    each = first.select("summary_id", F.posexplode("facts").alias("_n", "_f")).select("summary_id", "_n", "_f.path", "_f.fact").join(paths.select("path").distinct(), "path", "left_semi")
    ranked = each.withColumn("_rn", F.row_number().over(Window.partitionBy("summary_id").orderBy("_n"))).where(F.col("_rn") <= most_facts)
    facts = ranked.groupBy("summary_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "fact"))), lambda s: s["fact"]).alias("facts"))
    return first.select("summary_id").join(facts, "summary_id", "left").select("summary_id", F.coalesce("facts", F.array().cast("array<string>")).alias("facts"))


def ungrounded(surfaces: DataFrame, targets: DataFrame, nodes: DataFrame) -> DataFrame:
    """``surfaces(surface_id, node_id, path, start_line, end_line, hash)`` that break a rule: ``surface_id, reason``.

    Its node must be a target, its location must carry the node's hash and cover the node's line. Empty: all are grounded.
    """
    t = targets.select(F.col("node_id").alias("_t")).distinct()
    n = nodes.select(F.col("node_id").alias("_n"), F.col("path").alias("_p"), "line", "source_hash")
    both = surfaces.join(t, F.col("node_id") == F.col("_t"), "left").join(n, F.col("node_id") == F.col("_n"), "left")
    covers = F.col("path").eqNullSafe(F.col("_p")) & F.col("line").between(F.col("start_line"), F.col("end_line"))
    reason = F.when(F.col("_t").isNull() | F.col("_n").isNull(), "outside the targets").when(~F.col("hash").eqNullSafe(F.col("source_hash")), "other source").when(~F.coalesce(covers, F.lit(False)), "line not covered")
    return both.withColumn("reason", reason).where("reason IS NOT NULL").select("surface_id", "reason").distinct()


def exact_target(a: Column, b: Column) -> Column:
    """Two arrays hold the same set."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def rebound(investigations: DataFrame, bindings: DataFrame) -> DataFrame:
    """``investigations(investigation_id, target, question, state)``, ``bindings(old, new)``: after targets got new ids, ids are hashed anew and the work starts again."""
    b = bindings.select(F.col("old").alias("_o"), F.col("new").alias("_n"))
    both = investigations.join(b, F.col("target") == F.col("_o"), "left")
    target = F.coalesce("_n", "target")
    moved = F.col("_n").isNotNull()
    fresh = F.concat(F.lit("inv-"), F.left(F.sha2(joined([target, F.col("question")], "\x1d"), 256), F.lit(32)))
    return both.select(F.when(moved, fresh).otherwise(F.col("investigation_id")).alias("investigation_id"), target.alias("target"), "question", F.when(moved, "planned").otherwise(F.col("state")).alias("state"))


def region_tasks(regions: DataFrame, route_tasks: DataFrame, path_tasks: DataFrame) -> DataFrame:
    """``regions(region_id, route, path)`` -> ``region_id, task_ids``: by route where the region has one, else by path; a route without a match gets none."""
    r = route_tasks.select(F.col("route").alias("_r"), F.col("task_id").alias("_rt"))
    p = path_tasks.select(F.col("path").alias("_p"), F.col("task_id").alias("_pt"))
    by_route = regions.where("route IS NOT NULL").join(r, F.col("route") == F.col("_r"), "left").select("region_id", F.col("_rt").alias("task"))
    by_path = regions.where("route IS NULL").join(p, F.col("path") == F.col("_p"), "left").select("region_id", F.col("_pt").alias("task"))
    return by_route.unionByName(by_path).groupBy("region_id").agg(F.array_sort(F.collect_set("task")).alias("task_ids"))


def related_facts(asked: DataFrame, tables: dict[str, tuple[DataFrame, str, str]], cap: int) -> DataFrame:
    """``asked(key)`` -> ``key, kind, rank, fact``: from each table (rows, its key column, its text column) the first ``cap`` facts of the key."""
    every = None
    for kind, (df, on, fact) in tables.items():
        part = df.select(F.col(on).alias("key"), F.lit(kind).alias("kind"), F.col(fact).cast("string").alias("fact")).distinct()
        every = part if every is None else every.unionByName(part)
    near = every.join(asked.select("key").distinct(), "key", "left_semi")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("key", "kind").orderBy("fact")).cast("long"))
    return ranked.where(F.col("rank") <= cap)


def preserved(evidence: DataFrame, regions: DataFrame) -> DataFrame:
    """``evidence(id, path, start_line, end_line, excerpt)``: the excerpt is blanked where one region of ``regions(path, start_line, end_line)`` holds all of it."""
    r = regions.select(F.col("path").alias("_p"), F.col("start_line").alias("_s"), F.col("end_line").alias("_e"))
    held = evidence.join(r, (F.col("path") == F.col("_p")) & (F.col("_s") <= F.col("start_line")) & (F.col("_e") >= F.col("end_line")), "left_semi").select(F.col("id").alias("_h")).distinct()
    return evidence.join(held, F.col("id") == F.col("_h"), "left").select("id", "path", "start_line", "end_line", F.when(F.col("_h").isNull(), F.col("excerpt")).otherwise("").alias("excerpt"))


def surface_obligations(worksets: DataFrame) -> DataFrame:
    """One required obligation for each workset: ``workset_id, canonical_id, importance``."""
    return worksets.select("workset_id").distinct().select("workset_id", F.sha2(F.concat_ws("\x1d", F.lit("surface"), "workset_id"), 256).alias("canonical_id"), F.lit("REQUIRED").alias("importance"))


def numbered_window(content: Column) -> Column:
    """The span of a context whose lines begin with their numbers (``12: text``): struct(start_line, end_line); null without a numbered line."""
    numbers = F.transform(F.regexp_extract_all(content, F.lit(r"(?m)^\s*(\d{1,9}):"), F.lit(1)), lambda n: n.cast("int"))
    return F.when(F.size(numbers) > 0, F.struct(F.array_min(numbers).alias("start_line"), F.array_max(numbers).alias("end_line")))


def observations(planned: DataFrame, observed: DataFrame) -> DataFrame:
    """Every planned (region, obligation) with its status, UNRESOLVED where nothing was said."""
    o = observed.groupBy(F.col("region_id").alias("_r"), F.col("canonical_id").alias("_c")).agg(F.max("status").alias("_s"))
    both = planned.join(o, (F.col("region_id") == F.col("_r")) & (F.col("canonical_id") == F.col("_c")), "left")
    return both.select("region_id", "canonical_id", F.coalesce("_s", F.lit("UNRESOLVED")).alias("status"))


def inventory(surfaces: DataFrame, area: str, order: list[str], limit: int) -> DataFrame:
    """A balanced sample of surfaces by area with the area's count and how many were left out."""
    from provenant.operators.ranking import balanced_sample

    chosen = balanced_sample(surfaces, area, order, limit).drop("truncated")
    n = surfaces.groupBy(F.col(area).alias("_a")).agg(F.count(F.lit(1)).alias("n_area"))
    kept = chosen.groupBy(F.col(area).alias("_b")).agg(F.count(F.lit(1)).alias("_kept"))
    counts = n.join(kept, F.col("_a") == F.col("_b")).select("_a", "n_area", (F.col("n_area") - F.col("_kept")).alias("n_omitted"))
    return chosen.join(counts, F.col(area) == F.col("_a")).drop("_a")


def retrieval_text(scope: Column, own: Column, ecosystem: Column, topic: Column) -> Column:
    """The text to search knowledge for: the topic, with the codebase's own terms in its scope or the ecosystem's otherwise; nulls and blanks left out."""
    extra = F.when(scope == "codebase", own).otherwise(ecosystem)
    parts = F.filter(F.array(topic, extra), lambda p: F.coalesce(F.trim(p) != "", F.lit(False)))
    return F.array_join(parts, " ")


def cited(entries: DataFrame, citations: DataFrame) -> DataFrame:
    """Entries whose URL, normalised, was cited."""
    c = citations.select(T.url_text(F.col("url")).alias("_u")).distinct()
    return entries.withColumn("_v", T.url_text(F.col("url"))).join(c, F.col("_v") == F.col("_u"), "left_semi").drop("_v")


def add_knowledge(stored: DataFrame, new: DataFrame, tenant: str, text: str) -> DataFrame:
    """Content-addressed: an entry is new if no stored one of the tenant has its hash; of equal new ones the first by text."""
    return insert_absent(stored, new.withColumn("content_hash", F.sha2(T.plain_text(F.col(text)), 256)), [tenant, "content_hash"])


def unit_counts(units: DataFrame) -> DataFrame:
    """``stage, n, n_completed, n_retryable, last_key``: what a journal holds, by stage."""
    return units.groupBy("stage").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "completed").alias("n_completed"), F.count_if(F.col("status") == "failed_retryable").alias("n_retryable"), F.max("unit_key").alias("last_key"))


def report_rows(findings: DataFrame) -> DataFrame:
    """Findings as the versioned nested rows of a report: ``finding_id, schema_version, evidence, decision``."""
    return findings.select(
        "finding_id", F.lit(1).alias("schema_version"), F.struct("path", "start_line", "end_line").alias("evidence"), F.struct(F.lower("severity").alias("severity"), T.clamp(F.col("confidence")).alias("confidence")).alias("decision"))


def attempt_finished(attempts: DataFrame, results: DataFrame) -> DataFrame:
    """``attempts(key, owner, state)``, ``results(key, owner, ok)``: only the owner of a running attempt may end it. Adds ``updated``."""
    r = results.select(F.col("key").alias("_k"), F.col("owner").alias("_o"), "ok").dropDuplicates(["_k", "_o"])
    both = attempts.join(r, (F.col("key") == F.col("_k")) & F.col("owner").eqNullSafe(F.col("_o")), "left")
    mine = F.col("_k").isNotNull() & (F.col("state") == "running")
    return both.select("key", "owner", F.when(mine & F.col("ok"), "completed").when(mine, "failed").otherwise(F.col("state")).alias("state"), mine.alias("updated"))


def extended_baseline(baseline: DataFrame, branch: DataFrame, changed: DataFrame) -> DataFrame:
    """The baseline and the branch's open findings that it lacks, kept if their path is among the changed ones, under its old or new name.

    ``baseline, branch(finding, path, status)``, ``changed(path, old_path)``.
    """
    extra = branch.where("status = 'open'").join(baseline.select("finding"), "finding", "left_anti")
    names = changed.select(F.explode(F.array_compact(F.array("path", "old_path"))).alias("path")).distinct()
    return baseline.unionByName(extra).join(names, "path", "left_semi").select("finding", "path", "status")


def trimmed_window(lines: Column, most_lines: int, most_chars: int) -> Column:
    """Blank lines at both ends go, then lines beyond a number, then whole lines beyond a number of characters."""
    solid = F.filter(F.transform(lines, lambda t, i: F.when(F.trim(t) != "", i)), lambda i: i.isNotNull())
    inner = F.when(F.size(solid) > 0, F.slice(lines, F.array_min(solid) + 1, F.array_max(solid) - F.array_min(solid) + 1)).otherwise(F.slice(lines, 1, 0))
    few = F.slice(inner, 1, most_lines)
    sizes = F.aggregate(few, F.struct(F.lit(0).alias("n"), F.lit(0).alias("k")), lambda acc, t: F.struct((acc["n"] + F.length(t) + 1).alias("n"), (acc["k"] + F.when(acc["n"] + F.length(t) + 1 <= most_chars, 1).otherwise(0)).alias("k")))
    return F.slice(few, F.lit(1), sizes["k"])


def context_records(records: DataFrame, paths: DataFrame) -> DataFrame:
    """``records(prefix, value)``, ``paths(path)`` -> ``path, value`` of the longest prefix that is the path or a folder above it; null: none."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    each = paths.select("path").distinct().select("path", F.explode(above).alias("_x"))
    best = each.join(records, F.col("_x") == F.col("prefix")).groupBy(F.col("path").alias("_p")).agg(F.max_by("value", F.struct(F.length("prefix"), "value")).alias("value"))
    return paths.select("path").distinct().join(best, F.col("path") == F.col("_p"), "left").select("path", "value")


def cached(entries: DataFrame, version: int) -> DataFrame:
    """Entries of the current version; any other is a miss."""
    return entries.where((F.col("version") == version) & F.col("payload").isNotNull())


def adapted_candidates(candidates: DataFrame, schema: str, files: DataFrame, least_depth: str, depths: list[str]) -> tuple[DataFrame, DataFrame]:
    """``candidates(id, payload)`` parsed by ``schema`` (with path, line, depth) -> good ones, depth raised to the least; and gaps ``id, reason``.

    A payload that is no such object, or that lies outside its file, is dropped and leaves a gap, which clears the coverage of its review.
    """
    parsed = candidates.withColumn("_c", F.from_json("payload", schema, {"mode": "PERMISSIVE"}))
    f = files.select(F.col("path").alias("_p"), "line_count")
    both = parsed.join(f, F.col("_c.path") == F.col("_p"), "left")
    bad = F.when(F.col("_c.path").isNull() | F.col("_c.line").isNull(), "malformed").when(F.col("_p").isNull() | ~F.col("_c.line").between(1, F.col("line_count")), "not anchored")
    rank = F.greatest(F.array_position(F.lit(depths), F.coalesce("_c.depth", F.lit(depths[0]))), F.array_position(F.lit(depths), F.lit(least_depth)))
    marked = both.withColumn("reason", bad)
    good = marked.where("reason IS NULL").select("id", "_c.path", "_c.line", F.element_at(F.lit(depths), rank.cast("int")).alias("depth"))
    return good, marked.where("reason IS NOT NULL").select("id", "reason")


def record_activity(stored: DataFrame, new: DataFrame, allowed: list[str]) -> DataFrame:
    """``(idempotency_key, at, metadata: map)``: one row a key, metadata merged in time, later values over earlier ones; other names are left out."""
    both = stored.unionByName(new).select("idempotency_key", "at", F.explode_outer(F.map_filter("metadata", lambda k, v: k.isin(*allowed))).alias("_k", "_v"))
    values = both.where("_k IS NOT NULL").groupBy("idempotency_key", "_k").agg(F.max_by("_v", F.struct("at", "_v")).alias("_v"))
    merged = values.groupBy("idempotency_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias("metadata"))
    first = both.groupBy("idempotency_key").agg(F.min("at").alias("at"))
    return first.join(merged, "idempotency_key", "left").select("idempotency_key", "at", F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"))


def promoted_baseline(baseline: DataFrame, reviews: DataFrame, findings: DataFrame) -> DataFrame:
    """Every finding of a completed, merged review becomes an open baseline row at its merge revision; of several the latest counts.

    ``baseline(finding, status, revision)``, ``reviews(review, state, merge_revision)``, ``findings(review, finding)``.
    """
    done = reviews.where("state = 'completed' AND merge_revision IS NOT NULL")
    rows = findings.join(done, "review").select("finding", F.lit("open").alias("status"), F.col("merge_revision").alias("revision"))
    return update_columns(baseline, latest(rows, ["finding"], [F.col("revision")]), ["finding"], ["status", "revision"])


def typed_context(documents: DataFrame, schema: str) -> DataFrame:
    """``documents(id, payload)`` -> the payload's lists as typed columns; a list that is missing or no list is empty."""
    parsed = documents.select("id", F.from_json("payload", schema).alias("_c"))
    names = parsed.schema["_c"].dataType.fields
    return parsed.select("id", *[F.coalesce(F.col(f"_c.{f.name}"), F.array().cast(f.dataType)).alias(f.name) for f in names])


def continuation(requests: DataFrame, found: DataFrame, seen: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """``requests(ord, id)``, ``found(id, evidence)``, ``seen(evidence)`` -> ``id, resolved`` of the first ``most``, and whether there was any new evidence.

    A request is resolved only by evidence not seen before; of two that found the same, the earlier one is. Without new evidence the round ends.
    """
    first = requests.orderBy("ord").limit(most)
    new = found.join(seen.select("evidence").distinct(), "evidence", "left_anti").join(first.select("id", "ord"), "id").groupBy("evidence").agg(F.min_by("id", "ord").alias("id"))
    hit = new.select(F.col("id").alias("_i")).distinct()
    out = first.join(hit, F.col("id") == F.col("_i"), "left").select("id", F.col("_i").isNotNull().alias("resolved"))
    return out, not new.isEmpty()


def rebuilt_trace(evidence: DataFrame, layers: dict[str, int]) -> DataFrame:
    """``evidence(finding, role, path, start_line, end_line)`` -> ``finding, pos, role, path, start_line, end_line, complete``: distinct places by the layer of their role.

    There are no edges between them, so a rebuilt trace is never complete.
    """
    once = evidence.select("finding", "role", "path", "start_line", "end_line").distinct()
    w = Window.partitionBy("finding").orderBy(T.lookup(F.col("role"), layers, len(layers)), "path", "start_line", "end_line", "role")
    return once.withColumn("pos", (F.row_number().over(w) - 1).cast("long")).withColumn("complete", F.lit(False))


def filled_nodes(history: DataFrame, blobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A repair pass over nested history: ``history(id, revision, nodes: array<struct<path, line, code>>)``, ``blobs(revision, path, lines)``.

    Null codes are read again at the reviewed revision; nodes keep their order. -> the repaired history, and one row with counts: missing, filled.
    """
    nodes = history.select("id", "revision", F.posexplode_outer("nodes").alias("_n", "_x")).select("id", "revision", "_n", "_x.path", "_x.line", "_x.code")
    b = blobs.select(F.col("revision").alias("_r"), F.col("path").alias("_p"), "lines")
    both = nodes.join(b, (F.col("revision") == F.col("_r")) & (F.col("path") == F.col("_p")) & F.col("code").isNull(), "left")
    found = F.coalesce("code", F.try_element_at("lines", F.col("line")))
    done = both.withColumn("_f", found)
    repaired = done.groupBy("id", "revision").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("_n").isNotNull(), F.struct("_n", "path", "line", F.col("_f").alias("code"))))), lambda s: F.struct(s["path"].alias("path"), s["line"].alias("line"), s["code"].alias("code"))).alias("nodes"))
    empty = F.col("_n").isNotNull() & F.col("code").isNull()
    return repaired, done.agg(F.count_if(empty).alias("missing"), F.count_if(empty & F.col("_f").isNotNull()).alias("filled"))


def bounded_hash(fields: list[Column], most_chars: int = 2_000) -> Column:
    """Hash of an attribute record: each text cut to a size, then redacted, then hashed with the others."""
    return F.sha2(joined([T.redact(F.substring(f, 1, most_chars)) for f in fields], "\x1d"), 256)


def carried_locations(prior: DataFrame, current: DataFrame, files: DataFrame) -> DataFrame:
    """``prior(record_id, path, start_line, end_line, hash)`` that may stand in for records without locations of their own in ``current(record_id)``.

    A prior location is reused only if its file is still there under the same hash and holds its lines.
    """
    f = files.select(F.col("path").alias("_p"), "line_count", "content_hash")
    ok = F.col("hash").eqNullSafe(F.col("content_hash")) & (F.col("start_line") >= 1) & (F.col("start_line") <= F.col("end_line")) & (F.col("end_line") <= F.col("line_count"))
    return prior.join(current.select("record_id").distinct(), "record_id", "left_anti").join(f, (F.col("path") == F.col("_p")) & ok, "left_semi")
