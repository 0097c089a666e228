"""Decision functions: scan and merge policies, routing, relationships, statuses, requests for context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.functions.text import lookup
from provenant.operators.aggregates import first_by_precedence
from provenant.operators.graphs import stored

# Fixed values of the default merge policy.
BLOCKING_RELATIONSHIPS = ("INTRODUCED", "REGRESSED", "MODIFIED_EXISTING")
BLOCKING_SEVERITIES = ("critical", "high")
WARNING_SEVERITIES = ("medium", "low", "info")
MINIMUM_CONFIDENCE = 0.7
PRECEDENCE = ("BLOCK", "INCOMPLETE", "REQUIRE_SECURITY_APPROVAL", "WARN", "PASS")
DEFAULT_POLICY = {
    "blocking_relationships": BLOCKING_RELATIONSHIPS, "blocking_severities": BLOCKING_SEVERITIES, "warning_severities": WARNING_SEVERITIES,
    "minimum_verified_confidence": MINIMUM_CONFIDENCE, "existing": "PASS", "resolved": "PASS", "low_confidence": "REQUIRE_SECURITY_APPROVAL",
    "unknown_severity": "REQUIRE_SECURITY_APPROVAL", "incomplete": "INCOMPLETE", "false_positive": "PASS", "accepted_risk": "PASS",
    "decision_precedence": PRECEDENCE,
}


def validate_policy(policy: dict) -> None:
    """Every decision is a known one, the precedence holds each once, lists are not empty, severities do not overlap."""
    decisions = [policy[k] for k in ("existing", "resolved", "low_confidence", "unknown_severity", "incomplete", "false_positive", "accepted_risk")]
    if sorted(policy["decision_precedence"]) != sorted(PRECEDENCE) or not set(decisions) <= set(PRECEDENCE):
        raise ValueError("the policy names an unsupported decision")
    if not policy["blocking_relationships"] or not policy["blocking_severities"] or set(policy["blocking_severities"]) & set(policy["warning_severities"]):
        raise ValueError("the policy's lists are empty or overlap")
    if not 0 <= policy["minimum_verified_confidence"] <= 1:
        raise ValueError("the policy's confidence is out of range")


def scan_policy(findings: DataFrame, key: str, block: tuple[str, ...], warn: tuple[str, ...], least: float) -> DataFrame:
    """``findings(key, severity, confidence, incomplete)`` -> ``key, decision``: block, else warn, else pass; an incomplete scan never passes."""
    sure = F.col("confidence") >= least
    g = findings.groupBy(key).agg(
        F.bool_or(F.col("severity").isin(*block) & sure).alias("_b"), F.bool_or(F.col("severity").isin(*warn) & sure).alias("_w"),
        F.bool_or(F.coalesce("incomplete", F.lit(False))).alias("_i"),
    )
    return g.select(key, F.when(F.col("_b"), "block").when(F.col("_w"), "warn").when(F.col("_i"), "incomplete").otherwise("pass").alias("decision"))


def finding_decision(policy: dict = DEFAULT_POLICY) -> Column:
    """Decision of a finding with ``relationship, verification_state, triage_state, confidence, severity``; rules in order."""
    severity = F.lower("severity")
    changed = F.col("relationship").isin(*policy["blocking_relationships"])
    known = severity.isin(*policy["blocking_severities"], *policy["warning_severities"])
    return (
        F.when(F.col("relationship") == "EXISTING", policy["existing"]).when(F.col("relationship") == "RESOLVED", policy["resolved"])
        .when(~F.col("verification_state").eqNullSafe(F.lit("verified")), "PASS")
        .when(F.col("triage_state") == "false_positive", policy["false_positive"]).when(F.col("triage_state") == "accepted_risk", policy["accepted_risk"])
        .when(F.col("confidence") < policy["minimum_verified_confidence"], policy["low_confidence"])
        .when(~F.coalesce(known, F.lit(False)), policy["unknown_severity"])
        .when(changed & severity.isin(*policy["blocking_severities"]), "BLOCK").when(changed & severity.isin(*policy["warning_severities"]), "WARN")
        .otherwise("PASS")
    )


def merge_policy(findings: DataFrame, key: str, incomplete: DataFrame | None = None, policy: dict = DEFAULT_POLICY) -> DataFrame:
    """Overall decision of each review: the first, by precedence, of its findings' decisions; ``incomplete(key)`` adds theirs."""
    validate_policy(policy)
    decided = findings.select(key, finding_decision(policy).alias("decision"))
    if incomplete is not None:
        decided = decided.unionByName(incomplete.select(key, F.lit(policy["incomplete"]).alias("decision")))
    return first_by_precedence(decided, key, "decision", list(policy["decision_precedence"]), "PASS")


def route(severity: Column) -> Column:
    """Review tier of a candidate."""
    return lookup(F.lower(severity), {"critical": "deep", "high": "deep", "medium": "standard", "low": "fast", "info": "fast"}, "standard")


def relationship(baseline_state: Column, root_changed: Column, is_control: Column) -> Column:
    """Of a verified finding to the baseline: ``baseline_state`` is null where nothing matches."""
    return (
        F.when(baseline_state == "resolved", "REGRESSED").when(baseline_state.isNotNull() & root_changed, "MODIFIED_EXISTING")
        .when(baseline_state.isNotNull(), "EXISTING").when(root_changed & is_control, "REGRESSED").otherwise("INTRODUCED")
    )


def scan_status(counters: list[str]) -> Column:
    """partial if any failure counter is above zero."""
    return F.when(F.greatest(*[F.coalesce(F.col(c), F.lit(0)) for c in counters], F.lit(0)) > 0, "partial").otherwise("complete")


def evidence_roles(steps: DataFrame, roles: DataFrame) -> DataFrame:
    """``steps(kind, ...)`` with the role of their kind from ``roles(kind, role)``; unknown kinds are context."""
    r = roles.select(F.col("kind").alias("_k"), "role")
    return steps.join(r, F.col("kind") == F.col("_k"), "left").drop("_k").withColumn("role", F.coalesce("role", F.lit("context")))


def dotted_endings(name: Column) -> Column:
    """A name and what follows each of its dots, case-folded: all that it may be asked for by."""
    parts = F.split(F.trim(F.lower(name)), r"\.")
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))


def expand_requests(requests: DataFrame, symbols: DataFrame, calls: DataFrame, imports: DataFrame, most: int, references: DataFrame | None = None) -> DataFrame:
    """``requests(id, kind, target)`` -> ``id, kind, rank, fact, truncated``: the first ``most`` facts about the target.

    Kinds: definition (``symbols(name, path, start_line)``), callers, callees and flow (``calls(caller, callee)``; flow takes both sides, as ``caller -> callee``),
    imports (``imports(path, module)``, by path), sibling_handlers (all symbols of a path; a target that is no path stands for the request's
    ``changed_path``, if requests have that column). Names match whole or by what follows a dot. A target without callers has its
    ``references(source, target)`` instead, if they are given.

    Requests are written to the shared folder, as each kind reads them; of kinds that nobody asks for nothing is read.
    """
    from pyspark.sql.window import Window

    requests = stored(requests)
    kinds = {r["kind"] for r in requests.where(F.col("kind").isin("definition", "callers", "callees", "flow", "imports", "sibling_handlers")).select("kind").distinct().collect()}

    def first(side: DataFrame) -> DataFrame:
        """``_on, fact`` -> ``_on, _facts``: a name's first facts in order; one more than asked for tells that there are others. A name's facts
        are cut where they lie, before they meet, and no request takes more of them along."""
        w = Window.partitionBy("_on").orderBy("fact")
        ranked = side.where("_on IS NOT NULL").distinct().withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most + 1)
        return ranked.groupBy("_on").agg(F.array_sort(F.collect_list(F.struct("_rn", "fact"))).alias("_facts"))

    def side(df: DataFrame, on: str, fact: Column, whole: bool = False) -> DataFrame:
        names = F.array(F.trim(F.lower(on))) if whole else dotted_endings(F.col(on))
        return df.select(F.explode(names).alias("_on"), fact.alias("fact"))

    def facts(kind: str, known: DataFrame, target: Column = F.trim(F.lower("target"))) -> DataFrame:
        asked = requests.where(F.col("kind") == kind).select("id", "kind", target.alias("_t"))
        return asked.join(first(known), F.col("_t") == F.col("_on")).select("id", "kind", F.explode("_facts.fact").alias("fact"))

    place, link = F.concat_ws(":", "path", "start_line"), F.concat_ws(" -> ", "caller", "callee")
    callers = facts("callers", side(calls, "callee", F.col("caller")))
    if references is not None and "callers" in kinds:
        callers = callers.unionByName(facts("callers", side(references, "target", F.col("source"))).join(callers.select("id").distinct(), "id", "left_anti"))
    target = F.col("target")
    if "changed_path" in requests.columns:
        target = F.when(F.instr("target", "/").cast("boolean") | F.contains("target", F.lit(".")), F.col("target")).otherwise(F.col("changed_path"))
    known = {
        "definition": lambda: facts("definition", side(symbols, "name", place)), "callers": lambda: callers, "callees": lambda: facts("callees", side(calls, "caller", F.col("callee"))),
        "imports": lambda: facts("imports", side(imports, "path", F.col("module"), True)),
        "flow": lambda: facts("flow", side(calls, "caller", link).unionByName(side(calls, "callee", link))).distinct(),
        "sibling_handlers": lambda: facts("sibling_handlers", symbols.select(F.col("path").alias("_on"), F.concat_ws(":", "name", "start_line").alias("fact")), target),
    }
    found = reduce(DataFrame.unionByName, [known[kind]() for kind in known if kind in kinds] or [callers])
    w = Window.partitionBy("id", "kind")
    ranked = found.withColumn("rank", F.row_number().over(w.orderBy("fact"))).withColumn("truncated", F.count(F.lit(1)).over(w) > most)
    return ranked.where(F.col("rank") <= most)


def expand_source(requests: DataFrame, files: DataFrame, routes: DataFrame, reach: int, most: int) -> DataFrame:
    """``requests(id, kind, path, line, target)`` of the kinds window, search and route, over ``files(path, lines)`` and ``routes(path, line_no, route)``.

    -> ``id, kind, rank, path, line, content, truncated``: the lines around a place, lines that hold a text, registrations that hold a route.
    """
    from pyspark.sql.window import Window

    from provenant.operators.intervals import context_window
    from provenant.sources.readers import terms_in

    f = files.select(F.col("path").alias("_p"), "lines")
    around = requests.where("kind = 'window'").join(f, F.col("path") == F.col("_p")).where((F.col("line") >= 1) & (F.col("line") <= F.size("lines"))).select(
        "id", "kind", F.col("_p").alias("path"), F.col("line"), context_window(F.col("lines"), F.col("line"), F.lit(reach), 16_000)["content"].alias("content"))
    text = f.select(F.col("_p").alias("path"), F.posexplode("lines").alias("_n", "content"))
    wanted = requests.where("kind = 'search' AND length(target) > 1").select("id", "kind", "target")
    held = terms_in(text.select("path", "_n", "content", F.col("content").alias("_c")), wanted.select(F.col("target").alias("term")), "_c")
    found = held.join(wanted, F.col("term") == F.col("target")).select("id", "kind", "path", (F.col("_n") + 1).alias("line"), "content")
    r = routes.select(F.col("path").alias("_p"), "line_no", "route")
    # a registration ends in what is asked for: both meet in the last characters, as many as are asked for
    asked = requests.where("kind = 'route'").select("id", "kind", F.lower("target").alias("_t"))
    lengths = F.coalesce(asked.agg(F.array_sort(F.collect_set(F.length("_t")))).scalar(), F.array().cast("array<int>"))
    endings = r.withColumn("_ls", lengths).withColumn("_l", F.explode("_ls")).drop("_ls").where(F.col("_l") <= F.length("route")).withColumn("_end", F.expr("right(lower(route), _l)"))
    at = asked.join(endings, (F.col("_t") == F.col("_end")) & (F.length("_t") == F.col("_l"))).select(
        "id", "kind", F.col("_p").alias("path"), F.col("line_no").alias("line"), F.col("route").alias("content"))
    w = Window.partitionBy("id", "kind")
    every = around.unionByName(found).unionByName(at)
    ranked = every.withColumn("rank", F.row_number().over(w.orderBy("path", "line"))).withColumn("truncated", F.count(F.lit(1)).over(w) > most)
    return ranked.where(F.col("rank") <= most)
