"""Graph operators over ``edges(source, target)``: bounded reach, fan-out, components, neighbourhoods, staleness."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def reverse_reach(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """``start(node)`` -> ``node, depth``: nodes from which a start node is reached within so many steps, with the least depth.

    Breadth first: each round joins the frontier with the edges and drops nodes seen before. The rounds are at most
    ``hops`` (a dozen) and each is checkpointed to the shared folder, so the plan stays short.
    """
    spark = start.sparkSession
    e = edges.select(F.col("source").alias("_from"), F.col("target").alias("_to")).distinct()
    seen = start.select("node").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for depth in range(1, hops + 1):
        step = frontier.join(e, F.col("node") == F.col("_to")).select(F.col("_from").alias("node")).distinct()
        frontier = cut(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), spark)
        if frontier.limit(1).count() == 0:
            break
        seen = seen.unionByName(frontier)
    return seen


def _shared(spark) -> str:
    """The checkpoint folder that driver and executors share. Where none is set, one of this machine stands in if Spark runs on it alone (tests)."""
    if not spark.sparkContext.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="provenant-")
        spark.sparkContext.setCheckpointDir(shared)
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame, spark) -> DataFrame:
    """Cut the lineage in the shared folder."""
    _shared(spark)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table below the folder of ``cut``: in columns and compressed, where a checkpoint is rows as they are; the shuffle files
    that led to it go at once. It stays until the driver ends."""
    spark, cleanup = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    run = spark._jvm.org.apache.hadoop.fs.Path(f"{_shared(spark)}/stored-{spark.sparkContext.applicationId}")
    run.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(run)
    path, before = f"{run.toString()}/{uuid.uuid4().hex}", spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    return spark.read.schema(df.schema).parquet(path)


def ancestors(parents: DataFrame, wanted: DataFrame) -> DataFrame:
    """``parents(revision, parent)`` (null: a root), ``wanted(revision)`` -> ``revision, ancestor, distance``, itself at 0. A cycle raises.

    Pointers are doubled: a round extends what is known of each wanted revision by as many steps as it has, so a chain of n takes log2(n) rounds.
    """
    spark = parents.sparkSession
    known = wanted.select("revision").distinct().select("revision", F.col("revision").alias("ancestor"), F.lit(0).cast("long").alias("distance"))
    jumps = parents.where("parent IS NOT NULL").select(F.col("revision").alias("_from"), F.col("parent").alias("_to")).distinct()
    steps, most = 1, jumps.count()
    while not jumps.isEmpty():
        if steps > most:
            raise ValueError("the chain of revisions has a cycle")
        further = known.join(jumps, F.col("ancestor") == F.col("_from")).select("revision", F.col("_to").alias("ancestor"), (F.col("distance") + steps).alias("distance"))
        known = cut(known.unionByName(further), spark)
        onward = jumps.select(F.col("_from").alias("_mid"), F.col("_to").alias("_end"))
        jumps = cut(jumps.join(onward, F.col("_to") == F.col("_mid")).select("_from", F.col("_end").alias("_to")), spark)
        steps *= 2
    return known


def fan_out(edges: DataFrame, nodes: DataFrame, start: DataFrame, hops: int, most: int) -> DataFrame:
    """``node, invalid``: reverse reach with a cap that fails closed. If more than ``most`` nodes are reached, or an edge from an
    unreached node still leads into the reached ones, or from a reached node at the last depth, every node is invalid.
    """
    reached = reverse_reach(edges, start, hops)
    n = reached.count()
    last = reached.where(F.col("depth") == hops).select(F.col("node").alias("_n"))
    open_ = edges.join(last, F.col("target") == F.col("_n"), "left_semi").limit(1).count() > 0
    if n > most or open_:
        return nodes.select("node").withColumn("invalid", F.lit(True))
    return nodes.select("node").join(reached.select(F.col("node").alias("_n")), F.col("node") == F.col("_n"), "left").select(
        "node", F.col("_n").isNotNull().alias("invalid")
    )


def neighbours(edges: DataFrame, nodes: DataFrame, direction: str, relations: list[str] | None, cap: int) -> DataFrame:
    """One hop from each of ``nodes(node)``: ``node, neighbour, n_total, truncated``; relations case-insensitive; the first ``cap`` by id.

    ``direction``: out, in or both.
    """
    e = edges if relations is None else edges.where(F.lower("relation").isin(*[r.lower() for r in relations]))
    out = e.select(F.col("source").alias("node"), F.col("target").alias("neighbour"))
    back = e.select(F.col("target").alias("node"), F.col("source").alias("neighbour"))
    pairs = {"out": out, "in": back, "both": out.unionByName(back)}[direction].join(nodes.select("node").distinct(), "node", "left_semi").distinct()
    w = Window.partitionBy("node")
    ranked = pairs.withColumn("_rn", F.row_number().over(w.orderBy("neighbour"))).withColumn("n_total", F.count(F.lit(1)).over(w))
    return ranked.where(F.col("_rn") <= cap).select("node", "neighbour", "n_total", (F.col("n_total") > cap).alias("truncated"))


def neighbourhood_hashes(edges: DataFrame) -> DataFrame:
    """``edges(edge_id, source, target)`` -> ``node, degree, hash``: SHA-256 of the sorted ids of its edges."""
    ends = edges.select("edge_id", F.explode(F.array("source", "target")).alias("node")).distinct()
    return ends.groupBy("node").agg(
        F.count(F.lit(1)).alias("degree"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("edge_id").cast("string"))), ","), 256).alias("hash")
    )


def components(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pairs(a, b)`` and ``nodes(node)`` -> ``node, component``: the smallest node that is linked, itself included.

    Each node points to its smallest neighbour, if that is smaller; pointers are doubled until they reach a node that points nowhere, and the edges that are left
    are drawn between those. Every round drops the edges that have become loops; it ends when none is left. No bound on rounds.
    """
    spark = pairs.sparkSession
    e = cut(pairs.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).where("x < y").distinct(), spark)
    now = nodes.select("node").distinct().withColumn("component", F.col("node"))
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
        up = cut(both.groupBy("x").agg(F.min("y").alias("_m")).where("_m < x").select(F.col("x").alias("_n"), F.col("_m").alias("_c")), spark)
        label, moved = up, True
        while moved:
            higher = label.select(F.col("_n").alias("_n2"), F.col("_c").alias("_c2"))
            step = cut(label.join(higher, F.col("_c") == F.col("_n2"), "left").select("_n", F.coalesce("_c2", "_c").alias("_c"), F.col("_c2").isNotNull().alias("_up")), spark)
            label, moved = step.select("_n", "_c"), not step.where("_up").isEmpty()
        now = cut(now.join(label, F.col("component") == F.col("_n"), "left").select("node", F.coalesce("_c", "component").alias("component")), spark)
        a, b = label.select(F.col("_n").alias("_p"), F.col("_c").alias("_a")), label.select(F.col("_n").alias("_q"), F.col("_c").alias("_b"))
        moved = e.join(a, F.col("x") == F.col("_p"), "left").join(b, F.col("y") == F.col("_q"), "left").select(F.coalesce("_a", "x").alias("a"), F.coalesce("_b", "y").alias("b"))
        e = cut(moved.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).where("x < y").distinct(), spark)
    return now


def target_groups(targets: DataFrame, edges: DataFrame) -> DataFrame:
    """``targets(target, node)``, ``edges(source, target)`` -> ``target, component``: targets that share a node or whose nodes one edge joins.

    A node with many targets links each to the smallest of them, not all to all.
    """
    t = targets.select(F.col("target").alias("t"), "node").distinct()
    head = t.groupBy("node").agg(F.min("t").alias("h"))
    shared = t.join(head, "node").select(F.col("t").alias("a"), F.col("h").alias("b"))
    ends = edges.select(F.col("source").alias("_s"), F.col("target").alias("_t")).distinct()
    a = head.select(F.col("node").alias("_s"), F.col("h").alias("a"))
    b = head.select(F.col("node").alias("_t"), F.col("h").alias("b"))
    joined = ends.join(a, "_s").join(b, "_t").select("a", "b")
    return components(shared.unionByName(joined), t.select(F.col("t").alias("node"))).withColumnRenamed("node", "target")


def is_connected(edges: DataFrame, nodes: DataFrame) -> bool:
    """Whether the subgraph of the nodes is connected; an empty one is."""
    inside = edges.join(nodes.select(F.col("node").alias("source")), "source", "left_semi").join(nodes.select(F.col("node").alias("target")), "target", "left_semi")
    found = components(inside.select(F.col("source").alias("a"), F.col("target").alias("b")), nodes)
    return found.select("component").distinct().limit(2).count() <= 1


def bounded_slice(edges: DataFrame, targets: DataFrame, most_nodes: int, most_edges: int) -> tuple[DataFrame, DataFrame, bool]:
    """The targets and their neighbours in order, up to a number of nodes; edges with both ends inside, up to a number; whether anything was cut."""
    near = neighbours(edges, targets, "both", None, most_nodes).select(F.col("neighbour").alias("node"))
    every = targets.select("node", F.lit(0).alias("k")).unionByName(near.select("node", F.lit(1).alias("k"))).groupBy("node").agg(F.min("k").alias("k"))
    nodes = every.orderBy("k", "node").limit(most_nodes)
    inside = edges.join(nodes.select(F.col("node").alias("source")), "source", "left_semi").join(nodes.select(F.col("node").alias("target")), "target", "left_semi")
    kept = inside.orderBy("source", "target").limit(most_edges)
    return nodes.select("node"), kept, every.count() > most_nodes or inside.count() > most_edges


def flow(edges: DataFrame, start: DataFrame, depth: int, most_edges: int) -> DataFrame:
    """``edges(edge_id, source, target, ord)`` walked in both directions: ``edge_id, depth``, the first so many by depth, then scan order."""
    spark = edges.sparkSession
    e = edges.select("edge_id", "ord", F.col("source").alias("_a"), F.col("target").alias("_b"))
    ends = e.select("edge_id", "ord", F.col("_a").alias("_x"), F.col("_b").alias("_y")).unionByName(e.select("edge_id", "ord", F.col("_b").alias("_x"), F.col("_a").alias("_y")))
    seen = start.select("node").distinct()
    frontier, found = seen, None
    for d in range(1, depth + 1):
        step = cut(ends.join(frontier, F.col("_x") == F.col("node")).select("edge_id", "ord", "_y", F.lit(d).alias("depth")), spark)
        found = step if found is None else found.unionByName(step)
        frontier = cut(step.select(F.col("_y").alias("node")).distinct().join(seen, "node", "left_anti"), spark)
        if frontier.limit(1).count() == 0:
            break
        seen = seen.unionByName(frontier)
    return found.groupBy("edge_id", "ord").agg(F.min("depth").alias("depth")).orderBy("depth", "ord").limit(most_edges).select("edge_id", "depth")


def flows(requests: DataFrame, edges: DataFrame, depth: int, most_edges: int) -> DataFrame:
    """``requests(id, node)``, ``edges(edge_id, source, target, ord)`` walked in both directions -> ``id, edge_id, depth, rank, path``.

    All requests are answered together, in ``depth`` joins: the frontier is keyed by request and node. A node keeps the first way (by the orders of its
    edges) of the least length that leads to it, and an edge's ``path`` is that way and the edge. The first ``most_edges`` of a request by depth, then
    scan order. Several nodes of one request start together.
    """
    spark = edges.sparkSession
    e = edges.select("edge_id", "ord", F.col("source").alias("_a"), F.col("target").alias("_b"))
    ends = e.select("edge_id", "ord", F.col("_a").alias("_x"), F.col("_b").alias("_y")).unionByName(e.select("edge_id", "ord", F.col("_b").alias("_x"), F.col("_a").alias("_y")))
    step = F.struct("ord", "edge_id")
    none = F.array().cast(edges.select(F.array(step)).schema[0].dataType)
    frontier = requests.select("id", "node").distinct().withColumn("way", none)
    seen, found = frontier.select("id", "node"), []
    for d in range(1, depth + 1):
        walked = ends.join(frontier, F.col("_x") == F.col("node")).select("id", "edge_id", "ord", F.col("_y").alias("to"), F.lit(d).alias("depth"), F.concat("way", F.array(step)).alias("way"))
        walked = cut(walked, spark)
        found.append(walked.groupBy("id", "edge_id", "ord").agg(F.min("depth").alias("depth"), F.min("way").alias("way")))
        frontier = cut(walked.groupBy("id", F.col("to").alias("node")).agg(F.min("way").alias("way")).join(seen, ["id", "node"], "left_anti"), spark)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.select("id", "node"))
    once = reduce(DataFrame.unionByName, found).groupBy("id", "edge_id", "ord").agg(F.min(F.struct("depth", "way")).alias("_b"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("_b.depth", "ord", "edge_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= most_edges).select("id", "edge_id", "_b.depth", "rank", F.transform("_b.way", lambda x: x["edge_id"]).alias("path"))


def stale(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """``recorded(owner, kind, key, hash)``, ``current(kind, key, hash)`` -> recorded dependencies that no longer hold. Kind ``unresolved`` never holds."""
    c = current.select(F.col("kind").alias("_k"), F.col("key").alias("_key"), F.col("hash").alias("_h"))
    both = recorded.join(c, (F.col("kind") == F.col("_k")) & (F.col("key") == F.col("_key")), "left")
    return both.where((F.col("kind") == "unresolved") | ~F.col("hash").eqNullSafe(F.col("_h"))).select("owner", "kind", "key")


def mismatch_reasons(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Per owner the sorted set of kinds whose dependencies no longer hold; owners without any are compatible and absent."""
    return stale(recorded, current).groupBy("owner").agg(F.array_sort(F.collect_set("kind")).alias("reasons"))


def to_revalidate(findings: DataFrame, changed: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """``findings(finding, symbol)`` that depend on a changed symbol or on one that reaches it within so many steps."""
    hit = reverse_reach(edges, changed, hops).select(F.col("node").alias("symbol"))
    return findings.join(hit, "symbol", "left_semi").select("finding").distinct()


def entry_and_terminal(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, is_entry`` (nothing leads into it), ``is_terminal`` (nothing leads out)."""
    into = edges.select(F.col("target").alias("_i")).distinct()
    out = edges.select(F.col("source").alias("_o")).distinct()
    both = nodes.select("node").distinct().join(into, F.col("node") == F.col("_i"), "left").join(out, F.col("node") == F.col("_o"), "left")
    return both.select("node", F.col("_i").isNull().alias("is_entry"), F.col("_o").isNull().alias("is_terminal"))


def assembled_traces(steps: DataFrame, support: DataFrame, gaps: DataFrame, root: str, sinks: list[str]) -> DataFrame:
    """Evidence traces with a row for each step.

    ``steps(trace, pos, role)``, ``support(trace, pos, support, via)`` (the step before it, as ``joins.nearest_by_class`` finds it; null: none),
    ``gaps(trace, gap)`` -> ``trace, pos, role, source, via, branch, depth, is_entry, is_terminal, complete, n_gaps``. ``branch`` is the position where the
    chain of supports of a step begins, ``depth`` its length: chains are closed by doubled pointers, in as many rounds as the longest has binary digits. A
    step without support that isn't its trace's first is a gap. A trace is complete if it has no gap, a step of the role ``root`` and one of ``sinks``.
    """
    linked = stored(steps.select("trace", "pos", "role").join(support.select("trace", "pos", F.col("support").alias("source"), "via"), ["trace", "pos"], "left"))
    # each step points at its support; those that begin a chain point at themselves
    moving = linked.where("source IS NOT NULL").select("trace", "pos", F.col("source").alias("up"), F.lit(1).cast("long").alias("far"))
    closed = []
    while True:
        # what points at a beginning is closed: it is looked up, but looks up nothing any more
        above = reduce(DataFrame.unionByName, [*closed, moving]).select(F.col("trace").alias("_t"), F.col("pos").alias("_p"), F.col("up").alias("_up"), F.col("far").alias("_far"))
        moved = stored(moving.join(above, (F.col("trace") == F.col("_t")) & (F.col("up") == F.col("_p")), "left").select(
            "trace", "pos", F.coalesce("_up", "up").alias("up"), (F.col("far") + F.coalesce("_far", F.lit(0))).alias("far"), F.col("_up").isNotNull().alias("_open")))
        closed.append(moved.where("NOT _open").drop("_open"))
        moving = moved.where("_open").drop("_open")
        if moving.isEmpty():
            break
    begun = linked.where("source IS NULL").select("trace", "pos", F.col("pos").alias("up"), F.lit(0).cast("long").alias("far"))
    at = reduce(DataFrame.unionByName, [*closed, begun])
    onward = linked.where("source IS NOT NULL").select(F.col("trace").alias("_t"), F.col("source").alias("_p")).distinct()
    marked = linked.join(at.select(F.col("trace").alias("_a"), F.col("pos").alias("_b"), F.col("up").alias("branch"), F.col("far").alias("depth")), (F.col("trace") == F.col("_a")) & (F.col("pos") == F.col("_b"))).join(
        onward, (F.col("trace") == F.col("_t")) & (F.col("pos") == F.col("_p")), "left").select("trace", "pos", "role", "source", "via", "branch", "depth", F.col("_p").isNull().alias("is_terminal"))
    known = gaps.where("trim(gap) <> ''").select("trace", F.trim("gap").alias("gap")).distinct().groupBy("trace").agg(F.count(F.lit(1)).alias("_told"))
    whole = marked.groupBy("trace").agg(
        F.min("pos").alias("_first"), F.count_if(F.col("source").isNull()).alias("_starts"), F.bool_or(F.col("role") == root).alias("_root"), F.bool_or(F.col("role").isin(*sinks)).alias("_sink")
    ).join(known, "trace", "left").withColumn("n_gaps", F.col("_starts") - 1 + F.coalesce("_told", F.lit(0)))
    facts = whole.select(F.col("trace").alias("_w"), "n_gaps", F.coalesce((F.col("n_gaps") == 0) & F.col("_root") & F.col("_sink"), F.lit(False)).alias("complete"))
    return marked.join(facts, F.col("trace") == F.col("_w")).select("trace", "pos", "role", "source", "via", "branch", "depth", F.col("source").isNull().alias("is_entry"), "is_terminal", "complete", "n_gaps")


def nested_values(df: DataFrame, key: str, payload: str, name: str) -> DataFrame:
    """``key, value``: every text under a field of that name, at any depth of a JSON text, once for each key; in no particular order.

    Texts become variants, which are taken apart level by level: as many rounds as the deepest nesting. What isn't JSON has no values.
    """
    spark = df.sparkSession
    level, found = df.select(F.col(key).alias("_k"), F.try_parse_json(payload).alias("_v")).where("_v IS NOT NULL"), []
    while True:
        parts = level.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer())).select("_k", F.col("key").alias("_name"), F.col("value").alias("_v"), F.schema_of_variant("value").alias("_kind"))
        parts = cut(parts, spark)
        found.append(parts.where((F.col("_name") == name) & (F.col("_kind") == "STRING")).select(F.col("_k").alias(key), F.try_variant_get("_v", "$", "string").alias("value")))
        level = parts.where("_kind LIKE 'OBJECT%' OR _kind LIKE 'ARRAY%'").select("_k", "_v")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found).distinct()


# How each kind of request is answered: mode, relations, direction.
BOTH_WAYS = ("relationship", ("calls", "references"), "both")
RESOLVERS = {
    "definition": ("definition", (), ""), "callers": ("relationship", ("calls",), "in"), "callees": ("relationship", ("calls",), "out"),
    "references": ("relationship", ("references",), "in"), "imports": ("relationship", ("imports",), "both"), "readers": ("relationship", ("references",), "both"),
    "writers": ("relationship", ("references",), "both"), "credential_consumer": BOTH_WAYS, "middleware": BOTH_WAYS, "route": BOTH_WAYS, "sibling_handlers": BOTH_WAYS,
    "authorization_decision": BOTH_WAYS, "security_control": BOTH_WAYS, "store_relationship": BOTH_WAYS, "configuration": ("relationship", ("references", "imports"), "both"),
    "environment_usage": ("relationship", ("references", "imports"), "both"), "flow": BOTH_WAYS, "search": ("label_search", (), ""), "knowledge": ("label_search", (), ""),
    "window": ("window", (), ""),
}


def _grams(label: Column) -> Column:
    """Distinct runs of two and of three characters of a lower-cased text."""
    low = F.lower(label)

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(low) - n + 1, F.lit(1)))
        return F.filter(F.transform(starts, lambda i: F.substring(low, i, F.lit(n))), lambda g: F.length(g) == n)

    return F.array_distinct(F.concat(runs(2), runs(3)))


def typed_lookup(requests: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = 8) -> DataFrame:
    """``requests(id, kind, path, symbol, query)``, ``nodes(node_id, label, path, line)``, ``edges(source, target, relation)`` -> ``id, node_id, rank, truncated``.

    definition: nodes of that label (in the path, if one is given); relationship: their neighbours by the kind's relations and direction;
    label_search: nodes whose label holds every term of the query. The first ``most`` by path, line and id. Windows and unknown kinds give no node.
    Equal requests are answered once. A search joins distinct labels by the first characters of its longest term before it looks at whole terms. A table of nodes looks small by
    its file and isn't, the less with the characters of its labels: the joins are hinted so that neither nodes nor requests go through the driver.
    """
    table = requests.sparkSession.createDataFrame([(k, m, list(r), d) for k, (m, r, d) in RESOLVERS.items()], "kind string, mode string, relations array<string>, direction string")
    what = F.struct("kind", "path", "symbol", "query")
    asked = requests.select("kind", "path", "symbol", "query", what.alias("what")).distinct().join(F.broadcast(table), "kind")  # the table has twenty rows
    n = nodes.select("node_id", "label", F.col("path").alias("_p"), "line").hint("merge")
    here = F.col("path").isNull() | (F.col("path") == "") | (F.col("path") == F.col("_p"))
    seeds = asked.where("mode IN ('definition', 'relationship')").join(n, (F.col("symbol") == F.col("label")) & here)
    found = seeds.where("mode = 'definition'").select("what", "node_id")
    related = seeds.where("mode = 'relationship'").select("what", "node_id", F.explode("relations").alias("_r"), "direction")
    e = edges.select("source", "target", F.lower("relation").alias("_rel"))
    out = related.where("direction <> 'in'").join(e, (F.col("node_id") == F.col("source")) & (F.col("_r") == F.col("_rel"))).select("what", F.col("target").alias("node_id"))
    back = related.where("direction <> 'out'").join(e, (F.col("node_id") == F.col("target")) & (F.col("_r") == F.col("_rel"))).select("what", F.col("source").alias("node_id"))
    words = F.filter(F.regexp_extract_all(F.lower("query"), F.lit(r"([a-z0-9_$.-]+)"), F.lit(1)), lambda w: F.length(w) > 1)
    longest = F.array_max(F.transform("_w", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    wanted = asked.where("mode = 'label_search'").withColumn("_w", words).where("size(_w) > 0").withColumn("_g", F.substring(longest, 1, 3))
    indexed = nodes.select(F.col("label").alias("_label")).distinct().select("_label", F.explode(_grams(F.col("_label"))).alias("_n")).hint("merge")
    holding = wanted.join(indexed, (F.col("_g") == F.col("_n")) & F.forall("_w", lambda w: F.instr(F.lower(F.col("_label")), w) > 0)).select("what", "path", "_label")
    matched = holding.join(n, (F.col("_label") == F.col("label")) & here).select("what", "node_id")
    every = found.unionByName(out).unionByName(back).unionByName(matched).distinct().join(nodes.select("node_id", "path", "line").hint("merge"), "node_id")
    w = Window.partitionBy("what")
    ranked = every.withColumn("rank", F.row_number().over(w.orderBy("path", "line", "node_id"))).withColumn("truncated", F.count(F.lit(1)).over(w) > most)
    answers = ranked.where(F.col("rank") <= most).select(F.col("what").alias("_what"), "node_id", F.col("rank").cast("long").alias("rank"), "truncated")
    return requests.select("id", what.alias("what")).hint("merge").join(answers, F.col("what") == F.col("_what")).select("id", "node_id", "rank", "truncated")
