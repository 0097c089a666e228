"""Queries over intervals, graphs and clusters whose order decides; their SQL walks the order with recursion."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenant.functions import text as T
from provenant.operators import graphs as G
from provenant.operators import intervals as I
from provenant.operators import joins as J
from provenant.operators import resolution as E
from provenant.plans.events_queries import micros, table
from provenant.plans.text_queries import STEMS, _lines


def _minutes(spark, d):
    return table(spark, d, "events").select("event_id", "event_type", F.col("user_id").cast("string").alias("path"), F.floor(micros("ts") / 60_000_000).cast("int").alias("start_line"))


def merge_search_windows(spark, d):
    e = _minutes(spark, d)
    windows = e.select(
        "path", "start_line", (F.col("start_line") + 5 + F.pmod("event_id", F.lit(40))).cast("int").alias("end_line"), F.expr("repeat('x', int(event_id % 9000))").alias("content"),
        F.array("event_type").alias("query_ids"), F.array(F.concat(F.lit("t"), F.pmod("event_id", F.lit(3)).cast("string"))).alias("task_ids"))
    return I.merge_windows(windows).select("path", "start_line", "end_line", F.array_join("query_ids", ",").alias("queries"), F.array_join("task_ids", ",").alias("tasks"), "n")


WINDOWS = """with recursive w as (select user_id::varchar as path, (epoch_us(ts) // 60000000)::integer as s, (epoch_us(ts) // 60000000 + 5 + event_id % 40)::integer as e, event_id % 9000 as c, event_type as q, 't' || event_id % 3 as t from events),
r as (select *, row_number() over (partition by path order by s, e, c) as k from w),
f as (select path, k, s, e, c, 1 as g from r where k = 1 union all select r.path, r.k, r.s, case when r.s - f.e <= 20 and f.c + r.c <= 16000 then greatest(f.e, r.e) else r.e end, case when r.s - f.e <= 20 and f.c + r.c <= 16000 then f.c else r.c end,
 f.g + case when r.s - f.e <= 20 and f.c + r.c <= 16000 then 0 else 1 end from f join r on r.path = f.path and r.k = f.k + 1)
select f.path, min(f.s) as start_line, max(f.e) as end_line, string_agg(distinct q, ',' order by q) as queries, string_agg(distinct t, ',' order by t) as tasks, count(*)::integer as n from f join r using (path, k) group by f.path, f.g"""


def merge_anchored_regions(spark, d):
    e = table(spark, d, "events")
    line = F.pmod("event_id", F.lit(1200)).cast("int") + 1
    regions = e.select(
        F.col("user_id").cast("string").alias("path"), line.alias("start_line"), (line + F.pmod("event_id", F.lit(50)).cast("int")).alias("end_line"),
        F.when(F.col("event_type") == "click", "symbol").otherwise("line_range").alias("anchor_type"), F.when(F.col("event_type") == "click", F.pmod("event_id", F.lit(3)).cast("string")).otherwise("").alias("anchor_id"),
        F.array("event_type").alias("task_ids"))
    files = regions.select("path").distinct().withColumn("lines", F.array_repeat(F.lit("xxxxxxxxx"), 1300))
    return I.merge_anchored(regions, files, limit=2_000).select("path", "start_line", "end_line", "anchor_type", "anchor_id", F.array_join("task_ids", ",").alias("tasks"), "n")


ANCHORED = """with recursive w as (select user_id::varchar as path, (event_id % 1200 + 1)::integer as s, (event_id % 1200 + 1 + event_id % 50)::integer as e, case when event_type = 'click' then 'symbol' else 'line_range' end as a, case when event_type = 'click' then (event_id % 3)::varchar else '' end as i, event_type as t from events),
r as (select *, row_number() over (partition by path order by s, e, i, t) as k from w),
x as (select path, k, s, e, a, i, t, 1 as g from r where k = 1 union all select path, k, case when j then least(s, s2) else s2 end, case when j then greatest(e, e2) else e2 end, a2, i2, t, g + case when j then 0 else 1 end from (
 select r.path, r.k, x.s, x.e, x.g, r.s as s2, r.e as e2, case when same or plain then x.a else r.a end as a2, case when same or plain then x.i else r.i end as i2, r.t, ((same and (enough or r.s - x.e <= 20)) or (plain and enough)) and 10 * (greatest(x.e, r.e) - least(x.s, r.s) + 1) - 1 <= 2000 as j
 from x join r on r.path = x.path and r.k = x.k + 1, lateral (select x.a = r.a and x.i = r.i as same, x.a = 'line_range' and r.a = 'line_range' as plain, greatest(0, least(x.e, r.e) - greatest(x.s, r.s) + 1) / greatest(1, r.e - r.s + 1) >= 0.5 as enough) l))
select path, min(s) as start_line, max(e) as end_line, min(a) as anchor_type, min(i) as anchor_id, string_agg(distinct t, ',' order by t) as tasks, count(*)::integer as n from x group by path, g"""


def chunk_routes(spark, d):
    return I.chunk_routes(_lines(spark, d), "doc_id", 6, 400_000)


ROUTES = """with recursive l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as i, length(unnest(string_split(text, chr(10)))) + 1 as n from documents),
f as (select doc_id, i, i as s, n as c from l where i = 1 union all select l.doc_id, l.i, case when f.c + l.n <= 400000 and l.i - f.s < 6 then f.s else l.i end, case when f.c + l.n <= 400000 and l.i - f.s < 6 then f.c + l.n else l.n end from f join l on l.doc_id = f.doc_id and l.i = f.i + 1)
select doc_id, s::integer as start_line, max(i)::integer as end_line, max(c)::integer as chars from f group by doc_id, s"""


def pack_batches(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_suppkey")).alias("ord"), (F.col("l_quantity") * 1000).cast("int").alias("chars"))
    return I.pack_batches(li, "l_partkey", 3, 60_000)


BATCHES = """with recursive l as (select l_partkey, row_number() over (partition by l_partkey order by (l_orderkey * 10 + l_linenumber) * 1000000 + l_suppkey) as i, (l_orderkey * 10 + l_linenumber) * 1000000 + l_suppkey as ord, (l_quantity * 1000)::integer as c from lineitem),
f as (select l_partkey, i, ord, c, 0 as b, 1 as n, c as t from l where i = 1 union all select l.l_partkey, l.i, l.ord, l.c, f.b + case when f.n >= 3 or f.t + l.c > 60000 then 1 else 0 end, case when f.n >= 3 or f.t + l.c > 60000 then 1 else f.n + 1 end, case when f.n >= 3 or f.t + l.c > 60000 then l.c else f.t + l.c end from f join l on l.l_partkey = f.l_partkey and l.i = f.i + 1)
select l_partkey, ord, c as chars, b as batch, (max(b) over o + 1)::integer as batch_count, (count(*) over o - max(i) over (partition by l_partkey, b))::integer as remaining from f window o as (partition by l_partkey)"""


def group_worksets(spark, d):
    li = table(spark, d, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("region_id"), F.col("l_returnflag").alias("surface_type"), F.col("l_suppkey").cast("string").alias("surface_id"),
        F.col("l_linestatus").alias("path"), "l_linenumber", F.pmod("l_partkey", F.lit(50)).cast("string").alias("content_id")).withColumn("start_line", F.col("l_linenumber")).withColumn("end_line", F.col("l_linenumber") + 3)
    slices = F.array_join(F.transform("slices", lambda s: F.concat_ws("-", s["start_line"].cast("string"), s["end_line"].cast("string"), s["content_id"])), ",")
    return I.group_worksets(li).select("surface_type", "surface_id", "path", slices.alias("slices"), "workset_id", "evidence_hash")


WORKSETS = """with c as (select l_returnflag as a, l_suppkey::varchar as b, l_linestatus as p, (l_partkey % 50)::varchar as c, min(struct_pack(s := l_linenumber, e := l_linenumber + 3, r := l_orderkey || '-' || l_linenumber)) as m from lineitem group by 1, 2, 3, 4)
select a as surface_type, b as surface_id, p as path, string_agg(m.s || '-' || m.e || '-' || c, ',' order by m.s, m.e, c) as slices, sha256(a || ':' || b || ':' || p) as workset_id, sha256(a || ':' || b || ':' || p || ':' || string_agg(c, ',' order by m.s, m.e, c)) as evidence_hash from c group by 1, 2, 3"""


def bounded_flow(spark, d):
    e = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id"), (-F.col("l_orderkey")).alias("source"), F.col("l_suppkey").alias("target")).withColumn("ord", F.col("edge_id"))
    start = table(spark, d, "orders").agg((-F.min("o_orderkey")).alias("node"))
    return G.flow(e, start, 2, 500).select("edge_id", F.col("depth").cast("long").alias("depth"))


FLOW = """with e as (select l_orderkey * 10 + l_linenumber as id, -l_orderkey as s, l_suppkey as t from lineitem), z as (select -min(o_orderkey) as node from orders), a as (select id, t as n from e join z on s = node union select id, s from e join z on t = node),
n as (select distinct n from a where n not in (select node from z)), b as (select id from e where s in (select n from n) or t in (select n from n)), u as (select id, 1 as depth from a union all select id, 2 from b)
select id as edge_id, min(depth)::bigint as depth from u group by 1 order by 2, 1 limit 500"""


def _chain(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("source"))
    return p.withColumn("target", F.floor(F.col("source") / 2).cast("long")).where("source > 0")


def connected(spark, d):
    edges, nodes = _chain(spark, d), table(spark, d, "part").select(F.col("p_partkey").alias("node"))
    apart = edges.where("target > 1")
    return spark.createDataFrame([("tree", G.is_connected(edges, nodes)), ("branches", G.is_connected(apart, nodes)), ("nothing", G.is_connected(edges, nodes.limit(0)))], "graph string, connected boolean")


CONNECTED = """with recursive n as (select p_partkey as n from part), e as (select n as s, n // 2 as t from n where n > 0), r(n) as (select min(n) from n union select e.s from r join e on e.t = r.n),
q(n) as (select min(n) from n union select e.s from q join e on e.t = q.n where e.t > 1) select 'tree' as graph, (select count(*) from r) = (select count(*) from n) as connected union all select 'branches', (select count(*) from q) = (select count(*) from n) union all select 'nothing', true"""


def bounded_slice(spark, d):
    nodes, edges, cut = G.bounded_slice(_chain(spark, d), table(spark, d, "part").where("p_partkey BETWEEN 10 AND 40").select(F.col("p_partkey").alias("node")), 50, 30)
    some = nodes.select(F.col("node").alias("a"), F.lit(0).cast("long").alias("b"))
    return some.unionByName(edges.select(F.col("source").alias("a"), F.col("target").alias("b"))).withColumn("truncated", F.lit(cut))


SLICE = """with e as (select p_partkey as s, p_partkey // 2 as t from part where p_partkey > 0), g as (select p_partkey as n from part where p_partkey between 10 and 40), v as (select n, 0 as k from g union all select t, 1 from e where s in (select n from g) union all select s, 1 from e where t in (select n from g)),
m as (select n, min(k) as k from v group by 1), c as (select n from m order by k, n limit 50), i as (select s, t from e where s in (select n from c) and t in (select n from c)), j as (select * from i order by s, t limit 30)
select a, b, (select count(*) from m) > 50 or (select count(*) from i) > 30 as truncated from (select n as a, 0::bigint as b from c union all select s, t from j)"""


def revalidation(spark, d):
    findings = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("finding"), F.col("l_partkey").alias("symbol"))
    changed = table(spark, d, "part").where("p_partkey = 5").select(F.col("p_partkey").alias("node"))
    return G.to_revalidate(findings, changed, _chain(spark, d), 3)


REVALIDATE = """with recursive r(n, k) as (select 5::bigint, 0 union select p_partkey, k + 1 from r join part on p_partkey // 2 = n where k < 3 and p_partkey > 0) select distinct l_orderkey as finding from lineitem where l_partkey in (select n from r)"""


def entry_and_terminal(spark, d):
    return G.entry_and_terminal(table(spark, d, "part").select(F.col("p_partkey").alias("node")), _chain(spark, d))


ENDS = "select p_partkey as node, p_partkey not in (select p_partkey // 2 from part where p_partkey > 0) as is_entry, p_partkey = 0 as is_terminal from part"


def nested_references(spark, d):
    p = table(spark, d, "part").withColumn("payload", F.concat(F.lit('{"a": {"ref": "'), "p_name", F.lit('"}, "b": [{"ref": "'), "p_type", F.lit('"}, {"c": {"ref": "'), "p_name", F.lit('", "x": 1}}], "ref": 5}')))
    return G.nested_values(p, "p_partkey", "payload", "ref")


NESTED = "select p_partkey, unnest(list_distinct([p_name, p_type])) as value from part"


def first_span(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.floor(micros("ts") / 1_000_000).cast("long").alias("s"))
    spans = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("span_id"), F.col("s").alias("start_line"), (F.col("s") + 600 * (1 + F.pmod("event_id", F.lit(40)))).alias("end_line"), F.col("event_id").alias("ord"))
    points = e.where("event_type <> 'click'").select(F.col("event_id").alias("id"), "user_id", F.col("s").alias("line"))
    return J.enclosing_span(points, spans, ["user_id"], narrowest=False).select("id", "span_id")


FIRST_SPAN = """with e as (select *, epoch_us(ts) // 1000000 as s from events), c as (select user_id, event_id, s, s + 600 * (1 + event_id % 40) as t from e where event_type = 'click')
select e.event_id as id, min(c.event_id) as span_id from e left join c on e.user_id = c.user_id and e.s between c.s and c.t where e.event_type <> 'click' group by 1"""


def focus_paths(spark, d):
    paths = table(spark, d, "part").select(F.concat_ws("/", F.regexp_replace("p_type", " ", "/"), F.concat("p_name", F.lit(".py"))).alias("path"))
    focus = spark.createDataFrame([("STANDARD",), ("PROMO/*",), ("SMALL/",), ("*/part_1?.py",)], "pattern string")
    return J.matching_paths(paths, focus)


FOCUS = """with p as (select distinct replace(p_type, ' ', '/') || '/' || p_name || '.py' as path from part) select path from p where path like 'STANDARD/%' or path like 'PROMO/%' or path like 'SMALL/%' or regexp_full_match(path, '.*/part_1..py')"""


def touched_hunks(spark, d):
    hunk = lambda a, b, c, n: F.struct(F.lit(a).alias("old_start"), F.lit(b).alias("old_lines"), F.lit(c).alias("new_start"), F.lit(n).alias("new_lines"))
    hunks = F.array(hunk(5, 0, 6, 5), hunk(20, 3, 25, 0), hunk(40, 2, 43, 4))
    return table(spark, d, "part").select("p_partkey", I.touches_hunks(hunks, F.col("p_size"), F.col("p_size") + 2, F.pmod("p_partkey", F.lit(2)) == 0).alias("touched"))


TOUCHED = """select p_partkey, case when p_partkey % 2 = 0 then (p_size <= 5 and p_size + 2 >= 5) or (p_size <= 22 and p_size + 2 >= 20) or (p_size <= 41 and p_size + 2 >= 40) else (p_size <= 10 and p_size + 2 >= 6) or (p_size <= 25 and p_size + 2 >= 25) or (p_size <= 46 and p_size + 2 >= 43) end as touched from part"""


def _greedy_sql(nodes: str, rule: str, order: str, near: str = "true") -> str:
    """Clusters of ``nodes(path, id, ...)`` by the rule over a (earlier) and b (later): each row in turn joins its first matching head or becomes one."""
    return f"""{nodes}, ranked as materialized (select *, row_number() over (partition by path order by {order}) as n from d),
met as materialized (select b.path, b.n as late, list(a.n order by a.n) as nb from ranked a join ranked b on a.path = b.path and a.n < b.n and {near} where {rule} group by 1, 2),
row_ as materialized (select ranked.path, ranked.n, coalesce(nb, []) as nb from ranked left join met on met.path = ranked.path and met.late = ranked.n),
walk as (select distinct path, 0::bigint as n, []::bigint[] as heads from ranked union all select row_.path, row_.n, case when len(list_intersect(nb, heads)) = 0 then list_append(heads, row_.n) else heads end from walk join row_ on row_.path = walk.path and row_.n = walk.n + 1),
last_ as (select path, arg_max(heads, n) as heads from walk group by 1) select ranked.path, ranked.id, h.id as cluster from ranked join row_ using (path, n) join last_ using (path) join ranked h on h.path = ranked.path and h.n = coalesce(list_min(list_intersect(nb, heads)), ranked.n)"""


CLUSTER = _greedy_sql(
    "with recursive " + STEMS.split("with ", 1)[1].rsplit("\nselect", 1)[0].replace("w as (", "tok as (", 1).replace("from w where", "from tok where")
    + ", d as (select coalesce(source, '') as path, doc_id as id, doc_id % 10 as conf, n_chars % 400 as a0, coalesce(list(s.w) filter (s.w is not null), []) as words from documents left join s using (doc_id) group by 1, 2, 3, 4)",
    "case when abs(a.a0 - b.a0) <= 6 then len(list_intersect(a.words, b.words)) > 0 else len(list_intersect(a.words, b.words)) > 1 end", "conf desc, id", "abs(a.a0 - b.a0) <= 9")


def admission(spark, d):
    li = table(spark, d, "lineitem")
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000 + F.col("l_suppkey")
    line = F.pmod("l_orderkey", F.lit(60)).cast("int")
    rows = li.select(
        F.col("l_partkey").cast("string").alias("path"), key.alias("id"), key.alias("ord"), F.when(F.pmod("l_orderkey", F.lit(7)) == 0, F.concat(F.lit("s"), F.col("l_linenumber").cast("string"))).otherwise("").alias("structural_key"),
        F.when(F.pmod("l_orderkey", F.lit(5)) == 0, F.concat(F.lit("m"), "l_returnflag", F.pmod("l_suppkey", F.lit(9)).cast("string"))).otherwise("").alias("semantic_key"), F.array(F.concat(F.lit("c"), F.col("l_linenumber").cast("string"))).alias("classes"),
        F.array().cast("array<string>").alias("words"), line.alias("start_line"), (line + 8).alias("end_line"))
    return E.admit(rows)


ADMISSION = _greedy_sql(
    """with recursive d as (select l_partkey::varchar as path, (l_orderkey * 10 + l_linenumber) * 1000 + l_suppkey as id, case when l_orderkey % 7 = 0 then 's' || l_linenumber else '' end as st, case when l_orderkey % 5 = 0 then 'm' || l_returnflag || l_suppkey % 9 else '' end as se, l_linenumber as c, l_orderkey % 60 as a0 from lineitem)""",
    "case when a.st <> '' and b.st <> '' then a.st = b.st when a.se <> '' and b.se <> '' then a.se = b.se else abs(a.a0 - b.a0) <= 8 and a.c = b.c end", "id",
    "((a.st <> '' and a.st = b.st) or (a.se <> '' and a.se = b.se) or abs(a.a0 - b.a0) <= 8)")


def consolidation(spark, d):
    li = table(spark, d, "lineitem")
    supplier, line = F.col("l_suppkey"), F.pmod("l_orderkey", F.lit(60)).cast("int")
    word = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    none = F.array().cast("array<string>")
    rows = li.select(
        F.col("l_partkey").cast("string").alias("path"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000 + F.col("l_suppkey")).alias("id"), F.when(F.col("l_quantity") > 40, "critical").when(F.col("l_quantity") > 20, "Medium").otherwise("odd").alias("severity"),
        F.col("l_discount").alias("confidence"), F.when(F.pmod(supplier, F.lit(3)) > 0, word("h", F.pmod(supplier, F.lit(20)))).otherwise("").alias("root_hash"), word("f", F.pmod(supplier, F.lit(5))).alias("symbol"),
        F.when(F.pmod("l_orderkey", F.lit(2)) == 0, F.array(word("CWE-", F.pmod("l_linenumber", F.lit(3))))).otherwise(none).alias("cwes"), F.array("l_returnflag").alias("classes"), F.array(word("t", F.col("l_linenumber")), F.col("l_linestatus")).alias("title"),
        F.array(word("x", F.pmod(supplier, F.lit(4))), F.lit("y")).alias("fix"), F.when(F.pmod(supplier, F.lit(4)) > 0, F.array(word("i", F.pmod(supplier, F.lit(3))))).otherwise(none).alias("invariant"), line.alias("start"), (line + 4).alias("end"))
    return E.consolidate(rows)


def _alike(column: str, least: float) -> str:
    both = f"len(a.{column}) > 0 and len(b.{column}) > 0"
    return f"({both} and len(list_intersect(a.{column}, b.{column})) >= {least} * len(list_distinct(list_concat(a.{column}, b.{column}))))"


CONSOLIDATION = _greedy_sql(
    """with recursive d as (select l_partkey::varchar as path, (l_orderkey * 10 + l_linenumber) * 1000 + l_suppkey as id, case when l_quantity > 40 then 0 when l_quantity > 20 then 2 else 5 end as sv, l_discount as conf, case when l_suppkey % 3 > 0 then 'h' || l_suppkey % 20 else '' end as root, 'f' || l_suppkey % 5 as sym,
 case when l_orderkey % 2 = 0 then ['CWE-' || l_linenumber % 3] else [] end as cwes, [l_returnflag] as classes, ['t' || l_linenumber, l_linestatus] as title, ['x' || l_suppkey % 4, 'y'] as fix, case when l_suppkey % 4 > 0 then ['i' || l_suppkey % 3] else [] end as inv, l_orderkey % 60 as a0 from lineitem)""",
    f"""not (len(a.cwes) > 0 and len(b.cwes) > 0 and len(list_intersect(a.cwes, b.cwes)) = 0) and not (len(a.inv) > 0 and len(b.inv) > 0 and not {_alike('inv', 0.6)}) and (abs(a.a0 - b.a0) <= 10 or (a.sym = b.sym and a.root <> '' and a.root = b.root))
 and ((a.root <> '' and a.root = b.root) or {_alike('inv', 0.6)}) and ((a.root <> '' and a.root = b.root and len(a.cwes) > 0 and len(b.cwes) > 0) or {_alike('fix', 0.65)} or ({_alike('title', 0.65)} and ((len(a.cwes) > 0 and len(b.cwes) > 0) or {_alike('classes', 0.6)})))""",
    "sv, conf desc, id", "(abs(a.a0 - b.a0) <= 10 or (a.root <> '' and a.root = b.root and a.sym = b.sym))")


def candidate_keys(spark, d):
    p = table(spark, d, "part")
    control = F.when(F.pmod("p_partkey", F.lit(4)) > 0, F.col("p_type"))
    effect = F.when(F.pmod("p_partkey", F.lit(3)) == 0, "unresolved").otherwise(F.col("p_brand"))
    return p.select("p_partkey", E.semantic_key(F.col("p_brand"), F.col("p_name"), control, F.when(F.pmod("p_partkey", F.lit(5)) > 0, F.col("p_type")), F.lit(None).cast("string")).alias("semantic"),
                    E.structural_key(F.col("p_brand"), F.col("p_name"), effect, F.col("p_type")).alias("structural"))


CANDIDATE_KEYS = r"""with p as (select p_partkey, regexp_replace(lower(p_brand), '\b[0-9]+\b', '#', 'g') as b, regexp_replace(lower(p_name), '\b[0-9]+\b', '#', 'g') as n, regexp_replace(lower(p_type), '\b[0-9]+\b', '#', 'g') as t, regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g') as s from part)
select p_partkey, case when p_partkey % 4 = 0 then '' else b || '|' || n || '|' || s || case when p_partkey % 5 > 0 then '|' || t || '|' else '' end end as semantic, case when p_partkey % 3 = 0 then '' else b || '|' || n || '|' || b || '|' || t end as structural from p"""


def assigned_groups(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("fingerprint"), F.col("p_size").alias("group_id"))
    first = p.groupBy("group_id").agg(F.min("fingerprint").alias("primary"))
    return E.grouped_by_assignment(p.select("fingerprint"), p.join(first, "group_id")).select("group_id", "primary", F.array_join("members", ",").alias("members"))


ASSIGNED = "select p_size as group_id, min(p_partkey::varchar) as primary, string_agg(p_partkey::varchar, ',' order by p_partkey::varchar) as members from part group by 1"

QUERIES = {
    "merge_search_windows": merge_search_windows, "merge_anchored_regions": merge_anchored_regions, "chunk_routes": chunk_routes, "pack_batches": pack_batches, "group_worksets": group_worksets, "bounded_flow": bounded_flow, "connected": connected,
    "bounded_slice": bounded_slice, "revalidation": revalidation, "entry_and_terminal": entry_and_terminal, "nested_references": nested_references, "first_span": first_span, "focus_paths": focus_paths, "touched_hunks": touched_hunks,
    "admission": admission, "consolidation": consolidation, "candidate_keys": candidate_keys, "assigned_groups": assigned_groups,
}
ORACLES = {
    "merge_search_windows": WINDOWS, "merge_anchored_regions": ANCHORED, "chunk_routes": ROUTES, "pack_batches": BATCHES, "group_worksets": WORKSETS, "bounded_flow": FLOW, "connected": CONNECTED, "bounded_slice": SLICE, "revalidation": REVALIDATE,
    "entry_and_terminal": ENDS, "nested_references": NESTED, "first_span": FIRST_SPAN, "focus_paths": FOCUS, "touched_hunks": TOUCHED, "greedy_cluster": CLUSTER, "admission": ADMISSION, "consolidation": CONSOLIDATION, "candidate_keys": CANDIDATE_KEYS,
    "assigned_groups": ASSIGNED,
}
