"""Queries over orders, lineitem, parts and events: overlays, joins, graphs, intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenant.operators import graphs as G
from provenant.operators import intervals as I
from provenant.operators import joins as J
from provenant.operators import overlay as V
from provenant.plans.events_queries import micros, table


def changed_paths(spark, d):
    old = table(spark, d, "documents").select("doc_id", F.md5("text").alias("h"))
    m = F.pmod("doc_id", F.lit(10))
    new = old.where(m != 7).select("doc_id", F.when(m == 3, F.md5(F.concat("h", F.lit("x")))).otherwise(F.col("h")).alias("h"))
    extra = old.where(m == 5).select((-F.col("doc_id") - 1).alias("doc_id"), "h")
    return V.delta(old, new.unionByName(extra), ["doc_id"], ["h"])


CHANGED = """with o as (select doc_id, md5(text) as h from documents), n as (select doc_id, case when doc_id % 10 = 3 then md5(h || 'x') else h end as h from o where doc_id % 10 <> 7 union all select -doc_id - 1, h from o where doc_id % 10 = 5)
select coalesce(o.doc_id, n.doc_id) as doc_id, case when o.doc_id is null then 'added' when n.doc_id is null then 'removed' else 'changed' end as change from o full join n on o.doc_id = n.doc_id where o.doc_id is null or n.doc_id is null or o.h is distinct from n.h"""


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.expr("cast(round(o_totalprice * 100) as bigint)").alias("cents"))


def effective_overlay(spark, d):
    o = _orders(spark, d)
    k = F.col("o_orderkey")
    dead = F.pmod(k, F.lit(7)) == 0
    layer = o.where((F.pmod(k, F.lit(5)) == 0) | dead).select(
        "o_orderkey", F.when(dead, "deleted").otherwise("active").alias("state"), F.when(~dead, F.lit("X")).alias("o_orderstatus"), F.when(~dead, F.col("cents") + 1).alias("cents"))
    return V.effective(o, layer, "o_orderkey", ["o_orderstatus", "cents"])


EFFECTIVE = """with o as (select o_orderkey, o_orderstatus, cast(round(o_totalprice * 100) as bigint) as cents from orders)
select o_orderkey, case when o_orderkey % 5 = 0 then 'X' else o_orderstatus end as o_orderstatus, case when o_orderkey % 5 = 0 then cents + 1 else cents end as cents from o where o_orderkey % 7 <> 0"""


def effective_chain(spark, d):
    o = _orders(spark, d)
    k = F.col("o_orderkey")
    one = o.withColumn("depth", F.lit(0)).withColumn("state", F.lit("active"))
    two = o.where(F.pmod(k, F.lit(3)) == 0).withColumn("depth", F.lit(1)).withColumn("state", F.when(F.pmod(k, F.lit(2)) == 0, "deleted").otherwise("active")).withColumn("cents", F.col("cents") + 10)
    three = o.where(F.pmod(k, F.lit(4)) == 0).withColumn("depth", F.lit(2)).withColumn("state", F.when(F.pmod(k, F.lit(5)) == 0, "deleted").otherwise("active")).withColumn("cents", F.col("cents") + 20)
    return V.effective_chain(one.unionByName(two).unionByName(three), "o_orderkey", ["o_orderstatus", "cents"])


CHAIN = """with o as (select o_orderkey as k, o_orderstatus, cast(round(o_totalprice * 100) as bigint) as cents from orders)
select k as o_orderkey, o_orderstatus, case when k % 4 = 0 then cents + 20 when k % 3 = 0 then cents + 10 else cents end as cents from o where not case when k % 4 = 0 then k % 5 = 0 when k % 3 = 0 then k % 2 = 0 else false end"""


def graph_delta(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.pmod("l_orderkey", F.lit(2)).alias("h"))
    out = V.set_delta(e.where("h = 0").drop("h"), e.where("h = 1").drop("h"))
    return out.groupBy("change").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"))


DELTA = """with a as (select distinct l_suppkey as s, l_partkey as t from lineitem where l_orderkey % 2 = 0), b as (select distinct l_suppkey as s, l_partkey as t from lineitem where l_orderkey % 2 = 1),
c as (select 'removed' as change, * from (select * from a except select * from b) union all select 'added', * from (select * from b except select * from a)) select change, count(*) as n, count(distinct s) as sources from c group by 1"""


def upsert_rows(spark, d):
    o = _orders(spark, d)
    old = o.where("o_orderkey % 3 <> 0").withColumn("version", F.lit(4).cast("long"))
    new = o.where("o_orderkey % 2 = 0").withColumn("cents", F.col("cents") + F.pmod("o_orderkey", F.lit(4)))
    return V.upsert_version(old, new, ["o_orderkey"], ["cents"])


UPSERT = """with o as (select o_orderkey as k, o_orderstatus, cast(round(o_totalprice * 100) as bigint) as cents from orders)
select k as o_orderkey, case when k % 3 = 0 then 1 when k % 2 = 0 and k % 4 <> 0 then 5 else 4 end::bigint as version, o_orderstatus, case when k % 2 = 0 then cents + k % 4 else cents end as cents from o where k % 3 <> 0 or k % 2 = 0"""


def packet(spark, d):
    li = table(spark, d, "lineitem")
    first = li.where("l_returnflag = 'R'").select("l_partkey", F.col("l_orderkey").alias("ord"))
    second = li.where("l_returnflag = 'A'").select("l_partkey", F.col("l_orderkey").alias("ord"))
    return V.capped_union(first, second, "l_partkey", 24)


PACKET = """with u as (select l_partkey, min(struct_pack(s := case l_returnflag when 'R' then 0 else 1 end, o := l_orderkey)) as p from lineitem where l_returnflag in ('R', 'A') group by 1)
select l_partkey, row_number() over (order by p, l_partkey) - 1 as ord from u qualify row_number() over (order by p, l_partkey) <= 24"""


def overlay_lookup(spark, d):
    o = _orders(spark, d)
    ids = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("ord"))
    top = o.where("o_orderkey % 5 = 0").withColumn("o_orderstatus", F.lit("X"))
    return J.overlay_lookup(ids, top, o.where("o_orderkey % 7 <> 0"), "o_orderkey", ["o_orderstatus", "cents"])


LOOKUP = """select l_orderkey as o_orderkey, l_partkey * 10 + l_linenumber as ord, case when l_orderkey % 5 = 0 then 'X' else o_orderstatus end as o_orderstatus, cast(round(o_totalprice * 100) as bigint) as cents
from lineitem join orders on l_orderkey = o_orderkey where l_orderkey % 5 = 0 or l_orderkey % 7 <> 0"""


def call_edges(spark, d):
    """Each edge, between names that a handful of symbols share."""
    s = table(spark, d, "part").select(F.col("p_partkey").alias("symbol_id"), F.col("p_brand").alias("path"), F.concat_ws(".", "p_brand", F.concat(F.lit("f"), F.floor(F.col("p_partkey") / 4).cast("string"))).alias("name"))
    calls = table(spark, d, "lineitem").join(s.select(F.col("symbol_id").alias("l_partkey"), "path", "name"), "l_partkey").select(
        "path", F.col("name").alias("caller"), F.concat(F.lit("m.f"), F.floor(F.col("l_suppkey") / 3).cast("string")).alias("callee"))
    return J.resolve_edges(calls, s)


CALLS = """with s as (select p_partkey as id, p_brand as path, p_brand || '.f' || (p_partkey // 4) as name, 'f' || (p_partkey // 4) as last from part), c as (select distinct path, name as caller, 'f' || (l_suppkey // 3) as callee from lineitem join s on id = l_partkey)
select distinct a.id as source_id, b.id as target_id from c join s a on a.path = c.path and a.name = c.caller join s b on b.last = c.callee where a.id <> b.id"""


def edge_resolution(spark, d):
    """The calls of all lines, to names that a fifth of all symbols share."""
    s = table(spark, d, "part").select(F.col("p_partkey").alias("symbol_id"), F.col("p_brand").alias("path"), F.concat_ws(".", F.replace("p_type", F.lit(" "), F.lit("_")), F.concat(F.lit("f"), F.pmod("p_size", F.lit(5)).cast("string"))).alias("name"))
    calls = table(spark, d, "lineitem").join(s.select(F.col("symbol_id").alias("l_partkey"), "path", "name"), "l_partkey").select(
        "path", F.col("name").alias("caller"), F.concat(F.lit("m.f"), F.pmod("l_suppkey", F.lit(7)).cast("string")).alias("callee")).distinct()
    return J.resolve_edge_totals(calls, s)


EDGES = """with s as (select p_partkey as id, p_brand as path, replace(p_type, ' ', '_') || '.f' || (p_size % 5) as name, 'f' || (p_size % 5) as last from part),
c as (select distinct path, name as caller, last as own, 'f' || (l_suppkey % 7) as callee from lineitem join s on id = l_partkey), x as (select distinct a.id, c.own, c.callee from c join s a on a.path = c.path and a.name = c.caller), k as (select last, count(*) as n, sum(id) as t from s group by 1)
select x.id as source_id, sum(n - case when own = callee then 1 else 0 end)::bigint as n, sum(t - case when own = callee then x.id else 0 end)::bigint as targets from x join k on k.last = x.callee group by 1 having sum(n - case when own = callee then 1 else 0 end) > 0"""


def unique_resolution(spark, d):
    p = table(spark, d, "part")
    left = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("Brand#"), (F.pmod("c_custkey", F.lit(60))).cast("string")).alias("brand"), F.pmod("c_custkey", F.lit(50)).alias("size"))
    return J.resolve_unique(left, p.select("p_partkey", "p_brand", "p_size"), [("brand", "p_brand"), ("size", "p_size")], "c_custkey", "p_partkey").select("c_custkey", "n_targets", "target")


UNIQUE = """select c_custkey, count(distinct p_partkey) as n_targets, case when count(distinct p_partkey) = 1 then min(p_partkey) end as target
from customer left join part on p_brand = 'Brand#' || (c_custkey % 60) and p_size = c_custkey % 50 group by 1"""


def _seconds(df, *keep):
    return df.select(*keep, F.floor(micros("ts") / 1_000_000).cast("long").alias("s"))


def enclosing_span(spark, d):
    e = _seconds(table(spark, d, "events"), "event_id", "user_id", "event_type")
    spans = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("span_id"), F.col("s").alias("start_line"), (F.col("s") + 600 * (1 + F.pmod("event_id", F.lit(40)))).alias("end_line"), F.col("event_id").alias("ord"))
    points = e.where("event_type <> 'click'").select(F.col("event_id").alias("id"), "user_id", F.col("s").alias("line"))
    return J.enclosing_span(points, spans, ["user_id"]).select("id", "span_id")


ENCLOSING = """with e as (select *, epoch_us(ts) // 1000000 as s from events), c as (select user_id, event_id, s, s + 600 * (1 + event_id % 40) as t from e where event_type = 'click'),
m as (select e.event_id as id, arg_min(c.event_id, (greatest(1, c.t - c.s), c.event_id)) as span_id from e join c on e.user_id = c.user_id and e.s between c.s and c.t where e.event_type <> 'click' group by 1)
select e.event_id as id, m.span_id from e left join m on m.id = e.event_id where e.event_type <> 'click'"""


def asof_symbol(spark, d):
    e = _seconds(table(spark, d, "events"), "event_id", "user_id", "event_type")
    left = e.where("event_type = 'error'").select("event_id", "user_id", "s")
    right = e.where("event_type = 'click'").select("user_id", "s", F.col("event_id").alias("click_id"), F.col("event_id").alias("ord"))
    return J.as_of(left, right, "user_id", "s", "click_id").select("event_id", "user_id", "click_id")


ASOF = """with e as (select *, epoch_us(ts) // 1000000 as s from events), r as (select user_id, s, min(event_id) as click_id from e where event_type = 'click' group by 1, 2)
select l.event_id, l.user_id, r.click_id from (select * from e where event_type = 'error') l asof left join r on l.user_id = r.user_id and l.s >= r.s"""


def _windows(spark, d, status):
    o = table(spark, d, "orders").where(F.col("o_orderstatus") == status)
    day = F.floor(micros("o_orderdate") / 86_400_000_000).cast("long")
    return o.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), day.alias("start"), (day + 30).alias("end"))


def interval_overlap(spark, d):
    return J.overlapping(_windows(spark, d, "O"), _windows(spark, d, "F"), "key").select("key", "left_id", "right_id")


OVERLAP = """with o as (select o_custkey as key, o_orderkey as id, o_orderstatus as st, epoch_us(o_orderdate) // 86400000000 as s from orders)
select a.key, a.id as left_id, b.id as right_id from o a join o b on a.key = b.key and a.s <= b.s + 30 and b.s <= a.s + 30 where a.st = 'O' and b.st = 'F'"""


def nearest_support(spark, d):
    c = table(spark, d, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL").select(F.col("conv_id").alias("conv"), F.col("turn").alias("pos"), "role", F.length("text").alias("n"))
    steps = c.groupBy("conv", "pos").agg(F.min("role").alias("role"), F.max("n").alias("n"))
    return J.nearest_supporting(steps, "conv", lambda a, b: (F.col(f"{a}.role") != F.col(f"{b}.role")) & (F.pmod(F.col(f"{a}.n"), F.lit(3)) == F.pmod(F.col(f"{b}.n"), F.lit(3))))


SUPPORT = """with s as (select conv_id as conv, turn as pos, min(role) as role, max(length(text)) as n from conversations where conv_id is not null and turn is not null group by 1, 2)
select b.conv, b.pos, max(a.pos) as support from s b left join s a on a.conv = b.conv and a.pos < b.pos and a.role <> b.role and a.n % 3 = b.n % 3 group by 1, 2"""


def alias_join(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.regexp_replace("p_type", " ", ".").alias("name"))
    names = p.select("id", F.element_at(F.split("name", r"\."), -1).alias("short"))
    return J.alias_totals(names, p, "short", "name")


ALIAS = """with p as (select p_partkey as id, lower(replace(p_type, ' ', '.')) as name from part), a as (select id, unnest([name, list_extract(string_split(name, '.'), -1)]) as al from p), n as (select id, list_extract(string_split(name, '.'), -1) as al from p)
select left_id, count(*) as n, sum(right_id)::bigint as rights from (select distinct n.id as left_id, a.id as right_id from n join a using (al)) group by 1"""


def greedy_match(spark, d):
    o = table(spark, d, "orders").select(F.pmod("o_custkey", F.lit(20)).alias("case"), F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("ord"), F.pmod("o_orderkey", F.lit(17)).alias("v"))
    e = table(spark, d, "events").select(F.pmod("user_id", F.lit(20)).alias("case"), F.col("event_id").alias("id"), F.col("event_id").alias("ord"), F.pmod("event_id", F.lit(17)).alias("v"))
    return J.greedy_match_within(o, e, 1)


def _supplier_edges(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    nxt = li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_suppkey").alias("target"))
    return li.join(nxt, ["l_orderkey", "l_linenumber"]).select(F.col("l_suppkey").alias("source"), "target").distinct()


EDGE_SQL = "e as (select distinct a.l_suppkey as s, b.l_suppkey as t from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1)"


def reverse_reach(spark, d):
    start = table(spark, d, "supplier").where("s_suppkey <= 2").select(F.col("s_suppkey").alias("node"))
    return G.reverse_reach(_supplier_edges(spark, d), start, 3).select("node", F.col("depth").cast("long").alias("depth"))


REACH = f"""with recursive {EDGE_SQL}, r(node, depth) as (select s_suppkey, 0::bigint from supplier where s_suppkey <= 2 union select e.s, r.depth + 1 from r join e on e.t = r.node where r.depth < 3)
select node, min(depth) as depth from r group by 1"""


def fanout_capped(spark, d):
    nodes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"))
    return G.fan_out(_supplier_edges(spark, d), nodes, nodes.where("node <= 2"), 2, 20)


FANOUT = f"""with recursive {EDGE_SQL}, r(node, depth) as (select s_suppkey, 0 from supplier where s_suppkey <= 2 union select e.s, r.depth + 1 from r join e on e.t = r.node where r.depth < 2),
m as (select node, min(depth) as depth from r group by 1), c as (select (select count(*) from m) > 20 or exists (select 1 from e join m on e.t = m.node where m.depth = 2) as all_)
select s_suppkey as node, (select all_ from c) or s_suppkey in (select node from m) as invalid from supplier"""


def components(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("target"))
    t = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("target", F.concat_ws(":", F.col("l_partkey").cast("string"), F.date_format("l_shipdate", "yyyy-MM")).alias("node"))
    none = t.select(F.col("node").alias("source"), F.col("node").alias("target")).limit(0)
    return G.target_groups(t, none)


COMPONENTS = """with recursive t as (select distinct o_custkey as c, l_partkey::varchar || ':' || strftime(l_shipdate, '%Y-%m') as n from orders join lineitem on l_orderkey = o_orderkey),
p as (select distinct a.c as x, b.c as y from t a join t b using (n)), r(x, y) as (select x, y from p union select r.x, p.y from r join p on p.x = r.y) select x as target, min(y) as component from r group by 1"""


def neighbourhood(spark, d):
    e = _supplier_edges(spark, d).withColumn("relation", F.when(F.pmod("source", F.lit(2)) == 0, "CALLS").otherwise("refs"))
    nodes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"))
    return G.neighbours(e, nodes, "both", ["calls"], 4)


NEIGHBOURS = f"""with {EDGE_SQL}, p as (select s as node, t as neighbour from e where s % 2 = 0 union select t, s from e where s % 2 = 0),
r as (select *, row_number() over (partition by node order by neighbour) as rn, count(*) over (partition by node) as n_total from p where node in (select s_suppkey from supplier))
select node, neighbour, n_total, n_total > 4 as truncated from r where rn <= 4"""


def neighbourhood_hash(spark, d):
    e = table(spark, d, "lineitem").select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("edge_id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target"))
    return G.neighbourhood_hashes(e)


NHASH = """with e as (select distinct l_orderkey::varchar || '-' || l_linenumber as id, 's' || l_suppkey as s, 'p' || l_partkey as t from lineitem), u as (select id, s as node from e union select id, t from e)
select node, count(*) as degree, sha256(string_agg(id, ',' order by id)) as hash from u group by 1"""


def stale_dependencies(spark, d):
    o = table(spark, d, "orders")
    rec = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("owner"), F.when(F.pmod("l_orderkey", F.lit(11)) == 0, "unresolved").when(F.col("l_linenumber") == 1, "file").otherwise("node").alias("kind"), F.col("l_orderkey").alias("key"), F.pmod("l_orderkey", F.lit(3)).alias("hash"))
    cur = o.where("o_orderkey % 13 <> 0").select(F.explode(F.array(F.lit("file"), F.lit("node"), F.lit("unresolved"))).alias("kind"), F.col("o_orderkey").alias("key"), F.when(F.pmod("o_orderkey", F.lit(17)) == 0, F.lit(9)).otherwise(F.pmod("o_orderkey", F.lit(3))).alias("hash"))
    return G.mismatch_reasons(rec, cur).select("owner", F.array_join("reasons", ",").alias("reasons"))


STALE = """with r as (select l_suppkey as owner, case when l_orderkey % 11 = 0 then 'unresolved' when l_linenumber = 1 then 'file' else 'node' end as kind, l_orderkey as k from lineitem)
select owner, string_agg(distinct kind, ',' order by kind) as reasons from r where kind = 'unresolved' or k % 13 = 0 or k % 17 = 0 or k not in (select o_orderkey from orders) group by 1"""


def merge_windows(spark, d):
    e = _seconds(table(spark, d, "events"), "user_id").select("user_id", F.floor(F.col("s") / 60).cast("long").alias("start"))
    return I.merge_near(e.select("user_id", "start", (F.col("start") + 5).alias("end")), "user_id", 200)


MERGE_W = """with e as (select user_id, epoch_us(ts) // 60000000 as s from events), f as (select *, case when s - max(s + 5) over w > 200 or max(s + 5) over w is null then 1 else 0 end as n from e window w as (partition by user_id order by s rows between unbounded preceding and 1 preceding)),
g as (select *, sum(n) over (partition by user_id order by s rows unbounded preceding) as i from f) select user_id, min(s) as start, max(s + 5) as "end", count(*) as n from g group by user_id, i"""


def subtract_ranges(spark, d):
    e = _seconds(table(spark, d, "events"), "user_id", "event_id").select("user_id", "event_id", F.floor(F.col("s") / 60).cast("long").alias("start"))
    covered = e.select("user_id", "start", (F.col("start") + 30).alias("end"))
    ranges = e.select("user_id", F.col("event_id").alias("id"), (F.col("start") - 20).alias("start"), (F.col("start") + 100).alias("end"))
    return I.subtract(ranges, covered, "user_id").groupBy("id").agg(F.sum(F.col("end") - F.col("start") + 1).alias("minutes"), F.min("start").alias("first"), F.max("end").alias("last"))


SUBTRACT = """with e as (select user_id, event_id, epoch_us(ts) // 60000000 as s from events), r as (select user_id, event_id as id, unnest(range(s - 20, s + 101)) as m from e),
c as (select distinct user_id, unnest(range(s, s + 31)) as m from e) select id, count(*) as minutes, min(m) as first, max(m) as last from r anti join c using (user_id, m) group by 1"""


def line_mapping(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("line"))
    hunk = lambda a, b, c, n: F.struct(F.lit(a).alias("old_start"), F.lit(b).alias("old_lines"), F.lit(c).alias("new_start"), F.lit(n).alias("new_lines"))
    hunks = F.array(hunk(5, 0, 6, 5), hunk(20, 3, 25, 1), hunk(40, 2, 43, 0))
    return p.withColumn("_m", I.map_lines(hunks, F.col("line"), F.col("line") + 2)).select("p_partkey", F.col("_m.start").cast("long").alias("start"), F.col("_m.end").cast("long").alias("end"))


LINES = """with f(l) as (select p_size from part group by 1), m as (select u.l, case when l between 20 and 22 then 25 when l between 40 and 41 then 43 else l + case when l > 5 then 5 else 0 end - case when l > 22 then 2 else 0 end - case when l > 41 then 2 else 0 end end as a,
 case when l between 20 and 22 then 25 when l between 40 and 41 then 43 else l + case when l > 5 then 5 else 0 end - case when l > 22 then 2 else 0 end - case when l > 41 then 2 else 0 end end as b from (select l from f union select l + 2 from f) u)
select p_partkey, greatest(1, x.a)::bigint as start, greatest(1, y.b, x.a)::bigint as "end" from part join m x on x.l = p_size join m y on y.l = p_size + 2"""

QUERIES = {
    "changed_paths": changed_paths, "effective_overlay": effective_overlay, "effective_chain": effective_chain, "graph_delta": graph_delta, "upsert_rows": upsert_rows, "packet": packet, "overlay_lookup": overlay_lookup,
    "edge_resolution": edge_resolution, "call_edges": call_edges, "unique_resolution": unique_resolution, "enclosing_span": enclosing_span, "asof_symbol": asof_symbol, "interval_overlap": interval_overlap, "nearest_support": nearest_support,
    "alias_join": alias_join, "greedy_match": greedy_match, "reverse_reach": reverse_reach, "fanout_capped": fanout_capped, "components": components, "neighbourhood": neighbourhood,
    "neighbourhood_hash": neighbourhood_hash, "stale_dependencies": stale_dependencies, "merge_windows": merge_windows, "subtract_ranges": subtract_ranges, "line_mapping": line_mapping,
}
ORACLES = {
    "changed_paths": CHANGED, "effective_overlay": EFFECTIVE, "effective_chain": CHAIN, "graph_delta": DELTA, "upsert_rows": UPSERT, "packet": PACKET, "overlay_lookup": LOOKUP, "edge_resolution": EDGES, "call_edges": CALLS,
    "unique_resolution": UNIQUE, "enclosing_span": ENCLOSING, "asof_symbol": ASOF, "interval_overlap": OVERLAP, "nearest_support": SUPPORT, "alias_join": ALIAS, "reverse_reach": REACH, "fanout_capped": FANOUT,
    "components": COMPONENTS, "neighbourhood": NEIGHBOURS, "neighbourhood_hash": NHASH, "stale_dependencies": STALE, "merge_windows": MERGE_W, "subtract_ranges": SUBTRACT, "line_mapping": LINES,
}
