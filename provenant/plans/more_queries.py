"""More queries: filters, upserts, cascades, ledgers, text functions, snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenant.functions import ids
from provenant.functions import text as T
from provenant.operators import aggregates as A
from provenant.operators import filters as X
from provenant.operators import graphs as G
from provenant.operators import intervals as I
from provenant.operators import joins as J
from provenant.operators import lifecycle as L
from provenant.operators import overlay as V
from provenant.operators import policy as P
from provenant.operators import ranking as R
from provenant.operators import resolution as E
from provenant.operators import snapshots as S
from provenant.plans.events_queries import CENTS, micros, table


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.expr("cast(round(o_totalprice * 100) as bigint)").alias("cents"))


O = "o as (select o_orderkey, o_custkey, o_orderstatus, cast(round(o_totalprice * 100) as bigint) as cents from orders)"


def effective_scope(spark, d):
    o = _orders(spark, d).withColumn("own", F.when(F.pmod("o_orderkey", F.lit(3)) != 0, F.col("o_custkey"))).withColumn("category", F.when(F.pmod("o_orderkey", F.lit(4)) == 0, "all").otherwise(F.col("o_orderstatus")))
    return o.where(X.effective_scope(F.col("own"), F.lit(7), F.col("category"), "F")).select("o_orderkey")


SCOPE = "select o_orderkey from orders where (o_orderkey % 3 = 0 or o_custkey = 7) and (o_orderkey % 4 = 0 or o_orderstatus = 'F')"


def wildcard_filter(spark, d):
    return table(spark, d, "part").where(X.contains_any(["p_name", "p_type"], F.lit("d_w"))).select("p_partkey")


WILDCARD = "select p_partkey from part where p_name ilike '%d_w%' or p_type ilike '%d_w%'"


def evidence_present(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("report_id"), F.struct(F.col("l_partkey").alias("path"), F.col("l_linenumber").alias("start_line"), (F.col("l_linenumber") + F.pmod("l_suppkey", F.lit(30))).alias("end_line")).alias("l"))
    reports = li.groupBy("report_id").agg(F.collect_list("l").alias("locations"))
    files = table(spark, d, "part").where("p_partkey % 41 <> 0").select(F.col("p_partkey").alias("path"), (F.col("p_size") + 20).alias("line_count"))
    return X.evidence_present(reports, files).select("report_id")


PRESENT = """select l_orderkey as report_id from lineitem left join (select * from part where p_partkey % 41 <> 0) on p_partkey = l_partkey group by 1
having bool_and(p_partkey is not null and l_linenumber + l_suppkey % 30 <= p_size + 20)"""


def reusable_reports(spark, d):
    o = _orders(spark, d)
    reports = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("scan_id"), F.col("l_partkey").alias("finding_id"), F.pmod("l_suppkey", F.lit(2)).alias("schema_version"), F.when(F.col("l_returnflag") != "A", F.array(F.lit("p"))).alias("taint_path"))
    scans = o.select(F.col("o_orderkey").alias("scan_id"), F.when(F.col("o_orderstatus") == "O", "SUCCESSFUL").otherwise("FAILED").alias("status"), F.lit("w1").alias("workflow"), F.pmod("o_custkey", F.lit(3)).cast("string").alias("scope"))
    findings = table(spark, d, "part").select(F.col("p_partkey").alias("finding_id"), F.when(F.pmod("p_size", F.lit(2)) == 0, "open").otherwise("fixed").alias("state"), (F.pmod("p_size", F.lit(3)) == 0).alias("graph_complete"))
    return X.reusable(reports, scans, findings, "w1", "1", True).groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"))


REUSABLE = """select l_orderkey as scan_id, count(*) as n from lineitem join orders on o_orderkey = l_orderkey join part on p_partkey = l_partkey
where l_suppkey % 2 = 1 and l_returnflag <> 'A' and o_orderstatus = 'O' and o_custkey % 3 = 1 and p_size % 2 = 0 and p_size % 3 = 0 group by 1"""


def insert_absent(spark, d):
    o = _orders(spark, d)
    return V.insert_absent(o.where("o_orderkey % 3 <> 0"), o.where("o_orderkey % 2 = 0").withColumn("cents", F.lit(0).cast("long")), ["o_orderkey"])


INSERT = f"with {O} select o_orderkey, o_custkey, o_orderstatus, case when o_orderkey % 3 = 0 then 0 else cents end as cents from o where o_orderkey % 3 <> 0 or o_orderkey % 2 = 0"


def replace_rows(spark, d):
    o = _orders(spark, d).drop("o_custkey")
    key = F.when(F.pmod("l_suppkey", F.lit(2)) == 0, F.col("l_orderkey")).otherwise(-F.col("l_orderkey"))
    # an order has lines of one number: of these the first in the table counts, wherever it is read
    place = F.struct("_metadata.file_path", "_metadata.row_index").alias("place")
    writes = table(spark, d, "lineitem").select(key.alias("o_orderkey"), F.col("l_returnflag").alias("o_orderstatus"), F.col("l_partkey").cast("long").alias("cents"), F.col("l_linenumber").alias("w"), place)
    return V.replace_rows(o, writes, ["o_orderkey"], "w", "place")


REPLACE = f"""with {O}, l as (select case when l_suppkey % 2 = 0 then l_orderkey else -l_orderkey end as l_orderkey, l_returnflag, l_partkey, l_linenumber from lineitem), w as (select l_orderkey, l_returnflag, l_partkey from l qualify row_number() over (partition by l_orderkey order by l_linenumber desc) = 1)
select o_orderkey, o_orderstatus, cents from o where o_orderkey not in (select l_orderkey from w) union all select l_orderkey, l_returnflag, l_partkey from w"""


def update_columns(spark, d):
    o = _orders(spark, d)
    new = o.where("o_orderkey % 2 = 0").withColumn("cents", F.col("cents") + 5).withColumn("o_orderstatus", F.lit("N"))
    return V.update_columns(o.where("o_orderkey % 3 <> 0"), new, ["o_orderkey"], ["cents"])


UPDATE = f"with {O} select o_orderkey, o_custkey, case when o_orderkey % 3 = 0 then 'N' else o_orderstatus end as o_orderstatus, case when o_orderkey % 2 = 0 then cents + 5 else cents end as cents from o where o_orderkey % 3 <> 0 or o_orderkey % 2 = 0"


def replace_children(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("long").alias("v"))
    new = _orders(spark, d).where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(99).alias("l_linenumber"), F.lit(0).cast("long").alias("v"))
    return V.replace_children(li, new, "l_orderkey")


CHILDREN = "select l_orderkey, l_linenumber, l_partkey as v from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderkey % 5 = 0) union all select o_orderkey, 99, 0 from orders where o_orderkey % 5 = 0"


def guarded_update(spark, d):
    o = _orders(spark, d)
    return V.guarded_update(o, (F.col("o_orderstatus") == "O") & (F.col("cents") > 10_000_000), {"o_orderstatus": F.lit("done")})


GUARDED = f"with {O} select o_orderkey, o_custkey, case when o_orderstatus = 'O' and cents > 10000000 then 'done' else o_orderstatus end as o_orderstatus, cents, o_orderstatus = 'O' and cents > 10000000 as updated from o"


def sparse_layer(spark, d):
    o = _orders(spark, d).select("o_orderkey", "cents")
    wanted = o.where("o_orderkey % 6 <> 0").withColumn("cents", F.col("cents") + F.when(F.pmod("o_orderkey", F.lit(5)) == 0, 1).otherwise(0))
    return V.sparse_layer(o, wanted, "o_orderkey", ["cents"])


SPARSE = f"with {O} select o_orderkey, case when o_orderkey % 6 = 0 then 'deleted' else 'active' end as state, case when o_orderkey % 6 <> 0 then cents + 1 end as cents from o where o_orderkey % 6 = 0 or o_orderkey % 5 = 0"


def fill_missing(spark, d):
    o = _orders(spark, d).withColumn("cents", F.when(F.pmod("o_orderkey", F.lit(4)) != 0, F.col("cents")))
    found = _orders(spark, d).where("o_orderkey % 8 = 0").select("o_orderkey", "cents")
    return V.fill_missing(o, found, ["o_orderkey"], "cents")[0]


FILL = f"with {O} select o_orderkey, o_custkey, o_orderstatus, case when o_orderkey % 4 <> 0 or o_orderkey % 8 = 0 then cents end as cents from o"


def baseline_cascade(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    li = table(spark, d, "lineitem")
    one = li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("matched"), F.col("l_linenumber").alias("ord"))
    two = li.where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("matched"), F.col("l_linenumber").alias("ord"))
    return J.first_match(o, "o_orderkey", [("root", one), ("location", two)])


CASCADE = """with m as (select l_orderkey, 0 as i, l_linenumber as o, 'root' as stage, l_partkey as m from lineitem where l_returnflag = 'R' union all select l_orderkey, 1, l_linenumber, 'location', l_partkey from lineitem where l_quantity > 40),
b as (select * from m qualify row_number() over (partition by l_orderkey order by i, o, stage, m) = 1) select o_orderkey, stage, m as matched from orders left join b on l_orderkey = o_orderkey"""


def existing_elsewhere(spark, d):
    base = _orders(spark, d).select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "RESOLVED").otherwise("OPEN").alias("status"))
    hit = table(spark, d, "lineitem").where("l_returnflag = 'N' AND l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.still_open_elsewhere(base, hit, "o_orderkey")


EXISTING = "select o_orderkey, 'OPEN' as status, 'EXISTING' as relationship from orders where o_orderstatus <> 'F' and o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'N' and l_quantity > 25)"


def nodes_in_ranges(spark, d):
    n = table(spark, d, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_brand").alias("path"), F.col("p_size").alias("line"), F.left("p_type", F.lit(1)).alias("source_hash"))
    r = table(spark, d, "supplier").select(F.col("s_suppkey").alias("range_id"), F.concat(F.lit("Brand#"), (F.pmod("s_suppkey", F.lit(60))).cast("string")).alias("path"), F.lit("S").alias("hash"), F.pmod("s_suppkey", F.lit(50)).alias("start_line"), (F.pmod("s_suppkey", F.lit(50)) + 3).alias("end_line"), (F.pmod("s_suppkey", F.lit(7)) != 0).alias("verified"))
    return J.nodes_in_ranges(r, n).select("range_id", "mapping", F.size("nodes").cast("long").alias("n"))


RANGES = """with r as (select s_suppkey as id, 'Brand#' || (s_suppkey % 60) as path, s_suppkey % 50 as a, s_suppkey % 7 <> 0 as ok from supplier),
g as (select id, any_value(ok) as ok, count(p_partkey) as anyn, count(*) filter (left(p_type, 1) = 'S') as same, count(distinct case when left(p_type, 1) = 'S' and p_size between a and a + 3 then p_partkey end) as n from r left join part on p_brand = path group by id)
select id as range_id, case when not ok then 'unverified_location' when anyn > 0 and same = 0 then 'stale_source' when n = 0 then 'unmapped' when n = 1 then 'mapped' else 'ambiguous' end as mapping, n from g"""


def first_covering(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey", F.floor(micros("o_orderdate") / 86_400_000_000).cast("long").alias("day"))
    seg = o.where("o_orderkey % 2 = 0").select("key", F.col("o_orderkey").alias("id"), F.col("day").alias("start"), (F.col("day") + 9).alias("end"))
    reg = o.where("o_orderkey % 2 = 1").select("key", F.col("o_orderkey").alias("region"), F.col("o_orderkey").alias("ord"), (F.col("day") - 60).alias("start"), (F.col("day") + 60).alias("end"))
    return I.first_covering(seg, reg, "key", 0.5).select("id", "region")


COVERING = """with o as (select o_custkey as key, o_orderkey as id, epoch_us(o_orderdate) // 86400000000 as s from orders),
m as (select a.id, min(b.id) as region from o a join o b on a.key = b.key and b.id % 2 = 1 and (least(a.s + 9, b.s + 60) - greatest(a.s, b.s - 60) + 1) / 10 >= 0.5 where a.id % 2 = 0 group by 1)
select o.id, m.region from o left join m using (id) where o.id % 2 = 0"""


def thresholds(spark, d):
    m = table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.sum(F.expr(CENTS)).alias("actual"))
    t = spark.createDataFrame([("click", 0), ("error", 1 << 40), ("view", None)], "name string, maximum long")
    return A.failed_thresholds(m, t)


THRESHOLDS = f"select 'click' as name, sum({CENTS})::bigint as actual, 0::bigint as maximum from events where event_type = 'click'"


def reuse_percent(spark, d):
    o = _orders(spark, d).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("base"), F.count_if(F.col("o_orderstatus") == "F").alias("changed"))
    return o.select("o_custkey", A.reuse_percentage(F.col("base"), F.col("changed")).cast("long").alias("percent"))


REUSE = "select o_custkey, round_even((count(*) - count(*) filter (o_orderstatus = 'F')) * 100 / count(*), 0)::bigint as percent from orders group by 1"


def budget_cutoff(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", micros("ts").alias("at"), F.expr(CENTS).alias("cents"))
    return A.budget_cutoff(e, "user_id", ["at", "event_id"], "cents", 30_000).select("event_id", "spent", "allowed")


CUTOFF = f"select event_id, sum({CENTS}) over w::bigint as spent, sum({CENTS}) over w <= 30000 as allowed from events window w as (partition by user_id order by ts, event_id rows unbounded preceding)"


def first_items(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    return R.first_n(li, "l_suppkey", ["l_orderkey", "l_linenumber"], 5)


FIRST = "select l_suppkey, l_orderkey, l_linenumber, greatest(0, n - 5)::bigint as omitted from (select *, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber) as rn, count(*) over (partition by l_suppkey) as n from lineitem) where rn <= 5"


def newest_exploded(spark, d):
    runs = table(spark, d, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("parts"))
    return R.newest_exploded(runs, "l_suppkey", ["l_orderkey"], 3, "parts").select("l_suppkey", F.col("run_rank").cast("long").alias("run_rank"), F.col("pos").cast("long").alias("pos"), "item")


NEWEST = """with r as (select l_suppkey, l_orderkey, list_sort(list(distinct l_partkey)) as p, row_number() over (partition by l_suppkey order by l_orderkey desc) as run_rank from lineitem group by 1, 2)
select l_suppkey, run_rank, generate_subscripts(p, 1) - 1 as pos, unnest(p) as item from r where run_rank <= 3"""


def truncated_prefix(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", "text")
    return R.truncate_within(docs, "source", ["doc_id"], "text", 10_000).select("doc_id", F.length("text").cast("long").alias("n"), F.md5("text").alias("h"))


TRUNCATED = """with r as (select *, 10000 - coalesce(sum(length(text)) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) as room from documents)
select doc_id, length(left(text, room::bigint)) as n, md5(left(text, room::bigint)) as h from r where room > 0"""


def stable_keys(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("path"), F.lit("def").alias("kind"), F.element_at(F.split("p_type", " "), -1).alias("name"), F.col("p_size").cast("string").alias("signature"), F.col("p_partkey").alias("start_line"), F.col("p_partkey").alias("ord"))
    return ids.stable_keys(p).select(F.col("ord").alias("p_partkey"), "stable_key", "symbol_id")


STABLE = """with s as (select p_partkey, p_brand as path, list_extract(string_split(p_type, ' '), -1) as name, left(sha256(p_size::varchar), 16) as sig from part),
k as (select p_partkey, path || ':def:' || name || case when count(*) over (partition by path, name) > 1 then ':' || sig || ':' || (row_number() over (partition by path, name, sig order by p_partkey) - 1) else '' end as stable_key from s)
select p_partkey, stable_key, 'sym-' || left(sha256(stable_key), 16) as symbol_id from k"""


def tree_hashes(spark, d):
    f = table(spark, d, "part").select(F.pmod("p_partkey", F.lit(9)).alias("snapshot_id"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("path"), F.md5("p_type").alias("content_hash"))
    out = ids.tree_hash(f)
    return out.withColumn("stable", ids.stable_id("snap", [F.col("snapshot_id"), F.col("tree_hash")]))


TREE = """with t as (select p_partkey % 9 as snapshot_id, sha256(string_agg(p_name || p_partkey || chr(0) || md5(p_type) || chr(0), '' order by p_name || p_partkey)) as tree_hash from part group by 1)
select *, 'snap-' || left(sha256(snapshot_id || ':' || tree_hash), 32) as stable from t"""


def source_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", T.source_hash(F.col("text")).alias("h"), T.slug(F.substring("text", 1, 40)).alias("slug"))


SOURCE = r"""select doc_id, sha256(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) as h, regexp_replace(regexp_replace(lower(left(text, 40)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from documents"""


def canonical_classes(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.pmod("p_partkey", F.lit(5)) == 0, F.concat(F.lit("CWE-0"), F.col("p_size").cast("string"), F.lit(" cwe_"), F.pmod("p_partkey", F.lit(40)).cast("string"))).otherwise(F.concat("p_type", F.lit(" via the input"))).alias("c"))
    return p.select("p_partkey", T.canonical_class(F.col("c"), F.lit("")).alias("class"))


CLASSES = f"""with p as (select p_partkey, p_size, p_type from part), w as (select p_partkey, unnest(list_distinct(regexp_extract_all(lower(p_type || ' via the input'), '[a-z0-9]+'))) as w from p),
t as (select p_partkey, string_agg(w, '-' order by w) as t from w where length(w) > 2 and w not in ({", ".join(f"'{x}'" for x in T.PLAIN_WORDS)}) group by 1)
select p.p_partkey, case when p.p_partkey % 5 = 0 then 'cwe-' || least(p_size, p.p_partkey % 40) else t.t end as class from p left join t using (p_partkey)"""


def routing(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > 40, "critical").when(F.col("l_quantity") > 20, "Medium").when(F.col("l_quantity") > 10, "info").otherwise("odd").alias("s"))
    return li.select("l_orderkey", "l_linenumber", P.route(F.col("s")).alias("tier"), T.severity_rank(F.col("s")).cast("long").alias("rank"))


ROUTING = "select l_orderkey, l_linenumber, case when l_quantity > 40 then 'deep' when l_quantity > 20 then 'standard' when l_quantity > 10 then 'fast' else 'standard' end as tier, case when l_quantity > 40 then 0 when l_quantity > 20 then 2 when l_quantity > 10 then 4 else 5 end::bigint as rank from lineitem"


def relationships(spark, d):
    li = table(spark, d, "lineitem")
    state = F.when(F.col("l_returnflag") == "R", "resolved").when(F.col("l_returnflag") == "A", "open")
    return li.select("l_orderkey", "l_linenumber", P.relationship(state, F.col("l_linestatus") == "O", F.pmod("l_partkey", F.lit(3)) == 0).alias("relationship"))


RELATIONS = "select l_orderkey, l_linenumber, case when l_returnflag = 'R' then 'REGRESSED' when l_returnflag = 'A' then case when l_linestatus = 'O' then 'MODIFIED_EXISTING' else 'EXISTING' end when l_linestatus = 'O' and l_partkey % 3 = 0 then 'REGRESSED' else 'INTRODUCED' end as relationship from lineitem"


def dispositions(spark, d):
    e = table(spark, d, "orders").select(F.explode(F.sequence(F.lit(1), F.lit(7))).alias("n"), "o_orderkey").select(F.concat_ws(":", "o_orderkey", "n").alias("obligation_id"))
    q = F.pmod("l_partkey", F.lit(6))
    n = F.when(F.pmod("l_orderkey", F.lit(9)) == 0, F.ceil(F.col("l_linenumber") / 2)).otherwise(F.col("l_linenumber"))
    r = table(spark, d, "lineitem").select(
        F.concat_ws(":", "l_orderkey", n).alias("obligation_id"), F.when(q == 0, "CANDIDATE_FOUND").when(q == 1, "NEEDS_CONTEXT").when(q == 2, "odd").otherwise("NO_ISSUE").alias("status"),
        F.when((q == 0) | (q == 3), F.array(F.lit("c"))).alias("candidate_ids"), (F.col("l_suppkey") % 2 == 0).alias("grounded"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("n_requests"))
    return E.apply_dispositions(e, r)


DISPOSED = """with r as (select l_orderkey || ':' || case when l_orderkey % 9 = 0 then (l_linenumber + 1) // 2 else l_linenumber end as k, l_partkey % 6 as q, l_suppkey % 2 = 0 as g, l_returnflag = 'R' as a from lineitem),
c as (select k, count(*) as n from r group by 1), f as (select k, n, q, g, a from c join r using (k) where n = 1 union all select k, n, null, null, null from c where n > 1), o as (select o_orderkey || ':' || i as obligation_id from orders, range(1, 8) t(i)),
j as (select obligation_id, q, case when k is null then 'omitted' when n > 1 then 'duplicated' when q = 2 then 'malformed' when q = 0 and not g then 'ungrounded candidate' when q = 3 then 'invalid candidate link' when q = 1 and not a then 'no context request' when q <> 1 and a then 'terminal with request' end as issue from o left join f on k = obligation_id)
select obligation_id, case when issue is not null then 'UNRESOLVED' when q = 0 then 'CANDIDATE_FOUND' when q = 1 then 'NEEDS_CONTEXT' else 'NO_ISSUE' end as status, issue from j"""


def grounding(spark, d):
    at = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.col("l_partkey").alias("path"), F.col("l_linenumber").alias("start_line"), (F.col("l_linenumber") + 20).alias("end_line"), F.when(F.pmod("l_suppkey", F.lit(6)) == 0, "x").otherwise("h").alias("hash"))
    f = table(spark, d, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("line_count"), F.lit("h").alias("content_hash"))
    return E.ground_annotations(at, f)


GROUNDING = """with g as (select l_orderkey as record_id, count(*) as n, count(*) filter (p_partkey is not null and l_suppkey % 6 <> 0 and l_linenumber + 20 <= p_size) as n_verified from lineitem left join part on p_partkey = l_partkey group by 1)
select record_id, case when n = n_verified then 'verified' when n_verified > 0 then 'partial' else 'unverified' end as state, n, n_verified from g"""


def known_outcomes(spark, d):
    o = table(spark, d, "orders")
    known = o.select(F.col("o_orderkey").alias("id"), F.lit("pr").alias("scope"))
    return L.known_outcomes(known, known.where("id % 5 = 0"), known.where("id % 3 = 0").select("id", F.lit("fixed_removed").alias("outcome")), known.where("id % 2 = 0").select("id", F.lit("still_present").alias("outcome")), False).select("id", "outcome")


OUTCOMES = "select o_orderkey as id, case when o_orderkey % 5 = 0 then 'reobserved' when o_orderkey % 3 = 0 then 'carried_incomplete' when o_orderkey % 2 = 0 then 'still_present' else 'carried' end as outcome from orders"


def recheck_plan(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.pmod("o_custkey", F.lit(2)) == 0, "pr").otherwise("branch").alias("scope"), F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("ord"))
    c = table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("path"), F.when(F.pmod("c_custkey", F.lit(3)) == 1, "deleted").otherwise("modified").alias("status"))
    return L.recheck_plan(o, c, 10)


RECHECK = """with k as (select o_orderkey as id, o_custkey % 2 = 0 as pr, case when c_custkey is null then 'unchanged' when o_custkey % 3 = 1 then 'deleted' else 'modified' end as s from orders left join (select c_custkey from customer where c_custkey % 3 <> 0) on c_custkey = o_custkey),
x as (select *, case when s = 'deleted' then 'fixed_removed' when s = 'unchanged' and pr then 'carried_unchanged' end as settled from k), r as (select *, row_number() over (partition by settled is null order by id) as rn from x)
select id, coalesce(settled, case when rn <= 10 then 'recheck' else 'carried_incomplete' end) as plan from r"""


def promotion(spark, d):
    pr = _orders(spark, d).where("o_orderkey % 2 = 0").select(F.pmod("o_custkey", F.lit(40)).alias("pr"), F.pmod("o_orderkey", F.lit(500)).alias("finding"), F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "fixed").otherwise("duplicate").alias("status"))
    branch = spark.range(0, 500, 3).select(F.col("id").alias("finding"), F.when(F.pmod("id", F.lit(2)) == 0, "open").otherwise("fixed").alias("status"))
    closings = spark.range(0, 40).select(F.col("id").alias("pr"), (F.pmod("id", F.lit(3)) != 0).alias("merged"))
    return L.promote(pr, branch, closings)


PROMOTION = """with b as (select f as finding, case when f % 2 = 0 then 'open' else 'fixed' end as s from (select unnest(range(0, 500, 3)) as f)),
m as (select o_orderkey % 500 as finding, bool_or(o_orderstatus = 'O') as op from orders where o_orderkey % 2 = 0 and (o_custkey % 40) % 3 <> 0 and o_orderstatus in ('O', 'F') group by 1)
select coalesce(b.finding, m.finding) as finding, case when op then 'open' when op is not null and s = 'open' then 'fixed' else s end as status from b full join m on b.finding = m.finding where op or s is not null"""


def claims(spark, d):
    o = _orders(spark, d)
    out = L.claim_outcome(F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed"), F.pmod("o_orderkey", F.lit(3)) - 1, F.pmod("o_custkey", F.lit(5)), F.lit(4), F.lit(0))
    return o.select("o_orderkey", out.alias("outcome"))


CLAIMS = "select o_orderkey, case when o_orderstatus = 'F' then 'replay' when o_orderstatus = 'O' and o_orderkey % 3 - 1 > 0 then 'conflict' when o_custkey % 5 >= 4 then 'exhausted' else 'claimed' end as outcome from orders"


def current_rows(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", micros("ts").alias("at"), F.sha2(F.col("event_id").cast("string"), 256).alias("arrival"), "event_type")
    return L.current_rows(e, "user_id", "at", ["arrival"]).select("user_id", "event_id", "event_type")


CURRENT = "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, sha256(event_id::varchar) desc) = 1"


def journal(spark, d):
    o = _orders(spark, d)
    units = o.select(F.lit("s").alias("stage"), F.col("o_orderkey").alias("unit_key"), F.when(F.pmod("o_orderkey", F.lit(7)) == 0, "completed").otherwise("pending").alias("status"), F.lit(1).alias("attempt_count"), F.pmod("o_custkey", F.lit(50)).alias("operation"), F.pmod("o_orderkey", F.lit(3)).alias("identity"))
    ev = table(spark, d, "lineitem").select(F.lit("s").alias("stage"), F.col("l_orderkey").alias("unit_key"), F.when(F.col("l_returnflag") == "N", "begin").when(F.col("l_returnflag") == "R", "complete").otherwise("fail").alias("kind"), F.col("l_linenumber").alias("ord"))
    return L.journal(units, ev).select("unit_key", "status", "attempt_count")


JOURNAL = """with e as (select l_orderkey as k, l_returnflag as f, row_number() over (partition by l_orderkey order by l_linenumber, case l_returnflag when 'N' then 'begin' when 'R' then 'complete' else 'fail' end) as n from lineitem),
c as (select k, min(n) filter (f = 'R') as done from e group by 1), u as (select o_orderkey as k, o_orderkey % 7 = 0 as was, o_custkey % 50 as op, o_orderkey % 3 as ident from orders),
a as (select u.k, u.op, u.ident, was or c.done is not null as ok, 1 + case when was then 0 else (select count(*) from e where e.k = u.k and e.f = 'N' and (c.done is null or e.n < c.done)) end as n from u left join c on c.k = u.k)
select k as unit_key, case when ok then 'completed' when exists (select 1 from a b where b.ok and b.op = a.op and b.ident = a.ident) then 'superseded' else 'failed_retryable' end as status, n::bigint as attempt_count from a"""


def changed_symbols(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("symbol_id"), F.col("p_brand").alias("path"), F.md5("p_name").alias("content_hash"))
    now = p.where("symbol_id % 11 <> 0").withColumn("content_hash", F.when(F.pmod("symbol_id", F.lit(4)) == 0, F.md5(F.col("content_hash"))).otherwise(F.col("content_hash")))
    paths = p.where("symbol_id <= 20").select("path").distinct()
    return S.changed_symbols(p, now, paths)


SYMBOLS = """select p_partkey as symbol_id, case when p_partkey % 11 = 0 then 'removed' else 'changed' end as change from part where p_brand in (select p_brand from part where p_partkey <= 20) and (p_partkey % 11 = 0 or p_partkey % 4 = 0)"""


def typed_lookup(spark, d):
    p = table(spark, d, "part")
    n_targets = p.count()
    nodes = p.select(F.col("p_partkey").alias("node_id"), F.replace("p_type", F.lit(" "), F.lit("_")).alias("label"), F.col("p_brand").alias("path"), F.col("p_size").alias("line"))
    edges = table(spark, d, "lineitem").select(F.col("l_partkey").alias("source"), (F.pmod(F.col("l_partkey") * 7 + F.col("l_suppkey"), F.lit(n_targets)) + 1).alias("target"), F.when(F.pmod("l_suppkey", F.lit(2)) == 0, "Calls").otherwise("references").alias("relation"))
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("definition", "callers", "callees", "references", "flow", "search")]), (F.pmod("p_partkey", F.lit(6)) + 1).cast("int"))
    req = p.select(F.col("p_partkey").alias("id"), kinds.alias("kind"), F.lit("").alias("path"), F.replace("p_type", F.lit(" "), F.lit("_")).alias("symbol"), F.element_at(F.split("p_type", " "), -1).alias("query"))
    return G.typed_lookup(req, nodes, edges)


TYPED = """with n as (select p_partkey as id, replace(p_type, ' ', '_') as label, p_brand as path, p_size as line from part), e as (select l_partkey as s, (l_partkey * 7 + l_suppkey) % (select count(*) from part) + 1 as t, case when l_suppkey % 2 = 0 then 'calls' else 'references' end as r from lineitem),
q as (select p_partkey as id, p_partkey % 6 as k, replace(p_type, ' ', '_') as symbol, lower(list_extract(string_split(p_type, ' '), -1)) as w from part),
sd as (select q.id, q.k, n.id as node from q join n on n.label = q.symbol where k <= 4),
f as (select id, node from sd where k = 0 union select sd.id, e.s from sd join e on e.t = node and ((k = 1 and r = 'calls') or (k = 3 and r = 'references') or k = 4) union select sd.id, e.t from sd join e on e.s = node and ((k = 2 and r = 'calls') or k = 4)
 union select q.id, n.id from q join n on k = 5 and contains(lower(label), w)),
r as (select f.id, node as node_id, row_number() over (partition by f.id order by path, line, node) as rank, count(*) over (partition by f.id) > 8 as truncated from f join n on n.id = f.node) select * from r where rank <= 8"""


def merged_evidence(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("cluster"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), "l_partkey", "l_returnflag")
    m = li.select("cluster", F.lit(-1).alias("id"), "ord", F.array("l_returnflag").alias("task_ids"), F.col("l_partkey").cast("string").alias("evidence"), F.array("l_returnflag").alias("contexts"), F.pmod("l_partkey", F.lit(30)).cast("string").alias("variant"))
    out = E.merge_evidence(m)
    return out.select("cluster", "duplicates", F.array_join("task_ids", ",").alias("tasks"), F.array_join("support", ",").alias("support"), F.array_join("variants", ",").alias("variants"))


EVIDENCE = """with l as (select l_suppkey as c, l_orderkey * 10 + l_linenumber as o, l_partkey::varchar as e, (l_partkey % 30)::varchar as v, l_returnflag as t from lineitem),
s as (select c, e, min(o) as o from l group by 1, 2 qualify row_number() over (partition by c order by min(o), e) <= 20), v as (select c, v, min(o) as o from l group by 1, 2 qualify row_number() over (partition by c order by min(o), v) <= 12)
select c as cluster, count(*) - 1 as duplicates, string_agg(distinct t, ',' order by t) as tasks, (select string_agg(e, ',' order by o, e) from s where s.c = l.c) as support, (select string_agg(v, ',' order by o, v) from v where v.c = l.c) as variants from l group by c"""

QUERIES = {
    "effective_scope": effective_scope, "wildcard_filter": wildcard_filter, "evidence_present": evidence_present, "reusable_reports": reusable_reports, "insert_absent": insert_absent, "replace_rows": replace_rows,
    "update_columns": update_columns, "replace_children": replace_children, "guarded_update": guarded_update, "sparse_layer": sparse_layer, "fill_missing": fill_missing, "baseline_cascade": baseline_cascade,
    "existing_elsewhere": existing_elsewhere, "nodes_in_ranges": nodes_in_ranges, "first_covering": first_covering, "thresholds": thresholds, "reuse_percent": reuse_percent, "budget_cutoff": budget_cutoff,
    "first_items": first_items, "newest_exploded": newest_exploded, "truncated_prefix": truncated_prefix, "stable_keys": stable_keys, "tree_hashes": tree_hashes, "source_hashes": source_hashes,
    "canonical_classes": canonical_classes, "routing": routing, "relationships": relationships, "dispositions": dispositions, "grounding": grounding, "known_outcomes": known_outcomes, "recheck_plan": recheck_plan,
    "promotion": promotion, "claims": claims, "current_rows": current_rows, "journal": journal, "changed_symbols": changed_symbols, "typed_lookup": typed_lookup, "merged_evidence": merged_evidence,
}
ORACLES = {
    "effective_scope": SCOPE, "wildcard_filter": WILDCARD, "evidence_present": PRESENT, "reusable_reports": REUSABLE, "insert_absent": INSERT, "replace_rows": REPLACE, "update_columns": UPDATE,
    "replace_children": CHILDREN, "guarded_update": GUARDED, "sparse_layer": SPARSE, "fill_missing": FILL, "baseline_cascade": CASCADE, "existing_elsewhere": EXISTING, "nodes_in_ranges": RANGES,
    "first_covering": COVERING, "thresholds": THRESHOLDS, "reuse_percent": REUSE, "budget_cutoff": CUTOFF, "first_items": FIRST, "newest_exploded": NEWEST, "truncated_prefix": TRUNCATED, "stable_keys": STABLE,
    "tree_hashes": TREE, "source_hashes": SOURCE, "canonical_classes": CLASSES, "routing": ROUTING, "relationships": RELATIONS, "dispositions": DISPOSED, "grounding": GROUNDING, "known_outcomes": OUTCOMES,
    "recheck_plan": RECHECK, "promotion": PROMOTION, "claims": CLAIMS, "current_rows": CURRENT, "journal": JOURNAL, "changed_symbols": SYMBOLS, "typed_lookup": TYPED, "merged_evidence": EVIDENCE,
}
