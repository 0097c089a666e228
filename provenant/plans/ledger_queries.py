"""Queries over records around a review, built on orders, lines, parts, events, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenant.functions import text as T
from provenant.operators import ledger as K
from provenant.plans.events_queries import table
from provenant.plans.text_queries import URLS

CENTS = "cast(round(o_totalprice * 100) as bigint)"


def _mod(column, n):
    return F.pmod(column, F.lit(n))


def get_or_create(spark, d):
    o = table(spark, d, "orders")
    old = o.where("o_orderkey % 3 = 0").select((F.col("o_custkey") * 10 + _mod("o_orderkey", 7)).alias("k"), "o_orderstatus").groupBy("k").agg(F.min("o_orderstatus").alias("s"), F.lit(0).cast("long").alias("at"))
    new = o.where("o_orderkey % 3 <> 0").select((F.col("o_custkey") * 10 + _mod("o_orderkey", 7)).alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_orderkey").alias("at"))
    rows, refused = K.get_or_create(old, new, ["k"], ["s"], ["at"])
    return rows.join(refused.withColumn("refused", F.lit(True)), "k", "left").select("k", "s", "at", F.coalesce("refused", F.lit(False)).alias("refused"))


CREATE = """with o as (select o_custkey * 10 + o_orderkey % 7 as k, o_orderstatus as s, o_orderkey as t from orders), a as (select k, min(s) as s, 0::bigint as t from o where t % 3 = 0 group by 1), n as (select * from o where t % 3 <> 0),
r as (select * from a union all select k, arg_min(s, t), min(t) from n where k not in (select k from a) group by 1) select r.k, r.s, r.t as "at", exists (select 1 from n where n.k = r.k and n.s <> r.s) as refused from r"""


def tenant_controls(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    stored = table(spark, d, "orders").where("o_orderkey % 4 = 0").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("jobs"), F.when(F.min("o_orderstatus") == "F", F.lit(9)).cast("long").alias("slots"))
    changed = K.set_controls(stored, stored.where("c_custkey % 5 = 0").withColumn("jobs", F.lit(7).cast("long")), "c_custkey", ["jobs"])
    return K.with_defaults(c, changed, "c_custkey", {"jobs": 100, "slots": 2}).select("c_custkey", F.col("jobs").cast("long"), F.col("slots").cast("long"))


CONTROLS = """with s as (select o_custkey as k, max(o_orderkey) as j, case when min(o_orderstatus) = 'F' then 9 end as z from orders where o_orderkey % 4 = 0 group by 1)
select c_custkey, case when k is null then 100 when k % 5 = 0 then 7 else j end::bigint as jobs, coalesce(z, 2)::bigint as slots from customer left join s on k = c_custkey"""


def usage_quota(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.expr("cast(abs(round(value * 100)) as bigint)").alias("cents"))
    stored = K.append_usage(e.where("event_id % 2 = 0"), e.where("event_id % 3 = 0").withColumn("cents", F.lit(0).cast("long")), ["event_id"], ["cents"])
    limits = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") * 100).alias("limit"))
    return K.over_quota(stored, "user_id", "cents", limits)


QUOTA = """with e as (select user_id, case when event_id % 2 = 0 then cast(abs(round(value * 100)) as bigint) else 0 end as c from events where event_id % 2 = 0 or event_id % 3 = 0), u as (select user_id, sum(c) as c from e group by 1)
select c_custkey as user_id, coalesce(c, 0)::bigint as used, coalesce(c, 0) >= c_custkey * 100 as exceeded from customer left join u on user_id = c_custkey"""


def context_documents(spark, d):
    return K.context_document(table(spark, d, "part"), "p_partkey", ["p_type", "p_brand", "p_size"])


DOCUMENTS = """with p as (select p_partkey, '{"p_brand":"' || p_brand || '","p_size":' || p_size || ',"p_type":"' || p_type || '"}' as document from part) select p_partkey, document, sha256(document) as content_hash from p"""


def ledger_revisions(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.lit("planned").alias("state"), F.lit(0).alias("revision"))
    target = F.element_at(F.array(F.lit("running"), F.lit("candidate"), F.lit("unresolved"), F.lit("running")), (_mod("l_partkey", 4) + 1).cast("int"))
    asks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_linenumber") * 100_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("ord"), target.alias("target"), _mod("l_suppkey", 3).alias("expected"))
    moves = {"planned": ("running", "skipped"), "running": ("candidate", "unresolved"), "unresolved": ("running",)}
    return K.advance(o, asks, "o_orderkey", ["ord"], moves)


REVISIONS = """with recursive l as (select l_orderkey as k, row_number() over (partition by l_orderkey order by l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey) as i, ['running', 'candidate', 'unresolved', 'running'][l_partkey % 4 + 1] as t, l_suppkey % 3 as e from lineitem),
f as (select o_orderkey as k, 0::bigint as i, 'planned' as s, 0::bigint as r from orders union all select k, i, case when ok then t else s end, r + ok::bigint from (select l.k, l.i, l.t, f.s, f.r, l.e = f.r and (f.s || '>' || l.t) in ('planned>running', 'planned>skipped', 'running>candidate', 'running>unresolved', 'unresolved>running') as ok from f join l on l.k = f.k and l.i = f.i + 1))
select k as o_orderkey, arg_max(s, i) as state, arg_max(r, i) as revision, arg_max(r, i) as n_applied from f group by 1"""


def version_writes(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", F.col("l_linenumber").alias("version"), F.when(F.col("l_linenumber") <= 2, F.col("l_suppkey").cast("string")).otherwise(F.col("l_returnflag")).alias("content"))
    return K.versions_conflicting(li, ["l_suppkey", "version"], "content")


VERSIONS = """select l_suppkey, l_linenumber as version, min(case when l_linenumber <= 2 then l_suppkey::varchar else l_returnflag end) as content, count(distinct case when l_linenumber <= 2 then l_suppkey::varchar else l_returnflag end) > 1 as conflict from lineitem group by 1, 2"""


def symbol_links(spark, d):
    li = table(spark, d, "lineitem")
    links = li.where("l_linenumber <= 2").select(F.col("l_orderkey").alias("finding"), F.col("l_partkey").alias("symbol"), F.lit("old").alias("dependency_hash")).distinct()
    found = li.where("l_linenumber >= 2").select(F.col("l_orderkey").alias("finding"), F.col("l_partkey").alias("symbol"))
    symbols = table(spark, d, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("symbol"), F.md5("p_name").alias("dependency_hash"))
    return K.link_symbols(links, found, symbols)


LINKS = """with a as (select distinct l_orderkey as f, l_partkey as s from lineitem where l_linenumber <= 2), b as (select distinct l_orderkey as f, l_partkey as s, md5(p_name) as h from lineitem join part on p_partkey = l_partkey where l_linenumber >= 2 and p_partkey % 3 <> 0)
select coalesce(a.f, b.f) as finding, coalesce(a.s, b.s) as symbol, coalesce(h, 'old') as dependency_hash from a full join b on a.f = b.f and a.s = b.s"""


def reloaded_graphs(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("graph"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")).alias("edge_id"))
    kept = e.where("graph % 4 <> 0 OR edge_id NOT LIKE '%7'")
    return K.reloaded_graphs(e, K.graph_identity(kept))


RELOADED = "select l_suppkey as graph, l_suppkey % 4 <> 0 or not bool_or((l_orderkey || '-' || l_partkey) like '%7') as matches from lineitem group by 1 having l_suppkey % 4 <> 0 or bool_or((l_orderkey || '-' || l_partkey) not like '%7')"


def symbol_slices(spark, d):
    files = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("path"), F.split("text", "\n").alias("lines"))
    symbols = files.where("path % 3 <> 0").select("path", F.explode(F.array(F.lit(1), F.lit(3))).alias("start_line")).withColumn("end_line", F.col("start_line") + 1).withColumn("name", F.concat(F.lit("s"), F.col("start_line").cast("string")))
    rows = K.symbol_rows(files.withColumn("path", F.col("path").cast("string")), symbols.withColumn("path", F.col("path").cast("string")))
    return rows.select("path", "name", "start_line", F.col("end_line").cast("long").alias("end_line"), F.md5("content").alias("content"))


SLICES = """with f as (select doc_id::varchar as p, string_split(text, chr(10)) as l, doc_id % 3 as m from documents where text is not null)
select p as path, 's' || s as name, s::integer as start_line, least(len(l), s + 1)::bigint as end_line, md5(array_to_string(list_slice(l, s, s + 1), chr(10))) as content from f, (values (1), (3)) t(s) where m <> 0 union all select p, p, 1, len(l), md5(array_to_string(l, chr(10))) from f where m = 0"""


def literal_fallback(spark, d):
    asks = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    answers = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("id")).agg(F.min("l_suppkey").alias("value"))
    other = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.max("l_orderkey").alias("value"))
    return K.fallback(asks, answers, other)


FALLBACK = """with a as (select l_partkey as id, min(l_suppkey) as v from lineitem where l_returnflag = 'R' group by 1) select id, v as value, true as resolved from a
union all select l_partkey, max(l_orderkey), false from lineitem where l_partkey not in (select id from a) and l_partkey in (select p_partkey from part) group by 1"""


def summary_selection(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 100_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("o"), F.struct(_mod("l_suppkey", 10).cast("string").alias("path"), F.col("l_partkey").cast("string").alias("fact")).alias("f"))
    s = li.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "f"))), lambda x: x["f"]).alias("facts"))
    paths = spark.createDataFrame([(str(i),) for i in range(4)], "path string")
    return K.summaries_for(s.select(F.col("l_orderkey").alias("summary_id"), F.col("l_orderkey").alias("ord"), "facts"), paths, 2, 200).select("summary_id", F.array_join("facts", ",").alias("facts"))


SUMMARIES = """with s as (select distinct l_orderkey as k from lineitem order by 1 limit 200), l as (select l_orderkey as k, l_partkey::varchar as f, row_number() over (partition by l_orderkey order by l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey) as i from lineitem where l_suppkey % 10 < 4)
select s.k as summary_id, coalesce(string_agg(f, ',' order by i) filter (i <= 2), '') as facts from s left join l using (k) group by 1"""


def surface_grounding(spark, d):
    p = table(spark, d, "part")
    nodes = p.select(F.col("p_partkey").alias("node_id"), F.col("p_brand").alias("path"), F.col("p_size").alias("line"), F.md5("p_type").alias("source_hash"))
    surfaces = p.select(F.col("p_partkey").alias("surface_id"), F.col("p_partkey").alias("node_id"), F.col("p_brand").alias("path"), F.lit(10).alias("start_line"), F.lit(30).alias("end_line"), F.when(_mod("p_partkey", 5) == 0, "stale").otherwise(F.md5("p_type")).alias("hash"))
    return K.ungrounded(surfaces, nodes.where("node_id % 7 <> 0"), nodes)


GROUNDED = """select p_partkey as surface_id, case when p_partkey % 7 = 0 then 'outside the targets' when p_partkey % 5 = 0 then 'other source' else 'line not covered' end as reason from part where p_partkey % 7 = 0 or p_partkey % 5 = 0 or p_size not between 10 and 30"""


def rebound_investigations(spark, d):
    i = table(spark, d, "part").select(F.concat(F.lit("inv-"), F.col("p_partkey").cast("string")).alias("investigation_id"), F.col("p_brand").alias("target"), F.col("p_type").alias("question"), F.lit("running").alias("state"))
    b = table(spark, d, "part").where("p_size > 48").select(F.col("p_brand").alias("old"), F.concat("p_brand", F.lit("b")).alias("new")).distinct()
    return K.rebound(i, b)


REBOUND = """with b as (select distinct p_brand as o from part where p_size > 48) select case when o is null then 'inv-' || p_partkey else 'inv-' || left(sha256(p_brand || 'b' || chr(29) || p_type), 32) end as investigation_id, case when o is null then p_brand else p_brand || 'b' end as target, p_type as question, case when o is null then 'running' else 'planned' end as state from part left join b on o = p_brand"""


def region_construction(spark, d):
    r = table(spark, d, "orders").select(F.col("o_orderkey").alias("region_id"), F.when(_mod("o_orderkey", 3) == 0, F.col("o_orderpriority")).alias("route"), F.col("o_orderstatus").alias("path"))
    routes = spark.createDataFrame([("1-URGENT", "a"), ("1-URGENT", "b"), ("2-HIGH", "c")], "route string, task_id string")
    paths = spark.createDataFrame([("F", "d"), ("F", "e"), ("O", "d")], "path string, task_id string")
    return K.region_tasks(r, routes, paths).select("region_id", F.array_join("task_ids", ",").alias("tasks"))


CONSTRUCTION = """select o_orderkey as region_id, case when o_orderkey % 3 = 0 then case o_orderpriority when '1-URGENT' then 'a,b' when '2-HIGH' then 'c' else '' end else case o_orderstatus when 'F' then 'd,e' when 'O' then 'd' else '' end end as tasks from orders"""


def related_facts(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    return K.related_facts(table(spark, d, "customer").select(F.col("c_custkey").alias("key")), {"orders": (o, "o_custkey", "o_orderkey"), "lines": (li.join(o, F.col("l_orderkey") == F.col("o_orderkey")), "o_custkey", "l_partkey")}, 5)


RELATED = """with e as (select distinct o_custkey as key, 'orders' as kind, o_orderkey::varchar as fact from orders union select o_custkey, 'lines', l_partkey::varchar from orders join lineitem on l_orderkey = o_orderkey), r as (select *, row_number() over (partition by key, kind order by fact) as rank from e where key in (select c_custkey from customer)) select * from r where rank <= 5"""


def preserved_evidence(spark, d):
    li = table(spark, d, "lineitem")
    rows = li.select(((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).alias("id"), F.col("l_suppkey").alias("path"), _mod("l_partkey", 100).alias("start_line"), (_mod("l_partkey", 100) + 3).alias("end_line"), F.col("l_returnflag").alias("excerpt"))
    regions = table(spark, d, "supplier").select(F.col("s_suppkey").alias("path"), F.lit(20).alias("start_line"), F.lit(60).alias("end_line"))
    return K.preserved(rows, regions)


PRESERVED = """select (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey as id, l_suppkey as path, l_partkey % 100 as start_line, l_partkey % 100 + 3 as end_line, case when l_partkey % 100 between 20 and 57 and l_suppkey in (select s_suppkey from supplier) then '' else l_returnflag end as excerpt from lineitem"""


def coverage_observations(spark, d):
    planned = table(spark, d, "orders").select(F.col("o_orderkey").alias("region_id"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("canonical_id"))
    seen = table(spark, d, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("region_id"), F.col("l_linenumber").alias("canonical_id"), F.when(F.col("l_returnflag") == "R", "CANDIDATE_FOUND").otherwise("NO_ISSUE").alias("status"))
    return K.observations(planned, seen)


OBSERVED = """select o_orderkey as region_id, i::integer as canonical_id, coalesce(max(case when l_returnflag = 'R' then 'CANDIDATE_FOUND' when l_returnflag is not null then 'NO_ISSUE' end), 'UNRESOLVED') as status from orders cross join range(1, 4) t(i) left join lineitem on l_orderkey = o_orderkey and l_linenumber = i and l_quantity > 25 group by 1, 2"""


def surface_inventory(spark, d):
    return K.inventory(table(spark, d, "part").select("p_brand", "p_partkey"), "p_brand", ["p_partkey"], 60)


INVENTORY = """with r as (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_partkey) as rn from part), c as (select * from r order by rn, p_brand limit 60), n as (select p_brand, count(*) as n from part group by 1), k as (select p_brand, count(*) as k from c group by 1)
select p_brand, p_partkey, n as n_area, n - k as n_omitted from c join n using (p_brand) join k using (p_brand)"""


def retrieval_texts(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", K.retrieval_text(F.when(_mod("p_partkey", 3) == 0, "codebase").otherwise("global"), F.col("p_brand"), F.when(_mod("p_partkey", 4) > 0, F.col("p_type")).otherwise(" "), F.col("p_name")).alias("text"))


RETRIEVAL = "select p_partkey, p_name || case when p_partkey % 3 = 0 then ' ' || p_brand when p_partkey % 4 > 0 then ' ' || p_type else '' end as text from part"


def cited_pages(spark, d):
    p = table(spark, d, "pages").select("page_id", "url")
    return K.cited(p, p.where("page_id % 10 = 0").select(F.concat("url", F.lit("/")).alias("url"))).select("page_id")


CITED = f"with n as ({URLS}) select page_id from n where url in (select url from n where page_id % 10 = 0)"


def add_knowledge(spark, d):
    docs = table(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("tenant"), F.coalesce("text", F.lit("")).alias("text"), "doc_id")
    stored = docs.where("doc_id % 2 = 0").withColumn("content_hash", F.sha2(T.plain_text(F.col("text")), 256))
    return K.add_knowledge(stored, docs.where("doc_id % 2 = 1"), "tenant", "text").groupBy("tenant").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("content_hash").alias("n_hashes"))


KNOWLEDGE = r"""with t as (select coalesce(source, '') as tenant, doc_id, lower(trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'))) as h from documents), a as (select * from t where doc_id % 2 = 0), b as (select distinct tenant, h from t where doc_id % 2 = 1 and (tenant, h) not in (select (tenant, h) from a)),
u as (select tenant, h from a union all select tenant, h from b) select tenant, count(*) as n, count(distinct h) as n_hashes from u group by 1"""


def journal_reads(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("stage"), F.col("o_orderkey").alias("unit_key"), F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed_retryable").otherwise("running").alias("status"))
    return K.unit_counts(o)


JOURNAL = "select o_orderpriority as stage, count(*) as n, count(*) filter (o_orderstatus = 'F') as n_completed, count(*) filter (o_orderstatus = 'P') as n_retryable, max(o_orderkey) as last_key from orders group by 1"


def attempts(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("owner"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("queued").alias("state"))
    r = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_custkey") + _mod("o_orderkey", 2)).alias("owner"), (_mod("o_orderkey", 4) == 0).alias("ok"))
    return K.attempt_finished(a, r)


ATTEMPTS = """select o_orderkey as key, o_custkey as owner, case when o_orderstatus = 'O' and o_orderkey % 4 = 0 then 'completed' when o_orderstatus = 'O' and o_orderkey % 2 = 0 then 'failed' when o_orderstatus = 'O' then 'running' else 'queued' end as state, o_orderstatus = 'O' and o_orderkey % 2 = 0 as updated from orders"""


def extended_baseline(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("finding"), F.col("p_brand").alias("path"), F.when(_mod("p_size", 3) == 0, "open").otherwise("fixed").alias("status"))
    changed = spark.createDataFrame([("Brand#11", None), ("Brand#12", "Brand#22"), ("Brand#33", None)], "path string, old_path string")
    return K.extended_baseline(p.where("finding % 4 = 0"), p.where("finding % 4 <> 1"), changed)


EXTENDED = """select p_partkey as finding, p_brand as path, case when p_size % 3 = 0 then 'open' else 'fixed' end as status from part where p_brand in ('Brand#11', 'Brand#12', 'Brand#22', 'Brand#33') and (p_partkey % 4 = 0 or (p_partkey % 4 <> 1 and p_size % 3 = 0))"""


def trimmed_windows(spark, d):
    lines = F.concat(F.array_repeat(F.lit(" "), _mod("p_partkey", 3).cast("int")), F.split("p_type", " "), F.array_repeat(F.lit(""), 2))
    return table(spark, d, "part").select("p_partkey", F.array_join(K.trimmed_window(lines, 2, 16), "|").alias("window"))


TRIMMED = """with p as (select p_partkey, string_split(p_type, ' ') as w from part) select p_partkey, case when length(w[1]) + 1 > 16 then '' when len(w) > 1 and length(w[1]) + length(w[2]) + 2 <= 16 then w[1] || '|' || w[2] else w[1] end as window from p"""


def context_by_prefix(spark, d):
    paths = table(spark, d, "part").select(F.regexp_replace("p_type", " ", "/").alias("path"))
    records = spark.createDataFrame([("", "root"), ("STANDARD", "s"), ("PROMO/BURNISHED", "pb"), ("PROM", "no")], "prefix string, value string")
    return K.context_records(records, paths)


PREFIX = """select distinct replace(p_type, ' ', '/') as path, case when replace(p_type, ' ', '/') || '/' like 'PROMO/BURNISHED/%' then 'pb' when p_type || ' ' like 'STANDARD %' then 's' else 'root' end as value from part"""


def adapted_candidates(spark, d):
    p = table(spark, d, "part")
    payload = F.when(_mod("p_partkey", 9) == 0, "no json").otherwise(F.concat(F.lit('{"path": "'), "p_brand", F.lit('", "line": '), F.col("p_size").cast("string"), F.lit(', "depth": "'), F.element_at(F.array(F.lit("fast"), F.lit("standard"), F.lit("deep")), (_mod("p_partkey", 3) + 1).cast("int")), F.lit('"}')))
    files = p.where("p_brand < 'Brand#4'").select(F.col("p_brand").alias("path"), F.lit(40).alias("line_count")).distinct()
    good, gaps = K.adapted_candidates(p.select(F.col("p_partkey").alias("id"), payload.alias("payload")), "path string, line int, depth string", files, "standard", ["fast", "standard", "deep"])
    return good.select("id", "depth", F.lit("").alias("gap")).unionByName(gaps.select("id", F.lit("").alias("depth"), F.col("reason").alias("gap")))


ADAPTED = """select p_partkey as id, case when p_partkey % 9 = 0 or p_brand >= 'Brand#4' or p_size > 40 or p_size < 1 then '' when p_partkey % 3 = 2 then 'deep' else 'standard' end as depth, case when p_partkey % 9 = 0 then 'malformed' when p_brand >= 'Brand#4' or p_size > 40 or p_size < 1 then 'not anchored' else '' end as gap from part"""


def activity_ledger(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("idempotency_key"), (F.col("l_linenumber") * 100_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("at"), F.create_map(F.lit("flag"), F.col("l_returnflag"), F.lit("private"), F.lit("x")).alias("metadata"))
    out = K.record_activity(li.where("idempotency_key % 2 = 0"), li.where("idempotency_key % 2 = 1 OR at % 2 = 0"), ["flag", "other"])
    return out.select("idempotency_key", "at", F.to_json("metadata").alias("metadata"))


ACTIVITY = """select l_orderkey as idempotency_key, min(t) as "at", '{"flag":"' || arg_max(l_returnflag, t) || '"}' as metadata from (select *, l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey as t from lineitem) group by 1"""


def promoted_baseline(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("review"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("state"), F.when(_mod("o_orderkey", 3) > 0, F.col("o_orderkey")).alias("merge_revision"))
    found = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("review"), F.col("l_partkey").alias("finding"))
    old = table(spark, d, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("finding"), F.lit("fixed").alias("status"), F.lit(0).cast("long").alias("revision"))
    return K.promoted_baseline(old, o, found)


PROMOTED = """with m as (select l_partkey as f, max(o_orderkey) as r from lineitem join orders on o_orderkey = l_orderkey where o_orderstatus = 'F' and o_orderkey % 3 > 0 group by 1), p as (select p_partkey as f from part where p_partkey % 2 = 0)
select coalesce(p.f, m.f) as finding, case when r is null then 'fixed' else 'open' end as status, coalesce(r, 0)::bigint as revision from p full join m on m.f = p.f"""


def typed_contexts(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit('{"goals": ["'), "p_brand", F.lit('", "x"], "roles": '), F.when(_mod("p_partkey", 2) == 0, '["r"]').otherwise("null"), F.lit("}")).alias("payload"))
    return K.typed_context(p, "goals array<string>, roles array<string>, flows array<string>").select("id", F.array_join("goals", ",").alias("goals"), F.size("roles").cast("long").alias("n_roles"), F.size("flows").cast("long").alias("n_flows"))


TYPED = "select p_partkey as id, p_brand || ',x' as goals, (1 - p_partkey % 2)::bigint as n_roles, 0::bigint as n_flows from part"


def continuation(spark, d):
    asks = table(spark, d, "customer").select(F.col("c_custkey").alias("ord"), F.col("c_custkey").alias("id"))
    o = table(spark, d, "orders")
    found = o.select(F.col("o_custkey").alias("id"), F.concat_ws(":", "o_orderstatus", _mod("o_orderkey", 211).cast("string")).alias("evidence"))
    out, fresh = K.continuation(asks, found, found.where("id % 3 = 0").select("evidence").where("evidence LIKE 'F%'"), 300)
    return out.withColumn("progress", F.lit(fresh))


CONTINUATION = """with f as (select o_custkey as id, o_orderstatus || ':' || (o_orderkey % 211) as e from orders), q as (select c_custkey as id from customer order by 1 limit 300), n as (select e, min(id) as id from f where id in (select id from q) and e not in (select e from f where id % 3 = 0 and e like 'F%') group by 1)
select id, id in (select id from n) as resolved, (select count(*) from n) > 0 as progress from q"""


def rebuilt_traces(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("finding"), F.element_at(F.array(F.lit("sink"), F.lit("source"), F.lit("odd")), (_mod("l_linenumber", 3) + 1).cast("int")).alias("role"), _mod("l_partkey", 20).cast("string").alias("path"), F.col("l_linenumber").alias("start_line"), (F.col("l_linenumber") + 1).alias("end_line"))
    return K.rebuilt_trace(li, {"source": 0, "guard": 1, "sink": 2})


REBUILT = """with e as (select distinct l_suppkey as finding, ['sink', 'source', 'odd'][l_linenumber % 3 + 1] as role, (l_partkey % 20)::varchar as path, l_linenumber as start_line, l_linenumber + 1 as end_line from lineitem)
select *, row_number() over (partition by finding order by case role when 'source' then 0 when 'sink' then 2 else 3 end, path, start_line, end_line, role) - 1 as pos, false as complete from e"""


def filled_history(spark, d):
    li = table(spark, d, "lineitem")
    node = F.struct((F.col("l_linenumber") * 100_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("o"), F.col("l_suppkey").cast("string").alias("path"), F.col("l_linenumber").alias("line"), F.when(_mod("l_partkey", 2) == 0, F.col("l_returnflag")).alias("code"))
    history = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(node)), lambda n: F.struct(n["path"].alias("path"), n["line"].alias("line"), n["code"].alias("code"))).alias("nodes")).withColumn("revision", F.lit("r1"))
    blobs = table(spark, d, "supplier").where("s_suppkey % 3 <> 0").select(F.lit("r1").alias("revision"), F.col("s_suppkey").cast("string").alias("path"), F.split(F.lit("a,b,c,d,e"), ",").alias("lines"))
    rows, _ = K.filled_nodes(history, blobs)
    return rows.select("id", F.array_join(F.transform("nodes", lambda n: F.concat_ws("", n["path"], F.coalesce(n["code"], F.lit("?")))), ",").alias("nodes"))


FILLED = """select l_orderkey as id, string_agg(l_suppkey || coalesce(case when l_partkey % 2 = 0 then l_returnflag when l_suppkey % 3 <> 0 and l_linenumber <= 5 then ['a', 'b', 'c', 'd', 'e'][l_linenumber] end, '?'), ',' order by l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey) as nodes from lineitem group by 1"""


def bounded_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", K.bounded_hash([F.col("text"), F.col("source")], 300).alias("h"))


def _sql_bounded() -> str:
    out = "left(coalesce(text, ''), 300)"
    for pattern, to in T.REDACTIONS:
        out = f"regexp_replace({out}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to.replace('$1', chr(92) + '1')}', 'g')"
    return f"select doc_id, sha256({out} || chr(29) || coalesce(source, '')) as h from documents"


def carried_locations(spark, d):
    li = table(spark, d, "lineitem")
    prior = li.select(F.col("l_orderkey").alias("record_id"), F.col("l_partkey").alias("path"), F.col("l_linenumber").alias("start_line"), (F.col("l_linenumber") + 20).alias("end_line"), F.when(_mod("l_suppkey", 6) == 0, "x").otherwise("h").alias("hash"))
    files = table(spark, d, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("line_count"), F.lit("h").alias("content_hash"))
    return K.carried_locations(prior, table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("record_id")), files)


CARRIED = """select l_orderkey as record_id, l_partkey as path, l_linenumber as start_line, l_linenumber + 20 as end_line, 'h' as hash from lineitem join part on p_partkey = l_partkey where l_suppkey % 6 <> 0 and l_linenumber + 20 <= p_size and l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'O')"""


def numbered_windows(spark, d):
    text = F.concat(F.lit("head\n"), F.col("p_size").cast("string"), F.lit(": a\n  "), (F.col("p_size") - 3).cast("string"), F.lit(": b\nx 7: c"))
    return table(spark, d, "part").select("p_partkey", K.numbered_window(F.when(_mod("p_partkey", 4) > 0, text).otherwise("none")).alias("w")).select("p_partkey", "w.start_line", "w.end_line")


NUMBERED = "select p_partkey, case when p_partkey % 4 > 0 then case when p_size - 3 >= 0 then p_size - 3 else p_size end end::integer as start_line, case when p_partkey % 4 > 0 then p_size end::integer as end_line from part"


def report_rows(spark, d):
    f = table(spark, d, "part").select(F.col("p_partkey").alias("finding_id"), F.col("p_brand").alias("path"), F.col("p_size").alias("start_line"), (F.col("p_size") + 1).alias("end_line"), F.col("p_type").alias("severity"), (F.col("p_size") / 40).alias("confidence"))
    return K.report_rows(f).select("finding_id", "schema_version", F.concat_ws(":", "evidence.path", "evidence.start_line", "evidence.end_line").alias("evidence"), "decision.severity", "decision.confidence")


REPORT = "select p_partkey as finding_id, 1 as schema_version, p_brand || ':' || p_size || ':' || (p_size + 1) as evidence, lower(p_type) as severity, least(1.0, p_size / 40)::double as confidence from part"


def exact_targets(spark, d):
    p = table(spark, d, "part")
    a = F.split("p_type", " ")
    return p.select("p_partkey", K.exact_target(F.concat(F.reverse(a), F.slice(a, 1, 1)), F.when(_mod("p_partkey", 2) == 0, a).otherwise(F.slice(a, 1, 2))).alias("same"))


EXACT = "select p_partkey, p_partkey % 2 = 0 or len(list_distinct(string_split(p_type, ' '))) = len(list_distinct(list_slice(string_split(p_type, ' '), 1, 2))) as same from part"

QUERIES = {
    "get_or_create": get_or_create, "tenant_controls": tenant_controls, "usage_quota": usage_quota, "context_documents": context_documents, "ledger_revisions": ledger_revisions, "version_writes": version_writes, "symbol_links": symbol_links,
    "reloaded_graphs": reloaded_graphs, "symbol_slices": symbol_slices, "literal_fallback": literal_fallback, "summary_selection": summary_selection, "surface_grounding": surface_grounding, "rebound_investigations": rebound_investigations,
    "region_construction": region_construction, "related_facts": related_facts, "preserved_evidence": preserved_evidence, "coverage_observations": coverage_observations, "surface_inventory": surface_inventory, "retrieval_texts": retrieval_texts,
    "cited_pages": cited_pages, "add_knowledge": add_knowledge, "journal_reads": journal_reads, "attempts": attempts, "extended_baseline": extended_baseline, "trimmed_windows": trimmed_windows, "context_by_prefix": context_by_prefix,
    "adapted_candidates": adapted_candidates, "activity_ledger": activity_ledger, "promoted_baseline": promoted_baseline, "typed_contexts": typed_contexts, "continuation": continuation, "rebuilt_traces": rebuilt_traces, "filled_history": filled_history,
    "bounded_hashes": bounded_hashes, "carried_locations": carried_locations, "numbered_windows": numbered_windows, "report_rows": report_rows, "exact_targets": exact_targets,
}
ORACLES = {
    "get_or_create": CREATE, "tenant_controls": CONTROLS, "usage_quota": QUOTA, "context_documents": DOCUMENTS, "ledger_revisions": REVISIONS, "version_writes": VERSIONS, "symbol_links": LINKS, "reloaded_graphs": RELOADED, "symbol_slices": SLICES,
    "literal_fallback": FALLBACK, "summary_selection": SUMMARIES, "surface_grounding": GROUNDED, "rebound_investigations": REBOUND, "region_construction": CONSTRUCTION, "related_facts": RELATED, "preserved_evidence": PRESERVED,
    "coverage_observations": OBSERVED, "surface_inventory": INVENTORY, "retrieval_texts": RETRIEVAL, "cited_pages": CITED, "add_knowledge": KNOWLEDGE, "journal_reads": JOURNAL, "attempts": ATTEMPTS, "extended_baseline": EXTENDED, "trimmed_windows": TRIMMED,
    "context_by_prefix": PREFIX, "adapted_candidates": ADAPTED, "activity_ledger": ACTIVITY, "promoted_baseline": PROMOTED, "typed_contexts": TYPED, "continuation": CONTINUATION, "rebuilt_traces": REBUILT, "filled_history": FILLED,
    "bounded_hashes": _sql_bounded(), "carried_locations": CARRIED, "numbered_windows": NUMBERED, "report_rows": REPORT, "exact_targets": EXACT,
}
