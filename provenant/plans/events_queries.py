"""Queries over events, orders and labels: metrics, counts, quotas, versions, queues, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.operators import aggregates as A
from provenant.operators import lifecycle as L
from provenant.operators import overlay as V
from provenant.operators import ranking as R

#: Micros since the epoch of a driver timestamp (they have no zone; sessions run in UTC).
def micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


KINDS = ["click", "error", "purchase", "refund", "signup", "view"]
CENTS = "cast(round(value * 100) as bigint)"


def acceptance_metrics(spark, d):
    said = F.col("text").rlike("trash|clown")
    docs = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return A.quality_metrics(F.col("toxic") == 1, said, F.md5("text"), docs.where("text IS NOT NULL AND toxic IS NOT NULL"))


ACCEPTANCE = """
with x as (select toxic = 1 as e, regexp_matches(text, 'trash|clown') as r, md5(text) as f from labels join documents using (doc_id) where text is not null and toxic is not null),
c as (select count(*) filter (e and r) as tp, count(*) filter (not e and r) as fp, count(*) filter (e and not r) as fn,
 count(*) filter (r) as n, count(*) filter (r) - count(distinct case when r then f end) as d from x)
select tp, fp, fn, case when tp + fn = 0 then 1.0::double else round_even(tp / (tp + fn), 4) end as recall,
 case when tp + fp = 0 then 1.0::double else round_even(tp / (tp + fp), 4) end as precision, case when n = 0 then 0.0::double else round_even(d / n, 4) end as duplicate_rate from c"""


def status_counts(spark, d):
    return A.counts_by(table(spark, d, "events"), "event_type", KINDS)


STATUS = "with k(event_type) as (values ('click'), ('error'), ('purchase'), ('refund'), ('signup'), ('view')) select k.event_type, count(e.event_id) as n from k left join events e using (event_type) group by 1"


def monthly_cost(spark, d):
    e = table(spark, d, "events").select("user_id", (micros("ts") + F.lit(15 * 86_400_000_000)).alias("at"), F.expr(CENTS).alias("cents"))
    month = F.unix_micros(F.date_trunc("month", F.lit("2024-02-10").cast("timestamp")))
    return A.sum_since(e, "user_id", "at", "cents", month)


MONTHLY = f"""select user_id, coalesce(sum({CENTS}) filter (epoch_us(ts) + 15 * 86400000000 >= epoch_us(date_trunc('month', timestamp '2024-02-10'))), 0)::bigint as total
from events group by user_id"""


def rolling_daily_quota(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", (micros("ts") / 1_000_000).cast("long").alias("s"))
    return A.rolling_count(e, "user_id", F.col("s"), 86_400, 3).select("event_id", "user_id", "n_recent", "over_quota")


ROLLING = """with e as (select event_id, user_id, epoch_us(ts) // 1000000 as s from events)
select event_id, user_id, count(*) over (partition by user_id order by s range between 86400 preceding and current row) as n_recent,
count(*) over (partition by user_id order by s range between 86400 preceding and current row) > 3 as over_quota from e"""


def latest_per_user(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", micros("ts").alias("at"), "event_type")
    from provenant.operators.joins import latest

    return latest(e, ["user_id"], [F.col("at"), F.col("event_id")])


LATEST = "select user_id, event_id, epoch_us(ts) as at, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1"


def version_bumps(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", micros("ts").alias("at"), "event_type")
    return V.version_bumps(e, "user_id", ["at", "event_id"], ["event_type"]).select("event_id", "user_id", "version")


VERSIONS = """with b as (select event_id, user_id, ts, event_type, lag(event_type) over w as p, lag(event_id) over w as pe from events window w as (partition by user_id order by ts, event_id))
select event_id, user_id, (1 + sum(case when pe is not null and p is distinct from event_type then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding))::bigint as version from b"""


def idempotent_enqueue(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", (F.floor(micros("ts") / 3_600_000_000)).cast("long").alias("hour"), micros("ts").alias("at"), "event_id", "props")
    first = L.first_per_key(e, ["user_id", "hour", "event_type"], ["at", "event_id"])
    bad = L.identity_conflicts(e, ["user_id", "hour", "event_type"], "props").withColumnRenamed("n", "n_payloads")
    return first.join(bad, ["user_id", "hour", "event_type"], "left").select("user_id", "hour", "event_type", "event_id", F.coalesce("n_payloads", F.lit(1)).cast("long").alias("n_payloads"))


ENQUEUE = """select user_id, epoch_us(ts) // 3600000000 as hour, event_type, arg_min(event_id, (ts, event_id)) as event_id, greatest(1, count(distinct props))::bigint as n_payloads
from events group by 1, 2, 3"""


def lease_next(spark, d):
    o = table(spark, d, "orders")
    now = F.lit(0)
    jobs = o.select(
        F.col("o_custkey").alias("tenant"), F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "leased").otherwise("queued").alias("state"),
        F.left("o_orderpriority", F.lit(1)).cast("int").alias("priority"), micros("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "P", F.pmod(F.col("o_orderkey"), F.lit(2)) * 2 - 1).alias("lease_expires_at"),
        F.pmod(F.col("o_orderkey"), F.lit(4)).alias("attempt_count"), F.lit(3).alias("maximum_attempts"),
    )
    keys = jobs.select("tenant").distinct()
    limits = keys.select("tenant", F.lit(2).alias("concurrent"), F.lit(100).alias("monthly_cost"))
    spent = keys.select("tenant", F.pmod("tenant", F.lit(111)).alias("cost"))
    return L.next_leases(jobs, "tenant", limits, spent, now).select("tenant", "job_id", F.col("priority").cast("long").alias("priority"))


LEASE = """with j as (select o_custkey as tenant, o_orderkey as job_id, case o_orderstatus when 'F' then 'failed' when 'P' then 'leased' else 'queued' end as state,
 left(o_orderpriority, 1)::bigint as priority, o_orderdate as created, case when o_orderstatus = 'P' then o_orderkey % 2 * 2 - 1 end as exp, o_orderkey % 4 as att from orders),
f as (select tenant, case when tenant % 111 >= 100 then 0 else greatest(0, 2 - count(*) filter (state = 'leased' and exp > 0)) end as free from j group by tenant),
r as (select *, row_number() over (partition by tenant order by priority, created, job_id) as rn from j where state in ('queued', 'leased') and att < 3 and (exp is null or exp <= 0))
select tenant, job_id, priority from r join f using (tenant) where rn <= free"""


def late_run_guard(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", micros("ts").alias("at"), F.sha2(F.col("event_id").cast("string"), 256).alias("arrival"))
    return L.accept_on_time(e, "user_id", ["arrival"], "at").select("event_id", "user_id", "accepted")


LATE = """select event_id, user_id, coalesce(epoch_us(ts) >= max(epoch_us(ts)) over (partition by user_id order by sha256(event_id::varchar) rows between unbounded preceding and 1 preceding), true) as accepted from events"""


COMMANDS = {"click": "valid", "error": "fp", "purchase": "fixed", "signup": "accepted_risk", "view": "none"}


def triage_fold(spark, d):
    from provenant.functions.text import lookup

    e = table(spark, d, "events").select("user_id", micros("ts").alias("at"), "event_id", lookup(F.col("event_type"), COMMANDS, "none").alias("command"))
    return L.fold_commands(e, "user_id", ["at", "event_id"], "command", "open")


TRIAGE = """with recursive m(c, a, b) as (values ('click', 'open', 'confirmed'), ('error', 'open', 'false_positive'), ('error', 'confirmed', 'false_positive'), ('signup', 'open', 'accepted_risk'),
 ('signup', 'confirmed', 'accepted_risk'), ('purchase', 'open', 'fix_pending'), ('purchase', 'confirmed', 'fix_pending'), ('purchase', 'accepted_risk', 'fix_pending')),
e as (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) as n from events),
f as (select user_id, 0::bigint as n, 'open' as state, 0::bigint as ok, 0::bigint as bad from (select distinct user_id from events)
 union all select f.user_id, e.n, coalesce(m.b, f.state), f.ok + (m.b is not null)::bigint, f.bad + (m.b is null)::bigint from f join e on e.user_id = f.user_id and e.n = f.n + 1 left join m on m.c = e.event_type and m.a = f.state)
select user_id, arg_max(state, n) as state, arg_max(ok, n) as n_applied, arg_max(bad, n) as n_rejected from f group by user_id"""


def occurrence_fold(spark, d):
    names = {"click": "observed", "error": "observed", "purchase": "fixed", "signup": "carried", "view": "duplicate"}
    from provenant.functions.text import lookup

    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("ord"), lookup(F.col("event_type"), names, "carried").alias("outcome"), micros("ts").alias("at"))
    return L.occurrence_fold(e)


OCCURRENCES = """with recursive e as (select user_id, epoch_us(ts) as t, event_type as k, row_number() over (partition by user_id order by event_id) as n from events),
f as (select user_id, 0::bigint as n, null::varchar as status, 0::bigint as reopened, null::bigint as last from (select distinct user_id from events)
 union all select f.user_id, e.n, case when coalesce(e.t < f.last, false) then f.status when k in ('click', 'error') then 'open' when k = 'purchase' then 'fixed' when k = 'view' then 'duplicate' else f.status end,
 f.reopened + (not coalesce(e.t < f.last, false) and k in ('click', 'error') and coalesce(f.status = 'fixed', false))::bigint, greatest(f.last, e.t) from f join e on e.user_id = f.user_id and e.n = f.n + 1)
select user_id as key, arg_max(status, n) as status, max(reopened) as reopened, max(last) as last_at from f group by 1"""


def budget_prefix(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return R.prefix_within(docs, "source", ["doc_id"], "n_chars", 20_000)


BUDGET = "select source, doc_id, n_chars, used::bigint as used from (select source, doc_id, n_chars, sum(n_chars) over (partition by source order by doc_id rows unbounded preceding) as used from documents) where used <= 20000"


def usage_telemetry(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("model"), (F.pmod("event_id", F.lit(3)) == 0).alias("cached"), F.pmod("event_id", F.lit(1000)).alias("tokens"), F.expr(CENTS).alias("cost"))
    return A.usage_by_model(e)


USAGE = f"""select event_type as model, count(*) as requests, count(*) filter (event_id % 3 = 0) as hits, sum(event_id % 1000)::bigint as tokens, sum({CENTS})::bigint as cost,
round_even(count(*) filter (event_id % 3 = 0) / count(*), 4) as hit_rate from events group by 1"""


def priority_rank(spark, d):
    from provenant.functions import text as T

    p = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("key"),
        F.when(F.col("l_extendedprice") > 50_000, "critical").when(F.col("l_extendedprice") > 30_000, "high").when(F.col("l_extendedprice") > 15_000, "medium").otherwise("low").alias("severity"),
        (F.lit(1.0) - F.round(F.col("l_discount") * 100) / 100).alias("confidence"), F.when(F.col("l_returnflag") == "R", "deep").otherwise("fast").alias("depth"), F.lit("scheduled").alias("state"),
    )
    scored = p.withColumn("score", T.priority_score(F.col("severity"), F.col("confidence"), F.col("depth")).cast("long"))
    return R.demote_past(scored, "key", "score", ["l_orderkey", "l_linenumber"], 40, "state", "deferred").select("key", "l_orderkey", "l_linenumber", "score", F.col("rank").cast("long").alias("rank"), "state")


PRIORITY = """with s as (select l_suppkey as key, l_orderkey, l_linenumber, least(100, round_even((case when l_extendedprice > 50000 then 95 when l_extendedprice > 30000 then 75 when l_extendedprice > 15000 then 50 else 25 end)
 * (1.0::double - round(l_discount * 100) / 100) + case when l_returnflag = 'R' then 5 else 0 end, 0))::bigint as score from lineitem),
r as (select *, row_number() over (partition by key order by score desc, l_orderkey, l_linenumber) as rank from s)
select key, l_orderkey, l_linenumber, score, rank, case when rank > 40 then 'deferred' else 'scheduled' end as state from r"""


def obligation_reconcile(spark, d):
    e = table(spark, d, "events").select(
        F.concat_ws(":", F.pmod("user_id", F.lit(50)).cast("string"), "event_type").alias("canonical_id"), F.pmod("event_id", F.lit(7)).cast("string").alias("coverage_scope"),
        F.when(F.pmod("event_id", F.lit(5)) == 0, "NO_ISSUE").when(F.pmod("event_id", F.lit(5)) == 1, "CANDIDATE_FOUND").when(F.pmod("event_id", F.lit(5)) == 2, "NEEDS_CONTEXT").otherwise("UNRESOLVED").alias("status"),
        F.when(F.col("event_type") == "error", "REQUIRED").otherwise("SUPPORTING").alias("importance"),
    )
    return A.reconcile_obligations(e)


OBLIGATIONS = """with g as (select (user_id % 50)::varchar || ':' || event_type as c, event_id % 7 as s, bool_or(event_type = 'error') as req, bool_or(event_id % 5 in (0, 1)) as res, bool_or(event_id % 5 in (2, 3, 4)) as pen from events group by 1, 2)
select count(*) as canonical_obligations_total, count(*) filter (req) as canonical_required_obligations, count(*) filter (not res and pen and req) as canonical_required_unresolved,
count(*) filter (not res and pen and not req) as canonical_supporting_unresolved, count(*) filter (res and pen) as obligations_reconciled_by_sibling from g"""


def batch_reconcile(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), "l_returnflag", "l_linestatus")
    region = F.concat_ws("-", F.col("o").cast("string"), F.col("n").cast("string"))
    planned = li.select(F.col("o").alias("workset_id"), F.lit("h").alias("evidence_hash"), F.col("l_linestatus").alias("canonical_id"), region.alias("region_id"))
    status = F.when(F.col("l_returnflag") == "R", "CANDIDATE_FOUND").when(F.col("l_returnflag") == "A", "NO_ISSUE").otherwise("NOT_APPLICABLE")
    answered = li.where(F.pmod(F.col("o") + F.col("n"), F.lit(11)) != 0)
    observed = answered.select(region.alias("region_id"), F.col("l_linestatus").alias("canonical_id"), F.when(F.pmod("o", F.lit(13)) == 0, "UNRESOLVED").otherwise(status).alias("status"))
    got = A.reconcile_batches(planned, observed)
    batches = li.select(F.col("o").alias("workset_id"), (F.col("n") - 1).cast("long").alias("batch_index"), F.lit(7).alias("batch_count"))
    gaps = A.missing_batches(batches).select("workset_id", F.size("absent").cast("long").alias("batches_missing"))
    return got.join(gaps, "workset_id", "left").select("workset_id", "canonical_id", "status", "missing", F.coalesce("batches_missing", F.lit(0)).alias("batches_missing"))


BATCHES = """with li as (select distinct l_orderkey as o, l_linenumber as n, l_linestatus as c from lineitem),
a as (select l_orderkey as o, l_linenumber as n, l_linestatus as c, count(*) as k, list(case when l_orderkey % 13 = 0 then 'UNRESOLVED' when l_returnflag = 'R' then 'CANDIDATE_FOUND' when l_returnflag = 'A' then 'NO_ISSUE' else 'NOT_APPLICABLE' end) as s
 from lineitem where (l_orderkey + l_linenumber) % 11 <> 0 group by all),
j as (select li.o, li.c, a.k, a.s from li left join a using (o, n, c)),
g as (select o, c, bool_and(coalesce(k = 1 and not list_contains(s, 'UNRESOLVED'), false)) as ok, count(*) filter (k is null) as missing, bool_or(coalesce(list_contains(s, 'CANDIDATE_FOUND'), false)) as cf, bool_or(coalesce(list_contains(s, 'NO_ISSUE'), false)) as ni from j group by all),
b as (select l_orderkey as o, 7 - count(distinct l_linenumber) as m from lineitem group by 1)
select o as workset_id, c as canonical_id, case when not ok then 'UNRESOLVED' when cf then 'CANDIDATE_FOUND' when ni then 'NO_ISSUE' else 'NOT_APPLICABLE' end as status, missing, m::bigint as batches_missing from g join b using (o)"""


def merge_policy(spark, d):
    from provenant.operators import policy as P

    li = table(spark, d, "lineitem")
    f = li.select(
        F.col("l_orderkey").alias("review"),
        F.when(F.pmod("l_partkey", F.lit(5)) == 0, "EXISTING").when(F.pmod("l_partkey", F.lit(5)) == 1, "RESOLVED").when(F.pmod("l_partkey", F.lit(5)) == 2, "REGRESSED").otherwise("INTRODUCED").alias("relationship"),
        F.when(F.col("l_linestatus") == "O", "verified").otherwise("rejected").alias("verification_state"), F.when(F.pmod("l_suppkey", F.lit(9)) == 0, "false_positive").alias("triage_state"),
        (F.lit(1.0) - F.col("l_discount") * 5).alias("confidence"),
        F.when(F.col("l_quantity") > 40, "critical").when(F.col("l_quantity") > 20, "medium").when(F.col("l_quantity") > 5, "low").otherwise("odd").alias("severity"),
    )
    bad = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("review"))
    return P.merge_policy(f, "review", bad)


MERGE = """with f as (select l_orderkey as review, case when l_partkey % 5 in (0, 1) then 5 when l_linestatus <> 'O' then 5 when l_suppkey % 9 = 0 then 5 when 1.0::double - l_discount * 5 < 0.7::double then 3
 when l_quantity > 40 then 1 when l_quantity > 5 then 4 else 3 end as p from lineitem union all select o_orderkey, 2 from orders where o_orderstatus = 'P')
select review, ['BLOCK', 'INCOMPLETE', 'REQUIRE_SECURITY_APPROVAL', 'WARN', 'PASS'][min(p)] as decision from f group by review"""


def scan_policy(spark, d):
    from provenant.operators import policy as P

    f = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("scan"), F.when(F.col("l_quantity") > 45, "critical").when(F.col("l_quantity") > 30, "medium").otherwise("info").alias("severity"), (F.lit(1.0) - F.col("l_discount") * 5).alias("confidence"), (F.pmod("l_partkey", F.lit(17)) == 0).alias("incomplete"))
    return P.scan_policy(f, "scan", ("critical", "high"), ("medium",), 0.7)


SCAN = """select l_orderkey as scan, case when bool_or(l_quantity > 45 and 1.0::double - l_discount * 5 >= 0.7::double) then 'block' when bool_or(l_quantity > 30 and l_quantity <= 45 and 1.0::double - l_discount * 5 >= 0.7::double) then 'warn'
when bool_or(l_partkey % 17 = 0) then 'incomplete' else 'pass' end as decision from lineitem group by 1"""


def json_props(spark, d):
    k = F.from_json("props", "k BIGINT", {"mode": "PERMISSIVE"})["k"]
    return table(spark, d, "events").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr(CENTS)).alias("cents"))


JSON = f"select cast(json_extract(props, '$.k') as bigint) as k, count(*) as n, sum({CENTS})::bigint as cents from events group by 1"

QUERIES = {
    "acceptance_metrics": acceptance_metrics, "status_counts": status_counts, "monthly_cost": monthly_cost, "rolling_daily_quota": rolling_daily_quota, "latest_per_user": latest_per_user,
    "version_bumps": version_bumps, "idempotent_enqueue": idempotent_enqueue, "lease_next": lease_next, "late_run_guard": late_run_guard, "triage_fold": triage_fold, "occurrence_fold": occurrence_fold,
    "budget_prefix": budget_prefix, "usage_telemetry": usage_telemetry, "priority_rank": priority_rank, "obligation_reconcile": obligation_reconcile, "batch_reconcile": batch_reconcile,
    "merge_policy": merge_policy, "scan_policy": scan_policy, "json_props": json_props,
}
ORACLES = {
    "acceptance_metrics": ACCEPTANCE, "status_counts": STATUS, "monthly_cost": MONTHLY, "rolling_daily_quota": ROLLING, "latest_per_user": LATEST, "version_bumps": VERSIONS, "idempotent_enqueue": ENQUEUE,
    "lease_next": LEASE, "late_run_guard": LATE, "triage_fold": TRIAGE, "occurrence_fold": OCCURRENCES, "budget_prefix": BUDGET, "usage_telemetry": USAGE, "priority_rank": PRIORITY, "obligation_reconcile": OBLIGATIONS,
    "batch_reconcile": BATCHES, "merge_policy": MERGE, "scan_policy": SCAN, "json_props": JSON,
}
