"""State over time, as batch folds: queues, leases, late runs, occurrences, triage, journals, outcomes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Triage commands, their transitions, and the states at which a repeated command changes nothing.
TRIAGE = {
    "valid": {"open": "confirmed"},
    "fp": {"open": "false_positive", "confirmed": "false_positive"},
    "accepted_risk": {"open": "accepted_risk", "confirmed": "accepted_risk"},
    "fixed": {"open": "fix_pending", "confirmed": "fix_pending", "accepted_risk": "fix_pending"},
}
TRIAGE_DONE = {
    "valid": ("confirmed",), "fp": ("false_positive",), "accepted_risk": ("accepted_risk",), "fixed": ("fix_pending", "fix_validating", "resolved"),
}
REASON_REQUIRED = ("fp", "accepted_risk")
# States of an investigation and those that may follow.
INVESTIGATION = {
    "planned": ("running", "skipped"), "running": ("candidate", "no_candidate", "unresolved", "failed"), "candidate": (), "no_candidate": (),
    "unresolved": ("running",), "failed": ("running",), "skipped": (),
}


def first_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Idempotent intake: of all requests with a key, the first."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def identity_conflicts(df: DataFrame, key: list[str], identity: str) -> DataFrame:
    """Keys that came with more than one payload: ``*key, n``."""
    return df.groupBy(*key).agg(F.count_distinct(identity).alias("n")).where("n > 1")


def leasable(jobs: DataFrame, now: Column) -> Column:
    """Queued or leased, attempts left, and no lease that still runs."""
    free = F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") <= now)
    return F.col("state").isin("queued", "leased") & (F.col("attempt_count") < F.col("maximum_attempts")) & free


def expire_exhausted(jobs: DataFrame, now: Column) -> DataFrame:
    """Leased jobs whose last attempt's lease has run out fail."""
    dead = (F.col("state") == "leased") & (F.col("lease_expires_at") <= now) & (F.col("attempt_count") >= F.col("maximum_attempts"))
    return jobs.withColumn("state", F.when(dead, "failed").otherwise(F.col("state"))).withColumn("lease_owner", F.when(~dead, F.col("lease_owner")))


def next_leases(jobs: DataFrame, tenant: str, limits: DataFrame, spent: DataFrame, now: Column) -> DataFrame:
    """Who gets the next leases: per tenant as many leasable jobs as its free slots, by priority, age and id; none above its monthly cost.

    ``limits(tenant, concurrent, monthly_cost)``, ``spent(tenant, cost)``. One row for each tenant is joined, so both stay small.
    """
    running = jobs.groupBy(F.col(tenant).alias("_t")).agg(F.count_if((F.col("state") == "leased") & (F.col("lease_expires_at") > now)).alias("_active"))
    s = spent.select(F.col(tenant).alias("_u"), F.col("cost").alias("_cost"))
    room = limits.join(running, F.col(tenant) == F.col("_t"), "left").join(s, F.col(tenant) == F.col("_u"), "left").select(
        F.col(tenant).alias("_v"),
        F.when(F.coalesce("_cost", F.lit(0)) >= F.col("monthly_cost"), 0).otherwise(F.greatest(F.lit(0), F.col("concurrent") - F.coalesce("_active", F.lit(0)))).alias("_free"),
    )
    w = Window.partitionBy(tenant).orderBy("priority", "created_at", "job_id")
    ready = jobs.where(leasable(jobs, now)).withColumn("_rn", F.row_number().over(w))
    return ready.join(room, F.col(tenant) == F.col("_v")).where("_rn <= _free").drop("_v", "_free", "_rn")


def renew(jobs: DataFrame, owner: Column, now: Column, until: Column) -> DataFrame:
    """A heartbeat moves the lease on if the owner holds it and it still runs. Adds ``updated``."""
    ok = (F.col("state") == "leased") & F.col("lease_owner").eqNullSafe(owner) & (F.col("lease_expires_at") > now)
    return jobs.withColumn("updated", F.coalesce(ok, F.lit(False))).withColumn("lease_expires_at", F.when(F.col("updated"), until).otherwise(F.col("lease_expires_at")))


def finish(jobs: DataFrame, owner: Column, ok: bool) -> DataFrame:
    """Completion, or failure that queues again while attempts are left, by the owner only. Adds ``updated``."""
    mine = (F.col("state") == "leased") & F.col("lease_owner").eqNullSafe(owner)
    after = F.lit("completed") if ok else F.when(F.col("attempt_count") < F.col("maximum_attempts"), "queued").otherwise("failed")
    done = jobs.withColumn("updated", F.coalesce(mine, F.lit(False)))
    return done.withColumn("state", F.when(F.col("updated"), after).otherwise(F.col("state"))).withColumn("lease_owner", F.when(~F.col("updated"), F.col("lease_owner")))


def claim_outcome(state: Column, expires: Column, attempts: Column, most: Column, now: Column) -> Column:
    """What a claim meets: replay of a completed one, conflict with a running one, exhausted attempts, or a (re)claim."""
    return F.when(state == "completed", "replay").when((state == "running") & (expires > now), "conflict").when(attempts >= most, "exhausted").otherwise("claimed")


def accept_on_time(runs: DataFrame, key: str, arrival: list[str], at: str) -> DataFrame:
    """Adds ``accepted``: a run older than one that arrived before it must not overwrite. Event time per key, not a watermark."""
    before = Window.partitionBy(key).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1)
    newest = F.max(at).over(before)
    return runs.withColumn("accepted", newest.isNull() | (F.col(at) >= newest))


def current_rows(runs: DataFrame, key: str, at: str, arrival: list[str]) -> DataFrame:
    """What stays after all runs: the one with the latest event time, of equals the one that arrived last."""
    rest = [c for c in runs.columns if c != key]
    return runs.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, *arrival)).alias("_r")).select(key, "_r.*")


ENDINGS = ("closed", "merged")


def occurrence_fold(events: DataFrame) -> DataFrame:
    """``events(key, ord, outcome, at)`` -> ``key, status, reopened, last_at``: each key's events in order.

    observed: open, counted as reopened if it was fixed; fixed and duplicate set their status; others carry it on. An event older than the last
    accepted one is ignored; closed and merged retire an open finding and end the scope whenever they come. The fold is an expression over a
    key's ordered events.
    """
    seq = F.transform(F.array_sort(F.collect_list(F.struct("ord", "outcome", F.col("at").cast("long").alias("at")))), lambda e: F.struct(e["outcome"].alias("o"), e["at"].alias("a")))
    zero = F.struct(F.lit(None).cast("string").alias("s"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("t"), F.lit(False).alias("over"))

    def step(acc: Column, e: Column) -> Column:
        ends = e["o"].isin(*ENDINGS)
        late = acc["t"].isNotNull() & (e["a"] < acc["t"])
        live, fixed = ~acc["over"], F.coalesce(acc["s"] == "fixed", F.lit(False))
        seen, set_ = e["o"] == "observed", e["o"].isin("fixed", "duplicate")
        status = F.when(ends, F.when(acc["s"] == "open", e["o"]).otherwise(acc["s"])).when(late, acc["s"]).when(seen, "open").when(set_, e["o"]).otherwise(acc["s"])
        return F.struct(
            F.when(live, status).otherwise(acc["s"]).alias("s"), (acc["n"] + F.when(live & ~ends & ~late & seen & fixed, 1).otherwise(0)).alias("n"),
            F.when(live & ~ends & ~late, e["a"]).otherwise(acc["t"]).alias("t"), (acc["over"] | ends).alias("over"),
        )

    done = events.groupBy("key").agg(F.aggregate(seq, zero, step).alias("_l"))
    return done.select("key", F.col("_l.s").alias("status"), F.col("_l.n").alias("reopened"), F.col("_l.t").alias("last_at"))


def promote(pr_rows: DataFrame, branch: DataFrame, closings: DataFrame) -> DataFrame:
    """``pr_rows(pr, finding, status)``, ``branch(finding, status)``, ``closings(pr, merged)`` -> the branch rows afterwards.

    Merged: open findings open on the branch, fixed ones fix what is open there; closed unmerged: nothing. Applied once.
    """
    hit = pr_rows.join(closings.where("merged").select("pr").distinct(), "pr", "left_semi")
    moves = hit.where("status IN ('open', 'fixed')").groupBy("finding").agg(F.bool_or(F.col("status") == "open").alias("_open"))
    both = branch.join(moves, "finding", "full_outer")
    status = F.when(F.col("_open"), "open").when(F.col("_open").isNotNull() & (F.col("status") == "open"), "fixed").otherwise(F.col("status"))
    return both.select("finding", status.alias("status")).where("status IS NOT NULL")


def fold_commands(events: DataFrame, key: str, order: list[str], command: str, start: str, table: dict[str, dict[str, str]] = TRIAGE) -> DataFrame:
    """``key, state, n_applied, n_rejected`` after all commands, in order, from ``start``. A command without a transition changes nothing.

    The fold is an expression over each key's ordered commands and a transition map.
    """
    pairs = {f"{c}:{a}": b for c, moves in table.items() for a, b in moves.items()}
    moves = F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])
    seq = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(command).alias("_c")))), lambda s: s["_c"])
    zero = F.struct(F.lit(start).alias("state"), F.lit(0).cast("long").alias("n_applied"), F.lit(0).cast("long").alias("n_rejected"))

    def step(acc: Column, c: Column) -> Column:
        to = F.try_element_at(moves, F.concat_ws(":", c, acc["state"]))
        return F.struct(
            F.coalesce(to, acc["state"]).alias("state"), (acc["n_applied"] + F.when(to.isNotNull(), 1).otherwise(0)).alias("n_applied"),
            (acc["n_rejected"] + F.when(to.isNull(), 1).otherwise(0)).alias("n_rejected"),
        )

    return events.groupBy(key).agg(F.aggregate(seq, zero, step).alias("_s")).select(key, "_s.*")


def command_result(state: Column, command: Column, reason: Column) -> Column:
    """applied, unchanged (the finding is already there), reason_required, or conflict."""
    pairs = [f"{c}:{a}" for c, moves in TRIAGE.items() for a in moves]
    done = [f"{c}:{a}" for c, states in TRIAGE_DONE.items() for a in states]
    at = F.concat_ws(":", command, state)
    bare = command.isin(*REASON_REQUIRED) & (F.coalesce(F.trim(reason), F.lit("")) == "")
    return F.when(at.isin(*done), "unchanged").when(bare, "reason_required").when(at.isin(*pairs), "applied").otherwise("conflict")


def may_follow(state: Column, target: Column) -> Column:
    return F.concat_ws(">", state, target).isin(*[f"{a}>{b}" for a, to in INVESTIGATION.items() for b in to])


def journal(units: DataFrame, events: DataFrame) -> DataFrame:
    """``units(stage, unit_key, status, attempt_count, operation, identity)``, ``events(stage, unit_key, kind, ord)`` -> units afterwards.

    begin: running, one more attempt, unless completed; complete and fail act on what is not completed; at the end what still runs was abandoned and
    may be retried; a completed unit supersedes retryable ones with its operation and identity.
    """
    seq = F.transform(F.array_sort(F.collect_list(F.struct("ord", "kind"))), lambda s: s["kind"])
    folded = events.groupBy(F.col("stage").alias("_s"), F.col("unit_key").alias("_k")).agg(seq.alias("_e"))
    both = units.join(folded, (F.col("stage") == F.col("_s")) & (F.col("unit_key") == F.col("_k")), "left")
    zero = F.struct(F.col("status").alias("s"), F.col("attempt_count").cast("long").alias("n"))

    def step(acc: Column, kind: Column) -> Column:
        done = acc["s"] == "completed"
        s = F.when(done, acc["s"]).when(kind == "begin", "running").when(kind == "complete", "completed").when(kind == "fail", "failed_retryable").otherwise(acc["s"])
        return F.struct(s.alias("s"), (acc["n"] + F.when(~done & (kind == "begin"), 1).otherwise(0)).alias("n"))

    after = both.withColumn("_r", F.aggregate(F.coalesce("_e", F.array().cast("array<string>")), zero, step)).select(
        "stage", "unit_key", F.when(F.col("_r.s").isin("running", "pending"), "failed_retryable").otherwise(F.col("_r.s")).alias("status"),
        F.col("_r.n").alias("attempt_count"), "operation", "identity",
    )
    finished = after.where("status = 'completed'").select(F.col("operation").alias("_o"), F.col("identity").alias("_i")).distinct()
    out = after.join(finished, (F.col("operation") == F.col("_o")) & (F.col("identity") == F.col("_i")), "left")
    status = F.when((F.col("status") == "failed_retryable") & F.col("_o").isNotNull(), "superseded").otherwise(F.col("status"))
    return out.select("stage", "unit_key", status.alias("status"), "attempt_count", "operation", "identity")


def expired(artifacts: DataFrame, now: Column) -> DataFrame:
    """Artifacts past their time that have not been deleted."""
    return artifacts.where((F.col("expires_at") <= now) & F.col("deleted_at").isNull())


def known_outcomes(known: DataFrame, observed: DataFrame, decided: DataFrame, rechecked: DataFrame, complete: bool) -> DataFrame:
    """``known(id, scope)`` -> ``id, outcome``: observed again, else decided, else the recheck's result, else carried.

    An incomplete run holds fixes back: they become carried_incomplete.
    """
    o = observed.select(F.col("id").alias("_o")).distinct()
    d = decided.select(F.col("id").alias("_d"), F.col("outcome").alias("_do"))
    r = rechecked.select(F.col("id").alias("_r"), F.col("outcome").alias("_ro"))
    both = known.join(o, F.col("id") == F.col("_o"), "left").join(d, F.col("id") == F.col("_d"), "left").join(r, F.col("id") == F.col("_r"), "left")
    out = F.when(F.col("_o").isNotNull(), "reobserved").otherwise(F.coalesce("_do", "_ro", F.lit("carried")))
    held = out if complete else F.when(out.startswith("fixed"), "carried_incomplete").otherwise(out)
    return both.select("id", "scope", held.alias("outcome"))


def recheck_plan(known: DataFrame, changes: DataFrame, limit: int) -> DataFrame:
    """``known(id, scope, path, ord)``, ``changes(path, status)`` -> ``id, plan``: deleted files are fixed, unchanged ones of the PR carried, the first
    ``limit`` of the rest rechecked, the others carried as incomplete."""
    c = changes.select(F.col("path").alias("_p"), F.col("status").alias("_s"))
    both = known.join(c, F.col("path") == F.col("_p"), "left").withColumn("_s", F.coalesce("_s", F.lit("unchanged")))
    settled = F.when(F.col("_s") == "deleted", "fixed_removed").when((F.col("_s") == "unchanged") & (F.col("scope") == "pr"), "carried_unchanged")
    first = both.withColumn("_x", settled).where("_x IS NULL").orderBy("ord").limit(limit).select(F.col("id").alias("_i"))
    return both.join(first, F.col("id") == F.col("_i"), "left").select(
        "id", F.coalesce(settled, F.when(F.col("_i").isNotNull(), "recheck"), F.lit("carried_incomplete")).alias("plan")
    )


def resolution_cascade(requests: DataFrame, exact: DataFrame, broad: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``requests(id)``, matches ``(id, entry)`` -> answered ``id, entry, source``, and the requests with neither, for outside research."""
    e = exact.groupBy(F.col("id").alias("_e")).agg(F.min("entry").alias("_x"))
    b = broad.groupBy(F.col("id").alias("_b")).agg(F.min("entry").alias("_y"))
    both = requests.join(e, F.col("id") == F.col("_e"), "left").join(b, F.col("id") == F.col("_b"), "left")
    source = F.when(F.col("_x").isNotNull(), "exact").when(F.col("_y").isNotNull(), "broad")
    out = both.select("id", F.coalesce("_x", "_y").alias("entry"), source.alias("source"))
    return out.where("source IS NOT NULL"), out.where("source IS NULL").select("id")
