"""What must hold on larger tables: rows that tie, groups that grow, files that come in parts."""

from __future__ import annotations

from provenant.operators import joins as J
from provenant.plans import registry


def test_replace_rows_takes_the_first_line_of_the_table(spark, tmp_path):
    """The larger file is read first; the row of the first file counts nevertheless."""
    o = spark.createDataFrame([(1, 5, "O", 2.0), (2, 5, "F", 3.0)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double")
    o.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string"
    small = spark.createDataFrame([(1, 10, 2, 3, "A"), (2, 11, 2, 1, "A")], schema)
    large = spark.range(5000).selectExpr("id + 3 as l_orderkey", "id * 7919 as l_partkey", "2L as l_suppkey", "1 as l_linenumber", "'N' as l_returnflag").unionByName(spark.createDataFrame([(1, 20, 2, 3, "R"), (2, 21, 2, 2, "R")], schema))
    (tmp_path / "lineitem.parquet").mkdir()
    for i, df in enumerate((small, large)):
        df.coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
        next((tmp_path / f"w{i}").glob("*.parquet")).rename(tmp_path / "lineitem.parquet" / f"part-{i}.parquet")
    got = registry.QUERIES["replace_rows"](spark, str(tmp_path)).where("o_orderkey < 3").orderBy("o_orderkey").collect()
    assert [tuple(r) for r in got] == [(1, "A", 10), (2, "R", 21)]


def test_equal_windows_are_one_island_whatever_their_order(spark):
    """Sixty windows of one start, in the middle of an island and at the start of one."""
    from provenant.operators import intervals as I

    starts = [0] * 60 + [100] * 60 + [1000] * 60
    df = spark.createDataFrame([(7, s, s + 5) for s in starts], "k long, start long, end long").repartition(8)
    got = sorted(tuple(r) for r in I.merge_near(df, "k", 200).collect())
    assert got == [(7, 0, 105, 120), (7, 1000, 1005, 60)]


def test_unique_resolution_counts_targets_once(spark):
    """Twenty thousand rows and as many targets of one name: four hundred million pairs, which nobody needs."""
    left = spark.range(20_000).selectExpr("id", "'x' as a", "id % 2 as b").unionByName(spark.createDataFrame([(-1, "y", 0), (-2, None, 0), (-3, "z", 0)], "id long, a string, b long"))
    targets = spark.range(20_000).selectExpr("id as t", "'x' as c", "id % 2 as e").unionByName(spark.createDataFrame([(7, "y", 0), (7, "y", 0), (8, None, 0)], "t long, c string, e long"))
    got = J.resolve_unique(left, targets, [("a", "c"), ("b", "e")], "id", "t")
    assert got.where("id >= 0").groupBy("n_targets", "target").count().collect() == [(10_000, None, 20_000)]
    assert sorted((r["id"], r["n_targets"], r["target"]) for r in got.where("id < 0").collect()) == [(-3, 0, None), (-2, 0, None), (-1, 1, 7)]


def test_alias_totals_are_those_of_the_pairs(spark):
    names = ["a.X", "x", "b.x", "X.y", "y", "y.", "", ".", None, "a.x"]
    left = spark.createDataFrame([(i, x) for i, x in enumerate(names)], "id long, name string")
    right = spark.createDataFrame([(100 + i, x) for i, x in enumerate(names)], "id long, name string")
    alias = lambda x: {x.lower(), x.lower().split(".")[-1]} if x is not None else set()
    want = sorted((i, 100 + j) for i, a in enumerate(names) for j, b in enumerate(names) if alias(a) & alias(b))
    assert sorted(tuple(r) for r in J.alias_join(left, right, "name", "name").collect()) == want
    totals = {i: (len(p), sum(p)) for i in {i for i, _ in want} for p in [[b for a, b in want if a == i]]}
    assert {r[0]: (r[1], r[2]) for r in J.alias_totals(left, right, "name", "name").collect()} == totals
    many = spark.range(50_000).selectExpr("id", "concat('m', id % 3, '.F') as name")
    assert J.alias_totals(many, many, "name", "name").select("n", "rights").distinct().collect() == [(50_000, 50_000 * 49_999 // 2)]


def test_parsing_shuffles_whole_files_once(spark, monkeypatch):
    """Lines travel once with their path and once with their definitions; without hashes no text is cut out again, and the rest is the same."""
    from provenant.sources import parsing as P

    text = "class A:\n    def m(self):\n        self.n(1)\n\n    def n(self, x):\n        def inner():\n            return m(x)\n        return inner()\nm(2)\n"
    files = spark.createDataFrame([("a.py", text), ("b.py", "x = f(1)\n"), ("c.js", "function f(a) {\n  g(a);\n}\nh();\n"), ("d.txt", "one\ntwo\n")], "path string, content string")
    plain, whole = P.parse(files, hashes=False), P.parse(files)
    assert sorted(tuple(r) for r in plain.symbols.collect()) == sorted(tuple(r) for r in whole.symbols.drop("content_hash").collect())
    assert sorted((r.path, r.caller, r.callee, r.line) for r in plain.calls.collect()) == [
        ("a.py", "A.m", "self.n", 3), ("a.py", "A.n", "inner", 8), ("a.py", "A.n.inner", "m", 7), ("a.py", "a.py", "m", 9), ("b.py", "b.py", "f", 1), ("c.js", "c.js", "h", 4), ("c.js", "f", "g", 2)]
    plan = plain.calls._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_greedy_match_within_equals_the_general_one(spark):
    import random

    r = random.Random(3)
    row = lambda i: (r.randrange(4), i, i, r.randrange(9))
    e = spark.createDataFrame([row(i) for i in range(300)] + [(9, 900, 900, 1), (0, 901, 901, None)], "case long, id long, ord long, v long")
    f = spark.createDataFrame([row(i) for i in range(1000, 1280)] + [(8, 1900, 1900, 1), (0, 1901, 1901, None)], "case long, id long, ord long, v long")
    near = lambda a, b: a["v"] == a["v"] and b["v"] == b["v"] and abs(a["v"] - b["v"]) <= 1
    want = sorted((tuple(x) for x in J.greedy_match(e, f, "case", near).collect()), key=str)
    assert sorted((tuple(x) for x in J.greedy_match_within(e, f, 1).collect()), key=str) == want


def test_greedy_match_within_large_case(spark):
    """One case of 100,000 rows a side, matched the other way round: each search through a list of free findings would go to its end."""
    e = spark.range(100_000).selectExpr("'c' as case", "id", "id as ord", "99999 - id as v")
    f = spark.range(100_000).selectExpr("'c' as case", "id", "id as ord", "id as v")
    got = J.greedy_match_within(e, f, 0)
    assert got.where("finding = 99999 - expectation").count() == 100_000


def test_claims_of_small_and_large_codebases(spark, monkeypatch):
    """Small codebases need no round; large ones take them beside the small ones; both ways give the same claims, also where a codebase is null."""
    import random

    r = random.Random(5)
    rows = sorted({(c, i, i, p, p) for c in (1, 2, 3, None) for i in range(12) for p in r.sample(range(100, 120), 5 if c == 1 else 2)}, key=str)
    pairs = spark.createDataFrame(rows, "codebase long, ord long, id long, prior long, prior_ord long")
    want, used, done = [], set(), set()
    for c, _, i, p, _ in sorted(rows, key=lambda x: (x[0] or 0, x[1], x[4])):
        if c is not None and (c, i) not in done and (c, p) not in used:
            want.append((c, i, p)); done.add((c, i)); used.add((c, p))
    known = lambda **k: sorted(tuple(x) for x in J.claim_once(pairs, **k).where("codebase IS NOT NULL").collect())
    assert known(alone=0) == known(alone=30) == known(alone=30, rounds=1) == want
    count, cuts = J.cut, []
    monkeypatch.setattr(J, "cut", lambda df, s: cuts.append(1) or count(df, s))
    assert known() == want and len(cuts) == 1


def _shuffled(spark) -> int:
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


def test_similar_pairs_do_not_carry_their_sets(spark, monkeypatch):
    """Equal to brute force with copies, blocks and small chunks; then 300 near copies of one long text: a set travels a few times, not once for each of 44,850 pairs."""
    import random

    from provenant.operators import resolution as E

    r = random.Random(11)
    base = [[f"w{r.randrange(60)}" for _ in range(r.randrange(1, 25))] for _ in range(12)]
    sets = [(i, r.choice(("x", "y", None)), list(dict.fromkeys([w if r.random() < 0.9 else f"v{r.randrange(40)}" for w in r.choice(base)]))) for i in range(150)] + [(900, "x", []), (901, "x", ["a|b"]), (902, "x", ["a", "b"])]
    want = []
    for i, p, a in sets:
        for j, q, b in sets:
            n = len(set(a) & set(b))
            if i < j and p == q and p is not None and n and n >= len(set(a) | set(b)) * 0.6:
                want.append((i, j, n))
    df = spark.createDataFrame(sets, "id long, p string, t array<string>")
    monkeypatch.setattr(E, "CHUNK_SETS", 3)
    assert sorted((x.a, x.b, x.shared) for x in E.similar_pairs(df, ["p"], "t", 0.6).collect()) == sorted(want) and len(want) > 100
    monkeypatch.undo()
    words = [f"word{i:05}" for i in range(1500)]
    near = spark.createDataFrame([(i, "x", words[i:] + [f"own{i}"]) for i in range(300)], "id long, p string, t array<string>")
    before = _shuffled(spark)
    assert E.similar_pairs(near, ["p"], "t", 0.6).count() == 44_850
    assert _shuffled(spark) - before < 60e6


def test_typed_lookup_broadcasts_no_nodes(spark):
    """A small file of nodes has many rows once their labels are taken apart; only the table of kinds goes through the driver."""
    from provenant.operators import graphs as G

    nodes = spark.createDataFrame([(i, f"label_{i % 5}", f"p{i % 3}", i) for i in range(60)], "node_id long, label string, path string, line long")
    edges = spark.createDataFrame([(i, (i * 7) % 60, "Calls") for i in range(60)], "source long, target long, relation string")
    asks = spark.createDataFrame([(1, "definition", "p1", "label_2", ""), (2, "callees", "", "label_3", ""), (3, "search", "", "", "LABEL_4"), (4, "search", "p2", "", "label bel_4")], "id long, kind string, path string, symbol string, query string")
    found = G.typed_lookup(asks, nodes, edges, 100)
    got = {i: sorted(x.node_id for x in found.collect() if x.id == i) for i in (1, 2, 3, 4)}
    assert got == {1: [i for i in range(60) if i % 5 == 2 and i % 3 == 1], 2: sorted({i * 7 % 60 for i in range(60) if i % 5 == 3}), 3: [i for i in range(60) if i % 5 == 4], 4: [i for i in range(60) if i % 5 == 4 and i % 3 == 2]}
    whole = found._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in whole.splitlines() if "Join Inner" in x]
    assert len(joins) >= 6 and all("merge" in x or "broadcast" in x for x in joins if "_rel" not in x)


def test_ordered_passes_stream_past_many_small_keys(spark):
    """3,000 keys of a few rows in each pass: keys share batches, a key's rows may come in several, and a file's lines are not repeated for each of its regions."""
    from provenant.operators import intervals as I
    from provenant.operators import ranking as R

    many = spark.range(9000).selectExpr("if(id = 0, null, id % 3000) as k", "id as ord", "int(4 + id % 3) as chars")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        packed, filled = I.pack_batches(many, "k", 2, 10), R.fill_within(many, "k", ["ord"], "chars", 10)
        rows, kept = packed.collect(), filled.collect()
        regions = spark.range(3000).selectExpr("concat('f', id % 40) as path", "int(id) as start_line", "int(id + 5) as end_line", "'line_range' as anchor_type", "'' as anchor_id", "array('t') as task_ids")
        files = spark.range(39).selectExpr("concat('f', id) as path", "array_repeat('xxxx', 4000) as lines")
        merged = I.merge_anchored(regions, files)
        assert merged.count() == 3000 * 39 // 40
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) == 9000 and all(r.batch == r.ord // 3000 // (1 if r.chars == 6 else 2) for r in rows if r.k)
    assert all(r.used == r.chars if r.ord < 3000 else r.used <= 10 for r in kept) and {r.ord for r in kept} >= set(range(3000))
    for df in (packed, filled, merged):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroups" not in plan and "Join" not in plan


def _stages(df):
    """The operators of the plan that is run, by name."""
    text = df._jdf.queryExecution().optimizedPlan().toString()
    return {name: text.count(name) for name in ("Aggregate", "Join", "Window", "Distinct", "Union")}


def test_subtract_in_one_run(spark):
    import random

    from provenant.operators import intervals as I

    rng = random.Random(8)
    ranges = [(k, i, a, a + rng.randrange(30)) for k in range(4) for i in range(20) for a in [rng.randrange(100)]]
    covered = [(k, a, a + rng.randrange(-1, 6)) for k in range(3) for a in (rng.randrange(120) for _ in range(18))]
    out = I.subtract(spark.createDataFrame(ranges, "k long, id long, start long, end long"), spark.createDataFrame(covered, "k long, start long, end long"), "k")
    want = []
    for k, i, a, b in ranges:
        free = [n for n in range(a, b + 1) if not any(q == k and s <= n <= e for q, s, e in covered)]
        want += [(k, i, n, next(m for m in range(n, b + 2) if m not in free) - 1) for n in free if n - 1 not in free]
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)
    assert _stages(out)["Join"] == 1 and _stages(out)["Union"] == 0 and _stages(out)["Aggregate"] == 0


def test_set_delta_in_one_pass(spark):
    from provenant.operators import overlay as V

    rows = lambda x: spark.createDataFrame([(i % 7, i) for i in x], "a long, b long")
    out = V.set_delta(rows([1, 1, 2, 3]), rows([3, 4, 4]))
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1, "removed"), (2, 2, "removed"), (4, 4, "added")]
    assert _stages(out)["Aggregate"] == 1


def test_calls_are_counted_before_symbols_meet_them(spark):
    symbols = spark.createDataFrame([(i, "p", f"x.f{i % 2}") for i in range(50)], "symbol_id long, path string, name string")
    calls = spark.createDataFrame([("p", f"x.f{i % 2}", f"m.f{i % 3}") for i in range(30)], "path string, caller string, callee string")
    totals = J.resolve_edge_totals(calls, symbols)
    pairs = {(i, j) for i in range(50) for j in range(50) if i != j}
    assert {r["source_id"]: (r["n"], r["targets"]) for r in totals.collect()} == {i: (49, sum(j for a, j in pairs if a == i)) for i in range(50)}
    sources, targets = J.resolved_names(calls, symbols)
    assert {tuple(r) for r in sources.collect()} == {(i, f"f{n}") for i in range(50) for n in range(2)} and targets.count() == 50
    # nothing is grouped after the join that multiplies rows by symbols
    top = totals._jdf.queryExecution().optimizedPlan().toString()
    assert top.index("Join") < top.index("Aggregate")


def test_kinds_that_nobody_asks_for_are_not_read(spark):
    from provenant.operators import policy as Q

    symbols = spark.createDataFrame([("a.f", "p", 1), ("f", "q", 2)], "name string, path string, start_line int")
    calls = spark.createDataFrame([("a.f", "g")], "caller string, callee string")
    imports = spark.createDataFrame([("p", "m")], "path string, module string")
    asks = spark.createDataFrame([(1, "definition", "F"), (2, "other", "f"), (3, None, "f")], "id long, kind string, target string")
    found = Q.expand_requests(asks, symbols, calls, imports, 4)
    assert sorted((r["id"], r["rank"], r["fact"]) for r in found.collect()) == [(1, 1, "p:1"), (1, 2, "q:2")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("WindowGroupLimit") == 1
    assert Q.expand_requests(asks.where("id > 1"), symbols, calls, imports, 4).isEmpty()


def test_similar_pairs_leave_no_words_behind(spark):
    """Pairs are there before sets travel: nothing that is left to run takes words apart or joins heads with heads, so their shuffle files are gone."""
    from provenant.operators import resolution as E

    df = spark.createDataFrame([(i, "x", [f"w{j}" for j in range(i % 3, 9)]) for i in range(12)], "id long, p string, t array<string>")
    found = E.similar_pairs(df, ["p"], "t", 0.6)
    assert found.count() == 66
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan
