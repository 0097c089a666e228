"""Search of many terms, support by classes and traces, against plain versions."""

from __future__ import annotations

import random

from provenant.operators import graphs as G
from provenant.operators import joins as J
from provenant.operators import policy as P
from provenant.plans import registry
from provenant.sources import readers as Z


def test_many_terms(spark):
    """A hundred thousand terms in several automata: every hit, overlapping ones and one term within another, and the columns kept."""
    rng = random.Random(6)
    terms = {"".join(rng.choice("abcdé") for _ in range(rng.randrange(5, 12))) for _ in range(100_000)} | {"aa", "aaa", "%_\\", "日本"}
    texts = [(i, "".join(rng.choice("abcdé %_\\日本") for _ in range(rng.randrange(0, 300))), i * 2) for i in range(300)] + [(900, None, 1), (901, "", 2)]
    df = spark.createDataFrame(texts, "id long, text string, term_count long")
    got = {(r["id"], r["term"]) for r in Z.terms_in(df, spark.createDataFrame([(t,) for t in [*terms, "", None]], "term string"), "text", 1 << 20).collect()}
    want = {(i, t[a : a + n]) for i, t, _ in texts if t for n in range(2, 12) for a in range(len(t) - n + 1) if t[a : a + n] in terms}
    assert got == want and len(want) > 300


def test_text_is_read_once(spark):
    """Terms beyond an automaton don't add passes over the text; short and long terms, long rows, batches with nulls, terms across rows' ends, and filters that are full."""
    rng = random.Random(16)
    word = lambda n: "".join(rng.choice("abé日 ") for _ in range(n))
    texts = [(i, word(rng.choice([0, 3, 40, 200]))) for i in range(200)] + [(500, None), (501, ""), (502, word(300_000)), (503, "ab"), (503, "ab"), (504, "é")]
    terms = {word(rng.randrange(6, 30)) for _ in range(2000)} | {t[a : a + n] for _, t in texts if t for a, n in [(rng.randrange(len(t)), rng.choice([1, 2, 5, 9, 17, 33, 150])) for _ in range(5)]} - {""} | {"ab", texts[202][1][131_000:131_200]}
    df, known = spark.createDataFrame(texts, "id long, text string").repartition(3), spark.createDataFrame([(t,) for t in terms], "term string")
    want = sorted((i, t) for i, text in texts if text for t in terms if t in text)
    found = Z.terms_in(df, known, "text", 1 << 10)
    assert sorted(map(tuple, found.collect())) == want and len(want) > 3000
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted(map(tuple, Z.terms_in(df, known, "text", 1 << 10, 1 << 13).collect())) == want


def test_hot_term_and_cap(spark):
    lines = spark.createDataFrame([("f", i, "hot line" if i % 2 else "cold hot") for i in range(1, 2001)], "path string, line_no int, text string")
    queries = spark.createDataFrame([("q", ["hot", "line"]), ("same", ["hot"]), ("none", ["x"]), ("bad", ["a\nb"]), ("empty", [])], "query_id string, terms array<string>")
    hits, bad = Z.search(lines, queries, "path", 100)
    rows = hits.collect()
    assert sorted((r["query_id"], r["line_no"]) for r in rows) == sorted((q, i) for q in ("q", "same") for i in range(1, 101)) and all(r["truncated"] for r in rows)
    assert sorted(r["query_id"] for r in bad.collect()) == ["bad", "empty"]


def test_requests_over_source(spark):
    files = spark.createDataFrame([("a.py", ["x = 1", "find me", "me"])], "path string, lines array<string>")
    routes = spark.createDataFrame([("a.py", 3, "GET /v1/Users"), ("a.py", 2, "POST /users/x")], "path string, line_no int, route string")
    asks = spark.createDataFrame([(1, "search", None, None, "me"), (2, "route", None, None, "/users"), (3, "route", None, None, "GET /v1/users"), (4, "search", None, None, "m")], "id long, kind string, path string, line int, target string")
    got = sorted((r["id"], r["line"], r["content"]) for r in P.expand_source(asks, files, routes, 1, 10).collect())
    assert got == [(1, 2, "find me"), (1, 3, "me"), (2, 3, "GET /v1/Users"), (3, 3, "GET /v1/Users")]


def test_support_and_traces(spark):
    rng = random.Random(7)
    steps = [(t, p, rng.choice(["ROOT", "SINK", "MID"]), rng.sample("abcdef", rng.randrange(3)), rng.sample("abcdef", rng.randrange(3))) for t in range(60) for p in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(steps, "trace long, pos long, role string, gives array<string>, takes array<string>")
    gaps = spark.createDataFrame([(1, "told"), (1, "told "), (2, "  "), (3, "x"), (3, "y")], "trace long, gap string")
    support = J.nearest_by_class(df, "trace")
    source = {}
    for t, p, _, _, takes in steps:
        source[t, p] = max(((q, -ord(min(set(g) & set(takes)))) for u, q, _, g, _ in steps if u == t and q < p and set(g) & set(takes)), default=None)
    assert {(r["trace"], r["pos"]): r["support"] and (r["support"], -ord(r["via"])) for r in support.where("support <> 0 OR support IS NULL").collect()} == {k: v for k, v in source.items() if v is None or v[0]}
    told = {1: 1, 3: 2}
    for r in G.assembled_traces(df, support, gaps, "ROOT", ["SINK"]).collect():
        t, p = r["trace"], r["pos"]
        at, far = p, 0
        while source[t, at]:
            at, far = source[t, at][0], far + 1
        own = [(q, role) for u, q, role, _, _ in steps if u == t]
        n = sum(source[t, q] is None for q, _ in own) - 1 + told.get(t, 0)
        roles = {role for _, role in own}
        assert (r["branch"], r["depth"], r["n_gaps"], r["complete"]) == (at, far, n, n == 0 and {"ROOT", "SINK"} <= roles)
        assert r["is_entry"] == (source[t, p] is None) and r["is_terminal"] == all(source[t, q] is None or source[t, q][0] != p for q, _ in own)


def test_a_trace_of_many_steps(spark):
    """One hot key: a look back along each class, and a chain of twenty thousand steps closed in a few rounds."""
    n = 20_000
    df = spark.range(n).selectExpr("1 AS trace", "id AS pos", "'MID' AS role", "array('x', concat('y', id % 3)) AS gives", "array('x') AS takes")
    rows = G.assembled_traces(df, J.nearest_by_class(df, "trace"), spark.createDataFrame([], "trace long, gap string"), "ROOT", ["SINK"])
    assert rows.where("depth <> pos OR branch <> 0").count() == 0 and rows.count() == n


def test_many_terms_query(spark, sf_dir):
    got = {r["doc_id"]: (r["n"], r["n_terms"]) for r in registry.QUERIES["many_terms"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    import re
    from collections import Counter

    words = Counter(w for d in docs for w in re.split(r"[^\w]+", d["text"] or "", flags=re.ASCII) if 9 <= len(w) <= 40)
    once = [w for w, c in words.items() if c == 1]
    sample = docs[::7]
    for d in sample:
        lines = (d["text"] or "").split("\n")
        hits = [(i, w) for i, x in enumerate(lines) for w in once if w in x]
        assert got.get(d["doc_id"], (0, 0)) == (len(hits), len({w for _, w in hits}))


def test_flows_of_many_requests(spark):
    rng = random.Random(8)
    edges = sorted({(i, rng.randrange(30), rng.randrange(30)) for i in range(45)})
    asks = [(r, rng.randrange(30)) for r in range(40)] + [(3, 4), (99, 1000)]
    got = G.flows(spark.createDataFrame(asks, "id long, node long"), spark.createDataFrame([(i, a, b, 100 - i) for i, a, b in edges], "edge_id long, source long, target long, ord long"), 4, 20).collect()
    for r in {i for i, _ in asks}:
        far, way = {n: 0 for i, n in asks if i == r}, {}
        for d in range(1, 5):
            for _, a, b in edges:
                for x, y in ((a, b), (b, a)):
                    if far.get(x) == d - 1 and y not in far:
                        far[y] = d
        depth = {i: min(far.get(a, 9), far.get(b, 9)) + 1 for i, a, b in edges}
        want = sorted((d, 100 - i, i) for i, d in depth.items() if d <= 4)[:20]
        mine = sorted((x["rank"], x["depth"], x["edge_id"], x["path"]) for x in got if x["id"] == r)
        assert [(d, e) for _, d, e, _ in mine] == [(d, i) for d, _, i in want]
        ends = {i: {a, b} for i, a, b in edges}
        for _, d, e, path in mine:
            assert len(path) == d and path[-1] == e and all(ends[x] & ends[y] for x, y in zip(path, path[1:])) and ends[path[0]] & {n for i, n in asks if i == r}


def test_requests_by_kind(spark):
    symbols = spark.createDataFrame([("Shop.buy", "a.js", 3), ("buy", "b.js", 1), ("Shop", "a.js", 1)], "name string, path string, start_line int")
    calls = spark.createDataFrame([("Shop.buy", "db.save"), ("main", "Shop.Buy")], "caller string, callee string")
    refs = spark.createDataFrame([("routes", "main")], "source string, target string")
    imports = spark.createDataFrame([("a.js", "fs")], "path string, module string")
    asks = [(1, "definition", "buy", "x"), (2, "callers", "buy", "x"), (3, "callers", "main", "x"), (4, "callees", "shop.buy", "x"), (5, "flow", "buy", "x"), (6, "sibling_handlers", "a.js", "x"), (7, "sibling_handlers", "handlers", "b.js"), (8, "imports", "A.js", "x"), (9, "what", "buy", "x"), (10, "callers", "uy", "x")]
    found = P.expand_requests(spark.createDataFrame(asks, "id long, kind string, target string, changed_path string"), symbols, calls, imports, 5, refs)
    got = {}
    for r in found.orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["fact"])
    assert got == {1: ["a.js:3", "b.js:1"], 2: ["main"], 3: ["routes"], 4: ["db.save"], 5: ["Shop.buy -> db.save", "main -> Shop.Buy"], 6: ["Shop.buy:3", "Shop:1"], 7: ["buy:1"], 8: ["fs"]}


def test_facts_are_cut_before_they_meet(spark):
    """Names with many facts, asked for often; requests with one id, null facts, references in place of callers: by a plain reading. No request takes all facts of its name along."""
    rng = random.Random(28)
    names = ["a", "x.a", "b", "y.b.a", "C", "c.B", " a "]
    symbols = sorted({(rng.choice(names), rng.choice(["p", "q.py", "a"]), rng.randrange(9)) for _ in range(60)})
    calls = [(rng.choice([*names, None]), rng.choice([*names, None])) for _ in range(40)] + [(f"c{i:03}", "hot") for i in range(300)]
    refs = [(f"r{rng.randrange(9)}", rng.choice(["d", "a", "z.d"])) for _ in range(30)]
    imports = [(rng.choice(["p", "P ", None, "q.py"]), rng.choice(["m", "n", "o", "k", None])) for _ in range(20)]
    kinds = ["definition", "callers", "callees", "flow", "imports", "sibling_handlers"]
    asks = [(rng.randrange(30), rng.choice(kinds), rng.choice(["a", "b", " B", "b.a", "d", "p", "q.py", "hot", "none", None]), rng.choice(["p", "a"])) for _ in range(120)] + [(100 + i, "callers", "hot", "p") for i in range(200)]
    low = lambda t: t and t.strip().lower()
    ends = lambda t: set() if t is None else {".".join(low(t).split(".")[i:]) for i in range(t.count(".") + 1)}
    link = lambda a, b: " -> ".join(x for x in (a, b) if x is not None)
    called = {i for i, kind, t, _ in asks if kind == "callers" and any(low(t) in ends(b) for _, b in calls)}
    want, flow = {}, {}
    for i, kind, t, changed in asks:
        if kind == "definition":
            got = {f"{p}:{n}" for s, p, n in symbols if low(t) in ends(s)}
        elif kind == "callers":
            got = {a for a, b in calls if low(t) in ends(b)} if i in called else {a for a, b in refs if low(t) in ends(b)}
        elif kind == "callees":
            got = {b for a, b in calls if low(t) in ends(a)}
        elif kind == "flow":
            got = {link(a, b) for a, b in calls if low(t) in ends(a) | ends(b)} - flow.get(i, set())
            flow.setdefault(i, set()).update(got)
        elif kind == "imports":
            got = {m for p, m in imports if p is not None and low(t) == low(p)}
        else:
            got = {f"{s}:{n}" for s, p, n in symbols if p == (t if t and ("/" in t or "." in t) else changed)}
        want.setdefault((i, kind), []).extend(got)
    want = sorted((i, kind, n + 1, fact or "", len(every) > 3) for (i, kind), every in want.items() for n, fact in enumerate(sorted(every, key=lambda x: (x is not None, x))[:3]))
    frame = spark.createDataFrame
    found = P.expand_requests(frame(asks, "id long, kind string, target string, changed_path string"), frame(symbols, "name string, path string, start_line int"), frame(calls, "caller string, callee string"), frame(imports, "path string, module string"), 3, frame(refs, "source string, target string"))
    assert sorted((r["id"], r["kind"], r["rank"], r["fact"] or "", r["truncated"]) for r in found.collect()) == want and len(want) > 600
    assert found._jdf.queryExecution().optimizedPlan().toString().count("WindowGroupLimit") >= 7


def test_windows_registrations_and_answers(spark):
    import hashlib

    from pyspark.sql import Observation
    from pyspark.sql.types import StructType

    from provenant.functions import redaction as D
    from provenant.operators import intervals as I

    text = "one\ntwo\npassword = 'hunter2hunter2'\nfour\n"
    h = hashlib.sha256(text.encode()).hexdigest()
    asks = [(1, "f", 3, h), (2, "f", 3, "old"), (3, "f", 3, None), (4, "g", 1, h), (5, "f", 9, h), (6, "f", 0, h), (7, "f", 4, h), (8, "long", 1, hashlib.sha256(b"x" * 50).hexdigest()), (9, "f", None, h)]
    files = spark.createDataFrame([("f", text), ("long", "x" * 50)], "path string, content string")
    got = {r["id"]: r for r in I.source_windows(spark.createDataFrame(asks, "id long, path string, line int, hash string"), files, 1, 1, 45).collect()}
    assert {i: r["state"] for i, r in got.items()} == {1: "ok", 2: "stale_source", 3: "unknown_path", 4: "unreadable", 5: "invalid_range", 6: "invalid_range", 7: "ok", 8: "over_budget", 9: "invalid_range"}
    assert "hunter2" not in got[1]["content"] and got[1]["content"].startswith("two\n") and got[1]["content"].endswith("four\n") and got[2]["content"] is None
    seen = Observation("added")
    parts = I.add_uncovered(
        spark.createDataFrame([("p", 1, 1, 20), ("p", 2, 30, 31), ("q", 3, 5, 5)], "path string, id long, start long, end long"),
        spark.createDataFrame([("p", 4, 6, "symbol"), ("p", 5, 12, "line_range"), ("p", 1, 40, "route")], "path string, start long, end long, anchor_type string"), seen)
    assert sorted((r["id"], r["start"], r["end"]) for r in parts.collect()) == [(1, 1, 3), (1, 13, 20), (2, 30, 31), (3, 5, 5)]
    assert seen.get == {"added": 4, "lines": 14}
    said = [(1, '{"n": 1, "t": "x"}'), (2, "so: ```json\n{\"n\": 2, \"t\": \"y\", \"more\": [1]}\n```"), (3, '{"n": "one", "t": "z"}'), (4, '{"t": "z"}'), (5, "nothing"), (6, None), (7, "[1, 2]")]
    answers = {r["id"]: (r["value"] and tuple(r["value"]), r["reasons"]) for r in D.structured(spark.createDataFrame(said, "id long, text string"), "text", StructType.fromDDL("n int, t string"), ["n"]).collect()}
    assert answers == {1: ((1, "x"), []), 2: ((2, "y"), []), 3: (None, ["type:n"]), 4: (None, ["missing:n"]), 5: (None, ["no_json"]), 6: (None, ["no_json"]), 7: (None, ["no_json"])}


def test_nested_values(spark):
    deep = '{"ref":"top","a":' * 1 + '[{"ref":"x"},{"b":{"ref":{"ref":"y"}}},[["z",{"ref":"x"}]],{"ref":5},{"ref":null}]' + "}"
    rows = [(1, deep), (2, "no json"), (3, None), (4, "[]"), (5, '"ref"'), (6, '{"ref":""}')]
    got = sorted(tuple(r) for r in G.nested_values(spark.createDataFrame(rows, "k long, p string"), "k", "p", "ref").collect())
    assert got == [(1, "top"), (1, "x"), (1, "y"), (6, "")]


def test_sarif_in_parts(spark, tmp_path):
    import json

    from provenant.sources import sinks as W

    rows = [(i, f"r{i % 7}", f'a "title" {i}', ["critical", "low", "odd"][i % 3], f"p{i}.py", i, i + 1, f"f{i}", [("q", 1, 2)] if i % 2 else []) for i in range(5, 400)]
    findings = spark.createDataFrame(rows, "ord long, rule_id string, title string, severity string, path string, start_line int, end_line int, fingerprint string, others array<struct<path:string,start_line:int,end_line:int>>")
    W.write_sarif(findings.repartition(5), 'my "tool"', "1", str(tmp_path / "out"))
    text = "".join(f.read_text() for f in sorted((tmp_path / "out").glob("part-*")))
    doc = json.loads(text)
    run = doc["runs"][0]
    assert [r["partialFingerprints"]["primary"] for r in run["results"]] == [f"f{i}" for i in range(5, 400)] and [r["id"] for r in run["tool"]["driver"]["rules"]] == [f"r{i % 7}" for i in range(5, 12)]
    assert run["tool"]["driver"]["name"] == 'my "tool"' and json.loads(W.sarif(findings, 'my "tool"', "1").first()[0]) == doc
    assert json.loads(W.sarif(findings.where("false"), "t", "1").first()[0])["runs"][0]["results"] == []


def test_factored_edges(spark):
    symbols = [(i, f"p{i % 4}", f"{'ab'[i % 2]}.f{i % 3}") for i in range(60)]
    calls = [(f"p{i % 4}", f"{'ab'[i % 2]}.f{i % 3}", f"x.y.f{(i * 5 + 1) % 4}") for i in range(60)]
    s, c = spark.createDataFrame(symbols, "symbol_id long, path string, name string"), spark.createDataFrame(calls, "path string, caller string, callee string")
    sources, targets = J.resolved_names(c, s)
    whole = sources.join(targets, "name").where("source_id <> target_id").select("source_id", "target_id").distinct()
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, J.resolve_edges(c, s).collect())) and whole.count() > 100
