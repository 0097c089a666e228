"""Passes in order, done by rounds: against the pass itself, with one hot place, long chains and full contention; and trees at revisions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from provenant.operators import graphs as G
from provenant.operators import joins as J
from provenant.operators import overlay as V
from provenant.operators import resolution as R
from provenant.operators import snapshots as S
from provenant.plans import registry


def heads_in_order(n, earlier):
    """earlier: row -> matching earlier rows."""
    heads = set()
    for i in range(n):
        if not heads & earlier.get(i, set()):
            heads.add(i)
    return heads


@pytest.mark.parametrize(("n", "links", "rounds"), [(4000, "random", 8), (3000, "chain", 3), (500, "all", 8), (2000, "random", 1)])
def test_heads_by_rounds(spark, n, links, rounds):
    rng = random.Random(n)
    earlier: dict[int, set] = {}
    for i in range(1, n):
        if links == "chain":
            earlier[i] = {i - 1} | ({i - 2} if i % 7 == 3 else set())
        elif links == "all":
            earlier[i] = set(range(i))
        else:
            earlier[i] = {rng.randrange(i) for _ in range(rng.randrange(4))}
    names = list(range(n))
    rng.shuffle(names)  # ids say nothing about the order
    edges = spark.createDataFrame([("hot", names[a], names[b]) for b, found in earlier.items() for a in found], "p string, early long, late long")
    order = spark.createDataFrame([("hot", names[i], i) for i in range(n)], "p string, id long, o long")
    got = {r["node"] for r in R.covered_rows(edges, order, rounds).collect()}
    assert got == {names[i] for i in range(n)} - {names[i] for i in heads_in_order(n, earlier)}


@pytest.mark.parametrize(("size", "width", "rounds"), [(300, 4, 8), (60, 60, 3), (200, 2, 1)])
def test_claims_by_rounds(spark, size, width, rounds):
    rng = random.Random(size)
    pairs = {(c, i, p) for c in ("hot", "cold") for i in range(size if c == "hot" else 5) for p in (rng.sample(range(size), width))}
    rows = [(c, i * 3 % 101, i, p, p * 7 % 89) for c, i, p in pairs]
    got = sorted(tuple(r) for r in J.claim_once(spark.createDataFrame(rows, "codebase string, ord long, id long, prior long, prior_ord long"), rounds).collect())
    used, want, done = set(), [], set()
    for c, _, i, _, p in sorted((c, o, i, q, p) for c, o, i, p, q in rows):
        if (c, i) not in done and (c, p) not in used:
            done.add((c, i))
            used.add((c, p))
            want.append((c, i, p))
    assert got == sorted(want)


def test_one_path_with_all_rows(spark):
    rows = [("one", i, i, 0.5, "", "", ["a"], ["w"], 3 * i, 3 * i + 1) for i in range(1500)]
    kind = "path string, id long, ord long, confidence double, structural_key string, semantic_key string, classes array<string>, words array<string>, start_line long, end_line long"
    got = {r["id"]: r["cluster"] for r in R.admit(spark.createDataFrame(rows, kind)).collect()}
    heads = []
    for i in range(1500):
        near = [h for h in heads if 3 * (i - h) <= 6]
        assert got[i] == (near[0] if near else i)
        heads += [] if near else [i]


def test_crowded_place_meets_heads(spark, monkeypatch):
    """A place where nearly all rows match: its pairs are not formed, only those of its first rows and of heads."""
    edges, inner = [], R.covered_rows
    monkeypatch.setattr(R, "covered_rows", lambda e, *rest: (edges.append(e.count()), inner(e, *rest))[1])
    n, rng = 6000, random.Random(3)
    at, words = [rng.randrange(40) for _ in range(n)], [rng.sample(range(12), 5) for _ in range(n)]
    rows = [("one" if i % 60 else "small", i, i, 0.5, "", "", [], [f"w{w}" for w in words[i]], at[i], at[i] + 9) for i in range(n)]
    kind = "path string, id long, ord long, confidence double, structural_key string, semantic_key string, classes array<string>, words array<string>, start_line long, end_line long"
    got = {(r["path"], r["id"]): r["cluster"] for r in R.admit(spark.createDataFrame(rows, kind)).collect()}
    heads, want = {"one": [], "small": []}, {}
    for path, i, *_ in rows:
        shared = {h: len(set(words[h]) & set(words[i])) for h in heads[path]}
        near = [h for h in heads[path] if (abs(at[h] - at[i]) <= 6 and shared[h] > 0) or (abs(at[h] - at[i]) <= 9 and shared[h] > 1)]
        want[path, i] = near[0] if near else i
        heads[path] += [] if near else [i]
    assert got == want
    assert sum(edges) < n


def test_trees(spark):
    rng = random.Random(4)
    parents = [(0, None)] + [(i, rng.randrange(max(0, i - 3), i)) for i in range(1, 120)]
    up = dict(parents)
    changes = [(i, f"f{rng.randrange(9)}", None if rng.random() < 0.3 else f"text {i} {'x' * rng.randrange(9)}") for i in range(120) for _ in range(2)]
    wanted = [119, 60, 7, 0, 500]
    df = lambda rows, kind: spark.createDataFrame(rows, kind)
    args = df([(w,) for w in wanted], "revision long"), df(parents, "revision long, parent long"), df(changes, "revision long, path string, content string")
    got = sorted((r["revision"], r["path"], r["content"], r["since"]) for r in S.tree_at(*args).collect())
    want = []
    for w in wanted:
        seen, at = {}, w if w in up else None
        while at is not None:
            for path in {p for r, p, _ in changes if r == at} - set(seen):
                seen[path] = (max((c for r, p, c in changes if (r, p) == (at, path) and c is not None), default=None), at)
            at = up[at]
        want += [(w, p, c, r) for p, (c, r) in seen.items() if c is not None]
    assert got == sorted(want)
    far = G.ancestors(args[1], args[0].where("revision = 119")).agg(F.max("distance"), F.count("ancestor")).first()
    assert far[1] == far[0] + 1
    with pytest.raises(ValueError):
        G.ancestors(df([(1, 2), (2, 3), (3, 1)], "revision long, parent long"), df([(1,)], "revision long")).collect()


def test_layer_depths(spark):
    parents = spark.createDataFrame([(f"s{i}", f"s{i - 1}" if i else None) for i in range(40)] + [("t", "s3")], "snapshot_id string, parent_id string")
    assert sorted((r["depth"], r["snapshot_id"]) for r in V.layer_depths(parents, "s39").collect()) == [(i, f"s{i}") for i in range(40)]


def test_no_query_is_empty_at_the_least_size(spark, sf_dir):
    for name in ("deleted_keys", "source_blobs", "revision_trees", "claimed_priors"):
        assert not registry.QUERIES[name](spark, sf_dir).isEmpty()
