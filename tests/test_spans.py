"""The tree of line blocks against plain comparison."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from provenant.operators import intervals as I
from provenant.operators import joins as J
from provenant.operators import spans as S


def test_blocks_are_a_disjoint_cover(spark):
    rng = random.Random(1)
    rows = [(a, a + rng.choice([0, 1, 5, 63, 64, 700, 9000])) for a in (rng.randrange(2000) for _ in range(300))] + [(5, 4), (0, 0), (0, 511), (1, 512), (0, S.FARTHEST - 1), (7, 1 << 60), (-5, 3)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "id long, a long, b long")
    found = {}
    for r in S.covered(df, F.col("a"), F.col("b")).collect():
        width = 1 << S.BITS * r["_lv"]
        found.setdefault(r["id"], []).append((r["_bl"] * width, (r["_bl"] + 1) * width - 1))
    for i, (a, b) in enumerate(rows):
        parts = sorted(found.get(i, []))
        first, last = max(0, a), min(b, S.FARTHEST - 1)
        assert (not parts) == (a > b)
        if parts:
            assert parts[0][0] == first and parts[-1][1] == last and all(x[1] + 1 == y[0] for x, y in zip(parts, parts[1:]))
            assert len(parts) <= 6 * (S.TOP + 1)


def test_any_length(spark):
    """One span over 2^31 lines and many open-ended ones on one hot key; the narrowest wins, ties by order."""
    rng = random.Random(2)
    spans = [("f", i, s, s + rng.randrange(0, 40), i) for i, s in enumerate(rng.randrange(1, 5000) for _ in range(500))]
    spans += [("f", 900, 10, 10 + 2**31, 900)] + [("f", 1000 + i, rng.randrange(1, 10**6), rng.choice([0, -1]), 5000 - i) for i in range(100_000)]
    points = [(i, "f", rng.randrange(1, 6000)) for i in range(3000)] + [(5000, "f", 2**33), (5001, "g", 4), (5002, "f", 0)]
    s = spark.createDataFrame(spans, "path string, span_id long, start_line long, end_line long, ord long")
    p = spark.createDataFrame(points, "id long, path string, line long")
    starts = sorted((a, o, i) for _, i, a, e, o in spans if e <= 0)
    for narrowest in (True, False):
        got = {r["id"]: r["span_id"] for r in J.enclosing_span(p, s, ["path"], narrowest).collect()}
        assert len(got) == len(points)
        for i, path, line in points[::23] + points[-3:]:
            inside = [(max(1, e - a) if narrowest else 0, o, x) for f, x, a, e, o in spans if f == path and e > 0 and a <= line <= e]
            inside += [((1 << 42) if narrowest else 0, o, x) for a, o, x in starts if path == "f" and a <= line]
            assert got[i] == (min(inside)[2] if inside else None)


def test_overlaps(spark):
    rng = random.Random(3)

    def some(n, first):
        return [(rng.choice("ab"), first + i, s, s + rng.choice([0, 3, 50, 4000, 2**31])) for i, s in enumerate(rng.randrange(0, 3000) for _ in range(n))]

    left, right = some(150, 0) + [("a", 500, 9, 3)], some(150, 1000) + [("c", 2000, 1, 5)]
    frame = lambda x: spark.createDataFrame(x, "key string, id long, start long, end long")
    got = sorted(tuple(r) for r in J.overlapping(frame(left), frame(right), "key").collect())
    assert got == sorted((k, i, j) for k, i, a, b in left for q, j, c, d in right if k == q and a <= b and c <= d and a <= d and c <= b)


def test_covering(spark):
    segments = [("k", 1, 10, 19), ("k", 2, 100, 100), ("j", 3, 1, 9)]
    regions = [("k", "wide", 9, 0, 2**31), ("k", "half", 2, 15, 30), ("k", "less", 1, 16, 30)]
    got = I.first_covering(
        spark.createDataFrame(segments, "key string, id long, start long, end long"), spark.createDataFrame(regions, "key string, region string, ord long, start long, end long"), "key", 0.5)
    assert {r["id"]: r["region"] for r in got.collect()} == {1: "half", 2: "wide", 3: None}
