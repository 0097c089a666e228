"""Collocations, vector packing and whitening against versions that share no code with the library, and their edge cases."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from tokenizers import Tokenizer

from provenant.llm import collocations, vectorfit, whitening

LOWER = {c: c + 32 for c in range(65, 91)}


# -- collocations -------------------------------------------------------------


def brute_collocations(rows, least, longest, top, percent):
    n, f = Counter(), {}
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    f.setdefault(lang, Counter())[tuple(words[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {g: c for g, c in counts.items() if c >= least and len(g) > 1}
        gone = {g[i : i + k] for g, c in candidates.items() for k in range(2, len(g)) for i in range(len(g) - k + 1) if 100 * c >= percent * counts[g[i : i + k]]}
        rated = []
        for g, a in candidates.items():
            if g not in gone:
                score, k = min((1000 * a * n[lang] // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g)))
                rated.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rated)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: f"{'wWéß'[rng.randrange(4)]}{min(rng.randrange(60), rng.randrange(60))}"
    texts = []
    for _ in range(n):
        texts.append("".join(word() + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", " "]) for _ in range(rng.randrange(1, 120))))
    return [(t, rng.choice(["en", "en", "fr", None, "und"])) for t in texts]


@pytest.mark.parametrize(("least", "longest", "top", "percent", "bits"), [(6, 5, 2000, 100, 1 << 16), (4, 4, 25, 80, 64), (3, 2, 10, 100, 1 << 12), (2, 7, 300, 60, 1 << 14)])
def test_collocations(spark, least, longest, top, percent, bits):
    rows = corpus(least, 150)
    rows += [("Same passage of Words, in copies; a a a a a a a", "en")] * 40 + [(None, "en"), ("", "fr"), (" \t.,;", None), ("Ab " * 3000, "de"), ("ab " * 9, "de")]
    docs = spark.createDataFrame([(t, x, i, 1.5) for i, (t, x) in enumerate(rows)], "text string, lang string, gram long, n double")
    got = collocations.collocations(docs.repartition(5), least, longest, top, percent, bits, salts=3)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute_collocations(rows, least, longest, top, percent)


def test_collocations_of_a_hot_passage(spark):
    """A third of all rows are one passage: it is one row with a multiplicity, and results are whole. DuckDB spills at the least memory it takes."""
    rows = corpus(9, 400) + [("the hot passage that all share", "en")] * 20_000
    got = collocations.collocations(spark.createDataFrame(rows, "text string, lang string"), 5, memory="32MB")
    assert sorted(tuple(r) for r in got.collect()) == brute_collocations(rows, 5, 5, 2000, 100)
    assert collocations.pieces(spark.createDataFrame(rows[400:], "text string, lang string")).collect()[0]["n"] == 20_000


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None), ("one", "en")], "text string, lang string"), 1).count() == 0


def test_score_beyond_64_bits(spark):
    a, n, left, right = 4_000_000_000_000, 900_000_000_000_000_000, 5_000_000_000_007, 4_100_000_000_009
    row = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long")
    assert row.select(collocations._exact_score(row.a, row.n, row.l, row.r)).first()[0] == 1000 * a * n // (left * right)


# -- vector best fit ----------------------------------------------------------


def brute_bins(lengths, capacity, weights, rule):
    """Piece by piece, by falling length; the earliest of equally good sequences."""
    bins = []
    for length in sorted(lengths, reverse=True):
        item = np.array([length, 1, length * length])
        room = np.array(capacity) - np.array(bins).reshape(-1, 3)
        fits = [i for i in range(len(bins)) if (room[i] >= item).all()]
        if not fits:
            bins.append(item)
            continue
        share = item / np.array(capacity)
        rate = (lambda i: (weights * (room[i] / capacity - share) ** 2).sum()) if rule == "norm" else (lambda i: -(weights * room[i] / capacity * share).sum())
        bins[min(fits, key=lambda i: (round(rate(i), 12), i))] += item
    return sorted(tuple(b.tolist()) for b in bins)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize(("capacity", "weights"), [((64, 64, 4096), (1, 0, 0)), ((64, 3, 4096), (0.5, 0.4, 0.1)), ((64, 5, 4096), (0.2, 0.2, 0.6)), ((100, 7, 10_000), (1, 1, 1))])
def test_plan(rule, capacity, weights):
    rng = random.Random(capacity[1])
    lengths = [min(rng.randrange(1, capacity[0] + 1), rng.randrange(1, capacity[0] + 1)) for _ in range(400)]
    histogram = np.bincount(lengths, minlength=capacity[0] + 1)
    slots, sequences = vectorfit.plan(histogram, capacity, np.array(weights, dtype=float), rule)
    bins, ranks = {}, Counter()
    for length, a, b, first, offset in sorted(slots):
        assert ranks[length] == a < b  # ranks of a length are used once each
        ranks[length] = b
        for i in range(b - a):
            bins.setdefault(first + i, []).append((offset, length))
    assert all(ranks[n] == c for n, c in enumerate(histogram)) and sorted(bins) == list(range(sequences))
    used = []
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        used.append((at, len(parts), sum(n * n for _, n in parts)))
        assert all(u <= c for u, c in zip(used[-1], capacity))
    if rule == "norm":
        assert sorted(used) == brute_bins(lengths, capacity, np.array(weights, dtype=float), rule)
    assert sequences <= 1.1 * len(brute_bins(lengths, capacity, np.array(weights, dtype=float), rule))


def test_plan_is_bounded():
    """A thousand million pieces: as many steps as for few, and little padding."""
    rng = np.random.default_rng(3)
    histogram = np.concatenate([[0], rng.integers(1, 2_000_000, 1024)])
    slots, sequences = vectorfit.best_plan(histogram, (1024, 1024, 1 << 20))
    tokens = int((histogram * np.arange(1025)).sum())
    assert len(slots) < 40_000 and -(-tokens // 1024) <= sequences < 1.006 * tokens / 1024
    assert sum(b - a for _, a, b, _, _ in slots) == histogram.sum()


def brute_pieces(rows, window):
    tokenizer = Tokenizer.from_file(vectorfit.default_tokenizer())
    out = Counter()
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % window if len(ids) > window and len(ids) % window else min(len(ids), window)
        cuts = [0, *range(first, len(ids), window), len(ids)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out[doc, n, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes()), len(ids)] += 1
    return out


@pytest.mark.parametrize(("window", "most"), [(1024, None), (32, 4)])
def test_vector_packing(spark, window, most):
    rng = random.Random(8)
    odd = ["don't  stop\n\n x²  ½ 日本語 — “q”     é 🙂🙂 ", "<|endoftext|> a<|endoftext|>b", "a" * 5000, " " * 300 + "x", "\x1c\x1d\x85 ﻿", "It's I'LL we've\t\tÉtat ÜBER ß ŉ ǆ"]
    rows = [(i, " ".join(rng.choice(["lorem", "Ipsum", "été", "x1", "$9.50", "\n", "don't"]) for _ in range(rng.randrange(0, 900)))) for i in range(60)]
    rows += [(i + 100, t) for i, t in enumerate(odd)] + [(7, None), (7, ""), (None, "nothing"), (None, None)] + [(5, "again and again")] * 30
    docs = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, length int, key string")
    got = vectorfit.pack(docs, vectorfit.default_tokenizer(), window, most_docs=most).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == brute_pieces(rows, window)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window and len(parts) <= (most or window)
    assert sorted(bins) == list(range(len(bins)))
    if most is None:
        assert len(bins) <= 1.02 * sum(r["length"] for r in got) / window + 1
    with pytest.raises(ValueError):
        vectorfit.pack(docs, vectorfit.default_tokenizer(), window, most_cost=window)


def test_vector_packing_of_nothing(spark):
    assert vectorfit.pack(spark.createDataFrame([], "doc_id long, text string"), vectorfit.default_tokenizer()).count() == 0


# -- whitening ----------------------------------------------------------------


def exact_fit(vectors):
    """n, sums and the covariance in fractions."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    n, dim = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(dim)]
    far = [[n * r[i] - sums[i] for i in range(dim)] for r in x]
    cov = [[Fraction(sum(r[i] * r[j] for r in far), n**3) for j in range(dim)] for i in range(dim)]
    return n, far, cov


def check_whitening(rows, vectors, components):
    n, far, cov = exact_fit([v for _, v in vectors])
    values = np.linalg.eigvalsh(np.array(cov, dtype=float))[::-1]
    trace = float(sum(cov[i][i] for i in range(len(cov))))
    want = Counter((v, sum(d * d for d in row)) for (v, _), row in zip(vectors, far))
    k = min(components, len(cov))
    assert len(rows) == len(vectors) * k
    assert Counter((r["vec_id"], r["deviation"]) for r in rows) == Counter({key: c * k for key, c in want.items()})
    assert {r["n"] for r in rows} == {n} and {r["component"] for r in rows} == set(range(1, k + 1))
    for c in range(1, k + 1):
        own = [r for r in rows if r["component"] == c]
        assert abs(own[0]["explained"] - values[c - 1] / trace) < 1e-10 * values[0] / trace
        if own[0]["whitened"] is not None:
            got = np.array([r["whitened"] for r in own])
            assert abs(got.mean()) < 1e-9 and abs((got**2).mean() - 1) < 1e-9
            # the rows' projections rebuild the component: a unit eigenvector of the exact covariance
            x = np.array([[d / n for d in dict(zip([v for v, _ in vectors], far))[r["vec_id"]]] for r in own])
            vector = x.T @ got / n / np.sqrt(values[c - 1])
            exact = np.array(cov, dtype=float)
            assert abs(vector @ vector - 1) < 1e-6
            assert np.abs(exact @ vector - values[c - 1] * vector).max() < 1e-6 * values[0]
    assert {r["identity_error"] for r in rows} and max(r["identity_error"] for r in rows) < 1e-9


def test_whitening(spark):
    rng = np.random.default_rng(1)
    usable = [(i, (rng.standard_normal(6) * [3, 1, 1, 0.5, 2, 0.2]).tolist()) for i in range(300)] + [(900, [1.0] * 6)] * 3
    junk = [(1000, None), (1001, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (1002, [float("nan")] * 6), (1003, [float("inf")] * 6), (1004, []), (1005, [1e300] * 6)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in usable + junk], "vec_id long, embedding array<double>, dim string, n int")
    check_whitening(whitening.whiten(df.repartition(7), 4).collect(), usable, 4)
    single = spark.createDataFrame(usable, "vec_id long, embedding array<float>")
    check_whitening(whitening.whiten(single, 32).collect(), [(i, np.float32(v).tolist()) for i, v in usable], 32)


def test_whitening_of_graded_and_equal_spreads(spark):
    """One direction is ten thousand million times as wide as the others, which are nearly alike; small ones keep their digits."""
    rng = np.random.default_rng(2)
    turn = np.linalg.qr(rng.standard_normal((8, 8)))[0]
    base = rng.standard_normal((200, 8)) * [1e10, 1, 1, 1, 1, 1.001, 0.5, 0.5] @ turn
    vectors = [(i, v.tolist()) for i, v in enumerate(base)]
    rows = whitening.whiten(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()
    _, _, cov = exact_fit([v for _, v in vectors])
    got = {r["component"]: r["explained"] for r in rows}
    trace = sum(cov[i][i] for i in range(8))
    # small eigenvalues from the exact inverse's powers: sums of all and of products of pairs are invariants
    det = exact_det([row[:] for row in cov])
    assert abs(float(sum(Fraction(v) for v in got.values())) - 1) < 1e-12
    log = sum(np.log(v) for v in got.values()) + 8 * np.log(float(trace))
    assert abs(log - (math.log(det.numerator) - math.log(det.denominator))) < 1e-6
    assert rows[0]["identity_error"] < 1e-6


def exact_det(a):
    out = Fraction(1)
    for i in range(len(a)):
        p = next(r for r in range(i, len(a)) if a[r][i])
        if p != i:
            a[i], a[p] = a[p], a[i]
            out = -out
        out *= a[i][i]
        for r in range(i + 1, len(a)):
            f = a[r][i] / a[i][i]
            a[r] = [x - f * y for x, y in zip(a[r], a[i])]
    return out


def test_whitening_without_spread(spark):
    rows = whitening.whiten(spark.createDataFrame([(i, [1.0, float(i), 2.0]) for i in range(5)], "vec_id long, embedding array<double>")).collect()
    assert len(rows) == 15
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in rows) and all(r["identity_error"] < 1e-12 for r in rows)
    rows = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert len(rows) == 4 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in rows)
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).count() == 0


def test_whitening_of_vectors_of_different_lengths(spark):
    rng = np.random.default_rng(4)
    short, long = [(i, rng.standard_normal(3).tolist()) for i in range(40)], [(i + 100, rng.standard_normal(5).tolist()) for i in range(60)]
    rows = whitening.whiten(spark.createDataFrame(short + long, "vec_id long, embedding array<double>")).collect()
    check_whitening([r for r in rows if r["vec_id"] < 100], short, 32)
    check_whitening([r for r in rows if r["vec_id"] >= 100], long, 32)


def test_exact_distances_beyond_a_long():
    x = np.array([[2**61, 5], [3, -(2**60)]], dtype=np.int64)
    sums = [int(x[:, 0].astype(object).sum()), int(x[:, 1].astype(object).sum())]
    far = whitening.distances(x, 2, sums)
    assert [[int(v) for v in r] for r in far] == [[2 * int(a) - s for a, s in zip(r, sums)] for r in x.tolist()]
    assert whitening.squares(far) == [None, None]
    high, low = whitening.centred(far, 2)
    assert all(Fraction(h) + Fraction(w) == Fraction(int(v), 2) for h, w, v in zip(high.ravel(), low.ravel(), far.ravel()))


def test_double_double_products():
    rng = np.random.default_rng(5)
    a = rng.standard_normal((30, 4)) * np.exp2(rng.integers(-40, 40, (30, 4)))
    low = a * 1e-17 * rng.standard_normal((30, 4))
    high, low = whitening.two_sum(a, low)
    got = whitening.outer((high, low))
    for i in range(4):
        for j in range(4):
            want = sum((Fraction(high[k, i]) + Fraction(low[k, i])) * (Fraction(high[k, j]) + Fraction(low[k, j])) for k in range(30))
            scale = Fraction(float(np.abs(high[:, i]).max() * np.abs(high[:, j]).max()))
            assert abs(Fraction(got[0][i, j]) + Fraction(got[1][i, j]) - want) < scale / 2**90
