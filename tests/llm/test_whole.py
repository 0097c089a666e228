"""What an operator or stage must not leave out."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from provenant.llm import lines, mixing, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, size=4000):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def test_simhash_stage_keeps_documents_without_an_id_of_their_own(spark, sf_dir):
    rng = random.Random(11)
    texts = [words(rng, 80) for _ in range(6)]
    ids = [None, None, None, 5, 5, 1]
    rows = [(d, t, "en", "s", len(t)) for d, t in zip(ids, texts)]
    copies = [(None, texts[5], "en", "s", len(texts[5])), (9, texts[0], "en", "s", len(texts[0])), rows[1]]
    kept = corpus_pipeline.simhash_stage(spark, spark.createDataFrame([*rows, *copies], DOCS), sf_dir).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted(zip([9, None, None, 5, 5, 1], texts), key=str)
    assert len({simhash.fingerprint(t.encode()) for t in texts}) == 6


def test_each_use_has_a_position(spark, sf_dir):
    rows = [(i, words(random.Random(i), 20), "en", "big" if i < 60 else "small", 0) for i in range(75)]
    docs = spark.createDataFrame(rows, DOCS)
    mixed = {r["doc_id"]: r for r in mixing.mix(docs.select("doc_id", "source", mixing.n_words().alias("size"))).collect()}
    small = [r for i, r in mixed.items() if i >= 60]
    assert all(r["taken"] == 60 for r in small)
    assert all(len(r["positions"]) == -(-r["taken"] // r["size"]) for r in mixed.values())
    assert all(r["positions"][:1] == [r["position"]] for r in mixed.values() if r["taken"])
    # Weight 2: the demand rises from 0.5 to 1.5, whose integral is (t + t * t) / 2; position is its inverse at each use's share.
    got = np.sort([p for r in small for p in r["positions"]])
    assert np.abs((got + got * got) / 2 - np.arange(45) / 45).max() < 1e-9
    out = corpus_pipeline.mixing_stage(spark, docs, sf_dir).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()).orderBy("_p", "_i").collect()
    got = [r["doc_id"] for r in out]
    want = sorted((p, i) for i, r in mixed.items() for p in r["positions"])
    assert got == [i for _, i in want]


def test_scheduled_by_position(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", i % 40) for i in range(500)], "doc_id long, source string, size long")
    got = [(r["taken"] <= 0, r["position"]) for r in mixing.schedule(mixing.mix(docs)).collect()]
    assert len(got) == 500 and got == sorted(got)


def test_passages_go_whole(spark):
    rng = random.Random(12)
    rows, n = [], 0
    for size in (2, 3, 5, 8, 12, 20):
        for _ in range(10):
            shared = [words(rng, 6) for _ in range(size)]
            for _ in range(2):
                rows.append((n, "\n".join([*(words(rng, 6) for _ in range(rng.randrange(1, 5))), *shared, *(words(rng, 6) for _ in range(rng.randrange(1, 5)))]), size))
                n += 1
    rows += [(n, "one\n\n\n\ntwo\nown a", 0), (n + 1, "one\n\n\n\ntwo\nown b", 0), (n + 2, None, 0), (n + 3, "\n\n", 0), (n + 4, "\n\n", 0)]
    got = {r["doc_id"]: r for r in lines.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, size int")).collect()}
    for i, _, size in rows[:n]:
        assert got[i]["n_lines_removed"] == (size if i % 2 else 0)
    assert (got[n]["n_lines_removed"], got[n + 1]["text"], got[n + 2]["text"], got[n + 4]["text"]) == (0, "own b", None, "\n\n")


def test_no_chunk_of_one_line():
    rng = random.Random(3)
    for n in (1, 2, 3, 50, 400):
        found = lines.spans([words(rng, rng.randrange(7)) for _ in range(n)])
        assert all(lines.LEAST_LINES <= b - a and b <= n for a, b in found) and (n < 2 or found[0][0] == 0)


def test_passages_hold_a_chunk():
    """Recall by length: whether two documents that share a passage of short lines share a chunk of it."""
    rng = random.Random(4)
    least = {2: 0.5, 3: 0.8, 4: 0.93, 5: 0.97, 8: 0.99, 20: 1.0}
    for size, share in least.items():
        hits = 0
        for _ in range(400):
            passage = [words(rng, 2, 10**6) for _ in range(size)]
            both = [[*(words(rng, 2, 10**6) for _ in range(3)), *passage, *(words(rng, 2, 10**6) for _ in range(3))] for _ in range(2)]
            one, two = ({tuple(found[a:b]) for a, b in lines.spans(found)} for found in both)
            hits += bool(one & two)
        assert hits >= share * 400, (size, hits)
