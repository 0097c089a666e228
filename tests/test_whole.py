"""What queries must not leave out."""

from __future__ import annotations

from provenant.operators import joins as J
from provenant.plans import registry


def test_edge_totals(spark):
    symbols = spark.createDataFrame([(i, f"p{i % 3}", f"m{i}.f{i % 2}") for i in range(40)], "symbol_id long, path string, name string")
    calls = spark.createDataFrame([(f"p{i % 3}", f"m{i}.f{i % 2}", c) for i in range(10) for c in ("x.f0", "y.f0", "f1", "none")], "path string, caller string, callee string")
    want = {}
    for s, t in J.resolve_edges(calls, symbols).collect():
        want.setdefault(s, []).append(t)
    assert {r[0]: (r[1], r[2]) for r in J.resolve_edge_totals(calls, symbols).collect()} == {s: (len(t), sum(t)) for s, t in want.items()}


def test_greedy_match_takes_all_orders(spark, sf_dir):
    got = registry.QUERIES["greedy_match"](spark, sf_dir)
    assert got.select("expectation").distinct().count() == spark.read.parquet(f"{sf_dir}/orders.parquet").count()


def test_documents_of_all_languages_and_lengths(spark, sf_dir):
    ids = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    assert registry.QUERIES["greedy_cluster"](spark, sf_dir).count() == ids.count()


def test_no_query_cuts_its_tables():
    """Modulo filters split a table in two sides of an operator; none may drop rows from both, and no query reads some lines or languages only."""
    for name in ("edge_resolution", "reverse_reach", "fanout_capped", "neighbourhood", "components", "alias_join", "subtract_ranges", "typed_lookup", "jaccard_pairs", "redact", "tokens_stemmed", "exact_dedupe", "overlay_lookup", "stale_dependencies", "dispositions"):
        sql = registry.ORACLES[name]
        assert "lang =" not in sql and "l_linenumber = 1 and" not in sql and "where l_linenumber" not in sql and "% 50" not in sql and "n_chars <" not in sql
    assert not any(name.endswith("_whole") for name in registry.QUERIES)
