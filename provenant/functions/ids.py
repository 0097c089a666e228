"""Content-addressed identities: SHA-256 prefixes over explicit concatenations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def joined(parts: list[Column], separator: str = ":") -> Column:
    """Parts joined by a separator; null parts count as empty, so that no part shifts another's place."""
    return F.concat_ws(separator, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def short_hash(parts: list[Column], digits: int = 16) -> Column:
    return F.left(F.sha2(joined(parts), 256), F.lit(digits))


def stable_id(prefix: str, parts: list[Column]) -> Column:
    return F.concat(F.lit(f"{prefix}-"), short_hash(parts, 32))


def tree_hash(files: DataFrame, key: str = "snapshot_id") -> DataFrame:
    """``files(key, path, content_hash)`` -> ``key, tree_hash``: a hash over path and content hash pairs, ordered by path.

    One array for each snapshot; its size is that of the snapshot's file list.
    """
    pairs = F.array_sort(F.collect_list(F.struct("path", "content_hash")))
    text = F.array_join(F.transform(pairs, lambda p: F.concat(p["path"], F.lit("\0"), p["content_hash"], F.lit("\0"))), "")
    return files.groupBy(key).agg(F.sha2(text, 256).alias("tree_hash"))


def stable_keys(symbols: DataFrame) -> DataFrame:
    """``symbols(path, kind, name, signature, start_line, ord)`` -> adds ``stable_key, symbol_id``.

    ``path:kind:name``; only where (kind, name) repeats in the file, a signature hash and the 0-based occurrence of that
    signature follow. An identity never holds a content hash.
    """
    same = Window.partitionBy("path", "kind", "name")
    twin = Window.partitionBy("path", "kind", "name", "_sig").orderBy("start_line", "ord")
    base = symbols.withColumn("_sig", F.left(F.sha2(F.coalesce("signature", F.lit("")), 256), F.lit(16)))
    plain = joined([F.col("path"), F.col("kind"), F.col("name")])
    full = F.concat_ws(":", plain, F.col("_sig"), (F.row_number().over(twin) - 1).cast("string"))
    keyed = base.withColumn("stable_key", F.when(F.count(F.lit(1)).over(same) > 1, full).otherwise(plain))
    return keyed.withColumn("symbol_id", F.concat(F.lit("sym-"), F.left(F.sha2("stable_key", 256), F.lit(16)))).drop("_sig")


def canonical_json(value: Column) -> Column:
    """JSON with nulls kept; the caller's struct must have its fields in alphabetical order, which makes the text canonical."""
    return F.to_json(value, {"ignoreNullFields": "false"})
