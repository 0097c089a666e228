"""Embedding near-duplicates by randomised-rotation codes with stored correction factors.

A unit vector o is rotated by one seeded random rotation and its coordinates are rounded to 8 bits. The top bit of each is its sign;
the code vector c of these bits has entries +-1/sqrt(D). Beside the code stands the correction factor a = <o, c>. For a rotated
query q, <c, q> / a is an unbiased estimate of <o, q> over rotations. With c = a o + r, r across o and |r| = sqrt(1 - a^2),

    <c, q> = a <o, q> + <r, q>,    |<r, q>| <= sqrt(1 - a^2) * s,

where s bounds the part of q across o: s = sqrt(1 - t^2) holds for every pair that reaches the threshold t, so a pair whose <c, q> lies
below a t - sqrt(1 - a^2) s is none. <c, q> itself comes from population counts: the query's three top bit planes and'ed with the code,
less the norm of what those bits leave out. Pairs that pass get the estimate of all 8 bits, whose error the stored rounding
errors bound: above the threshold by more than that, they are linked; below, they are not. Only pairs in between are recomputed
from the vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import drop_path, signed, small_batches, stored
from provenant.llm.components import connected_components, merge_labels

THRESHOLD, ROTATION_SEED = 0.93, 20_240_229
#: Rows of a chunk; a task compares one pair of chunks.
CHUNK_ROWS = 65_536
#: Codes and queries compared in one sweep, and share of pairs to look into from which they are multiplied as a block.
CODE_ROWS, QUERY_ROWS, DENSE = 256, 2_048, 0.02
#: Pairs looked into at once where they are few.
SOME_PAIRS = 1 << 15
#: Bits of a query that the first look uses, and allowance for rounding in double precision.
TOP_BITS, SLACK = 3, 1e-9

ENCODED = "vec_id long, label string, dim int, da long, db long, facts binary, raw binary"
FOUND = "label string, dim int, tile long, da long, db long, vec_id long, root long, links long, open boolean"


def rotation(dim: int, seed: int = ROTATION_SEED) -> np.ndarray:
    """The same random rotation (QR of a Gaussian matrix, signs fixed) on every machine."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


class Codes:
    """Rows of 8-bit coordinates with their factors, steps and rounding errors, and what the comparison needs of them."""

    def __init__(self, levels: np.ndarray, factor: np.ndarray, step: np.ndarray, error: np.ndarray) -> None:
        self.levels, self.factor, self.step, self.error = levels, factor, step, error

    def __len__(self) -> int:
        return len(self.levels)

    def take(self, rows: np.ndarray) -> Codes:
        return Codes(self.levels[rows], self.factor[rows], self.step[rows], self.error[rows])

    def values(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The rounded coordinates."""
        return (self.levels[rows] - 127.5) * self.step[rows, None]

    def plane(self, bit: int) -> np.ndarray:
        """One bit of every coordinate, 64 coordinates to a word: words by rows."""
        packed = np.packbits(self.levels >> bit & 1, axis=1, bitorder="little")
        padded = np.zeros((len(packed), -(-packed.shape[1] // 8) * 8), dtype=np.uint8)
        padded[:, : packed.shape[1]] = packed
        return np.ascontiguousarray(padded.view(np.uint64).T)


def encode(units: np.ndarray, turn: np.ndarray) -> Codes:
    """Unit vectors -> codes of their rotations."""
    turned = units @ turn.T
    step = np.abs(turned).max(axis=1) / 127.5
    levels = np.clip(np.floor(turned / step[:, None] + 128), 0, 255).astype(np.uint8)
    found = Codes(levels, np.zeros(len(units)), step, np.zeros(len(units)))
    found.error = np.sqrt(((turned - found.values()) ** 2).sum(axis=1))
    found.factor = (turned * np.where(levels >= 128, 1.0, -1.0)).sum(axis=1) / np.sqrt(units.shape[1])
    return found


def may_link(codes: Codes, queries: Codes, threshold: float, spread: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of codes and of queries in ascending order of blocks: those that the population counts do not rule out.

    A block's codes are sorted by factor, so that one bound, that of its smallest, serves the block.
    """
    dim = codes.levels.shape[1]
    shift = 8 - TOP_BITS
    top = queries.levels >> shift
    half = (2**TOP_BITS - 1) / 2
    rough = (2**shift * queries.step)[:, None] * (top - half)
    missed = queries.error + np.sqrt(((queries.values() - rough) ** 2).sum(axis=1))
    # <c, q> sqrt(D) / step = 2 S - (2 half) P - sum(top) + half D, with S = <bits of c, top> and P = bits of c
    offset = top.sum(axis=1) - half * dim
    scale = np.sqrt(dim) / (2**shift * queries.step)
    order = np.argsort(codes.factor, kind="stable")
    words = codes.plane(7)[:, order]
    ones = np.bitwise_count(words).sum(axis=0, dtype=np.int32)
    least = codes.factor[order] * threshold - np.sqrt(np.maximum(0.0, 1 - codes.factor[order] ** 2)) * spread
    planes = [queries.plane(7 - k) for k in range(TOP_BITS)]
    for a in range(0, len(codes), CODE_ROWS):
        rows = slice(a, a + CODE_ROWS)
        lowest = least[rows].min()
        for b in range(0, len(queries), QUERY_ROWS):
            cols = slice(b, b + QUERY_ROWS)
            total = np.zeros((len(words[0][rows]), len(queries.step[cols])), dtype=np.int32)
            for k, plane in enumerate(planes):
                for w in range(len(words)):
                    total += np.bitwise_count(words[w][rows, None] & plane[w][None, cols]).astype(np.int32) << (TOP_BITS - 1 - k)
            bound = np.floor(scale[cols] * (lowest - missed[cols]) + offset[cols] - SLACK * dim)
            hit = 2 * total - (2**TOP_BITS - 1) * ones[rows, None] >= bound[None]
            x, y = np.nonzero(hit)
            yield order[a + x], b + y


def decided(left: Codes, right: Codes, threshold: float, spread: float, inside: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows (left, right) of the pairs that are linked for certain or open, and which of them are open.

    ``inside``: both are the same rows; each pair once, no row with itself.
    """
    long_left, long_right = (np.sqrt((c.values() ** 2).sum(axis=1)) for c in (left, right))
    for x, y in may_link(left, right, threshold, spread):
        if inside:
            keep = x > y
            x, y = x[keep], y[keep]
        if not len(x):
            continue
        rows, cols = np.unique(x), np.unique(y)
        if len(x) >= DENSE * len(rows) * len(cols):
            product = left.values(rows) @ right.values(cols).T
            estimate = product[np.searchsorted(rows, x), np.searchsorted(cols, y)]
        else:
            parts = [slice(i, i + SOME_PAIRS) for i in range(0, len(x), SOME_PAIRS)]
            estimate = np.concatenate([np.einsum("ij,ij->i", left.values(x[p]), right.values(y[p])) for p in parts])
        error = left.error[x] * long_right[y] + right.error[y] * long_left[x] + left.error[x] * right.error[y] + SLACK
        some = estimate + error >= threshold
        yield x[some], y[some], (estimate - error < threshold)[some]


def _digest(label: str, unit: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(unit.tobytes() + label.encode())
    return signed(d >> 64), signed(d & (1 << 64) - 1)


def _units(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors scaled to length one, and which of them can be."""
    with np.errstate(all="ignore"):
        scale = np.abs(rows).max(axis=1, keepdims=True)
        scaled = rows / scale
        units = scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
    return units, np.isfinite(rows).all(axis=1) & (scale[:, 0] > 0) & np.isfinite(units).all(axis=1)


def _encode_batches(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    turns: dict[int, np.ndarray] = {}
    names = [x.split()[0] for x in ENCODED.split(", ")]
    for batch in batches:
        vectors, labels = batch.column("embedding"), batch.column("label").to_pylist()
        n = batch.num_rows
        lengths = np.array([x or 0 for x in pc.list_value_length(vectors).to_pylist()], dtype=np.int64)
        usable = np.array([x is not None for x in labels], dtype=bool) & np.array(batch.column("vec_id").is_valid())
        rest: list[list] = [[None] * n for _ in range(5)]
        for dim in {int(x) for x in np.unique(lengths)} - {0}:
            at = np.flatnonzero((lengths == dim) & usable)
            if not len(at):
                continue
            flat = vectors.take(pa.array(at)).flatten()
            raw = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(at), dim)
            units, fine = _units(raw.astype(np.float64))
            at, raw, units = at[fine], raw[fine], units[fine]
            if not len(at):
                continue
            if dim not in turns:
                turns[dim] = rotation(dim, seed)
            codes = encode(units, turns[dim])
            numbers = np.stack([codes.factor, codes.step, codes.error], axis=1)
            for i, row in enumerate(at.tolist()):
                da, db = _digest(labels[row], units[i])
                for column, value in zip(rest, (dim, da, db, numbers[i].tobytes() + codes.levels[i].tobytes(), raw[i].tobytes())):
                    column[row] = value
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("label"), *(pa.array(c, type=k) for c, k in zip(rest, kinds))], names=names
        )


def _codes(facts: list[bytes], dim: int) -> Codes:
    size = 24 + dim
    joined = np.frombuffer(b"".join(facts), dtype=np.uint8).reshape(len(facts), size)
    numbers = np.ascontiguousarray(joined[:, :24]).view(np.float64)
    return Codes(joined[:, 24:], numbers[:, 0], numbers[:, 1], numbers[:, 2])


def _by_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each tile, from batches sorted by (label, dim, tile)."""
    held, rows = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(batch.column(n).to_pylist() for n in ("label", "dim", "tile"))))
        start = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and keys[i] == keys[start]:
                continue
            if held is not None and keys[start] != held:
                yield pa.Table.from_batches(rows)
                rows = []
            held = keys[start]
            rows.append(batch.slice(start, i - start))
            start = i
    if rows:
        yield pa.Table.from_batches(rows)


def _compare_batches(batches: Iterator[pa.RecordBatch], threshold: float, epsilon: float | None, single: bool, exact: bool) -> Iterator[pa.RecordBatch]:
    """Rows of tiles -> for each row with links or open pairs in its tile: links, a row that it is joined with, whether pairs are open.

    ``exact``: the tiles hold the rows with open pairs and their vectors; only open pairs count, and are decided.
    """
    names = [x.split()[0] for x in FOUND.split(", ")]
    for table in _by_tile(batches):
        table = table.combine_chunks()
        label, dim, tile = (table.column(n)[0].as_py() for n in ("label", "dim", "tile"))
        i, j = tile >> 32, tile & (1 << 32) - 1
        codes = _codes(table.column("facts").to_pylist(), dim)
        ids, mult = table.column("vec_id").to_numpy(), table.column("mult").to_numpy()
        chunk = table.column("chunk").to_numpy()
        if exact:
            raw = np.frombuffer(b"".join(table.column("raw").to_pylist()), dtype=np.float32 if single else np.float64).reshape(-1, dim)
            units, _ = _units(raw.astype(np.float64))
        p, q = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
        s = np.sqrt(1 - threshold * threshold) if epsilon is None else epsilon / np.sqrt(max(1, dim - 1))
        links, open_, group = np.zeros(len(ids)), np.zeros(len(ids), dtype=bool), np.arange(len(ids))
        for x, y, between in decided(codes.take(p), codes.take(q), threshold, s, i == j):
            x, y = p[x], q[y]
            if exact:
                x, y = x[between], y[between]
                parts = [slice(k, k + SOME_PAIRS) for k in range(0, len(x), SOME_PAIRS)]
                sure = np.concatenate([np.einsum("ij,ij->i", units[x[k]], units[y[k]]) >= threshold for k in parts]) if parts else np.zeros(0, dtype=bool)
            else:
                open_[x[between]] = open_[y[between]] = True
                sure = ~between
            x, y = x[sure], y[sure]
            links += np.bincount(x, weights=mult[y], minlength=len(ids)) + np.bincount(y, weights=mult[x], minlength=len(ids))
            merge_labels(group, x, y)
        out = np.flatnonzero((links > 0) | open_)
        n = len(out)
        yield pa.RecordBatch.from_arrays(
            [pa.array([label] * n, type=pa.string()), pa.array(np.full(n, dim, dtype=np.int32)), pa.array(np.full(n, tile, dtype=np.int64)),
             pa.array(table.column("da").to_numpy()[out]), pa.array(table.column("db").to_numpy()[out]), pa.array(ids[out]),
             pa.array(ids[group[out]]), pa.array(links[out].astype(np.int64)), pa.array(open_[out])], names=names
        )


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, epsilon: float | None = None, chunk_rows: int = CHUNK_ROWS, seed: int = ROTATION_SEED
) -> DataFrame:
    """``vectors(vec_id, embedding, label)`` -> ``vec_id, n_links, component_id, kept``, one row for each row.

    Two vectors are compared only if their labels are equal and not null and their lengths are equal; vectors that are null,
    empty, zero or hold null or non-finite components link with nothing. ``epsilon``: confidence of the first bound; None: certain.
    Vectors of one direction (equal 128-bit digest of label and unit vector) are compared once and count as often as they occur.
    A label's distinct vectors are split by a hash into chunks of about ``chunk_rows``; each pair of chunks is one tile, so a
    label with a third of all rows is spread over many tasks of two chunks each. Codes travel, 88 bytes for 64 dimensions, once for each chunk of the
    label; vectors only for rows with a pair that the codes leave open, and only to the tiles where it lies. Pairs are counted in
    the task and never emitted. The number of comparisons grows with the square of a label's rows: the bound of a pair at 0.93
    in so many dimensions allows no exact partitioning.
    Rows with equal vec_id are one vertex in components; each still counts as a vector in links. Null vec_id: links with nothing.
    An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    base = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"),
    )
    encoded, encoded_path = stored(base.mapInArrow(lambda b: _encode_batches(b, seed), ENCODED), "codes")
    facts = encoded.where("da IS NOT NULL").groupBy("label", "dim", "da", "db").agg(
        F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("mult"), F.min("facts").alias("facts")
    )
    distinct, distinct_path = stored(facts, "distinct")
    sizes = distinct.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("chunks"))
    dealt = distinct.join(sizes, ["label", "dim"]).withColumn("chunk", F.pmod(F.xxhash64("da", F.lit(3)), F.col("chunks")))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("_o")
    place = (F.shiftleft(F.least("chunk", "_o").cast("long"), 32) + F.greatest("chunk", "_o")).alias("tile")
    tiles = dealt.select("*", other).select("label", "dim", place, "da", "db", "vec_id", "mult", "facts", F.col("chunk").cast("long").alias("chunk"))
    by = ["label", "dim", "tile"]
    found, found_path = stored(
        tiles.repartition(*by).sortWithinPartitions(*by).mapInArrow(lambda b: _compare_batches(b, threshold, epsilon, single, False), FOUND), "links"
    )
    every, scratch = found, [encoded_path, distinct_path, found_path]
    wanted = found.where("open")
    if not wanted.isEmpty():
        need = wanted.select("label", "dim", "tile", F.col("da").alias("_a"), F.col("db").alias("_b"), F.col("vec_id").alias("_v"))
        source = encoded.select("vec_id", "da", "db", "raw").join(need, (F.col("da") == F.col("_a")) & (F.col("db") == F.col("_b")) & (F.col("vec_id") == F.col("_v")))
        once = source.dropDuplicates(["tile", "da", "db"]).select("label", "dim", "tile", "da", "db", "raw")
        again = once.join(tiles.drop("label", "dim"), ["tile", "da", "db"])
        settled, path = stored(
            again.repartition(*by).sortWithinPartitions(*by).mapInArrow(lambda b: _compare_batches(b, threshold, epsilon, single, True), FOUND), "exact"
        )
        every = found.unionByName(settled)
        scratch.append(path)
    counts = every.groupBy("da", "db").agg(F.sum("links").alias("links"))
    # a vec_id with several vectors joins what they are linked with
    which = F.struct("da", "db")
    several = encoded.where("da IS NOT NULL").groupBy(F.col("vec_id").alias("v")).agg(F.min(which).alias("_l"), F.max(which).alias("_m")).where("_l <> _m")
    own = encoded.select("vec_id", F.col("da").alias("_a"), F.col("db").alias("_b")).join(several.select("v"), F.col("vec_id") == F.col("v")).drop("vec_id")
    shared = own.join(distinct.select("da", "db", "vec_id"), (F.col("_a") == F.col("da")) & (F.col("_b") == F.col("db"))).select(F.col("vec_id").alias("u"), "v")
    labels = connected_components(every.where("links > 0").select(F.col("vec_id").alias("u"), F.col("root").alias("v")).unionByName(shared))
    known, _ = stored(
        distinct.select("da", "db", "vec_id", "mult").join(counts, ["da", "db"], "left").join(labels, F.col("vec_id") == F.col("node"), "left").select(
            F.col("da").alias("_a"), F.col("db").alias("_b"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
        ), "known")
    rows, _ = stored(encoded.select("vec_id", "da", "db"), "rows")
    for path in scratch:
        drop_path(spark, path)
    return rows.join(known, (F.col("da") == F.col("_a")) & (F.col("db") == F.col("_b")), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce("component_id", "vec_id").eqNullSafe(F.col("vec_id")).alias("kept"),
    )
