"""SimHash near-duplicates by bit-sliced comparison.

A text's words are lower-cased (A-Z), its 4-word shingles hashed with XXH64 (seed 42), and a fingerprint bit is
set if it is set in over half of the hashes. Equal fingerprints are one from here on. Candidates: two
fingerprints within ``radius`` bits agree in whole on some ``k - radius`` of ``k`` bit groups, so each is sent to
one block for each such choice, and no link is lost. In a block the fingerprints' bits stand in vertical
planes; one query is compared with 64 of them at once by carry-save counters, and words of lanes are abandoned
once all their lanes exceed the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import drop_path, small_batches, stored, text_key
from provenant.llm.components import connected_components, merge_labels

RADIUS, SHINGLE, SEED = 4, 4, 42
#: Shingles of one text hashed at a time.
PART_SHINGLES = 1 << 16
#: Rows that a block may have before it is split into pairs of chunks.
BLOCK_ROWS = 4096
#: Lanes (a query and 64 fingerprints) compared in one sweep.
LANES = 1 << 15
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a UTF-8 text as an unsigned number; null and wordless texts: 0."""
    words = text.lower().split() if text else ()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest, n = xxhash.xxh64_intdigest, len(words) - shingle + 1
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, PART_SHINGLES):
        low, high = starts[at : min(n, at + PART_SHINGLES)].tolist(), ends[at + shingle - 1 : min(n, at + PART_SHINGLES) + shingle - 1].tolist()
        part = np.array([digest(joined[a:b], seed) for a, b in zip(low, high)], dtype=np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        prints = np.array([fingerprint(t.as_py()) for t in texts], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(prints)], names=["doc_id", "key", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, key, fp``: a row for each row, the text's key and the fingerprint as signed longs."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_fingerprint_batches, "doc_id long, key long, fp long")


def _exceeds(digits: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count (binary digits, highest first; ``over``: too large for them) is above the radius."""
    above, level = over, ~over
    for place, digit in enumerate(digits):
        if radius >> (len(digits) - 1 - place) & 1:
            level = level & digit
        else:
            above = above | (level & digit)
            level = level & ~digit
    return above


def near_lanes(
    prints: np.ndarray, planes: np.ndarray, query: np.ndarray, word: np.ndarray, radius: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lanes (query row, word of 64 rows) with rows within the radius: query, word, and a bit for each near row.

    Four planes at a time go through carry-save adders into counters of ones, twos and fours; after 16
    planes each, words of lanes that have all exceeded the radius are given up.
    """
    if not 0 <= radius <= 7:
        raise ValueError("radius must be from 0 to 7")
    bits = prints[query]
    ones = np.zeros(len(query), dtype=np.uint64)
    twos, fours, over = ones.copy(), ones.copy(), ones.copy()
    one = np.uint64(1)
    for base in range(0, 64, 4):
        a, b, c, d = (planes[p, word] ^ (np.uint64(0) - ((bits >> np.uint64(p)) & one)) for p in range(base, base + 4))
        half = ones ^ a
        first = (ones & a) | (half & b)
        ones = half ^ b
        half = ones ^ c
        second = (ones & c) | (half & d)
        ones = half ^ d
        half = twos ^ first
        carry = (twos & first) | (half & second)
        twos = half ^ second
        over |= fours & carry
        fours = fours ^ carry
        if base % 16 == 12:
            gone = _exceeds([fours, twos, ones], over, radius)
            alive = gone != ALL
            if base == 60:
                return query[alive], word[alive], ~gone[alive]
            if alive.mean() < 0.75:
                query, word, bits = query[alive], word[alive], bits[alive]
                ones, twos, fours, over = ones[alive], twos[alive], fours[alive], over[alive]
    raise AssertionError


def bit_planes(padded: np.ndarray) -> np.ndarray:
    """Rows (a multiple of 64) as 64 vertical planes: word w of plane p has bit p of rows 64 w to 64 w + 63."""
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def block_labels(prints: np.ndarray, starts: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """``prints`` lie block after block, ``starts`` has the blocks' first rows -> for each row, the lowest row linked with it in its block."""
    sizes = np.diff(np.append(starts, len(prints)))
    words = -(-sizes // 64)
    first_word = np.cumsum(words) - words
    place = np.repeat(first_word * 64 - starts, sizes) + np.arange(len(prints))
    padded = np.zeros(int(words.sum()) * 64, dtype=np.uint64)
    padded[place] = prints
    row_at = np.full(len(padded), -1, dtype=np.int64)
    row_at[place] = np.arange(len(prints))
    planes = bit_planes(padded)
    label = np.arange(len(prints))
    own_word = place // 64
    lanes = np.repeat(first_word + words, sizes) - own_word
    ends = np.cumsum(lanes)
    row = 0
    while row < len(prints):
        upto = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + LANES, side="right")))
        mine = lanes[row:upto]
        query = np.repeat(np.arange(row, upto), mine)
        word = np.arange(len(query)) - np.repeat(np.cumsum(mine) - mine, mine) + own_word[query]
        for at in range(0, len(query), LANES):
            q, w, near = near_lanes(prints, planes, query[at : at + LANES], word[at : at + LANES], radius)
            hits = np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            lane, bit = np.nonzero(hits)
            left, right = q[lane], row_at[w[lane] * 64 + bit]
            keep = (right >= 0) & (right > left)
            merge_labels(label, left[keep], right[keep])
        row = upto
    return label


def _block_batches(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (t, key, i, j, fp), sorted by block -> edges (u, v) that join what is linked within each block."""

    def edges(block: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.append(True, (block[1:] != block[:-1]).any(axis=1)))
        unsigned = prints.view(np.uint64)
        label = block_labels(unsigned, starts, radius)
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(prints[linked]), pa.array(prints[label[linked]])], names=["u", "v"])

    kept_block, kept = np.zeros((0, 4), dtype=np.int64), np.zeros(0, dtype=np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        block = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("t", "key", "i", "j")], axis=1)
        block = np.concatenate([kept_block, block])
        prints = np.concatenate([kept, batch.column("fp").to_numpy()])
        change = np.flatnonzero((block[1:] != block[:-1]).any(axis=1))
        cut = int(change[-1]) + 1 if len(change) else 0
        if cut:
            yield edges(block[:cut], prints[:cut])
        kept_block, kept = block[cut:], prints[cut:]
    if len(kept):
        yield edges(kept_block, kept)


def bit_groups(n: int, radius: int = RADIUS) -> list[int]:
    """Masks of the block keys for ``n`` fingerprints: each keeps k - radius of k bit groups, so many that keys outnumber rows."""
    for k in range(radius + 1, 64):
        if 64 * (k - radius) // k >= min(32, max(1, n).bit_length()):
            break
    cuts = [64 * i // k for i in range(k + 1)]
    group = [((1 << cuts[i + 1]) - (1 << cuts[i])) for i in range(k)]
    masks = (sum(group[i] for i in chosen) for chosen in combinations(range(k), k - radius))
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near_edges(prints: DataFrame, radius: int = RADIUS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``prints(fp)``, distinct -> edges ``(u, v)`` whose components are those of all links within the radius.

    Blocks of one row end at once. A block above ``block_rows`` is split into chunks by a hash, and each pair of
    chunks becomes a block of its own, so no task holds more than two chunks and no pair is skipped.
    """
    masks = bit_groups(prints.count(), radius)
    places = F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)
    ]))
    dealt = prints.select("fp", places.alias("_p")).select("_p.t", "_p.key", "fp")
    sizes = dealt.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.col("t").alias("_t"), F.col("key").alias("_k"), F.ceil(F.col("n") / block_rows).cast("int").alias("chunks")
    )
    joined = dealt.join(sizes, (F.col("t") == F.col("_t")) & (F.col("key") == F.col("_k")))
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("chunks")).cast("int")
    blocks = joined.select("t", "key", "fp", own.alias("c"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("o")).select(
        "t", "key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "fp"
    )
    by = ["t", "key", "i", "j"]
    return blocks.repartition(*by).sortWithinPartitions(*by).mapInArrow(
        lambda batches: _block_batches(batches, radius), "u long, v long"
    )


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, key, fingerprint, fp, root, component_id``: one row for each row.

    ``component_id``: the smallest doc_id of all documents reachable by links, itself included (nulls don't count; null
    if no document of the component has an id). ``root``: the component's smallest fingerprint, which tells components apart
    whatever their ids; ``key``: the text's, as ``text_key`` has it. Null and empty texts have fingerprint zero and are linked like any other.
    Copies share a fingerprint and are compared once. An empty table gives an empty result.
    """
    rows, _ = stored(fingerprints(docs), "fingerprints")
    lowest, lowest_path = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    labels = connected_components(near_edges(lowest.select("fp"), radius))
    members = lowest.join(labels, lowest["fp"] == labels["node"], "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("root")
    )
    tops = members.groupBy("root").agg(F.min("low").alias("component_id"))
    known, _ = stored(members.join(tops, "root").select(F.col("fp").alias("_fp"), "root", "component_id"), "members")
    drop_path(docs.sparkSession, lowest_path)
    return rows.join(known, rows["fp"] == known["_fp"]).select(
        "doc_id", "key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "fp", "root", "component_id"
    )
