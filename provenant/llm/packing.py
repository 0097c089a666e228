"""Packing token sequences by non-negative least squares over shallow length combinations.

A document's tokens are cut into whole windows and a remainder of 1 to W - 1 tokens. The remainders' histogram is explained by
combinations of up to three lengths that fill a window exactly: their repeat counts solve a non-negative least-squares
problem, are rounded down and made feasible, and the remainders take the slots they open. What is left is packed greedily,
end to end, cut at window ends; the last, partly filled window is cut into sequences whose lengths are powers of
two, which need no padding.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenant.llm.common import running_sum, small_batches, stored, text_key, uniform_buckets

WINDOW, END_ID = 4096, 2
#: Lengths of the two shorter members of a combination of three are multiples of this.
GRID = 64
#: Parts of words kept with their token ids by a worker before it starts afresh.
CACHE_PARTS = 700_000
SPACES = str.maketrans({c: " " for c in "\t\n\r"})
#: What the cutting below is known to do as the tokenizer does: printable ASCII, line ends, and Latin letters whose lower case is one letter.
SIMPLE = re.compile("[\t\n\r\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]*")
# Fixed value: the tokenizer's cutting pattern, for such words.
PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


class _Filled(dict):
    """A dict that computes what it lacks."""

    def __init__(self, compute) -> None:
        super().__init__()
        self.compute = compute

    def __missing__(self, key: str) -> bytes:
        self[key] = value = self.compute(key)
        return value


class WordTokens:
    """Token ids of texts, as bytes of little-endian unsigned 16-bit numbers, by the tokenizer file at ``path``.

    The ids of a text are those of its parts (runs of letters, single digits, runs of signs), one after another. Each part's are
    computed once and kept. Only texts of plain letters, digits and signs are cut here; of any other, the space-separated words
    that are not plain go to the tokenizer as they are, which never joins characters across a space, tab or line end.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("token ids must fit 16 bits")
        kinds = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
        rest = [b for b in range(256) if b not in kinds]
        # byte-level pieces: printable bytes stand for themselves, the others for code points from 256 on
        self.visible = {b: chr(256 + i) for i, b in enumerate(rest)}
        self.parts = _Filled(self._part)

    def _bytes(self, ids: list[int]) -> bytes:
        return array("H", ids).tobytes()

    def _part(self, part: str) -> bytes:
        shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.visible)
        return self._bytes([t.id for t in self.tokenizer.model.tokenize(shown)])

    def _plain(self, text: str) -> bytes | None:
        if "<|" in text or not (text.isascii() and text.isprintable()) and not SIMPLE.fullmatch(text):
            return None
        return b"".join(map(self.parts.__getitem__, PART.findall(text.lower())))

    def _word(self, word: str) -> bytes:
        found = self._plain(word)
        return self._bytes(self.tokenizer.encode(word, add_special_tokens=False).ids) if found is None else found

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(self.parts) > CACHE_PARTS:
            self.parts.clear()
        found = self._plain(text)
        return b"".join(map(self._word, text.translate(SPACES).split(" "))) if found is None else found


@lru_cache(maxsize=2)
def _tokens(path: str) -> WordTokens:
    return WordTokens(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _token_batches(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    tokens, end = _tokens(path), array("H", [end_id]).tobytes()
    for batch in batches:
        ids = [tokens(t) + end for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("key"), pa.array([len(x) // 2 for x in ids], type=pa.int64()), pa.array(ids, type=pa.binary())],
            names=["doc_id", "key", "doc_tokens", "ids"],
        )


def combinations(window: int = WINDOW, grid: int = GRID) -> list[tuple[int, ...]]:
    """Length combinations that fill a window: all pairs, and triples whose two shorter members lie on the grid."""
    pairs = [(a, window - a) for a in range(1, window // 2 + 1)]
    step = max(1, min(grid, window // 8))
    triples = [
        (a, b, window - a - b) for a in range(step, window // 3 + 1, step) for b in range(a, (window - a) // 2 + 1, step) if window - a - b >= b
    ]
    return pairs + triples


def solve(histogram: np.ndarray, combos: list[tuple[int, ...]], sweeps: int = 40) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram|^2 (column j of A counts the lengths of combination j).

    Cyclic coordinate descent: each step is the exact minimum along one coordinate, cut at zero.
    """
    left = histogram.astype(float).tolist()
    x = [0.0] * len(combos)
    columns = [sorted({n: c.count(n) for n in c}.items()) for c in combos]
    weight = [sum(k * k for _, k in c) for c in columns]
    for _ in range(sweeps):
        moved = 0.0
        for j, column in enumerate(columns):
            to = max(0.0, x[j] + sum(k * left[n] for n, k in column) / weight[j])
            by = to - x[j]
            if by:
                x[j] = to
                for n, k in column:
                    left[n] -= k * by
                moved = max(moved, abs(by))
        if moved < 1e-3:
            break
    return np.array(x)


def plan(histogram: np.ndarray, window: int = WINDOW) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Histogram of remainders -> slots (length, first rank, end rank, sequence of the first rank, offset), number of sequences.

    The rounded-down solution is cut to what the histogram still holds, so slots never outnumber documents.
    """
    combos = combinations(window)
    counts = np.floor(solve(histogram, combos) + 1e-6).astype(np.int64)
    left, used, slots, sequences = histogram.astype(np.int64).copy(), np.zeros(len(histogram), dtype=np.int64), [], 0
    for combo, count in zip(combos, counts.tolist()):
        most = min(left[n] // combo.count(n) for n in combo)
        count = int(min(count, most))
        if count <= 0:
            continue
        offset = 0
        for n in combo:
            slots.append((n, int(used[n]), int(used[n]) + count, sequences, offset))
            used[n] += count
            left[n] -= count
            offset += n
        sequences += count
    return slots, sequences


def powers(n: int) -> list[int]:
    """The powers of two that add up to n, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pieces(counts: DataFrame, window: int = WINDOW, seed: int = 11) -> DataFrame:
    """``counts(doc_id, key, copy, doc_tokens)`` -> adds ``start, length, sequence_id, offset``: one row for each piece.

    Ranks and positions are prefix sums over buckets of a hash, so neither a common length nor a large residue meets in
    one task. The histogram (window - 1 numbers) and the slots are all that reaches the driver.
    """
    spark = counts.sparkSession
    same = ["doc_id", "key", "copy"]
    base = counts.withColumn("whole", F.floor(F.col("doc_tokens") / window).cast("long")).withColumn("rest", F.pmod("doc_tokens", F.lit(window)).cast("long"))
    seen = base.agg(F.count(F.lit(1)).alias("n"), F.sum("whole").alias("whole")).first()
    buckets, n_whole = uniform_buckets(seen["n"]), int(seen["whole"] or 0)
    wholes = running_sum(base.where("whole > 0").withColumn("_one", F.lit(0)), "_one", same, "whole", "_first", buckets, seed).select(
        *same, "doc_tokens", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("_i"), "_first"
    ).select(*same, "doc_tokens", (F.col("_i") * window).alias("start"), F.lit(window).cast("long").alias("length"),
             (F.col("_first") + F.col("_i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rests = base.where("rest > 0")
    histogram = np.zeros(window, dtype=np.int64)
    for row in rests.groupBy("rest").count().collect():  # at most window - 1 rows
        histogram[row["rest"]] = row["count"]
    slots, n_combined = plan(histogram, window)
    ranked = running_sum(rests.withColumn("_each", F.lit(1)), "rest", same, "_each", "_rank", buckets, seed).drop("_each")
    table = spark.createDataFrame(slots or [(0, 0, 0, 0, 0)], "_len long, _from long, _to long, _seq long, _off long")
    placed, _ = stored(
        ranked.join(F.broadcast(table), (F.col("rest") == F.col("_len")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")), "left")
        .select(*same, "doc_tokens", "whole", "rest", (F.col("_seq") + F.col("_rank") - F.col("_from")).alias("_slot"), F.col("_off")), "slots")
    start = F.col("whole") * window
    combined = placed.where("_slot IS NOT NULL").select(
        *same, "doc_tokens", start.alias("start"), F.col("rest").alias("length"), (F.col("_slot") + n_whole).alias("sequence_id"), F.col("_off").alias("offset")
    )
    residue = placed.where("_slot IS NULL")
    total = int(residue.agg(F.sum("rest")).first()[0] or 0)
    base_id = n_whole + n_combined
    full, tail = divmod(total, window)
    laid = running_sum(residue.withColumn("_one", F.lit(0)), "_one", same, "rest", "_at", buckets, seed)
    last = powers(tail)
    ends = [full * window + sum(last[: i + 1]) for i in range(len(last))]
    cuts = F.array_union(
        F.transform(F.sequence(F.floor(F.col("_at") / window), F.floor((F.col("_at") + F.col("rest") - 1) / window)), lambda i: F.greatest(i * window, F.col("_at"))),
        F.filter(F.lit([full * window, *ends]).cast("array<bigint>"), lambda e: (e > F.col("_at")) & (e < F.col("_at") + F.col("rest"))),
    )
    cut = laid.withColumn("_cuts", F.array_sort(F.array_distinct(cuts))).select("*", F.posexplode("_cuts").alias("_p", "_from"))
    until = F.coalesce(F.try_element_at("_cuts", F.col("_p") + 2), F.col("_at") + F.col("rest"))
    in_tail = F.col("_from") >= full * window
    order = F.size(F.filter(F.lit([*ends]).cast("array<bigint>"), lambda e: e <= F.col("_from")))
    tail_start = F.element_at(F.lit([full * window, *ends]).cast("array<bigint>"), order + 1)
    greedy = cut.select(
        *same, "doc_tokens", (start + F.col("_from") - F.col("_at")).alias("start"), (until - F.col("_from")).alias("length"),
        (F.when(in_tail, F.lit(full) + order).otherwise(F.floor(F.col("_from") / window)) + base_id).cast("long").alias("sequence_id"),
        F.when(in_tail, F.col("_from") - tail_start).otherwise(F.pmod("_from", F.lit(window))).cast("long").alias("offset"),
    )
    return wholes.unionByName(combined).unionByName(greedy)


def _crc_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "copy", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for doc, raw, placed in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), batch.column("pieces").to_pylist()):
            ids = np.frombuffer(raw, dtype="<u2").astype("<u4")
            for p in placed:
                crc = zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
                for column, value in zip(out, (doc, p["copy"], p["start"], p["length"], crc, len(ids), p["sequence_id"], p["offset"])):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in out], names=names)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """``docs(doc_id, text)`` -> a row for each piece: doc_id, copy, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of the tokenizer file at ``tokenizer``, which every executor must have, and ``end_id``. Null text: empty
    (the end id alone). Rows that repeat a doc_id, or a doc_id and a text, are documents of their own, told apart by ``copy``. Sequence ids are dense.
    Ids are computed once and kept in the shared folder, two bytes each; they join their pieces by document.
    An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), F.col("text").cast("string").alias("text"))
    tokens, _ = stored(texts.mapInArrow(lambda b: _token_batches(b, tokenizer, end_id), "doc_id long, key long, doc_tokens long, ids binary"), "tokens")
    grouped = tokens.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_tokens").alias("doc_tokens"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("doc_id").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = grouped.withColumn("_from", earlier + 1).select("doc_id", "key", "doc_tokens", F.explode(F.sequence(F.col("_from"), F.col("_from") + F.col("n") - 1)).alias("copy"))
    counts, _ = stored(each.select("doc_id", "key", "copy", "doc_tokens"), "counts")
    placed = pieces(counts, window)
    lists = placed.groupBy("doc_id", "key").agg(F.collect_list(F.struct("copy", "start", "length", "sequence_id", "offset")).alias("pieces")).select(
        F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "pieces"
    )
    repeated = counts.count() > counts.select("doc_id", "key").distinct().count()
    single = tokens.dropDuplicates(["doc_id", "key"]) if repeated else tokens
    joined = single.join(lists, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k"))).select("doc_id", "ids", "pieces")
    return joined.mapInArrow(
        _crc_batches, "doc_id long, copy long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
