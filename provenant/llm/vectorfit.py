"""Vector best-fit packing: pieces go to the sequence whose residual capacities suit them best, under every constraint.

A sequence has three capacities: tokens, documents, and attention cost (the sum of squared lengths, what block-diagonal attention
computes). Pieces of one length are alike in all three, so the pass over pieces by falling length is worked out on the histogram of
lengths: bins of equal state form a group, and a step moves as many bins of a group as there are pieces to place. It makes the
same bins as a pass piece by piece, in steps whose number follows the window, not the corpus. Slots (length, range of ranks, first
sequence, offset) come out; each piece finds its own by its rank within its length.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import running_sum, small_batches, stored, text_key, uniform_buckets

WINDOW, END_ID = 1024, 2
# Fixed value: the cutting pattern of byte-level tokenizers of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class BytePairs:
    """Token ids of texts by the byte-level BPE tokenizer file at ``path``; its special tokens count where a text holds their strings."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as file:
            found = json.load(file)
        special = {t["content"]: t["id"] for t in found["added_tokens"]}
        kinds = [*range(33, 127), *range(161, 173), *range(174, 256)]
        # bytes that print stand for themselves, the others for code points from 256 on
        back = {chr(b): b for b in kinds} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in kinds)}
        ranks = {bytes(back[c] for c in token): i for token, i in found["model"]["vocab"].items() if token not in special}
        self.encoding = tiktoken.Encoding("from a file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str | None) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special="all") if text else np.zeros(0, dtype=np.uint32)


@lru_cache(maxsize=2)
def _tokens(path: str) -> BytePairs:
    return BytePairs(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _piece_batches(batches: Iterator[pa.RecordBatch], path: str, window: int, end_id: int) -> Iterator[pa.RecordBatch]:
    """Documents -> their pieces. One longer than the window is cut from its end, so only its first piece may be shorter."""
    tokens, names = _tokens(path), ["doc_id", "key", "piece", "start", "length", "ids_crc32", "doc_tokens"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 4]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for doc, key, text in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "key", "text"))):
            ids = np.append(tokens(text), np.uint32(end_id)).astype("<u4")
            first = len(ids) % window or window
            for n, (a, b) in enumerate([(0, first), *((a, a + window) for a in range(first, len(ids), window))] if len(ids) > window else [(0, len(ids))]):
                for column, value in zip(out, (doc, key, n, a, b - a, zlib.crc32(ids[a:b].tobytes()), len(ids))):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(out, kinds)], names=names)


def demand(histogram: np.ndarray, capacity: tuple[int, int, int]) -> np.ndarray:
    """Weights of the three capacities: the share of each that all pieces together ask for."""
    n, lengths = histogram.astype(float), np.arange(len(histogram), dtype=float)
    asked = np.array([(n * lengths).sum(), n.sum(), (n * lengths**2).sum()]) / np.array(capacity, dtype=float)
    return asked / max(asked.sum(), 1e-300)


def plan(histogram: np.ndarray, capacity: tuple[int, int, int], weights: np.ndarray, rule: str = "norm") -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Counts by length -> slots (length, first rank, end rank, sequence of the first rank, offset), number of sequences.

    By falling length, each piece takes the open sequence that has room in all capacities and, by ``rule``, leaves the smallest weighted norm of
    residual shares (``norm``) or has the largest weighted dot product of its own shares with the residual ones (``dot``); ties go to the earlier
    group. Without one it opens a sequence.
    """
    size, limit = np.array(capacity, dtype=float), np.array(capacity, dtype=np.int64)
    # groups of open sequences in one state: first sequence, number of sequences, and what each has used
    groups, used = np.zeros((0, 2), dtype=np.int64), np.zeros((0, 3), dtype=np.int64)
    slots: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    for length in range(len(histogram) - 1, 0, -1):
        left, rank = int(histogram[length]), 0
        item = np.array([length, 1, length * length], dtype=np.int64)
        while left:
            open_ = np.flatnonzero((limit - used >= item).all(axis=1))
            if len(open_):
                shares = (limit - used[open_]) / size
                score = -(weights * (shares - item / size) ** 2).sum(axis=1) if rule == "norm" else (weights * shares * (item / size)).sum(axis=1)
                g = int(open_[int(np.argmax(score))])
                (first, there), before = groups[g].tolist(), used[g].copy()
                # a smaller residual is always better: by the norm, the same sequence takes the next piece, too
                most = int(((limit - before) // item).min()) if rule == "norm" else 1
            else:
                g, before, most = None, np.zeros(3, dtype=np.int64), int((limit // item).min())
                if most == 0:
                    raise ValueError("a piece exceeds the capacities of an empty sequence")
                first, there = sequences, -(-left // most)
                sequences += there
            bins, each = (min(there, left // most), most) if left >= most else (1, left)
            parts = [(first, bins, each)]
            if g is None and bins < there:
                parts.append((first + bins, 1, left - bins * each))  # the last sequence that was opened takes what is left
            elif g is not None:
                groups[g] = first + bins, there - bins
            for start, n, k in parts:
                slots += [(length, rank + j * n, rank + (j + 1) * n, start, int(before[0]) + j * length) for j in range(k)]
                rank, left = rank + n * k, left - n * k
            groups = np.concatenate([groups, [(start, n) for start, n, _ in parts]])
            used = np.concatenate([used, [before + k * item for _, _, k in parts]])
            if g is not None and bins == there:
                groups, used = np.delete(groups, g, axis=0), np.delete(used, g, axis=0)
        keep = (used < limit).all(axis=1)
        groups, used = groups[keep], used[keep]
    return slots, sequences


def best_plan(histogram: np.ndarray, capacity: tuple[int, int, int], weights: np.ndarray | None = None) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """The plan with the fewest sequences of three: residual norm by tokens alone and by demand, dot product by demand (or all by ``weights``)."""
    asked = demand(histogram, capacity) if weights is None else np.asarray(weights, dtype=float)
    choices = [("norm", np.array([1.0, 0.0, 0.0]) if weights is None else asked), ("norm", asked), ("dot", asked)]
    return min((plan(histogram, capacity, w, rule) for rule, w in choices), key=lambda found: found[1])


def pack(
    docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, most_docs: int | None = None, most_cost: int | None = None, weights: np.ndarray | None = None
) -> DataFrame:
    """``docs(doc_id, text)`` -> a row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, doc_tokens.

    A document's ids are those of the tokenizer file at ``tokenizer``, which every executor must have, and ``end_id``. Null or empty text: the end id
    alone. Only a document longer than ``window`` is cut. A sequence holds at most ``window`` tokens, ``most_docs`` pieces and a sum of squared lengths of
    ``most_cost``; the defaults, ``window`` and its square, are reached only by sequences that are full of tokens, so that as few as possible are
    made. Rows that repeat a doc_id, or a doc_id and a text, are documents of their own; which of two equal rows takes which slot does not
    show. Sequence ids are dense from 0. An empty table gives an empty result; other columns are ignored.

    Ids are made once and not kept: their checksums are. What is dealt afterwards is a row of seven numbers a piece, ranked within its length over
    buckets of a hash. The histogram (``window`` numbers) reaches the driver, and the slots go back as a broadcast, of about 10,000 rows at any size.
    """
    capacity = (window, most_docs or window, most_cost or window * window)
    if capacity[2] < window * window:
        raise ValueError("a full piece must fit: most_cost below the square of the window")
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, key long, piece int, start long, length long, ids_crc32 long, doc_tokens long"
    cut, _ = stored(texts.mapInArrow(lambda b: _piece_batches(b, tokenizer, window, end_id), schema), "pieces")
    histogram = np.zeros(window + 1, dtype=np.int64)
    for row in cut.groupBy("length").count().collect():  # at most window rows
        histogram[row["length"]] = row["count"]
    slots, _ = best_plan(histogram, capacity, weights)
    ranked = running_sum(cut.withColumn("_each", F.lit(1)), "length", ["doc_id", "key", "piece"], "_each", "_rank", uniform_buckets(int(histogram.sum())), 13)
    # a length's slots lie end to end in rank, so the slot of a rank is the last that starts at or before it
    by_length: dict[int, list[tuple[int, int, int, int]]] = {}
    for length, start, _, sequence, offset in sorted(slots):
        by_length.setdefault(length, []).append((start, sequence, offset))
    rows = [(length, a, (places[i + 1][0] if i + 1 < len(places) else int(histogram[length])), s, o) for length, places in by_length.items() for i, (a, s, o) in enumerate(places)]
    table = spark.createDataFrame(rows or [(0, 0, 0, 0, 0)], "_len long, _from long, _to long, _seq long, _off long")
    inside = (F.col("length") == F.col("_len")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    return ranked.join(F.broadcast(table), inside).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("_seq") + F.col("_rank") - F.col("_from")).alias("sequence_id"), F.col("_off").alias("offset"), "doc_tokens")
