"""Line dedup by content-defined chunks of lines.

Rolling hashes over the hashes of one and of two lines decide, from the content alone, where a chunk may start and where one may end,
so an inserted or removed line shifts no boundary but those beside it. A chunk goes from a start to the first end at least
``LEAST_LINES`` lines on. Chunks that occur again anywhere in the corpus are compared by their bytes; all but the first occurrence go,
and with them the lines beside them that equal, byte for byte, the lines beside the first occurrence, so a passage goes up to its ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from provenant.llm.common import drop_path, signed, small_batches, stored, text_key

#: Windows of lines under the rolling hash, and how many lines one of them lets pass for each boundary (a power of two).
WINDOWS, MEAN_LINES = (1, 2), 2
#: A chunk has at least this many lines; no window is longer, so a boundary never depends on lines beyond its chunk.
LEAST_LINES = 2
#: A window of so many words is always a boundary: two lines that hold as many are a chunk wherever they occur. In passages without such a
#: pair, hashes leave 43 % of two lines, 15 % of three, 4 % of four, 1 % of five and 0.1 % of eight without a chunk.
WIDE_WORDS = 10
#: Chunks that leave a Python worker together.
BATCH_ROWS = 2048
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

HASHES = "doc_id long, key long, at int, hash_a long, hash_b long"
BODIES = f"{HASHES}, stop int, chunk string, before array<string>, after array<string>"


def boundaries(hashes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each line, with these hashes and numbers of words: may a chunk start with it, may one end with it?

    The windows that start (or end) with a line decide; a text's first line is a start and its last one an end.
    """
    n = len(hashes)
    starts, ends = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    before = np.concatenate([[0], np.cumsum(words)])
    with np.errstate(over="ignore"):
        for size in WINDOWS:
            if n < size:
                continue
            rolling = np.full(n - size + 1, size, dtype=np.uint64)
            for i in range(size):
                rolling = rolling * MULTIPLIER + hashes[i : n - size + 1 + i]
            mixed = (rolling ^ rolling >> np.uint64(29)) * MULTIPLIER
            wide = before[size:] - before[: n - size + 1] >= WIDE_WORDS
            starts[: n - size + 1] |= wide | ((mixed >> np.uint64(40)) & np.uint64(MEAN_LINES - 1) == 0)
            ends[size - 1 :] |= wide | ((mixed >> np.uint64(50)) & np.uint64(MEAN_LINES - 1) == 0)
    if n:
        starts[0] = ends[-1] = True
    return starts, ends


def spans(found: list[str]) -> list[tuple[int, int]]:
    """The chunks of a text's lines, as (first line, line after the last one), by rising first line; those of blank lines alone too."""
    hashes = np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in found], dtype=np.uint64)
    starts, ends = boundaries(hashes, np.array([len(x.split()) for x in found], dtype=np.int64))
    first, stops = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    first = first[first + LEAST_LINES <= len(found)]
    return list(zip(first.tolist(), stops[np.searchsorted(stops, first + LEAST_LINES)].tolist())) if len(first) else []


def _chunk_batches(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    """The chunks of each text; with their bytes and the lines beside them, only those that start at one of ``ats``."""
    fields = [x.split() for x in (BODIES if with_text else HASHES).split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    columns_of = ("doc_id", "key", "text", "ats") if with_text else ("doc_id", "key", "text")

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[] for _ in fields]
        return pa.RecordBatch.from_arrays([pa.array(c, type=kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])

    for batch in batches:
        rows: list[tuple] = []
        for doc, key, text, *wanted in zip(*(batch.column(n).to_pylist() for n in columns_of)):
            if not text:
                continue
            found = text.split("\n")
            cut, only = spans(found), set(wanted[0]) if with_text else None
            for no, (at, stop) in enumerate(cut):
                if only is not None and at not in only or not any(x.strip() for x in found[at:stop]):
                    continue
                body = "\n".join(found[at:stop])
                d = xxhash.xxh3_128_intdigest(body.encode("utf-8", "surrogatepass"))
                row = (doc, key, at, signed(d >> 64), signed(d & (1 << 64) - 1))
                if with_text:
                    # back to the chunk before, on to the end of the next: what lies beyond has chunks of its own
                    before = found[cut[no - 1][0] if no else 0 : at][::-1]
                    after = found[stop : cut[no + 1][1] if no + 1 < len(cut) else len(found)]
                    row = (*row, stop, body, before, after)
                rows.append(row)
                if len(rows) == BATCH_ROWS:
                    yield packed(rows)
                    rows = []
        yield packed(rows)


def without_lines(found: list[str], gone: list[dict]) -> list[str]:
    """The lines outside the spans that go; blank lines between two removed ones go as well."""
    drop = {i for span in gone for i in range(span["a"], span["b"])}
    at = 0
    while at < len(found):
        end = at
        while end < len(found) and end not in drop and not found[end].strip():
            end += 1
        if end > at and at - 1 in drop and end in drop:
            drop.update(range(at, end))
        at = max(end, at + 1)
    return [x for i, x in enumerate(found) if i not in drop]


def _rebuild_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their text and the spans of lines that go -> row, text, number of lines, of lines removed."""
    for batch in batches:
        texts, before, removed = [], [], []
        for text, gone in zip(*(batch.column(n).to_pylist() for n in ("text", "gone"))):
            found = text.split("\n") if text else []
            held = without_lines(found, gone) if gone else found
            texts.append("\n".join(held) if len(held) < len(found) else text)
            before.append(len(found))
            removed.append(len(found) - len(held))
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(texts, type=pa.string()), pa.array(before, type=pa.int64()), pa.array(removed, type=pa.int64())],
            names=["row", "text", "n_lines", "n_lines_removed"],
        )


def _agreeing(a: str, b: str) -> Column:
    """How many of the first elements of two arrays of strings are equal."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    return (F.array_position(F.concat(same, F.array(F.lit(False))), False) - 1).cast("int")


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, key, text)`` -> ``doc_id, key, gone``: the spans of lines (``a``, and ``b`` after the last) to remove from each document that loses any.

    First, hashes alone are dealt (their counts are combined before the shuffle). Only chunks whose hash occurs more than once are
    then compared by their bytes, as groups of equal text: a hash collision removes nothing. The first occurrence, by (doc_id, key, line),
    stays; null ids come last. The others take along the lines beside them that equal those beside the first one. A chunk repeated
    within one document is removed there too.
    """
    spark = docs.sparkSession
    hashed = docs.mapInArrow(lambda b: _chunk_batches(b, False), HASHES)
    # tables of their own, here and below: both sides of a join are plain shuffles then, which skew handling can split where a chunk is very common;
    # merged at every size, so that a small table's plan is that of a large one
    often, often_path = stored(
        hashed.groupBy("hash_a", "hash_b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("hash_a").alias("_a"), F.col("hash_b").alias("_b")), "often"
    )
    again = hashed.join(often.hint("merge"), (F.col("hash_a") == F.col("_a")) & (F.col("hash_b") == F.col("_b")), "left_semi")
    ats, ats_path = stored(again.groupBy(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).agg(F.collect_set("at").alias("ats")), "repeated-starts")
    mine = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k"))
    bodies, bodies_path = stored(docs.join(ats.hint("merge"), mine).select("doc_id", "key", "text", "ats").mapInArrow(lambda b: _chunk_batches(b, True), BODIES), "chunks")
    place = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "key", "at")
    firsts = bodies.withColumn("_place", place).groupBy("hash_a", "hash_b", "chunk").agg(F.min(F.struct("_place", "before", "after")).alias("f"), F.count(F.lit(1)).alias("n"))
    known, known_path = stored(
        firsts.where("n > 1").select(
            F.col("hash_a").alias("_a"), F.col("hash_b").alias("_b"), F.col("chunk").alias("_c"), F.col("f._place").alias("_first"), F.col("f.before").alias("_before"), F.col("f.after").alias("_after")
        ), "first-chunks"
    )
    same = (F.col("hash_a") == F.col("_a")) & (F.col("hash_b") == F.col("_b")) & (F.col("chunk") == F.col("_c"))
    lost = bodies.join(known.hint("merge"), same).where(~place.eqNullSafe(F.col("_first")))
    span = F.struct((F.col("at") - _agreeing("before", "_before")).alias("a"), (F.col("stop") + _agreeing("after", "_after")).alias("b"))
    gone, _ = stored(lost.select("doc_id", "key", span.alias("span")).groupBy("doc_id", "key").agg(F.collect_set("span").alias("gone")), "gone-lines")
    for path in (often_path, ats_path, bodies_path, known_path):
        drop_path(spark, path)
    return gone


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> the same rows and columns, ``text`` without repeated passages, and ``n_lines, n_lines_removed``.

    Null and empty texts have no lines and stay as they are. Rows equal in doc_id and text are one document: both keep or lose the same
    lines. Passages of one line are never removed, nor ones of blank lines alone. An empty table gives an empty result. Columns of these
    names are replaced; any other names may occur.
    """
    small_batches(docs.sparkSession)
    added = ("n_lines", "n_lines_removed")
    kept = [c for c in docs.columns if c not in (*added, "text")]
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"),
        F.col("text").cast("string").alias("text"),
    )
    gone = repeated_chunks(base.select("doc_id", "key", "text")).select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "gone")
    joined = base.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")), "left").select("row", "text", "gone")
    schema = StructType([joined.schema["row"], StructField("text", StringType()), StructField("n_lines", LongType()), StructField("n_lines_removed", LongType())])
    done = joined.mapInArrow(_rebuild_batches, schema)
    return done.select(*["text" if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c not in added], *added)
