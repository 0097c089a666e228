"""Collocations: phrases that occur more often than their parts suggest, counted exactly over whole texts.

Texts are cut into pieces at sentence marks and line ends. Identical pieces of a language become one row with a multiplicity, so a
passage of thousands of copies is read once. Tasks turn pieces into weighted n-grams, add up equal ones, and deal them by hash; each
hash bucket is counted by an embedded DuckDB that has a fixed memory and spills beside Spark's own spills. A phrase of at least
``least`` occurrences is made of words and pairs of words with as many, so longer n-grams are formed only where the words, then the
pairs, pass a Bloom filter of the frequent ones; the filter has a fixed size and errs only towards counting more. The counts of a
candidate's parts are fetched by lookup requests: a distinct request for each part and salt is shuffled to the part's count, and the
answer back to the candidates that asked.
"""

from __future__ import annotations

import os
import re
import tempfile
from collections import Counter
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenant.llm.common import drop_path, small_batches, stored

LEAST, LONGEST, TOP, PERCENT = 100, 5, 2_000, 100
#: Bits of a filter of frequent n-grams; it is broadcast, 8 MB at any size of the corpus.
FILTER_BITS = 1 << 26
#: Memory of the DuckDB that counts a bucket; beyond it, it spills.
MEMORY = "256MB"
#: Bytes of pieces whose n-grams are added up before they leave a task.
CHUNK_BYTES = 16 << 20
#: Rows of a batch of n-grams.
ROWS = 1 << 17
#: Lookup requests for one part are split into so many.
SALTS = 64
UNKNOWN = "und"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
BREAKS = re.compile(rb"[.,;:!?\n-\r]")
MIX, TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _piece_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> pieces with single spaces between words, and how often each occurs in the batch."""
    for batch in batches:
        found: dict[str, Counter] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            found.setdefault(lang, Counter()).update(b" ".join(p.split()) for p in BREAKS.split(text.translate(LOWER)))
        for lang, counts in found.items():
            counts.pop(b"", None)
            if counts:
                pieces = pa.array(list(counts), type=pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(pieces)), pieces, pa.array(list(counts.values()), type=pa.int64())], names=["lang", "piece", "n"])


def pieces(docs: DataFrame) -> DataFrame:
    """``docs(text, lang)`` -> ``lang, piece, n``: distinct pieces and their multiplicities. Null text: none; null lang: und."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(_piece_batches, "lang string, piece string, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def _text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode())


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * TURN
    return h ^ (h >> np.uint64(32))


def gram_hash(lang: str, gram: str) -> int:
    """The 64-bit hash of an n-gram: that of its words in turn, begun with the language's."""
    own = np.array([_text_hash(lang)], dtype=np.uint64)
    words = [_mixed(np.array([_text_hash(w)], dtype=np.uint64) + own) for w in gram.split(" ")]
    out = words[0]
    for w in words[1:]:
        out = _mixed(out * MIX + w)
    return int(out[0].astype(np.int64))


def _passes(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes may be in the filter."""
    mask, out = np.uint64(len(known) * 64 - 1), np.ones(len(h), dtype=bool)
    for at in (h & mask, (h >> np.uint64(32)) & mask):
        out &= (known[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= CHUNK_BYTES:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def _gram_batches(batches: Iterator[pa.RecordBatch], orders: tuple[int, ...], known) -> Iterator[pa.RecordBatch]:
    """Weighted n-grams of the pieces for n in ``orders``. ``known``: broadcast filters by n; where there is none, all pass."""
    filters = {} if known is None else known.value
    for table in _chunks(batches):
        split = pc.split_pattern(table.column("piece").combine_chunks(), " ")
        ends = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        encoded = split.flatten().dictionary_encode()
        codes, vocabulary = encoded.indices.to_numpy().astype(np.int64), encoded.dictionary
        langs = table.column("lang").combine_chunks().dictionary_encode()
        lang_names, n_langs = langs.dictionary, len(langs.dictionary)
        row = np.repeat(np.arange(len(split)), np.diff(ends))
        lang, weight = langs.indices.to_numpy().astype(np.int64)[row], table.column("n").to_numpy()[row]
        left = ends[1:][row] - np.arange(len(codes))  # words from here to the piece's end
        own, word = np.unique(codes * n_langs + lang, return_inverse=True)
        word_hash = np.array([_text_hash(w) for w in vocabulary.to_pylist()], dtype=np.uint64)
        lang_hash = np.array([_text_hash(x) for x in lang_names.to_pylist()], dtype=np.uint64)
        first = _mixed(word_hash[own // n_langs] + lang_hash[own % n_langs])
        at, gram, h = np.arange(len(codes)), word, first[word]
        for n in range(1, max(orders) + 1):
            if n > 1:
                fine = np.zeros(len(codes) + 1, dtype=bool)
                fine[at] = True
                keep = np.flatnonzero((left[at] >= n) & fine[at + 1])
                last = at[keep] + n - 1
                _, renamed = np.unique(gram[keep] * len(own) + word[last], return_inverse=True)
                at, gram, h = at[keep], renamed, _mixed(h[keep] * MIX + first[word[last]])
            if n in orders:
                _, where, which = np.unique(gram, return_index=True, return_inverse=True)
                total = np.bincount(which, weights=weight[at], minlength=len(where)).astype(np.int64)
                for k in range(0, len(where), ROWS):
                    here = at[where[k : k + ROWS]]
                    words = [vocabulary.take(pa.array(codes[here + i])) for i in range(n)]
                    text = pc.binary_join_element_wise(*words, " ") if n > 1 else words[0]
                    yield pa.RecordBatch.from_arrays([lang_names.take(pa.array(lang[here])), text, pa.array(total[k : k + ROWS])], names=["lang", "gram", "n"])
            if n in filters:
                keep = _passes(filters[n], h)
                at, gram, h = at[keep], gram[keep], h[keep]


def _count_batches(batches: Iterator[pa.RecordBatch], least: int, totals: bool, memory: str) -> Iterator[pa.RecordBatch]:
    """A bucket's n-grams with at least ``least`` occurrences; with ``totals`` also each language's occurrences (gram null)."""
    folder = os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir()).split(",")[0]
    with tempfile.TemporaryDirectory(dir=folder) as spill:
        con = duckdb.connect(config={"memory_limit": memory, "threads": 1, "temp_directory": spill, "preserve_insertion_order": False})
        try:
            con.execute("CREATE TABLE parts (lang VARCHAR, gram VARCHAR, n BIGINT)")
            for batch in batches:
                if batch.num_rows:
                    con.register("arrived", pa.Table.from_batches([batch]))
                    con.execute("INSERT INTO parts SELECT lang, gram, n FROM arrived")
                    con.unregister("arrived")
            sql = f"SELECT lang, gram, sum(n)::BIGINT AS n FROM parts GROUP BY lang, gram HAVING sum(n) >= {int(least)}"
            if totals:
                sql += " UNION ALL SELECT lang, NULL, sum(n)::BIGINT FROM parts GROUP BY lang"
            for found in con.execute(sql).to_arrow_reader(ROWS):
                grams = found.column(1).to_pylist()
                h = pa.array([None if g is None else gram_hash(x, g) for x, g in zip(found.column(0).to_pylist(), grams)], type=pa.int64())
                size = pa.array([0 if g is None else g.count(" ") + 1 for g in grams], type=pa.int32())
                yield pa.RecordBatch.from_arrays([found.column(0), found.column(1), found.column(2), h, size], names=["lang", "gram", "n", "h", "size"])
        finally:
            con.close()


def _counted(rows: DataFrame, orders: tuple[int, ...], known, least: int, memory: str) -> tuple[DataFrame, str]:
    parts = rows.mapInArrow(lambda b: _gram_batches(b, orders, known), "lang string, gram string, n long")
    counted = parts.repartition("lang", "gram").mapInArrow(lambda b: _count_batches(b, least, 1 in orders, memory), "lang string, gram string, n long, h long, size int")
    return stored(counted, "grams")


def _filter(grams: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of the n-grams' hashes, put together by Spark; what comes back has at most ``bits`` / 64 rows."""
    places = F.array(F.col("h").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(bits - 1)))
    words = grams.where("gram IS NOT NULL").select(F.explode(places).alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("ones")
    ).toArrow()
    out = np.zeros(bits >> 6, dtype=np.uint64)
    out[words.column("word").to_numpy()] = words.column("ones").to_numpy().view(np.uint64)
    return out


def gram_counts(
    spark: SparkSession, rows: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = FILTER_BITS, memory: str = MEMORY
) -> tuple[DataFrame, DataFrame, list[str]]:
    """``rows(lang, piece, n)`` -> exact counts of the n-grams of up to ``longest`` words with at least ``least`` occurrences (``lang, gram, n,
    size``), the occurrences of all words of each language (``lang, n``), and the scratch tables that hold them."""
    words, path = _counted(rows, (1,), None, least, memory)
    counts, paths = [words.where("gram IS NOT NULL")], [path]
    filters = {1: _filter(words, bits)}
    longer = rows.where(F.contains("piece", F.lit(" ")))
    for orders in ((2,), tuple(range(3, longest + 1))):
        if orders and orders[0] <= longest:
            known = spark.sparkContext.broadcast(dict(filters))
            grams, path = _counted(longer, orders, known, least, memory)
            known.unpersist()
            counts.append(grams)
            paths.append(path)
            if orders == (2,) and longest > 2:
                filters[2] = _filter(grams, bits)
    every = counts[0]
    for part in counts[1:]:
        every = every.unionByName(part)
    return every.select("lang", "gram", "n", "size"), words.where("gram IS NULL").groupBy("lang").agg(F.sum("n").alias("n")), paths


def _exact_score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (l r)) in whole numbers of up to 38 digits; what has more is an error, never a wrong number."""
    top = (F.lit(1000).cast("decimal(4,0)") * a.cast("decimal(16,0)")).cast("decimal(19,0)") * n.cast("decimal(18,0)")
    under = left.cast("decimal(19,0)") * right.cast("decimal(18,0)")
    return F.call_function("div", top, under)


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, percent: int = PERCENT, bits: int = FILTER_BITS, memory: str = MEMORY, salts: int = SALTS
) -> DataFrame:
    """``docs(text, lang)`` -> ``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases.

    Texts are lower-cased (A-Z), cut into pieces at the marks ``.,;:!?`` and line ends, and these into words at spaces and tabs; n counts a language's words, f a phrase's
    occurrences within pieces, overlaps included. Phrases of 2 to ``longest`` words with a = f >= ``least`` are candidates. Of a candidate's cuts
    into a first part (l = f) and the rest (r = f), the one with the lowest floor(1000 a n / (l r)) counts, ties to the shorter first
    part. A candidate goes if a longer one holds it and 100 f(longer) >= ``percent`` a; for that a look at those with one word more is
    enough, as f falls with length. Order: score, then a, both falling, then phrase in UTF-8 byte order.

    Null text: empty; null lang: und (together with that value). Other columns are ignored. Empty tables give an empty result. Repeated rows and
    documents count each time. A very long text or piece is worked on whole. A language, word or passage with any share of the rows is
    spread: pieces and n-grams are added up before they are dealt by hash, requests for one part go by ``salts``, and ranks keep ``top`` rows a task.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows, pieces_path = stored(pieces(docs), "pieces")
    counts, totals, _ = gram_counts(spark, rows, least, longest, bits, memory)
    drop_path(spark, pieces_path)
    words, size = F.split("gram", " "), F.col("size")
    candidates = counts.where("size > 1").select("lang", F.col("gram").alias("phrase"), F.col("n").alias("a"), "size", words.alias("words"))
    # lookup requests: each candidate asks for both parts of each of its cuts
    cut = candidates.select("lang", "phrase", "a", "words", "size", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    parts = F.array(F.array_join(F.slice("words", F.lit(1), F.col("k")), " "), F.array_join(F.slice("words", F.col("k") + 1, size - F.col("k")), " "))
    requests = cut.select("lang", "phrase", "a", "k", F.pmod(F.xxhash64("lang", "phrase"), F.lit(salts)).alias("salt"), F.posexplode(parts).alias("side", "part"))
    asked = requests.select("lang", "part", "salt").distinct()
    answers = asked.join(counts.select(F.col("lang").alias("_l"), "gram", "n"), (F.col("lang") == F.col("_l")) & (F.col("part") == F.col("gram"))).select(
        F.col("lang").alias("_l"), F.col("part").alias("_p"), F.col("salt").alias("_s"), F.col("n").alias("f"))
    back = requests.join(answers, (F.col("lang") == F.col("_l")) & (F.col("part") == F.col("_p")) & (F.col("salt") == F.col("_s")))
    cuts = range(1, longest)
    sides = [F.max(F.when((F.col("k") == k) & (F.col("side") == s), F.col("f"))).alias(f"f{s}_{k}") for k in cuts for s in (0, 1)]
    known = back.groupBy("lang", "phrase", "salt").agg(F.first("a").alias("a"), *sides)
    each = totals.select(F.col("lang").alias("_l"), "n", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_s"))
    with_n = known.join(each, (F.col("lang") == F.col("_l")) & (F.col("salt") == F.col("_s")))
    options = [
        F.when(F.col(f"f0_{k}").isNotNull(), F.struct(_exact_score(F.col("a"), F.col("n"), F.col(f"f0_{k}"), F.col(f"f1_{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"f0_{k}").alias("l"), F.col(f"f1_{k}").alias("r")))
        for k in cuts
    ]
    scored = with_n.select("lang", "phrase", "salt", "a", "n", F.array_min(F.array(*options)).alias("best"))
    inner = F.array(F.array_join(F.slice("words", F.lit(1), size - 1), " "), F.array_join(F.slice("words", F.lit(2), size - 1), " "))
    held = candidates.where("size > 2").select("lang", "a", F.explode(inner).alias("inside")).groupBy("lang", "inside").agg(F.max("a").alias("longer"))
    free = scored.join(held.select(F.col("lang").alias("_l"), "inside", "longer"), (F.col("lang") == F.col("_l")) & (F.col("phrase") == F.col("inside")), "left").where(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * percent))
    # first within a language's salt, so that what one task ranks for a language is at most salts times top rows
    order = [F.desc("best.score"), F.desc("a"), F.asc("phrase")]
    ahead = free.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("_r") <= top)
    free = ahead.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return free.where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score")
