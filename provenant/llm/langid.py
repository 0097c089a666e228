"""Language identification by rank-order profiles of character n-grams.

A profile is the list of a text's most frequent n-grams (1 to 3 letters, words padded with a blank), most frequent
first. A document's profile is compared with each language's by out-of-place distance: the sum of the rank
differences of the document's n-grams, ``PROFILE`` for those that the language's profile lacks. The nearest wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from provenant.llm.common import drop_path, small_batches, stored

#: N-grams in a profile.
PROFILE = 300
#: Bound on the training sample: about this many labelled documents of each language, chosen by a hash of doc_id and text.
SAMPLE_DOCS = 4_000
#: Languages whose profiles go to every task: 50 MB of ranks.
MOST_LANGUAGES = 20_000
#: Characters of one text counted at a time.
PART_CHARS = 1 << 20
UNDETERMINED = "und"
SHIFT = 21


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point: its lower-case letter, or 0 if it is no letter."""
    table = np.zeros(0x110000, dtype=np.int32)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            low = char.lower()
            table[point] = ord(low) if len(low) == 1 else point
    return table


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of a text and their numbers; both empty if it has no letter.

    A code holds up to three code points, 21 bits each, the first lowest; a blank is 1. Runs of anything but letters are one blank.
    """
    letters = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    is_letter = letters > 0
    if not is_letter.any():
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    one = np.ones(1, dtype=np.int32)
    line = np.concatenate([one, np.where(is_letter, letters, 1)[keep], one])
    blank = line == 1
    line = line[np.append(True, ~(blank[1:] & blank[:-1]))]
    # parts that share their last two characters with the next one's first
    found = [_part_counts(line[at : at + PART_CHARS + 2], at + PART_CHARS + 2 >= len(line)) for at in range(0, max(1, len(line) - 2), PART_CHARS)]
    if len(found) == 1:
        return found[0]
    codes, back = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
    return codes, np.bincount(back, weights=np.concatenate([n for _, n in found]), minlength=len(codes)).astype(np.int64)


def _part_counts(part: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Codes and numbers of the n-grams that start in this part of a line, but for its last two characters unless it is the last one."""
    line = part.astype(np.int64)
    blank = line == 1
    own = len(line) if last else len(line) - 2
    one = line[:own][~blank[:own]]
    two = (line[:-1] | line[1:] << SHIFT)[:own]
    three = (line[:-2] | line[1:-1] << SHIFT | line[2:] << 2 * SHIFT)[~blank[1:-1]]
    codes = np.concatenate([one, two, three])
    codes.sort()
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    return codes[first], np.diff(np.append(first, len(codes)))


def ranked(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The ``size`` most frequent codes, most frequent first, ties by code."""
    if len(codes) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        some = counts >= least
        codes, counts = codes[some], counts[some]
    return codes[np.lexsort((codes, -counts))][:size]


def _sum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their language -> n-gram counts, combined for each batch and language before the shuffle."""
    for batch in batches:
        by: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            by.setdefault(lang, []).append(ngram_counts(text))
        for lang, found in by.items():
            codes, back = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
            totals = np.bincount(back, weights=np.concatenate([n for _, n in found]), minlength=len(codes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(codes), type=pa.string()), pa.array(codes), pa.array(totals)], names=["lang", "code", "n"]
            )


def learn(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, profile: int = PROFILE) -> dict[str, list[int]]:
    """``labelled(doc_id, text, lang)`` -> the profile of each language. Null texts and languages teach nothing.

    About ``sample_docs`` documents of each language are used: those whose hash falls below the share of it that they are. The languages' sizes go to
    every task, so that no text is dealt by language; their number is checked before.
    The result is bounded by ``MOST_LANGUAGES`` times ``profile``; more languages are an error. Of a language's n-grams only the ``profile``
    best leave the task that summed them.
    """
    small_batches(labelled.sparkSession)
    base = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    sizes, sizes_path = stored(base.groupBy(F.col("lang").alias("_l")).count(), "languages")
    if sizes.limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    draw = F.pmod(F.xxhash64("doc_id", F.length("text"), F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = base.join(F.broadcast(sizes), F.col("lang") == F.col("_l")).where(draw < F.lit(float(sample_docs)) / F.col("count"))
    counted = chosen.select("text", "lang").mapInArrow(_sum_batches, "lang string, code long, n long")
    totals = counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = totals.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("place") <= profile)
    kept, path = stored(best.select("lang", "place", "code"), "profiles")
    found: dict[str, list[int]] = {}
    for row in kept.orderBy("lang", "place").collect():
        found.setdefault(row["lang"], []).append(row["code"])
    for done in (path, sizes_path):
        drop_path(labelled.sparkSession, done)
    return found


class Profiles:
    """Rank tables of all languages, for one look-up of a document's n-grams."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE) -> None:
        self.size, self.langs = size, sorted(profiles)
        self.codes = np.array(sorted({c for p in profiles.values() for c in p}), dtype=np.int64)
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, dtype=np.int64)
        for i, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.codes, profiles[lang]), i] = np.arange(len(profiles[lang]))

    def distances(self, text: str | None) -> np.ndarray | None:
        """Out-of-place distance to each language as a share of the largest possible one; None without letters."""
        codes, counts = ngram_counts(text) if text else (np.zeros(0, dtype=np.int64), None)
        if not len(codes) or not self.langs:
            return None
        top = ranked(codes, counts, self.size)
        at = np.minimum(np.searchsorted(self.codes, top), max(0, len(self.codes) - 1))
        at = np.where(self.codes[at] == top, at, len(self.codes)) if len(self.codes) else np.zeros(len(top), dtype=np.int64)
        ranks = self.ranks[at]
        away = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(top))[:, None]))
        return np.minimum(away, self.size).sum(axis=0) / (self.size * len(top))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language (ties: first by name) and 1 - its distance; no letter: undetermined, 0."""
        far = self.distances(text)
        if far is None:
            return UNDETERMINED, 0.0
        best = int(far.argmin())
        return self.langs[best], float(1 - far[best])


def _predict_batches(batches: Iterator[pa.RecordBatch], profiles: dict[str, list[int]], size: int) -> Iterator[pa.RecordBatch]:
    model = Profiles(profiles, size)
    for batch in batches:
        found = [model.predict(t) for t in batch.column("text").to_pylist()]
        rest = [batch.column(i) for i in range(batch.num_columns)]
        yield pa.RecordBatch.from_arrays(
            [*rest, pa.array([x[0] for x in found], type=pa.string()), pa.array([x[1] for x in found], type=pa.float64())],
            names=[*batch.schema.names, "lang_pred", "score"],
        )


def identify(docs: DataFrame, profiles: dict[str, list[int]], profile: int = PROFILE) -> DataFrame:
    """Adds ``lang_pred, score`` to rows with a ``text``; nothing but the whole text is looked at, and nothing is shuffled.

    Null texts and texts without a letter are ``und`` with score 0, as is every text if no language was learnt.
    Columns named lang_pred or score are replaced.
    """
    small_batches(docs.sparkSession)
    base = docs.drop("lang_pred", "score")
    schema = StructType([*base.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return base.mapInArrow(lambda b: _predict_batches(b, profiles, profile), schema)


def held_out(doc_id: str = "doc_id"):
    """True for the documents that nothing is learnt from: crc32 of the id's text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
