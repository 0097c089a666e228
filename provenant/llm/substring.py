"""Substring dedup by suffix automata of reference shards.

A window is 50 consecutive words of a document; a word goes if it lies in a window whose words also start in a document
with a smaller doc_id. An automaton of every shard broadcast to every document would take work in proportion to shards times
documents, so a shard's automaton goes only where it can match: every window has a minimiser, the smallest hash of
its word 10-grams, equal windows have equal minimisers, and consecutive windows with one minimiser form a segment.
A shard holds the segments of one minimiser. Its automaton is grown by documents in rising order, and each segment is
streamed through it first: where its matching statistics reach 50 words, the window has been seen in a smaller document.

No shard is larger than ``SHARD_SEGMENTS``: one that would be (a passage that very many documents hold in different surroundings) is
split by the two smallest hashes of a window instead of the smallest, then by four, and so on up to the window itself. Equal
windows stay together at every step, so each part has its own automaton and nothing is compared across parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import drop_path, signed, small_batches, stored, text_key

WINDOW, GRAM = 50, 10
#: Distinct segments that one automaton is made of, at most, and windows that one segment has, at most: with some 70 words a segment
#: an automaton takes about 30 MB.
SHARD_SEGMENTS, SEGMENT_WINDOWS = 1_000, 1_000
#: How many of a window's smallest hashes tell its shard, step by step; the last stands for the whole window.
STEPS = (1, 2, 4, 8, 16, WINDOW)
#: Words with their hashes that a worker keeps.
CACHE_WORDS = 1_000_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

SEGMENTS = "shard long, hash_a long, hash_b long, doc_id long, key long, first int, n int, often boolean, segment binary"
PIECES = "up_shard long, up_a long, up_b long, at int, n int, shard long, hash_a long, hash_b long, low long, segment binary"


class SuffixAutomaton:
    """Generalised suffix automaton over words; each state knows the document whose text first made it."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.doc = [-1], [0], [-1]

    def _new(self, length: int, link: int, doc: int, edges: dict[bytes, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.doc.append(doc)
        return len(self.next) - 1

    def _clone(self, state: int, word: bytes, target: int) -> int:
        copy = self._new(self.length[state] + 1, self.link[target], self.doc[target], dict(self.next[target]))
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def add(self, words: list[bytes], doc: int) -> None:
        """Add a text; texts must come in rising order of doc, so a state's document is the smallest that holds it."""
        last = 0
        for word in words:
            if word in self.next[last]:
                target = self.next[last][word]
                last = target if self.length[target] == self.length[last] + 1 else self._clone(last, word, target)
                continue
            state, last = last, self._new(self.length[last] + 1, 0, doc, {})
            while state >= 0 and word not in self.next[state]:
                self.next[state][word] = last
                state = self.link[state]
            if state >= 0:
                target = self.next[state][word]
                self.link[last] = target if self.length[target] == self.length[state] + 1 else self._clone(state, word, target)

    def windows(self, words: list[bytes], size: int) -> list[int]:
        """For each window of ``size`` words, the smallest document that holds it, or -1: from the matching statistics."""
        out, state, length = [], 0, 0
        for at, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            if at >= size - 1:
                if length >= size:
                    while self.length[self.link[state]] >= size:
                        state = self.link[state]
                        length = self.length[state]
                    out.append(self.doc[state])
                else:
                    out.append(-1)
        return out


class WordHashes:
    """64-bit hashes of words, kept for the most recent ones."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known, digest = self.known, xxhash.xxh3_64_intdigest
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = digest(w)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def _rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words."""
    n = len(hashes) - size + 1
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = out * MULTIPLIER + hashes[i : i + n]
        out = (out ^ out >> np.uint64(31)) * MULTIPLIER
    return out ^ out >> np.uint64(29)


def minimisers(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """The minimiser of each window; none if there are fewer words than a window has."""
    if len(hashes) < window:
        return np.zeros(0, dtype=np.int64)
    least, span = _rolling(hashes, gram), window - gram + 1
    reach = 1
    while reach * 2 <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < span:
        least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
    return least.view(np.int64)


def finer(hashes: np.ndarray, smallest: int, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """A hash of each window's ``smallest`` least 10-gram hashes, or of the whole window if it has no more."""
    span = window - gram + 1
    if smallest >= span:
        return _rolling(hashes, window).view(np.int64)
    grams = np.lib.stride_tricks.sliding_window_view(_rolling(hashes, gram), span)
    least = np.sort(np.partition(grams, smallest - 1, axis=1)[:, :smallest], axis=1)
    out = np.zeros(len(least), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(smallest):
            out = (out ^ least[:, i]) * MULTIPLIER
            out ^= out >> np.uint64(29)
    return out.view(np.int64)


def segments(mins: np.ndarray, longest: int = SEGMENT_WINDOWS) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of each run with one minimiser; longer runs are cut."""
    first = np.flatnonzero(np.append(True, mins[1:] != mins[:-1])) if len(mins) else np.zeros(0, dtype=np.int64)
    count = np.diff(np.append(first, len(mins)))
    if len(count) and count.max() > longest:
        first = np.concatenate([np.arange(f, f + n, longest) for f, n in zip(first.tolist(), count.tolist())])
        count = np.diff(np.append(first, len(mins)))
    return first, count


def _minimiser_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    word_hashes = WordHashes()
    for batch in batches:
        found, docs, keys, numbers = [], [], [], []
        for doc, key, text in zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), batch.column("text").cast(pa.binary())):
            words = (text.as_py() or b"").split()
            if len(words) < WINDOW or doc is None:
                continue
            mins = minimisers(word_hashes(words))
            first, _ = segments(mins)
            found.append(mins[first])
            docs.append(np.full(len(first), doc, dtype=np.int64))
            keys.append(np.full(len(first), key, dtype=np.int64))
            numbers.append(np.arange(len(first), dtype=np.int32))
        columns = [np.concatenate(x) if x else np.zeros(0, dtype=t) for x, t in ((found, np.int64), (docs, np.int64), (keys, np.int64), (numbers, np.int32))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shard", "doc_id", "key", "no"])


def _digest(body: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(body)
    return signed(d >> 64), signed(d & (1 << 64) - 1)


def _segment_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their shared segments' numbers -> the segments."""
    word_hashes = WordHashes()
    kinds = [pa.int64()] * 5 + [pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
    names = [x.split()[0] for x in SEGMENTS.split(", ")]
    for batch in batches:
        rows: list[tuple] = []
        for doc, key, text, shared in zip(
            batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), batch.column("text").cast(pa.binary()), batch.column("shared").to_pylist()
        ):
            words = text.as_py().split()
            mins = minimisers(word_hashes(words))
            first, count = segments(mins)
            for item in shared:
                at, n = int(first[item["no"]]), int(count[item["no"]])
                body = b" ".join(words[at : at + n + WINDOW - 1])
                rows.append((int(mins[at]), *_digest(body), doc, key, at, n, item["often"], body))
                if len(rows) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names=names)


def _piece_batches(batches: Iterator[pa.RecordBatch], smallest: int) -> Iterator[pa.RecordBatch]:
    """Distinct segments of a shard that is too large -> their pieces by finer shards, each with the segment it lies in."""
    word_hashes = WordHashes()
    kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.int64()] * 4 + [pa.binary()]
    names = [x.split()[0] for x in PIECES.split(", ")]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names=names)

    for batch in batches:
        rows: list[tuple] = []
        for shard, a, b, low, segment in zip(*(batch.column(n).to_pylist() for n in ("shard", "hash_a", "hash_b", "low", "segment"))):
            words = segment.split(b" ")
            keys = finer(word_hashes(words), smallest)
            for at, n in zip(*(x.tolist() for x in segments(keys))):
                body = b" ".join(words[at : at + n + WINDOW - 1])
                rows.append((shard, a, b, at, n, int(keys[at]), *_digest(body), low, body))
            if len(rows) >= 20_000:
                yield out(rows)
                rows = []
        if rows:
            yield out(rows)


def shard_windows(found: list[tuple[list[bytes], int]], window: int = WINDOW) -> list[list[int]]:
    """Segments (words, smallest document) of one shard, by rising document -> for each of its windows the smallest document with it."""
    automaton, out = SuffixAutomaton(), []
    for words, doc in found:
        seen = automaton.windows(words, window)
        out.append([d if d >= 0 else doc for d in seen])
        if -1 in seen:
            automaton.add(words, doc)
    return out


def _shard_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct segments sorted by (shard, low) -> hashes, and each window's smallest document (null: ``low`` throughout)."""

    def settle(group: list[tuple]) -> list[tuple]:
        if len(group) == 1:
            return [(*group[0][:4], None)]
        # document ids may be negative: the automaton gets ranks
        ranks = {d: i for i, d in enumerate(sorted({g[3] for g in group}))}
        docs = list(ranks)
        seen = shard_windows([(g[4].split(b" "), ranks[g[3]]) for g in group])
        return [(*g[:4], [docs[r] for r in s]) for g, s in zip(group, seen)]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=["shard", "hash_a", "hash_b", "low", "lows"])

    group, done = [], []
    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in ("shard", "hash_a", "hash_b", "low", "segment"))):
            if group and group[0][0] != row[0]:
                done += settle(group)
                group = []
                if len(done) >= 20_000:
                    yield out(done)
                    done = []
            group.append(row)
    if group:
        done += settle(group)
    if done:
        yield out(done)


def _remove_batches(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, totals, removed, kept_text = [], [], [], []
        for doc, text, hits in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), batch.column("hits").to_pylist()):
            words = (text.as_py() or b"").split()
            n = len(words)
            if hits:
                steps = np.zeros(n + 1, dtype=np.int64)
                for h in hits:
                    at = np.array(h["some"]) if h["some"] is not None else np.arange(h["n"])
                    at = at + h["first"]
                    np.add.at(steps, at, 1)
                    np.add.at(steps, at + window, -1)
                keep = np.cumsum(steps[:-1]) == 0
                words = [words[i] for i in np.flatnonzero(keep)]
            ids.append(doc)
            totals.append(n)
            removed.append(n - len(words))
            kept_text.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, type=pa.int64()), pa.array(totals, type=pa.int64()), pa.array(removed, type=pa.int64()),
             pa.array(kept_text, type=pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"]
        )


SHARD = ["shard", "hash_a", "hash_b"]


def _automata(distinct: DataFrame) -> DataFrame:
    """``distinct(shard, hash_a, hash_b, low, segment)`` -> ``shard, hash_a, hash_b, low, lows``: each shard's automaton in one task."""
    return distinct.select(*SHARD, "low", "segment").repartition("shard").sortWithinPartitions("shard", "low", "hash_a", "hash_b").mapInArrow(
        _shard_batches, "shard long, hash_a long, hash_b long, low long, lows array<long>"
    )


def _smallest(often: DataFrame, step: int, shard_segments: int, scratch: list[str]) -> DataFrame:
    """As ``_automata``, for shards that may have more than ``shard_segments`` distinct segments.

    Those that do are cut into pieces by the next of ``STEPS``; equal pieces become one, and what is found for the pieces is put
    together again for the segments. The last step gives each window a shard of its own, so none is left too large.
    """
    if step + 1 == len(STEPS):
        return _automata(often)
    large = often.groupBy("shard").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > shard_segments).select(F.col("shard").alias("_l"))
    marked = often.join(large, F.col("shard") == F.col("_l"), "left")
    cut, path = stored(marked.where("_l IS NOT NULL").select(*SHARD, "low", "segment").mapInArrow(lambda b: _piece_batches(b, STEPS[step + 1]), PIECES), "pieces")
    scratch.append(path)
    done = _automata(marked.where("_l IS NULL"))
    if cut.isEmpty():
        return done
    pieces, path = stored(cut.groupBy(*SHARD, "segment").agg(F.min("low").alias("low")), "distinct-pieces")
    scratch.append(path)
    found = _smallest(pieces, step + 1, shard_segments, scratch)
    seen = found.select(F.col("shard").alias("_s"), F.col("hash_a").alias("_a"), F.col("hash_b").alias("_b"), F.col("low").alias("_low"), "lows")
    same = (F.col("shard") == F.col("_s")) & (F.col("hash_a") == F.col("_a")) & (F.col("hash_b") == F.col("_b"))
    lows = F.coalesce("lows", F.expr("array_repeat(_low, n)"))
    parts = cut.select("up_shard", "up_a", "up_b", "at", "n", *SHARD, F.col("low").alias("up_low")).join(seen, same).select(
        F.col("up_shard").alias("shard"), F.col("up_a").alias("hash_a"), F.col("up_b").alias("hash_b"), F.col("up_low").alias("low"), "at", lows.alias("lows")
    )
    whole = parts.groupBy(*SHARD, "low").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "lows"))), lambda p: p["lows"])).alias("lows"))
    return done.unionByName(whole)


def repeated_windows(docs: DataFrame, shard_segments: int = SHARD_SEGMENTS) -> DataFrame:
    """``docs(doc_id, key, text)`` -> ``doc_id, key, hits``: for each document, segments (first, n, some) with the windows that also
    start in a smaller document: those numbered in ``some``, or all n if it is null.

    1. Minimisers alone are dealt; those of one document end here. 2. Shared segments are cut from the texts and equal ones become one,
    with their smallest document, before they are shuffled. 3. Each shard's automaton; shards that would have more than ``shard_segments``
    distinct segments are split first, step by step. 4. The verdicts go back to the documents.
    """
    spark, scratch = docs.sparkSession, []
    mins, mins_path = stored(docs.mapInArrow(_minimiser_batches, "shard long, doc_id long, key long, no int"), "minimisers")
    shared = mins.groupBy("shard").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count(F.lit(1)).alias("n")).where("a < b").select(
        F.col("shard").alias("_s"), (F.col("n") > shard_segments).alias("often")
    )
    wanted = mins.join(shared, F.col("shard") == F.col("_s")).groupBy("doc_id", "key").agg(F.collect_set(F.struct("no", "often")).alias("shared"))
    texts = docs.join(wanted.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "shared"), (F.col("doc_id") == F.col("_d")) & (F.col("key") == F.col("_k")))
    cut, cut_path = stored(texts.select("doc_id", "key", "text", "shared").mapInArrow(_segment_batches, SEGMENTS), "segments")
    drop_path(spark, mins_path)
    scratch.append(cut_path)
    distinct = cut.groupBy(*SHARD, "segment").agg(F.min("doc_id").alias("low"), F.max("often").alias("often"))
    few = _automata(distinct.where("NOT often"))
    often, path = stored(distinct.where("often").drop("often"), "often")
    scratch.append(path)
    seen = few.unionByName(_smallest(often, 0, shard_segments, scratch)).select(
        F.col("shard").alias("_s"), F.col("hash_a").alias("_a"), F.col("hash_b").alias("_b"), "low", "lows"
    )
    same = (F.col("shard") == F.col("_s")) & (F.col("hash_a") == F.col("_a")) & (F.col("hash_b") == F.col("_b"))
    # the numbers of the windows whose smallest document is smaller than this one
    some = F.filter(F.transform("lows", lambda d, i: F.when(d < F.col("doc_id"), i).otherwise(F.lit(-1))), lambda i: i >= 0)
    hits = cut.drop("segment").join(seen, same).withColumn("some", some).where("(lows IS NULL AND low < doc_id) OR size(some) > 0")
    out, _ = stored(hits.groupBy("doc_id", "key").agg(F.collect_set(F.struct("first", "n", "some")).alias("hits")), "hits")
    for path in scratch:
        drop_path(spark, path)
    return out


def remove_repeated(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, n_words, n_removed, kept`` (the kept words, joined by one space): a row for each row.

    Null texts have no words. Rows with a null doc_id neither lose words nor count as a source of windows. Rows with one doc_id do not affect each
    other. An empty table gives an empty result. Windows are judged on the input.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), F.col("text").cast("string").alias("text"))
    hits = repeated_windows(base).select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "hits")
    joined = base.join(hits, (F.col("doc_id") == F.col("_d")) & (F.col("key") == F.col("_k")), "left").select("doc_id", "text", "hits")
    return joined.mapInArrow(lambda b: _remove_batches(b, WINDOW), "doc_id long, n_words long, n_removed long, kept string")
