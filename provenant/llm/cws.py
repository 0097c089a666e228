"""Document fingerprints by consistent weighted sampling (DataFrame functions only).

A document is a bag of words, a word's weight its number of occurrences. For sample k, hashes of the
word give r ~ Gamma(2, 1), c ~ Gamma(2, 1) and b ~ U(0, 1); with t = floor(ln w / r + b) the sample's value
is ln a = ln c - r (t - b + 1), and the smallest value over the words is kept. It depends on the word
and t alone, so two documents share it with the probability sum(min w) / sum(max w), their generalised
Jaccard similarity. A fingerprint is the K values, 32 bits of each, as hex.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenant.llm.common import SPACES, text_key

#: Samples in a fingerprint, and samples computed side by side in one aggregation.
SAMPLES, ABREAST = 32, 8
#: What a document without words has for each sample.
NOTHING = "ffffffff"


def _unit(h: Column, shift: int, bits: int) -> Column:
    """``bits`` bits of a hash as a number strictly between 0 and 1."""
    part = F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1))
    return (part.cast("double") + F.lit(0.5)) * F.lit(2.0**-bits)


def _words(text: str) -> Column:
    """The words, a row for each occurrence, and empty texts between spaces that follow each other."""
    return F.explode(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "))


def sample_values(bags: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """``bags(*keys, term, w)``, one row for each word of a bag -> ``keys, g, s0 .. s7``: the smallest values.

    ``term`` is a hash (long), ``w`` its weight (> 0). Row g holds the samples from 8 g on. The caller's partitioning by some
    of ``keys`` is kept: then nothing is shuffled here.
    """
    if samples % ABREAST:
        raise ValueError(f"samples must be a multiple of {ABREAST}")
    wide = bags.select(*keys, "term", F.log("w").alias("lw"), F.explode(F.sequence(F.lit(0), F.lit(samples // ABREAST - 1))).alias("g"))
    out = []
    for j in range(ABREAST):
        seed = F.col("g") * F.lit(ABREAST) + F.lit(j)
        h1, h2 = F.xxhash64("term", seed), F.xxhash64("term", seed, F.lit(1))
        r = -F.log(_unit(h1, 0, 21) * _unit(h1, 21, 21))
        b = _unit(h1, 42, 21)
        lc = F.log(-F.log(_unit(h2, 0, 32) * _unit(h2, 32, 32)))
        t = F.floor(F.col("lw") / r + b)
        out.append(F.min(lc - r * (t.cast("double") - b + F.lit(1.0))).alias(f"s{j}"))
    return wide.groupBy(*keys, "g").agg(*out)


def fingerprint_text(values: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """``sample_values`` -> ``keys, fingerprint`` (8 hex digits for each sample)."""
    one = F.concat(*[F.lpad(F.lower(F.hex(F.xxhash64(f"s{j}").bitwiseAND(F.lit(0xFFFFFFFE)))), 8, "0") for j in range(ABREAST)])
    parts = [F.max(F.when(F.col("g") == g, F.col("_fp"))) for g in range(samples // ABREAST)]
    return values.withColumn("_fp", one).groupBy(*keys).agg(F.concat(*parts).alias("fingerprint"))


def likeness(a: str, b: str, samples: int = SAMPLES) -> Column:
    """Share of equal samples of two fingerprints: the estimate of their generalised Jaccard similarity."""
    same = sum(
        (F.when(F.substring(a, 8 * i + 1, 8) == F.substring(b, 8 * i + 1, 8), 1).otherwise(0) for i in range(1, samples)),
        F.when(F.substring(a, 1, 8) == F.substring(b, 1, 8), 1).otherwise(0),
    )
    return same / F.lit(float(samples))


def word_bags(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``texts(*keys, text)`` -> ``keys, term, w``. Rows with equal keys form one bag; nulls and empty texts give none."""
    words = texts.select(*keys, _words("text").alias("word")).where("word <> ''")
    return words.select(*keys, F.xxhash64("word").alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("w"))


def fingerprints(docs: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """``docs(*keys, text)`` -> ``keys, fingerprint``; ``keys`` must tell rows apart.

    A null or wordless text has the fingerprint of the empty bag. Equal texts have equal fingerprints.
    """
    found = fingerprint_text(sample_values(word_bags(docs, keys), keys, samples), keys, samples)
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    cond = on[0]
    for x in on[1:]:
        cond = cond & x
    renamed = found.select(*[F.col(k).alias(f"_{k}") for k in keys], "fingerprint")
    return docs.select(*keys).join(renamed, cond, "left").select(
        *keys, F.coalesce("fingerprint", F.lit(NOTHING * samples)).alias("fingerprint")
    )


def _last(among: Column) -> Column:
    """0-based place of the last of some sorted ids that is not above doc_id, the first of them being no larger.

    Written without lambda functions: their variables would keep Spark from reusing the exchange of the dealt texts.
    """
    at = F.array_position(F.sort_array(F.array_append(among, F.col("doc_id"))), F.col("doc_id"))
    return (at - 2 + F.array_contains(among, F.col("doc_id")).cast("int")).cast("int")


def _bucket(bounds: list[int], step: int = 64) -> Column:
    """0-based number of the last bound that is not above doc_id; null ids belong to the last bucket."""
    every, coarse = F.lit(bounds).cast("array<bigint>"), F.lit(bounds[::step]).cast("array<bigint>")
    first = _last(coarse) * step
    return F.when(F.col("doc_id").isNull(), F.lit(len(bounds) - 1)).otherwise(first + _last(F.slice(every, first + 1, F.lit(step))))


def _cuts(n: int) -> Column:
    return F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10 * n)


def _ranges(base: DataFrame, n: int, low: int | None, most: int, parts: int) -> tuple[DataFrame, int]:
    """Adds ``_at`` (number of the row's range of doc_id) and ``_leads`` (its id is the range's smallest); the number of ranges.

    Up to ``most`` ranges have their bounds in the plan. For more, each of ``most`` ranges is cut into up to ``parts`` by bounds of its own; these
    go to the tasks as a broadcast of at most most * parts numbers, 8 MB by default.
    """
    if low is None:
        return base.withColumn("_at", F.lit(0)).withColumn("_leads", F.lit(True)), 1
    bounds = [low]
    if n > 1:
        bounds = sorted({low, *base.agg(_cuts(min(n, most))).first()[0]})
    placed = base.withColumn("_at", _bucket(bounds).cast("int"))
    if n <= most:
        return placed.withColumn("_leads", F.col("doc_id").eqNullSafe(F.element_at(F.lit(bounds), F.col("_at") + 1))), len(bounds)
    own = placed.groupBy("_at").agg(F.sort_array(F.array_distinct(F.array_append(_cuts(min(parts, -(-n // most))), F.min("doc_id")))).alias("_own"))
    before = Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    table = own.select(F.col("_at").alias("_c"), "_own", F.coalesce(F.sum(F.size("_own")).over(before), F.lit(0)).cast("int").alias("_start"))
    total = table.agg(F.max(F.col("_start") + F.size("_own"))).first()[0]
    within = F.when(F.col("doc_id").isNull(), F.size("_own") - 1).otherwise(_last(F.col("_own")))
    fine = placed.join(F.broadcast(table), F.col("_at") == F.col("_c")).withColumn("_i", within)
    leads = F.col("doc_id").eqNullSafe(F.element_at("_own", F.col("_i") + 1))
    return fine.select("doc_id", "text", (F.col("_start") + F.col("_i")).alias("_at"), leads.alias("_leads")), total


def neighbours(docs: DataFrame, bucket_chars: int = 500_000, most_buckets: int = 4096, parts: int = 256) -> DataFrame:
    """``docs(doc_id, text)`` -> ``bucket, rid, spare, doc_id, text, next_text``: every row beside its successor.

    Rows are dealt by ranges of doc_id of about ``bucket_chars`` characters (bounds: approximate percentiles); the first
    row of each range is also sent, as a spare, behind the last of the range before (of the first, behind the very last).
    Within a range rows go by doc_id, then by a hash of the text, so repeated ids are well defined; null ids come last.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    seen = base.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.min("doc_id").alias("low")).first()
    n = max(1, min(most_buckets * parts, -(-(seen["chars"] or 0) // bucket_chars), seen["n"] or 1))
    place, total = _ranges(base, n, seen["low"], most_buckets, parts)
    own = F.struct(F.col("_at").alias("bucket"), F.lit(False).alias("spare"))
    extra = F.struct(F.pmod(F.col("_at") + F.lit(total - 1), F.lit(total)).cast("int").alias("bucket"), F.lit(True).alias("spare"))
    dealt = place.select(
        "doc_id", "text", text_key().alias("_key"), F.explode(F.when(F.col("_leads"), F.array(own, extra)).otherwise(F.array(own))).alias("_p")
    ).select("_p.bucket", "_p.spare", "doc_id", "text", "_key")
    # a join on bucket implies this filter on one side only; stated here, both sides read one exchange
    dealt = dealt.where("bucket IS NOT NULL").repartition(max(8, -(-total // 8)), "bucket")
    w = Window.partitionBy("bucket").orderBy("spare", F.col("doc_id").asc_nulls_last(), "_key")
    return dealt.withColumn("rid", F.row_number().over(w)).withColumn("next_text", F.lead("text").over(w)).drop("_key")


def edited(text: str = "text", other: str = "next_text") -> Column:
    """The text with its last half (code points, rounded down) replaced by as many first ones of the other text."""
    return F.expr(
        f"concat(left({text}, length({text}) - length({text}) div 2), coalesce(left({other}, int(length({text}) div 2)), ''))"
    )


def edit_report(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null text: empty. Every row has its row in the result, repeated ones too; a single row is its own successor.
    Empty table: empty result. The rows cross the network once, by range of doc_id; words, samples and fingerprints are
    all made where the row lies.
    """
    rows = neighbours(docs)
    keys = ["bucket", "rid"]
    both = rows.select(
        *keys, F.explode(F.array(
            F.struct(F.lit(0).alias("which"), F.col("text").alias("text")),
            F.struct(F.lit(1).alias("which"), F.when(~F.col("spare"), edited()).alias("text")),
        )).alias("_t")
    ).select(*keys, "_t.which", "_t.text")
    by = [*keys, "which"]
    values = sample_values(word_bags(both, by), by, samples)
    prints = fingerprint_text(values, by, samples).groupBy(*keys).agg(
        F.max(F.when(F.col("which") == 0, F.col("fingerprint"))).alias("_a"),
        F.max(F.when(F.col("which") == 1, F.col("fingerprint"))).alias("_b"),
    )
    empty = F.lit(NOTHING * samples)
    facts = rows.select(
        *keys, "spare", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(edited(), 256).alias("edited_sha256")
    )
    joined = facts.join(prints, keys, "left").withColumns(
        {"fingerprint": F.coalesce("_a", empty), "edited_fingerprint": F.coalesce("_b", empty)}
    )
    after = joined.withColumn("_next", F.lead("fingerprint").over(Window.partitionBy("bucket").orderBy("rid")))
    return after.where("NOT spare").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint", samples).alias("near_edited"),
        likeness("fingerprint", "_next", samples).alias("near_next"),
    )
