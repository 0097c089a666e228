"""A corpus pipeline of five of the training-data operators; each stage is written as Parquet and reread as the next one's input.

Language ID -> line dedup -> SimHash near-dedup -> source mixing -> packing. All stages but the last return the columns of
``documents``; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.llm import langid, lines, mixing, packing, simhash
from provenant.llm.common import SPACES, stored, text_key

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Profiles are learnt from the labelled documents; those without any letter (or text) are rejected.

    ``lang`` becomes the predicted language, so later stages and unlabelled documents rely on what the text says.
    """
    profiles = langid.learn(docs)
    found = langid.identify(docs.select(*COLUMNS), profiles)
    return found.where(F.col("lang_pred") != langid.UNDETERMINED).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go; a document of which nothing but white space is left goes with them."""
    done = lines.remove_repeats(docs.select(*COLUMNS))
    kept = done.where("n_lines_removed = 0 OR text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'")
    return _recounted(kept).select(*COLUMNS)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document stays: the one with the smallest doc_id (null comes last), then with the least text hash.

    Groups are components of fingerprints, so documents without an id, or that share one, stay if their texts are not near-duplicates.
    """
    groups = simhash.near_duplicates(docs.select("doc_id", "text"))
    place = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "key")
    heads = groups.groupBy("root").agg(F.min(place).alias("_first")).select(F.col("_first.doc_id").alias("_doc"), F.col("_first.key").alias("_first"))
    unique = docs.select(*COLUMNS).withColumn("_key", text_key())
    kept = unique.join(heads, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_first")))
    return kept.dropDuplicates(["doc_id", "_key"]).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix that the sources' targets ask for: a document comes once for each full use; one cut short keeps its first words.

    Documents that the mix does not reach go. Each use has a training position of its own; rows are range-sorted by it.
    """
    keyed = docs.select(*COLUMNS).withColumn("_key", text_key())
    sizes, _ = stored(keyed.select("doc_id", "source", "_key", mixing.n_words().alias("size")), "sizes")
    mixed = mixing.mix(sizes).where("taken > 0").select(
        F.col("doc_id").alias("_d"), F.col("_key").alias("_k"), "size", "taken", "positions"
    ).dropDuplicates(["_d", "_k"])
    joined = keyed.join(mixed, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")))
    each = joined.select("*", F.posexplode("positions").alias("_use", "position")).withColumn("_words", F.least("size", F.col("taken") - F.col("_use") * F.col("size")))
    found = F.split(F.ltrim(F.translate("text", SPACES, " " * len(SPACES))), " +")
    words = F.array_join(F.slice(found, F.lit(1), F.col("_words").cast("int")), " ")
    cut = each.withColumn("text", F.when(F.col("_words") < F.col("size"), words).otherwise(F.col("text")))
    return mixing.schedule(_recounted(cut).select(*COLUMNS, "taken", "position")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of the mixed documents; ``copy`` tells a document's repeats apart."""
    return packing.pack(docs.select("doc_id", "text"), packing.default_tokenizer())


STAGES = [
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", simhash_stage),
    ("source mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Rank profiles, rolling and XXH64 hashes and a tokenizer are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
