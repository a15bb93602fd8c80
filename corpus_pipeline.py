"""Documents to packed training sequences, in five stages over the operators of ``tracewarden.llm``.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next
one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.llm import language, mixing, neardup, packing, toxicity
from tracewarden.llm.queries import PAYLOADS, vocabulary
from tracewarden.llm.storage import short_batches, written
from tracewarden.sources.tables import table

#: A text stays if its language has at least this posterior.
LANGUAGE_FROM = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents with a calibrated toxicity of 0.5 or more. Null and empty texts are scored too."""
    short_batches(spark)
    events = docs.withColumnsRenamed(PAYLOADS)
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "event_id")
    scored = toxicity.score_toxicity(events, toxicity.fit_toxicity(events, labels), carry=events.columns)
    return scored.where("predicted = 0").select("carried.*").toDF(*docs.columns)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents without a letter, those unlike the labelled texts of their best language
    (``known``), and short ones between languages."""
    short_batches(spark)
    events = docs.withColumnsRenamed(PAYLOADS)
    model = language.fit_languages(events, vocabulary("byte_bpe_50k.json"))
    found = language.identify_languages(events, model, carry=events.columns)
    good = (F.col("lang_pred") != language.UNKNOWN) & F.col("known") & (F.col("score") >= LANGUAGE_FROM)
    return found.where(good).select("carried.*").toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (five-word shingles, 0.8) the document with the smallest id stays.

    Texts are told apart by id. Where an id has several texts, or is null, each of its texts is compared under a
    number of its own, above the usual ids; rows that share id and text are one document and stay together.
    """
    short_batches(spark)
    several = docs.groupBy("doc_id").agg((F.min(F.xxhash64("text")) < F.max(F.xxhash64("text"))).alias("_several")).where("_several")
    keyed = docs.join(written(several, "shared-ids"), "doc_id", "left")
    own = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2).bitwiseOR(F.lit(1 << 62))
    plain = F.col("doc_id").isNotNull() & F.col("_several").isNull()
    keyed = keyed.withColumn("_key", F.when(plain, F.col("doc_id").cast("long")).otherwise(own)).drop("_several")
    classes = neardup.near_duplicates(keyed.select(F.col("_key").alias("event_id"), F.col("text").alias("canonical_string")), width=5, percent=80)
    gone = classes.where(~F.col("kept")).select(F.col("event_id").alias("_key")).distinct()
    return keyed.join(gone, "_key", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: whole copies, and the words taken once more.

    A document that the mix does not take goes. ``n_chars`` follows the text. Rows that share id, text
    and source are told apart only by number.
    """
    keyed = docs.withColumn("_h", F.md5(F.coalesce("text", F.lit(""))))
    mixed = mixing.mix_events(keyed.withColumnsRenamed(PAYLOADS), carry=["_h"]).where("taken > 0")
    key = F.struct("doc_id", "_h", "source").alias("_key")
    takes = mixed.select(
        F.struct(F.col("event_id").alias("doc_id"), F.col("carried._h").alias("_h"), "source").alias("_key"), "passes", "spans")
    single = keyed.withColumn("_key", key).drop("_h").dropDuplicates(["_key"])
    rows = single.join(takes, "_key")  # a take for each repeated row
    cut = F.transform("spans", lambda s: mixing.cut_words(F.col("text"), s))
    texts = F.concat(F.array_repeat("text", F.col("passes").cast("int")), cut)
    rows = rows.withColumn("text", F.explode(texts))
    return rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and offset."""
    short_batches(spark)
    packed = packing.pack_events(docs.withColumnsRenamed(PAYLOADS), vocabulary("byte_bpe_50k.json"), sequence_tokens=2048, end_id=1)
    return packed.withColumnsRenamed({"event_id": "doc_id", "event_tokens": "doc_tokens"})


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_languages),
    ("minhash_near_dedup", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("packing", pack_sequences),
]
#: Trained models and tokenizers are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
