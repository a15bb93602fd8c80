"""One registered query per operator: the given tables in, the contract's columns out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import chat, language, mixing, neardup, packing, phrases, quality, reference_sql, repeats, search, tokens, toxicity, urls, vectors
from .storage import short_batches

PAYLOADS = {"doc_id": "event_id", "text": "canonical_string", "source": "cloud_resource_id"}


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` under the names of the event tables."""
    short_batches(spark)
    return table(spark, sf_dir, "documents").withColumnsRenamed(PAYLOADS)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_events(payloads(spark, sf_dir), weights=(3, 1, 2), share=1.5, most=2.0)
    return mixed.select(F.col("event_id").alias("doc_id"), "size", "source_size", "target", "taken")


def remainder(key: str, divisor: int) -> Column:
    """crc32 of an id as text, modulo ``divisor``."""
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(divisor))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = payloads(spark, sf_dir)
    held_out = remainder("event_id", 4) == 2
    model = language.fit_languages(texts, vocabulary("byte_bpe_50k.json"), where=~held_out)
    found = language.identify_languages(texts, model).withColumn("held_out", held_out)
    return found.select(F.col("event_id").alias("doc_id"), "held_out", "lang_pred", "score")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    told = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", told), (-1, 1, "assistant", told)], "conv_id long, turn long, role string, text string")
    return chat.read_chats(chat.format_chats(turns.unionByName(extra)))


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = payloads(spark, sf_dir)
    manifest = tokens.write_token_shards(texts, vocabulary("word_bpe_49k.json"), end_id=2)
    return tokens.read_token_shards(spark, manifest, dict(texts.dtypes)["event_id"]).withColumnRenamed("event_id", "doc_id")


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), listed)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = neardup.near_duplicates(payloads(spark, sf_dir), width=4, percent=80)
    return classes.withColumnRenamed("event_id", "doc_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, labels = payloads(spark, sf_dir), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "event_id")
    held_out = remainder("event_id", 5) == 0
    model = toxicity.fit_toxicity(texts, labels, where=~held_out)
    scored = toxicity.score_toxicity(texts, model).withColumn("held_out", held_out)
    return scored.select(F.col("event_id").alias("doc_id"), "held_out", "score", "predicted")


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors_ = table(spark, sf_dir, "embeddings").withColumnsRenamed({"vec_id": "event_id", "embedding": "features"})
    return vectors.near_vectors(vectors_, threshold=0.9).withColumnRenamed("event_id", "vec_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_events(payloads(spark, sf_dir), vocabulary("byte_bpe_50k.json"), sequence_tokens=2048, end_id=1)
    return packed.withColumnsRenamed({"event_id": "doc_id", "event_tokens": "doc_tokens"})


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, labels = payloads(spark, sf_dir), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "event_id")
    judged = quality.judge_quality(texts, quality.fit_quality(texts, labels))
    return judged.withColumnRenamed("event_id", "doc_id")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").withColumnsRenamed({"item_id": "resource_id", "text": "canonical_string"})
    ranked = search.rank_events(payloads(spark, sf_dir), items, top=20)
    return ranked.withColumnsRenamed({"resource_id": "item_id", "event_id": "doc_id"})


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.remove_repeats(payloads(spark, sf_dir), window=13)
    return kept.select(F.col("event_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    mined = phrases.mine_phrases(payloads(spark, sf_dir), category="lang", longest=5, least=100, top=2000)
    return mined.withColumnRenamed("category", "lang")


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_language_id": op2_language_id,
    "op3_chat_format": op3_chat_format,
    "op4_token_shards": op4_token_shards,
    "op5_url_rules": op5_url_rules,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_toxicity": op7_toxicity,
    "op8_near_vectors": op8_near_vectors,
    "op9_packing": op9_packing,
    "op10_quality_rules": op10_quality_rules,
    "op11_ranked_search": op11_ranked_search,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_phrases": op13_phrases,
}
ORACLE_SQL = {
    "op1_mixing": reference_sql.MIX, "op3_chat_format": reference_sql.CHAT, "op5_url_rules": reference_sql.URLS,
    "op6_near_duplicates": reference_sql.NEAR_TEXTS, "op8_near_vectors": reference_sql.NEAR_VECTORS, "op11_ranked_search": reference_sql.SEARCH, "op12_substring_dedup": reference_sql.REPEATS,
    "op13_phrases": reference_sql.PHRASES,
}
