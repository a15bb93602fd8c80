"""The registered queries and the pipeline."""

import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracewarden.llm import queries
from tracewarden.llm.encoding import Encoder
from tracewarden.llm.queries import vocabulary

from ..test_queries import check


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_corpus_query_matches_reference_sql(spark, data, name):
    db = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "conversations", "benchmark"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    verdict = check.compare(queries.QUERIES[name](spark, data), db.execute(queries.ORACLE_SQL[name]))
    assert verdict.startswith("ok"), verdict


CONTRACT = {
    "op2_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op4_token_shards": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op7_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op9_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op10_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_contract_columns(spark, data, name):
    rows = queries.QUERIES[name](spark, data)
    assert set(CONTRACT[name]) <= set(rows.columns)
    found = {r[0] for r in rows.select("doc_id").distinct().collect()}
    assert found == {r[0] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id").collect()}


def test_held_out_folds(spark, data):
    from tracewarden.llm.queries import remainder

    for key, divisor in ((0, 4), (123456789, 5)):
        frame = spark.createDataFrame([(key,)], "event_id long").select(remainder("event_id", divisor).alias("r"))
        assert frame.first()["r"] == zlib.crc32(str(key).encode()) % divisor


def test_pipeline_stages(spark, data):
    """Stage by stage, every decision against its own operator or brute force."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "src0", 0), (10**6 + 2, "12 34", "en", "src0", 5)], docs.schema)
    docs = docs.unionByName(extra).persist()
    sizes = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, data).persist()
        sizes[name] = docs.count()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.schema == before.schema
        if name in ("toxicity", "language_id", "minhash_near_dedup"):
            kept = {r["doc_id"] for r in docs.collect()}
            assert kept <= {r["doc_id"] for r in before.collect()} and len(kept) == sizes[name] > 100
        if name == "language_id":
            assert not kept & {10**6, 10**6 + 1, 10**6 + 2}
        if name == "minhash_near_dedup":
            from .test_neardup import brute

            want = brute([(r["doc_id"], r["text"]) for r in before.collect()])
            assert kept == {i for i, (_, _, stays) in want.items() if stays}
        if name == "mix_sources":
            words = lambda frame: {r["source"]: r["n"] for r in frame.groupBy("source").agg(F.sum(F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))).alias("n")).collect()}
            old, new = words(before), words(docs)
            assert sum(new.values()) == pytest.approx(1.5 * sum(old.values()), rel=0.001) and all(new[k] <= 2 * old[k] for k in new)
    own = Encoder(vocabulary("byte_bpe_50k.json"), True)
    total = sum(len(own.tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in before.collect())
    packed = docs.toPandas()
    assert packed["length"].sum() == total and packed.groupby("sequence_id")["length"].sum().max() <= 2048
    assert np.array_equal(np.sort(packed["sequence_id"].unique()), np.arange(packed["sequence_id"].nunique()))


def test_pipeline_of_nothing(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
        assert docs.count() == 0, name


def test_mixing_stage_keeps_repeated_rows_apart(spark):
    docs = spark.createDataFrame([(1, "a b c d", "en", "s", 7), (1, "a b c d", "en", "s", 7), (2, "e f", "en", None, 3)], "doc_id long, text string, lang string, source string, n_chars long")
    mixed = corpus_pipeline.mix_sources(spark, docs, "").collect()
    assert sum(len(r["text"].split()) for r in mixed) == 15 and all(r["n_chars"] == len(r["text"]) for r in mixed)


def test_mixing_stage_gathers_no_repeated_rows(spark, capsys):
    docs = spark.createDataFrame([(1, "a b c d", "en", "s", 7)] * 300 + [(None, "e f", "en", None, 3)] * 200, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    mixed.explain()
    assert "collect_list" not in capsys.readouterr().out
    assert sum(len(r["text"].split()) for r in mixed.collect()) == 2400
    assert mixed.where("doc_id is null").count() > 0


def test_mixing_stage_keeps_words_after_leading_white_space(spark):
    texts = ["\na b c d", "\t\r\ne f", " \n g", "h i", "\x0bj", "\n\n"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    mixed = corpus_pipeline.mix_sources(spark, docs, "").collect()
    assert sum(len(r["text"].split()) for r in mixed) == 15 and all(r["text"] in texts[r["doc_id"]] and r["text"].strip() for r in mixed)
    assert {w for r in mixed for w in r["text"].split()} == set("abcdefghij")


def test_language_stage_drops_unlearned_languages(spark, data):
    from .test_models import FOREIGN

    docs = spark.read.parquet(f"{data}/documents.parquet")
    foreign = spark.createDataFrame([(i, t, None, "src0", len(t)) for i, t in FOREIGN.items()], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.keep_languages(spark, docs.unionByName(foreign), data).collect()}
    assert not kept & set(FOREIGN) and len(kept) > 100


def test_first_stages_keep_what_their_operators_keep(spark):
    from tracewarden.llm import language, toxicity

    big = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    planted = docs.join(labels.where("toxic is not null"), "doc_id").withColumn("doc_id", F.col("doc_id") + 10**7 * (1 + F.col("toxic"))).select(*docs.columns)
    docs = docs.unionByName(planted).persist()
    events = docs.withColumnsRenamed(queries.PAYLOADS)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, big).select("doc_id").collect()}
    model = toxicity.fit_toxicity(events, labels.withColumnRenamed("doc_id", "event_id"))
    assert kept == {r["event_id"] for r in toxicity.score_toxicity(events, model).where("predicted = 0").collect()}
    clean, toxic = ({r["doc_id"] for r in planted.where(f"doc_id >= {low} and doc_id < {low + 10**7}").collect()} for low in (10**7, 2 * 10**7))
    # with some fifty labelled toxic rows a few stay below 0.5; the larger tables lose none
    assert len(toxic) > 20 and len(toxic & kept) <= 0.25 * len(toxic) and len(clean & kept) > 0.95 * len(clean)
    kept = {r["doc_id"] for r in corpus_pipeline.keep_languages(spark, docs, big).select("doc_id").collect()}
    found = language.identify_languages(events, language.fit_languages(events, vocabulary("byte_bpe_50k.json")))
    assert kept == {r["event_id"] for r in found.where("lang_pred <> 'und' and known and score >= 0.5").collect()}


def test_near_duplicate_stage_loses_no_text_of_a_shared_id(spark):
    """Only copies go where an id, or no id, has several texts."""
    from tracewarden.llm import neardup  # noqa: F401 - the stage's operator

    t, u = " ".join(f"t{i}" for i in range(30)), " ".join(f"u{i}" for i in range(30))
    v, w = " ".join(f"v{i}" for i in range(30)), " ".join(f"w{i}" for i in range(30))
    rows = [(1, t), (2, t), (2, u), (None, v), (None, w), (None, t), (7, w), (8, None), (8, ""), (9, u)]
    docs = spark.createDataFrame([(i, x, "en", "s", 0) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(1, t), (9, u), (None, v), (7, w), (8, None), (8, "")], key=repr)


def test_pipeline_runs_to_its_end(spark, data):
    packed = corpus_pipeline.run(spark, data).toPandas()
    assert packed["length"].between(1, 2048).all() and packed.groupby("sequence_id")["length"].sum().max() <= 2048
    assert len(packed) > 100 and set(packed["doc_id"]) <= {r["doc_id"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
