"""Encoding, wavelet shards, packing."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewarden.llm import packing, tokens
from tracewarden.llm.encoding import Encoder
from tracewarden.llm.queries import vocabulary
from tracewarden.llm.text import split_words
from tracewarden.llm.wavelet import WaveletMatrix

TEXT = "event_id long, canonical_string string"
FILES = {"word_bpe_49k.json": (False, 2), "byte_bpe_50k.json": (True, 1)}
HARD = [
    "", " ", "  ", "a  b", " a", "a ", "a\n b", "a \nb", "a b   c", "\n\n a", "a\n  b", "\r\n x\t y", "I'm don't  it's", "é é", "12 345", "Σας ΟΔΟΣ",
    "\x1c\x1d a", "​ a", "中文 字符 🙂🙂", "a  b", "tail\n\n", "x\x0b y\x0cz", "　　 a  b", "a\x85 b", "word " * 30_000,
]


@pytest.mark.parametrize("name", FILES)
def test_pieces_give_the_ids_of_the_text(name):
    spaced, end = FILES[name]
    own = Encoder(vocabulary(name), spaced)
    draw = random.Random(4)
    texts = HARD + ["".join(draw.choice("ab .,'s\n\t  éÉ1<|>") for _ in range(draw.randrange(40))) for _ in range(800)] + [None]
    for part in (texts, texts[::-1]):
        starts, ids = own.encode(pa.array(part, pa.string()), end)
        for i, text in enumerate(part):
            want = own.tokenizer.encode(text or "", add_special_tokens=False).ids + [end]
            assert ids[starts[i]:starts[i + 1]].tolist() == want, repr(text)


def test_words_split_on_ascii_space_alone():
    words = split_words(pa.array([" a b\x0bc\x0cd\t\r\ne ", None, "", "a\x1cb\xa0c"]))
    assert [[words.distinct[c] for c in words.of(i)] for i in range(4)] == [["a", "b", "c", "d", "e"], [], [], ["a\x1cb\xa0c"]]


@pytest.mark.parametrize("n,top", [(0, 5), (1, 5), (513, 3), (5000, 49408), (2000, 65536)])
def test_wavelet_matrix(n, top):
    ids = np.random.default_rng(n).integers(0, top, n).astype(np.uint16)
    matrix = WaveletMatrix.from_bytes(WaveletMatrix.build(ids, 16, ["x"], np.array([n])).to_bytes())
    assert (matrix.tokens() == ids).all() and matrix.ids == ["x"]
    for i in range(0, n, max(1, n // 37)):
        assert matrix.access(i) == ids[i]
    for token in {0, 1, top - 1, *ids[:5].tolist()}:
        at = np.flatnonzero(ids == token)
        assert matrix.count(token) == len(at) and matrix.rank(token, n // 2) == int((at < n // 2).sum())
        assert [matrix.select(token, k) for k in range(min(len(at), 3))] == at[:3].tolist() and matrix.select(token, len(at)) == -1
    assert matrix.count(70_000) == 0


def brute(rows, name):
    spaced, end = FILES[name]
    own, start, out = Encoder(vocabulary(name), spaced), 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = own.tokenizer.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_shards_read_back(spark, data):
    documents = spark.read.parquet(f"{data}/documents.parquet").select(F.col("doc_id").alias("event_id"), F.col("text").alias("canonical_string"))
    extra = spark.createDataFrame([(10**6, None), (-5, ""), (None, "no id"), (10**7, "long " * 40_000)], TEXT)
    frame = documents.unionByName(extra).withColumns({"tokens": F.lit(1), "shard": F.lit("clash")})
    manifest = tokens.write_token_shards(frame.repartition(7), vocabulary("word_bpe_49k.json"), shard_tokens=20_000)
    got = [tuple(r) for r in tokens.read_token_shards(spark, manifest, "bigint").collect()]
    want = brute([tuple(r) for r in frame.select("event_id", "canonical_string").collect()], "word_bpe_49k.json")
    assert sorted(got, key=lambda r: r[1]) == want and manifest.count() > 5


def test_shards_of_alerts_and_of_nothing(spark, alert_texts):
    manifest = tokens.write_token_shards(alert_texts.unionByName(alert_texts.limit(3)), vocabulary("word_bpe_49k.json"))
    got = tokens.read_token_shards(spark, manifest, "string").orderBy("start").collect()
    assert [r["event_id"] for r in got] == sorted(r["event_id"] for r in got) and len(got) == alert_texts.count() + 3
    empty = tokens.write_token_shards(alert_texts.limit(0), vocabulary("word_bpe_49k.json"))
    assert tokens.read_token_shards(spark, empty).collect() == []


def test_shortest_pack_first():
    patterns = packing.shortest_pack_first({7: 3, 5: 2, 3: 4, 2: 5, 1: 1}, 10)
    used = {}
    for lengths, count in patterns:
        assert sum(lengths) <= 10
        for x in lengths:
            used[x] = used.get(x, 0) + count
    assert used == {7: 3, 5: 2, 3: 4, 2: 5, 1: 1}
    assert packing.shortest_pack_first({}, 10) == []
    assert sum(c for _, c in packing.shortest_pack_first({1: 1_000_003}, 2048)) == 489
    random_lengths = {n: random.Random(n).randrange(1, 50) for n in range(1, 2049)}
    whole = sum(n * c for n, c in random_lengths.items())
    assert whole / (2048 * sum(c for _, c in packing.shortest_pack_first(random_lengths, 2048))) > 0.97


def test_packing_holds_every_id_once(spark, data):
    documents = spark.read.parquet(f"{data}/documents.parquet").select(F.col("doc_id").alias("event_id"), F.col("text").alias("canonical_string"))
    extra = spark.createDataFrame([(10**6, None), (-5, ""), (10**7, "long " * 10_000), (-5, "")], TEXT)
    frame = documents.unionByName(extra).withColumns({"length": F.lit("clash"), "offset": F.lit(0)})
    packed = packing.pack_events(frame, vocabulary("byte_bpe_50k.json"), sequence_tokens=512).toPandas().sort_values(["sequence_id", "offset"])
    ends = packed.groupby("sequence_id")["length"].cumsum() - packed["length"]
    assert (ends == packed["offset"]).all() and packed.groupby("sequence_id")["length"].sum().max() <= 512
    assert sorted(packed["sequence_id"].unique()) == list(range(packed["sequence_id"].nunique()))
    own = Encoder(vocabulary("byte_bpe_50k.json"), True)
    want = []
    for r in frame.collect():
        ids = np.array(own.tokenizer.encode(r["canonical_string"] or "", add_special_tokens=False).ids + [1], dtype="<u4")
        want += [(r["event_id"], at, len(ids[at:at + 512]), zlib.crc32(ids[at:at + 512].tobytes()), len(ids)) for at in range(0, len(ids), 512)]
    got = packed[["event_id", "start", "length", "ids_crc32", "event_tokens"]].itertuples(index=False)
    assert sorted(map(tuple, got)) == sorted(want)
    assert packing.pack_events(frame.limit(0), vocabulary("byte_bpe_50k.json")).collect() == []


def test_packing_of_alerts(spark, alert_texts):
    packed = packing.pack_events(alert_texts, vocabulary("byte_bpe_50k.json")).toPandas()
    assert set(packed["event_id"]) == {r["event_id"] for r in alert_texts.collect()}
    assert packed["length"].sum() / (2048 * packed["sequence_id"].nunique()) > 0.8
