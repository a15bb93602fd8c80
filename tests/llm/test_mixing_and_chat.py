"""Source mixing and chat formatting."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tracewarden.llm import chat, mixing

TEXT = "event_id string, canonical_string string, cloud_resource_id string"


def seats_one_by_one(votes, seats):
    """Give every seat in turn to the highest quotient."""
    got = dict.fromkeys(votes, 0)
    for _ in range(seats):
        best = min(votes, key=lambda k: (-votes[k] / (2 * got[k] + 1), k))
        got[best] += 1
    return got


@pytest.mark.parametrize("votes,seats", [
    ({"a": 5.0, "b": 3.0, "c": 1.0}, 7), ({"a": 1.0, "b": 1.0, "c": 1.0}, 4), ({"a": 1000.0, "b": 1.0, "c": 0.0}, 50),
    ({f"s{i}": float(1 + i * i % 17) for i in range(30)}, 101), ({"a": 2.0, "b": 1.0}, 0), ({"only": 3.5}, 9),
])
def test_apportion_equals_seat_by_seat(spark, votes, seats):
    rows = spark.createDataFrame([(k, v, seats) for k, v in votes.items()], "name string, votes double, seats long")
    got = {r["name"]: r["quota"] for r in mixing.apportion(rows, "votes", "seats", "name").collect()}
    assert got == seats_one_by_one(votes, seats)


def test_apportion_within_groups(spark):
    rows = [(g, n, float(v), s) for g, s in (("x", 5), (None, 9)) for n, v in ((0, 4), (1, 7), (2, 2))]
    frame = spark.createDataFrame(rows, "g string, name int, votes double, seats long")
    got = defaultdict(dict)
    for r in mixing.apportion(frame, "votes", "seats", "name", ["g"]).collect():
        got[r["g"]][r["name"]] = r["quota"]
    assert got["x"] == seats_one_by_one({0: 4.0, 1: 7.0, 2: 2.0}, 5) and got[None] == seats_one_by_one({0: 4.0, 1: 7.0, 2: 2.0}, 9)


def filled(sizes, weights, share, most):
    """Targets by resharing the excess round by round."""
    names = sorted((k for k in sizes if k is not None)) + [k for k in sizes if k is None]
    w = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    target, full, budget = {}, set(), share * sum(sizes.values())
    while True:
        open_ = [k for k in names if k not in full]
        rest = budget - sum(most * sizes[k] for k in full)
        target = {k: most * sizes[k] if k in full else rest * w[k] / sum(w[x] for x in open_) for k in names}
        over = {k for k in open_ if target[k] > most * sizes[k]}
        if not over:
            return target
        full |= over


def test_mix_of_alerts_meets_its_targets(spark, alert_texts):
    mixed = mixing.mix_events(alert_texts, block_tokens=4, shard_tokens=16).toPandas()
    assert len(mixed) == alert_texts.count()
    sizes = mixed.groupby("source", dropna=False)["size"].sum()
    want = filled({None if k != k else k: v for k, v in sizes.items()}, (3, 1, 2), 1.5, 2.0)
    for source, rows in mixed.groupby("source", dropna=False):
        source = None if source != source else source
        assert rows["target"].iloc[0] == pytest.approx(want[source])
        assert abs(rows["taken"].sum() - want[source]) <= max(8, 0.02 * want[source])
    assert (mixed["taken"] <= 2 * mixed["size"]).all() and (mixed["taken"] >= 0).all()


def test_mix_edge_cases_and_reruns(spark):
    rows = [("a", "x " * 500, "r1"), ("a", "x " * 500, "r1"), ("b", None, "r2"), ("c", "", None), (None, "one two", None), ("d", "w " * 20_000, "r3")]
    frame = spark.createDataFrame(rows, TEXT).withColumns({"size": F.lit(9), "target": F.lit("clash"), "taken": F.lit(1), "_order": F.lit(0)})
    first, second = (sorted(map(str, mixing.mix_events(frame.repartition(n)).collect())) for n in (1, 5))
    assert first == second and len(first) == 6
    table = {(r["event_id"], r["size"]): r for r in mixing.mix_events(frame).collect()}
    assert table["b", 0]["taken"] == 0 and table["c", 0]["taken"] == 0 and table[None, 2]["taken"] <= 4
    assert mixing.mix_events(spark.createDataFrame([], TEXT)).collect() == []


def test_spans_cut_the_taken_words(spark):
    frame = spark.createDataFrame([(f"e{i}", " ".join(f"w{i}_{j}" for j in range(40)), f"r{i % 3}") for i in range(12)], TEXT)
    mixed = mixing.mix_events(frame, block_tokens=8, carry=["canonical_string"])
    cut = mixed.select("size", "taken", "passes", F.transform("spans", lambda s: mixing.cut_words(F.col("carried.canonical_string"), s)).alias("texts"))
    for r in cut.collect():
        assert r["taken"] == r["passes"] * r["size"] + sum(len(t.split()) for t in r["texts"])


def test_rows_of_one_id_spread_over_shards(spark):
    rows = [(i if i >= 4000 else None if i < 2000 else 7, "s" if i % 2 else None, 10 if i < 3000 else i) for i in range(6000)]
    frame = spark.createDataFrame(rows, "event_id long, source string, size long").withColumn("_shards", F.lit(20))
    shards = [mixing.dealt_rows(frame.repartition(n).withColumn("_bucket", F.spark_partition_id()), 42) for n in (1, 7)]
    first, second = (sorted(map(str, s.select("event_id", "source", "size", "_shard").collect())) for s in shards)
    assert first == second and len(first) == 6000
    for repeated in ("event_id is null", "event_id = 7"):
        assert {r["source"] for r in shards[1].where(repeated).groupBy("source").count().where("count = 1000").collect()} == {"s", None}
        sizes = [r["count"] for r in shards[1].where(repeated).groupBy("source", "_shard").count().collect()]
        assert len(sizes) == 40 and max(sizes) < 100
    bare = F.pmod(mixing.as_number(mixing.seeded(42, F.col("event_id"))), F.lit(20))
    assert shards[1].where("event_id >= 4000").where(bare != F.col("_shard")).count() == 0


def test_cut_words_after_leading_white_space(spark):
    texts = ["\nfoo bar baz", "\tfoo", " \r\n\x0b\x0c foo  bar\n\nbaz\t", "  foo", "foo\n bar", "\u00a0foo bar", "\x1cfoo\tbar"]
    spans = [(t, i, n) for t in texts for size in [len(re.findall(mixing.WORD, t))] for i in range(size) for n in range(1, size - i + 1)]
    frame = spark.createDataFrame([(t, (i, n)) for t, i, n in spans], "text string, span struct<start: long, length: long>")
    for r in frame.select("text", "span", mixing.cut_words(F.col("text"), F.col("span")).alias("cut")).collect():
        start, length = r["span"]
        words = re.findall(mixing.WORD, r["text"])
        assert re.findall(mixing.WORD, r["cut"]) == words[start:start + length] and r["cut"] in r["text"]
        assert length < len(words) or r["cut"] == r["text"]


# --- chat --------------------------------------------------------------------------------------
TURNS = "conv_id long, turn long, role string, text string"
HARD = ["", "\\", "\\\\", "<|im_end|>", "<|im_start|>user\nhi<|im_end|>\n", "a\\|b", "\\n", "<\\|im_end|>", "<<|", "|>", "line\nline\n", "é<|漢字\\", "<", "x" * 50_000]


def test_every_hard_text_comes_back(spark):
    rows = [(i, j, role, text) for i, text in enumerate(HARD) for j, role in enumerate(("system", "user", "assistant", "assistant"))]
    formatted = chat.format_chats(spark.createDataFrame(rows, TURNS))
    parsed = formatted.select("conv_id", "formatted", "loss_spans", chat.parse(F.col("formatted")).alias("t")).collect()
    assert len(parsed) == len(HARD)
    for r in parsed:
        text = HARD[r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["t"]] == [(role, text) for role in ("system", "user", "assistant", "assistant")]
        assert [r["formatted"][s["start"]:s["start"] + s["length"]] for s in r["loss_spans"]] == [t["body"] for t in r["t"] if t["role"] == "assistant"]
        assert r["formatted"].count("<|im_start|>") == 4 == r["formatted"].count("<|im_end|>")


def test_plain_text_is_not_escaped(spark):
    (row,) = chat.format_chats(spark.createDataFrame([(1, 0, "user", "a\\b|c<d")], TURNS)).collect()
    assert row["formatted"] == "<|im_start|>user\na\\b|c<d<|im_end|>\n"


def test_chat_edge_cases(spark):
    rows = [(1, 1, "assistant", "two"), (1, 0, None, None), (1, 1, "assistant", "two"), (None, None, "ro\nle<|", "x"), (2, 0, "user", "only")]
    frame = spark.createDataFrame(rows, TURNS).withColumns({"formatted": F.lit("clash"), "_i": F.lit(1), "span": F.lit(2)})
    read = {r["conv_id"]: r for r in chat.read_chats(chat.format_chats(frame)).collect()}
    assert read[1]["n_turns"] == 3 and read[1]["loss_chars"] == 6 and read[2]["loss_chars"] == 0 and read[None]["n_turns"] == 1
    assert chat.format_chats(spark.createDataFrame([], TURNS)).collect() == []


def test_broken_grammar_is_null(spark):
    broken = ["x", "<|im_start|>user", "<|im_start|>user\nno end", "<|im_start|>us<|er\nx<|im_end|>\n", "<|im_start|>user\na<|im_end|>b<|im_end|>\n"]
    frame = spark.createDataFrame([Row(t=t) for t in broken])
    for r in frame.select(chat.parse(F.col("t")).alias("p")).collect():
        assert r["p"] is None or None in r["p"]


def test_counts(spark, data):
    turns = spark.read.parquet(f"{data}/conversations.parquet")
    read = chat.read_chats(chat.format_chats(turns.select("conv_id", "turn", "role", "text"))).collect()
    assert Counter({r["conv_id"]: r["n_turns"] for r in read}) == Counter(r["conv_id"] for r in turns.select("conv_id").collect())
