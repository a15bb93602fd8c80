"""Near-duplicate texts and vectors against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewarden.llm import neardup, vectors
from tracewarden.llm.components import components

TEXT = "event_id long, canonical_string string"


def union_find(ids, links):
    low = {i: i for i in ids}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        low[b] = a
    return {i: root(i) for i in ids}


def shingles(text, width):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").split()
    if not words:
        return frozenset()
    return frozenset(zip(*(words[i:] for i in range(width)))) if len(words) >= width else frozenset([tuple(words)])


def brute(rows, width=5, percent=80):
    sets = {i: shingles(t, width) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
             if (sets[a] and sets[b]) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    low = union_find(ids, links)
    return {i: (len(sets[i]), low[i], low[i] == i) for i in ids}


def near(frame, **options):
    return {r["event_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(frame, **options).collect()}


@pytest.mark.parametrize("case", range(3))
def test_components(spark, case):
    draw = random.Random(case)
    links = [(draw.randrange(400), draw.randrange(400)) for _ in range((150, 380, 900)[case])] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    low = union_find({x for link in links for x in link}, links)
    assert got == {i: c for i, c in low.items() if any(i in link for link in links if link[0] != link[1])}


def test_near_copies_and_chains(spark):
    draw = random.Random(1)
    rows, word = [], lambda: draw.choice("abcdefgh") + str(draw.randrange(400))
    for _ in range(40):
        text = [word() for _ in range(draw.randrange(20, 120))]
        for _ in range(draw.randrange(1, 7)):  # a drifting chain: neighbours are near, its ends are not
            rows.append((len(rows), " ".join(text)))
            text = list(text)
            for _ in range(draw.randrange(0, 3)):
                text[draw.randrange(len(text))] = word()
    base = [word() for _ in range(150)]
    for i in range(300):  # one hot group
        copy = list(base)
        for _ in range(draw.randrange(0, 5)):
            copy[draw.randrange(len(copy))] = word()
        rows.append((len(rows), " ".join(copy)))
    rows += [(5000 + i, rows[0][1].upper()) for i in range(50)]
    assert near(spark.createDataFrame(rows, TEXT)) == brute(rows)
    assert near(spark.createDataFrame(rows, TEXT), width=4) == brute(rows, 4)


def test_strays_of_a_mixed_bucket_meet(spark, monkeypatch):
    """Texts that their bucket's smallest id does not link still find each other, in chunks of any size."""
    draw = random.Random(3)
    base = [f"w{draw.randrange(10**6)}" for _ in range(120)]
    family = [base[:60] + [f"f{k}x{i}" for i in range(60)] for k in range(4)]
    rows = []
    for k in range(4):
        for copy in range(6):
            words = list(family[k])
            words[-1 - copy % 2] += "z" * (copy // 2)
            rows.append((len(rows), " ".join(words)))
    texts = spark.createDataFrame(rows, "event_id long, text string")
    sketches = neardup.sketch_events(texts, 5).select(
        F.lit(0).alias("band"), F.lit(1).cast("long").alias("key"), "event_id", F.col("event_id").alias("component"), "n_shingles", "registers")
    monkeypatch.setattr(neardup, "MEMBERS", 4)
    needed = neardup.stray_members(sketches.select("band", "key", "event_id", "component", "n_shingles", "registers"), 0.8).persist()
    links = [(r["a"], r["b"]) for r in neardup.stray_links(needed, texts, 5, 80).collect()]
    want = brute(rows)
    assert union_find(range(24), links) == {i: c for i, (_, c, _) in want.items()} and len(set(c for _, c, _ in want.values())) == 4


def test_sketch_estimates(spark):
    draw = np.random.default_rng(5)
    for similarity, expected in ((0.9, True), (0.8, True), (0.4, False)):
        hits = 0
        for _ in range(40):
            shared = int(600 * similarity)
            pool = draw.integers(0, 1 << 63, 600, dtype=np.uint64)
            left = (600 - shared) // 2
            a, b = np.unique(pool[:shared + left]), np.unique(np.concatenate([pool[:shared], pool[shared + left:]]))
            x, y = neardup.registers_of(a), neardup.registers_of(b)
            hits += bool(neardup.likely(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([float(len(a))]), np.array([float(len(b))]), 0.8, neardup.LEAST_LIKELY)[0])
        assert hits == (40 if expected else 0)
    both = np.unique(draw.integers(0, 1 << 63, 500, dtype=np.uint64))
    assert (np.maximum(neardup.registers_of(both[:200]), neardup.registers_of(both[100:])) == neardup.registers_of(both)).all()  # mergeable


def test_text_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE  two"), (6, "é"), (7, "É"), (8, "long " + "word " * 30_000), (9, "long " + "word " * 29_999), (10, "a b c d e"), (11, "A b c d e ")]
    frame = spark.createDataFrame(rows, TEXT).withColumns({"key": F.lit(1), "text": F.lit("clash"), "n_shingles": F.lit(0)})
    assert near(frame) == brute(rows)
    assert near(frame.limit(0)) == {}
    twice = near(spark.createDataFrame([(1, "a b c"), (1, "x y z"), (2, "x y z"), (None, "x y z")], TEXT).where("event_id is not null"))
    assert twice[2][1] == 1 and twice[2][2] is False
    nulls = neardup.near_duplicates(spark.createDataFrame([(None, "x y z"), (4, "x y z")], TEXT)).collect()
    assert all(r["kept"] for r in nulls)


def test_alerts(spark, alert_texts):
    rows = [(r["event_id"], r["canonical_string"].replace("|", " ")) for r in alert_texts.collect()]
    frame = spark.createDataFrame(rows + [("zz" + k, t) for k, t in rows[:20]], "event_id string, canonical_string string")
    got = near(frame, width=2)
    assert got == brute([(r["event_id"], r["canonical_string"]) for r in frame.collect()], 2)
    assert sum(kept for _, _, kept in got.values()) == len(rows)


# --- vectors -----------------------------------------------------------------------------------
VEC = "event_id long, features array<float>"


def brute_vectors(rows, threshold=0.9):
    good = [(k, i, np.array(v, dtype=np.float64)) for k, (i, v) in enumerate(rows)
            if v is not None and None not in v and np.isfinite(np.array(v, dtype=float)).all() and np.any(v)]
    degree, links = dict.fromkeys(range(len(rows)), 0), []
    for p, (k, i, x) in enumerate(good):
        for m, j, y in good[p + 1:]:
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                degree[k] += 1
                degree[m] += 1
                links.append((i, j))
    low = union_find({i for i, _ in rows}, links)
    return sorted((i, degree[k], low[i], low[i] == i) for k, (i, _) in enumerate(rows))


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE_ROWS", 40)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(12, 24))
    x = np.concatenate([c + draw.normal(size=(25, 24)) * s for c, s in zip(centres, np.linspace(0.05, 0.5, 12))]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, (x[3] * (1 + i)).tolist()) for i in range(5)]
    rows += [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] * 24), (2003, [1.0, None]), (2004, [float("inf")] * 24), (2005, [3.0]), (2006, [4.0]), (2007, [-4.0]), (2008, [])]
    rows += [(1, x[40].tolist()), (3000, x[3].tolist()), (3001, x[3].tolist())]
    frame = spark.createDataFrame(rows, VEC).withColumns({"copies": F.lit("clash"), "_cell": F.lit(1), "label": F.lit(0)})
    assert sorted(map(tuple, vectors.near_vectors(frame).collect())) == brute_vectors(rows)
    assert vectors.near_vectors(frame.limit(0)).collect() == []
    (alone,) = vectors.near_vectors(spark.createDataFrame([(None, [1.0])], VEC)).collect()
    assert tuple(alone) == (None, 0, None, True)


def test_bound_is_rigorous():
    draw = np.random.default_rng(9)
    x = draw.normal(size=(200, 40))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = x + draw.normal(size=x.shape) * 0.07
    y /= np.linalg.norm(y, axis=1)[:, None]
    got = vectors.linked((*vectors.quantised(x), x), (*vectors.quantised(y), y), 0.9)
    assert (got == (np.einsum("ik,jk->ij", x, y) >= 0.9)).all() and 0 < got.sum() < got.size


def test_alert_features(spark, alert_texts):
    frame = alert_texts.select("event_id", F.array(F.element_at("features", "k"), F.element_at("features", "value")).alias("features"))
    rows = [(r["event_id"], r["features"]) for r in frame.collect()]
    assert sorted(map(tuple, vectors.near_vectors(frame, threshold=0.999).collect())) == brute_vectors(rows, 0.999)


def test_words_of_sets_match_plain_python():
    texts = ["A b C d e f", "a b", "x", "", None, "a\x0bb c d e"]
    sizes = [len(s) for s in neardup.shingle_sets(pa.array(texts), 5)]
    assert sizes == [len(shingles(t, 5)) for t in texts]
