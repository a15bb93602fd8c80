"""Ranked search, removal of repeats and phrases against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewarden.llm import bytewords, filters, phrases, repeats, search

WORDS = "the a of in log probe scan ip port over under again deny allow drop flow x y z".split()


def made_texts(seed=3, n=80):
    """Texts with shared passages, runs, periods, repeated rows, nulls and odd white space."""
    rng = random.Random(seed)
    passage = [rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(60)]
    texts = []
    for i in range(n):
        own = [rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(rng.randrange(0, 70))]
        if i % 3 == 0:
            at, a = rng.randrange(len(own) + 1), rng.randrange(40)
            own[at:at] = passage[a:a + rng.randrange(5, 40)]
        if i % 7 == 0:
            own += ["spam"] * rng.randrange(8, 60)
        if i % 11 == 0:
            own += ["ab", "cd"] * rng.randrange(5, 30)
        texts.append(rng.choice([" ", "\n", " \t ", "\r\n"]).join(own))
    texts += [texts[0], texts[9], None, "", " \n ", "word", "é" * 70 + " " + "ü" * 400, "\n" + texts[3] + " "]
    return texts


def numbered(spark, texts, extra=True):
    rows = [(i * 7 % 101 + 1000 * (i // 101), t, "c", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "event_id long, canonical_string string, text string, key int").repartition(5)


# --- words -----------------------------------------------------------------------------------------
@pytest.mark.parametrize("kinds,pattern", [
    (bytewords.byte_kinds(bytewords.WHITE_SPACE), r"[^\x20\x09-\x0D]+"), (search.KINDS, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")])
def test_words_of_bytes(kinds, pattern):
    texts = ["a b", "", None, "ab", "c", " x\ty ", "ÄÖ Z.9", "q" * 300, "q" * 299 + "r", "  a b"]
    words = bytewords.byte_words(pa.array(texts).slice(1), kinds)
    codes, distinct = words.coded()
    want = [re.findall(pattern, t or "") for t in texts[1:]]
    assert distinct.take(pa.array(codes)).to_pylist() == [w for ws in want for w in ws]
    assert np.diff(words.starts).tolist() == [len(w) for w in want]
    assert words.joined(np.ones(len(words), dtype=bool)).to_pylist() == [" ".join(w) for w in want]
    digests = words.digests()
    assert len(set(digests.tolist())) == len(distinct) and (phrases.digests_of_strings(distinct)[codes] == digests).all()


def test_filter_in_pieces(spark):
    names = np.random.default_rng(1).integers(-(1 << 63), (1 << 63) - 1, 50_000)
    made = spark.createDataFrame([(int(x),) for x in names], "name long")
    for most in (1 << 20, 1 << 12):
        bloom = filters.name_filter(made, 16, most)
        assert bloom.holds(names).all() and bloom.words.nbytes <= most
    others = np.random.default_rng(2).integers(-(1 << 63), (1 << 63) - 1, 10_000)
    assert filters.name_filter(made, 16, 1 << 20).holds(others).mean() < 0.02
    assert not filters.name_filter(made.limit(0), 16, 1 << 20).holds(others).any()


# --- repeats -----------------------------------------------------------------------------------------
def kept_words(rows, window):
    """The contract in plain Python: {(id, text): (words, removed, kept)}."""
    words = [(i, t, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    rank = lambda i: (i is None, i)  # noqa: E731 - null ids are the largest
    first = {}
    for i, _, w in words:
        for at in range(len(w) - window + 1):
            key = tuple(w[at:at + window])
            first[key] = min(first.get(key, rank(i)), rank(i))
    out = []
    for i, _, w in words:
        gone = {j for at in range(len(w) - window + 1) if first[tuple(w[at:at + window])] < rank(i) for j in range(at, at + window)}
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [13, 5, 1])
def test_repeats_against_brute_force(spark, window):
    df = numbered(spark, made_texts())
    got = sorted((tuple(r) for r in repeats.remove_repeats(df, window=window).collect()), key=repr)
    assert got == kept_words([(r["event_id"], r["canonical_string"]) for r in df.collect()], window)


def test_repeats_with_text_null_and_repeated_ids(spark):
    texts = made_texts(5, 30)
    rows = [(None if i % 5 == 0 else f"e{i % 12:02d}", t) for i, t in enumerate(texts)] + [(None, texts[0]), ("e03", texts[3]), ("e03", texts[3])]
    df = spark.createDataFrame(rows, "event_id string, canonical_string string").repartition(4)
    got = sorted((tuple(r) for r in repeats.remove_repeats(df).collect()), key=repr)
    assert got == kept_words(rows, 13)


def test_repeats_of_nothing(spark):
    empty = spark.createDataFrame([], "event_id long, canonical_string string")
    assert repeats.remove_repeats(empty).collect() == []


def test_repeats_of_alerts(spark, alert_texts):
    """A replayed alert keeps only what differs from the first one."""
    spaced = alert_texts.select("event_id", F.regexp_replace("canonical_string", r"\|", " ").alias("canonical_string"))
    replayed = spaced.unionByName(spaced.select(F.concat(F.lit("z-"), "event_id").alias("event_id"), F.concat(F.lit("again "), "canonical_string").alias("canonical_string")))
    got = sorted((tuple(r) for r in repeats.remove_repeats(replayed).collect()), key=repr)
    assert got == kept_words([tuple(r) for r in replayed.collect()], 13)
    replays = [r for r in got if r[0].startswith("z-") and r[1] >= 14]
    assert replays and all(r[2] >= r[1] - 1 for r in replays)


def test_equal_windows_have_equal_anchors():
    rng = random.Random(8)
    for window in (13, 6, 2):
        own = repeats.Slice(pa.record_batch({"text": pa.array(made_texts(rng.randrange(99)))}), window)
        which, names, first = own.anchors()
        seen, wide = {}, window + 1 - max(1, (window + 1) // 2 - 1)
        for at, k in zip(own.windows.tolist(), which.tolist()):
            assert at <= first[k] and first[k] + wide <= at + window
            assert seen.setdefault(tuple(own.digests[at:at + window].tolist()), names[k]) == names[k]


def test_equal_passages_share_interior_symbols():
    rng = random.Random(4)
    passage = [f"w{rng.randrange(500)}" for _ in range(200)]
    texts = [" ".join([f"a{i}" for i in range(k)] + passage + [f"b{k}"] * 3) for k in (0, 3, 17)]
    own = repeats.Slice(pa.record_batch({"text": pa.array(texts)}), 13)
    begin, end = own.doubles()
    names = own.names(begin, end, 1)[0]
    of = [set(names[own.text_of(begin) == i].tolist()) for i in range(3)]
    assert len(of[0] & of[1] & of[2]) >= 5


# --- phrases -----------------------------------------------------------------------------------------
def mined(rows, longest, least, top):
    """The contract in plain Python."""
    counts, total = defaultdict(Counter), Counter()
    for kind, text in rows:
        kind = "und" if kind is None else kind
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[kind] += len(w)
            counts[kind].update(tuple(w[i:i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for kind, found in counts.items():
        good = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        inner = {q[i:i + k] for q in good for k in range(2, len(q)) for i in range(len(q) - k + 1) if good[q] >= good[q[i:i + k]]}
        rows = []
        for p, a in good.items():
            if p not in inner:
                score, k = min((1000 * a * total[kind] // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        out += [(kind, r + 1, p.decode(), -a, x, y, total[kind], -s) for r, (s, a, p, x, y) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def spoken(seed, n):
    rng = random.Random(seed)
    chains = ["over and out", "time out of mind", "port scan on the host", "a a a a a a a"]
    rows = []
    for i in range(n):
        parts = [rng.choice([*chains, rng.choice(WORDS), f"u{rng.randrange(999)}"]) for _ in range(rng.randrange(1, 40))]
        text = "".join(p + rng.choice([" ", " ", "\t", ". ", ", ", "\n", "!?"]) for p in parts)
        rows.append((rng.choice(["en", "fr", None, "und"]), text.upper() if i % 4 == 0 else text))
    return rows + [(None, None), ("en", ""), ("xx", "..."), ("en", "É é " * 30)]


@pytest.mark.parametrize("longest,least,top", [(5, 20, 2000), (3, 5, 7), (2, 1, 50)])
def test_phrases_against_brute_force(spark, longest, least, top):
    rows = spoken(longest, 250)
    df = spark.createDataFrame([(k, t, "n", 1) for k, t in rows], "threat_category string, canonical_string string, word string, n int").repartition(6)
    got = sorted(tuple(r) for r in phrases.mine_phrases(df, longest=longest, least=least, top=top).collect())
    assert got == mined(rows, longest, least, top)


def test_phrases_when_prefixes_are_split(spark, monkeypatch):
    """With every common prefix split, counts come from several routes and are the same."""
    monkeypatch.setattr(phrases, "ROUTE_WORDS", 40)
    rows = spoken(9, 200)
    df = spark.createDataFrame(rows, "threat_category string, canonical_string string").repartition(4)
    assert sorted(tuple(r) for r in phrases.mine_phrases(df, least=10).collect()) == mined(rows, 5, 10, 2000)


def test_phrases_of_nothing(spark):
    assert phrases.mine_phrases(spark.createDataFrame([], "threat_category string, canonical_string string")).collect() == []
    few = spark.createDataFrame([("en", "one two")], "threat_category string, canonical_string string")
    assert phrases.mine_phrases(few).collect() == []


def test_quicksort_counts_every_prefix():
    rng = np.random.default_rng(6)
    size = rng.integers(1, 6, 5000)
    table = np.where(np.arange(5) < size[:, None], rng.zipf(1.6, (5000, 5)).clip(1, 50), 0)
    weights, want = rng.integers(1, 4, 5000), Counter()
    for row, n, w in zip(table.tolist(), size.tolist(), weights.tolist()):
        want.update({tuple(row[:k]): w for k in range(1, n + 1)})
    for least in (1, 30):
        got = {tuple(table[p, :d].tolist()): n for ps, ns, d in phrases.equal_partitions(table, weights, np.zeros(5000), least) for p, n in zip(ps.tolist(), ns.tolist())}
        assert got == {k: n for k, n in want.items() if n >= least}


# --- search -----------------------------------------------------------------------------------------
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def best_records(records, watched, top):
    counted = [(i, Counter(terms_of(t))) for i, t in records]
    counted = [(i, c) for i, c in counted if c]
    n_all, words, df = len(counted), sum(sum(c.values()) for _, c in counted), Counter(t for _, c in counted for t in c)
    out = []
    for name, text in watched:
        rows = []
        for i, c in counted:
            m = 75 + 25 * sum(c.values()) * n_all // words
            w = lambda t: math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1)))
            score = sum(w(t) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms_of(text) if c[t])
            if score:
                rows.append((-score, i is None, i))
        out += [(name, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(rows, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("top", [20, 3])
def test_search_against_brute_force(spark, top, monkeypatch):
    monkeypatch.setattr(search, "GATHERED_KEYS", 300)
    monkeypatch.setattr(search, "SEARCH_TERMS", 60)
    rng = random.Random(2)
    texts = made_texts(7, 150)
    records = [(None if i % 41 == 0 else i % 90, t) for i, t in enumerate(texts)] + [(7, texts[4])] * 30
    watched = [(k, " ".join(rng.choice(["spam", "ab", "the1", "ZZZ", *(texts[k] or "x").split()[:30], "Scan4"]) for _ in range(12))) for k in range(12)]
    watched += [(90, None), (91, "  .. "), (92, "nowhere"), (93, "spam"), (93, "spam"), (None, "cd cd spam")]
    df = spark.createDataFrame([(i, t, "h") for i, t in records], "event_id long, canonical_string string, h string").repartition(5)
    asked = spark.createDataFrame(watched, "resource_id long, canonical_string string")
    got = search.rank_events(df, asked, top=top)
    assert got.columns == ["resource_id", "rank", "event_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == best_records(records, watched, top)


def test_bounds_are_never_below_the_scores():
    texts = [t for t in made_texts(11, 60) if terms_of(t)]
    block = search.Searches([0, 1], pa.array(["spam", "ab", "cd", "the1"], pa.large_string()), np.array([0, 1, 2, 3, 3]), np.array([0, 2, 5]))
    block.records, block.words, block.weights = 60, 3000, np.array([900, 700, 600, 1500])
    level = np.array([np.searchsorted(search.LEVELS, Counter(terms_of(t))[w], side="right") for t in texts for w in ("spam", "ab", "cd", "the1")])
    digests = phrases.digests_of_strings(block.terms)
    bits = np.zeros((512, len(texts)), dtype=bool)
    for i, k in enumerate(level.tolist()):
        for rank in range(k):
            for place in search._places(search._key_of(digests[[i % 4]], rank), 512):
                bits[place, i // 4] = True
    sizes = np.array([len(terms_of(t)) for t in texts])
    bounds = search.block_bounds(block, digests, sizes, 512, np.packbits(bits, axis=1, bitorder="little").tobytes())
    for r, t in enumerate(texts):
        c, m = Counter(terms_of(t)), int(block.shrink(sizes[[r]])[0])
        for s in range(2):
            score = sum(int(block.weights[k]) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for k, w in ((int(k), block.terms[int(k)].as_py()) for k in block.flat[block.starts[s]:block.starts[s + 1]]) if c[w])
            assert score <= bounds[s, r]


def test_search_with_text_ids_and_nothing(spark, alert_texts):
    asked = alert_texts.select(F.col("cloud_resource_id").alias("resource_id"), "canonical_string").limit(5)
    got = search.rank_events(alert_texts, asked, top=3).collect()
    want = best_records_text([tuple(r) for r in alert_texts.select("event_id", "canonical_string").collect()], [tuple(r) for r in asked.collect()], 3)
    assert sorted((tuple(r) for r in got), key=repr) == want
    none = alert_texts.limit(0)
    assert search.rank_events(none, asked).collect() == [] and search.rank_events(alert_texts, asked.limit(0)).collect() == []


def best_records_text(records, watched, top):
    names = sorted(i for i, _ in records)
    number = {name: k + 1 for k, name in enumerate(names)}
    found = best_records([(number[i], t) for i, t in records], watched, top)
    return sorted(((r, k, names[i - 1], s) for r, k, i, s in found), key=repr)
