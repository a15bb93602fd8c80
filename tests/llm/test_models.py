"""Language, toxicity and quality models; URL rules."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewarden.llm import language, quality, toxicity, urls
from tracewarden.llm.queries import payloads, remainder, vocabulary

TEXT = "event_id long, canonical_string string"
BIG = "/root/testdata/sf0.01"


# --- language ----------------------------------------------------------------------------------
def test_forward_sums_all_segmentations():
    pieces = sorted(["▁", "a", "b", "▁a", "ab", "▁ab", "ba", "bab"])
    log_p = np.log(np.random.default_rng(1).dirichlet(np.ones(len(pieces)), 2).T)
    lattice = language.Lattice(pieces)
    words = ["ab", "babab", "a", "abba", "axb"]
    arcs, lengths = lattice.arcs(words)
    total = language.forward(arcs, log_p, -16.0)
    back = language.backward(arcs, lengths, log_p, -16.0)
    index = {p: i for i, p in enumerate(pieces)}
    for w, word in enumerate(words):
        text = "▁" + word
        for k in range(2):
            mass = 0.0
            for cuts in itertools.product((0, 1), repeat=len(text) - 1):
                parts, last = [], 0
                for i, c in enumerate((*cuts, 1), 1):
                    if c:
                        parts.append(text[last:i])
                        last = i
                scores = [log_p[index[p], k] if p in index else (-16.0 if len(p) == 1 else -math.inf) for p in parts]
                mass += math.exp(sum(scores))
            assert total[w, lengths[w], k] == pytest.approx(math.log(mass))
            assert back[w, 0, k] == pytest.approx(math.log(mass))


def test_long_pieces_and_words_are_not_cut():
    pieces = language.vocabulary_pieces(vocabulary("byte_bpe_50k.json"))
    assert "▁international" in pieces
    log_p = np.log(np.random.default_rng(2).dirichlet(np.ones(len(pieces)), 2).T)
    model = language.LanguageModel(["a", "b"], pieces, log_p, np.zeros(2))
    words = ["", "a", "international" * 9, "donaudampfschifffahrtsgesellschaftskapitän" * 3, "x" * 31, "x" * 32, "x" * 33, "漢" * 70, "the" * 400]
    for word, scores in zip(words, model.word_scores(words)):
        arcs, lengths = model.lattice.arcs([word])
        assert scores == pytest.approx(language.forward(arcs, log_p, model.other)[0, lengths[0]])
        text, states = "▁" + word, [1.0] + [0.0] * (len(word) + 1)
        if len(word) < 40:
            for e in range(1, len(text) + 1):
                states[e] = sum(states[b] * math.exp(log_p[model.lattice.number[text[b:e]], 0]) for b in range(e) if text[b:e] in model.lattice.number)
            assert scores[0] == pytest.approx(math.log(states[-1]))
    some = sorted([(w, 0, 1) for w in words], key=lambda r: len(r[0]))
    assert [r for lot in language.lots(some, 10_000) for r in lot] == some


@pytest.fixture(scope="module")
def languages(spark):
    texts = payloads(spark, BIG)
    return language.fit_languages(texts, vocabulary("byte_bpe_50k.json"), where=remainder("event_id", 4) != 2, max_rows_per_language=60, rounds=3)


def test_held_out_languages(spark, languages):
    texts = payloads(spark, BIG).where((remainder("event_id", 4) == 2) & F.col("lang").isNotNull())
    found = language.identify_languages(texts, languages, carry=["lang"]).select("lang_pred", "score", "carried.lang").toPandas()
    assert (found["lang_pred"] == found["lang"]).mean() > 0.98 and found["score"].between(0, 1).all()


def test_language_edge_cases(spark, languages):
    rows = [(1, None), (2, ""), (3, "123 !! \n"), (4, "the " * 40_000), (4, "the the"), (None, "der die und"), (5, "漢字"), (6, "a" * 5000)]
    frame = spark.createDataFrame(rows, TEXT).withColumns({"lang_pred": F.lit("clash"), "text": F.lit("clash"), "score": F.lit(7)})
    got = language.identify_languages(frame, languages).collect()
    by = {(r["event_id"], r["lang_pred"] == "und") for r in got}
    assert len(got) == 8 and {(1, True), (2, True), (3, True), (4, False), (5, False), (6, False), (None, False)} == by
    assert all(0 <= r["score"] <= 1 for r in got)
    assert language.identify_languages(frame.limit(0), languages).collect() == []
    blank = language.fit_languages(spark.createDataFrame([(1, "x", None)], TEXT + ", lang string"), vocabulary("byte_bpe_50k.json"))
    assert {r["lang_pred"] for r in language.identify_languages(frame, blank).collect()} == {"und"}


FOREIGN = {
    10**7: "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem",
    10**7 + 1: "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα",
    10**7 + 2: "人人生而自由 在尊严和权利上一律平等",
    10**7 + 3: "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto",
}


def test_texts_of_unlearned_languages_are_not_known(spark, languages):
    rows = [*FOREIGN.items(), (1, "All human beings are born free and equal in dignity and rights"), (2, "Alle Menschen sind frei und gleich geboren"), (3, "house"), (4, "12 !")]
    found = {r["event_id"]: r for r in language.identify_languages(spark.createDataFrame(rows, TEXT), languages).collect()}
    assert {k for k, r in found.items() if r["known"]} == {1, 2, 3}
    assert sum(r["score"] >= 0.5 for k, r in found.items() if k in FOREIGN) >= 3  # the posterior alone would keep them
    own = language.identify_languages(payloads(spark, BIG), languages)
    assert own.where("lang_pred <> 'und' and not known").count() == 0


# --- toxicity ----------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def toxic_model(spark):
    labels = spark.read.parquet(f"{BIG}/labels.parquet").withColumnRenamed("doc_id", "event_id")
    return toxicity.fit_toxicity(payloads(spark, BIG), labels, where=remainder("event_id", 5) != 0)


def test_held_out_toxicity(spark, toxic_model):
    labels = spark.read.parquet(f"{BIG}/labels.parquet").withColumnRenamed("doc_id", "event_id")
    rows = toxicity.score_toxicity(payloads(spark, BIG), toxic_model).join(labels, "event_id").where(remainder("event_id", 5) == 0).toPandas()
    clean, bad = rows[rows["toxic"] == 0], rows[rows["toxic"] == 1]
    assert (bad["score"].to_numpy()[:, None] > clean["score"].to_numpy()[None, :]).mean() > 0.9
    assert (clean["predicted"] == 0).mean() > 0.95 and (rows["predicted"] == (rows["score"] >= 0.5)).all()


def test_toxicity_edge_cases(spark, toxic_model):
    rows = [(1, None), (2, ""), (3, "word " * 50_000), (3, "word"), (None, "you idiot loser moron scum"), (4, "!!! ###"), (5, "漢字")]
    frame = spark.createDataFrame(rows, TEXT).withColumns({"features": F.lit("clash"), "prediction": F.lit(1.0), "raw": F.lit(2)})
    got = toxicity.score_toxicity(frame, toxic_model, carry=["prediction"]).collect()
    assert len(got) == 7 and all(0 <= r["score"] <= 1 for r in got)
    assert [r["score"] for r in got if r["event_id"] == 1] == [r["score"] for r in got if r["event_id"] == 2]
    assert toxicity.score_toxicity(frame.limit(0), toxic_model).collect() == []
    for label, want in ((1, 1), (0, 0), (None, 0)):
        one = toxicity.fit_toxicity(frame, spark.createDataFrame([(3, label)], "event_id long, toxic int"))
        assert {r["predicted"] for r in toxicity.score_toxicity(frame, one).collect()} == {want}


def test_look_alikes():
    assert toxicity.plain_forms("1d10t!!") == ("dt", "idiot") and toxicity.plain_forms("Stuuupid,") == ("stupid", "stupid")
    assert {"idiot", "^idio"} <= toxicity.terms_of("id!ot") | toxicity.terms_of("idiot")
    lexicon = toxicity.Lexicon({"idiot": (30, 0)}, 100, 900)
    assert lexicon.weight("idiot") > lexicon.weight("idiot", own=1) > 0 and lexicon.weight("house") == 0
    assert lexicon.word("1d10t")[2] and not lexicon.word("idiot")[2]


def test_one_rule_for_rare_terms_at_every_size(spark):
    for toxic in (30, 40, 41, 500):
        lexicon = toxicity.Lexicon({"two": (2, 0), "one": (1, 0)}, toxic, 900)
        assert lexicon.weight("one") == lexicon.weight("two", own=1) == 0 < lexicon.weight("two")
    for toxic in (40, 41):
        rows = [(i, f"vile word{i}" + " pair" * (i < 2) + " trio" * (i < 3)) for i in range(toxic)] + [(100 + i, "plain text") for i in range(60)]
        labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows], "event_id long, toxic int")
        terms = toxicity.fit_toxicity(spark.createDataFrame(rows, TEXT), labels, trees=1).lexicon.counts
        assert "trio" in terms and "pair" not in terms


# --- quality -----------------------------------------------------------------------------------
def base_by_hand(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] >= 2 for k in range(3)}
    lines, seen, twice = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            twice += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), twice, len(covered), failed


@pytest.fixture(scope="module")
def quality_model(spark):
    labels = spark.read.parquet(f"{BIG}/labels.parquet").withColumnRenamed("doc_id", "event_id")
    return quality.fit_quality(payloads(spark, BIG), labels, where=remainder("event_id", 5) != 0)


def test_base_statistics(spark, quality_model):
    draw = random.Random(8)
    rows = [(i, "".join(draw.choice(["a", "b", "é#", " ", " ", "\n", "\t", "🙂", "|x"]) for _ in range(draw.randrange(400)))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, "x y z " * 20_000), (502, "dup"), (None, "w"), (503, "line one\nline one\n\n \nline one\r\n")]
    frame = spark.createDataFrame(rows, TEXT).withColumns({"n_words": F.lit("clash"), "text": F.lit(1), "probability": F.lit(0)})
    got = quality.judge_quality(frame, quality_model).collect()
    table = sorted(((x["event_id"] or -1), x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"]) for x in got)
    assert table == sorted((i or -1, *base_by_hand(t)) for i, t in rows)
    assert not any(x["kept"] and x["base_failed"] for x in got)
    assert quality.judge_quality(frame.limit(0), quality_model).collect() == []


def test_held_out_quality(spark, quality_model):
    labels = spark.read.parquet(f"{BIG}/labels.parquet").withColumnRenamed("doc_id", "event_id")
    rows = quality.judge_quality(payloads(spark, BIG), quality_model).join(labels, "event_id").where(remainder("event_id", 5) == 0).toPandas()
    rows = rows[~rows["base_failed"]]
    assert (rows[rows["quality"] == 1]["kept"]).mean() > 0.97
    low = rows[rows["quality"] == 0]["probability"].to_numpy()
    assert (low[:, None] < rows[rows["quality"] == 1]["probability"].to_numpy()[None, :]).mean() > 0.9


def test_one_class_of_labels(spark):
    frame = spark.createDataFrame([(1, "good text " * 3 + " ".join(f"w{i}" for i in range(60)))], TEXT)
    for label, want in ((1, True), (0, False), (None, True)):
        model = quality.fit_quality(frame, spark.createDataFrame([(1, label)], "event_id long, quality int"))
        assert [r["kept"] for r in quality.judge_quality(frame, model).collect()] == [want]


def test_calibration_recovers_a_logistic_curve():
    draw = np.random.default_rng(3)
    x = draw.normal(size=20_000)
    y = (draw.uniform(size=20_000) < 1 / (1 + np.exp(-(2 * x - 1)))).astype(float)
    slope, offset = quality.calibrate(x, y, np.ones_like(x))
    assert slope == pytest.approx(2, abs=0.15) and offset == pytest.approx(-1, abs=0.1)
    x, y = np.append(x * 5, 60.0), np.append(y, 0.0)  # a far outlier
    slope, offset = quality.calibrate(x, y, np.ones_like(x))
    assert slope == pytest.approx(0.4, abs=0.05) and offset == pytest.approx(-1, abs=0.1)


# --- urls --------------------------------------------------------------------------------------
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("a.b", "", "block"), ("a.b", "/x", "allow"), ("A.b", "/x", "block"), ("net", "/ü", "block")]


def judged(url, rules=RULES):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, after = rest[:at], rest[at:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = after[: min([after.find(c) for c in "?#" if c in after], default=len(after))]
    fits = [(len(h.lower() + p), v, h.lower() + p) for h, p, v in rules if (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[1] if best else "allow"


def test_urls(spark):
    some = ["http://Example.ORG/es/1?q#f", "http://example.org", "http://x.example.org/es/", "https://notexample.org/es/", "a.b/x", "s://a.b", "s://c.a.b/x/y", "s://a.b?x",
            "s://k.net/üb", "", None, "://", "://host", "x://h/p://q", "http://org/", "http://a.b:80/x", "http://É.org/\n/z", "http://x.org/" + "p" * 50_000]
    rows = [(i, u) for i, u in enumerate(some)] + [(3, some[0]), (None, some[0])]
    frame = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit("clash"), "rule": F.lit(1), "verdict": F.lit(2)})
    listed = spark.createDataFrame(RULES + [(None, None, "block")], "host string, path string, verdict string")
    got = sorted(((r["page_id"] or -1), r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in urls.judge_urls(frame, listed.where("host is not null")).collect())
    want = sorted(((i or -1), h, p, rule or "", v) for i, u in rows for h, p, rule, v in [judged(u)])
    assert got == want
    assert urls.judge_urls(frame.limit(0), listed).collect() == []
    assert {r["verdict"] for r in urls.judge_urls(frame, listed.limit(0), otherwise="block").collect()} == {"block"}


def test_bloom_has_no_false_negative():
    draw = np.random.default_rng(6)
    keys, others = draw.integers(-(1 << 63), 1 << 63, 20_000), draw.integers(-(1 << 63), 1 << 63, 20_000)
    bloom = urls.BlockedBloom.sized(len(keys), 16, 1 << 20)
    bloom.add(keys)
    assert bloom.holds(keys).all() and bloom.holds(others).mean() < 0.01


def test_a_filter_too_small_costs_no_verdict(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    listed = spark.createDataFrame(RULES, "host string, path string, verdict string")
    small, large = (sorted(map(tuple, urls.judge_urls(pages, listed, most_bytes=n).collect())) for n in (32, 1 << 20))
    assert small == large


def test_sample_is_bounded_by_rows(spark):
    """One labelled id with very many rows and texts is one row of the sample."""
    from tracewarden.llm.labelled import labelled_sample

    rows = [(1, f"text {i}") for i in range(2000)] + [(i, f"other {i}") for i in range(2, 60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "event_id long, toxic int")
    got = labelled_sample(spark.createDataFrame(rows, TEXT).repartition(7), labels, "toxic", 1000).collect()
    assert len(got) == 59 and len({r["event_id"] for r in got}) == 59
    assert got[0].asDict().keys() == {"event_id", "text", "label", "weight", "fold"}
    again = labelled_sample(spark.createDataFrame(rows[::-1], TEXT).repartition(3), labels, "toxic", 1000).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_a_rule_fits_its_own_host_and_path_only(spark):
    """Host and path never run into each other, and hosts of very many labels cost no more than others."""
    listed = spark.createDataFrame([("a.co", "m/x", "block"), ("co", "/y", "block")], "host string, path string, verdict string")
    long = "http://" + "a." * 20_000 + "co/y"
    pages = spark.createDataFrame([(1, "http://a.com/x"), (2, "http://a.co/m/x"), (3, "http://b.a.co/y"), (4, long)], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge_urls(pages, listed).collect()}
    assert got == {1: (None, "allow"), 2: (None, "allow"), 3: ("co/y", "block"), 4: ("co/y", "block")}
