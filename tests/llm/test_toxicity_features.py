"""Toxicity features against a plain version, word by word and text by text."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
import regex

from tracewarden.llm import toxicity as T


def plain_features(text, lexicon, strong, own):
    """The sixteen figures of one text."""
    words = regex.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if not n:
        return [0.0] * 16
    found = [lexicon.word(w, own) for w in words]
    row = []
    for k in range(2):
        value = [f[k] for f in found]
        hits = [v for v in value if v >= strong]
        row += [sum(hits) / n, max(value), sum(sorted(hits)[-3:]), math.log1p(len(hits))]
    person = [regex.sub(r"[^\p{L}]+", "", w.lower()) in T.SECOND_PERSON for w in words]
    at = [i for i, f in enumerate(found) if f[0] >= strong or f[1] >= strong]
    near = [any(p and abs(i - j) <= T.NEAR_WORDS for j, p in enumerate(person)) for i in at]
    count = lambda pattern: [len(regex.findall(pattern, w)) for w in words]
    letters, upper = count(r"\p{L}"), count(r"\p{Lu}")
    hidden = [bool(T.INSIDE.search(w)) or bool(T.STRETCHED.search(w)) for w in words]
    shouted = [u >= 3 and u == x for u, x in zip(upper, letters)]
    return row + [
        sum(near) / len(near) if near else 0.0, sum(person) / n, sum(upper) / max(sum(letters), 1), sum(shouted) / n, sum(count("[!?]")) / n,
        sum(count(r"[^\p{L}\p{N}]")) / max(sum(map(len, words)), 1), sum(hidden) / n, math.log1p(sum(f[2] for f in found))]


WORDS = "idiot id1ot IDIOT idiots, i.d.i.o.t stuuupid Stupid! you You, u dich l'idiot nice fine words. ÀÉ éé éééé. ÉÉÉ 123 1d10t!! !!! ### x X a ΑΣ İi ß mor-on moron mooooron $cum scum. 日本語 日日日 ok?! '' it's AAa aAA".split()


@pytest.mark.parametrize("own", [None, 0, 1])
def test_features_against_the_plain_version(own):
    rng = random.Random(3)
    lexicon = T.Lexicon({
        "idiot": (30, 1), "^idio": (31, 2), "stupid": (20, 9), "^stup": (25, 12), "moron": (2, 0), "scum": (4, 1), "éé": (5, 0), "^日日日": (9, 0), "^mor": (9, 9), "ας": (3, 0)}, 100, 900)
    texts = [None, "", " \n ", "idiot", "words fine nice", "you " + "fine " * 9 + "idiot " + "nice " * 3 + "u"]
    texts += [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(60))) for _ in range(60)]
    texts += ["".join(rng.choice("aAéÉ.!1-' ,İΣσ日 ") for _ in range(80)) for _ in range(60)]
    got = T.text_features(pa.array(texts), lexicon, 2.0, None if own is None else np.full(len(texts), own))
    for row, text in zip(got, texts):
        assert row == pytest.approx(plain_features(text, lexicon, 2.0, own), abs=1e-12), text


def test_classes_are_told_apart_text_by_text():
    lexicon = T.Lexicon({"scum": (3, 2)}, 10, 90)
    mixed = T.text_features(pa.array(["scum"] * 4), lexicon, 0.1, np.array([0, 1, 1, 0]))
    assert mixed[0, 1] == mixed[3, 1] == lexicon.weight("scum", 0) != mixed[1, 1] == mixed[2, 1] == lexicon.weight("scum", 1)
