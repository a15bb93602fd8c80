"""Toxicity by gradient-boosted trees over dense text features, with isotonic calibration."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import WHITE_SPACE, byte_kinds, byte_words, string_buffers
from .labelled import labelled_sample
from .storage import written
from .text import slices, split_words
from .worker import claim

#: Words that address the reader; a parameter of the features.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur ya du dich dir dein deine ihr euch euer sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros os".split())
NEAR_WORDS = 6
STEMS = (4, 5, 6)
LEET = str.maketrans("013457@$€!|", "oieastaseil")
NOT_LETTERS = regex.compile(r"[^\p{L}]+")
STRETCHED = regex.compile(r"(\p{L})\1{2,}")
INSIDE = regex.compile(r"\p{L}[^\p{L}\s'’.,;:!?-]+\p{L}")
FEATURES = [
    "word_density", "word_best", "word_best3", "word_hits", "stem_density", "stem_best", "stem_best3", "stem_hits", "near_person",
    "person_density", "capitals", "shouted", "exclaimed", "punctuated", "obfuscated", "obfuscated_hits",
]
CACHE_WORDS = 100_000
WORD_KINDS = byte_kinds(WHITE_SPACE)
#: Texts of class 1 that hold a lexicon term, at least.
LEAST_TEXTS = 3


def plain_forms(word: str) -> tuple[str, str]:
    """A word as letters only, and with look-alike characters read as letters; stretched letters once."""
    low = word.lower()
    bare = STRETCHED.sub(r"\1", NOT_LETTERS.sub("", low))
    if low.isalpha():
        return bare, bare
    read = low.rstrip("!?.,;:|").translate(LEET)
    return bare, STRETCHED.sub(r"\1", NOT_LETTERS.sub("", read))


def terms_of(word: str) -> set[str]:
    """Lexicon entries that a word may match: its plain forms and their stems (``^``)."""
    forms = {f for f in plain_forms(word) if len(f) > 1}
    return forms | {f"^{f[:n]}" for f in forms for n in STEMS if len(f) >= n}


@dataclass
class Lexicon:
    """Texts of each class that hold a term, for the terms that speak for class 1."""

    counts: dict[str, tuple[int, int]]
    toxic: int
    clean: int
    known: tuple | None = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": None}

    def weight(self, term: str, own: int | None = None) -> float:
        """Log odds of a term, never below 0. ``own``: the class of a text whose share is left out."""
        t, c = self.counts.get(term, (0, 0))
        t, c = max(t - (own == 1), 0), max(c - (own == 0), 0)
        if t < LEAST_TEXTS - 1:  # a text's own share may be left out
            return 0.0
        odds = math.log((t + 0.5) / (self.toxic + 1)) - math.log((c + 0.5) / (self.clean + 1))
        return max(odds, 0.0)

    def word(self, word: str, own: int | None = None) -> tuple[float, float, bool]:
        """(best full form, best stem, only found by reading look-alikes)."""
        bare, read = plain_forms(word)

        def best(form: str) -> tuple[float, float]:
            stems = [self.weight(f"^{form[:n]}", own) for n in STEMS if len(form) >= n]
            return self.weight(form, own) if len(form) > 1 else 0.0, max(stems, default=0.0)

        a = best(bare)
        if read == bare:
            return (*a, False)
        b = best(read)
        return max(a[0], b[0]), max(a[1], b[1]), b[0] > a[0]

    def tables(self) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
        """(full forms, stems, weights of both): three rows of weights, for unseen texts and for texts of class 0
        and 1 whose share is left out. The last weight is 0, for a form that is not listed."""
        if self.known is None:
            full, stems = ([t for t in self.counts if t.startswith("^") == is_stem] for is_stem in (False, True))
            weights = (np.array([[self.weight(t, own) for t in terms] + [0.0] for own in (None, 0, 1)]) for terms in (full, stems))
            self.known = (pa.array(full, pa.large_string()), pa.array([t[1:] for t in stems], pa.large_string()), *weights)
        return self.known

    def values(self, forms: pa.Array, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Weights of every form itself and of its best stem."""
        full, stems, full_weights, stem_weights = self.tables()
        listed = pc.fill_null(pc.index_in(forms, full), -1).to_numpy()
        long = (pc.utf8_length(forms).to_numpy() if len(forms) else np.zeros(0))
        best = np.zeros(len(forms))
        for n in STEMS:
            at = pc.fill_null(pc.index_in(pc.utf8_slice_codeunits(forms, 0, n), stems), -1).to_numpy()
            np.maximum(best, np.where(long >= n, stem_weights[row][at], 0.0), out=best)
        return np.where(long > 1, full_weights[row][listed], 0.0), best


#: Odd words of a worker: (letters, read as letters, hidden, addresses the reader).
_ODD: dict[str, tuple[str, str, bool, bool]] = {}
_LETTER, _UPPER, _LOUD, _MARK, _CHAR = (np.zeros(256) for _ in range(5))
for _b in range(128):
    _LETTER[_b], _UPPER[_b], _LOUD[_b], _MARK[_b] = chr(_b).isalpha(), chr(_b).isupper(), chr(_b) in "!?", not chr(_b).isalnum()
for _b in range(256):
    _CHAR[_b] = _b & 0xC0 != 0x80


def _tripled(words: pa.Array) -> np.ndarray:
    """Words that may hold a character three times in a row: a pattern of up to four bytes repeats twice."""
    offsets, data = string_buffers(words)
    found = np.zeros(len(data) + 1, dtype=bool)
    for size in range(1, 5):
        if len(data) < 3 * size:
            break
        same = np.append(0, np.cumsum(data[size:] == data[:-size]))
        found[:len(same) - 2 * size] |= same[2 * size:] - same[:-2 * size] == 2 * size
    before = np.append(0, np.cumsum(found))
    return before[offsets[1:]] > before[offsets[:-1]]


def word_figures(distinct: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """(forms, read forms, figures) of distinct words; figures are rows of letters, upper-case letters,
    characters, loud marks, marks, hidden, person.

    Words of letters, with or without marks behind them, are worked out as arrays; the others one by one,
    and remembered.
    """
    stem = pc.utf8_lower(pc.utf8_rtrim(distinct, ".,;:!?"))
    plain = pc.and_(pc.utf8_is_alpha(stem), pc.invert(pc.match_substring_regex(distinct, "[İΣ]"))).to_numpy(zero_copy_only=False) & ~_tripled(stem)
    at = np.flatnonzero(~plain)
    odd = distinct.take(pa.array(at)).to_pylist()
    claim(_ODD, _ODD.clear)
    if len(_ODD) + len(odd) > CACHE_WORDS:
        _ODD.clear()
    for w in odd:
        if w not in _ODD:
            _ODD[w] = (*plain_forms(w), bool(INSIDE.search(w)) or bool(STRETCHED.search(w)), NOT_LETTERS.sub("", w.lower()) in SECOND_PERSON)
    facts = [_ODD[w] for w in odd]
    place = np.arange(len(distinct))
    place[at] = len(distinct) + np.arange(len(at))
    forms = [pa.concat_arrays([stem, pa.array([f[k] for f in facts], pa.large_string())]).take(pa.array(place)) for k in (0, 1)]

    offsets, data = string_buffers(distinct)
    figures = np.zeros((7, len(distinct)))
    if len(distinct):
        for row, table in ((0, _LETTER), (1, _UPPER), (2, _CHAR), (3, _LOUD), (4, _MARK)):
            figures[row] = np.add.reduceat(table[data], offsets[:-1])  # no word is empty
        wide = np.flatnonzero(np.add.reduceat((data > 127).astype(np.int64), offsets[:-1]) > 0)
        beyond = distinct.take(pa.array(wide))
        for row, pattern in ((0, r"\p{L}"), (1, r"\p{Lu}"), (4, r"[^\p{L}\p{N}]")):
            figures[row, wide] = pc.count_substring_regex(beyond, pattern).to_numpy(zero_copy_only=False)
    figures[5, at] = [f[2] for f in facts]
    figures[6] = pc.is_in(stem, pa.array(sorted(SECOND_PERSON), pa.large_string())).to_numpy(zero_copy_only=False)
    figures[6, at] = [f[3] for f in facts]
    return *forms, figures


def text_features(texts: pa.Array, lexicon: Lexicon, strong: float, own: np.ndarray | None = None) -> np.ndarray:
    """One row of ``FEATURES`` per text. ``own`` gives the classes of texts that the lexicon has seen."""
    words = byte_words(texts, WORD_KINDS)
    codes, distinct = words.coded()
    bare, read, figures = word_figures(distinct)
    letters, upper, chars, loud, marks, hidden, person = figures
    n, out = np.diff(words.starts), np.zeros((len(texts), len(FEATURES)))
    has = np.flatnonzero(n)
    text = np.repeat(np.arange(len(n)), n)
    heads = words.starts[:-1][has]
    if not len(has):
        return out

    def by_text(values: np.ndarray, add: np.ufunc = np.add) -> np.ndarray:
        result = np.zeros(len(n))
        result[has] = add.reduceat(values, heads)
        return result

    tables = []
    for row in (0,) if own is None else (1, 2):
        a, b = lexicon.values(bare, row), lexicon.values(read, row)
        tables.append(np.stack([np.maximum(a[0], b[0]), np.maximum(a[1], b[1]), b[0] > a[0]]))
    found = tables[0][:, codes] if own is None else np.where(own[text] == 1, tables[1][:, codes], tables[0][:, codes])
    size = np.maximum(n, 1)
    for k in range(2):
        value = found[k]
        hits = np.flatnonzero(value >= strong)
        order = hits[np.lexsort((-value[hits], text[hits]))]
        count = np.bincount(text[hits], minlength=len(n))
        rank = np.arange(len(order)) - np.repeat(np.cumsum(count) - count, count)
        top = order[rank < 3]
        out[:, 4 * k] = np.bincount(text[hits], weights=value[hits], minlength=len(n)) / size
        out[:, 4 * k + 1] = by_text(value, np.maximum)
        out[:, 4 * k + 2] = np.bincount(text[top], weights=value[top], minlength=len(n))
        out[:, 4 * k + 3] = np.log1p(count)
    at, addressed = np.flatnonzero((found[0] >= strong) | (found[1] >= strong)), np.flatnonzero(person[codes])
    if len(at) and len(addressed):
        right = np.searchsorted(addressed, at)
        near = np.zeros(len(at), dtype=bool)
        for other in (addressed[np.minimum(right, len(addressed) - 1)], addressed[np.maximum(right - 1, 0)]):
            near |= (text[other] == text[at]) & (np.abs(other - at) <= NEAR_WORDS)
        out[:, 8] = np.bincount(text[at], weights=near, minlength=len(n)) / np.maximum(np.bincount(text[at], minlength=len(n)), 1)
    shouted = (upper >= 3) & (upper == letters)
    out[:, 9] = by_text(person[codes]) / size
    out[:, 10] = by_text(upper[codes]) / np.maximum(by_text(letters[codes]), 1)
    out[:, 11] = by_text(shouted[codes].astype(float)) / size
    out[:, 12] = by_text(loud[codes]) / size
    out[:, 13] = by_text(marks[codes]) / np.maximum(by_text(chars[codes]), 1)
    out[:, 14] = by_text(hidden[codes]) / size
    out[:, 15] = np.log1p(by_text(found[2]))
    return out


@dataclass
class ToxicityModel:
    """Lexicon, trees and calibration; without trees, a constant score."""

    lexicon: Lexicon
    trees: object | None
    isotonic: object | None
    constant: float
    strong: float


def _features(rows: DataFrame, lexicon: Lexicon, strong: float, labelled: bool) -> DataFrame:
    """``rows`` with ``values``, the features of ``text``; other columns stay in the JVM."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    @F.arrow_udf("array<double>")
    def describe(text: pa.Array, label: pa.Array) -> pa.Array:
        tables = [np.zeros((0, len(FEATURES)))]
        for part in slices(pa.RecordBatch.from_arrays([text, label], ["text", "label"]), "text"):
            tables.append(text_features(part.column("text"), shared.value, strong, part.column("label").to_numpy() if labelled else None))
        flat = np.concatenate(tables)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, len(FEATURES)), pa.int32()), pa.array(flat.ravel()))

    # declared not deterministic, so that no filter is pushed below it and computes it again
    return rows.withColumn("values", describe.asNondeterministic()("text", "label" if labelled else F.lit(0)))


def fit_toxicity(
    events: DataFrame, labels: DataFrame, event_id: str = "event_id", canonical_string: str = "canonical_string", label: str = "toxic",
    where: Column | None = None, rows_per_class: int = 5000, max_terms: int = 50_000, strong: float = 2.0, trees: int = 20,
) -> ToxicityModel:
    """Learn a lexicon, boosted trees over ``FEATURES``, and an isotonic calibration.

    All three learn from one bounded sample of labelled rows (``labelled_sample``). The lexicon counts
    texts by term (words and word stems, read through look-alike characters); terms of fewer than
    ``LEAST_TEXTS`` texts of class 1 do not count, and at most ``max_terms`` terms
    that speak for class 1 stay. When a sample row gets its features, its own share is taken out of the
    counts, so that the trees see lexicon values as they are on new texts. A fifth of the rows is kept for
    the calibration, in which classes have their true weight. With labels of one class only, every text
    gets that class; without labels, 0.
    """
    sample = written(labelled_sample(events, labels, label, rows_per_class, event_id, canonical_string, where), "toxicity-rows")
    classes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(classes) < 2:
        return ToxicityModel(Lexicon({}, 0, 0), None, None, float(classes.get(1, 0) > 0), strong)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity terms")
        for batch in batches:
            for part in slices(batch, "text"):
                words, found = split_words(part.column("text")), Counter()
                terms = [terms_of(w) for w in words.distinct]
                for i, kind in enumerate(part.column("label").to_pylist()):
                    found.update((t, kind) for t in set().union(*(terms[c] for c in np.unique(words.of(i)))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t for t, _ in found], pa.string()), pa.array([k for _, k in found], pa.int32()), pa.array(list(found.values()), pa.int64())],
                    ["term", "label", "n"])

    by_class = [F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)).alias(name) for k, name in ((1, "t"), (0, "c"))]
    terms = sample.mapInArrow(count, "term string, label int, n long").groupBy("term").agg(*by_class)
    odds = (F.col("t") + 0.5) / (classes[1] + 1) / ((F.col("c") + 0.5) / (classes[0] + 1))
    terms = terms.where((F.col("t") >= LEAST_TEXTS) & (odds > 2.0)).orderBy((odds * F.col("t")).desc(), "term").limit(max_terms)
    lexicon = Lexicon({r["term"]: (r["t"], r["c"]) for r in terms.collect()}, classes[1], classes[0])

    rows = written(_features(sample, lexicon, strong, labelled=True), "toxicity-features")
    rows = rows.withColumn("features", array_to_vector("values"))
    fit = rows.where("fold > 0")
    if fit.select("label").distinct().count() < 2:
        return ToxicityModel(lexicon, None, None, 0.0, strong)
    model = GBTClassifier(maxIter=trees, maxDepth=3, stepSize=0.3, seed=17, minInstancesPerNode=2).fit(fit)
    held = rows.where("fold = 0") if rows.where("fold = 0").select("label").distinct().count() == 2 else rows
    raw = model.transform(held).select(vector_to_array("probability")[1].alias("raw"), F.col("label").cast("double").alias("label"), "weight")
    isotonic = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight").fit(raw)
    return ToxicityModel(lexicon, model, isotonic, 0.0, strong)


def score_toxicity(
    events: DataFrame, model: ToxicityModel, event_id: str = "event_id", canonical_string: str = "canonical_string", threshold: float = 0.5,
    carry: list[str] | None = None,
) -> DataFrame:
    """Score of every whole text: ``event_id``, ``score`` (0 to 1), ``predicted`` (1 from ``threshold``),
    then ``carried``, a struct of the columns named in ``carry``, if any.

    The project's records are machine text without such labels, so this works on any table with an id
    and a text. Features are dense rates of the whole text: lexicon densities and best entries, hits near
    second-person words, capitals, punctuation, obfuscation. The calibrated score keeps a thousandth of
    the trees' own probability, so that texts on one step of the calibration stay ordered. Null and empty
    texts have all features 0 and are scored as such. All rows are kept, whatever their id; an empty
    table gives no rows.
    """
    kept = ["carried"] if carry else []
    text = F.col(canonical_string).cast("string").alias("text")
    if model.trees is None:
        rows = events.select(F.col(event_id).alias("event_id"), *[F.struct(*carry).alias(c) for c in kept])
        return rows.select("event_id", F.lit(model.constant).alias("score"), F.lit(int(model.constant >= threshold)).alias("predicted"), *kept)
    # a carried text is read out of its struct, so a row holds it once
    inside = carry and canonical_string in carry and events.schema[canonical_string].dataType.simpleString() == "string"
    rows = events.select(F.col(event_id).alias("event_id"), *[F.struct(*carry).alias(c) for c in kept], *([] if inside else [text]))
    rows = rows.withColumn("text", F.col("carried")[canonical_string]) if inside else rows
    described = _features(rows, model.lexicon, model.strong, labelled=False).select("event_id", array_to_vector("values").alias("features"), *kept)
    raw = model.trees.transform(described).select("event_id", vector_to_array("probability")[1].alias("raw"), *kept)
    scored = model.isotonic.transform(raw)
    score = F.greatest(F.least(0.999 * F.col("prediction") + 0.001 * F.col("raw"), F.lit(1.0)), F.lit(0.0))
    return scored.select("event_id", score.alias("score"), (score >= threshold).cast("int").alias("predicted"), *kept)
