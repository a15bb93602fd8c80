"""Language identification by unigram pieces, summed over all segmentations of every word."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written
from .text import slices, split_words
from .worker import claim

UNKNOWN = "und"
START = "▁"
#: Characters of a word that are scored in one go; the states before them are carried on to the next.
WORD_CHARS = 32
#: Array cells of the words that are learned from in one go, or one word.
LATTICE_CELLS = 1 << 21
#: Words whose scores a worker remembers before it starts over.
CACHE_WORDS = 400_000
#: A text may lie so many nats a letter below the labelled texts, and so many more divided by its words.
SLACK, SHORT_SLACK = 1.0, 8.0
LETTER = regex.compile(r"\p{L}")
LETTERS = r"\p{L}[\p{L}\p{M}]*"


def vocabulary_pieces(path: str) -> list[str]:
    """Letter pieces of a public tokenizer file, word beginnings marked, plus every single letter they use.

    Reads the vocabulary of a byte-level file: its printable byte names are mapped back to text, and
    only lower-case pieces of letters stay.
    """
    with open(path, encoding="utf-8") as file:
        names = json.load(file)["model"]["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}
    pieces = set()
    for name in names:
        text = bytes(byte[c] for c in name if c in byte).decode("utf-8", "replace").lower()
        start, body = text[:1] == " ", text.removeprefix(" ")
        if body and regex.fullmatch(LETTERS, body):
            pieces.add(START * start + body)
    return sorted(pieces | {c for p in pieces for c in p} | {START})


class Lattice:
    """Words as character codes with the pieces that end at each position."""

    def __init__(self, pieces: list[str]):
        self.number = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces), default=1)
        self.endings = {p[i:] for p in pieces for i in range(len(p))}

    def arcs(self, words: list[str], low: int = 0, high: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(arcs, lengths): ``arcs[w, e, n - 1]`` is the piece of n characters that ends before position
        e + 1 of word w, or -1. A character outside the vocabulary has no piece.

        Of the marked words, characters ``low`` to ``high`` only, and positions from there; pieces may
        begin before."""
        marked = [START + w for w in words]
        lengths = np.array([min(len(w), high or len(w)) - low for w in marked], dtype=np.int64)
        out = np.full((len(words), int(lengths.max(initial=0)), self.longest), -1, dtype=np.int32)
        get, endings = self.number.get, self.endings
        for w, word in enumerate(marked):
            row = out[w]
            for e in range(low + 1, low + int(lengths[w]) + 1):
                for n in range(1, min(self.longest, e) + 1):
                    end = word[e - n:e]
                    if end not in endings:
                        break
                    if (i := get(end)) is not None:
                        row[e - low - 1, n - 1] = i
        return out, lengths


def forward(arcs: np.ndarray, log_p: np.ndarray, other: float, before: np.ndarray | None = None) -> np.ndarray:
    """Log of the summed probability of all segmentations up to each position: (words, positions + 1, languages).

    ``log_p`` has a row per piece; ``other`` stands in for a character without a piece. ``before`` holds
    the last states of words that began earlier, and the result begins with them.
    """
    words, longest, sizes = arcs.shape
    first = np.zeros((words, 1, log_p.shape[1])) if before is None else before
    ahead = first.shape[1] - 1
    total = np.concatenate([first, np.full((words, longest, log_p.shape[1]), -np.inf)], axis=1)
    padded = np.vstack([log_p, np.full((1, log_p.shape[1]), -np.inf)])
    used = (arcs >= 0).any(axis=0)
    for e in range(ahead + 1, ahead + longest + 1):
        at = arcs[:, e - ahead - 1]
        terms = [total[:, e - n] + padded[at[:, n - 1]] for n in range(1, min(sizes, e) + 1) if n == 1 or used[e - ahead - 1, n - 1]]
        alone = at[:, 0] < 0
        terms[0][alone] = total[alone, e - 1] + other
        top = np.max(terms, axis=0)
        total[:, e] = top + np.log(sum(np.exp(t - top) for t in terms))
    return total


def backward(arcs: np.ndarray, lengths: np.ndarray, log_p: np.ndarray, other: float) -> np.ndarray:
    """The same from each position to the end of the word."""
    words, longest, sizes = arcs.shape
    total = np.full((words, longest + 1, log_p.shape[1]), -np.inf)
    total[np.arange(words), lengths] = 0.0
    padded = np.vstack([log_p, np.full((1, log_p.shape[1]), -np.inf)])
    used = (arcs >= 0).any(axis=0)
    for s in range(longest - 1, -1, -1):
        inside = s < lengths
        terms = [total[:, s + n] + padded[arcs[:, s + n - 1, n - 1]] for n in range(1, min(sizes, longest - s) + 1) if n == 1 or used[s + n - 1, n - 1]]
        alone = arcs[:, s, 0] < 0
        terms[0][alone] = total[alone, s + 1] + other
        top = np.max(terms, axis=0)
        safe = np.where(np.isfinite(top), top, 0.0)
        with np.errstate(divide="ignore"):
            value = safe + np.log(sum(np.exp(t - safe) for t in terms))
        total[inside, s] = value[inside]
    return total


def lots(rows: list[tuple], longest: int) -> Iterator[list[tuple]]:
    """Rows (word first, shorter words first) in lots of at most ``LATTICE_CELLS`` cells, or of one row."""
    at = 0
    while at < len(rows):
        end = at + 1
        while end < len(rows) and (end + 1 - at) * (len(rows[end][0]) + 1) * longest <= LATTICE_CELLS:
            end += 1
        yield rows[at:end]
        at = end


def letter_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Lower-cased letter runs: (starts, codes, distinct) as in ``text.Words``."""
    lowered = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    spaced = pc.replace_substring_regex(lowered, r"[^\p{L}\p{M}]+", " ")
    words = split_words(spaced)
    return words.starts, words.codes, words.distinct


class LanguageModel:
    """Piece probabilities per language. ``log_p`` is (pieces, languages).

    ``low`` is the log probability a letter that all but a hundredth of a language's labelled texts reach.
    """

    def __init__(self, languages: list[str], pieces: list[str], log_p: np.ndarray, prior: np.ndarray, other: float = -16.0, low: np.ndarray | None = None):
        self.languages, self.pieces, self.log_p, self.prior, self.other = languages, pieces, log_p, prior, other
        self.low = np.full(len(languages), -np.inf) if low is None else low
        self.lattice = Lattice(pieces)
        self.forget()

    def forget(self) -> None:
        """Words with the row of ``table`` that holds their figures."""
        self.known: dict[str, int] = {}
        self.table = np.zeros((1 << 12, len(self.languages) + 2))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("lattice", "known", "table")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.lattice = Lattice(self.pieces)
        self.forget()

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language, all segmentations summed."""
        out = np.zeros((len(words), len(self.languages)))
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for at in range(0, len(order), 4096):
            some, low, before = order[at:at + 4096], 0, None
            while some:
                arcs, lengths = self.lattice.arcs([words[k] for k in some], low, low + WORD_CHARS)
                total = forward(arcs, self.log_p, self.other, before)
                ended = np.array([len(words[k]) + 1 <= low + WORD_CHARS for k in some])
                ahead = total.shape[1] - arcs.shape[1] - 1
                out[[k for k, e in zip(some, ended) if e]] = total[ended, ahead + lengths[ended]]
                some = [k for k, e in zip(some, ended) if not e]
                before, low = total[~ended, -self.lattice.longest:], low + WORD_CHARS
        return out

    def text_sums(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sums, words, has a letter) of whole texts. ``sums`` has the log probability in each language,
        then the letters, a word start counted as one, and the letters without a piece."""
        starts, codes, distinct = letter_words(texts)
        claim(self, self.forget)
        if len(self.known) + len(distinct) > CACHE_WORDS:
            self.forget()
        new = [w for w in distinct if w not in self.known]
        if new:
            letters = np.array([(len(w) + 1, sum(c not in self.lattice.number for c in w)) for w in new], dtype=float)
            first = len(self.known)
            while first + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[first:first + len(new)] = np.hstack([self.word_scores(new), letters])
            self.known.update(zip(new, range(first, first + len(new))))
        table = self.table[np.fromiter(map(self.known.__getitem__, distinct), dtype=np.int64, count=len(distinct))]
        sums = np.zeros((len(starts), len(self.languages) + 2))
        for k in range(len(self.languages) + 2):
            sums[1:, k] = np.cumsum(table[codes, k])[starts[1:] - 1] if len(codes) else 0.0
        sums[starts == 0] = 0.0
        lettered = np.array([any(LETTER.search(distinct[c]) for c in codes[a:a + 50]) or any(LETTER.search(distinct[c]) for c in codes[a + 50:b])
                             for a, b in zip(starts[:-1], starts[1:])], dtype=bool)
        return np.diff(sums, axis=0), np.diff(starts), lettered

    def text_scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(posteriors, has a letter, is like the labelled texts of its best language) of whole texts."""
        sums, words, lettered = self.text_sums(texts)
        total = sums[:, :-2] + self.prior
        best = total.argmax(axis=1)
        total -= total.max(axis=1, keepdims=True)
        odds = np.exp(total)
        letters, missing = sums[:, -2], sums[:, -1]
        rate = sums[np.arange(len(best)), best] / np.maximum(letters, 1)
        like = rate >= self.low[best] - SLACK - SHORT_SLACK / np.maximum(words, 1)
        like &= 2 * missing <= letters - words
        return odds / odds.sum(axis=1, keepdims=True), lettered, like & lettered


def fit_languages(
    events: DataFrame, tokenizer: str, event_id: str = "event_id", canonical_string: str = "canonical_string", language: str = "lang",
    where: Column | None = None, max_rows_per_language: int = 600, rounds: int = 4, max_languages: int = 1000,
) -> LanguageModel:
    """Learn piece probabilities by expectation maximisation over all segmentations.

    Uses at most about ``max_rows_per_language`` labelled rows of each language (the rows of smallest
    seeded hash, in expectation); their words are counted in Spark, and every round is one pass over
    the counts that returns one expected count per piece and language. The same rows then give the log
    probability a letter that texts of a language reach. More than ``max_languages``
    labels are refused. Without any labelled row there is no language, and every text is ``und``.
    """
    spark = events.sparkSession
    pieces = vocabulary_pieces(tokenizer)
    rows = events.where(F.col(language).isNotNull() & F.col(canonical_string).isNotNull())
    rows = rows.where(where) if where is not None else rows
    rows = rows.select(F.col(event_id).alias("event_id"), F.col(canonical_string).cast("string").alias("text"), F.col(language).cast("string").alias("lang"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(max_languages + 1).collect()}
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], pieces, np.zeros((len(pieces), 0)), np.zeros(0))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, max_rows_per_language / sizes[k]))])
    draw = F.pmod(F.xxhash64("event_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.where(draw < share[F.col("lang")])
    lowered = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{M}]+", " ")
    counts = rows.select("lang", F.explode(F.split(lowered, " ")).alias("word")).where("word <> ''").groupBy("lang", "word").count()
    counts = written(counts, "language-words")

    index = {name: i for i, name in enumerate(languages)}
    lattice_pieces, model = pieces, None
    log_p = np.full((len(pieces), len(languages)), -np.log(len(pieces)))
    for _ in range(rounds):
        model = LanguageModel(languages, lattice_pieces, log_p, np.zeros(len(languages)))

        def expect(batches: Iterator[pa.RecordBatch], model: LanguageModel = model) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(model.log_p)
            for batch in batches:
                rows = sorted(zip(batch.column("word").to_pylist(), batch.column("lang").to_pylist(), batch.column("count").to_pylist()), key=lambda r: len(r[0]))
                for words in lots([(w, index[k], n) for w, k, n in rows], model.lattice.longest):
                    arcs, lengths = model.lattice.arcs([w[0] for w in words])
                    lang, times, row = np.array([w[1] for w in words]), np.array([w[2] for w in words], dtype=float), np.arange(len(words))
                    ahead = forward(arcs, model.log_p, model.other)[row, :, lang]
                    behind = backward(arcs, lengths, model.log_p, model.other)[row, :, lang]
                    whole = ahead[row, lengths]
                    for n in range(1, model.lattice.longest + 1):
                        w, e = np.nonzero(arcs[:, :, n - 1] >= 0)
                        piece = arcs[w, e, n - 1]
                        weight = np.exp(ahead[w, e + 1 - n] + model.log_p[piece, lang[w]] + behind[w, e + 1] - whole[w]) * times[w]
                        np.add.at(total, (piece, lang[w]), weight)
            i, k = np.nonzero(total > 1e-6)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(k), pa.array(total[i, k])], ["piece", "lang", "n"])

        found = counts.mapInArrow(expect, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
        expected = np.zeros_like(log_p)
        for r in found.toLocalIterator():  # at most pieces times languages
            expected[r["piece"], r["lang"]] = r["n"]
        smooth = expected + 0.1 + 1e-3 * expected.sum(axis=1, keepdims=True) / max(len(languages), 1)
        log_p = np.log(smooth / smooth.sum(axis=0, keepdims=True))
    prior = np.log(np.array([sizes[k] for k in languages], dtype=float) / sum(sizes.values()))
    model = LanguageModel(languages, pieces, log_p, prior)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sums, _, lettered = model.text_sums(part.column("text"))
                own = np.array([index[k] for k in part.column("lang").to_pylist()], dtype=np.int64)
                rates = sums[np.arange(len(own)), own] / np.maximum(sums[:, -2], 1)
                yield pa.RecordBatch.from_arrays([pa.array(own[lettered]), pa.array(rates[lettered])], ["lang", "rate"])

    reached = rows.select("lang", "text").mapInArrow(rate, "lang long, rate double").groupBy("lang").agg(F.percentile("rate", F.lit(0.01)).alias("low"))
    for r in reached.collect():  # one row a language
        model.low[r["lang"]] = r["low"]
    return model


def identify_languages(
    events: DataFrame, model: LanguageModel, event_id: str = "event_id", canonical_string: str = "canonical_string",
    carry: list[str] | None = None,
) -> DataFrame:
    """Language of every whole text: ``event_id``, ``lang_pred``, ``score``, ``known``, then ``carried``,
    a struct of the columns named in ``carry``, if any.

    The project's records are machine text without a language, so this works on any table with an id
    and a text. A text is its letter runs, lower-cased; the probability of a run sums over all its
    segmentations into pieces (forward algorithm; a long run in parts that carry the states on), once for each distinct run of a batch; ``score`` is
    the posterior of the best language among the learned ones, 0 to 1. ``known`` says whether the text is
    like labelled texts of that language: at most half of its letters have no piece, and its log
    probability a letter is at most ``SLACK`` below what those reach, and for a short text a little more
    (``SHORT_SLACK`` divided by its words). Ties go to the first language by name. Null texts and
    texts without a letter are ``und`` with score 0 and not known, as is everything if nothing was learned. All rows
    are kept, whatever their id; an empty table gives no rows. The model is bounded by the vocabulary
    and the number of languages and travels as a broadcast variable.
    """
    kept = ["carried"] if carry else []
    text = F.col(canonical_string).cast("string").alias("text")
    # a carried text is read out of its struct, so a row holds it once
    inside = carry and canonical_string in carry and events.schema[canonical_string].dataType.simpleString() == "string"
    rows = events.select(F.col(event_id).alias("event_id"), *[F.struct(*carry).alias(c) for c in kept], *([] if inside else [text]))
    rows = rows.withColumn("text", F.col("carried")[canonical_string]) if inside else rows
    shared = events.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double, known: boolean>")
    def identify(text: pa.Array) -> pa.Array:
        own, names, scores, known = shared.value, [], [np.zeros(0)], [np.zeros(0, dtype=bool)]
        for part in slices(pa.RecordBatch.from_arrays([text], ["text"]), "text"):
            if own.languages:
                posterior, lettered, like = own.text_scores(part.column("text"))
                best = posterior.argmax(axis=1)
                names += [own.languages[b] if good else UNKNOWN for b, good in zip(best, lettered)]
                scores.append(np.where(lettered, posterior[np.arange(len(best)), best], 0.0))
                known.append(like)
            else:
                names += [UNKNOWN] * part.num_rows
                scores.append(np.zeros(part.num_rows))
                known.append(np.zeros(part.num_rows, dtype=bool))
        columns = [pa.array(names, pa.string()), pa.array(np.concatenate(scores)), pa.array(np.concatenate(known))]
        return pa.StructArray.from_arrays(columns, ["lang_pred", "score", "known"])

    # declared not deterministic, so that no filter is pushed below it and computes it again
    found = rows.withColumn("found", identify.asNondeterministic()("text"))
    return found.select("event_id", "found.lang_pred", "found.score", "found.known", *kept)
