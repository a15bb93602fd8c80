"""Near-duplicate texts by SetSketch registers: banded candidates, likelihood, exact check."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import written
from .text import slices, split_words
from .urls import build_filter
from .worker import claim, release

#: The first BANDS * BAND registers name buckets; all of them estimate.
REGISTERS, BAND, BANDS = 256, 4, 32
#: Bands of the first round. It joins the large groups, and the second round passes over what is joined.
FIRST_BANDS = 6
#: SetSketch base and rate; registers stay below 2**16 for any set of 64-bit elements.
BASE, RATE = 1.001, 20.0
#: A pair is checked on its full sets unless its likelihood falls before this similarity. At 256
#: registers the estimate of a pair of 0.8 has a deviation of 0.025, so this is four of them below.
LEAST_LIKELY = 0.7
MEMBERS = 256

_RANDOM = np.random.default_rng(20_231)
_LOW, _HIGH = (_RANDOM.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1) for _ in range(2))
_ADD = _RANDOM.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0x27D4EB2F165667C5], dtype=np.uint64)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text.

    Shingles are ``width`` words in a row after A-Z is lower-cased; a shorter text is one shingle, a
    text without words has none.
    """
    words = split_words(texts)
    # bytes.lower changes A-Z alone
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w.encode().lower()) for w in words.distinct), dtype=np.uint64, count=len(words.distinct))
    flat = hashed[words.codes]
    rolled = np.zeros(max(len(flat) - width + 1, 0), dtype=np.uint64)
    factors = _scramble(np.arange(1, width + 1, dtype=np.uint64) * _MIX[0])
    with np.errstate(over="ignore"):
        for i in range(width if len(rolled) else 0):
            rolled += _scramble(flat[i:i + len(rolled)] * (factors[i] | np.uint64(1)))
        rolled = _scramble(rolled)
        for i in range(len(words)):
            a, b = words.starts[i], words.starts[i + 1]
            if b - a >= width:
                yield np.unique(rolled[a:b - width + 1])
            elif b > a:
                whole = _scramble(flat[a:b] * (factors[:b - a] | np.uint64(1))).sum(dtype=np.uint64)
                yield _scramble(np.array([whole + _MIX[1] * np.uint64(b - a)], dtype=np.uint64))
            else:
                yield np.zeros(0, dtype=np.uint64)


def registers_of(elements: np.ndarray) -> np.ndarray:
    """SetSketch registers floor(1 - log_b x), x the least of one exponential variate per element."""
    least = np.full(REGISTERS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(elements), 1024):
        part = elements[at:at + 1024]
        low, high = part.astype(np.uint32)[:, None], (part >> np.uint64(32)).astype(np.uint32)[:, None]
        np.minimum(least, (low * _LOW + high * _HIGH + _ADD).min(axis=0), out=least)
    x = -np.log1p(-(least + 0.5) / 2.0 ** 32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, 65535).astype("<u2")


def likely(more: np.ndarray, less: np.ndarray, n: np.ndarray, m: np.ndarray, similarity: float, least: float) -> np.ndarray:
    """Whether sets of sizes n and m may have ``similarity``, by joint likelihood of their registers.

    ``more`` and ``less`` count registers in which the first sketch is above and below. The log
    likelihood is concave in the similarity, so its maximum is at ``least`` or beyond exactly where it
    still rises there. Sizes too far apart for ``similarity`` are certain.
    """
    u, v = n / (n + m), m / (n + m)
    equal = REGISTERS - more - less
    step = (BASE - 1) / BASE

    def above(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inner = 1 - np.clip(x, 1e-9, None) * step
        return -np.log(inner) / np.log(BASE), step / inner / np.log(BASE)

    (p, dp), (q, dq) = above(u - v * least), above(v - u * least)
    rise = -more * v * dp / p - less * u * dq / q + equal * (v * dp + u * dq) / np.maximum(1 - p - q, 1e-9)
    return (rise >= 0) & (np.minimum(n, m) >= similarity * np.maximum(n, m))


def _unpack(column: pa.Array) -> np.ndarray:
    return column.values.slice(column.offsets[0].as_py(), len(column) * (REGISTERS // BAND)).to_numpy().astype("<i8").view("<u2").reshape(len(column), REGISTERS)


def sketch_events(events: DataFrame, width: int) -> DataFrame:
    """(event_id, n_shingles, digest, registers): the sketch of every text, where it is read."""
    kind = events.schema["event_id"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near duplicates")
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, digests, found = [], [], []
                for s in shingle_sets(part.column("text"), width):
                    sizes.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    found.append(registers_of(s).view("<i8") if len(s) else np.zeros(REGISTERS // BAND, dtype="<i8"))
                flat = np.concatenate(found)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, REGISTERS // BAND), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [part.column("event_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists],
                    ["event_id", "n_shingles", "digest", "registers"])
        release()

    return events.mapInArrow(sketch, f"event_id {kind}, n_shingles long, digest binary, registers array<long>")


def likely_pairs(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose registers do not speak against ``similarity``."""
    side = lambda c: sketches.select(F.col("event_id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("registers").alias(f"r_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    kind = pairs.schema["a"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = _unpack(batch.column("r_a")), _unpack(batch.column("r_b"))
                n, m = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
                keep = likely((x > y).sum(axis=1), (x < y).sum(axis=1), n, m, similarity, LEAST_LIKELY)
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(judge, f"a {kind}, b {kind}").distinct()


def among(events: DataFrame, ids: DataFrame) -> DataFrame:
    """The events whose id may be among ``ids``, found where they are read.

    A blocked Bloom filter of at most 8 MB; what it lets pass in vain is removed by the join that
    follows. So only texts that are needed are shuffled.
    """
    bloom = build_filter(ids.select(F.col("event_id").alias("rule")), 16, 8 << 20)
    shared = events.sparkSession.sparkContext.broadcast(bloom)

    @F.pandas_udf("boolean")
    def held(hashes: pd.Series) -> pd.Series:
        return pd.Series(shared.value.holds(hashes.to_numpy()))

    return events.where(held(F.xxhash64("event_id")))


def near_sets(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * shared >= percent * union, for sorted sets; an empty set is near nothing."""
    small, large = (x, y) if len(x) < len(y) else (y, x)
    if 100 * len(small) < percent * len(large) or not len(small):
        return False
    shared = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return 100 * shared >= percent * (len(small) + len(large) - shared)


def verified(pairs: DataFrame, events: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * shared >= percent * union on their full shingle sets.

    Texts are dealt to groups of one ``a`` and about ``MEMBERS`` of its ``b``, so an ``a`` with very many
    partners is many groups. A group holds the set of ``a`` and streams the others.
    """
    kind = pairs.schema["a"].dataType.simpleString()
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).alias("_chunks"))
    members = pairs.join(sizes, "a").select(
        F.col("b").alias("event_id"), "a", F.pmod(F.xxhash64("b"), F.col("_chunks")).alias("_chunk"), F.lit(False).alias("_first"))
    firsts = members.select(F.col("a").alias("event_id"), "a", "_chunk", F.lit(True).alias("_first")).distinct()
    roles = members.unionByName(firsts)
    dealt = among(events.select("event_id", "text"), roles).join(roles, "event_id")
    dealt = dealt.repartition("a", "_chunk").sortWithinPartitions("a", "_chunk", F.col("_first").desc())

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            for part in slices(batch, "text"):
                a, b = part.column("a").to_pylist(), part.column("event_id").to_pylist()
                chunk, first = part.column("_chunk").to_pylist(), part.column("_first").to_pylist()
                good = []
                for i, own in enumerate(shingle_sets(part.column("text"), width)):
                    if (a[i], chunk[i]) != group:
                        group, held = (a[i], chunk[i]), []
                    if first[i]:
                        held.append(own)
                        continue
                    if any(near_sets(own, other, percent) for other in held):
                        good.append(i)
                yield part.select(["a", "event_id"]).take(pa.array(good, pa.int64())).rename_columns(["a", "b"])

    return dealt.mapInArrow(check, f"a {kind}, b {kind}")


class _Group:
    """The strays of one chunk of a bucket, held while its other rows stream by."""

    def __init__(self, similarity: float):
        self.similarity, self.rows, self.ready = similarity, [], None

    def hold(self, row: dict, registers: np.ndarray, elements: np.ndarray | None = None) -> None:
        self.rows.append((row, registers, elements))

    def partners(self, row: dict, registers: np.ndarray) -> np.ndarray:
        """Strays of another component that may be near ``row`` and share no earlier band with it."""
        if not self.rows:
            return np.zeros(0, dtype=np.int64)
        if self.ready is None:
            self.ready = np.array([r for _, r, _ in self.rows]), np.array([float(r["n_shingles"]) for r, _, _ in self.rows])
        x, sizes = self.ready
        keep = likely((x > registers).sum(axis=1), (x < registers).sum(axis=1), sizes, np.full(len(x), float(row["n_shingles"])), self.similarity, LEAST_LIKELY)
        before = BAND * row["band"]
        if before and keep.any():
            keep &= ~(x[:, :before] == registers[:before]).reshape(len(x), -1, BAND).all(axis=2).any(axis=1)
        # strays meet each other from both sides: once is enough
        return np.array([k for k in np.flatnonzero(keep) if self.rows[k][0]["component"] != row["component"]
                         and (row["_main"] or self.rows[k][0]["event_id"] < row["event_id"])], dtype=np.int64)


_PLACE = ["band", "key", "event_id", "component", "n_shingles", "registers", "_s", "_r", "_stray", "_main"]
_ORDER = ["key", "_s", "_r"]


def stray_members(members: DataFrame, similarity: float) -> DataFrame:
    """The members of mixed buckets that have a likely partner of another component there.

    ``members``: (band, key, event_id, component, n_shingles, registers), of buckets that still hold
    several components. Those outside the largest component of a bucket are its strays. Strays and
    members are cut into chunks, and every pair of chunks is one small group, compared by registers;
    a pair counts in the first band that it shares. Rows come out, never pairs.
    """
    parts = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    keys = parts.groupBy("key").agg(F.sum("n").alias("_all"), F.max(F.struct("n", "component")).alias("_top"), F.count("*").alias("_parts"))
    keys = keys.where("_parts > 1").select(
        "key", F.col("_top.component").alias("_largest"), F.ceil(F.col("_all") / 1024).alias("_rows"),
        F.ceil((F.col("_all") - F.col("_top.n")) / MEMBERS).alias("_strays"))
    rows = members.join(keys, "key")
    every = F.sequence(F.lit(0), F.col("_strays").cast("int") - 1), F.sequence(F.lit(0), F.col("_rows").cast("int") - 1)
    own = F.pmod(F.xxhash64("event_id"), F.col("_strays")).cast("int"), F.pmod(F.xxhash64("event_id"), F.col("_rows")).cast("int")
    carried, main = _PLACE[:6], F.col("component") == F.col("_largest")
    strays = rows.where(~main).select(*carried, own[0].alias("_s"), F.explode(every[1]).alias("_r"), F.lit(True).alias("_stray"), F.lit(False).alias("_main"))
    others = rows.select(*carried, F.explode(every[0]).alias("_s"), own[1].alias("_r"), F.lit(False).alias("_stray"), main.alias("_main"))
    dealt = strays.unionByName(others).select(*_PLACE).repartition(*_ORDER).sortWithinPartitions(*_ORDER, F.col("_stray").desc())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group, here = None, _Group(similarity), None
        wanted: dict[int, set] = {}

        def out(schema: pa.Schema) -> pa.RecordBatch:
            """The held strays that found a partner."""
            rows = [(r | {"registers": x.view("<i8").tolist()}) for k, (r, x, _) in enumerate(group.rows) if k in wanted]
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            found, cols, good = _unpack(batch.column("registers")), {c: batch.column(c).to_pylist() for c in _PLACE if c != "registers"}, []
            for i in range(batch.num_rows):
                row = {c: v[i] for c, v in cols.items()}
                if (here := tuple(row[c] for c in _ORDER)) != held:
                    if wanted:
                        yield out(batch.schema)
                    held, group, wanted = here, _Group(similarity), {}
                if row["_stray"]:
                    group.hold(row, found[i].copy())
                elif len(near := group.partners(row, found[i])):
                    wanted |= dict.fromkeys(near.tolist())
                    good.append(i)
            schema = batch.schema
            yield batch.take(pa.array(good, pa.int64()))
        if wanted:
            yield out(schema)

    return dealt.mapInArrow(compare, dealt.schema)


def stray_links(needed: DataFrame, events: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) among the rows of ``stray_members``, checked on their full shingle sets.

    The groups are those of ``stray_members``, now with texts. Components that a group has joined are
    not compared there again, so a group returns a forest.
    """
    kind = needed.schema["event_id"].dataType.simpleString()
    dealt = needed.join(among(events.select("event_id", "text"), needed), "event_id").repartition(*_ORDER).sortWithinPartitions(*_ORDER, F.col("_stray").desc())

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group, joined = None, _Group(percent / 100), {}

        def root(c):
            while joined.get(c, c) != c:
                c = joined[c]
            return c

        for batch in batches:
            for part in slices(batch, "text"):
                found, cols, left, right = _unpack(part.column("registers")), {c: part.column(c).to_pylist() for c in _PLACE if c != "registers"}, [], []
                for i, own in enumerate(shingle_sets(part.column("text"), width)):
                    row = {c: v[i] for c, v in cols.items()}
                    if (here := tuple(row[c] for c in _ORDER)) != held:
                        held, group, joined = here, _Group(percent / 100), {}
                    if row["_stray"]:
                        group.hold(row, found[i].copy(), own)
                        continue
                    for k in group.partners(row, found[i]).tolist():
                        other, _, elements = group.rows[k]
                        x, y = root(other["component"]), root(row["component"])
                        if x != y and near_sets(own, elements, percent):
                            joined[x] = y
                            left.append(other["event_id"]), right.append(row["event_id"])
                ids = part.schema.field("event_id").type
                yield pa.RecordBatch.from_arrays([pa.array(left, ids), pa.array(right, ids)], ["a", "b"])

    return dealt.mapInArrow(check, f"a {kind}, b {kind}")


def with_component(rows: DataFrame, classes: DataFrame, key: str, out: str) -> DataFrame:
    """Add the class of ``key``; an id without links is its own class."""
    named = classes.select(F.col("id").alias(key), F.col("component_id").alias(out))
    return rows.join(named, key, "left").withColumn(out, F.coalesce(out, key))


def unlike(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that no links join yet."""
    both = with_component(with_component(pairs, classes, "a", "_ca"), classes, "b", "_cb")
    return both.where("_ca <> _cb").select("a", "b")


def near_duplicates(
    events: DataFrame, event_id: str = "event_id", canonical_string: str = "canonical_string", width: int = 5, percent: int = 80,
) -> DataFrame:
    """Classes of texts whose word shingles overlap: ``event_id``, ``n_shingles``, ``component_id``, ``kept``.

    Made for the texts of alerts and events (canonical strings or reports), it works on any table with
    an id and a text. Two texts are linked if ``percent`` hundredths of the union of their shingles are
    shared; a class is what links reach, named by its smallest id, whose row is kept.

    Sketch (one pass over the texts), then equal sets are one (a grouped minimum). Bands of registers
    name buckets; in each bucket every text is compared with the smallest id only, by likelihood and
    then on full sets, in two rounds: the second passes over texts that the first has joined. Buckets
    that still hold several components after that are finished by ``stray_members`` and
    ``stray_links``, so no partner is given up because a bucket is large, and no bucket is expanded
    into all its pairs. A pair at 0.8 shares no band with probability below 1e-7.

    Texts without words and null texts are linked with nothing and kept; so are rows with a null id
    (component null). Rows that share an id are one text with several versions and stay or go together.
    Other columns are ignored. An empty table gives no rows.
    """
    similarity = percent / 100
    rows = events.select(F.col(event_id).alias("event_id"), F.col(canonical_string).cast("string").alias("text"))
    sketches = written(sketch_events(rows, width), "sketches")
    filled = sketches.where("n_shingles > 0 and event_id is not null")
    equal = filled.groupBy("digest").agg(F.min("event_id").alias("first"))
    copies = filled.join(equal, "digest").where("event_id <> first").select(F.col("first").alias("a"), F.col("event_id").alias("b"))
    single = filled.join(equal.select(F.col("first").alias("event_id"), "digest"), ["event_id", "digest"], "left_semi")
    single = written(single.dropDuplicates(["event_id", "digest"]).select("event_id", "n_shingles", "registers"), "single")

    banded = single.select("event_id", F.posexplode(F.slice("registers", 1, BANDS)).alias("band", "value"))
    banded = banded.select("event_id", "band", F.xxhash64("band", "value").alias("key"))
    pivots = banded.groupBy("key").agg(F.min("event_id").alias("pivot"), F.count("*").alias("n")).where("n > 1").drop("n")
    buckets = written(banded.join(pivots, "key").where("event_id <> pivot"), "buckets")

    links = written(copies, "links")
    found = None
    for some in (F.col("band") < FIRST_BANDS, F.col("band") >= FIRST_BANDS):
        pairs = buckets.where(some).select(F.col("pivot").alias("a"), F.col("event_id").alias("b")).distinct()
        if found is not None:
            pairs = unlike(pairs, found)
        pairs = written(likely_pairs(pairs, single, similarity), "pairs")
        links = written(links.unionByName(verified(pairs, rows, width, percent)), "links")
        found = written(components(links), "classes")

    named = written(with_component(buckets.select("band", "key", "event_id"), found, "event_id", "component"), "members")
    mixed = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    strays = written(stray_members(named.join(mixed, "key").join(single, "event_id"), similarity), "strays")
    more = written(stray_links(strays, rows, width, percent), "links")
    if not more.isEmpty():
        found = written(components(links.unionByName(more)), "classes")
    result = sketches.select("event_id", "n_shingles").join(found.withColumnRenamed("id", "event_id"), "event_id", "left")
    return result.select(
        "event_id", "n_shingles", F.coalesce("component_id", "event_id").alias("component_id"),
        (F.coalesce("component_id", "event_id").isNull() | (F.col("component_id").isNull()) | (F.col("component_id") == F.col("event_id"))).alias("kept"))
