"""URL rules behind a blocked Bloom filter and an exact hash join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import ASCII_LOWER, ASCII_UPPER

LANES = 8
#: One odd multiplier per lane of a block.
_SALTS = np.random.default_rng(3).integers(0, 1 << 32, LANES, dtype=np.uint32) | np.uint32(1)


class BlockedBloom:
    """Blocks of 8 lanes of 32 bits; a key sets one bit in every lane of one block."""

    def __init__(self, blocks: int):
        self.words = np.zeros((max(blocks, 1), LANES), dtype=np.uint32)

    @classmethod
    def sized(cls, keys: int, bits_per_key: int, most_bytes: int) -> BlockedBloom:
        return cls(min(-(-keys * bits_per_key // (32 * LANES)), most_bytes // (4 * LANES)))

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = hashes.astype(np.int64).view(np.uint64)
        block = ((h >> np.uint64(32)) * np.uint64(len(self.words))) >> np.uint64(32)
        bits = (h.astype(np.uint32)[:, None] * _SALTS) >> np.uint32(27)
        return block.astype(np.int64), np.uint32(1) << bits

    def add(self, hashes: np.ndarray) -> None:
        block, masks = self._places(hashes)
        for lane in range(LANES):
            np.bitwise_or.at(self.words[:, lane], block, masks[:, lane])

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """False: surely not added."""
        block, masks = self._places(hashes)
        return ((self.words[block] & masks) == masks).all(axis=1)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.substr(url, F.instr(url, "://") + 3)
    host = F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), ASCII_UPPER, ASCII_LOWER))
    return F.coalesce(host, F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    rest = F.substr(url, F.instr(url, "://") + 3)
    path = F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))
    return F.coalesce(path, F.lit(""))


#: Stands between host and path in a key. No host and no path of a url holds it, so keys of different pairs differ.
BETWEEN = "#"


def canonical_rules(listed: DataFrame, host: str = "host", path: str = "path", verdict: str = "verdict") -> DataFrame:
    """(rule, labels, length, verdict): one row per canonical host and path prefix, joined by ``BETWEEN``; block
    wins over allow. ``labels`` and ``length`` are those of the host and of the path."""
    low, start = F.translate(F.coalesce(F.col(host), F.lit("")), ASCII_UPPER, ASCII_LOWER), F.coalesce(F.col(path), F.lit(""))
    rows = listed.select(
        F.concat(low, F.lit(BETWEEN), start).alias("rule"), F.size(F.split(low, r"\.")).alias("labels"), F.length(start).alias("length"), F.col(verdict).alias("verdict"))
    return rows.groupBy("rule", "labels", "length").agg(F.max("verdict").alias("verdict"))


def build_filter(rules: DataFrame, bits_per_key: int, most_bytes: int) -> BlockedBloom:
    """Each partition fills a filter of the final size; the filters are joined by OR."""
    bloom = BlockedBloom.sized(rules.count(), bits_per_key, most_bytes)
    size = len(bloom.words)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = BlockedBloom(size)
        for batch in batches:
            own.add(batch.column("h").to_numpy())
        block, lane = np.nonzero(own.words)
        yield pa.RecordBatch.from_arrays(
            [pa.array(block * LANES + lane), pa.array(own.words[block, lane].astype(np.int64))], ["place", "bits"])

    hashes = rules.select(F.xxhash64("rule").alias("h"))
    found = hashes.mapInArrow(fill, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toPandas()
    place = found["place"].to_numpy(np.int64)  # at most most_bytes / 4 rows
    bloom.words[place // LANES, place % LANES] = found["bits"].to_numpy(np.int64).astype(np.uint32)
    return bloom


def judge_urls(
    pages: DataFrame, listed: DataFrame, page_id: str = "page_id", url: str = "url", otherwise: str = "allow",
    bits_per_key: int = 16, most_bytes: int = 8 << 20,
) -> DataFrame:
    """Verdict of every url: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``.

    The project keeps no urls (its flows have addresses and ports), so this works on any table of them.
    ``listed`` holds canonical (host, path, verdict) rows. A rule fits its host and all subdomains if the
    url's path starts with the rule's path; the longest rule wins, a blocking one among equals.
    A url without a rule gets ``otherwise``.

    Every distinct (host, path) offers the keys of the host suffixes and path prefixes that are as long as
    those of some rule. The Bloom filter (at most ``most_bytes``, so it may be broadcast whatever the list's size) lets
    possible hits pass to an exact join on the key, which removes the false ones. A list too long for the
    filter costs more passing keys, never a wrong verdict. Very common urls are one row before the join.

    Null urls and urls without ``://`` have an empty host and path. All rows are kept, whatever their id.
    An empty list leaves every url to ``otherwise``; an empty table gives no rows.
    """
    rules = canonical_rules(listed)
    sizes = {c: sorted(r[c] for r in rules.select(c).distinct().limit(65_537).collect()) for c in ("labels", "length")}
    if max(map(len, sizes.values())) > 65_536:
        raise ValueError("rules have more than 65,536 path lengths or label counts")
    bloom = build_filter(rules, bits_per_key, most_bytes)
    shared = pages.sparkSession.sparkContext.broadcast(bloom)

    parsed = pages.select(F.col(page_id).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    labels = F.split("host", r"\.")
    within = lambda c, most: F.filter(F.array(*[F.lit(n) for n in sizes[c]]).cast("array<int>"), lambda n: n <= most)
    suffixes = F.transform(within("labels", F.size(labels)), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    prefixes = F.transform(within("length", F.length("path")), lambda n: F.substr(F.col("path"), F.lit(1), n))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, F.lit(BETWEEN), p))))
    offered = parsed.select("host", "path").distinct().withColumn("keys", keys)
    offered = offered.withColumn("hashes", F.transform("keys", lambda k: F.xxhash64(k)))

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, hashes = batch.column("keys"), batch.column("hashes").flatten().to_numpy()
            rows = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            hit = np.flatnonzero(shared.value.holds(hashes))
            at = pa.array(rows[hit])
            yield pa.RecordBatch.from_arrays(
                [batch.column("host").take(at), batch.column("path").take(at), lists.flatten().take(pa.array(hit))], ["host", "path", "rule"])

    hits = offered.mapInArrow(passing, "host string, path string, rule string").join(rules, "rule")
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "verdict", "rule")).alias("_best"))
    out = parsed.join(best, ["host", "path"], "left")
    return out.select(
        "page_id", "host", "path", F.replace(F.col("_best.rule"), F.lit(BETWEEN), F.lit("")).alias("rule"), F.coalesce("_best.verdict", F.lit(otherwise)).alias("verdict"))
