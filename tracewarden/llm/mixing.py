"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.distributed import null_safe_join
from .storage import written

WORD = r"[^\x20\x09-\x0D]+"
LEADING = r"^[\x20\x09-\x0D]+"


def seeded(seed: int, *parts: Column) -> Column:
    """Hex text that orders rows at random, the same in every engine that has MD5."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def as_number(hex_text: Column) -> Column:
    return F.conv(F.substring(hex_text, 1, 8), 16, 10).cast("long")


def apportion(parties: DataFrame, votes: str, seats: str, name: str, by: list[str] | None = None, out: str = "quota") -> DataFrame:
    """Give ``seats`` (a column, equal within a group) to the parties with the highest quotients
    votes / (2 k + 1); ties go to the smaller ``name``.

    Highest quotients differ from the proportional share q by less than q * parties / (2 * seats) + 1
    seats. What is certain is given at once and only the seats between are ranked: about five
    quotients for each party, whatever the number of seats.
    """
    by = by or []
    group = W.partitionBy(*by)
    share = F.col(votes) * F.col(seats) / F.sum(votes).over(group)
    slack = F.count("*").over(group) / F.col(seats)
    some = (F.col(seats) > 0) & (F.sum(votes).over(group) > 0)
    sized = parties.withColumns({"_q": F.when(some, share).otherwise(0.0), "_slack": F.when(some, slack).otherwise(0.0)})
    sized = sized.withColumns({
        "_sure": F.greatest(F.floor(F.col("_q") * (1 - F.col("_slack"))) - 1, F.lit(0)),
        "_most": F.ceil(F.col("_q") * (1 + F.col("_slack"))) + 1,
    })
    sized = sized.withColumn("_left", F.when(some, F.col(seats) - F.sum("_sure").over(group)).otherwise(0))
    seat = sized.withColumn("_k", F.explode(F.sequence("_sure", "_most")))
    order = W.partitionBy(*by).orderBy((F.col(votes) / (2 * F.col("_k") + 1)).desc(), F.col(name).asc_nulls_last(), "_k")
    won = seat.withColumn("_won", (F.row_number().over(order) <= F.col("_left")).cast("long"))
    keys = [c for c in parties.columns]
    return won.groupBy(*keys).agg((F.max("_sure") + F.sum("_won")).alias(out))


def source_targets(sources: DataFrame, source: str, size: str, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Targets of the sources: ``share`` of all sizes by weight, none above ``most`` times its size.

    ``sources`` has one row per source; weights follow the code point order of ``source``, null last,
    and repeat. The excess of a full source goes to the others by weight until none is above.
    """
    table = F.array(*[F.lit(w) for w in weights])
    every = W.orderBy(F.col(source).asc_nulls_last())
    rows = sources.withColumn("_w", F.element_at(table, F.pmod(F.row_number().over(every) - 1, F.lit(len(weights))) + 1).cast("long"))
    rows = rows.withColumn("_cap", F.lit(float(most)) * F.col(size))
    fill = W.orderBy(F.col("_cap") / F.col("_w"), F.col(source).asc_nulls_last())
    before, whole = fill.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    budget = F.least(F.lit(float(share)) * F.sum(size).over(whole), F.sum("_cap").over(whole))
    rows = rows.withColumns({
        "_i": F.row_number().over(fill), "_budget": budget,
        "_level": (budget - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        / (F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0))),
    })
    rows = rows.withColumn("_open", F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_i"))).over(whole))
    level = F.max(F.when(F.col("_i") == F.col("_open"), F.col("_level"))).over(whole)
    target = F.when((F.col("_i") < F.col("_open")) | F.col("_open").isNull(), F.col("_cap")).otherwise(level * F.col("_w"))
    return rows.withColumns({"target": target, "budget": F.col("_budget")}).drop("_w", "_cap", "_i", "_level", "_open", "_budget")


def mix_events(
    events: DataFrame, event_id: str = "event_id", source: str = "cloud_resource_id", canonical_string: str = "canonical_string",
    weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block_tokens: int = 64,
    shard_tokens: int = 1 << 20, seed: int = 42,
    carry: list[str] | None = None,
) -> DataFrame:
    """How many tokens (words) of each event text a mix of the sources takes.

    A source is the cloud resource that the events belong to, or any other column. Sizes are the words
    of ``canonical_string`` (null: 0). Sources get targets (``source_targets``), then whole blocks of
    ``block_tokens`` by highest quotients, and each source deals its blocks in the same way to shards
    of about ``shard_tokens`` words, into which its events fall by a seeded hash (``dealt_rows``). Within a shard the
    events lie in seeded order, and the quota is taken as whole passes plus one run of blocks from a
    seeded block, round the end if need be. The largest shard of a source takes the few words between
    whole blocks and the target. No shard gives more than ``most`` = 2 passes.

    Returns ``event_id``, ``source``, ``size``, ``source_size``, ``target``, ``taken``, and for those
    who cut texts ``passes`` (whole passes) and ``spans`` (array of start, length: words taken once
    more), then ``carried``, a struct of the columns named in ``carry``, if any. Null source: a source of its own, last. Rows that share an id count each for itself. An
    empty text or an empty table takes nothing.

    Rows are sized once and written as a slim table. Only sources and shards are ever ranked together;
    rows are ranked inside shards of bounded size, so a source of a third of all rows spreads, and so
    do the rows of one repeated id.
    """
    words = F.coalesce(F.regexp_count(F.col(canonical_string).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    kept = ["carried"] if carry else []
    sized = written(events.select(
        F.col(event_id).alias("event_id"), F.col(source).alias("source"), words.alias("size"), F.spark_partition_id().alias("_bucket"),
        *[F.struct(*carry).alias(c) for c in kept]), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sources, "source", "source_size", weights, share, most)
    targets = targets.withColumns({
        "_seats": F.floor(F.col("budget") / block_tokens),
        "_shards": F.greatest(F.ceil(F.col("source_size") / shard_tokens), F.lit(1)),
    })
    quotas = apportion(targets, "target", "_seats", "source", out="_blocks").drop("budget", "_seats")
    quotas = written(quotas, "quotas")

    placed = written(dealt_rows(null_safe_join(sized, quotas, ["source"]), seed), "placed")
    shards = null_safe_join(sized_shards(placed), quotas, ["source"])
    dealt = apportion(shards, "_words", "_blocks", "_shard", ["source"], "_quota")
    largest = F.row_number().over(W.partitionBy("source").orderBy(F.col("_words").desc(), "_shard")) == 1
    rest = F.floor(F.col("target") + 0.5) - F.col("_blocks") * block_tokens
    quota = F.col("_quota") * block_tokens + F.when(largest, rest).otherwise(0)
    start = seeded(seed, F.coalesce(F.col("source").cast("string"), F.lit("")), F.col("_shard"))
    dealt = dealt.withColumn("_take", F.least(F.greatest(quota, F.lit(0)), (F.lit(most) * F.col("_words")).cast("long")))
    dealt = dealt.select(
        "source", "_shard", "_words", F.when(F.col("_words") > 0, F.floor(F.col("_take") / F.col("_words"))).otherwise(0).alias("passes"),
        F.when(F.col("_words") > 0, F.pmod(F.col("_take"), F.col("_words"))).otherwise(0).alias("_run"),
        (F.pmod(as_number(start), F.greatest(F.ceil(F.col("_words") / block_tokens), F.lit(1))) * block_tokens).alias("_from"),
    )

    within = W.partitionBy("source", "_shard").orderBy("_order", F.col("event_id").asc_nulls_last(), "size")
    rows = placed.withColumn("_at", F.sum("size").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    rows = null_safe_join(rows, dealt, ["source", "_shard"])

    def overlap(low: Column, high: Column) -> Column:
        first = F.greatest(low - F.col("_at"), F.lit(0))
        length = F.greatest(F.least(high - F.col("_at"), F.col("size")) - first, F.lit(0))
        return F.struct(first.cast("long").alias("start"), length.cast("long").alias("length"))

    end = F.col("_from") + F.col("_run")
    spans = F.filter(F.array(overlap(F.col("_from"), F.least(end, F.col("_words"))), overlap(F.lit(0), end - F.col("_words"))), lambda s: s["length"] > 0)
    rows = rows.withColumn("spans", spans)
    taken = F.col("passes") * F.col("size") + F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return rows.select("event_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "passes", "spans", *kept)


def dealt_rows(rows: DataFrame, seed: int) -> DataFrame:
    """``rows`` with ``_order``, their seeded hash, and ``_shard``, below ``_shards``.

    A row whose id is alone in its source falls by that hash. Rows that share an id (null is '') there
    fall by a hash of id, size, carried columns and a number among equal rows, so they spread too. The
    number is counted in buckets, the partitions that the rows were written from (``_bucket``): equal
    rows of one bucket are numbered together, and buckets follow each other.
    """
    rows = rows.withColumn("_order", seeded(seed, F.coalesce(F.col("event_id").cast("string"), F.lit(""))))
    seen = ["carried"] if "carried" in rows.columns else []
    rows = rows.withColumn("_like", F.xxhash64(F.col("event_id").isNull(), *seen))
    cells = rows.groupBy("_order", "source", "size", "_like", "_bucket").agg(F.count("*").alias("_n"))
    shared = cells.groupBy("_order", "source").agg(F.sum("_n").alias("_rows")).where("_rows > 1").drop("_rows")
    earlier = W.partitionBy("_order", "source", "size", "_like").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    cells = null_safe_join(cells, shared, ["_order", "source"]).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    cell = ["_order", "source", "size", "_like", "_bucket"]
    rows = rows.withColumn("_number", F.row_number().over(W.partitionBy(*cell).orderBy("_like")) - 1)
    rows = null_safe_join(rows, cells, cell, "left")
    mixed = seeded(seed, F.coalesce(F.col("event_id").cast("string"), F.lit("")), F.col("size"), F.col("_like"), F.col("_before") + F.col("_number"))
    fall = as_number(F.when(F.col("_before").isNull(), F.col("_order")).otherwise(mixed))
    return rows.withColumn("_shard", F.pmod(fall, F.col("_shards"))).drop("_like", "_number", "_before", "_bucket")


def sized_shards(placed: DataFrame) -> DataFrame:
    return placed.groupBy("source", "_shard").agg(F.sum("size").alias("_words"))


def cut_words(text: Column, span: Column) -> Column:
    """The words ``span`` (start, length) of a text with the white space that follows them, and before
    the first word also the white space that the text begins with: the span of all words is the text."""
    pieces = F.split(F.regexp_replace(text, LEADING, ""), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    cut = F.array_join(F.slice(pieces, (span["start"] + 1).cast("int"), span["length"].cast("int")), "")
    return F.when(span["start"] == 0, F.concat(F.regexp_extract(text, LEADING, 0), cut)).otherwise(cut)
