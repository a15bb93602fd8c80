"""Near-duplicate vectors by int8 tile products with proven error bounds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import written

PIVOTS = 32
TILE_ROWS = 4096
BLOCK = 1024
#: Integer products are exact in 32-bit floats up to this many components.
EXACT_COMPONENTS = 1024
#: Rounding of double precision sums, far above what can occur.
ROUNDING = 1e-9


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes, scale and length of the quantisation error of each unit vector."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None])
    return codes.astype(np.int8), scale, np.linalg.norm(unit - codes * scale[:, None], axis=1)


def linked(x: tuple, y: tuple, threshold: float) -> np.ndarray:
    """Pairs of two blocks with cosine >= threshold, as a boolean matrix.

    With a code product c, |cosine - c| <= e_x + (1 + e_x) e_y for the two error lengths. Pairs that the
    bound settles are settled; the others are computed again in double precision.
    """
    (codes_x, scale_x, error_x, unit_x), (codes_y, scale_y, error_y, unit_y) = x, y
    product = np.zeros((len(codes_x), len(codes_y)))
    for at in range(0, codes_x.shape[1], EXACT_COMPONENTS):
        part = slice(at, at + EXACT_COMPONENTS)
        product += codes_x[:, part].astype(np.float32) @ codes_y[:, part].astype(np.float32).T
    product *= scale_x[:, None]
    product *= scale_y[None, :]
    # one bound for the block: the largest errors in it
    a, b = float(error_x.max()), float(error_y.max())
    bound = a + (1 + a) * b + ROUNDING
    out = product >= threshold + bound
    i, j = np.nonzero((product >= threshold - bound) & ~out)
    for at in range(0, len(i), 65_536):
        p, q = i[at:at + 65_536], j[at:at + 65_536]
        out[p, q] = np.einsum("ij,ij->i", unit_x[p], unit_y[q]) >= threshold
    return out


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node that the links (i, j) connect it with."""
    low = np.arange(n)
    while len(i):
        new = low.copy()
        m = np.minimum(low[i], low[j])
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        new = new[new]
        if (new == low).all():
            break
        low = new
    return low


def usable(vector: str) -> F.Column:
    """Not null, no null or non-finite component, not zero."""
    value = F.col(vector).cast("array<double>")
    fine = F.forall(value, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(fine & F.exists(value, lambda v: v != 0), F.lit(False))


def near_vectors(events: DataFrame, event_id: str = "event_id", features: str = "features", threshold: float = 0.9) -> DataFrame:
    """Links and classes of feature vectors by cosine: ``event_id``, ``n_links``, ``component_id``, ``kept``.

    ``features`` is an array of numbers, such as the feature vector of a flow or event in model order.
    Every pair of usable vectors of equal length counts, whatever else the rows hold. ``n_links`` is the
    number of other rows linked directly, ``component_id`` the smallest id that links reach.

    Equal vectors are one with a multiplicity (a grouped minimum). Every vector belongs to the cell of
    its nearest pivot (32 vectors picked by hash); the range of angles that a cell has to each pivot
    rules out pairs of cells by the triangle inequality. Cells are cut into tiles, and a pair of tiles
    is one task: int8 codes are multiplied, bounds decide, and only open pairs are computed again in
    double precision. A task returns a count per vector and a spanning forest, never pairs. The work is
    quadratic where the cells do not separate; it is cut into equal tasks of bounded memory.

    Null, zero, non-finite or null-holding vectors link with nothing: 0 links, a class of their own.
    Rows that share an id are one node, and each of them counts in the others' links. Rows with a null
    id count as partners; their own class is null and they are kept. An empty table gives no rows.
    """
    spark = events.sparkSession
    rows = events.select(F.col(event_id).alias("event_id"), F.col(features).alias("vector"))
    rows = rows.withColumn("_hash", F.when(usable("vector"), F.xxhash64("vector")))
    kind = rows.schema["event_id"].dataType.simpleString()
    units = rows.where("_hash is not null").groupBy("vector").agg(F.min("event_id").alias("event_id"), F.count("*").alias("copies"))
    units = written(units.select("event_id", "copies", F.xxhash64("vector").alias("_hash"), F.col("vector").cast("array<double>").alias("vector"), F.size("vector").alias("_dim")), "vectors")

    pivots = {}
    for r in units.orderBy("_hash").limit(PIVOTS).collect():
        pivots.setdefault(r["_dim"], []).append(np.array(r["vector"]) / np.linalg.norm(r["vector"]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("_dim").to_numpy()
            cells, angles = np.zeros(len(dims), dtype=np.int64), [None] * len(dims)
            lists = batch.column("vector")
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                x = np.array([lists[i].values.to_numpy() for i in own])
                x /= np.linalg.norm(x, axis=1)[:, None]
                if dim in pivots:
                    angle = np.arccos(np.clip(x @ np.array(pivots[dim]).T, -1, 1))
                    cells[own] = angle.argmin(axis=1)
                    for i, a in zip(own, angle):
                        angles[i] = a.tolist()
                else:
                    for i in own:
                        angles[i] = []
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cells), pa.array(angles, pa.list_(pa.float64()))], [*batch.schema.names, "_cell", "_angles"])

    columns = f"event_id {kind}, copies long, _hash long, vector array<double>, _dim int"
    placed = written(units.mapInArrow(place, f"{columns}, _cell long, _angles array<double>"), "cells")
    ranges = placed.groupBy("_dim", "_cell").agg(
        F.count("*").alias("n"), *[f(F.get("_angles", F.lit(p))).alias(f"{name}{p}") for p in range(PIVOTS) for name, f in (("lo", F.min), ("hi", F.max))])
    # at most PIVOTS cells for each vector length
    cells = ranges.collect()
    reach = math.acos(threshold) + 1e-6

    def apart(a: dict, b: dict) -> bool:
        sides = [(a[f"lo{p}"], a[f"hi{p}"], b[f"lo{p}"], b[f"hi{p}"]) for p in range(PIVOTS)]
        return any(w is not None and y is not None and (w > z + reach or y > x + reach) for w, x, y, z in sides)

    tiles = {(c["_dim"], c["_cell"]): -(-c["n"] // TILE_ROWS) for c in cells}
    # each tile is sent to the tiles it may meet: (dim, cell, tile) -> (own side, pair)
    near = [(a, b) for a in cells for b in cells if a["_dim"] == b["_dim"] and a["_cell"] <= b["_cell"] and not apart(a, b)]
    met = {}
    for a, b in near:
        met.setdefault((a["_dim"], a["_cell"]), []).append((b["_cell"], tiles[b["_dim"], b["_cell"]]))
        if a["_cell"] != b["_cell"]:
            met.setdefault((b["_dim"], b["_cell"]), []).append((a["_cell"], tiles[a["_dim"], a["_cell"]]))
    meets = spark.createDataFrame(
        [(d, c, tiles[d, c], other, n) for (d, c), others in met.items() for other, n in others], "_dim int, _cell long, _own long, _other long, _n long")
    dealt = placed.drop("_angles").join(F.broadcast(meets), ["_dim", "_cell"])  # at most PIVOTS squared rows for each vector length
    dealt = dealt.withColumn("_tile", F.pmod(F.xxhash64("_hash"), F.col("_own"))).withColumn("_with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    mine, theirs = F.struct(F.col("_cell").alias("c"), F.col("_tile").alias("t")), F.struct(F.col("_other").alias("c"), F.col("_with").alias("t"))
    dealt = dealt.select("event_id", "copies", "_hash", "vector", F.struct("_dim", F.least(mine, theirs).alias("a"), F.greatest(mine, theirs).alias("b")).alias("_pair"), (mine <= theirs).alias("_left"), (mine == theirs).alias("_same"))

    def multiply(table: pa.Table) -> pa.Table:
        left, same = table.column("_left").to_numpy(), table.column("_same")[0].as_py()
        vectors = table.column("vector").combine_chunks()
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        unit = flat.reshape(len(vectors), -1)
        unit = unit / np.linalg.norm(unit, axis=1)[:, None]
        copies, codes = table.column("copies").to_numpy(), quantised(unit)
        n, links_i, links_j = np.zeros(len(unit), dtype=np.int64), [], []
        rows_x, rows_y = (np.arange(len(unit)),) * 2 if same else (np.flatnonzero(left), np.flatnonzero(~left))
        low = np.arange(len(unit))
        for p in range(0, len(rows_x), BLOCK):
            i = rows_x[p:p + BLOCK]
            for q in range(p if same else 0, len(rows_y), BLOCK):
                j = rows_y[q:q + BLOCK]
                hit = linked((*(c[i] for c in codes), unit[i]), (*(c[j] for c in codes), unit[j]), threshold)
                if same and p == q:
                    np.fill_diagonal(hit, False)
                if hit.any():
                    n[i] += hit @ copies[j]
                    if not (same and p == q):
                        n[j] += copies[i] @ hit
                    a, b = np.nonzero(hit)
                    near = spanning(np.concatenate([i[a], np.arange(len(unit))]), np.concatenate([j[b], low]), len(unit))
                    low = near
        some = pa.array(np.flatnonzero(n))
        return pa.table({
            "event_id": table.column("event_id").take(some), "_hash": table.column("_hash").take(some), "n": n[some.to_numpy()],
            "parent": table.column("event_id").take(pa.array(low[some.to_numpy()]))})

    found = written(dealt.groupBy("_pair").applyInArrow(multiply, f"event_id {kind}, _hash long, n long, parent {kind}"), "tile-links")
    totals = found.groupBy("_hash", "event_id").agg(F.sum("n").alias("n"))
    totals = units.select("event_id", "copies", "_hash", "vector").join(totals.withColumnRenamed("event_id", "_t"), ["_hash"], "left")
    totals = totals.where(F.col("_t").eqNullSafe(F.col("event_id")) | F.col("_t").isNull()).select(
        "_hash", F.col("event_id").alias("_first"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    counted = rows.select("event_id", "_hash").join(totals, "_hash", "left")
    counted = written(counted.select("event_id", "_first", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "vector-links")
    edges = found.select(F.col("event_id").alias("a"), F.col("parent").alias("b")).unionByName(
        counted.where("_first <> event_id").select(F.col("_first").alias("a"), F.col("event_id").alias("b")))
    classes = components(edges.where("a <> b"))
    out = counted.join(classes.withColumnRenamed("id", "event_id"), "event_id", "left")
    named = F.coalesce("component_id", "event_id")
    return out.select("event_id", "n_links", named.alias("component_id"), F.coalesce(named == F.col("event_id"), F.lit(True)).alias("kept"))
