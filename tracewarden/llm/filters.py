"""Bloom filters of 64-bit names, built in pieces."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .urls import LANES, BlockedBloom

#: Blocks of a filter that one group builds.
CHUNK_BLOCKS = 2048


def name_filter(names: DataFrame, bits_per_name: int, most_bytes: int) -> BlockedBloom:
    """A filter of the column ``name`` (digests as long), of ``most_bytes`` at most.

    Names are dealt by the part of the filter that they fall into, so what comes to the driver is the
    filter itself and nothing more.
    """
    bloom = BlockedBloom.sized(names.count(), bits_per_name, most_bytes)
    blocks = len(bloom.words)

    def fill(group: pa.Table) -> pa.Table:
        own = BlockedBloom(blocks)
        own.add(group.column("name").to_numpy())
        chunk = group.column("chunk")[0].as_py()
        part = own.words[chunk * CHUNK_BLOCKS:(chunk + 1) * CHUNK_BLOCKS]
        return pa.table([pa.array([chunk], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["chunk", "words"])

    # the block that BlockedBloom gives a name: its upper half scaled to the number of blocks
    block = F.shiftrightunsigned(F.shiftrightunsigned("name", 32) * blocks, 32)
    dealt = names.select("name", F.floor(block / CHUNK_BLOCKS).alias("chunk"))
    for row in dealt.groupBy("chunk").applyInArrow(fill, "chunk long, words binary").toLocalIterator():
        words = np.frombuffer(row["words"], dtype=np.uint32).reshape(-1, LANES)
        bloom.words[row["chunk"] * CHUNK_BLOCKS:row["chunk"] * CHUNK_BLOCKS + len(words)] = words
    return bloom
