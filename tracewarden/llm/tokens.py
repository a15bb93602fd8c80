"""Token-id output: whole texts encoded and written as wavelet-matrix shards, and read back."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .encoding import encoded
from .storage import shared_folder, written
from .wavelet import WaveletMatrix

SAMPLE_PER_RANGE = 100


def write_token_shards(
    payloads: DataFrame, tokenizer: str, event_id: str = "event_id", canonical_string: str = "canonical_string",
    end_id: int = 2, bits: int = 16, shard_tokens: int = 1 << 21, spaced: bool = False, folder: str | None = None,
) -> DataFrame:
    """Encode every payload text and write the ids in ascending ``event_id`` order.

    ``payloads`` is any table with a sortable id (integer or text) and a text, such as the canonical
    strings of the alerts; other columns are ignored. ``tokenizer`` is the path of a ``tokenizers``
    file on every worker, ``end_id`` follows each text, ``bits`` planes must hold every id.

    Texts are encoded where they are read; only the ids are shuffled, by ranges of ``event_id`` whose
    borders come from a sample (100 ids per shuffle partition; they shape the files, not the result).
    A task sorts its range and closes a file after ``shard_tokens`` ids or one longer text, so memory
    does not follow the size of a range. Files get their final name when they are complete, and a
    repeated task writes the same ones.

    Returns the manifest: ``folder``, ``shard``, ``part`` (in id order), ``path``, ``n_events``,
    ``n_tokens``, ``first_token`` (ids before it). Null text: the end id alone. Null ids come first;
    rows that share an id are all kept, ordered by their ids. An empty table has an empty manifest.
    """
    spark = payloads.sparkSession
    slim = payloads.select(F.col(event_id).alias("event_id"), F.col(canonical_string).cast("string").alias("text"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted, there = SAMPLE_PER_RANGE * ranges, slim.count()
    sample = slim.select("event_id").where("event_id is not null").sample(min(1.0, wanted / max(there, 1)), 7)
    ids = sorted(r[0] for r in sample.limit(2 * wanted).collect())
    borders = sorted({ids[len(ids) * i // ranges] for i in range(1, ranges)}) if ids else []
    kind = slim.schema["event_id"].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, starts, tokens in encoded(batches, tokenizer, spaced, end_id, "text"):
            if len(tokens) and int(tokens.max()) >> bits:
                raise ValueError(f"an id needs more than {bits} bits")
            raw = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [
                None, pa.py_buffer(starts * tokens.itemsize), pa.py_buffer(tokens)])
            keys = part.column("event_id").to_pylist()
            where = np.zeros(len(keys), dtype=np.int32)
            if borders:
                found = np.searchsorted(np.array(borders), np.array([borders[0] if k is None else k for k in keys]), side="right")
                where = np.where([k is None for k in keys], 0, found).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("event_id"), pa.array(where, pa.int32()), raw.cast(pa.binary())], ["event_id", "shard", "tokens"])

    out = folder or shared_folder(spark, "tokens")
    width = np.uint16 if bits <= 16 else np.uint32

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(out)
        files.create_dir(root, recursive=True)
        shard, part, keys, held = -1, 0, [], []

        def close() -> pa.RecordBatch:
            tokens = np.concatenate(held)
            matrix = WaveletMatrix.build(tokens, bits, keys, np.array([len(x) for x in held]))
            name = f"{root}/shard-{shard:06d}-{part:06d}.wm"
            with files.open_output_stream(temporary := f"{name}.{uuid.uuid4().hex}.tmp") as stream:
                stream.write(matrix.to_bytes())
            files.move(temporary, name)
            row = [out, shard, part, name.rsplit("/", 1)[1], len(keys), len(tokens)]
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["folder", "shard", "part", "path", "n_events", "n_tokens"])

        size = 0
        for batch in batches:
            for key, here, raw in zip(*(batch.column(c).to_pylist() for c in ("event_id", "shard", "tokens"))):
                if held and (here != shard or size + len(raw) // width().itemsize > shard_tokens):
                    yield close()
                    part, size, keys, held = (part + 1 if here == shard else 0), 0, [], []
                shard = here
                keys.append(key)
                held.append(np.frombuffer(raw, dtype=width))
                size += len(held[-1])
        if held:
            yield close()

    coded = slim.mapInArrow(encode, f"event_id {kind.simpleString()}, shard int, tokens binary")
    ranged = coded.repartitionById(ranges, "shard").sortWithinPartitions("shard", "event_id", "tokens")
    manifest = written(ranged.mapInArrow(write, "folder string, shard long, part long, path string, n_events long, n_tokens long"), "manifest")
    # one row per file of millions of ids
    before = F.sum("n_tokens").over(W.orderBy("shard", "part").rowsBetween(W.unboundedPreceding, -1))
    return manifest.withColumn("first_token", F.coalesce(before, F.lit(0)))


def read_token_shards(spark: SparkSession, manifest: DataFrame, id_type: str = "string") -> DataFrame:
    """The records of the written shards: ``event_id``, ``start`` (ids of all records before it),
    ``n_tokens`` and ``ids_crc32`` (unsigned CRC-32 of the ids as little-endian 32-bit integers).

    Files are read by Spark's binary file source, a file at a time. An empty manifest gives no rows.
    """
    folder = manifest.select("folder").first()
    schema = f"path string, event_id {id_type}, local long, n_tokens long, ids_crc32 long"
    if folder is None:
        return spark.createDataFrame([], f"event_id {id_type}, start long, n_tokens long, ids_crc32 long")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                matrix = WaveletMatrix.from_bytes(content.as_buffer().to_pybytes())
                tokens = matrix.tokens().astype("<u4")
                ends = np.cumsum(matrix.counts)
                starts = ends - matrix.counts
                crc = [zlib.crc32(tokens[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array([path.rsplit("/", 1)[1]] * len(crc)), pa.array(matrix.ids, batch_type), pa.array(starts),
                    pa.array(matrix.counts), pa.array(crc, pa.int64())], ["path", "event_id", "local", "n_tokens", "ids_crc32"])

    batch_type = to_arrow_type(T.StructType.fromDDL(f"x {id_type}")[0].dataType)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").load(folder[0]).select("path", "content")
    rows = files.mapInArrow(decode, schema).join(manifest.select("path", "first_token"), "path")
    return rows.select("event_id", (F.col("first_token") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
