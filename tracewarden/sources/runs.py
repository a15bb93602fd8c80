"""Append-only tables of many small epochs, merged level by level into sorted runs.

A run is a Parquet folder. What belongs to the table is said by its newest manifest, a small JSON file that
appears whole or not at all, so readers never see half an epoch and a repeated epoch replaces itself.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 1 << 16
SLOT = "_slot"
ROWS_PER_FILE = 1_000_000
#: Manifests that stay for readers that have just opened an older one.
KEPT_MANIFESTS = 20


class Conflict(RuntimeError):
    """Another writer has published a manifest in between."""


@dataclass(frozen=True)
class Run:
    """Epochs ``first`` to ``last`` in one folder. ``files`` are (name, rows, lowest slot, highest slot) of a merged run;
    a run of one epoch has none, and is read whole."""

    name: str
    level: int
    first: int
    last: int
    files: list = field(default_factory=list)



def slot_of(key: str) -> Column:
    """The slot by which rows are sorted: a hash of the key."""
    return F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int")


def pack_epochs(epochs: Iterable[int]) -> list[list[int]]:
    """Rising numbers as [start, step, count]: regular epochs stay a few triples however many there are."""
    out: list[list[int]] = []
    for e in epochs:
        if out and out[-1][2] == 1:
            out[-1][1:] = [e - out[-1][0], 2]
        elif out and e == out[-1][0] + out[-1][1] * out[-1][2]:
            out[-1][2] += 1
        else:
            out.append([e, 0, 1])
    return out


def unpack_epochs(packed: list[list[int]]) -> list[int]:
    return [start + step * i for start, step, count in packed for i in range(count)]


class RunTable:
    """One table of epochs below ``root``.

    ``append`` writes an epoch as a run of its own. As soon as ``fanout`` runs of one level lie before the epoch, they
    become one run of the next level, sorted by slots of ``key`` and cut into files by them, with Parquet's Bloom filter on
    ``key``. So a table of n epochs has about fanout * log(n) runs, every row is rewritten log(n) times, and a
    look-up of some keys opens the files of their slots only. With ``history=False`` nothing is merged and only the epoch and the
    one before it stay, for tables that say where things stand.

    The epoch that is written, and later ones, are never merged with others, so the last epoch may be written again.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, fanout: int = 4, history: bool = True, rows_per_file: int = ROWS_PER_FILE):
        if fanout < 2:
            raise ValueError("at least two runs are merged")
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        self.fanout, self.history, self.rows_per_file = fanout, history, rows_per_file

    # --- manifest ----------------------------------------------------------------------------------
    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        folder = self._path("_manifest")
        if not self._files().exists(folder):
            return []
        names = [s.getPath().getName() for s in self._files().listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> tuple[int, list[Run], list[int]]:
        """(version, runs in order of their epochs, all epochs that were written), by default the newest one."""
        version = max(self._versions(), default=-1) if version is None else version
        if version < 0:
            return -1, [], []
        stream = self._files().open(self._path(f"_manifest/{version:012d}.json"))
        try:
            told = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return version, [Run(**r) for r in told["runs"]], unpack_epochs(told["epochs"])

    def _publish(self, version: int, runs: list[Run], epochs: list[int]) -> None:
        jvm, folder = self.spark._jvm, "_manifest"
        text = json.dumps({"runs": [asdict(r) for r in sorted(runs, key=lambda r: r.first)], "epochs": pack_epochs(sorted(epochs))})
        temporary = self._path(f"{folder}/.{uuid.uuid4().hex}.tmp")
        out = self._files().create(temporary)
        out.write(text.encode())
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)  # fails if the name is taken
        try:
            context.rename(temporary, self._path(f"{folder}/{version:012d}.json"), plain)
        except Py4JJavaError as error:
            self._files().delete(temporary, False)
            if "FileAlreadyExists" in str(error.java_exception):
                raise Conflict(f"manifest {version} of {self.root} exists") from error
            raise
        for old in self._versions():
            if old <= version - KEPT_MANIFESTS:
                self._files().delete(self._path(f"{folder}/{old:012d}.json"), False)

    # --- writing -----------------------------------------------------------------------------------
    def _write(self, df: DataFrame, level: int, first: int, last: int) -> Run:
        name = f"run-{level}-{first}-{last}-{uuid.uuid4().hex[:8]}"
        path = f"{self.root}/{name}"
        (df.sortWithinPartitions(SLOT, self.key).write
            .option(f"parquet.bloom.filter.enabled#{self.key}", "true").option(f"parquet.bloom.filter.expected.ndv#{self.key}", self.rows_per_file)
            .parquet(path))
        if level == 0:
            return Run(name, level, first, last)
        stored = self.spark.read.parquet(path)
        found = stored.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n"), F.min(SLOT).alias("low"), F.max(SLOT).alias("high"))
        files = sorted((r["file"], r["n"], r["low"], r["high"]) for r in found.collect())  # one row a file
        return Run(name, level, first, last, [list(f) for f in files])

    def append(self, df: DataFrame, epoch: int, covers: list[int] | None = None) -> None:
        """Write an epoch, or write it again. A row belongs to its epoch by the column ``epoch``; ``covers`` names
        further epochs that are settled by it."""
        version, runs, epochs = self.manifest()
        if any(r.level > 0 and r.first <= epoch <= r.last for r in runs):
            raise ValueError(f"epoch {epoch} has been merged with later ones and cannot be written again")
        others = [r for r in runs if not r.first == r.last == epoch]
        others = self._merged(others, epoch) if self.history else [r for r in others if r.last > epoch] + others_before(others, epoch)
        rows = df.drop("epoch").withColumns({"epoch": F.lit(epoch), SLOT: slot_of(self.key)})
        own = self._write(rows.hint("rebalance"), 0, epoch, epoch)
        self._publish(version + 1, [*others, own], sorted({*epochs, epoch, *(covers or [])}))

    def replace(self, df: DataFrame, epoch: int) -> None:
        """One run in place of all there are."""
        version, _, epochs = self.manifest()
        own = self._write(df.drop("epoch").withColumns({"epoch": F.lit(epoch), SLOT: slot_of(self.key)}).hint("rebalance"), 0, epoch, epoch)
        self._publish(version + 1, [own], sorted({*epochs, epoch}))

    def _merged(self, runs: list[Run], epoch: int) -> list[Run]:
        level = 0
        while any(r.level >= level for r in runs):
            ready = [r for r in runs if r.level == level and r.last < epoch]
            if len(ready) >= self.fanout:
                rows = self._frame(ready, None)
                parts = -(-rows.count() // self.rows_per_file)
                spread = rows.repartitionByRange(max(parts, 1), SLOT, self.key) if parts > 1 else rows.coalesce(1)
                merged = self._write(spread, level + 1, min(r.first for r in ready), max(r.last for r in ready))
                runs = [r for r in runs if r not in ready] + [merged]
            level += 1
        return runs

    # --- reading -----------------------------------------------------------------------------------
    def _frame(self, runs: list[Run], slots: list[int] | None) -> DataFrame:
        def wanted(low: int, high: int) -> bool:
            return slots is None or any(low <= s <= high for s in slots)

        paths = [f"{self.root}/{r.name}" for r in runs if not r.files]
        paths += [f"{self.root}/{r.name}/{f[0]}" for r in runs for f in r.files if wanted(f[2], f[3])]
        if paths:
            return self.spark.read.option("basePath", self.root).parquet(*paths)
        return self.spark.read.parquet(f"{self.root}/{runs[-1].name}").limit(0)

    def _runs(self, before: int | None, version: int | None) -> list[Run]:
        runs = [r for r in self.manifest(version)[1] if before is None or r.first < before]
        return runs if self.history else runs[-1:]

    def read(self, before: int | None = None, version: int | None = None) -> DataFrame | None:
        """All rows (of the last epoch, where only that counts), or those of earlier epochs, with their ``epoch``; None if
        there is no epoch. A ``version`` that a
        reader has noted stays readable until ``vacuum``, and as long as its manifest is kept."""
        runs = self._runs(before, version)
        if not runs:
            return None
        df = self._frame(runs, None).drop(SLOT)
        return df if before is None or all(r.last < before for r in runs) else df.where(F.col("epoch") < before)

    def near(self, keys: DataFrame, before: int | None = None, version: int | None = None) -> DataFrame | None:
        """The rows of the files that may hold some of ``keys`` (a column named as the table's key)."""
        runs = self._runs(before, version)
        if not runs:
            return None
        slots = sorted(r[0] for r in keys.select(slot_of(self.key)).distinct().collect())  # at most SLOTS numbers
        df = self._frame(runs, slots).drop(SLOT)
        return df if before is None or all(r.last < before for r in runs) else df.where(F.col("epoch") < before)

    def since(self, known: set[int]) -> DataFrame | None:
        """The rows of epochs that are not ``known``, from the runs that hold some; None if there are none."""
        _, runs, epochs = self.manifest()
        fresh = [e for e in epochs if e not in known]
        runs = [r for r in runs if any(r.first <= e <= r.last for e in fresh)]
        if not runs:
            return None
        spans = pack_epochs(fresh)
        new = F.lit(False)
        for start, step, count in spans:
            e = F.col("epoch")
            inside = (e >= start) & (e <= start + step * (count - 1))
            new = new | (inside & ((e - start) % step == 0) if step else e == start)
        return self._frame(runs, None).where(new).drop(SLOT)

    def read_epoch(self, epoch: int) -> DataFrame:
        _, runs, _ = self.manifest()
        own = [r for r in runs if r.first <= epoch <= r.last]
        if not own:
            raise KeyError(epoch)
        return self._frame(own, None).where(F.col("epoch") == epoch).drop(SLOT, "epoch")

    def epochs(self) -> list[int]:
        return self.manifest()[2]

    def vacuum(self) -> list[str]:
        """Delete the folders that the newest manifest does not name; for times without readers of older ones."""
        _, runs, _ = self.manifest()
        known, gone = {r.name for r in runs}, []
        for status in self._files().listStatus(self._path("")):
            name = status.getPath().getName()
            if name.startswith("run-") and name not in known:
                self._files().delete(status.getPath(), True)
                gone.append(name)
        return gone


def others_before(runs: list[Run], epoch: int) -> list[Run]:
    """The last run before an epoch."""
    earlier = [r for r in runs if r.last < epoch]
    return [max(earlier, key=lambda r: r.last)] if earlier else []
