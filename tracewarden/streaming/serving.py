"""Read-only views of the log: latest state per resource, and lookups by event."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parse_rfc3339
from ..sources.runs import RunTable


def latest_state(log: DataFrame, resource: str) -> DataFrame:
    """Event count and last event per resource; a hot resource combines map-side to one row per task.

    Time is compared as time; of events of one instant the larger id is the last, as in
    ``merge_latest``.
    """
    last = F.max(F.struct(parse_rfc3339(F.col("timestamp")).alias("t"), "event_id", "timestamp"))
    return log.groupBy(resource).agg(F.count("*").alias("events"), last.alias("l")).select(
        resource, "events", F.col("l.timestamp").alias("last_timestamp"), F.col("l.event_id").alias("last_event_id"))


def by_event(log: DataFrame, event_id: str) -> DataFrame:
    return log.where(F.col("event_id") == event_id)


def by_resource(log: DataFrame, resource_id: str) -> DataFrame:
    return log.where(F.col("resource_id") == resource_id).orderBy(parse_rfc3339(F.col("timestamp")), "event_id")


def merge_latest(current: DataFrame, fresh: DataFrame, resource: str) -> DataFrame:
    """Latest state after new records: counts add up, the later event wins."""
    both = current.unionByName(fresh)
    last = F.max(F.struct(parse_rfc3339(F.col("last_timestamp")).alias("t"), "last_event_id", "last_timestamp"))
    return both.groupBy(resource).agg(F.sum("events").alias("events"), last.alias("l")).select(
        resource, "events", F.col("l.last_timestamp").alias("last_timestamp"), F.col("l.last_event_id").alias("last_event_id")
    )


class ServingView:
    """A synced copy of the log's state: the latest state per resource, and the records by event and by resource.

    A sync reads the epochs that it has not seen, and nothing else of the log. It adds them to tables of sorted runs and
    merges their latest states into the last ones; then it moves the versions held here, so readers never see
    half a sync and may keep the ``versions`` they began with. A failed sync keeps the previous copy readable.
    There is no write path from the view back to the log.
    """

    TABLES = {"latest": "resource_id", "by_event": "event_id", "by_resource": "resource_id"}

    def __init__(self, spark: SparkSession, log_path: str, root: str, fanout: int = 4):
        self.spark, self.log_path, self.root, self.fanout = spark, log_path, root.rstrip("/"), fanout
        self.versions: dict[str, int] | None = None
        self.synced_at: float | None = None

    @property
    def version(self) -> int | None:
        return None if self.versions is None else self.versions["latest"]

    def table(self, name: str) -> RunTable:
        return RunTable(self.spark, f"{self.root}/{name}", self.TABLES[name], self.fanout, history=name != "latest")

    def sync(self, now: float) -> bool:
        """Take over new epochs. False if there is no log; the view then stays as it was.

        A log that is a plain Parquet folder has no epochs and is taken over whole.
        """
        log = RunTable(self.spark, self.log_path, "event_id")
        epochs = log.epochs()
        if not epochs:
            return self._sync_whole(now)
        known = set(self.table("latest").epochs())
        # an epoch may have been written again since, so what is known is known by its number
        fresh = log.since(known)
        if fresh is not None:
            last = max(epochs)
            for name in ("by_event", "by_resource"):
                self._add(self.table(name), fresh, last)
            state, before = latest_state(fresh, "resource_id"), self.table("latest").read()
            self._add(self.table("latest"), state if before is None else merge_latest(before.drop("epoch"), state, "resource_id"), last, epochs)
        self.versions = {name: self.table(name).manifest()[0] for name in self.TABLES}
        self.synced_at = now
        return True

    def _sync_whole(self, now: float) -> bool:
        try:
            log = self.spark.read.parquet(self.log_path)
        except AnalysisException as exc:  # a log that is not there must not take the old view away
            if exc.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return False
        epoch = max(self.table("latest").epochs(), default=-1) + 1
        for name in self.TABLES:
            self.table(name).replace(latest_state(log, "resource_id") if name == "latest" else log, epoch)
        self.versions, self.synced_at = {name: self.table(name).manifest()[0] for name in self.TABLES}, now
        return True

    def _add(self, table: RunTable, df: DataFrame, epoch: int, epochs: list[int] | None = None) -> None:
        if epoch not in table.epochs():  # an earlier sync may have ended half way
            table.append(df, epoch, epochs)

    def _read(self, name: str, versions: dict[str, int] | None) -> DataFrame | None:
        versions = versions or self.versions
        return None if versions is None else self.table(name).read(version=versions[name]).drop("epoch")

    def frame(self, versions: dict[str, int] | None = None) -> DataFrame | None:
        """The latest state of every resource."""
        return self._read("latest", versions)

    def event(self, event_id: str, versions: dict[str, int] | None = None) -> DataFrame | None:
        """The record of an event, from the files that may hold it."""
        return self._near("by_event", event_id, versions)

    def resource(
        self, resource_id: str, after: tuple[str, str] | None = None, limit: int | None = None, versions: dict[str, int] | None = None,
    ) -> DataFrame | None:
        """The records of a resource in order of time, then of event; a page of ``limit`` that begins behind the
        (timestamp, event_id) ``after``."""
        df = self._near("by_resource", resource_id, versions)
        return df if df is None else history_page(df, after, limit)

    def _near(self, name: str, key: str, versions: dict[str, int] | None) -> DataFrame | None:
        versions, column = versions or self.versions, self.TABLES[name]
        if versions is None:
            return None
        one = self.spark.createDataFrame([(key,)], f"{column} string")
        return self.table(name).near(one, version=versions[name]).drop("epoch").where(F.col(column) == key)

    def staleness(self, now: float) -> float | None:
        return None if self.synced_at is None else now - self.synced_at


def history_page(log: DataFrame, after: tuple[str, str] | None = None, limit: int | None = None) -> DataFrame:
    """Records in order of time, then of event, behind a (timestamp, event_id) already seen.

    With a limit every task keeps that many rows, so a page costs a scan of what the filters leave and no sort of it.
    """
    time = parse_rfc3339(F.col("timestamp"))
    if after is not None:
        seen, last = parse_rfc3339(F.lit(after[0])), F.lit(after[1])
        log = log.where((time > seen) | ((time == seen) & (F.col("event_id") > last)))
    ordered = log.orderBy(time, "event_id")
    return ordered if limit is None else ordered.limit(limit)
