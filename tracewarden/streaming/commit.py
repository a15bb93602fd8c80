"""Asynchronous evidence commit as a streaming job.

Every micro-batch is one *epoch*. It takes the new events and the retries that are due, sets aside
repeated ids with a reason, calls the commit check once, and appends records, blocks, outcomes and the
rows still pending as runs of its own. Running an epoch again replaces exactly its own
runs and reads only earlier ones, so a replay after a failure changes nothing.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import BATCH_SIZE, MAX_ATTEMPTS
from ..functions.text import rfc3339
from ..operators import ledger as G
from ..operators.reports import loss_accounting
from ..sources.runs import RunTable
from . import retry

EVENT_COLUMNS = ["event_id", "chain", "payload_digest", "resource_id", "seq", "enqueued_sec"]
EVENT_SCHEMA = (
    "event_id string, chain string, payload_digest string, resource_id string, seq bigint, enqueued_sec double"
)
EPOCHS_PER_BATCH = 1000  # epoch = batch_id * 1000 + drain round


#: The key of every table, and the tables of which only the last state counts.
KEYS = {"blocks": "chain", "heads": "chain"}
STATES = ("heads", "pending")


@dataclass
class CommitLog:
    """The log as tables of epochs (``sources.runs``): taken, attempts, records, blocks, heads, outcomes, settled, pending.

    ``fanout`` epochs are merged into one sorted run, and so on, so the files that an epoch opens grow with the logarithm
    of the log.
    """

    spark: SparkSession
    root: str
    fanout: int = 4

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    def table(self, table: str) -> RunTable:
        return RunTable(self.spark, self.path(table), KEYS.get(table, "event_id"), self.fanout, table not in STATES)

    def read(self, table: str, before: int | None = None) -> DataFrame | None:
        return self.table(table).read(before)

    def read_epoch(self, table: str, epoch: int) -> DataFrame:
        return self.table(table).read_epoch(epoch)

    def write(self, df: DataFrame, table: str, epoch: int) -> None:
        self.table(table).append(df, epoch)

    def epochs(self, table: str) -> list[int]:
        """Epochs that ran, whether or not they left rows behind."""
        return self.table(table).epochs()


CommitCheck = Callable[[DataFrame], DataFrame]


def always_commits(batch: DataFrame) -> DataFrame:
    return batch.withColumn("error", F.lit(None).cast("string"))


class EvidenceCommitter:
    """Commits events epoch by epoch.

    ``commit`` receives the rows to try (with ``attempt``) and returns them with ``error``, null on
    success. It runs once per epoch: its result is written before anything is derived from it.
    """

    def __init__(
        self, log: CommitLog, commit: CommitCheck = always_commits, max_attempts: int = MAX_ATTEMPTS,
        batch_size: int = BATCH_SIZE, clock: Callable[[], float] = time.time,
    ):
        self.log, self.commit, self.max_attempts = log, commit, max_attempts
        self.batch_size, self.clock = batch_size, clock

    # --- one epoch ---------------------------------------------------------------------------
    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        """``foreachBatch`` entry point."""
        self.run_epoch(batch.select(*EVENT_COLUMNS), batch_id * EPOCHS_PER_BATCH)

    def run_epoch(self, fresh: DataFrame, epoch: int, wait: bool = True) -> None:
        now = self.clock()
        due, waiting = self._pending(epoch, now if wait else float("inf"))
        tries = fresh.select(*EVENT_COLUMNS, F.lit(1).alias("attempt"))
        if due is not None:
            tries = tries.unionByName(due.select(*EVENT_COLUMNS, (F.col("attempt") + 1).alias("attempt")))
        self._take(tries, epoch)
        tries = self.log.read_epoch("taken", epoch).where("reason is null").drop("reason")
        self.log.write(self.commit(tries).withColumn("tried_sec", F.lit(now)), "attempts", epoch)

        done = self.log.read_epoch("attempts", epoch)
        self._append_blocks(done.where("error is null"), epoch)
        final = done.where(F.col("error").isNull() | (F.col("attempt") >= self.max_attempts))
        self.log.write(final.select(
            "event_id", F.when(F.col("error").isNull(), "committed").otherwise("dead_lettered").alias("outcome"),
            F.col("attempt").alias("attempts"), "enqueued_sec", F.col("tried_sec").alias("finished_sec"), "error",
        ), "outcomes", epoch)
        self.log.write(final.select("event_id"), "settled", epoch)
        pending = done.where(F.col("error").isNotNull() & (F.col("attempt") < self.max_attempts)).select(
            *EVENT_COLUMNS, "attempt", "tried_sec", "error")
        if waiting is not None:
            pending = pending.unionByName(waiting.select(*pending.columns))
        self.log.write(pending, "pending", epoch)

    def _pending(self, epoch: int, now: float) -> tuple[DataFrame | None, DataFrame | None]:
        earlier = [e for e in self.log.epochs("pending") if e < epoch]
        if not earlier:
            return None, None
        rows = retry.with_state(self.log.read_epoch("pending", earlier[-1]), "tried_sec", now, self.max_attempts)
        return rows.where("state = 'due'"), rows.where("state = 'waiting'")

    def _take(self, tries: DataFrame, epoch: int) -> None:
        """Write every row of the epoch to ``taken``, with a reason where it is not tried.

        Of the rows of one id the further attempt is tried, then the earlier arrival; the others are
        repeats. An id the log has settled is refused whenever it comes back; an epoch opens the files of settled
        ids that may hold its own ones.
        """
        settled = self.log.table("settled").near(tries, epoch)
        settled = settled if settled is None else settled.select("event_id")
        order = [F.col("attempt").desc(), "seq", *[c for c in EVENT_COLUMNS if c not in ("event_id", "seq")]]
        told = G.with_reject_reason(tries, settled, "event_id", order)
        self.log.write(told.select(*EVENT_COLUMNS, "attempt", "reason"), "taken", epoch)

    def rejected(self) -> DataFrame | None:
        """Submissions that were not tried, with their reason."""
        taken = self.log.read("taken")
        return None if taken is None else taken.where(F.col("reason").isNotNull())

    def _append_blocks(self, committed: DataFrame, epoch: int) -> None:
        batches = G.assign_batches(committed, "seq", ["chain"], self.batch_size)
        roots = G.batch_roots(batches, "payload_digest", ["chain"]).withColumnRenamed("batch_no", "block_number")
        heads = self._heads(epoch)
        self.log.write(G.link_blocks(roots, "chain", heads=heads), "blocks", epoch)
        now = G.chain_heads(self.log.read_epoch("blocks", epoch), "chain")
        if heads is not None:
            now = now.unionByName(heads.join(now.select("chain"), "chain", "left_anti"))
        self.log.write(now, "heads", epoch)
        numbered = batches if heads is None else batches.join(heads.select("chain", "next_block"), "chain", "left")
        offset = F.lit(0) if heads is None else F.coalesce("next_block", F.lit(0))
        blocks = self.log.read_epoch("blocks", epoch).select("chain", "block_number", "merkle_root")
        records = numbered.withColumn("block_number", F.col("batch_no") + offset).join(blocks, ["chain", "block_number"])
        self.log.write(records.select(
            "event_id", "chain", "payload_digest", "resource_id", "seq", "block_number", "leaf_index", "merkle_root",
            F.col("tried_sec").alias("committed_sec"), rfc3339(F.timestamp_millis((F.col("tried_sec") * 1000).cast("long"))).alias("timestamp")), "records", epoch)

    def _heads(self, epoch: int) -> DataFrame | None:
        """Where every chain stands after the last epoch, one row per chain; no block is read again."""
        earlier = [e for e in self.log.epochs("heads") if e < epoch]
        return self.log.read_epoch("heads", earlier[-1]) if earlier else None

    # --- stream ------------------------------------------------------------------------------
    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = True, interval: str = "5 seconds"):
        """Run on a streaming frame; with ``available_now`` it stops after the present input."""
        writer = stream.writeStream.foreachBatch(self.on_batch).option("checkpointLocation", checkpoint)
        trigger = {"availableNow": True} if available_now else {"processingTime": interval}
        return writer.trigger(**trigger).start()

    def drain(self) -> int:
        """After the stream has stopped: try what is pending until every event is settled.

        Backoff is not waited for. Returns the number of rounds; ``max_attempts`` of them suffice.
        """
        epochs = self.log.epochs("pending")
        if not epochs:
            return 0
        epoch, rounds = epochs[-1], 0
        empty = self.log.spark.createDataFrame([], EVENT_SCHEMA)
        while not self.log.read_epoch("pending", epoch).isEmpty():
            epoch, rounds = epoch + 1, rounds + 1
            self.run_epoch(empty, epoch, wait=False)
        return rounds

    def accounting(self, submitted: DataFrame) -> DataFrame:
        outcomes = self.log.read("outcomes")
        if outcomes is None:
            outcomes = self.log.spark.createDataFrame([], "event_id string, outcome string, attempts int")
        return loss_accounting(submitted, outcomes.select("event_id", "outcome", "attempts"), rejected=self.rejected())
