"""The commit log as keyed state: one processor per chain with its head, its open batch and its retries.

Where ``commit`` settles whole micro-batches and keeps its state in tables, this keeps it in Spark's state store, so a stream of
many small chains touches only the chains that have news, and time moves chains that have none: timers close batches that
wait too long and try failed events again. It needs the RocksDB state store provider (``keyed_conf``).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..constants import BACKOFF_BASE_SEC, BACKOFF_MULTIPLIER, BATCH_SIZE, GENESIS_HASH, MAX_ATTEMPTS

BLOCK_SCHEMA = (
    "chain string, block_number bigint, record_count bigint, merkle_root string, previous_hash string, hash string, "
    "event_ids array<string>, error string"
)
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_conf() -> dict[str, str]:
    """Settings that a session needs for keyed state."""
    return {"spark.sql.streaming.stateStore.providerClass": PROVIDER}


def merkle_root(leaves: list[str]) -> str:
    """The root of ``functions.merkle`` for the hex digests of one batch."""
    level = [bytes.fromhex(x) for x in leaves]
    while len(level) > 1:
        level += level[-1:] if len(level) % 2 else []
        level = [hashlib.sha256(a + b).digest() for a, b in zip(level[::2], level[1::2])]
    return level[0].hex()


def linked_block(chain: str, number: int, head: str, leaves: list[str]) -> tuple[str, str, str]:
    """(merkle root, previous hash, hash) of a block, as ``operators.ledger`` links them."""
    name, root = json.dumps(chain, ensure_ascii=False), merkle_root(leaves)
    text = f'{{"chain":{name},"index":{number},"merkle_root":"{root}","previous_hash":"{head}","record_count":{len(leaves)}}}'
    return root, head, hashlib.sha256(text.encode()).hexdigest()


class ChainProcessor(StatefulProcessor):
    """State of one chain. ``commit`` gets an event and its attempt and returns an error text, or None on success.

    Events of a micro-batch are taken in order of ``seq``. A full batch becomes a block at once. Without ``hold_sec`` what is left at
    the end of the chain's micro-batch is a block as well, as in the epoch path; with it, it stays open until it is
    full or so many seconds old. A failed event is tried again after the backoff of its attempt, and after
    ``max_attempts`` comes out as a row with ``error`` and no block. State holds less than a batch, and the events that wait
    for a retry.
    """

    def __init__(self, batch_size: int, hold_sec: float | None, commit: Callable[[dict, int], str | None] | None, max_attempts: int):
        self.batch_size, self.hold_sec, self.commit, self.max_attempts = batch_size, hold_sec, commit, max_attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "hash string, next_block bigint")
        self.open = handle.getListState("open", "event_id string, payload_digest string")
        self.opened = handle.getValueState("opened", "close_ms bigint")
        self.failed = handle.getListState("failed", "event_id string, payload_digest string, seq bigint, attempt int, due_ms bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803 - Spark's names
        fresh = sorted(((r["seq"], r["event_id"], r["payload_digest"]) for r in rows))  # one chain's rows of a micro-batch
        yield from self._settle(key[0], [(e, d, s, 1) for s, e, d in fresh], self._now(timerValues))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803 - Spark's names
        now = max(self._now(timerValues), expiredTimerInfo.getExpiryTimeInMs())
        waiting = [tuple(r) for r in self.failed.get()] if self.failed.exists() else []
        due = [(e, d, s, attempt + 1) for e, d, s, attempt, at in waiting if at <= now]
        if due:
            self._put(self.failed, [w for w in waiting if w[4] > now])
        yield from self._settle(key[0], sorted(due, key=lambda x: (x[2], x[0])), now)

    def close(self) -> None:
        pass

    # --- steps -------------------------------------------------------------------------------------
    def _now(self, timer_values: Any) -> int:
        if self.hold_sec is None and self.commit is None:
            return 0  # no timers, so no clock
        return timer_values.getCurrentProcessingTimeInMs()

    @staticmethod
    def _put(state: Any, rows: list[tuple]) -> None:
        state.put(rows) if rows else state.clear()

    def _settle(self, chain: str, tries: list[tuple], now: int) -> Iterator[Row]:
        batch = [tuple(r) for r in self.open.get()] if self.open.exists() else []
        failed = []
        for event_id, digest, seq, attempt in tries:
            error = self.commit({"event_id": event_id, "payload_digest": digest, "seq": seq}, attempt) if self.commit else None
            if error is None:
                batch.append((event_id, digest))
            elif attempt >= self.max_attempts:
                yield Row(chain=chain, block_number=None, record_count=None, merkle_root=None, previous_hash=None, hash=None, event_ids=[event_id], error=error)
            else:
                due = now + round(1000 * BACKOFF_BASE_SEC * BACKOFF_MULTIPLIER ** (attempt - 1))
                failed.append((event_id, digest, seq, attempt, due))
                self.handle.registerTimer(due)
        if failed:
            self._put(self.failed, ([tuple(r) for r in self.failed.get()] if self.failed.exists() else []) + failed)
        while len(batch) >= self.batch_size:
            yield self._block(chain, batch[:self.batch_size])
            batch = batch[self.batch_size:]
            self.opened.clear()
        if batch and self.hold_sec is not None:
            if not self.opened.exists():
                self.opened.update((now + round(1000 * self.hold_sec),))
                self.handle.registerTimer(self.opened.get()[0])
            elif self.opened.get()[0] <= now:
                yield self._block(chain, batch)
                batch = []
                self.opened.clear()
        elif batch:
            yield self._block(chain, batch)
            batch = []
        self._put(self.open, batch)

    def _block(self, chain: str, batch: list[tuple]) -> Row:
        head, number = self.head.get() if self.head.exists() else (GENESIS_HASH, 0)
        root, previous, own = linked_block(chain, number, head, [d for _, d in batch])
        self.head.update((own, number + 1))
        return Row(chain=chain, block_number=number, record_count=len(batch), merkle_root=root, previous_hash=previous, hash=own,
                   event_ids=[e for e, _ in batch], error=None)


def keyed_blocks(
    events: DataFrame, batch_size: int = BATCH_SIZE, hold_sec: float | None = None, commit: Callable[[dict, int], str | None] | None = None,
    max_attempts: int = MAX_ATTEMPTS,
) -> DataFrame:
    """Blocks of a stream of events (``chain``, ``event_id``, ``payload_digest``, ``seq``), and events given up.

    Without ``hold_sec`` and ``commit`` no timers are needed, and the query may run with ``availableNow``; with them it runs
    until it is stopped. Ids are taken as they come; repeats are removed before, by ``windows.distinct_events`` or the epoch path. A
    chain's rows of one micro-batch are sorted in its task, so the trigger bounds them.
    """
    processor = ChainProcessor(batch_size, hold_sec, commit, max_attempts)
    # a query with timers goes on for ever, and an availableNow trigger would never end
    timed = hold_sec is not None or commit is not None
    return events.select("chain", "event_id", "payload_digest", "seq").groupBy("chain").transformWithState(
        statefulProcessor=processor, outputStructType=BLOCK_SCHEMA, outputMode="append", timeMode="processingTime" if timed else "none")
