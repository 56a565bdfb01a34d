"""Structured Streaming into a store, and a background compactor."""

from __future__ import annotations

import logging
import threading

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from stratolog.plans.store import DEFAULT_TRIGGER, Store
from stratolog.schema import conform


def upsert_stream(changes: DataFrame, store: Store, checkpoint: str, trigger: dict | None = None, compact_at: int | None = None) -> StreamingQuery:
    """Append each micro-batch of changelog rows to store, compacting at compact_at segments.

    A batch that is replayed after a failure appends the same records again with newer seqs in the
    same order, which resolves to the same view.
    """
    conform(changes)

    def append(batch: DataFrame, _: int) -> None:
        store.write_batch(batch)
        if compact_at:
            store.compact(compact_at)

    return changes.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class BackgroundCompactor:
    """Polls store and compacts when trigger segments have piled up; starting twice is a no-op."""

    def __init__(self, store: Store, trigger: int = DEFAULT_TRIGGER, poll_interval: float = 0.2):
        if trigger < 2:
            raise ValueError("trigger must be at least 2")
        self.store, self.trigger, self.poll = store, trigger, poll_interval
        self._stop, self._thread = threading.Event(), None

    def _run(self) -> None:
        while not self._stop.wait(self.poll):
            try:
                self.store.compact(self.trigger)
            except Exception:
                logging.getLogger(__name__).exception("compaction failed; it will be tried again")

    def start(self) -> None:
        if self._thread is None or not self._thread.is_alive():
            self._stop.clear()
            self._thread = threading.Thread(target=self._run, daemon=True)
            self._thread.start()

    def stop(self, timeout: float | None = None) -> None:
        self._stop.set()
        if self._thread is not None:
            self._thread.join(timeout)
