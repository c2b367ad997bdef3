"""Deliveries as a stateful stream with timers: claims run out, failed ones come due again, and finished ones are forgotten.

The state of a delivery lives in Spark's state store under its id; `transformWithState` needs the RocksDB provider:
spark.sql.streaming.stateStore.providerClass = org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from snapledger.operators.queues import TRANSITIONS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "status string, owner string, attempts int, until_ms long"
OUT = "id long, status string, owner string, attempts int, until timestamp, cause string"
_MOVES = {(event, before): after for event, before, after in TRANSITIONS}
# States that nothing follows, and the one that an operator has to look at.
FINISHED, UNCERTAIN = ("sent",), "uncertain"


class DeliveryMachine(StatefulProcessor):
    """Moves one delivery by its events (id, seq, event, owner, seconds) and by time.

    The moves are those of the batch machine, by the owner of a claim only. A claim lasts `seconds`; a failure makes the delivery due again
    after `seconds`, and it cannot be claimed before; an ambiguous end stays uncertain until someone decides. A sent delivery is
    remembered for keep_seconds, so that late events do not send it again. A delivery that is new starts as staged.
    """

    def __init__(self, keep_seconds: float):
        self.keep_ms = int(keep_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("delivery", STATE)

    def _wait(self, until_ms: int | None) -> None:
        """Leave one timer at most: that of what the delivery waits for now."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if until_ms is not None:
            self.handle.registerTimer(until_ms)

    def _row(self, key, cause: str) -> Row:
        status, owner, attempts, until = self.state.get()
        return Row(id=key[0], status=status, owner=owner, attempts=attempts, until=None if until is None else datetime.fromtimestamp(until / 1000, timezone.utc), cause=cause)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        status, owner, attempts, until = self.state.get() if self.state.exists() else ("staged", "", 0, None)
        # all events of one delivery that came in one batch
        for e in sorted(rows, key=lambda r: r["seq"]):
            after = _MOVES.get((e["event"], status))
            waits = status == "pending" and until is not None and until > now
            if after is None or (status == "claimed" and e["owner"] != owner) or (e["event"] == "claim" and waits):
                continue
            wait = int((e["seconds"] or 0) * 1000)
            if e["event"] == "claim":
                owner, attempts, until = e["owner"], attempts + 1, now + wait
            elif e["event"] == "failed" and wait > 0:
                owner, until = "", now + wait
            elif after in FINISHED:
                owner, until = "", now + self.keep_ms
            else:
                owner, until = "", None
            status = after
        self.state.update((status, owner, attempts, until))
        self._wait(until)
        yield self._row(key, "event")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, owner, attempts, until = self.state.get()
        if until is None or until > expiredTimerInfo.getExpiryTimeInMs():
            return
        if status in FINISHED:
            self.state.clear()
            return
        cause = "lease ended" if status == "claimed" else "due"
        self.state.update(("pending", "", attempts, None))
        yield self._row(key, cause)

    def close(self) -> None:
        pass


def delivery_states(events: DataFrame, keep_seconds: float = 7 * 86_400) -> DataFrame:
    """A stream of what deliveries become, as events (id, seq, event, owner, seconds) come in and as time goes by.

    One row per delivery and batch of events, and one per timer that moves it: `lease ended` for a claim that ran out, `due` for a failed
    delivery whose delay is over. Timers need no new input, only the query's trigger.
    """
    return events.groupBy("id").transformWithState(DeliveryMachine(keep_seconds), OUT, "Update", "ProcessingTime")
