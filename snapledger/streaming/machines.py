"""Structured Streaming forms of the folds, and snapshot ingestion."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from snapledger.operators import admission, fold, snapshot
from snapledger.state.store import StateStore

HEALTH = "source_id string, state string, consecutive_failures bigint, last_attempt_at timestamp"
LINK = "job_id string, state string, consecutive_gone bigint"


def _attempts(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    name, streak, last = ("pending", 0, pd.Timestamp.min) if not state.exists else state.get
    last = pd.Timestamp(last)
    for row in pd.concat(list(batches)).sort_values("arrival").itertuples():
        if row.at < last:
            continue
        last, streak, name = row.at, 0 if row.ok else streak + 1, "success" if row.ok else "failure"
    state.update((name, streak, last.to_pydatetime()))
    yield pd.DataFrame({"source_id": [key[0]], "state": [name], "consecutive_failures": [streak], "last_attempt_at": [last]})


def source_health(attempts: DataFrame) -> DataFrame:
    """A stream of the health of each source as attempts (source_id, arrival, at, ok) come in; late ones are ignored."""
    return attempts.groupBy("source_id").applyInPandasWithState(_attempts, HEALTH, "state string, streak bigint, last timestamp", "update", GroupStateTimeout.NoTimeout)


def _links(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    live, gone = (False, 0) if not state.exists else state.get
    for row in pd.concat(list(batches)).sort_values("seq").itertuples():
        if row.url_changed:
            live, gone = row.outcome == "live", int(row.outcome == "gone")
        elif row.outcome == "live":
            live, gone = True, 0
        elif row.outcome == "gone":
            gone += 1
    state.update((live, gone))
    name = "gone" if gone >= fold.GONE_AFTER else "live" if live else "unchecked"
    yield pd.DataFrame({"job_id": [key[0]], "state": [name], "consecutive_gone": [gone]})


def link_health(checks: DataFrame) -> DataFrame:
    """A stream of the state of each link as checks (job_id, seq, outcome, url_changed) come in."""
    return checks.groupBy("job_id").applyInPandasWithState(_links, LINK, "live boolean, gone bigint", "update", GroupStateTimeout.NoTimeout)


def ingest(observations: DataFrame, store: StateStore, now: datetime, checkpoint: str):
    """Fold a stream of observations (with pass_complete) into the store's tables; each batch is one commit.

    Rows are told apart by source, native id and time, so a batch that is replayed changes nothing. Rejected rows go to the
    ledger. Only sources whose pass is complete replace their active set.
    """

    def commit(batch: DataFrame, batch_id: int) -> None:
        version = store.version()
        done = store.read("batches", version)
        if done is not None and not done.where(F.col("batch_id") == batch_id).isEmpty():
            return
        batch = batch.dropDuplicates(["source_id", "source_native_id", "observed_at"])
        code = admission.rejection_code(now)
        accepted = batch.where(code.isNull())
        old = store.read("provenance", version)
        seen = fold.provenance(accepted.withColumn("snapshot_pending", F.lit(True)))
        if old is not None:
            seen = seen.unionByName(old)
        merged = seen.groupBy("job_id", "source_id", "source_native_id").agg(
            F.min("first_observed_at").alias("first_observed_at"), F.max("last_observed_at").alias("last_observed_at"), F.bool_or("active").alias("active")
        )
        passes = snapshot.complete_passes(batch.select("source_id", F.col("pass_complete").alias("complete")))
        tables = {
            "provenance": snapshot.reconcile(merged, accepted.select("source_id", "job_id"), passes),
            "rejections": admission.rejection_ledger(batch, now, store.read("rejections", version)),
        }
        mark = batch.sparkSession.createDataFrame([(batch_id,)], "batch_id long")
        tables["batches"] = mark if done is None else done.unionByName(mark)
        store.commit(tables, version)

    return observations.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True)
