"""A log of the state store as a stream: offsets are manifest versions, and a batch is the rows that its versions have appended.

    spark.dataSource.register(LogSource)
    rows = spark.readStream.format("state_log").schema(schema).option("path", root).option("table", "messages").load()

Only manifests are read to plan a batch; each appended Parquet file is one partition, read by the task that owns it in Arrow batches.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import DataStreamWriter

from snapledger.state.store import COMPACTED, Change, StateStore

BATCHES = "batch_id long"


class FilePart(InputPartition):
    """One appended Parquet file."""

    def __init__(self, path: str):
        self.path = path


def _file_system(root: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(root)


class LogReader(DataSourceStreamReader):
    """Plans batches from manifests and reads appended files."""

    def __init__(self, schema, options: dict):
        self.schema, self.root, self.table = schema, options["path"].rstrip("/"), options["table"]
        self.since = int(options.get("since", 0))
        self.step = int(options.get("versionsperbatch", options.get("versionsPerBatch", 0)))

    def _manifest(self, version: int) -> list[str]:
        if not version:
            return []
        fs, root = _file_system(self.root)
        with fs.open_input_stream(f"{root}/manifests/{version:012d}.json") as stream:
            found = json.loads(stream.readall()).get(self.table, [])
        return [found] if isinstance(found, str) else found

    def _latest(self) -> int:
        from pyarrow.fs import FileSelector

        fs, root = _file_system(self.root)
        names = [f.base_name for f in fs.get_file_info(FileSelector(f"{root}/manifests", allow_not_found=True))]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(".")), default=0)

    def initialOffset(self) -> dict:
        return {"version": self.since}

    def latestOffset(self) -> dict:
        return {"version": self._latest()}

    def appended(self, start: int, end: int) -> list[str]:
        """The folders that versions after start, up to end, have added, in their order.

        Version after version is compared with the one before: a compaction adds no rows, and is told by its folder's name; any other rewrite of
        the log raises ValueError, as its new rows cannot be told from the old.
        """
        added, old = [], self._manifest(start)
        for version in range(start + 1, end + 1):
            new = self._manifest(version)
            if new[: len(old)] == old:
                added += new[len(old) :]
            elif not (len(new) == 1 and COMPACTED in new[0]):
                raise ValueError(f"{self.table} was rewritten by version {version}")
            old = new
        return added

    def partitions(self, start: dict, end: dict) -> list[FilePart]:
        from pyarrow.fs import FileSelector

        fs, root = _file_system(self.root)
        parts = []
        for folder in self.appended(start["version"], end["version"]):
            files = fs.get_file_info(FileSelector(f"{root}/{folder}"))
            parts += [FilePart(f.path) for f in files if f.base_name.endswith(".parquet")]
        return parts

    def read(self, partition: FilePart) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(self.schema)
        fs, _ = _file_system(self.root)
        with fs.open_input_file(partition.path) as stream:
            file = pq.ParquetFile(stream)
            have = set(file.schema_arrow.names)
            for batch in file.iter_batches(columns=[n for n in wanted.names if n in have]):
                columns = [
                    batch.column(batch.schema.get_field_index(f.name)).cast(f.type, safe=False) if f.name in have else pa.nulls(batch.num_rows, f.type) for f in wanted
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=wanted)

    def commit(self, end: dict) -> None:
        """Nothing to let go: folders belong to the store."""


class LogSource(DataSource):
    """The data source `state_log`: options path (the store's root), table, and since (a version; zero reads the whole log)."""

    @classmethod
    def name(cls) -> str:
        return "state_log"

    def schema(self) -> str:
        raise ValueError("a state_log needs .schema(...): it is that of the log")

    def streamReader(self, schema) -> LogReader:
        return LogReader(schema, self.options)


def read_log(spark: SparkSession, store: StateStore, table: str, schema, since: int = 0) -> DataFrame:
    """A stream of the rows of a log, those of versions after since."""
    spark.dataSource.register(LogSource)
    return spark.readStream.format("state_log").schema(schema).option("path", store.root).option("table", table).option("since", str(since)).load()


def pump(messages: DataFrame, store: StateStore, table: str, checkpoint: str, send: Callable[[DataFrame], DataFrame]) -> DataStreamWriter:
    """Send a stream of messages by batches: send(batch) gives receipts, which are appended to a log with the batch's number as one commit.

    A batch that is replayed after a restart finds its number and changes nothing, so the log has each message's receipt once. What send
    does outside of the store happens at least once: it is told the same messages again if the process dies before the commit.
    """
    marks = f"{table}_batches"

    def commit(batch: DataFrame, batch_id: int) -> None:
        def work(version: int) -> Change:
            done = store.read(marks, version, BATCHES)
            if done is not None and not done.where(F.col("batch_id") == batch_id).isEmpty():
                return Change()
            mark = store.spark.createDataFrame([(batch_id,)], BATCHES)
            return Change(appends={marks: mark, table: send(batch)})

        store.transact(work)

    return messages.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
