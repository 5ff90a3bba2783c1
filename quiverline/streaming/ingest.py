"""Ingest from a stream: each micro-batch's valid rows are one commit, its rejects are kept with their reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import VectorTable


@dataclass
class Ingest:
    """A running ingest; errors are counted over its life."""

    table: VectorTable
    rejects: str
    name: str
    query: StreamingQuery | None = None
    inserted: int = 0
    errors: int = 0
    _told: int = 0

    def flush(self) -> int:
        """Wait until all that has arrived is in; how many rows were rejected since the last flush."""
        if self.query is not None:
            self.query.processAllAvailable()
        new, self._told = self.errors - self._told, self.errors
        return new

    def stop(self) -> None:
        self.flush()
        if self.query is not None:
            self.query.stop()

    def take(self, batch: DataFrame, number: int) -> None:
        """One writer: batches commit one after another.  The table's manifest holds the last number of each stream, published with
        its rows, so a batch that is delivered again is passed over, and its rejects stay as they are."""
        if number <= self.table.manifest["streams"].get(self.name, -1):
            return

        def keep(bad: DataFrame, count: int) -> None:
            if count:
                bad.write.mode("overwrite").parquet(f"{self.rejects}/batch={number}")
            self.errors += count

        n, _ = self.table.insert_valid(batch, (self.name, number), keep)
        self.inserted += n


def start(stream: DataFrame, table: VectorTable, checkpoint: str, rejects: str) -> Ingest:
    """Write a stream of `(id, vector[, label])` into a table; the source's own limits (`maxFilesPerTrigger`) hold it back.

    `checkpoint` also names the stream in the table's manifest.
    """
    ingest = Ingest(table, rejects, checkpoint)
    ingest.query = stream.writeStream.foreachBatch(ingest.take).option("checkpointLocation", checkpoint).start()
    return ingest


def bulk(rows: DataFrame, table: VectorTable) -> tuple[int, DataFrame]:
    """(rows inserted, rejects) of one batch."""
    return table.insert_valid(rows)
