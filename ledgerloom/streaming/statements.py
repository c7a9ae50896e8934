"""A folder of statements as a stream: each file that arrives is read once and its movements are committed as one version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators.store import Store
from ledgerloom.sources.delimited import Preset
from ledgerloom.sources.statements import MOST_BYTES, decode

FILES = "path string, modificationTime timestamp, length long, content binary"


def ingest(spark: SparkSession, folder: str, preset: Preset, store: Store, checkpoint: str, pattern: str = "*") -> StreamingQuery:
    """Read the files that are there and not yet read, through ``preset``, into the table ``candidates`` of ``store``; files over the upload limit are left out.

    The stream's checkpoint remembers which files it has seen.
    """
    stream = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).load(folder)

    def commit(batch: DataFrame, _: int) -> None:
        store.commit({"candidates": preset.read(decode(batch.select("path", "content")))})

    return stream.filter(f"length <= {MOST_BYTES}").writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
