"""Append-and-resume scoring, as a batch and as a stream.

A log is a folder of parts: `batch-<id>` for each call of score_batch, `stream-<stream>-<n>` for each micro-batch of a
stream. read_log reads them all. A record is known by its id: of repeated ids one request is scored, and requests
without an id are left out, since nothing could tell later that they were answered.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.operators.leakage import pending
from codeloom.sources import storage

Score = Callable[[DataFrame], DataFrame]


def _parts(spark: SparkSession, log_path: str, without: str | None = None) -> list[str]:
    """Folders of the log's parts that hold results, but for those of one stream."""
    names = [n for n in storage.names(spark, log_path) if n.startswith(("batch-", "stream-")) and not (without and n.startswith(without))]
    return [f"{log_path}/{n}" for n in names if "_SUCCESS" in storage.names(spark, f"{log_path}/{n}")]


def read_log(spark: SparkSession, log_path: str) -> DataFrame:
    """All results of a log; raises if there are none."""
    if not (parts := _parts(spark, log_path)):
        raise ValueError(f"no results in {log_path}")
    return spark.read.parquet(*parts)


def _todo(requests: DataFrame, parts: list[str], id_col: str) -> DataFrame:
    """Requests without a result in the parts.

    Only the id column is read, and only ids between the least and the greatest that are asked for, so Parquet's
    statistics leave most files of a log in id order out.
    """
    if not parts:
        return requests
    low, high = requests.agg(F.min(id_col), F.max(id_col)).first()
    if low is None:
        return requests
    return pending(requests, requests.sparkSession.read.parquet(*parts).select(id_col).where(F.col(id_col).between(low, high)), id_col)


def score_batch(requests: DataFrame, log_path: str, score: Score, id_col: str) -> int:
    """Scores what has no result yet and appends it; running it again does nothing. Returns the number of new rows."""
    spark = requests.sparkSession
    todo = _todo(requests.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]), _parts(spark, log_path), id_col)
    if todo.isEmpty():
        return 0
    part = f"{log_path}/batch-{uuid.uuid4().hex}"
    score(todo).write.parquet(part)
    return spark.read.parquet(part).count()


def score_stream(requests: DataFrame, log_path: str, checkpoint: str, score: Score, id_col: str, event_time: str | None = None, delay: str = "1 day") -> StreamingQuery:
    """The same for a stream of requests. The ids seen are the stream's keyed state, so a micro-batch meets no log of its own.

    A micro-batch that is replayed after a failure writes its own part anew. Only parts of batches and of other streams
    are asked for ids; a stream is known by its checkpoint folder. With event_time, a column of times, ids are
    forgotten after `delay`, so that state is bounded; requests that late are left out.
    """
    own = f"stream-{zlib.crc32(checkpoint.rstrip('/').encode()):08x}-"
    known = requests.where(F.col(id_col).isNotNull())
    if event_time is None:
        known = known.dropDuplicates([id_col])
    else:
        known = known.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([id_col])

    def each(batch: DataFrame, n: int) -> None:
        todo = _todo(batch, _parts(batch.sparkSession, log_path, without=own), id_col)
        score(todo).write.mode("overwrite").parquet(f"{log_path}/{own}{n:09d}")

    return known.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
