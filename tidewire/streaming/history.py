"""Dedup of a stream over its whole history (T5).

The reference drops a record id that any earlier run has kept, however long ago.  A watermark would
forget it, so the state has none: it holds 16 bytes of digest per distinct id in a RocksDB state store,
which keeps it on disk and not on the heap, and whose changes go to the stream's checkpoint.  The state
grows with the distinct ids and nothing else (no payload, no dates); ``state_size`` reports it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schema as S

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_of_history(df: DataFrame, key: str = S.RID) -> DataFrame:
    """The stream's rows whose id came with no row before; rows without an id all stay.
    Among rows of one micro-batch with the same id one stays."""
    one, two = F.xxhash64(F.col(key)), F.xxhash64(F.lit(7), F.col(key))
    # a row without an id gets a digest of its own
    lone = F.expr("uuid()")
    return (df.withColumn("_1", F.when(F.col(key).isNull(), F.xxhash64(lone)).otherwise(one)).withColumn("_2", two)
            .dropDuplicates(["_1", "_2"]).drop("_1", "_2"))


def start_deduped(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, key: str = S.RID) -> StreamingQuery:
    """Start a stream that hands each micro-batch's first rows to ``write(batch, batch_id)`` and
    stops when the source is drained; started again on its checkpoint it goes on with its state."""
    conf = df.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKSDB)
    try:
        return (first_of_history(df, key).writeStream.foreachBatch(write).outputMode("append")
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        if before is None:
            conf.unset(PROVIDER)
        else:
            conf.set(PROVIDER, before)


def land_deduped(df: DataFrame, target: str, checkpoint: str, key: str = S.RID, date: str = S.DATE) -> StreamingQuery:
    """``start_deduped`` into a folder by batch and day; a batch that is run again overwrites its own folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("day", F.to_date(F.col(date))).write.mode("overwrite").partitionBy("day").parquet(f"{target.rstrip('/')}/batch={batch_id}")

    return start_deduped(df, write, checkpoint, key)


def state_size(query: StreamingQuery) -> dict[str, int]:
    """Rows and bytes that the stream's last batch left in its state."""
    last = [p for p in query.recentProgress if p.stateOperators]
    ops = last[-1].stateOperators if last else []
    return {"rows": sum(o.numRowsTotal for o in ops), "bytes": sum(o.memoryUsedBytes for o in ops)}
