"""Streaming ingest, merge and repair of perspectives (STR1, STR2, STR5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from duelbook.functions.times import micros
from duelbook.operators.merge import conform, first_per_key, reconcile_repair, repair_candidates
from duelbook.sources import store_index
from duelbook.sources.history import rows_of, touched_days, update_history, write_history
from duelbook.sources.paths import exists

# A re-collected day may correct rows of that day and the next.
REPAIR_DELAY = "2 days"


def with_event_time(stream: DataFrame, delay: str = REPAIR_DELAY) -> DataFrame:
    """Watermark on ``event_ts``, an instant copy of the UTC wall clock ``ts``."""
    return stream.withColumn("event_ts", F.timestamp_micros(micros(F.col("ts")))).withWatermark("event_ts", delay)


def unique_perspectives(stream: DataFrame, delay: str = REPAIR_DELAY) -> DataFrame:
    """Each perspective once; state is dropped when the watermark passes."""
    return with_event_time(stream, delay).dropDuplicatesWithinWatermark(["perspective_id"])


def merge_into(stream: DataFrame, path: str, staging: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Field-wise upsert of every micro-batch into the partitioned history.

    A batch that is replayed after a failure merges to the same rows.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        update_history(batch.sparkSession, path, batch.drop("event_ts"), f"{staging}/batch={batch_id}")

    return (stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def repair_from(stream: DataFrame, target_day, path: str, staging: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Reconcile re-collected perspectives of a day (and the one after) with the stored rows.

    Stored rows are found by perspective_id through the store's index, because a repair may move a row to another day; only
    days that change are read and rewritten.
    """
    def repair(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = repair_candidates(conform(batch.drop("event_ts")), target_day)
        new = first_per_key(new, ["perspective_id"], ["ts", *sorted(c for c in new.columns if c not in ("ts", "perspective_id"))])
        if not exists(spark, path):
            write_history(new, path)
            store_index.rebuild(spark, path)
            return
        days = touched_days(spark, path, new)
        touched = rows_of(spark, path, days)
        before = touched.select("league", F.col("ts").cast("date").alias("match_date")).distinct()
        folder = f"{staging}/batch={batch_id}"
        before.write.mode("overwrite").parquet(f"{folder}/days")
        reconcile_repair(conform(touched), new).drop("action").write.mode("overwrite").parquet(f"{folder}/rows")
        ready = spark.read.parquet(f"{folder}/rows")
        emptied = spark.read.parquet(f"{folder}/days").join(ready.select("league", F.col("ts").cast("date").alias("match_date")).distinct(),
                                                           ["league", "match_date"], "left_anti")
        write_history(ready, path)
        drop_partitions(spark, path, emptied)
        store_index.refresh(spark, path, new, ready, days, f"{folder}/index")

    return (stream.writeStream.foreachBatch(repair).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def drop_partitions(spark, path: str, partitions: DataFrame) -> None:
    """Remove day folders whose rows have all moved away (at most a few days per repair)."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for row in partitions.toLocalIterator():
        p = fs_path(f"{path}/league={row['league']}/match_date={row['match_date']}")
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
