"""An incremental fold: each poll takes only items that no earlier poll has seen, and those that failed again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def fold_items(items: DataFrame, key: str, convert: Callable[[DataFrame], DataFrame], folder: str, max_tries: int | None = None) -> StreamingQuery:
    """Runs a stream of items (files that arrive, say) once over all there is, and keeps the results in `folder`.

    convert: items to rows with a boolean column `ok`.  Rows that are ok are appended to `folder`/done, each key once
    ever; the items of the others are offered to the next poll again, until they were tried `max_tries` times (None: for
    ever).  Keys that were seen are in the state store, and failed items come back as a stream of their own with the
    number of their tries, so a poll's cost is that of what is new and what failed, however many polls came before.  A
    batch writes folders of its own, so that one that is repeated after a failure replaces what it wrote.

    On a cluster with very many keys set the RocksDB provider for the state store.
    """
    spark, failed = items.sparkSession, f"{folder}/failed"
    schema = items.withColumn("tries", F.lit(0)).schema
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{failed}/none")  # a stream needs a file to begin with
    again = spark.readStream.schema(schema).parquet(f"{failed}/*")
    offered = items.dropDuplicates([key]).withColumn("tries", F.lit(0)).unionByName(again)

    def poll(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        convert(batch.drop("tries")).where("ok").drop("ok").write.mode("overwrite").parquet(f"{folder}/done/batch={number}")
        done = spark.read.parquet(f"{folder}/done/batch={number}").select(key)
        rest = batch.join(done, key, "left_anti").select(*batch.columns).withColumn("tries", F.col("tries") + 1)
        if max_tries is not None:
            rest = rest.where(F.col("tries") < max_tries)
        rest.write.mode("overwrite").parquet(f"{failed}/{number}")
        batch.unpersist()

    return offered.writeStream.foreachBatch(poll).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
