"""A versioned table: full-state snapshots in partitions, the newest is current.  Single writer, last one wins."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionedTable:
    """Rows have an `id` and a position `pos`; columns may come and go between snapshots."""

    RESERVED = ("id", "body")

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _stamp(self) -> str:
        return datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%fZ")

    def create(self, schema: str) -> str:
        return self.write(self.spark.createDataFrame([], schema))

    def write(self, rows: DataFrame, stamp: str | None = None) -> str:
        stamp = stamp or self._stamp()
        rows.write.parquet(f"{self.path}/snapshot_ts={stamp}")
        return stamp

    def history(self) -> list[str]:
        """The names of the snapshots that were committed, oldest first; one that died while written has no marker."""
        marks = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/snapshot_ts=*/_SUCCESS")
        found = marks.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).globStatus(marks) or []
        return sorted(str(f.getPath().getParent().getName()).split("=", 1)[1] for f in found)

    def at(self, stamp: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/snapshot_ts={stamp}")

    def latest(self) -> DataFrame:
        return self.at(self.history()[-1])

    def append(self, rows: DataFrame) -> str:
        new = rows if "id" in rows.columns else rows.withColumn("id", F.expr("uuid()"))
        return self.write(self.latest().unionByName(new, allowMissingColumns=True))

    def update(self, changes: DataFrame) -> str:
        """Changed columns by id; an id that isn't there, or is changed twice, is an error."""
        now = self.latest()
        if changes.groupBy("id").count().where("count > 1").limit(1).count():
            raise ValueError("an id is changed twice")
        lost = changes.join(now, "id", "left_anti").limit(1).count()
        if lost:
            raise KeyError("an id to update is not in the table")
        return self.write(updated(now, changes))

    def delete(self, ids: DataFrame) -> str:
        return self.write(self.latest().join(ids.select("id").distinct(), "id", "left_anti"))

    def rename_column(self, old: str, new: str) -> str:
        self._free(old, new)
        return self.write(self.latest().withColumnRenamed(old, new))

    def drop_column(self, name: str) -> str:
        self._free(name)
        return self.write(self.latest().drop(name))

    def set_column(self, name: str, value: Column) -> str:
        self._free(name)
        return self.write(self.latest().withColumn(name, value))

    def reorder(self, ids: DataFrame) -> str:
        return self.write(reordered(self.latest(), ids))

    def _free(self, *names: str) -> None:
        if any(n in self.RESERVED for n in names):
            raise ValueError("a reserved column can't be changed")


def updated(now: DataFrame, changes: DataFrame) -> DataFrame:
    """`now` with the columns of `changes` (one row for each id) set."""
    cols = [c for c in changes.columns if c != "id"]
    new = changes.select("id", *(F.col(c).alias(f"_new_{c}") for c in cols), F.lit(True).alias("_hit"))
    out = now.join(new, "id", "left")
    pick = [F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c) if c in now.columns else F.lit(None)).alias(c) if c in cols else F.col(c) for c in dict.fromkeys([*now.columns, *cols])]
    return out.select(*pick)


def reordered(now: DataFrame, ids: DataFrame) -> DataFrame:
    """`ids` (id, pos) first in their order, the others after them as they were."""
    front = ids.select("id", F.col("pos").alias("_front"))
    return now.join(front, "id", "left").withColumn("pos", F.when(F.col("_front").isNotNull(), F.col("_front")).otherwise(F.col("pos") + (1 << 40))).drop("_front")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """key, change and old/new values of rows that were added, removed or changed."""
    a = before.select(key, *(F.col(c).alias(f"old_{c}") for c in columns), F.lit(True).alias("_a"))
    b = after.select(key, *(F.col(c).alias(f"new_{c}") for c in columns), F.lit(True).alias("_b"))
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~same, "changed")
    return a.join(b, key, "full").withColumn("change", change).where("change is not null").drop("_a", "_b")
