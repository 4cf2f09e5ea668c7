"""Tables by key that outlive a run: replies by content, and calls by day.

Both are Parquet folders whose partitions are replaced one by one: what changes is merged
with the old rows of the same partitions, set down in the shared folder, and then moved in
by a dynamic partition overwrite.  Spark moves files at the end of the job only, so a job
that dies leaves the store as it was, and a task that runs twice adds nothing twice.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.rules import DAILY_CALLS
from loomgraph.operators.graph import stored


class BudgetExceeded(RuntimeError):
    """Raised before a call is made, never after."""


@dataclass
class KeyedStore:
    """Rows of `schema` by `key`, the latest by `latest` counts; `parts` partitions by hash."""

    spark: SparkSession
    path: str
    schema: str
    key: str = "key"
    latest: str = "stored_at"
    parts: int = 256

    def rows(self) -> DataFrame:
        return self._held().drop("part")

    def _held(self) -> DataFrame:
        """All rows with their partition; none before the first put."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)
        schema = f"{self.schema}, part int"
        return self.spark.read.schema(schema).parquet(self.path) if there else self.spark.createDataFrame([], schema)

    def put(self, rows: DataFrame) -> None:
        """Add `rows`, or replace those of the same key that are not later."""
        new = stored(rows.withColumn("part", F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")))
        if new.isEmpty():
            return
        old = self._held()
        touched = old.join(F.broadcast(new.select("part").distinct()), "part", "left_semi")  # at most `parts` rows
        columns = [c for c in old.columns if c != self.key]
        both = touched.select(self.key, *columns, F.lit(0).alias("__new")).unionByName(new.select(self.key, *columns, F.lit(1).alias("__new")))
        merged = stored(both.groupBy(self.key).agg(F.max_by(F.struct(*columns), F.struct(self.latest, "__new")).alias("r")).select(self.key, "r.*"))
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.path)


def replies(spark: SparkSession, path: str) -> KeyedStore:
    """A cache of replies by content."""
    return KeyedStore(spark, path, "key string, response string, stored_at timestamp")


@dataclass
class Ledger:
    """Calls by day, for `days` days.

    A day's partition is its number modulo `days` + 2, so writing a day does away with the
    one that stood there; days in between that are too old are left out when read.
    """

    spark: SparkSession
    path: str
    limit: int = DAILY_CALLS
    days: int = 30

    def _store(self) -> KeyedStore:
        return KeyedStore(self.spark, self.path, "day date, calls long", "day", "calls", self.days + 2)

    def used(self, today: date) -> DataFrame:
        """(day, calls) of the days that are kept as of `today`."""
        return self._store().rows().where(F.col("day").between(F.date_sub(F.lit(today), self.days), F.lit(today)))

    def remaining(self, today: date) -> int:
        row = self.used(today).where(F.col("day") == F.lit(today)).agg(F.sum("calls")).first()
        return max(0, self.limit - (row[0] or 0))

    def check(self, calls: int, today: date) -> None:
        """Raise if so many more calls would pass the day's limit."""
        left = self.remaining(today)
        if calls > left:
            raise BudgetExceeded(f"{calls} calls are needed, {left} of {self.limit} are left on {today}")

    def record(self, calls: DataFrame, today: date) -> None:
        """Add `calls` (day, calls); days too old as of `today` go."""
        kept = lambda df: df.where(F.col("day") >= F.date_sub(F.lit(today), self.days))
        slot = lambda df: df.withColumn("part", F.pmod(F.unix_date("day"), F.lit(self.days + 2)).cast("int"))
        new = stored(slot(kept(calls.groupBy("day").agg(F.sum("calls").cast("long").alias("calls")))))
        old = kept(self._store()._held()).join(F.broadcast(new.select("part").distinct()), "part", "left_semi")
        both = old.select("day", "calls", "part").unionByName(new.select("day", "calls", "part")).groupBy("day", "part").agg(F.sum("calls").alias("calls"))
        stored(both).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.path)
