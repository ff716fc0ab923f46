"""A key-value table in versions: sets write a new version, readers take the newest, clearing starts an empty one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path
from .store import upsert

SCHEMA = "key string, value binary"


class KeyValueTable:
    def __init__(self, spark: SparkSession):
        self.spark, self.versions = spark, []
        self.clear()

    def rows(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.versions[-1])

    def _write(self, rows: DataFrame) -> None:
        path = new_path(self.spark, "values")
        rows.select("key", "value").write.parquet(path)
        self.versions.append(path)

    def set(self, rows: DataFrame) -> None:
        """Values of the given keys take the place of what was there; of a key given twice the largest value counts."""
        fresh = rows.groupBy("key").agg(F.max("value").alias("value"))
        self._write(upsert(self.rows(), fresh, ["key"]))

    def get(self, keys: DataFrame) -> DataFrame:
        """(key, value) of the asked keys that are there."""
        return self.rows().join(keys.select("key").distinct(), "key", "left_semi")

    def clear(self) -> None:
        self._write(self.spark.createDataFrame([], SCHEMA))
