"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local master, as in tests, may go without: executors on other machines
    would each write to a disk of their own."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="linework-"))
        place = spark.sparkContext.getCheckpointDir()
    return place.rstrip("/")


class Rounds:
    """A table that grows by one part in each round of a loop. Parts are written once; `all` reads them together, with the number of
    their round, so that neither the plan nor what a round writes grows with the rounds before."""

    def __init__(self, spark: SparkSession, name: str):
        self.path, self.count = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def add(self, part: DataFrame, more: Column | None = None) -> tuple[DataFrame, int]:
        """The part, read again, and its number of rows (or another aggregate), observed as they were written."""
        seen = Observation()
        at = f"{self.path}/round={self.count}"
        part.observe(seen, (F.count(F.lit(1)) if more is None else more).alias("n")).write.parquet(at)
        self.count, self.schema = self.count + 1, part.schema
        return part.sparkSession.read.schema(part.schema).parquet(at), seen.get["n"] or 0

    def all(self, spark: SparkSession) -> DataFrame:
        """All parts' rows, with `round` from 0 as an int."""
        return spark.read.schema(StructType([*self.schema.fields, StructField("round", IntegerType())])).parquet(self.path)


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df as a table written in the shared folder and read again: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
