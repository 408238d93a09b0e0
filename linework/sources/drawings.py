"""Sink of drawings: one folder for each map, written by Spark in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_documents(documents: DataFrame, path: str, compressed: bool = False) -> None:
    """documents: (map_id, svg). An existing path is an error, as with any of Spark's writers."""
    writer = documents.select("map_id", "svg").write.partitionBy("map_id")
    (writer.option("compression", "gzip") if compressed else writer).text(path)
