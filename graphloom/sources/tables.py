"""Relational sources and sinks beside graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("parquet", "orc", "csv", "json", "text", "jdbc")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """A table of files. Give csv and json a schema: to infer one reads the data twice."""
    if kind not in FORMATS:
        raise ValueError(f"format {kind} is not one of {', '.join(FORMATS)}")
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error", partition_by: tuple[str, ...] = (), **options) -> None:
    writer = df.write.format(kind).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def folder_tables(spark: SparkSession, folder: str):
    """A reader of the tables in a folder, one Parquet file or folder each."""
    known: dict[str, DataFrame] = {}

    def table(name: str) -> DataFrame:
        if name not in known:
            known[name] = spark.read.parquet(f"{folder}/{name}.parquet")
        return known[name]

    return table
