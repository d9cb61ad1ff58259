"""Sources and sinks: tables, files, SQL, pandas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_table(spark: SparkSession, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.table(name)
    return df.select(*columns) if columns else df


def from_files(spark: SparkSession, path: str, fmt: str = "parquet", columns: list[str] | None = None, **options) -> DataFrame:
    df = spark.read.options(**options).format(fmt).load(path)
    return df.select(*columns) if columns else df


def from_model(spark: SparkSession, sql: str, args: dict | None = None, **frames: DataFrame) -> DataFrame:
    """A SQL text with {name} for other frames and :name for parameters."""
    return spark.sql(sql, args=args, **frames)


def from_pandas(spark: SparkSession, pdf, index: bool = True, table: str | None = None, if_exists: str = "fail") -> DataFrame:
    """A pandas frame, its index as columns _index_<name or number>; also as a table if one is named."""
    if index:
        names = [f"_index_{n if n is not None else k}" for k, n in enumerate(pdf.index.names)]
        pdf = pdf.rename_axis(names).reset_index()
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None) if pdf.isna().any().any() else pdf)
    return to_table(df, table, if_exists) if table else df


def to_table(df: DataFrame, name: str, if_exists: str = "fail", partition_by: list[str] | None = None) -> DataFrame:
    mode = {"fail": "errorifexists", "replace": "overwrite", "append": "append"}[if_exists]
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def event_table(spark: SparkSession, path: str, start_date: str | None = None, end_date: str | None = None) -> DataFrame:
    """Raw events by day, both dates included; the filter prunes partitions of a table laid out by day."""
    df = spark.read.parquet(path)
    if start_date:
        df = df.where(F.col("day") >= F.lit(start_date).cast("date"))
    if end_date:
        df = df.where(F.col("day") <= F.lit(end_date).cast("date"))
    return df
