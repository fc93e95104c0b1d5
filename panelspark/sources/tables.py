"""Reading tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import strip_bom
from .records import listing, read_records

__all__ = ["read_config", "read_csv", "read_csv_text", "read_excel_pairs", "read_records", "table"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType, cols: list[str] | None = None) -> DataFrame:
    """CSV (gzip too) with declared types; NaN and infinities become null. ``cols`` prunes the scan."""
    df = spark.read.csv(path, header=True, schema=schema, mode="FAILFAST", nanValue="NaN")
    doubles = [f.name for f in schema if isinstance(f.dataType, T.DoubleType | T.FloatType)]
    df = df.withColumns({c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)) for c in doubles})
    return df.select(*cols) if cols else df


def read_csv_text(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """CSV as text, with the file of each row and its place in it (the header is row 1), and no byte-order mark.

    Places are exact however files are cut into splits (see ``read_records``). All files have the first one's columns;
    short rows end in nulls, and what a row has beyond them is left out.
    """
    names = strip_bom(listing(spark).read.csv(path, header=True, multiLine=True, inferSchema=False, escape='"')).columns
    kind = ", ".join(f"c{i} string" for i in range(len(names)))
    records = read_records(spark, path, split_bytes).filter("source_row > 1")
    fields = records.withColumn("__row", F.from_csv("text", kind, {"escape": '"', "lineSep": "\n", "maxCharsPerColumn": "-1"}))
    return fields.select(*(F.col(f"__row.c{i}").alias(c) for i, c in enumerate(names)), "source_file", F.col("source_row").cast("int").alias("source_row"))


def read_config(spark: SparkSession, path: str) -> dict:
    """A JSON file of parameters, by a path that Spark can read."""
    return json.loads(spark.read.text(path, wholetext=True).first().value)


def read_excel_pairs(spark: SparkSession, path: str, sheet: str | int = 0, header: int | list[int] = 0) -> DataFrame:
    """A small sheet (a dictionary or a published table): needs an Excel library for pandas; two header rows are joined."""
    import pandas as pd

    sheet_rows = pd.read_excel(path, sheet_name=sheet, header=header, dtype=str)
    sheet_rows.columns = ["_".join(str(x) for x in c if not str(x).startswith("Unnamed")) if isinstance(c, tuple) else str(c) for c in sheet_rows.columns]
    return spark.createDataFrame(sheet_rows.where(sheet_rows.notna(), None), T.StructType([T.StructField(c, T.StringType()) for c in sheet_rows.columns]))
