"""Data tables: comma-separated text without quoting, and JSON objects of string arrays. All cells are strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def cells_of_lines(lines: DataFrame, header: list[str], line: str = "value") -> DataFrame:
    """Columns of comma-separated lines: a short line leaves nulls, further cells are dropped, nothing is trimmed."""
    parts = F.split(line, ",", -1)
    rest = [c for c in lines.columns if c != line]
    return lines.select(*rest, *[F.get(parts, F.lit(i)).alias(name) for i, name in enumerate(header)])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, _row) of the lines of a text file, numbered from 0 in the file's order.

    Lines of each split are counted first (one row for a split), so that each split knows how many come before it; no task sees more than its split.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_id"))
    splits = lines.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("_first"))
    before = F.sum("n").over(Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1))
    starts = splits.select("_f", "_b", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    return lines.join(starts, ["_f", "_b"]).select("value", (F.col("_id") - F.col("_first") + F.col("_before")).alias("_row"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table of strings from a text file whose first line names the columns (trimmed), with its row numbers.

    Only the first line comes to the driver. A line that follows the last line break is no row.
    """
    head = spark.read.text(path).first()
    if head is None:
        return spark.createDataFrame([], "value string").drop("value")
    header = [h.strip() for h in head[0].split(",")]
    lines = numbered_lines(spark, path).where("_row > 0").withColumn("_row", F.col("_row") - 1)
    return cells_of_lines(lines, header)


def columns(table: DataFrame) -> list[str]:
    """Names in order, without the row number."""
    return sorted(c for c in table.columns if c != "_row")


def cell(table: DataFrame, name: str, row: int) -> DataFrame:
    """One cell, null for an unknown column or row."""
    column = F.col(name) if name in table.columns else F.lit(None).cast("string")
    return table.where(F.col("_row") == row).agg(F.first(column).alias("cell"))


def column_data(table: DataFrame, name: str) -> DataFrame:
    return table.select("_row", name) if name in table.columns else table.select("_row").limit(0).withColumn(name, F.lit(None).cast("string"))


def csv_line(table: DataFrame) -> Column:
    return F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns(table)])


def write_table(table: DataFrame, path: str) -> None:
    """Text with sorted columns; missing cells are empty. The header is each file's first line."""
    rows = table.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns(table)])
    rows.write.mode("overwrite").option("header", True).option("quote", "").option("escape", "").option("emptyValue", "").csv(path)


def rows_of_json(objects: DataFrame, column: str = "json") -> DataFrame:
    """(object columns, name, _row, cell) of JSON objects of arrays; members that are no array are skipped, cells become strings."""
    members = F.from_json(column, "map<string,string>")
    listed = objects.select(*[c for c in objects.columns if c != column], F.explode(members).alias("name", "_raw"))
    arrays = listed.where(F.col("_raw").startswith("[")).withColumn("_cells", F.from_json("_raw", "array<string>"))
    return arrays.select(*[c for c in listed.columns if c not in ("_raw", "name")], "name", F.posexplode("_cells").alias("_row", "cell"))


def json_of_rows(rows: DataFrame, by: list[str]) -> DataFrame:
    """The inverse: one JSON object for each `by` from (name, _row, cell); a column is one array, so one row of the result."""
    cells = rows.groupBy(*by, "name").agg(F.transform(F.sort_array(F.collect_list(F.struct("_row", "cell"))), lambda x: x["cell"]).alias("cells"))
    return cells.groupBy(*by).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "cells"))))).alias("json"))


def row_numbers(table: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return table.withColumn("_row", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
