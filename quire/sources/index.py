"""A document index as tables: insert if absent, delete, append a comment, replace findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_absent(index: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """index with those rows whose key it lacks; of rows with one key, any one."""
    new = rows.dropDuplicates([key]).join(index.select(key), key, "left_anti")
    return index.unionByName(new)


def delete(index: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return index.join(rows.select(key), key, "left_anti")


def append(index: DataFrame, rows: DataFrame, key: str, column: str) -> DataFrame:
    """index with the values of rows added to an array column."""
    more = rows.groupBy(key).agg(F.collect_list(column).alias("__more"))
    j = index.join(more, key, "left")
    return j.withColumn(column, F.concat(F.coalesce(column, F.array().cast(index.schema[column].dataType)), F.coalesce("__more", F.array().cast(index.schema[column].dataType)))).drop("__more")


def replace(index: DataFrame, rows: DataFrame, key: str, column: str) -> DataFrame:
    """index with a column's values taken from rows where they have the key."""
    new: Column = F.coalesce(F.col("__new"), F.col(column))
    return index.join(rows.select(key, F.col(column).alias("__new")).dropDuplicates([key]), key, "left").withColumn(column, new).drop("__new")


def listed(index: DataFrame, part: str, order: list[str], name: str = "file_name") -> DataFrame:
    """Rows whose name contains a part, in any case, in order."""
    return index.where(F.contains(F.lower(name), F.lit(part.lower()))).orderBy(*order)


def figure_files(visuals: DataFrame) -> DataFrame:
    """Visuals (doc_id, page, box, bytes) with the path of the file that each is to be written to; a page's figures are numbered from the top."""
    n = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("vy0", "vx0")) - 1
    return visuals.withColumn("__n", n).withColumn("path", F.format_string("images/%d_p%d_%d.png", "doc_id", "page", "__n")).drop("__n")


def write_figures(visuals: DataFrame, folder: str) -> None:
    """Writes path and bytes of every figure as a table, whose folder is emptied before."""
    figure_files(visuals).select("path", "bytes").write.mode("overwrite").parquet(folder)
