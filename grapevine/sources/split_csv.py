"""CSV with line breaks inside quotes, read by many tasks.

A reader that looks for records must start at the head of a file, so one file is one task. Here lines are read wherever the file is cut,
and a first pass counts the quotes of each cut: whether a line starts a record follows from the parity of all quotes before it. Lines
then go to their records: one that is open where a cut ends goes on in the next.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def quoted_records(spark: SparkSession, paths: str | Sequence[str], quote: str = '"') -> DataFrame:
    """(file, cut, number, record): the text of every record, with its breaks; by file, the cut that it starts in, and its number there from 1.

    Records end at line feeds outside quotes; a carriage return before one is left out. Quotes inside a field are doubled. A file whose last
    quote is not closed ends with that record.
    """
    lines = spark.read.text(paths, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("cut"), F.monotonically_increasing_id().alias("line"), "value")
    quotes = F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))
    inside = Window.partitionBy("file", "cut").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    # the parity before each line, were the cut to start outside quotes
    odd = F.coalesce(F.sum(quotes).over(inside), F.lit(0)) % 2
    lines = lines.withColumn("odd", odd).withColumn("quotes", quotes)
    cuts = lines.groupBy("file", "cut").agg(
        F.sum("quotes").alias("quotes"), F.count_if(F.col("odd") == 0).alias("even_starts"), F.count_if(F.col("odd") == 1).alias("odd_starts"))
    # one row per cut from here: what is open at its start
    earlier = Window.partitionBy("file").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    cuts = cuts.withColumn("open", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    starts = F.when(F.col("open") == 0, F.col("even_starts")).otherwise(F.col("odd_starts"))
    last = F.when(starts > 0, F.struct("cut", starts.alias("number")))
    cuts = cuts.withColumn("last", last).withColumn("before", F.last("last", ignorenulls=True).over(earlier))
    placed = lines.join(cuts.select("file", "cut", "open", "before"), ["file", "cut"])
    begins = (F.col("odd") + F.col("open")) % 2 == 0
    so_far = Window.partitionBy("file", "cut").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = placed.withColumn("number", F.count_if(begins).over(so_far))
    home = F.when(F.col("number") > 0, F.struct("cut", "number")).otherwise(F.col("before"))
    parts = F.array_sort(F.collect_list(F.struct("cut", "line", "value")))
    records = numbered.withColumn("home", home).groupBy("file", "home").agg(parts.alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["value"]), "\n")
    return records.select("file", F.col("home.cut").alias("cut"), F.col("home.number").alias("number"), F.regexp_replace(text, "\r$", "").alias("record"))


def read_quoted_csv(spark: SparkSession, paths: str | Sequence[str], schema: str, header: bool = True, quote: str = '"') -> DataFrame:
    """The rows of CSV files whose quoted fields may hold line breaks, as a reader of whole files gives them, by as many tasks as the files have
    cuts. With ``header`` the first record of each file is left out. Blank records are no rows.
    """
    records = quoted_records(spark, paths, quote)
    if header:
        records = records.where(~((F.col("cut") == 0) & (F.col("number") == 1)))
    row: Column = F.from_csv("record", schema, {"quote": quote, "escape": quote})
    return records.where(F.length("record") > 0).select(row.alias("row")).select("row.*")
