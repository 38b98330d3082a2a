"""Disassembly listings as a source: text lines to functions and instructions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .corpus import normalise

# Fixed: the layout of a listing's lines.
HEADER = r"^([0-9a-f]+) <(.+?)>:$"
INSTRUCTION = r"^\s*([0-9a-f]+):\s+((?:[0-9a-f]{2}\s)+)\s*([a-zA-Z][\w.@]*)\s*(.*)$"


def parse_listing(lines: DataFrame) -> DataFrame:
    """(file, line_no, value) to instructions.

    A header opens a function; lines before the first header and functions without
    an instruction give no rows. Lines that hold bytes alone continue the
    instruction before them and give no row.
    """
    order = Window.partitionBy("file").orderBy("line_no")
    marked = lines.withColumn("is_header", F.col("value").rlike(HEADER)).withColumn("func_idx", F.sum(F.col("is_header").cast("int")).over(order))
    heads = marked.where("is_header").select("file", "func_idx", F.regexp_extract("value", HEADER, 2).alias("func"))
    body = marked.where(~F.col("is_header") & (F.col("func_idx") > 0) & F.col("value").rlike(INSTRUCTION))
    part = lambda k: F.regexp_extract("value", INSTRUCTION, k)
    rows = body.select(
        "file", "line_no", "func_idx", F.conv(part(1), 16, 10).cast("long").alias("address"), normalise(part(3)).alias("opcode"),
        F.trim(part(4)).alias("operands"), F.unhex(F.regexp_replace(part(2), r"\s", "")).alias("raw_bytes"),
    )
    return rows.join(heads, ["file", "func_idx"])


def read_listings(spark, path: str) -> DataFrame:
    """Listing files, a line a row, with the line's number in its file."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
    return parse_listing(lines)


def is_elf(content):
    """Whether a binary column starts with the magic of an executable."""
    return F.substring(content, 1, 4) == F.unhex(F.lit("7F454C46"))
