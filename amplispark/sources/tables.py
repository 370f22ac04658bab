"""Tables of Markdown files as rows (OP-09), and the names in one of their columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_BAR = r"(?<!\\)\|"
_RULE = r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$"


def cells(line: Column) -> Column:
    """The cells of a line: between bars that no backslash escapes, links as their words, without emphasis and code marks."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(line), r"^\|", ""), r"(?<!\\)\|$", "")
    link = F.regexp_replace(F.regexp_replace(inner, r"\[([^\]]*)\]\([^)]*\)", "$1"), "[*`]|(?<![A-Za-z0-9])_|_(?![A-Za-z0-9])", "")
    return F.transform(F.split(link, _BAR), lambda c: F.trim(F.replace(c, F.lit("\\|"), F.lit("|"))))


def markdown_tables(lines: DataFrame) -> DataFrame:
    """(path, table, row, cells) of the tables in (path, line_no, value) lines: ``cells`` maps the header's names to the row's cells.

    A table is a run of lines with a bar whose second one is a rule of dashes;
    tables of a file are numbered from 1, rows too. A row with fewer cells than
    the header lacks the rest, more are left out; of equal names the last counts.
    A run without a rule is no table.
    """
    with_bar = lines.where(F.col("value").rlike(_BAR))
    order = Window.partitionBy("path").orderBy("line_no")
    runs = with_bar.withColumn("_run", F.col("line_no") - F.row_number().over(order))
    within = Window.partitionBy("path", "_run").orderBy("line_no")
    whole = Window.partitionBy("path", "_run")
    r = runs.withColumn("_n", F.row_number().over(within)).withColumn("_cells", cells(F.col("value")))
    r = r.withColumn("_is", F.max(F.when(F.col("_n") == 2, F.col("value").rlike(_RULE))).over(whole)).where("_is")
    r = r.withColumn("_head", F.max(F.when(F.col("_n") == 1, F.col("_cells"))).over(whole)).withColumn("table", F.dense_rank().over(Window.partitionBy("path").orderBy("_run")))
    n = F.least(F.size("_head"), F.size("_cells"))
    pairs = F.zip_with(F.slice("_head", F.lit(1), n), F.slice("_cells", F.lit(1), n), lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["key"] == x["key"]))
    return r.where("_n > 2").select("path", "table", (F.col("_n") - 2).alias("row"), F.map_from_entries(last).alias("cells"))


def read_markdown_tables(spark: SparkSession, path: str) -> DataFrame:
    """The tables of Markdown files; a file is read whole, as its lines have to keep their order."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split("value", r"\r?\n").alias("lines"))
    return markdown_tables(files.select("path", F.posexplode("lines").alias("line_no", "value")))


def listed_names(rows: DataFrame, column: str) -> DataFrame:
    """OP-09: (name) of a table's column, once each; empty cells and comments (#) are left out. What TX-05 resolves."""
    name = F.element_at("cells", F.lit(column))
    return rows.select(name.alias("name")).where((F.col("name") != "") & ~F.col("name").startswith("#")).distinct()
