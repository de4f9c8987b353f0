"""Flow CSV folders with the reader rules of data frames in memory: headers, nulls, types."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import to_number
from ..operators.flows import union_by_name

# Texts that a CSV cell may hold for "no value".
NULL_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def distinct_header(names: list[str]) -> list[str]:
    """Number repeated raw headers: ``a, a, a`` becomes ``a, a.1, a.2``."""
    taken = set(names)
    seen: dict[str, int] = {}
    result = []
    for name in names:
        if name in seen:
            numbered = name
            while numbered in taken:
                seen[name] += 1
                numbered = f"{name}.{seen[name]}"
            taken.add(numbered)
            result.append(numbered)
        else:
            seen[name] = 0
            result.append(name)
    return result


# Rows in which a column may show that it is text, before the pass over all rows.
FIRST_ROWS = 1000

# Files of a folder that are read as CSV.
CSV_NAMES = "*.csv"


def csv_files(spark: SparkSession, folder: str, names: str = CSV_NAMES) -> list[str]:
    """CSV files right in ``folder``, sorted; the contents are not read."""
    listing = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", names)
        .option("recursiveFileLookup", "false")
        .load(folder)
        .select("path")
    )
    paths = sorted(r.path for r in listing.collect())
    if not paths:
        raise FileNotFoundError(f"No CSV files found in: {folder}")
    return paths


def file_headers(spark: SparkSession, folder: str, names: str = CSV_NAMES) -> DataFrame:
    """``(path, header, broken)`` of every CSV file that isn't empty, found by one job.

    ``broken`` tells that a quoted cell spans lines: some line has an odd number of quotes. Each task
    keeps a row for each of its files only.
    """
    lines = spark.read.option("pathGlobFilter", names).option("recursiveFileLookup", "false").text(folder)
    # Within a file the block's start orders the blocks, and the id the lines of a block.
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    placed = lines.select(
        F.col("_metadata.file_path").alias("path"), "value", place.alias("place"), (quotes % 2 == 1).alias("odd")
    )
    return placed.groupBy("path").agg(
        F.min_by("value", "place").alias("header"), F.bool_or("odd").alias("broken")
    )


def read_flow_text(spark: SparkSession, folder: str, pattern: str = CSV_NAMES) -> DataFrame:
    """Every CSV of the folder, all columns STRING, united by raw header name.

    Files that share a header are one scan, so Spark packs and splits them as it likes. Only files in
    which a quoted cell spans lines are read whole, by one task each, so that such a cell stays one.
    Empty files have no rows and no columns.
    """
    if not folder or not isinstance(folder, str):
        raise ValueError("The folder must be a non-empty string.")
    csv_files(spark, folder, pattern)  # none is an error
    found = file_headers(spark, folder, pattern).groupBy("header", "broken")
    found = found.agg(F.sort_array(F.collect_list("path")).alias("paths"))
    groups = sorted(found.collect(), key=lambda r: r.paths)  # one row for each header
    frames = []
    for group in groups:
        if group.header.count('"') % 2:
            raise ValueError(f"A name in the header of {group.paths[0]} spans lines.")
        names = distinct_header(next(csv.reader([group.header.removeprefix("\ufeff")])))
        columns = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
        reader = spark.read.schema(columns).option("header", True).option("escape", '"')
        frames.append(reader.option("multiLine", group.broken).csv(group.paths).toDF(*names))
    return union_by_name(frames)


def _not_numbers(text: DataFrame, cells: dict[str, Column]) -> set[str]:
    """Which of ``cells`` have a value in ``text`` that is not a number, by one aggregate pass."""
    if not cells:
        return set()
    bad = [F.count_if(c.isNotNull() & to_number(c).isNull()) for c in cells.values()]
    wrong = text.agg(*[n.alias(f"c{i}") for i, n in enumerate(bad)]).first()
    return {name for name, count in zip(cells, wrong) if count}


def type_flows(text: DataFrame) -> DataFrame:
    """Null texts to null; columns whose every value is a number to DOUBLE.

    One aggregate pass over the text counts, per column, values that are not numbers. Columns that
    have one in the first rows are text whatever follows, so the pass does not read them.
    """
    cells = {n: F.when(~F.col(f"`{n}`").isin(NULL_TEXTS), F.col(f"`{n}`")) for n in text.columns}
    words = _not_numbers(text.limit(FIRST_ROWS), cells)
    words |= _not_numbers(text, {n: c for n, c in cells.items() if n not in words})
    # All are numbers now, which the cast alone reads but for odd ends of infinities.
    numbers = {n: F.coalesce(c.try_cast("double"), to_number(c)) for n, c in cells.items()}
    return text.select(*[(c if n in words else numbers[n]).alias(n) for n, c in cells.items()])


def read_flows(spark: SparkSession, folder: str, pattern: str = CSV_NAMES) -> DataFrame:
    """Typed flow records of a folder, raw header names."""
    return type_flows(read_flow_text(spark, folder, pattern))
