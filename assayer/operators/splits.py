"""CSV documents of any size, repaired in splits.

Whether a line end ends a record depends on the number of quotes before it in the whole document. Each split counts its quotes; the
running parity over the splits, a row each, says how each begins; within a split a running sum does the rest. Records that are one
line, nearly all, stay where they are, and only the lines of longer ones are brought together. So no task holds more than a split or
a record. (A quote that is never closed takes the rest of its document into one record.)
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..store import written
from . import repair as R

PLACE = ["split", "at"]
# White space as Python has it.
_SPACE = r"[\s\x1c-\x1f]"


def physical_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(doc, split, at, value): the lines of text files, as many splits a file as Spark reads it in. at grows within a split."""
    m = F.col("_metadata")
    lines = spark.read.text(path).select(m.file_path.alias("doc"), m.file_block_start.alias("split"), F.monotonically_increasing_id().alias("at"), "value")
    return written(lines, "lines")  # at depends on how files are dealt to tasks, so it is made once


def some(c: Column) -> Column:
    """Whether c is not blank."""
    return c.rlike(f"(?Us)(?!{_SPACE}).")


def unfenced(lines: DataFrame) -> DataFrame:
    """lines without a fence in a document's first or last line that is not blank, and without what is beyond it."""
    place = F.struct(*PLACE)
    above, below = F.col("value").rlike(rf"^(?U){_SPACE}*```"), F.col("value").rlike(r"^[ \t]*```")
    ends = lines.where(some(F.col("value"))).groupBy("doc").agg(
        F.min(place).alias("first"), F.min_by(above, place).alias("above"), F.max(place).alias("last"), F.max_by(below, place).alias("below"),
    )
    inside = lines.join(written(ends, "ends"), "doc").where((~F.col("above") | (place > F.col("first"))) & (~F.col("below") | (place < F.col("last"))))
    return inside.drop("first", "above", "last", "below")


def records(lines: DataFrame) -> DataFrame:
    """(doc, split, at, record) of lines(doc, split, at, value), whose order in a document is that of (split, at): the records that are not
    blank, each at the place of its first line. Null lines are empty ones; blank documents have no records."""
    lines = lines.select("doc", *PLACE, F.coalesce("value", F.lit("")).alias("value"))
    quotes = F.length("value") - F.length(F.translate("value", '"', ""))
    counted = unfenced(lines).withColumn("quotes", quotes)
    before = Window.partitionBy("doc").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    sums = counted.groupBy("doc", "split").agg(F.sum("quotes").alias("n"))
    starts = sums.select("doc", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    here = Window.partitionBy("doc", "split").orderBy("at")
    parity = (F.col("base") + F.coalesce(F.sum("quotes").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) % 2
    placed = counted.join(written(starts, "starts"), ["doc", "split"]).withColumn("inside", parity == 1)
    placed = placed.withColumn("own", F.max(F.when(~F.col("inside"), F.col("at"))).over(here)).drop("base")
    placed = written(placed, "placed")
    single = ~F.col("inside") & (F.col("quotes") % 2 == 0)
    # The record that a split ends in, for the lines that go on with it in the splits behind.
    last = placed.groupBy("doc", "split").agg(F.max("own").alias("own"))
    carried = last.select("doc", "split", F.last(F.when(F.col("own").isNotNull(), F.struct("split", "own")), True).over(before).alias("carried"))
    parts = placed.where(~single).join(written(carried, "carried"), ["doc", "split"])
    parts = parts.withColumn("start", F.when(F.col("own").isNotNull(), F.struct("split", "own")).otherwise(F.col("carried")))
    pieces = F.array_sort(F.collect_list(F.struct("split", "at", "value")))
    joined = parts.groupBy("doc", "start").agg(F.array_join(F.transform(pieces, lambda p: p["value"]), "\n").alias("record"), F.sum("quotes").alias("quotes"))
    # Line ends after the last line with something, in a quote that is never closed, do not count.
    closed = F.when(F.col("quotes") % 2 == 1, F.regexp_replace("record", r"\n+\z", "")).otherwise(F.col("record"))
    longer = joined.select("doc", F.col("start.split").alias("split"), F.col("start.own").alias("at"), closed.alias("record"))
    return placed.where(single).select("doc", *PLACE, F.col("value").alias("record")).unionByName(longer).where(some(F.col("record")))


def repaired_cells(found: DataFrame) -> DataFrame:
    """(doc, split, at, cells) of what `records` gives: the header, and rows with as many cells as it has, as `repair` has them."""
    heads = found.groupBy("doc").agg(F.min(F.struct(*PLACE, "record")).alias("head"))
    both = found.join(written(heads, "heads"), "doc")

    @F.pandas_udf("array<string>")
    def cells(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for first, line, is_first in parts:
            yield pd.Series([R.shape(f).names if top else R.repaired_row(f, x) for f, x, top in zip(first, line, is_first, strict=True)], dtype=object)

    is_first = F.struct(*PLACE) == F.struct("head.split", "head.at")
    return both.select("doc", *PLACE, cells(F.col("head.record"), F.col("record"), is_first).alias("cells"))


def csv_rows(cells: DataFrame) -> DataFrame:
    """(doc, text): the rows as CSV, sorted by document and place."""
    line = R.per_cell(lambda row: R.as_csv([list(row)])[:-1])
    return cells.repartitionByRange("doc", *PLACE).sortWithinPartitions("doc", *PLACE).select("doc", line("cells").alias("text"))
