"""Readers and writers of datasets, schemas, texts, batch results and reports."""

from __future__ import annotations

import json
import math
import warnings
from collections import Counter
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import Schema, parse_exclusions
from ..store import written

# Column names that hold the example text, in the order in which they are tried.
TEXT_COLUMNS = ("example", "example text", "example_text", "text", "prompt")
# Tokens that a CSV cell may hold for "missing".
MISSING = ("", "NA", "N/A", "None", "null", "NULL", "NaN", "nan", "n/a", "#N/A")


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """A CSV dataset, all strings, missing tokens as null, its text column named `example`, and row_id in the order of the file."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    df = df.toDF(*(c.strip() for c in df.columns))
    df = df.select(*(F.when(F.trim(f"`{c}`").isin(*MISSING), None).otherwise(F.col(f"`{c}`")).alias(c) for c in df.columns))
    df = df.withColumnRenamed(text_column(df.columns), "example")
    return numbered(df)


def read_folder(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(dataset, row_id, example and the columns that occur) of CSV datasets as one table: `read_dataset` of each, for any number of files of
    any size, in the splits that Spark reads them in.

    dataset is the file's stem, ValueError if two have the same; a column that a file lacks is null. Rows of another width than their
    header are repaired."""
    from ..operators.splits import PLACE, physical_lines, records, repaired_cells

    stems = [p.rsplit("/", 1)[-1].rsplit(".", 1)[0] for p in paths]
    if twice := sorted(s for s, n in Counter(stems).items() if n > 1):
        raise ValueError(f"several files are named {twice}")
    cells = written(repaired_cells(records(physical_lines(spark, paths))).withColumn("dataset", F.regexp_extract("doc", r"([^/]+)\.[^./]*$", 1)), "cells")
    place = F.struct(*PLACE)
    heads = written(cells.groupBy("doc").agg(F.min(F.struct(*PLACE, "cells")).alias("head")), "heads")
    names = [r.cells for r in heads.select("head.cells").distinct().collect()]  # the distinct headers, of which a folder has few
    for header in names:
        text_column(header)
    trimmed = F.transform("head.cells", F.trim)
    lower = F.transform(trimmed, F.lower)
    at = F.array_position(lower, F.filter(F.array(*map(F.lit, TEXT_COLUMNS)), lambda t: F.array_contains(lower, t))[0])
    rows = cells.join(heads, "doc").where(place > F.struct("head.split", "head.at"))
    # A row's number is that within its split and the rows of the splits before.
    before = Window.partitionBy("doc").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("doc", "split").agg(F.count("*").alias("n"))
    starts = written(sizes.select("doc", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), "starts")
    within = F.row_number().over(Window.partitionBy("doc", "split").orderBy("at")) - 1
    rows = rows.withColumn("within", within).join(starts, ["doc", "split"])
    present = lambda c: F.when(F.trim(c).isin(*MISSING), None).otherwise(c)
    columns = list(dict.fromkeys(c.strip() for header in names for c in header if c != text_column(header)))
    of = lambda name: F.try_element_at("cells", F.nullif(F.array_position(trimmed, F.lit(name)), F.lit(0)).cast("int"))
    return rows.select("dataset", (F.col("start") + F.col("within")).alias("row_id"), present(F.try_element_at("cells", at.cast("int"))).alias("example"), *(present(of(c)).alias(c) for c in columns))


def numbered(df: DataFrame) -> DataFrame:
    """df with row_id from 0 in its order. Only the rows per partition are counted; they are one small row each."""
    at = df.withColumn("_at", F.monotonically_increasing_id())
    partition, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = at.groupBy(partition.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_start"))
    return at.withColumn("_part", partition).join(F.broadcast(starts), "_part").select((F.col("_start") + within).alias("row_id"), *(F.col(f"`{c}`") for c in df.columns))


def text_column(columns: list[str]) -> str:
    lower = {c.strip().lower(): c for c in columns}
    for name in TEXT_COLUMNS:
        if name in lower:
            return lower[name]
    raise ValueError(f"no text column among {columns}")


def read_schema(spark: SparkSession, path: str) -> Schema:
    return Schema.parse("\n".join(r.value for r in spark.read.text(path).collect()))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): the non-blank lines of text files, trimmed."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("text")).where("text <> ''")


def result_lines(lines: DataFrame) -> DataFrame:
    """(custom_id, status, body, error) of lines(value) of batch results in either form: a response with a status code and a body, or a
    result with a type and, where that is `succeeded`, a message. The body is JSON text; error says why there is none to read."""
    of = lambda path: F.get_json_object("value", path)
    code, kind = of("$.response.status_code").cast("int"), of("$.result.type")
    status = F.coalesce(code, F.when(kind == "succeeded", 200).when(kind.isNotNull(), 500))
    what = F.when(code.isNotNull(), F.concat(F.lit("status "), code.cast("string"))).otherwise(kind)
    error = F.when(status != 200, F.concat_ws(": ", what, F.coalesce(of("$.response.error"), of("$.result.error"), of("$.error"))))
    body = F.coalesce(of("$.response.body"), of("$.result.message"))
    return lines.where(F.trim("value") != "").select(of("$.custom_id").alias("custom_id"), status.alias("status"), body.alias("body"), error.alias("error"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return result_lines(spark.read.text(path))


def stream_results(spark: SparkSession, folder: str, files_per_batch: int) -> DataFrame:
    """read_results of the files of a folder as a stream."""
    return result_lines(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder))


def labelled_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, stem) of labelled datasets under a folder that are not metrics themselves."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(folder).select("path")
    stem = F.regexp_extract("path", r"([^/]+)\.csv$", 1)
    return files.withColumn("stem", stem).where(F.col("stem").contains("_labeled") & ~F.col("stem").contains("_metrics")).orderBy("path")


def label_targets(spark: SparkSession, folders: list[str], recursive: bool = True) -> DataFrame:
    """(txt, csv, exists): each text file under the folders and the labelled file that belongs beside it; a folder that is not there is
    passed over with a warning."""
    from pyspark.errors import AnalysisException

    found = spark.createDataFrame([], "path string")
    for folder in folders:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.{txt,csv}")
        try:
            found = found.unionByName(files.load(folder).select("path"))
        except AnalysisException:
            warnings.warn(f"no folder {folder}", stacklevel=2)
    texts = found.where(F.col("path").endswith(".txt")).select(F.col("path").alias("txt"), F.regexp_replace("path", r"\.txt$", "_labeled.csv").alias("csv"))
    return texts.join(found.select(F.col("path").alias("csv"), F.lit(True).alias("there")), "csv", "left").select("txt", "csv", F.coalesce("there", F.lit(False)).alias("exists"))


def unlabelled(texts: DataFrame, labelled: DataFrame) -> DataFrame:
    """texts(stem) without a labelled file of the same stem."""
    return texts.join(labelled.select(F.regexp_replace("stem", "_labeled$", "").alias("stem")), "stem", "left_anti")


def read_exclusions(spark: SparkSession, raw: str | None) -> list[list[str]] | None:
    """Exclusion rules given as JSON or as the path of a JSON file."""
    inline = not raw or raw.strip().startswith("[") or not raw.strip()
    return parse_exclusions(raw if inline else "\n".join(r.value for r in spark.read.text(raw.strip()).collect()))


def write_csv(df: DataFrame, path: str, one_file: bool = False, quote_all: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, header=True, escape='"', quoteAll=quote_all)


def write_requests(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def rounded(value: Any, digits: int = 2) -> Any:
    """Floats of a report to significant figures, through lists and dicts; 0 and non-finite ones stay."""
    if isinstance(value, dict):
        return {k: rounded(v, digits) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [rounded(v, digits) for v in value]
    if isinstance(value, float) and value and math.isfinite(value):
        return float(f"{value:.{digits}g}")
    return value


def report_json(report: dict) -> str:
    return json.dumps(rounded(report), indent=2, ensure_ascii=False, default=lambda v: v.item() if hasattr(v, "item") else str(v))
