"""What the operators of this subpackage share: written tables, texts, words and word hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import free_since, mark, new_folder, written  # noqa: F401  for the operators
from ..workers import ship  # noqa: F401


def from_files(df: DataFrame) -> bool:
    """Whether rows say from which place of which file they come."""
    try:
        df.select("_metadata.file_path", "_metadata.row_index")
    except Exception:  # noqa: BLE001  not read from such files: no such hidden columns
        return False
    return True


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, body binary): a null text is empty. Columns other than the two are not read."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("body"))


def spread(df: DataFrame) -> DataFrame:
    """df itself, or dealt evenly when its scan has fewer splits than the session has cores (one small file)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= min(cores, 8) else df.repartition(cores)


class WordHashes(dict):
    """word -> 64-bit hash as int, computed once while the table stays under its bound."""

    BOUND = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 arrays."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def portions(batches: Iterable[pa.RecordBatch], most_bytes: int = 2_000_000, text: str = "body", sizes: str | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in portions of about most_bytes of text, one row at least, so that work arrays stay bounded. sizes: a column
    that has the rows' bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(sizes or text))
        upto = np.cumsum(np.asarray(pc.fill_null(column if sizes else pc.binary_length(column), 0), dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            before = upto[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(upto, before + most_bytes, "right")))
            yield batch.slice(at, to - at)
            at = to


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
