"""Sharding by an external shuffle in two passes (operator 11).

The first pass scatters records uniformly, by a seeded hash of their place, into buckets that fit into a task's memory; the second
puts each bucket into a random order by a Fisher-Yates shuffle and writes it. One bucket after the other, this is one random order
of all records, whatever their order, copies or keys. Shards are equal stretches of it, so that their counts are at most one apart,
and a record's slot is its place in the stretch. Where a bucket begins follows from the counts of a light pass before, which reads
no more than hashes and lengths.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import from_files, new_folder, portions, ship, written

#: Hashes fall into so many cells, a bucket being a range of them; the driver gets a count and a size per cell.
CELLS = 1 << 16


@dataclass(frozen=True)
class Setup:
    """shards: how many; bucket_bytes: of text in a bucket, about, at most 1 GB; seed: of the hashes and the shuffles."""

    shards: int = 16
    bucket_bytes: int = 32 << 20
    seed: int = 7


def text_size(text: Column) -> Column:
    """UTF-8 bytes and 1 for the record itself; a null text has none."""
    return F.coalesce(F.octet_length(text.cast("string")), F.lit(0)).cast("long") + 1


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniformly drawn order of 0 to n - 1: from the last place down, each is swapped with itself or one before it."""
    order = list(range(n))
    last = np.arange(n - 1, 0, -1)
    for i, j in zip(last.tolist(), rng.integers(0, last + 1).tolist(), strict=True):
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def starts(n: int, parts: int) -> np.ndarray:
    """Where each of so many equal stretches of n places begins, and the end."""
    return np.arange(parts + 1) * n // parts


def shuffled(docs: DataFrame, setup: Setup = Setup(), folder: str | None = None) -> DataFrame:
    """(row, slot, shard), written: row is the record of docs as a struct. In the folder, a folder per shard; its files are in order, each
    has a stretch of slots.

    Needs a column text; a null one has no bytes. Columns may have any names. Repeated rows and rows of one or no doc_id are records each
    for itself and scattered apart. An empty table gives no rows. With fewer rows than shards some shards stay empty. The order
    follows from the seed, the doc_ids, the names of the files and the places in them, not from tasks; rows that are not read from Parquet
    files are written first."""
    if not 0 < setup.bucket_bytes <= 1 << 30 or setup.shards < 1:
        raise ValueError("a bucket has 1 byte to 1 GB, and there is a shard at least")
    spark = docs.sparkSession
    ship(spark)
    docs = docs if from_files(docs) else written(docs, "records")
    key = docs["doc_id"].cast("string") if "doc_id" in docs.columns else F.lit(None).cast("string")
    tag = F.xxhash64(F.lit(setup.seed), key, F.col("_metadata.file_name"), F.col("_metadata.row_index"))
    cell = F.shiftrightunsigned(tag, 48)
    size = text_size(docs["text"])
    cells = np.zeros((CELLS, 2), np.int64)
    for r in docs.select(cell.alias("cell"), size.alias("size")).groupBy("cell").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect():
        cells[r.cell] = r.n, r.size
    n, total = cells.sum(0).tolist()
    buckets = int(min(CELLS, max(1, -(-total // setup.bucket_bytes))))
    rows_in = np.bincount(np.arange(CELLS) * buckets // CELLS, cells[:, 0], buckets).astype(np.int64)
    before, edges, seed = np.cumsum(rows_in) - rows_in, starts(n, setup.shards), setup.seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = TaskContext.get().partitionId(), list(batches)
        records = pa.Table.from_batches(held) if held else None
        if (records.num_rows if held else 0) != rows_in[bucket]:
            raise RuntimeError(f"bucket {bucket} had {rows_in[bucket]} records when they were counted: the input changed")
        if not held or not records.num_rows:
            return
        # First in the order of the hashes: how the records came in does not matter.
        order = np.argsort(records.column("tag").to_numpy(), kind="stable")[fisher_yates(records.num_rows, np.random.default_rng((seed, bucket)))]
        place = np.arange(records.num_rows) + before[bucket]
        shard = np.searchsorted(edges, place, "right") - 1
        out = records.select(["row", "size"]).take(pa.array(order))
        out = out.append_column("slot", pa.array(place - edges[shard])).append_column("shard", pa.array(shard.astype(np.int32)))
        yield from portions(out.to_batches(), sizes="size")

    scattered = docs.select(F.struct("*").alias("row"), tag.alias("tag"), size.alias("size"), F.floor(cell * buckets / CELLS).cast("int").alias("bucket"))
    scattered = scattered.repartitionById(buckets, F.col("bucket")).select("row", "tag", "size")
    kinds = T.StructType([scattered.schema["row"], scattered.schema["size"], T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])
    out = scattered.mapInArrow(run, kinds).select("row", "slot", "shard")
    path = folder or new_folder(spark, "shards")
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path, compression="zstd")
    return spark.read.schema(out.schema).parquet(path)


def digests(docs: DataFrame, setup: Setup = Setup()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row per row of docs, read from the written shards.

    The law is `rows`, counts at most one apart; equal texts are not kept together, as they may be a third of all rows. grown_shard, which
    another law has, is null. A null text has size 1 and the checksum of no bytes; null ids stay null."""
    out = shuffled(docs, setup)
    text = F.col("row.text")
    return out.select(
        F.col("row.doc_id").cast("long").alias("doc_id"), text_size(text).alias("size"), F.crc32(F.coalesce(text.cast("string"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
