"""Exact deduplication (operator 6) as a stateful stream, with Spark's own expressions only.

The stream's keyed state has, per digest, the stable identifier (the largest doc_id), the number of rows and a content
locator (the file and place of that row). It lives in RocksDB on the executors' disks, with its changelog in the shared
folder, and never expires: there is no watermark. Digests with more than one row are hits; their rows are fetched by their
locators and their full texts compared by grouping on the text itself; rows whose digest is shared by different texts are
classed by text instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import from_files, new_folder, written

LOCATOR = "locator struct<file: string, place: long>"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def keyed_state(rows: DataFrame, files_per_batch: int = 256) -> DataFrame:
    """rows (digest, doc_id, locator), a written table, as a stream -> (digest, keep_id, group_size, locator), one row a digest."""
    spark = rows.sparkSession
    # Without fallocate a store's files take what they hold: there is a store per state partition.
    store = "spark.sql.streaming.stateStore"
    conf = {f"{store}.providerClass": ROCKS, f"{store}.rocksdb.changelogCheckpointing.enabled": "true", f"{store}.rocksdb.allowFAllocate": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    states, marks = new_folder(spark, "states"), new_folder(spark, "stream")
    folder = rows.inputFiles()[0].rsplit("/", 1)[0]
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    state = stream.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.max_by("locator", "doc_id").alias("locator"))

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{states}/batch={batch}")

    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        query = state.writeStream.outputMode("update").option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(keep).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    # Each batch has the new state of the digests that it touched; the state of the last one counts.
    every = spark.read.schema(f"digest string, keep_id long, group_size long, {LOCATOR}, batch int").parquet(states)
    return every.groupBy("digest").agg(*(F.max_by(c, "batch").alias(c) for c in ("keep_id", "group_size", "locator")))


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, files_per_batch: int = 256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, locator: one row per row of docs.

    A null text equals an empty one. Of equal texts the row with the largest doc_id stays; rows that repeat that doc_id with
    the same text are one document and all marked as kept. Rows with a null doc_id stay only if their text has no other row;
    they too are one document. An empty table gives an empty result. Extra columns are not read, whatever their names."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")) if from_files(docs) else F.lit(None).cast(LOCATOR.split(" ", 1)[1])
    seen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), place.alias("locator"))
    rows = written(seen.select(digest(F.col("text")).alias("digest"), "doc_id", "locator", F.sha2("text", 256).alias("text_sha256")), "digests")
    if not rows.inputFiles() or rows.isEmpty():
        return rows.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(False).alias("kept"), "text_sha256", "locator")
    state = written(keyed_state(rows.select("digest", "doc_id", "locator"), files_per_batch), "state")

    # Full bytes of the hits, the rows of digests with several; each text once per task before it is shuffled.
    several = state.where("group_size > 1").select("digest")
    if from_files(docs):
        hits = rows.join(several, "digest", "left_semi").select(F.col("locator.file").alias("file"), F.col("locator.place").alias("place"))
        texts = seen.select("text", F.col("locator.file").alias("file"), F.col("locator.place").alias("place"), "doc_id").join(hits.hint("shuffle_hash"), ["file", "place"], "left_semi")
        texts = texts.select("doc_id", "text", digest(F.col("text")).alias("digest"))
    else:
        texts = seen.select("doc_id", "text", digest(F.col("text")).alias("digest")).join(several.hint("shuffle_hash"), "digest", "left_semi")
    classes = texts.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    classes = written(classes.select("digest", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"), "classes")
    clash = written(classes.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "clashes")
    found = rows.join(state.drop("locator"), "digest")
    if not clash.isEmpty():
        apart = written(classes.join(clash, "digest", "left_semi").select("text_sha256", F.struct("keep_id", "group_size").alias("own")), "apart")
        found = found.join(apart, "text_sha256", "left")
        found = found.withColumn("keep_id", F.when(F.col("own").isNull(), F.col("keep_id")).otherwise(F.col("own.keep_id"))).withColumn("group_size", F.coalesce("own.group_size", "group_size"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "locator")


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with their columns, of any names and types; of rows alike in doc_id and text the one whose other
    columns come first as JSON. A null text equals an empty one and stays as it is. No rows give no rows."""
    return _kept(docs, exact_dedup(docs))


def _kept(docs: DataFrame, found: DataFrame) -> DataFrame:
    stay = found.where("kept").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("times"))
    stay = written(stay.select(F.col("doc_id").alias("keep_id"), F.col("text_sha256").alias("keep_sha"), "times"), "kept")
    sha = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    marked = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), sha.alias("sha"))
    same = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("doc_id").isNull() & F.col("keep_id").isNull())
    once = marked.join(stay.hint("shuffle_hash"), (F.col("sha") == F.col("keep_sha")) & same, "left_semi")
    if not stay.where("times > 1").isEmpty():
        once = once.groupBy("doc_id", "sha").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return once.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
