"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where it is unset on one machine (tests) one of our own."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="assayer-")
    return _own[app]


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/assayer/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df as a table in the shared folder, read back: cuts the lineage, survives lost executors, and joins see its size."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out.made_at = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def mark() -> int:
    """A point from which free_since counts."""
    return len(_made)


def free_since(point: int, *keep: DataFrame) -> None:
    """Delete the tables written since the point, but for those that the frames to keep are read from: what came of the others has been
    written itself, so that no lost executor needs them again. The files of a frame are listed only if `written` did not return it."""
    paths = [{df.made_at} if hasattr(df, "made_at") else {f.rsplit("/", 1)[0] for f in df.inputFiles()} for df in keep]
    kept = {p.rsplit("/", 1)[-1] for some in paths for p in some}
    for made in _made[point:]:
        if made[1].rsplit("/", 1)[-1] not in kept:
            delete(*made)
            _made.remove(made)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone, and with it the folder
            return
