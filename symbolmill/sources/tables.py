"""Reading the engine's tables and cutting lineage in storage that every executor shares."""

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The table ``name`` of a directory of parquet tables, pruned to ``columns`` when given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def latest(df: DataFrame, key: str, by: str = "indexed_at") -> DataFrame:
    """One row per ``key``: the last delivery (``by`` descending, nulls last).

    Redelivered rows hold equal values, so ties may fall either way. Rows with a null key are kept
    as one group.
    """
    w = Window.partitionBy(key).orderBy(F.col(by).desc_nulls_last())
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def latest_rows(spark: SparkSession, sf_dir: str, name: str, key: str, by: str = "indexed_at") -> DataFrame:
    """The table ``name`` with one row per ``key``, its last delivery, without shuffling its wide columns.

    Keys that were delivered several times are found from narrow columns, with the place of their last row in its file; every
    other row of those keys is filtered out where it is read. Ties of ``by`` fall by that place. Rows with a null key all stay.
    """
    raw = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    place = [F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row")]
    rows = raw.select(key, by, *place)
    again = rows.groupBy(key).agg(F.count("*").alias("_n"), F.max(F.struct(by, "_path", "_row")).alias("_last")).filter("_n > 1").select(key, "_last")
    kept = raw.select("*", *place).join(checked_broadcast(again), key, "left").filter("_last is null or (_last._path = _path and _last._row = _row)")
    return kept.select(*raw.columns)


def shared_dir(spark: SparkSession) -> str:
    """A new directory name below ``spark.checkpoint.dir``. Where that is unset, local mode gets a temporary folder and a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-symbolmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/symbolmill-{uuid.uuid4().hex}"


_written: list[tuple[SparkSession, str]] = []


def release() -> None:
    """Remove the folders that ``cut`` wrote; frames that read them are of no use any more. Called when the driver's process ends."""
    while _written:
        spark, path = _written.pop()
        try:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # noqa: BLE001 - the session has ended and its files are left to the folder's owner
            return


atexit.register(release)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends in files that survive executors. ``release`` removes them."""
    path = shared_dir(df.sparkSession)
    _written.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes up to which a table is broadcast, and what a column of each kind takes; strings here are names and paths.
BROADCAST, WIDTHS = 32 << 20, {"string": 120, "struct": 160}


def checked_broadcast(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its rows, counted here, take at most BROADCAST bytes by the width of its columns; beyond that Spark shuffles it.

    Meant for narrow lists of keys that are cheap to count, such as a written table.
    """
    width = sum(WIDTHS.get(kind.split("<")[0], 8) for _, kind in df.dtypes) + 8
    limit = BROADCAST // width
    few = df.limit(limit + 1).count() <= limit
    return F.broadcast(df) if few else df
