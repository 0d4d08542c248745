"""A record table in folders per batch: plain Parquet by day, written whole for the days a batch touches.

``lote=<n>/dia=<day>`` holds a day as batch n left it. A batch writes the other rows of its days and its changes into a new folder, so nothing that is
being read is overwritten, and a repeated batch replaces its own folder. A reader takes every day from the newest finished folder that
has it: what a batch wrote is seen as a whole or not at all. A day that a row left holds one line without an id, so that it counts as
written even if nothing else stayed. There are as many paths to read as calendar days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftledger.operators.numbering import highest_id, number_missing
from shiftledger.session import cut_lineage
from shiftledger.sources.schemas import RECORDS, conform
from shiftledger.sources.tables import day_partition

BATCH = "lote"
FIRST_LOAD = -1  # before all batches of a stream
#: A record with the place of the submission it was made by, and of the one it shows; both null for rows that came otherwise.
STORED = T.StructType([*RECORDS.fields, T.StructField("ordem", T.LongType()), T.StructField("ordem_criacao", T.LongType())])
_READ = T.StructType([*STORED.fields, T.StructField("dia", T.StringType()), T.StructField(BATCH, T.LongType())])


def write_batch(df: DataFrame, root: str, batch: int) -> None:
    """One folder per batch, replaced as a whole when a batch is repeated."""
    df.write.mode("overwrite").parquet(f"{root}/{BATCH}={batch}")


def _files(spark: SparkSession, path: str):
    """The file system of a path and the path in its terms."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below a path; none if it does not exist."""
    store, place = _files(spark, path)
    return sorted(f.getPath().getName() for f in store.listStatus(place) if f.isDirectory()) if store.exists(place) else []


def exists(spark: SparkSession, path: str) -> bool:
    store, place = _files(spark, path)
    return store.exists(place)


def batches(spark: SparkSession, root: str) -> list[int]:
    """The batches that are written to the end."""
    numbers = [int(f.split("=")[1]) for f in folders(spark, root) if f.startswith(f"{BATCH}=")]
    return sorted(n for n in numbers if exists(spark, f"{root}/{BATCH}={n}/_SUCCESS"))


def current_records(spark: SparkSession, root: str, before: int | None = None, days: set[str] | None = None) -> DataFrame:
    """The table as of its newest batch, or of the newest before a batch; of some days only, if they are named."""
    newest: dict[str, str] = {}
    for number in batches(spark, root):
        if before is None or number < before:
            newest |= {day: f"{root}/{BATCH}={number}/{day}" for day in folders(spark, f"{root}/{BATCH}={number}")}
    paths = [path for day, path in sorted(newest.items()) if days is None or day.split("=", 1)[1] in days]
    if not paths:
        return spark.createDataFrame([], _READ).drop(BATCH)
    return spark.read.schema(_READ).option("basePath", root).parquet(*paths).where("id IS NOT NULL").drop(BATCH)


def days_of(spark: SparkSession, root: str, ids: DataFrame, before: int | None = None) -> set[str]:
    """The days that rows of these ids are in. Reads the id column; returns a line per calendar day at most."""
    found = current_records(spark, root, before).select("id", "dia").join(ids.select("id"), "id", "left_semi")
    return {r.dia for r in found.select("dia").distinct().collect()}


def rows_with(spark: SparkSession, root: str, ids: DataFrame, before: int | None = None) -> DataFrame:
    """The stored rows of these ids, with only their days opened."""
    days = days_of(spark, root, ids, before)
    return current_records(spark, root, before, days).join(ids.select("id"), "id", "left_semi")


def replace_rows(rows: DataFrame, root: str, batch: int, stored: DataFrame | None = None) -> None:
    """Write batch: these rows in place of the stored ones of their ids, which may be in other days. Ids must be given, each once.

    ``stored`` may give what ``rows_with`` found for these ids (or more), so that the table is not searched for their days again.
    """
    spark = rows.sparkSession
    new = conform(rows, STORED).withColumn("dia", day_partition())
    if not any(number < batch for number in batches(spark, root)):  # nothing is stored, so nothing is replaced
        new.hint("rebalance", "dia").write.mode("overwrite").partitionBy("dia").parquet(f"{root}/{BATCH}={batch}")
        return
    new = cut_lineage(new)
    if stored is None:
        left = days_of(spark, root, new, before=batch)
    else:
        left = {r.dia for r in stored.join(new.select("id"), "id", "left_semi").select("dia").distinct().collect()}
    entered = {r.dia for r in new.select("dia").distinct().collect()}  # calendar days, too
    stayed = current_records(spark, root, batch, left | entered).join(new.select("id"), "id", "left_anti")
    kind = T.StructType([*STORED.fields, T.StructField("dia", T.StringType())])
    lines = spark.createDataFrame([(None,) * len(STORED) + (day,) for day in sorted(left)], kind)
    (
        stayed.select(*kind.names).unionByName(new).unionByName(lines).hint("rebalance", "dia")
        .write.mode("overwrite").partitionBy("dia").parquet(f"{root}/{BATCH}={batch}")
    )


def insert_rows(rows: DataFrame, root: str, batch: int, order: list[str]) -> None:
    """Write batch: these rows under the next free ids, numbered in the given order."""
    top = highest_id(current_records(rows.sparkSession, root, before=batch))
    replace_rows(number_missing(conform(rows, STORED), top, order), root, batch)
