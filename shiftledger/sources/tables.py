"""Readers and writers.

Records live in Parquet partitioned by ``dia``, so a date range prunes partitions. Writes go
through a rebalance on the day: a hot day is split over many tasks and small days share one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftledger.functions.dates import instant
from shiftledger.operators.numbering import highest_id, number_missing
from shiftledger.session import cut_lineage
from shiftledger.sources.schemas import AUDIT, DEPARTMENTS, RECORDS, REQUESTS, SCHEDULE, USERS, conform

CSV_OPTIONS = {
    "header": True,
    "encoding": "UTF-8",
    "escape": '"',
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
}
NO_DAY = "sem-data"


def read_records(
    spark: SparkSession, path: str, start: datetime | None = None, end: datetime | None = None
) -> DataFrame:
    """Records in [start, end). Bounds also prune ``dia`` partitions where the table has them."""
    df = spark.read.parquet(path)
    partitioned = "dia" in df.columns
    for bound, below in ((start, False), (end, True)):
        if bound is None:
            continue
        limit = instant(bound)
        df = df.where(F.col("data_registro") < limit if below else F.col("data_registro") >= limit)
        if partitioned:
            date = F.lit(bound.date().isoformat())
            df = df.where(F.col("dia").cast("string") <= date if below else F.col("dia").cast("string") >= date)
    return conform(df, RECORDS)


def read_table_jdbc(
    spark: SparkSession, url: str, table: str, lower: int, upper: int, partitions: int, **options: str
) -> DataFrame:
    """A relational table by ranges of ``id``, one task each."""
    return (
        spark.read.format("jdbc")
        .options(
            url=url, dbtable=table, partitionColumn="id",
            lowerBound=str(lower), upperBound=str(upper), numPartitions=str(partitions), **options,
        )
        .load()
    )


def newest_first(records: DataFrame) -> DataFrame:
    """The id breaks ties, so equal or missing dates still spread over range partitions."""
    return records.orderBy(F.col("data_registro").desc_nulls_last(), F.col("id"))


def read_schedule(spark: SparkSession, path: str) -> DataFrame:
    return conform(spark.read.parquet(path), SCHEDULE)


def read_users(spark: SparkSession, path: str) -> DataFrame:
    return conform(spark.read.parquet(path), USERS)


def read_departments(spark: SparkSession, path: str) -> DataFrame:
    return conform(spark.read.parquet(path), DEPARTMENTS)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    return conform(spark.read.parquet(path), REQUESTS)


def day_partition() -> Column:
    return F.coalesce(F.to_date("data_registro").cast("string"), F.lit(NO_DAY))


def write_records(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    (
        records.withColumn("dia", day_partition())
        .hint("rebalance", "dia")
        .write.mode(mode).partitionBy("dia").parquet(path)
    )


def read_envelopes(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON payload files: a top-level list, or an object whose ``data`` holds the list."""
    wide = T.StructType([*schema.fields, T.StructField("data", T.ArrayType(schema))])
    payload = spark.read.schema(wide).option("multiLine", True).json(path)
    own = F.struct(*[F.col(f.name) for f in schema.fields])
    rows = F.when(F.col("data").isNull(), F.array(own)).otherwise(F.col("data"))
    return payload.select(F.inline(rows))


def unwrap_envelopes(df: DataFrame, payload: str, schema: T.StructType) -> DataFrame:
    """The same for payload text held in a column."""
    rows = T.ArrayType(schema)
    listed = F.from_json(payload, rows)
    wrapped = F.from_json(payload, T.StructType([T.StructField("data", rows)]))["data"]
    is_list = F.ltrim(F.col(payload)).startswith("[")
    return df.select(F.inline(F.when(is_list, listed).otherwise(wrapped)))


def _written(df: DataFrame, write: Callable[[DataFrame], None]) -> int:
    """Write the rows and say how many there were, counted by the writing job itself."""
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("linhas")))
    return seen.get["linhas"]


def export_csv(df: DataFrame, path: str) -> int:
    """Returns the number of rows."""
    return _written(df, lambda rows: rows.write.options(**CSV_OPTIONS).csv(path))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).options(**CSV_OPTIONS, multiLine=True).csv(path)


@dataclass(frozen=True)
class Snapshot:
    """Where a snapshot lies, and the rows of each table as counted while they were written."""

    base: str
    rows: dict[str, int]

    def manifest(self, spark: SparkSession) -> DataFrame:
        lines = [F.struct(F.lit(name).alias("tabela"), F.lit(n).cast("bigint").alias("linhas")) for name, n in self.rows.items()]
        return spark.range(1).select(F.inline(F.array(*lines)))


def write_snapshot(tables: dict[str, DataFrame], root: str, taken_at: datetime) -> Snapshot:
    """All tables under one timestamp: ``root/snapshot=<ts>/tabela=<name>``. Nothing is read again to be counted."""
    base = f"{root}/snapshot={taken_at:%Y%m%d_%H%M%S}"
    return Snapshot(base, {
        name: _written(df, lambda rows, path=f"{base}/tabela={name}": rows.write.parquet(path)) for name, df in tables.items()
    })


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return conform(spark.read.parquet(path), AUDIT)


def append_audit(entries: DataFrame, path: str, top: int = 0) -> int:
    """Append-only audit trail, partitioned by day. Rows get ids from ``top`` + 1 on; returns the highest id now in use.

    The caller keeps the number from one append to the next, so no append reads the trail.
    """
    numbered = number_missing(conform(entries, AUDIT), top, ["timestamp", "acao", "detalhes"])
    numbered = cut_lineage(numbered)
    (
        numbered.withColumn("dia", F.to_date("timestamp"))
        .hint("rebalance", "dia")
        .write.mode("append").partitionBy("dia").parquet(path)
    )
    return max(top, highest_id(numbered))
