"""What the operators of this subpackage share: reading, slicing, scratch tables."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import shiftledger
from shiftledger.session import scratch_path

SLICE_BYTES = 4 << 20
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that workers can import it and keep caches between tasks."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(shiftledger.__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="shiftledger-code-")) / "shiftledger.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, *more: str) -> DataFrame:
    """Only the id, the text (null: empty) and the named columns, so other columns cannot clash."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice holds about ``limit`` bytes of the column, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The rows, computed once and read back from a table below ``spark.checkpoint.dir``.

    Unlike ``checkpoint()`` this evaluates the rows only once, and the table outlives lost executors.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
