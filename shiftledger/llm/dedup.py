"""Exact duplicates by a distributed content sort.

Sampled splitters range-partition the rows by normalised content, an external sort inside each partition
places equal texts side by side, and every row is compared in full with its neighbours. The row that sorts
first in a run of equals stays. The row's length and id are part of the sort key, so splitters may cut through
a run: a third of all rows holding one text spreads over a third of the tasks. The pieces of such a
run are joined afterwards from one line per partition border.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shiftledger.llm.common import ship, written
from shiftledger.session import shuffle_partitions

WHITE_SPACE = b" \t\n\x0b\x0c\r"
_LEAD = 24  # characters of content that the splitters see; a hash of the whole follows
_FOUND = (
    "doc_id long, part int, run long, head boolean, keep_id long, size long, text_sha256 string, border binary"
)


class _Run:
    """Rows of one text in one partition, in sort order."""

    def __init__(self, number: int, content: bytes, row: pa.Array | None):
        self.number, self.content, self.row = number, content, row
        self.ids: list[int | None] = []


class _Out:
    """Result lines, handed on a few thousand at a time."""

    LINES = 4096

    def __init__(self, part: int, schema: pa.Schema):
        self._part, self._schema = part, schema
        self._columns: dict[str, list] = {f.name: [] for f in schema}
        self.lines = 0

    def add(self, run: _Run, border: bool) -> None:
        n, put = len(run.ids), self._columns
        put["doc_id"] += run.ids
        put["part"] += [self._part] * n
        put["run"] += [run.number] * n
        put["head"] += [True] + [False] * (n - 1)
        put["keep_id"] += [run.ids[0]] * n
        put["size"] += [n] * n
        put["text_sha256"] += [hashlib.sha256(run.content).hexdigest()] * n
        put["border"] += [run.content if border else None] + [None] * (n - 1)
        if run.row is not None:
            put["row"].append(run.row)
            if n > 1:
                put["row"].append(pa.nulls(n - 1, run.row.type))
        self.lines += n

    def take(self) -> pa.RecordBatch:
        arrays = [
            pa.concat_arrays(self._columns[f.name]).cast(f.type) if f.name == "row" else pa.array(self._columns[f.name], f.type)
            for f in self._schema
        ]
        self._columns, self.lines = {f.name: [] for f in self._schema}, 0
        return pa.RecordBatch.from_arrays(arrays, schema=self._schema)


def _runs_of_partition(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out = _Out(TaskContext.get().partitionId(), schema)
    carried = "row" in schema.names
    first_key = key = None
    held: dict[bytes, _Run] = {}  # the runs of one key: one, unless hashes collide
    number = 0
    for batch in batches:
        ids = batch["doc_id"].to_pylist()
        texts = batch["text"] if "text" in batch.schema.names else pc.struct_field(batch["row"], "text")
        hashes, leads = batch["_hash"].to_pylist(), batch["_lead"].to_pylist()
        for i in range(batch.num_rows):
            here = (leads[i], hashes[i])
            if here != key:
                for run in held.values():
                    out.add(run, key == first_key)
                held, key = {}, here
                if first_key is None:
                    first_key = here
                if out.lines >= out.LINES:
                    yield out.take()
            text = texts[i]
            content = text.as_buffer().to_pybytes().translate(None, WHITE_SPACE) if text.is_valid else b""
            run = held.get(content)
            if run is None:
                # A copy of the one row: a slice would keep its batch in memory.
                row = batch["row"].take(pa.array([i])) if carried else None
                run = held[content] = _Run(number, content, row)
                number += 1
            run.ids.append(ids[i])
    for run in held.values():
        out.add(run, True)
    if out.lines:
        yield out.take()


def dedup(docs: DataFrame, carry: tuple[str, ...] = (), partitions: int | None = None) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical without white space; null text is empty, so all null, empty and blank texts
    are one group. Of equal texts the one with the most code points stays, then the smallest id (null last);
    of entirely equal rows exactly one. ``carry`` names input columns that come back as the struct ``row``, on kept rows only.
    Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    content = F.translate(text, WHITE_SPACE.decode(), "")
    # A text that is carried anyway travels once.
    alone = [] if "text" in carry and docs.schema["text"].dataType == T.StringType() else [text.alias("text")]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), *alone, F.substring(content, 1, _LEAD).alias("_lead"),
        F.xxhash64(content).alias("_hash"), F.char_length(text).alias("_length"),
        *([F.struct(*[F.col(c) for c in carry]).alias("row")] if carry else []),
    )
    order = [F.col("_lead"), F.col("_hash"), F.col("_length").desc(), F.col("doc_id").asc_nulls_last()]
    dealt = rows.repartitionByRange(partitions or shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    schema = T.StructType.fromDDL(_FOUND)
    if carry:
        schema = schema.add("row", rows.schema["row"].dataType, nullable=True)  # null on copies
    arrow = to_arrow_schema(schema)
    found = written(dealt.mapInArrow(lambda batches: _runs_of_partition(batches, arrow), schema), "runs")

    # Runs at a partition's border: two for each partition, a few more if hashes collide.
    pieces = F.struct("part", "run", "keep_id")
    border = (
        found.where(F.col("border").isNotNull()).groupBy("border")
        .agg(F.collect_list(pieces).alias("pieces"), F.sum("size").alias("whole"), F.min(pieces).alias("first"))
        .select(F.explode("pieces").alias("piece"), "whole", "first")
        .select(
            F.col("piece.part").alias("part"), F.col("piece.run").alias("run"), "whole",
            F.col("first.keep_id").alias("whole_keep"), (F.col("piece.part") == F.col("first.part")).alias("leads"),
        )
    )
    joined = found.drop("border").join(F.broadcast(border), ["part", "run"], "left")
    kept = F.col("head") & F.coalesce("leads", F.lit(True))
    return joined.select(
        "doc_id", F.when(F.col("whole").isNull(), F.col("keep_id")).otherwise(F.col("whole_keep")).alias("keep_id"),
        F.coalesce("whole", "size").alias("group_size"), kept.alias("kept"), "text_sha256",
        *([F.when(kept, F.col("row")).alias("row")] if carry else []),
    )
