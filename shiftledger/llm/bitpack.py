"""Token ids in files of fixed-width bits.

A shard file holds, in this order: the ids packed with the fewest bits the vocabulary needs, cut
into blocks of ``BLOCK`` ids; the byte offset of each block (unsigned 64-bit); the id of each document and the
position of its first token (signed 64-bit); a tail of fixed size. All numbers are little-endian. A reader opens the tail,
then reads any range of tokens by its blocks and unpacks them with numpy.

Documents are range-partitioned by id and sorted, so that shard k holds the k-th range. A task writes under a
name of its own and moves the file into place when it is complete; only files named by the manifest, which lists what successful tasks
returned, belong to the data set. So a task may be lost or run twice.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiftledger.llm.common import id_and_text, slices, written
from shiftledger.llm.tokens import END, encoder
from shiftledger.session import scratch_path, shuffle_partitions

BLOCK = 4096
_MAGIC = b"IDBITS01"
_TAIL = struct.Struct("<QQQQQB7s8s")  # ids, documents, offset of block table, of document table, block size, bits, spare, magic
_READ_IDS = 1 << 18
_STORES = {s: s for s in ("file", "hdfs", "viewfs", "s3", "gs", "abfs", "abfss")} | {"s3a": "s3", "s3n": "s3"}


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold the ids 0 to vocabulary - 1."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Each id's low bits in order, the lowest first, without gaps; the last byte is filled with zeros."""
    data = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if bits % 8 == 0:  # whole bytes, the same as their bits one by one
        return data[:, :bits // 8].tobytes()
    lanes = np.unpackbits(data, axis=1, bitorder="little")[:, :bits]
    return np.packbits(lanes.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    if bits % 8 == 0:
        whole = np.zeros((count, 4), dtype=np.uint8)
        whole[:, :bits // 8] = np.frombuffer(data, np.uint8, count * bits // 8).reshape(count, bits // 8)
        return whole.reshape(-1).view("<u4")
    lanes = np.zeros((count, 32), dtype=np.uint8)
    lanes[:, :bits] = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return np.packbits(lanes, axis=1, bitorder="little").reshape(-1).view("<u4")


class Writer:
    """Writes one shard to a binary stream; holds one block and the document table."""

    def __init__(self, out, bits: int):
        self._out, self._bits = out, bits
        self._rest = np.empty(0, dtype="<u4")
        self._at, self.ids = 0, 0
        self._blocks: list[int] = []
        self._docs: list[int] = []
        self._starts: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        # A document without an id is stored under the smallest 64-bit number.
        self._docs.append(-(2**63) if doc_id is None else doc_id)
        self._starts.append(self.ids)
        self.ids += len(ids)
        self._rest = np.concatenate([self._rest, ids])
        full = len(self._rest) // BLOCK * BLOCK
        for i in range(0, full, BLOCK):
            self._block(self._rest[i:i + BLOCK])
        self._rest = self._rest[full:]

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self._bits)
        self._out.write(data)
        self._blocks.append(self._at)
        self._at += len(data)

    def close(self) -> None:
        if len(self._rest):
            self._block(self._rest)
        docs_at = self._at + 8 * len(self._blocks)
        self._out.write(np.array(self._blocks, dtype="<u8").tobytes())
        self._out.write(np.array([self._docs, self._starts], dtype="<i8").tobytes())
        self._out.write(_TAIL.pack(self.ids, len(self._docs), self._at, docs_at, BLOCK, self._bits, b"", _MAGIC))


class Reader:
    """Random access to the tokens of one shard; ``file`` can seek."""

    def __init__(self, file):
        self._file = file
        size = file.size()
        self.ids, docs, blocks_at, docs_at, self._block, self._bits, _, magic = _TAIL.unpack(self._bytes(size - _TAIL.size, size))
        if magic != _MAGIC:
            raise ValueError("not a file of packed ids")
        self._ends = np.append(np.frombuffer(self._bytes(blocks_at, docs_at), "<u8").astype(np.int64), blocks_at)
        self.docs, self.starts = np.frombuffer(self._bytes(docs_at, size - _TAIL.size), "<i8").reshape(2, docs)

    def _bytes(self, start: int, stop: int) -> bytes:
        self._file.seek(start)
        return self._file.read(stop - start)

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids number start to stop - 1, from the blocks that hold them."""
        if stop <= start:
            return np.empty(0, dtype="<u4")
        first, last = start // self._block, (stop - 1) // self._block
        data = self._bytes(int(self._ends[first]), int(self._ends[last + 1]))
        # A full block fills whole bytes, so neighbouring blocks unpack in one go.
        count = min(self.ids, (last + 1) * self._block) - first * self._block
        return unpack(data, count, self._bits)[start - first * self._block:stop - first * self._block]


def shared_address(spark: SparkSession, root: str) -> str:
    """The folder as tasks open it: without a scheme it lies on Spark's default file system, as for Spark's own writers.

    Raises ValueError for a file system that tasks cannot open, before any is started.
    """
    if not urlsplit(root).scheme:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        root = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    scheme, store, folder, *_ = urlsplit(root)
    if scheme not in _STORES:
        raise ValueError(f"files of packed ids cannot be written to {scheme}: {root}")
    return f"{_STORES[scheme]}://{store}{folder}"


def write_ids(docs: DataFrame, tokenizer: str, root: str | None = None, shards: int | None = None) -> DataFrame:
    """Writes the files below ``root`` and returns the manifest: ``shard, path, n_ids, n_docs, start``.

    Every document's ids are followed by the id 1. Null text is empty; a document without an id sorts first. Documents of equal id
    are ordered by a hash of their text. ``start`` counts the ids of all shards before. A root without a scheme is taken as Spark takes it.
    """
    spark = docs.sparkSession
    root = shared_address(spark, root or scratch_path(spark, "ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        shard = TaskContext.get().partitionId()
        store, folder = fs.FileSystem.from_uri(root)
        store.create_dir(folder, recursive=True)
        name = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.ids"
        n_docs = 0
        with store.open_output_stream(f"{name}.part") as out:
            writer = Writer(out, bits_for(words.vocabulary))
            for part in slices(batches):
                ids = part["doc_id"].to_pylist()
                for doc_id, found in zip(ids, words.encode(part["text"].to_pylist())):
                    writer.add(doc_id, np.append(np.frombuffer(found, "<u4"), np.uint32(END)))
                n_docs += len(ids)
            writer.close()
        store.move(f"{name}.part", name)
        yield pa.RecordBatch.from_pylist([{"shard": shard, "path": name, "n_ids": writer.ids, "n_docs": n_docs}])

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = id_and_text(docs).repartitionByRange(shards or shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    manifest = written(dealt.mapInArrow(run, "shard long, path string, n_ids long, n_docs long"), "manifest")
    # One line per file, so one task is enough for the running sum.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).withColumn("root", F.lit(root))


def read_ids(manifest: DataFrame, readers: int | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document in the files; ``ids`` are little-endian unsigned 32-bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for line in batch.to_pylist():
                store, _ = fs.FileSystem.from_uri(line["root"])
                with store.open_input_file(line["path"]) as file:
                    shard = Reader(file)
                    ends = np.append(shard.starts[1:], shard.ids)
                    i = 0
                    while i < len(shard.docs):  # about _READ_IDS ids at a time, one document at least
                        j = max(i + 1, int(np.searchsorted(ends, shard.starts[i] + _READ_IDS, side="right")))
                        ids = shard.tokens(int(shard.starts[i]), int(ends[j - 1]))
                        offsets = np.append(shard.starts[i:j], ends[j - 1]) - shard.starts[i]
                        docs = shard.docs[i:j]
                        yield pa.RecordBatch.from_arrays([
                            pa.array(docs, mask=docs == -(2**63)), pa.array(shard.starts[i:j] + line["start"]),
                            pa.array(np.diff(offsets)),
                            pa.array([ids[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary()),
                        ], names=["doc_id", "start", "n_tokens", "ids"])
                        i = j

    lines = manifest.repartition(readers or shuffle_partitions(manifest.sparkSession))
    return lines.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
