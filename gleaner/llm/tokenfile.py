"""Token-id output: short-document access through a shared zstandard dictionary.

Documents are range-partitioned and sorted by doc_id, tokenised, and written as segments. A segment is one binary
value: magic, dictionary hash, the index (doc_id, null flag, token count and frame offset of each document), then one
zstandard frame a document. Reading one document touches the index and its own frame. Segments and the dictionary
are written and read by Spark, so they live in any store that Spark reaches.

The dictionary is trained on a bounded sample of serialised id arrays: of the documents of up to ``dictionary_text_bytes``
bytes the ``dictionary_docs`` with the smallest hashes. Without enough of them it is empty and frames stand alone.

Defined results: null text counts as empty (only the end id); a null doc_id sorts first and is kept; rows with equal
doc_id sort by text; no rows give no segments; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import blocks_for, text_bytes
from gleaner.llm.tokens import WORD_BPE, tokenizer

MAGIC = b"GLTOK1\x00\x00"
SEGMENT_BYTES = 4 << 20
SEGMENT_DOCS = 8192
_SEGMENT = "shard int, segment int, n_tokens long, data binary"
_DOCUMENT = "shard int, segment int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def _serialise(ids: np.ndarray) -> bytes:
    """Two bytes an id where that is enough, else four; the first byte says which."""
    if not len(ids) or int(ids.max()) < 1 << 16:
        return b"\x02" + ids.astype("<u2").tobytes()
    return b"\x04" + ids.astype("<u4").tobytes()


def _deserialise(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<u2" if data[0] == 2 else "<u4", offset=1).astype("<u4")


def _texts(column: pa.Array) -> list[bytes]:
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def train_dictionary(documents: DataFrame, vocabulary: str = WORD_BPE, dictionary_docs: int = 400, dictionary_bytes: int = 32 << 10, dictionary_text_bytes: int = 1 << 16) -> bytes:
    def run(batches):
        for batch in batches:
            ids = tokenizer(vocabulary).encode(_texts(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array([_serialise(x) for x in ids], pa.binary())], names=["data"])

    sample = documents.where(F.octet_length("text") <= dictionary_text_bytes).select("text").orderBy(F.xxhash64("text"), "text").limit(dictionary_docs)
    found = [bytes(r["data"]) for r in sample.mapInArrow(run, "data binary").collect()]
    try:
        return zstandard.train_dictionary(dictionary_bytes, sorted(found)).as_bytes()
    except zstandard.ZstdError:
        return b""


class SegmentWriter:
    def __init__(self, dictionary: bytes, level: int = 3):
        self.digest = hashlib.sha256(dictionary).digest()
        self.compress = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True).compress
        self.clear()

    def clear(self) -> None:
        self.ids, self.counts, self.frames, self.size = [], [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(ids))
        self.frames.append(self.compress(_serialise(ids)))
        self.size += len(self.frames[-1]) + 21

    @property
    def full(self) -> bool:
        return self.size >= SEGMENT_BYTES or len(self.ids) >= SEGMENT_DOCS

    def take(self) -> tuple[int, bytes]:
        """Tokens and bytes of the segment; the writer starts the next one."""
        null = np.array([x is None for x in self.ids], dtype=np.uint8)
        ids = np.array([0 if x is None else x for x in self.ids], dtype="<i8")
        offsets = np.cumsum([0, *map(len, self.frames)]).astype("<u8")
        head = MAGIC + self.digest + struct.pack("<I", len(ids))
        out = head + ids.tobytes() + null.tobytes() + np.array(self.counts, dtype="<u4").tobytes() + offsets.tobytes() + b"".join(self.frames)
        tokens = int(sum(self.counts))
        self.clear()
        return tokens, out


class SegmentReader:
    """Index and frames of one segment; raises if another dictionary wrote it."""

    def __init__(self, data: bytes, dictionary: bytes):
        if data[:8] != MAGIC or data[8:40] != hashlib.sha256(dictionary).digest():
            raise ValueError("not a segment of this dictionary")
        (n,) = struct.unpack_from("<I", data, 40)
        at = 44
        self.doc_ids = np.frombuffer(data, "<i8", n, at)
        self.null = np.frombuffer(data, np.uint8, n, at + 8 * n).astype(bool)
        self.counts = np.frombuffer(data, "<u4", n, at + 9 * n)
        self.offsets = np.frombuffer(data, "<u8", n + 1, at + 13 * n)
        self.frames, self.data = at + 21 * n + 8, data
        self.decompress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompress

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, i: int) -> np.ndarray:
        lo, hi = self.frames + int(self.offsets[i]), self.frames + int(self.offsets[i + 1])
        return _deserialise(self.decompress(self.data[lo:hi]))


def write(documents: DataFrame, path: str, vocabulary: str = WORD_BPE, end_id: int = 2, block_bytes: int = 32 << 20) -> None:
    """Write path/segments and path/dictionary."""
    spark = documents.sparkSession
    documents = documents.select("doc_id", "text")
    dictionary = train_dictionary(documents, vocabulary)
    spark.range(1).select(F.lit(dictionary).alias("dictionary"), F.sha2(F.lit(dictionary), 256).alias("sha256")).write.parquet(f"{path}/dictionary")

    def run(batches) -> Iterator[pa.RecordBatch]:
        shard, segment, writer = TaskContext.get().partitionId(), 0, SegmentWriter(dictionary)

        def out():
            nonlocal segment
            tokens, data = writer.take()
            segment += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([segment - 1], pa.int32()), pa.array([tokens], pa.int64()), pa.array([data], pa.binary())],
                names=["shard", "segment", "n_tokens", "data"],
            )

        for batch in batches:
            ids = tokenizer(vocabulary).encode(_texts(batch.column(1)))
            for doc_id, one in zip(batch.column(0).to_pylist(), ids, strict=True):
                writer.add(doc_id, np.append(one, np.uint32(end_id)))
                if writer.full:
                    yield out()
        if writer.ids:
            yield out()

    parts = blocks_for(spark, text_bytes(documents), block_bytes)
    ordered = documents.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, _SEGMENT).write.option("compression", "none").parquet(f"{path}/segments")


def read_dictionary(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])


def segment_starts(segments: DataFrame) -> DataFrame:
    """shard, segment, base: ids before each segment. Shards are summed first, so only one row a shard meets in one task."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sizes = segments.select("shard", "segment", "n_tokens")
    totals = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    bases = totals.select("shard", F.coalesce(F.sum("total").over(before(Window.orderBy("shard"))), F.lit(0)).alias("shard_base"))
    inner = F.coalesce(F.sum("n_tokens").over(before(Window.partitionBy("shard").orderBy("segment"))), F.lit(0))
    return sizes.withColumn("inner", inner).join(bases, "shard").select("shard", "segment", (F.col("shard_base") + F.col("inner")).alias("base"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files."""
    dictionary = read_dictionary(spark, path)
    segments = spark.read.parquet(f"{path}/segments")

    def run(batches):
        for batch in batches:
            for shard, segment, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                reader = SegmentReader(data, dictionary)
                counts = reader.counts.astype(np.int64)
                crc = [zlib.crc32(reader.ids(i).tobytes()) for i in range(len(reader))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(reader), shard, np.int32)),
                        pa.array(np.full(len(reader), segment, np.int32)),
                        pa.array(reader.doc_ids, mask=reader.null),
                        pa.array(np.cumsum(counts) - counts),
                        pa.array(counts),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["shard", "segment", "doc_id", "local_start", "n_tokens", "ids_crc32"],
                )

    rows = segments.select("shard", "segment", "data").mapInArrow(run, _DOCUMENT)
    found = rows.join(segment_starts(segments), ["shard", "segment"])
    return found.select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def read_documents(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """doc_id, ids of the documents in wanted(doc_id); only their frames are decompressed."""
    dictionary = read_dictionary(spark, path)

    def run(batches):
        for batch in batches:
            for data, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader, asked = SegmentReader(data, dictionary), set(ids)
                rows = [i for i in range(len(reader)) if not reader.null[i] and int(reader.doc_ids[i]) in asked]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(reader.doc_ids[rows]), pa.array([reader.ids(i).tolist() for i in rows], pa.list_(pa.int64()))], names=["doc_id", "ids"]
                )

    def index(batches):
        for batch in batches:
            for shard, segment, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                reader = SegmentReader(data, dictionary)
                keep = reader.doc_ids[~reader.null]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keep), shard, np.int32)), pa.array(np.full(len(keep), segment, np.int32)), pa.array(keep)], names=["shard", "segment", "doc_id"]
                )

    segments = spark.read.parquet(f"{path}/segments")
    where = segments.select("shard", "segment", "data").mapInArrow(index, "shard int, segment int, doc_id long")
    asked = where.join(wanted.select("doc_id").distinct(), "doc_id").groupBy("shard", "segment").agg(F.collect_list("doc_id").alias("asked"))
    return segments.join(asked, ["shard", "segment"]).select("data", "asked").mapInArrow(run, "doc_id long, ids array<long>")
