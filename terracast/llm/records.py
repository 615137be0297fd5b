"""Token ids as length-delimited binary records in shard files, with a separate offset index.

A shard file `ids-00000.rec` is a run of frames, little-endian throughout:

    uint64 n | uint32 masked checksum of the 8 length bytes | n payload bytes | uint32 masked checksum of the payload

The checksum is CRC-32; the mask rotates it right by 15 bits and adds 0xA282EAD8, so that a checksum
stored inside a payload doesn't look like its own. A payload is one flag byte (1: the document id is null;
2: the token ids take 16 bits each, as all of them are below 65536; else 32), the int64 document id, and
the unsigned token ids. The index file `ids-00000.idx` has one 24-byte entry
per record: uint64 offset of the frame, uint64 token count, int64 document id. Files go through Arrow's file
systems, so the folder may be any URI they know (local, HDFS, S3). A task writes under a name of its own
attempt and renames the pair when both are complete: a lost or repeated task leaves no half file behind.
"""
from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terracast.llm.tokens import default_tokenizer, encoder, text_groups

END_ID = 1
MASK = 0xA282EAD8
ENTRY = "<QQq"
CHUNK = 8 << 20


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class Damaged(ValueError):
    """A frame whose lengths or checksums don't hold."""


def pack_ids(doc: int | None, ids: bytes) -> bytes:
    """Payload of a record; ids are unsigned 32-bit."""
    values = np.frombuffer(ids, dtype="<u4")
    narrow = not len(values) or int(values.max()) < 1 << 16
    return struct.pack("<Bq", (doc is None) + 2 * narrow, doc or 0) + (values.astype("<u2").tobytes() if narrow else ids)


def unpack_ids(payload: bytes) -> tuple[int | None, bytes]:
    """(document id, ids as unsigned 32-bit bytes)."""
    flags, doc = struct.unpack("<Bq", payload[:9])
    ids = np.frombuffer(payload[9:], dtype="<u2").astype("<u4").tobytes() if flags & 2 else payload[9:]
    return (None if flags & 1 else doc), ids


def parse(stream) -> Iterator[bytes]:
    """Payloads of a file, in order; memory holds one record."""
    while head := stream.read(12):
        if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
            raise Damaged("length of a record")
        n = struct.unpack("<Q", head[:8])[0]
        body = stream.read(n + 4)
        if len(body) < n + 4 or struct.unpack("<I", body[n:])[0] != masked(body[:n]):
            raise Damaged("payload of a record")
        yield body[:n]


def write_documents(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, files: int | None = None) -> DataFrame:
    """Encode every text, add the end id, write the records in ascending id order; returns shard, file, records, n_tokens of each file.

    Ids ascend within a file and from file to file (nulls first; repeated ids stay together in no fixed
    order). A null text is an empty one. Other columns don't matter. `files` is the number of ranges, by
    default the session's shuffle partitions. An empty table gives no file.
    """
    path = tokenizer or default_tokenizer()
    n = files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        store, at = file_system(folder)
        store.create_dir(at, recursive=True)
        own = f"{at}/_{uuid.uuid4().hex}"
        coder, offset, tokens, records = encoder(path), 0, 0, 0
        end = np.asarray([END_ID], dtype="<u4").tobytes()
        batch = next(batches, None)
        if batch is None:
            return
        with store.open_output_stream(f"{own}.rec") as out, store.open_output_stream(f"{own}.idx") as index:
            while batch is not None:
                ids = batch.column(0).to_pylist()
                for first, texts in text_groups(batch.column(1)):
                    for i, token_bytes in enumerate(coder.encode(texts)):
                        doc = ids[first + i]
                        payload = pack_ids(doc, token_bytes + end)
                        count = len(token_bytes) // 4 + 1
                        index.write(struct.pack(ENTRY, offset, count, doc or 0))
                        data = frame(payload)
                        out.write(data)
                        offset, tokens, records = offset + len(data), tokens + count, records + 1
                batch = next(batches, None)
        name = f"ids-{shard:05d}"
        if records:
            store.move(f"{own}.rec", f"{at}/{name}.rec")
            store.move(f"{own}.idx", f"{at}/{name}.idx")
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([name]), pa.array([records], pa.int64()), pa.array([tokens], pa.int64())], names=["shard", "file", "records", "n_tokens"])
        else:
            store.delete_file(f"{own}.rec")
            store.delete_file(f"{own}.idx")

    return rows.mapInArrow(write, "shard int, file string, records bigint, n_tokens bigint")


def read_documents(written: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """Records of the files that `written` (a stored result of write_documents) lists: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids.

    Every length and checksum is verified; damage raises. `start` counts the ids of all records before.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = written.select("shard", "file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("first"))
    files = files.repartition(max(1, int(written.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "file")
    extra = ", ids binary" if with_ids else ""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, first in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                store, at = file_system(folder)
                out, size = [], 0
                with store.open_input_stream(f"{at}/{name}.rec", buffer_size=CHUNK) as stream:
                    for payload in parse(stream):
                        doc, ids = unpack_ids(payload)
                        out.append((doc, first, len(ids) // 4, zlib.crc32(ids), ids if with_ids else None))
                        first += len(ids) // 4
                        size += len(ids) if with_ids else 64
                        if size > CHUNK:
                            yield _rows(out, with_ids)
                            out, size = [], 0
                if out:
                    yield _rows(out, with_ids)

    return files.mapInArrow(read, f"doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint{extra}")


def _rows(out: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names, kinds = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"], [pa.int64()] * 4 + [pa.binary()]
    last = 5 if with_ids else 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True))[:last], kinds[:last], strict=True)], names=names[:last])


def index_entries(spark: SparkSession, written: DataFrame, folder: str) -> DataFrame:
    """file, record, offset, n_tokens, doc_id of every record, from the index files alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                store, at = file_system(folder)
                with store.open_input_stream(f"{at}/{name}.idx") as stream:
                    record = 0
                    while data := stream.read(24 * 50_000):
                        table = np.frombuffer(data, dtype=[("offset", "<u8"), ("n", "<u8"), ("doc", "<i8")])
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(table)), pa.array(np.arange(record, record + len(table))), *(pa.array(table[k].astype(np.int64)) for k in ("offset", "n", "doc"))], names=["file", "record", "offset", "n_tokens", "doc_id"])
                        record += len(table)

    return written.select("file").mapInArrow(read, "file string, record bigint, offset bigint, n_tokens bigint, doc_id bigint")


def read_shuffled(spark: SparkSession, written: DataFrame, folder: str, seed: int, partitions: int | None = None) -> DataFrame:
    """All records in a random order that the seed fixes: doc_id, ids. Entries are shuffled, then each task seeks its records."""
    entries = index_entries(spark, written, folder).withColumn("key", F.xxhash64(F.lit(seed), "file", "record"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = entries.repartition(n, "key").sortWithinPartitions("key", "file", "record")

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = file_system(folder)
        for b in batches:
            docs, ids, size = [], [], 0
            for name, offset in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                with store.open_input_file(f"{at}/{name}.rec") as f:
                    f.seek(offset)
                    payload = next(parse(f))
                doc, own = unpack_ids(payload)
                docs.append(doc)
                ids.append(own)
                size += len(own)
                if size > CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "ids"])
                    docs, ids, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return entries.mapInArrow(seek, "doc_id bigint, ids binary")
