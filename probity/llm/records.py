"""Length-delimited binary records of token ids, with a separate offset index for reads in any order.

Record file: for each document, in ascending doc_id order,
    u64 length of the payload | u32 masked checksum of those 8 bytes | payload | u32 masked checksum of it
Payload: u8 flags (1: the id is null) | u8 bytes per token (2 or 4) | i64 doc_id | ids, little-endian.
Index file: 8 bytes magic, then for each record i64 doc_id | u64 offset of the record | u64 its tokens
| u64 tokens of the same file before it. A masked checksum is CRC-32 rotated right by 15 bits plus a constant.

Rows are range-partitioned by id and each task streams one pair of files. A task names its files by
a fresh token and reports them in one manifest row, so files of a failed or doubled attempt are never
listed. Files go to the shared folder through ``pyarrow.fs``, which opens local and remote stores.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probity.llm.common import arrow_map, column, materialize, new_path, sliced_by_size
from probity.llm.tokens import encoder_for

MASK_DELTA = 0xA282EAD8
INDEX_MAGIC = b"PBIDX001"
_ENTRY = "<qQQQ"
_ENTRY_BYTES = struct.calcsize(_ENTRY)
_HEAD = "<BBq"
_HEAD_BYTES = struct.calcsize(_HEAD)

MANIFEST = "pid int, docs long, tokens long, record_file string, index_file string, n_bytes long"


class CorruptRecord(ValueError):
    """A length or checksum in a record or index file doesn't hold."""


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(data: bytes) -> bytes:
    """The payload of exactly one framed record."""
    if len(data) < 16 or struct.unpack_from("<I", data, 8)[0] != masked_crc(data[:8]):
        raise CorruptRecord("the length of a record is damaged")
    n = struct.unpack_from("<Q", data)[0]
    if len(data) != n + 16:
        raise CorruptRecord("a record is cut short")
    payload = data[12 : 12 + n]
    if struct.unpack_from("<I", data, 12 + n)[0] != masked_crc(payload):
        raise CorruptRecord("the payload of a record is damaged")
    return payload


def payload_of(doc_id: int | None, ids: bytes, width: int) -> bytes:
    body = ids if width == 4 else np.frombuffer(ids, dtype="<u4").astype("<u2").tobytes()
    return struct.pack(_HEAD, int(doc_id is None), width, doc_id or 0) + body


def ids_of(payload: bytes) -> tuple[int | None, bytes]:
    """doc_id and the ids as little-endian unsigned 32-bit integers."""
    null, width, doc_id = struct.unpack_from(_HEAD, payload)
    body = payload[_HEAD_BYTES :]
    return (None if null else doc_id), body if width == 4 else np.frombuffer(body, dtype="<u2").astype("<u4").tobytes()


def _open(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def write_records(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write record and index files; returns the written manifest.

    A null text is empty and has the end id alone; null ids come first; rows of equal id follow the
    order of their texts; an empty table writes no file. A very long text is one record. Only doc_id and text are read, whatever other
    columns there are.
    """
    folder = folder or new_path(docs.sparkSession, "records")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer_path)
        width = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        end = struct.pack("<I", end_id)
        pid = TaskContext.get().partitionId()
        name = f"part-{pid:06d}-{uuid.uuid4().hex}"
        store, base = _open(folder)
        docs_n = tokens = at = 0
        data = index = None
        for batch in sliced_by_size(batches, "text"):
            ids, texts = column(batch, "doc_id"), [t or "" for t in column(batch, "text")]
            for doc_id, coded in zip(ids, encoder.encode(texts), strict=True):
                if data is None:
                    store.create_dir(base, recursive=True)
                    data, index = store.open_output_stream(f"{base}/{name}.rec"), store.open_output_stream(f"{base}/{name}.idx")
                    index.write(INDEX_MAGIC)
                record = frame(payload_of(doc_id, coded + end, width))
                data.write(record)
                n = len(coded) // 4 + 1
                index.write(struct.pack(_ENTRY, doc_id or 0, at, n, tokens))
                docs_n, tokens, at = docs_n + 1, tokens + n, at + len(record)
        if data is not None:
            data.close()
            index.close()
            row = [[pid], [docs_n], [tokens], [f"{name}.rec"], [f"{name}.idx"], [at]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)],
                names=["pid", "docs", "tokens", "record_file", "index_file", "n_bytes"],
            )

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = materialize(arrow_map(ordered, write, MANIFEST), "manifest")
    return manifest.withColumn("folder", F.lit(folder))


def read_index(path: str) -> np.ndarray:
    store, at = _open(path)
    with store.open_input_stream(at) as f:
        data = f.read()
    if data[:8] != INDEX_MAGIC or (len(data) - 8) % _ENTRY_BYTES:
        raise CorruptRecord(f"{path} is no whole index file")
    return np.frombuffer(data[8:], dtype=[("doc_id", "<i8"), ("offset", "<u8"), ("tokens", "<u8"), ("before", "<u8")])


def read_at(path: str, offset: int, length: int) -> bytes:
    """The payload at an offset that the index gives: the read that shuffled training does."""
    store, at = _open(path)
    with store.open_input_file(at) as f:
        f.seek(offset)
        return unframe(f.read(length))


def read_records(manifest: DataFrame) -> DataFrame:
    """Read the files of ``manifest`` back, one task a file: doc_id, start, n_tokens, ids_crc32.

    start counts the ids of all documents before it: those of lower files, from the manifest's one
    row for each file, and those before it in its own file, from the index.
    """
    earlier = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).cast("long"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                index = read_index(f"{row['folder']}/{row['index_file']}")
                store, at = _open(f"{row['folder']}/{row['record_file']}")
                sizes = np.diff(np.append(index["offset"], np.uint64(row["n_bytes"]))).astype(np.int64)
                with store.open_input_stream(at, buffer_size=1 << 20) as f:
                    for lo in range(0, len(index), 4096):
                        ids, starts, counts, crcs = [], [], [], []
                        for entry, size in zip(index[lo : lo + 4096], sizes[lo : lo + 4096], strict=True):
                            doc_id, coded = ids_of(unframe(f.read(int(size))))
                            if len(coded) != 4 * int(entry["tokens"]):
                                raise CorruptRecord("index and record differ")
                            ids.append(doc_id)
                            starts.append(row["base"] + int(entry["before"]))
                            counts.append(len(coded) // 4)
                            crcs.append(zlib.crc32(coded))
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, counts, crcs)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return arrow_map(parts.repartition(files, "pid"), read, "doc_id long, start long, n_tokens long, ids_crc32 long")
