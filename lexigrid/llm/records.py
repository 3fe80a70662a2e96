"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

One shard per range of doc_id, in ascending order. A shard `part-NNNNN.rec` is a sequence of records

    length  u64 little-endian, bytes of the payload
    mask    u32, masked checksum of those 8 bytes
    payload the serialized sequence: doc_id i64, valid u8, width u8 (2 or 4), ids of that width
    mask    u32, masked checksum of the payload

and `part-NNNNN.idx` holds one (offset u64, tokens u64) per record. The checksum is CRC-32, masked as
((crc >> 15 | crc << 17) + 0xa282ead8) mod 2^32, so that a checksum of data that holds checksums
stays useful. Ids are two bytes wide where the vocabulary allows. A task writes under a name of its
own attempt and then renames, so a lost or repeated attempt leaves no half shard and the last one
to finish is whole.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import codec
from .common import SLICE_BYTES, raw, slices, text_bytes

MANIFEST = "shard long, path string, n_docs long, n_tokens long, n_bytes long"


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = len(payload).to_bytes(8, "little")
    return b"".join((length, masked(zlib.crc32(length)).to_bytes(4, "little"), payload, masked(zlib.crc32(payload)).to_bytes(4, "little")))


def payload(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """ids: 32-bit, little-endian."""
    if width == 2:
        ids = np.frombuffer(ids, "<u4").astype("<u2").tobytes()
    return (doc_id or 0).to_bytes(8, "little", signed=True) + bytes((doc_id is not None, width)) + ids


def parse(data: bytes) -> tuple[int | None, np.ndarray]:
    ids = np.frombuffer(data, "<u2" if data[9] == 2 else "<u4", offset=10)
    return (int.from_bytes(data[:8], "little", signed=True) if data[8] else None), ids.astype("<u4")


def unframe(stream, path: str) -> Iterator[bytes]:
    """Payloads of a shard in order, each held against its checksums."""
    while head := stream.read(12):
        if len(head) < 12 or masked(zlib.crc32(head[:8])) != int.from_bytes(head[8:], "little"):
            raise ValueError(f"{path}: a length doesn't match its checksum")
        n = int.from_bytes(head[:8], "little")
        body = stream.read(n + 4)
        if len(body) < n + 4 or masked(zlib.crc32(body[:n])) != int.from_bytes(body[n:], "little"):
            raise ValueError(f"{path}: a record doesn't match its checksum")
        yield body[:n]


def folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write_records(df: DataFrame, to: str, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Encode every whole text, append end_id, and write shards in the folder `to` (a URI that all
    executors see). Returns the manifest: one row per shard that has records, with its path.

    Texts are shuffled once, by range of doc_id; the ids are made in the task that writes them. Null
    text counts as empty (its record holds the end id alone); null doc_ids come first; rows with
    one doc_id lie next to each other, in order of text. Other columns are left out. An empty table
    gives no shards.
    """
    spark = df.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    where, root = folder(to)
    where.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        width = 2 if max(len(c.token), (end_id or 0) + 1) <= 1 << 16 else 4
        end = b"" if end_id is None else end_id.to_bytes(4, "little")
        shard = TaskContext.get().partitionId()
        disk, root = folder(to)
        name = f"{root}/part-{shard:05d}"
        attempt = f"{root}/_attempt-{uuid.uuid4().hex}"
        docs = tokens = at = 0
        index, out = [], None
        for b in slices(batches, "text"):
            if out is None:
                out = disk.open_output_stream(attempt)
            frames = []
            for doc_id, ids in zip(b.column(0).to_pylist(), c.encode_all(*raw(b.column(1)))):
                frames.append(frame(payload(doc_id, ids + end, width)))
                count = (len(ids) + len(end)) // 4
                index.append((at, count))
                at += len(frames[-1])
                tokens += count
                docs += 1
            out.write(b"".join(frames))
        if out is None:
            return
        out.close()
        with disk.open_output_stream(f"{attempt}.idx") as f:
            f.write(np.array(index, "<u8").tobytes())
        disk.move(f"{attempt}.idx", f"{name}.idx")
        disk.move(attempt, f"{name}.rec")
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"{to}/part-{shard:05d}"], "n_docs": [docs], "n_tokens": [tokens], "n_bytes": [at]})

    d = text_bytes(df, id_col, text_col).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return d.mapInArrow(run, MANIFEST)


def read_records(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Every record of the manifest's shards: doc_id, start (tokens of all records before it),
    n_tokens, ids (binary, 32-bit little-endian). A wrong checksum or length raises ValueError."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                disk, name = folder(path + ".rec")
                rows, size = [], 0
                with disk.open_input_stream(name, buffer_size=1 << 20) as f:
                    for record in unframe(f, path):
                        doc_id, ids = parse(record)
                        rows.append((doc_id, start, len(ids), ids.tobytes()))
                        start += len(ids)
                        size += len(record)
                        if size > SLICE_BYTES:
                            yield as_batch(rows)
                            rows, size = [], 0
                if rows:
                    yield as_batch(rows)

    return with_start(spark, manifest).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    doc_id, start, n, ids = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])


def with_start(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(path, start) of each shard. The manifest has one row per shard, as many as tasks wrote."""
    shards = sorted(manifest.select("shard", "path", "n_tokens").collect())
    start, rows = 0, []
    for s in shards:
        rows.append((s.path, start))
        start += s.n_tokens
    return spark.createDataFrame(rows, "path string, start long").repartition(max(1, len(rows)), "path")


def read_shuffled(path: str, seed: int, pick: Callable[[int], bool] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of one shard's records in an order drawn from the seed, by the offset index."""
    disk, name = folder(path + ".rec")
    with disk.open_input_stream(f"{folder(path)[1]}.idx") as f:
        index = np.frombuffer(f.read(), "<u8").reshape(-1, 2)
    with disk.open_input_file(name) as f:
        for i in np.random.default_rng(seed).permutation(len(index)).tolist():
            if pick is None or pick(i):
                f.seek(int(index[i, 0]))
                yield parse(next(unframe(f, path)))


def crc_digest(read: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of read_records."""
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
