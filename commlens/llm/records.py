"""Length-delimited binary records of token ids, with an offset index.

A shard ``part-N.rec`` is a run of records in ascending doc_id order::

    uint64  n            bytes of the payload (little-endian, as all numbers)
    uint32  masked crc32 of those eight bytes
    n bytes payload      int64 doc_id, uint8 width (2 or 4), uint8 has_id, ids
    uint32  masked crc32 of the payload

and ``part-N.idx`` holds a uint64 offset for each record, so that ``read_shuffled`` can
fetch records in any order.  A checksum c is masked as rotate-right(c, 15) + 0xa282ead8
modulo 2**32, so that a checksum of data that holds checksums stays meaningful.

Texts are encoded where they are read; only their ids are shuffled, to the range of ids
that a bucket holds (quantiles of doc_id, one bucket for about ``SHARD_BYTES`` of text, and
``MOST_RANGES`` of them at most).  A bucket is a task; its shards end at ``SHARD_BYTES``, so
they stay as large where there are more of them than buckets.
An id that fills several buckets (repeated, or null) is dealt over them by the checksum
of the ids, which is also the order among rows of one id.

A task writes under names of its own and renames at the end.  The manifest, one row a
shard, is a Parquet table beside the shards; Spark's commit makes it hold the shards of
exactly one run of a task that is lost or run twice, and readers take shards from there
only.  Where a shard's ids start is a running total of the manifest, by bucket.

Null texts are empty (the end id alone); null ids sort first; an empty table writes no
shard and reads as empty; only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from commlens.llm.common import map_batches, shared_dir, texts
from commlens.llm.token_count import loaded

_HEAD = struct.Struct("<QI")
_DOC = struct.Struct("<qBB")
_CRC = struct.Struct("<I")
#: Bytes of text of a shard, about.
SHARD_BYTES = 32 << 20
#: Buckets at most: their bounds come from one aggregate, and their totals are summed in one task.
MOST_RANGES = 20_000
_LEAST = -(1 << 63)
MANIFEST = "path string, bucket int, part int, n_docs long, n_ids long"
RECORD = "doc_id long, start long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> int:
    """The masked crc32 of data."""
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """One record."""
    n = struct.pack("<Q", len(payload))
    return n + _CRC.pack(masked(n)) + payload + _CRC.pack(masked(payload))


def read_record(f) -> bytes | None:
    """The next record's payload; None at the end of the file; an error if it is damaged."""
    head = f.read(_HEAD.size)
    if not head:
        return None
    if len(head) < _HEAD.size or masked(head[:8]) != _HEAD.unpack(head)[1]:
        raise ValueError("damaged record length")
    n = _HEAD.unpack(head)[0]
    payload, check = f.read(n), f.read(_CRC.size)
    if len(payload) < n or len(check) < _CRC.size or masked(payload) != _CRC.unpack(check)[0]:
        raise ValueError("damaged record")
    return payload


def pack(doc: int | None, width: int, ids: bytes) -> bytes:
    """The payload of one document."""
    return _DOC.pack(doc or 0, width, doc is not None) + ids


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    """doc_id and ids of a payload."""
    doc, width, has_id = _DOC.unpack_from(payload)
    return doc if has_id else None, np.frombuffer(payload, dtype=f"<u{width}", offset=_DOC.size)


def _bounds(docs: DataFrame, shard_bytes: int) -> list[int]:
    """Quantiles of doc_id (null as the smallest number): where buckets begin."""
    size, rows = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    n = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // shard_bytes))
    n = max(1, min(n, rows, MOST_RANGES))
    if n == 1:
        return []
    at = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST))
    return docs.agg(F.percentile_approx(at, [k / n for k in range(1, n)], max(10_000, 10 * n))).first()[0]


def write_records(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode, append ``end_id``, write shards below ``folder``; the manifest, one row a shard."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bounds = np.array(_bounds(docs, shard_bytes), dtype=np.int64)

    def encode(b: pa.RecordBatch) -> pa.RecordBatch:
        encoder = loaded(tokenizer_path)
        end = end_id.to_bytes(encoder.width, "little")
        flat, n = encoder.encode(texts(b))
        data, ends = flat.tobytes(), (np.cumsum(n) * encoder.width).tolist()
        ids = [data[a:z] + end for a, z in zip([0, *ends[:-1]], ends, strict=True)]
        crc = np.array([zlib.crc32(x) for x in ids], dtype=np.int64)
        at = b.column(0).fill_null(_LEAST).to_numpy()
        first, last = np.searchsorted(bounds, at, "left"), np.searchsorted(bounds, at, "right")
        bucket = first + (crc * (last - first + 1) >> 32)  # a share of the buckets that hold nothing but this id
        return pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), b.column(0), pa.array(crc), pa.array(ids, pa.binary())], ["bucket", "doc_id", "crc", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = loaded(tokenizer_path).width
        shard = None
        for b in batches:
            for bucket, doc, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if shard is None or shard.bucket != bucket or shard.at >= shard_bytes:
                    if shard is not None:
                        yield shard.close()
                    shard = _Shard(folder, bucket, shard.part + 1 if shard is not None and shard.bucket == bucket else 0)
                shard.add(doc, width, ids)
        if shard is not None:
            yield shard.close()

    coded = map_batches(docs, encode, "bucket int, doc_id long, crc long, ids binary")
    # a partition for each bucket, so that none holds several
    dealt = coded.repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions("bucket", "doc_id", "crc", "ids")
    # the writer's only output is the manifest, which Spark commits
    dealt.select("bucket", "doc_id", "ids").mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return read_manifest(docs.sparkSession, folder)


class _Shard:
    """A shard being written, under a name of its own."""

    def __init__(self, folder: str, bucket: int, part: int):
        self.bucket, self.part, self.name = bucket, part, f"{bucket:06d}-{part:06d}-{uuid.uuid4().hex}"
        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.store.create_dir(self.root)
        self.out = self.store.open_output_stream(f"{self.root}/.{self.name}.rec")
        self.offsets: list[int] = []
        self.at = self.n_ids = 0

    def add(self, doc: int | None, width: int, ids: bytes) -> None:
        data = frame(pack(doc, width, ids))
        self.out.write(data)
        self.offsets.append(self.at)
        self.at += len(data)
        self.n_ids += len(ids) // width

    def close(self) -> pa.RecordBatch:
        self.out.close()
        with self.store.open_output_stream(f"{self.root}/.{self.name}.idx") as f:
            f.write(np.array(self.offsets, dtype="<u8").tobytes())
        for kind in ("idx", "rec"):
            self.store.move(f"{self.root}/.{self.name}.{kind}", f"{self.root}/part-{self.name}.{kind}")
        row = {"path": f"part-{self.name}", "bucket": self.bucket, "part": self.part, "n_docs": len(self.offsets), "n_ids": self.n_ids}
        return pa.RecordBatch.from_pylist([row], pa.schema([("path", pa.string()), ("bucket", pa.int32()), ("part", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The shards of a folder; their order is that of ``bucket`` and ``part``."""
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _shards(spark: SparkSession, folder: str, seed: int | None = None) -> DataFrame:
    """path, start (ids of all shards before it), n_docs and a seed of every shard, dealt over tasks.

    In order without a seed, else in a random one that the seed, bucket and part give.
    """
    rows = read_manifest(spark, folder)
    sums = rows.groupBy("bucket").agg(F.sum("n_ids").alias("n"))  # MOST_RANGES rows at most
    ahead = sums.select("bucket", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("ahead") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))
    mixed = F.pmod(F.xxhash64(F.lit(seed or 0), "bucket", "part"), F.lit(1 << 62))
    shards = rows.join(F.broadcast(ahead), "bucket").select("path", start.alias("start"), "n_docs", mixed.alias("seed"), "bucket", "part")
    order = ["bucket", "part"] if seed is None else ["seed", "bucket", "part"]
    tasks = max(1, min(rows.count(), MOST_RANGES))
    return shards.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("path", "start", "n_docs", "seed")


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record, by streaming each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in (x for b in batches for x in b.to_pylist()):
            store, root = fs.FileSystem.from_uri(folder)
            at, rows, seen = x["start"], [], 0
            with store.open_input_stream(f"{root}/{x['path']}.rec") as f:
                while (payload := read_record(f)) is not None:
                    doc, ids = unpack(payload)
                    rows.append((doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at, seen = at + len(ids), seen + 1
                    if len(rows) == 20_000:
                        yield _batch(rows)
                        rows = []
            if seen != x["n_docs"]:
                raise ValueError(f"{x['path']}: {seen} records, not {x['n_docs']}")
            if rows:
                yield _batch(rows)

    return _shards(spark, folder).mapInArrow(run, RECORD)


def fetch(store: fs.FileSystem, path: str, numbers: list[int]) -> Iterator[tuple[int | None, np.ndarray]]:
    """doc_id and ids of the records of a shard with these numbers, in this order, by its offset index."""
    with store.open_input_file(f"{path}.idx") as f:
        offsets = np.frombuffer(f.read(), dtype="<u8").tolist()
    with store.open_input_file(f"{path}.rec") as f:
        for k in numbers:
            f.seek(offsets[k])
            yield unpack(read_record(f))


def read_shuffled(spark: SparkSession, folder: str, seed: int) -> DataFrame:
    """doc_id, ids of every record: shards in a random order, and each one's records too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in (x for b in batches for x in b.to_pylist()):
            store, root = fs.FileSystem.from_uri(folder)
            order = np.random.default_rng(x["seed"]).permutation(x["n_docs"]).tolist()
            for rows in batched(fetch(store, f"{root}/{x['path']}", order), 256):
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array([i.astype(np.int64) for _, i in rows], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return _shards(spark, folder, seed).mapInArrow(run, "doc_id long, ids array<long>")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write the documents' records to a new shared folder and read them back."""
    folder = shared_dir(docs.sparkSession)
    write_records(docs, tokenizer_path, folder, end_id)
    return read_digests(docs.sparkSession, folder)
