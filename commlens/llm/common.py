"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch handed to a Python worker: bounds its memory
#: whatever the size of the input partition (a single longer row is a batch of its own).
BATCH_ROWS, BATCH_BYTES = 2000, 2 << 20
#: Characters of a slice of a text that is split into words at once.
SLICE = 1 << 18
#: Rows of a batch of the Parquet reader, which holds all their texts in one array, and bytes
#: of a row group, which a writer holds until it is full.
READ_ROWS, GROUP_BYTES = 512, 16 << 20
try:  # glibc only
    _TRIM = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):
    _TRIM = None
_CUT = re.compile(r"[ \t\n\r]")

_LOWER_AZ = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The named input table."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session's Python operators, and its reads of long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one only in local mode, where that may be unset.

    The folder is removed when the application ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="commlens-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/commlens-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    if SparkContext._active_spark_context is None:
        return
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back.

    Unlike a cache, the table survives the loss of any executor; unlike an RDD
    checkpoint it is columnar and compressed.
    """
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").option("parquet.block.size", GROUP_BYTES).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores as make it differ from all columns (whose case doesn't count)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _drop(b: pa.RecordBatch, at: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c for k, c in enumerate(b.columns) if k != at], [n for k, n in enumerate(b.schema.names) if k != at])


def forget(df: DataFrame) -> None:
    """Delete the folder of a table that ``written`` made and nothing reads any more."""
    _remove(df.sparkSession, df._written_to)


class IdFilter:
    """A bitmap of hashed ids: passes every id of a set and few others.

    It has 16 to 32 bits for each id, and at most 2**``MOST_LOG2`` (16 MB): beyond, it passes more
    ids, never fewer, so that an exact join after it gives the same rows at every size.
    """

    MOST_LOG2 = 27

    def __init__(self, ids: DataFrame, *columns: str):
        self.log2 = min(self.MOST_LOG2, max(15, (16 * ids.count()).bit_length()))
        place = (self.place(*columns) + 1).alias("at")
        rows = ids.select(place).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
        bits = bytearray((1 << self.log2) // 8)
        for r in rows.collect():  # at most 2**MOST_LOG2 / 32768 rows of 4 KB
            bits[(r.bucket - 1) * 4096 : r.bucket * 4096] = r.bits
        self.shared = ids.sparkSession.sparkContext.broadcast(bytes(bits))

    def place(self, *columns: str) -> Column:
        """The bit of an id."""
        return F.pmod(F.xxhash64(*columns), F.lit(1 << self.log2))

    def part(self, df: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
        """Rows whose id may be in the set, and rows whose id is not."""
        at = len(df.columns)
        placed = df.withColumn(unused(df, "at"), self.place(*columns))

        def rows(inside: bool) -> DataFrame:
            return map_batches(placed, lambda b: _drop(b.filter(pa.array(self.passes(b.column(at).to_numpy()) == inside)), at), df.schema)

        return rows(True), rows(False)

    def passes(self, at: np.ndarray) -> np.ndarray:
        """Whether the bits at these places are set (in a Python worker)."""
        table = np.frombuffer(self.shared.value, dtype=np.uint8)
        return (table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    def __getstate__(self):
        return {"shared": self.shared, "log2": self.log2}


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, null as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def give_back() -> None:
    """Return free memory to the system: allocators keep what a batch has used, several times its size."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``fn`` to every Arrow batch; batches without rows are skipped."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := fn(b)) is not None:
                yield out
            give_back()

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, keep: Callable[[list[str]], np.ndarray], column: str = "text") -> DataFrame:
    """Rows whose text ``keep`` accepts; every column passes through unchanged."""
    return map_batches(df, lambda b: b.filter(pa.array(keep(texts(b, column)))), df.schema)


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut before white space only (a longer word stays whole)."""
    at = 0
    while len(text) - at > size and (m := _CUT.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def grouped(docs: list[str], size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges (begin, end) of texts that together hold at most ``size`` characters, or one longer text."""
    begin = total = 0
    for i, d in enumerate(docs):
        if total and total + len(d) > size:
            yield begin, i
            begin, total = i, 0
        total += len(d)
    if begin < len(docs):
        yield begin, len(docs)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions starts[0], ... of sizes[0] places, then of the next run, and so on."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total + int(starts.max(initial=0)) < 1 << 31 else np.int64
    return np.repeat((starts - ends + sizes).astype(kind), sizes) + np.arange(total, dtype=kind)


def lower_az(data: bytes) -> bytes:
    """Lower-case A-Z only."""
    return data.translate(_LOWER_AZ)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def code_points(docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts end to end, and where each text starts (one more at the end)."""
    codes = np.frombuffer("".join(docs).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.zeros(len(docs) + 1, dtype=np.int64)
    np.cumsum([len(d) for d in docs], out=starts[1:])
    return codes, starts


def window_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every run of n code points (len - n + 1 of them)."""
    if len(codes) < n:
        return np.zeros(0, dtype=np.uint64)
    m = len(codes) - n + 1
    h = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += codes[k : k + m].astype(np.uint64) + np.uint64(1)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h
