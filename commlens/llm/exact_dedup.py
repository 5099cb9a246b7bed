"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. Every partition is a sender (of at most ``CHUNK`` rows; a longer one is several).  It sorts
   the fingerprints of its texts, equal ones once, and sends each owner the share that it owns,
   as a Golomb code of the gaps.  A fingerprint has log2(rows) + ``SLACK`` bits, so a row that is
   alone is suspected with probability 2**-SLACK, and a code takes some
   bits - log2(fingerprints of the sender) + 1.5 of them.
2. Every owner decodes what it got, and answers each sender with a bitmap: a bit for each
   fingerprint that another sender has too.
3. Rows that are alone are done.  Suspects, whose fingerprint is marked or stands twice in
   their own sender, are verified by bytes: texts are grouped by their whole contents.  Texts
   that are surely no suspect's are set aside where they are read, by a bitmap of the suspects'
   fingerprints (16 MB at most; beyond, it lets more texts pass, which changes no result).

A text that a third of all rows hold is one fingerprint of each sender and, summed up before
the shuffle, one row of each task.  What senders sent and learnt is written to the shared
folder, so a lost executor costs the tasks it ran.

Golomb codes have a power of two for their divisor, and all quotients (in unary) before all
remainders, so that numpy decodes them without a loop over the numbers.

Nulls count as empty texts, which are equal to each other.  Of equal texts the row with the
largest id stays (a null id is smaller than any; of rows that repeat the largest id, one).  An
empty table gives an empty table.  Texts are compared whole, in the JVM; the operator reads doc_id
and text alone, so that other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commlens.llm.common import bounded_batches, forget, ragged, written

#: Bits of a fingerprint beyond log2(rows).
SLACK = 10
#: Rows of a sender, and fingerprints of an owner, at most (about).
CHUNK, OWNED = 1 << 18, 1 << 20
#: Bits of the bitmap of suspects, at most (16 MB), and of one row of it.
MOST_LOG2, ROW_BITS = 27, 32_768
SENT = "sender long, owner int, n int, low long, code binary, counts array<int>, ids array<long>, digests binary"
ANSWER = "sender long, owner int, marks binary"
ROW = "doc_id long, print long, digest binary, suspect boolean"


def golomb(sorted_: np.ndarray, low: int) -> bytes:
    """The code of ascending numbers, from ``low`` on: one byte k, then quotients, then k-bit remainders."""
    gaps = np.diff(sorted_.astype(np.int64), prepend=low)
    mean = (int(sorted_[-1]) - low) / len(sorted_)
    k = max(0, int(mean * np.log(2)).bit_length() - 1)
    quotient = gaps >> k
    unary = np.zeros(int(quotient.sum()) + len(gaps), dtype=np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 1
    rest = (gaps[:, None] >> np.arange(k - 1, -1, -1) & 1).astype(np.uint8)
    return bytes([k]) + np.packbits(np.concatenate([unary, rest.ravel()])).tobytes()


def ungolomb(code: bytes, n: int, low: int) -> np.ndarray:
    """The numbers of a code."""
    k = code[0]
    bits = np.unpackbits(np.frombuffer(code, dtype=np.uint8, offset=1))
    ones = np.flatnonzero(bits[: len(bits) - n * k])[:n]
    at = int(ones[-1]) + 1
    rest = np.zeros(n, dtype=np.int64)
    for x in bits[at : at + n * k].reshape(n, k).T:
        rest = rest << 1 | x
    return low + np.cumsum((np.diff(ones, prepend=-1) - 1 << k) + rest)


def _parcels(prints: np.ndarray, ids: pa.Array, digests: pa.Array, owners: int, bits: int, sender: int) -> Iterator[dict]:
    """What one sender sends each owner, and keeps: its rows in the order of their fingerprints."""
    order = np.argsort(prints, kind="stable")
    distinct, counts = np.unique(prints, return_counts=True)
    owner = (distinct.astype(np.uint64) * np.uint64(owners) >> np.uint64(bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(owner)) + 1
    rows = np.concatenate([[0], np.cumsum(counts)])
    for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(distinct)], strict=True):
        own = pa.array(order[rows[a] : rows[z]])
        low = -(-(int(owner[a]) << bits) // owners)  # the smallest fingerprint of this owner
        yield {
            "sender": sender, "owner": int(owner[a]), "n": z - a, "low": low, "code": golomb(distinct[a:z], low),
            "counts": counts[a:z].tolist(), "ids": ids.take(own).to_pylist(), "digests": b"".join(digests.take(own).to_pylist()),
        }


def _schema(*kinds: tuple[str, pa.DataType]) -> pa.Schema:
    return pa.schema(kinds)


_SENT = _schema(("sender", pa.int64()), ("owner", pa.int32()), ("n", pa.int32()), ("low", pa.int64()), ("code", pa.binary()), ("counts", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64())), ("digests", pa.binary()))


def send(rows: DataFrame, owners: int, bits: int, chunk: int = CHUNK) -> DataFrame:
    """One row for each sender and owner, of rows (doc_id, print, digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender, held, size = TaskContext.get().partitionId() << 32, [], 0

        def parcels() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            for x in _parcels(t.column(1).to_numpy(), t.column(0).chunk(0), t.column(2).chunk(0), owners, bits, sender):
                yield pa.RecordBatch.from_pylist([x], _SENT)

        for b in batches:
            if size and size + b.num_rows > chunk:
                yield from parcels()
                sender, held, size = sender + 1, [], 0
            if b.num_rows:
                held.append(b)
                size += b.num_rows
        if size:
            yield from parcels()

    return rows.mapInArrow(run, SENT)


def answer(sent: DataFrame) -> DataFrame:
    """A bitmap for each sender and owner: bit i is set if another sender has its i-th fingerprint too."""

    def run(t: pa.Table) -> pa.Table:
        n = t.column("n").to_pylist()
        decoded = [ungolomb(c, k, low) for c, k, low in zip(t.column("code").to_pylist(), n, t.column("low").to_pylist(), strict=True)]
        _, number, count = np.unique(np.concatenate(decoded), return_inverse=True, return_counts=True)
        marks = [np.packbits(m).tobytes() for m in np.split(count[number] > 1, np.cumsum(n)[:-1])]
        return pa.table({"sender": t.column("sender"), "owner": t.column("owner"), "marks": pa.array(marks, pa.binary())})

    return sent.select("sender", "owner", "n", "low", "code").groupBy("owner").applyInArrow(run, ANSWER)


def unpacked(answered: DataFrame) -> DataFrame:
    """doc_id, print, digest, suspect: the senders' rows, as the owners' bitmaps judge them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in (x for b in batches for i in range(b.num_rows) for x in b.slice(i, 1).to_pylist()):
            counts = np.array(x["counts"])
            marked = np.unpackbits(np.frombuffer(x["marks"], dtype=np.uint8), count=x["n"]).astype(bool) | (counts > 1)
            prints = np.repeat(ungolomb(x["code"], x["n"], x["low"]), counts)
            digests = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(prints), [None, pa.py_buffer(x["digests"])]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x["ids"], pa.int64()), pa.array(prints), digests, pa.array(np.repeat(marked, counts))], ["doc_id", "print", "digest", "suspect"])

    return answered.mapInArrow(run, ROW)


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def _print(bits: int) -> Column:
    """The first bits of a 64-bit hash of the text."""
    return F.shiftrightunsigned(F.xxhash64(_text()), 64 - bits)


def _bitmap(prints: DataFrame, log2: int) -> DataFrame:
    """row, bits: a bitmap of hashed fingerprints, at most 2**MOST_LOG2 / ROW_BITS rows of 4 KB."""
    at = F.pmod(F.xxhash64("print"), F.lit(1 << log2)) + 1
    return prints.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))


def parted(docs: DataFrame, prints: DataFrame, bits: int) -> DataFrame:
    """row (a document, as a struct), text (null as empty) and maybe: whether its fingerprint is among ``prints``.

    A few more are, but none is missed; texts stay where they are read.
    """
    log2 = min(MOST_LOG2, max(15, (16 * prints.count()).bit_length()))
    held = _bitmap(prints, log2).withColumnRenamed("row", "line")
    at = F.pmod(F.xxhash64(_print(bits)), F.lit(1 << log2))
    placed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _text().alias("text"), at.alias("at"))
    place = F.pmod("at", F.lit(ROW_BITS))
    byte = F.conv(F.hex(F.substring("bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    # a broadcast of at most 4096 rows of 4 KB
    there = placed.join(F.broadcast(held), F.floor(F.col("at") / ROW_BITS) + 1 == F.col("line"), "left")
    return there.select("row", "text", F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False)).alias("maybe"))


def _judged(docs: DataFrame, chunk: int, owned: int) -> tuple[DataFrame, int]:
    """Rows as ``unpacked`` has them (written), and the bits of a fingerprint."""
    bounded_batches(docs.sparkSession)
    n = docs.count()
    bits = max(1, n).bit_length() + SLACK
    owners = max(docs.sparkSession.sparkContext.defaultParallelism, -(-n // owned))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _print(bits).alias("print"), F.unhex(F.sha2(_text(), 256)).alias("digest"))
    sent = written(send(rows, owners, bits, chunk))
    judged = written(unpacked(sent.join(answer(sent), ["sender", "owner"])))
    forget(sent)
    return judged, bits


def find_duplicates(docs: DataFrame, chunk: int = CHUNK, owned: int = OWNED) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    docs = docs.select("doc_id", "text")
    judged, bits = _judged(docs, chunk, owned)
    suspects = judged.where("suspect")
    texts = parted(docs, written(suspects.select("print").distinct()), bits).where("maybe").select("row.doc_id", "text")
    # equal bytes, whole texts; summed up where they are read, so a text of very many rows is a row a task
    equal = texts.groupBy("text").agg(F.max("doc_id").cast("long").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = written(equal.where("group_size > 1").select(F.unhex(F.sha2("text", 256)).alias("digest"), "keep_id", "group_size"))
    # rows that repeat an id and text are told apart by a number
    same = suspects.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("times"))
    hit = same.join(groups, "digest", "left").select(
        "doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "digest", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("time"),
    )
    hit = hit.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("time") == 1)).alias("kept"), "digest")
    alone = judged.where("NOT suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    return alone.unionByName(hit).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, chunk: int = CHUNK, owned: int = OWNED) -> DataFrame:
    """One row of each text, with all its columns: the one with the largest id (any, of equal ids)."""
    judged, bits = _judged(docs.select("doc_id", "text"), chunk, owned)
    rows = parted(docs, written(judged.where("suspect").select("print").distinct()), bits)
    rank = F.struct(F.col("row.doc_id").isNotNull(), F.col("row.doc_id"))
    one = rows.where("maybe").groupBy("text").agg(F.max_by("row", rank).alias("row"))
    return rows.where("NOT maybe").select("row.*").unionAll(one.select("row.*"))
