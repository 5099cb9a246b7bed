"""MinHash near-duplicates with SuperMinHash signatures.

A document's set holds the hashes of its word shingles (A-Z lower-cased, ASCII white
space between words).  Documents with equal sets form a class, and only class
representatives go on; copies are never expanded into pairs.

SuperMinHash: every element has a random permutation of the signature's slots; slot i of
the signature is the smallest (rank + uniform fraction) that any element gives it.  Ranks
are correlated within an element, which lowers the variance, and a document is done as
soon as every slot is filled by a lower rank than the next round's (early stopping): a
long document needs two or three rounds whatever the size of its signature.

Banding gives candidate buckets.  Instead of all pairs of a bucket:

1. every member is compared with the bucket's leader, the member that shares the most
   buckets (a base text of many copies, usually), on full sets; links join components;
2. in buckets whose other members are still in different components, those outside of the
   leader's component (loose ones) are compared with all others, in blocks: a task gets two
   blocks of about ``BLOCK`` members with their sets and multiplies their incidence
   matrices, so the intersections are exact.  Members of the leader's component are not
   compared with each other.  A task returns a spanning forest of the links it finds, so its
   result is linear in the members.

So each pair that shares a bucket is either compared or already connected.  A pair at the
threshold shares no bucket with probability (1 - t**ROWS)**BANDS, 2e-8 at 0.85 and 1e-7
at 0.8 for the defaults.

Nulls, empty texts and texts without words have an empty set and link with nothing;
texts with fewer words than a shingle have their whole sequence as one; rows with a null
id take part but have no id to give (the component's smallest non-null id counts).  A
repeated id gives a row for each of its texts; an empty table gives an empty table; only
doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commlens.llm.common import IdFilter, forget, grouped, map_batches, mix64, slices, texts, unused, written
from commlens.llm.components import connected_components
from commlens.llm.words import hashed_words

ROWS, BANDS = 4, 28
#: Elements whose permutations are held at once (a byte for each of their slots).
_ELEMENTS = 1 << 15
#: Members of a block in the exact comparison.
BLOCK = 512
_ONE = 2.0**-53


def shingle_sets(docs: list[str], n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's n-word shingles."""
    out: list[np.ndarray] = []
    for a, b in grouped(docs):
        parts = docs[a:b] if b - a > 1 else list(slices(docs[a]))
        h, counts = hashed_words(parts, lower=True)
        out += [_shingles(x, n) for x in np.split(h, np.cumsum(counts)[:-1])] if b - a > 1 else [_shingles(h, n)]
    return out


def _shingles(h: np.ndarray, n: int) -> np.ndarray:
    if not len(h):
        return np.zeros(0, np.uint64)
    n = min(n, len(h))
    m = len(h) - n + 1
    out = np.full(m, np.uint64(n))
    for k in range(n):
        out = (out ^ h[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(mix64(out))


def super_minhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Signatures (rank + fraction, as floats) of all sets; +inf where a set is empty."""
    out = np.full((len(sets), m), np.inf)
    group: list[int] = []
    size = 0
    for i, s in enumerate(sets):
        if size and size + len(s) > _ELEMENTS:
            _sign(sets, group, out, m)
            group, size = [], 0
        group.append(i)
        size += len(s)
    _sign(sets, group, out, m)
    return out


def _sign(sets: list[np.ndarray], group: list[int], out: np.ndarray, m: int) -> None:
    for begin in range(0, max((len(sets[i]) for i in group), default=0), _ELEMENTS):  # a huge set goes in parts
        parts = [sets[i][begin : begin + _ELEMENTS] for i in group]
        h = np.concatenate(parts)
        owner = np.repeat(np.array(group), [len(p) for p in parts])
        perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(h), 1))
        for j in range(m):
            # a document whose slots are all below j can gain nothing more
            open_ = out[owner].max(axis=1) > j if j == 0 else (out.max(axis=1) > j)[owner]
            if not open_.all():
                h, owner, perm = h[open_], owner[open_], perm[open_]
                if not len(h):
                    break
            r = mix64(h + np.uint64((2 * j + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
            k = j + ((r >> np.uint64(40)) % np.uint64(m - j)).astype(np.int64)
            lines = np.arange(len(h))
            slot = perm[lines, k]
            perm[lines, k] = perm[:, j]
            perm[:, j] = slot
            value = j + (mix64(r) >> np.uint64(11)).astype(np.float64) * _ONE
            np.minimum.at(out, (owner, slot), value)


def bands(signatures: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band; keys of different bands differ."""
    bits = signatures.view(np.uint64).reshape(len(signatures), -1, rows)
    key = np.broadcast_to(np.arange(1, bits.shape[1] + 1, dtype=np.uint64), bits.shape[:2]).copy()
    for k in range(rows):
        key = mix64(key ^ bits[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)  # of an array, so it wraps silently
    return key


def sketch(docs: DataFrame, n: int, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, md5 (of the text), n_shingles, cls (digest of the set; null if empty), keys (its bands)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(texts(b), n)
        cls = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        first = {c: i for i, c in reversed(list(enumerate(cls))) if c is not None}  # equal sets are signed once
        at = sorted(first.values())
        keys = bands(super_minhash([sets[i] for i in at], n_bands * rows), rows).view(np.int64) if at else []
        by = {cls[i]: k.tolist() for i, k in zip(at, keys, strict=True)}
        return pa.RecordBatch.from_arrays(
            [b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(cls, pa.binary()), pa.array([by.get(c, []) for c in cls], pa.list_(pa.int64()))],
            ["doc_id", "md5", "n_shingles", "cls", "keys"],
        )

    return map_batches(docs.select("doc_id", "text", _md5()), run, "doc_id long, md5 binary, n_shingles long, cls binary, keys array<long>")


def _md5() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("md5")


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """cls, s (its set) for the classes in ``wanted`` (cls, doc_id): one text of each is read again.

    Texts are not shuffled: a bitmap of the wanted ids passes over most others where they
    are read, and the exact join takes the sets.
    """
    bits = IdFilter(wanted, "doc_id")

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        b = b.filter(pa.array(bits.passes(b.column(2).to_numpy())))
        sets = shingle_sets(texts(b), n)
        cls = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        return pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["cls", "s"])

    made = map_batches(docs.select("doc_id", "text", bits.place("doc_id").alias("at")), run, "cls binary, s array<long>")
    return written(made.join(wanted.select("cls"), "cls", "left_semi").dropDuplicates(["cls"]))


def _linked(percent: int) -> "F.Column":
    both = F.size(F.array_intersect("sa", "sb"))
    return 100 * both >= percent * (F.size("sa") + F.size("sb") - both)


def _blocks(percent: int):
    """Compare two blocks (i = j: one block with itself); a spanning forest of the links."""

    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        side = table.column("blk").to_numpy()
        cls, roots = table.column("cls").to_pylist(), table.column("root").to_pylist()
        s = table.column("s").combine_chunks()
        elements, count = s.flatten().to_numpy(), pc.list_value_length(s).to_numpy().astype(np.int64)
        root = {c: c for c in roots}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        values, index = np.unique(elements, return_inverse=True)
        owner = np.repeat(np.arange(len(count)), count)
        shared = np.flatnonzero(np.bincount(index) > 1)
        place = np.full(len(values), -1)
        place[shared] = np.arange(len(shared))
        column = place[index]
        both = np.zeros((len(left), len(right)), dtype=np.float32)
        for begin in range(0, len(shared), 2048):
            part = (column >= begin) & (column < begin + 2048)
            m = np.zeros((len(count), min(2048, len(shared) - begin)), dtype=np.float32)
            m[owner[part], column[part] - begin] = 1
            both += m[left] @ m[right].T
        union = count[left][:, None] + count[right][None, :] - both
        a, b = np.nonzero(100 * both.astype(np.float64) >= percent * union.astype(np.float64))
        out = []
        for x, y in zip(left[a].tolist(), right[b].tolist(), strict=True):
            if x != y and (p := find(roots[x])) != (q := find(roots[y])):
                root[p] = q
                out.append((cls[x], cls[y]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([y for _, y in out], pa.binary())})

    return run


def _roots(docs: DataFrame, sketches: DataFrame, n: int, percent: int) -> DataFrame:
    """cls, doc_id (the smallest of its rows), root (of its component) of every class."""
    classes = sketches.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"))
    member = written(classes.select("cls", "doc_id", F.explode("keys").alias("key")))
    many = member.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bucket = written(member.join(many, "key"))
    # the leader: the member with the most company over all its buckets
    company = bucket.groupBy("cls").agg(F.sum("n").alias("company"))
    held = written(bucket.join(company, "cls").select("cls", "key", F.struct("company", "cls").alias("rank")))
    leader = held.groupBy("key").agg(F.max("rank").alias("lead")).select("key", F.col("lead.cls").alias("leader"))
    led = written(held.join(leader, "key").select("key", "cls", "leader"))
    sets = _sets(docs, bucket.select("cls", "doc_id").distinct(), n)
    pairs = led.where("cls <> leader").select(F.greatest("cls", "leader").alias("a"), F.least("cls", "leader").alias("b")).distinct()
    side = [sets.select(F.col("cls").alias(c), F.col("s").alias(f"s{c}")) for c in "ab"]
    stars = written(pairs.join(side[0], "a").join(side[1], "b").where(_linked(percent)).select("a", "b"))
    # what the leaders leave open
    found = connected_components(stars)
    rooted = led.join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    lead = rooted.where("cls = leader").select("key", F.col("root").alias("lead_root"))
    rest = rooted.where("cls <> leader").select("key", "cls", "root")
    open_ = rest.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    # a row for each open bucket, so the joins with its members are small on this side
    lead = written(lead.join(open_, "key"))
    rest = rest.join(lead, "key").select("key", "cls", "root", (F.col("root") != F.col("lead_root")).alias("loose"))
    sizes = rest.groupBy("key").agg(*[F.ceil(F.count_if(c) / BLOCK).cast("int").alias(n) for c, n in ((F.col("loose"), "probes"), (~F.col("loose"), "others"))])
    rest = written(rest.join(sizes, "key"))
    # equal groups of members under several keys are compared once
    same = rest.groupBy("key").agg(F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("f"), F.count(F.lit(1)).alias("n")).groupBy("f", "n").agg(F.min("key").alias("key"))
    # loose members are in blocks 0 to probes - 1, the leader's component in those after them
    block = F.when(F.col("loose"), F.pmod(F.xxhash64("cls"), F.col("probes"))).otherwise(F.col("probes") + F.pmod(F.xxhash64("cls"), F.col("others"))).cast("int")
    placed = rest.join(same.select("key"), "key", "left_semi").withColumn("blk", block)
    # a loose member's block meets every block, one of the leader's component only loose ones
    last = F.when(F.col("loose"), F.col("probes") + F.col("others")).otherwise(F.col("probes")) - 1
    dealt = placed.select("key", "cls", "root", "blk", F.explode(F.sequence(F.lit(0), last)).alias("o")).select("key", "cls", "root", "blk", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"))
    late = dealt.join(sets, "cls").groupBy("key", "i", "j").applyInArrow(_blocks(percent), "a binary, b binary")
    found = connected_components(stars.unionAll(late))
    by_class = classes.select("cls", "doc_id").join(found.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "doc_id", F.coalesce("root", "cls").alias("root"))
    by_class = written(by_class)
    for used in (member, bucket, held, led, sets, stars, lead, rest):
        forget(used)
    return by_class


def components(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id (rows without words are their own)."""
    sketches = written(sketch(docs, n))
    by_class = _roots(docs, sketches, n, percent)
    low = by_class.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = by_class.join(low, "root").select("cls", "component_id")
    return sketches.select("doc_id", "n_shingles", "cls").join(named, "cls", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _matching(left: DataFrame, right: DataFrame, how: str, md5: str = "md5") -> DataFrame:
    """A semi or anti join by (doc_id, md5), null ids included."""
    i, d = unused(left, "id"), unused(left, "digest")
    r = right.select(F.col("doc_id").alias(i), F.col("md5").alias(d))
    return left.join(r, left["doc_id"].eqNullSafe(r[i]) & (left[md5] == r[d]), how)


def one_of_each(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The documents without near-duplicates: one row of each component stays, with all columns.

    It is a row with the component's smallest id (any id before none; of several texts under
    that id the one with the smallest md5; of equal rows any one).  Rows without words stay.
    Texts are shuffled only if their (id, md5) may be among those that go.
    """
    sketches = written(sketch(docs, n))
    by_class = _roots(docs, sketches, n, percent)
    some = sketches.where("cls IS NOT NULL")
    first = some.groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "md5")).alias("first"))
    best = first.join(by_class.select("cls", "root"), "cls").groupBy("root").agg(F.min("first").alias("first"))
    best = written(best.select("first.doc_id", "first.md5"))
    rows = some.groupBy("doc_id", "md5").agg(F.count(F.lit(1)).alias("n"))
    gone = written(_matching(rows, best, "left_anti").select("doc_id", "md5"))
    twice = written(_matching(rows.where("n > 1"), best, "left_semi").select("doc_id", "md5"))
    digest = unused(docs, "md5")
    unsure, clear = IdFilter(gone.unionAll(twice), "doc_id", "md5").part(docs.withColumn(digest, _md5()), "doc_id", digest)
    unsure = _matching(unsure, gone, "left_anti", digest)
    once = _matching(unsure, twice, "left_semi", digest).dropDuplicates(["doc_id", digest])
    return clear.unionAll(_matching(unsure, twice, "left_anti", digest)).unionAll(once).select(docs.columns)
