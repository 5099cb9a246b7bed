"""Language identification with bit-sliced n-gram Bloom filters.

Training: n-gram counts by language over all training texts.  A language's filter holds
every n-gram that occurs in its texts and is at least ``max_ratio`` times as frequent
there as in the language where it is most frequent.

The filters of all languages share their hash functions and are stored bit-sliced: slot
s holds a bitmask of the languages whose bit s is set; the AND of an n-gram's slots is
the set of languages whose filters contain it.  For each language the hits of a text's
n-grams are counted and corrected for the filter's false-positive rate f:
(hits - n f) / (1 - f).  The highest count decides; ties go to the first name.

The filters grow with the n-grams, 10 to 20 slots for each of the language that has the
most.  Up to 2**``MOST_LOG2`` slots (16 MB with 8 languages, 128 MB with 64) they are one
part, which is broadcast.  Beyond, the n-grams are dealt by hash over several parts of that
size: the documents are read once for each part, one after the other, and the corrected
counts of all parts are summed up by text, so that the false-positive rate and the memory
of a task are the same at every size.  Slots are set on the executors; the driver gets one
row a slot in use of one part.

Texts that are null or hold no letter get ``und`` and score 0.  Without any training
text every prediction is ``und``.  Up to 64 languages; more raise an error.  Repeated rows
count as often as they occur; only doc_id, text and lang are read, so other columns may
have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commlens.llm.common import SLICE, IdFilter, code_points, forget, grouped, keep_rows, map_batches, mix64, texts, unused, window_hashes, written
from commlens.operators.ranks import medians

NGRAM, HASHES, SLOTS_EACH, MOST_LOG2 = 4, 3, 10, 24
MAX_RATIO = 0.2
_OTHER = regex.compile(r"[^\p{L}\p{M}']+")
_LETTER = regex.compile(r"\p{L}")


def _normal(text: str) -> str:
    """Lower-case letters, one space between words and at both ends."""
    return " " + _OTHER.sub(" ", text.lower()).strip() + " "


def _grams(docs: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams, and the text each belongs to; none spans two texts."""
    codes, starts = code_points(docs)
    h = window_hashes(codes, n)
    owner = np.repeat(np.arange(len(docs), dtype=np.int32), np.diff(starts))
    if len(h) == 0:
        return h, owner[:0]
    same = owner[: len(h)] == owner[n - 1 :]
    return h[same], owner[: len(h)][same]


def _parts(docs: list[str], n: int) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Normalised texts in groups of bounded size; long ones in parts that share n - 1 characters."""
    for a, b in grouped(docs):
        clean = [_normal(d) for d in docs[a:b]]
        if b - a > 1:
            yield np.arange(a, b), clean
            continue
        for at in range(0, max(1, len(clean[0]) - n + 1), SLICE):
            yield np.array([a]), [clean[0][at : at + SLICE + n - 1]]


def _places(h: np.ndarray, log2: int) -> list[np.ndarray]:
    """The slots of each n-gram."""
    low = np.uint64((1 << log2) - 1)
    a, b = h & low, (h >> np.uint64(log2)) | np.uint64(1)
    return [((a + np.uint64(i) * b) & low).astype(np.int64) for i in range(HASHES)]


def _part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """The part that holds each n-gram, by bits that are no slot's."""
    return (mix64(h) >> np.uint64(32)) % np.uint64(parts)


class Filters:
    """The bit-sliced filters, or one part of them."""

    def __init__(self, languages: list[str], log2: int, at: np.ndarray, mask: np.ndarray, n: int = NGRAM, part: int = 0, parts: int = 1):
        self.languages, self.log2, self.n, self.part, self.parts = languages, log2, n, part, parts
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if len(languages) <= 8 * np.dtype(k).itemsize)
        self.slots = np.zeros(1 << log2, dtype=kind)
        self.slots[at] = mask.astype(np.int64).view(np.uint64).astype(kind)
        fill = [float(np.count_nonzero(self.slots & kind(1 << k))) / len(self.slots) for k in range(len(languages))]
        self.false_rate = np.array(fill) ** HASHES

    def hits(self, docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """This part's n-grams of each text, and how many of them each language's filter holds."""
        n = np.zeros(len(docs))
        hits = np.zeros((len(docs), max(1, len(self.languages))))
        for index, part in _parts(docs, self.n):
            h, owner = _grams(part, self.n)
            if self.parts > 1:
                own = _part_of(h, self.parts) == self.part
                h, owner = h[own], owner[own]
            n[index] += np.bincount(owner, minlength=len(part))
            mask = np.full(len(h), ~self.slots.dtype.type(0))
            for at in _places(h, self.log2):
                mask &= self.slots[at]
            for k in range(len(self.languages)):
                hits[index, k] += np.bincount(owner[(mask & self.slots.dtype.type(1 << k)) != 0], minlength=len(part))
        return n, hits

    def corrected(self, docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of each text, and the hits of each language without those to be expected falsely."""
        n, hits = self.hits(docs)
        if self.languages:
            hits = (hits - n[:, None] * self.false_rate) / (1 - np.minimum(self.false_rate, 0.999))
        return n, hits

    def lettered(self, docs: list[str]) -> np.ndarray:
        """Whether a language is to be named."""
        return np.array([bool(self.languages) and bool(_LETTER.search(d)) for d in docs], dtype=bool)

    def measure(self, docs: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language of each text, score (its share of all corrected counts) and coverage (its share of the text's n-grams)."""
        return self.decide(*self.corrected(docs), self.lettered(docs))

    def decide(self, n: np.ndarray, hits: np.ndarray, known: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The same from the figures of all parts together."""
        hits = np.maximum(0, hits)
        best, total = hits.argmax(axis=1), hits.sum(axis=1)
        most = hits[np.arange(len(n)), best]
        lang = [self.languages[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)]
        return lang, np.where(known & (total > 0), most / np.maximum(total, 1e-12), 0.0), np.where(known, np.where(n > 0, most / np.maximum(n, 1), 1.0), 0.0)

    def predict(self, docs: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        return self.measure(docs)[:2]


class Parts:
    """Filters in several parts: each is built from the written table of n-grams when it is asked for."""

    def __init__(self, languages: list[str], masks: DataFrame, parts: int, log2: int, n: int):
        self.languages, self.masks, self.parts, self.log2, self.n = languages, masks, parts, log2, n

    def each(self) -> Iterator[Filters]:
        for k in range(self.parts):
            yield _part(self.masks, self.languages, self.log2, self.n, k, self.parts)

    def measured(self, docs: DataFrame) -> DataFrame:
        """t (digest of the text), lang, score, coverage of every distinct text of ``docs``."""
        languages, spark = self.languages, docs.sparkSession
        names = [f"h{k}" for k in range(len(languages))]
        kind = "t binary, known boolean, n double, " + ", ".join(f"{c} double" for c in names)
        tables = []
        for part in self.each():
            shared = spark.sparkContext.broadcast(part)

            def run(b: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
                own = texts(b)
                n, hits = shared.value.corrected(own)
                known = pa.array(shared.value.lettered(own))
                return pa.RecordBatch.from_arrays([b.column(0), known, pa.array(n), *map(pa.array, hits.T)], ["t", "known", "n", *names])

            rows = map_batches(docs.select(text_key(), "text"), run, kind)
            tables.append(written(rows.groupBy("t").agg(*[F.first(c).alias(c) for c in ("known", "n", *names)])))
            shared.destroy()
        whole = reduce(DataFrame.unionAll, tables).groupBy("t").agg(F.first("known").alias("known"), *[F.sum(c).alias(c) for c in ("n", *names)])
        judge = Filters(languages, 1, np.zeros(0, np.int64), np.zeros(0, np.int64))

        def decide(b: pa.RecordBatch) -> pa.RecordBatch:
            known, n, *hits = (c.to_numpy(zero_copy_only=False) for c in b.columns[1:])
            lang, score, coverage = judge.decide(n, np.column_stack(hits), known)
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(coverage)], ["t", "lang", "score", "coverage"])

        return written(map_batches(whole, decide, "t binary, lang string, score double, coverage double"))


def text_key() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("t")


def train(docs: DataFrame, n: int = NGRAM, max_ratio: float = MAX_RATIO, most_log2: int | None = None) -> Filters | Parts:
    """Fit on all rows of ``docs`` (text, lang) with a language."""

    def count(b: pa.RecordBatch) -> pa.RecordBatch | None:
        names, code = np.unique(np.array(b.column(1).to_pylist(), dtype=object).astype(str), return_inverse=True)
        grams: list[list[np.ndarray]] = [[] for _ in names]
        for index, part in _parts(texts(b), n):
            h, owner = _grams(part, n)
            lang = code[index][owner]
            for k in range(len(names)):
                grams[k].append(h[lang == k])
        out = []
        for name, x in zip(names, grams, strict=True):
            g, c = np.unique(np.concatenate(x), return_counts=True)
            out.append(pa.RecordBatch.from_arrays([pa.array([str(name)] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(c.astype(np.int64))], ["lang", "gram", "n"]))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if any(len(x) for x in out) else None

    spark = docs.sparkSession
    counts = map_batches(docs.select("text", "lang").where("lang IS NOT NULL AND text IS NOT NULL"), count, "lang string, gram long, n long")
    totals = written(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    sizes = totals.groupBy("lang").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("grams")).limit(65).collect()  # a row a language
    if len(sizes) > 64:
        raise ValueError("more than 64 languages")
    languages = sorted(r.lang for r in sizes)
    most_log2 = most_log2 or MOST_LOG2
    log2 = max(10, (SLOTS_EACH * max((r.grams for r in sizes), default=0)).bit_length())
    parts, log2 = 1 << max(0, log2 - most_log2), min(log2, most_log2)
    if not languages:
        return Filters([], log2, np.zeros(0, np.int64), np.zeros(0, np.int64), n)
    bit = {x: (1 << k) - (1 << 64 if k == 63 else 0) for k, x in enumerate(languages)}
    table = spark.createDataFrame([(r.lang, bit[r.lang], r.total) for r in sizes], "lang string, bit long, total long")
    share = totals.join(F.broadcast(table), "lang").select("gram", "bit", (F.col("n") / F.col("total")).alias("share"))
    met = share.groupBy("gram").agg(F.max("share").alias("top"), F.collect_list(F.struct("bit", "share")).alias("x"))  # at most a row a language
    own = F.filter("x", lambda e: e["share"] >= max_ratio * F.col("top"))
    masks = met.select("gram", F.aggregate(own, F.lit(0).cast("long"), lambda a, e: a.bitwiseOR(e["bit"])).alias("mask"))

    if parts > 1:
        held = Parts(languages, written(masks), parts, log2, n)
    else:
        held = _part(masks, languages, log2, n)
    forget(totals)
    return held


def _part(masks: DataFrame, languages: list[str], log2: int, n: int, part: int = 0, parts: int = 1) -> Filters:
    """The filters of one part of the n-grams."""

    def place(b: pa.RecordBatch) -> pa.RecordBatch:
        h, mask = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
        if parts > 1:
            own = _part_of(h, parts) == part
            h, mask = h[own], mask[own]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(_places(h, log2))), pa.array(np.tile(mask, HASHES))], ["at", "mask"])

    slots = map_batches(masks, place, "at long, mask long").groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()  # at most 2**log2 rows
    return Filters(languages, log2, slots.column("at").to_numpy(), slots.column("mask").to_numpy(), n, part, parts)


def predict(docs: DataFrame, filters: Filters | Parts) -> DataFrame:
    """doc_id, lang_pred, score."""
    if isinstance(filters, Parts):
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key())
        return rows.join(filters.measured(docs), "t").select("doc_id", F.col("lang").alias("lang_pred"), "score")
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # at most 2**MOST_LOG2 slots

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        lang, score = shared.value.predict(texts(b))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double")


def typical_coverage(docs: DataFrame, filters: Filters | Parts) -> float:
    """The median coverage of all labelled texts, repeated ones and those without an id too.

    It is exact: the coverages are written, counted by value, and the middle one is found by
    position, without a task that holds all of them.
    """
    some = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("text")
    if isinstance(filters, Parts):
        rows = written(some.select(text_key()).join(filters.measured(some), "t").select("coverage"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(filters)

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(shared.value.measure(texts(b))[2])], ["coverage"])

        rows = written(map_batches(some, run, "coverage double"))
    middle = medians(rows, [], "coverage", "middle").first()[0]
    forget(rows)
    return middle or 0.0


def keep_covered(docs: DataFrame, filters: Filters | Parts, share: float) -> DataFrame:
    """Rows whose text is in one of the languages, with all their columns.

    The language's n-grams must cover the text to ``share`` of what they cover of a typical
    labelled text.  This cut is fitted, and does not depend on the number of languages as a
    share of all hits would.  Texts without a letter go; those with letters but too short for
    an n-gram stay; without any language to learn from, all with a letter stay.
    """
    if not filters.languages:
        return keep_rows(docs, lambda t: [bool(_LETTER.search(d)) for d in t])
    least = share * typical_coverage(docs, filters)
    if isinstance(filters, Parts):
        gone = written(filters.measured(docs).where((F.col("coverage") < least) | (F.col("lang") == "und")).select("t"))
        t = unused(docs, "t")
        unsure, clear = IdFilter(gone, "t").part(docs.withColumn(t, text_key()), t)
        return clear.unionAll(unsure.join(gone.withColumnRenamed("t", t), t, "left_anti").select(clear.columns)).select(docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def keep(t: list[str]) -> np.ndarray:
        lang, _, coverage = shared.value.measure(t)
        return (coverage >= least) & np.array([x != "und" for x in lang], dtype=bool)

    return keep_rows(docs, keep)
