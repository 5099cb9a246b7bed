"""Benchmark decontamination: BM25 over test items with block-max WAND.

The test items are the indexed documents, training passages the queries.  A passage is a
window of words, twice the longest item long and half overlapping, so each place of an
item lies whole in some window.  Scores are BM25 weights of the terms that a passage and
an item share, over the item's own full weight: 1 means every term is there.  All items
of at least ``THRESHOLD`` are retrieved:

* passages whose terms cannot reach the threshold in any block of items are set aside, by
  the block maxima of their distinct terms, summed in numpy over ``COARSE`` blocks;
* the others are evaluated item by item with block-max WAND: postings sorted by item, a
  pivot by list maxima, then the maxima of the blocks the pivot falls into.

A retrieved pair is verified on the words: an item's last sentence (or its last quarter
if it has one sentence) is the answer, what stands before it the question; of the
distinct five-word shingles of each at least ``OVERLAP`` must stand in the passage (shorter
shingles of a part under ``SHORT`` words; the whole sequence of a still shorter one).

The index is broadcast while the benchmark's texts take at most ``INDEX_BYTES``; a larger one
is dealt by hash over parts that are searched one after the other: a part's hits are written
to the shared folder, and its index is given up, before the next part is built.  Every part
reads the documents once, and has the number of items, document frequencies, mean length and
window of the whole benchmark, so that the hits are the same in any number of parts, memory
stays that of one part and no item is dropped.

Null and empty texts have no passages; very long ones are cut into passages whole; equal
scores are all kept, as every item above the threshold is; items without words match nothing; items without id
are found like others (their item_id is null); repeated documents and items give repeated
hits; an empty benchmark or document table gives no hits.  Only doc_id, item_id and text are
read, so other columns may have any name.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commlens.llm.common import IdFilter, keep_rows, map_batches, mix64, slices, texts, unused, written
from commlens.llm.words import numbered_words

THRESHOLD, OVERLAP, SHINGLE = 0.6, 0.8, 5
#: A question or answer of fewer than SHORT words has shingles of two words, one of fewer than
#: VERY_SHORT beside a longer part single words; else one edit would take most of them.
SHORT, VERY_SHORT = 30, 12
#: BM25's saturation and length parameters.
K1, B = 1.2, 0.75
#: Items of a WAND block, and blocks of the numpy bound.
BLOCK, COARSE = 16, 64
INDEX_BYTES = 16 << 20
_SPACE = bytes(c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_MARKS = regex.compile("[ -¿ -⁯　-〿]")


def _spaced(text: str) -> bytes:
    """In lower case, with spaces for all but letters and digits."""
    low = text.lower()
    if not low.isascii():
        low = _MARKS.sub(" ", low)
    return low.encode("utf-8", "surrogatepass").translate(_SPACE)


def words_of(text: str) -> list[bytes]:
    """Lower-case words of letters and digits."""
    return _spaced(text).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The words of an item's question and answer."""
    parts = [w for p in regex.split(r"(?<=[.!?])\s+", text) if (w := words_of(p))]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = len(words) - max(1, len(words) // 4)
    return words[:cut], words[cut:]


def shingle_sizes(question: int, answer: int) -> tuple[int, int]:
    """Words of a shingle of either part, by their numbers of words."""

    def of(n: int, other: int) -> int:
        return min(n, SHINGLE if n >= SHORT else 2 if n >= VERY_SHORT or other < VERY_SHORT else 1)

    return of(question, answer), of(answer, question)


@dataclass
class Statistics:
    """What BM25 takes from the whole benchmark, whatever part of it an index holds."""

    n: int
    mean: float
    longest: int
    df: dict[bytes, int]

    @classmethod
    def of(cls, texts: list[str]) -> Statistics:
        split = [words_of(t) for t in texts]
        return cls(len(split), max(1.0, sum(map(len, split)) / max(1, len(split))), max(map(len, split), default=0), dict(Counter(w for s in split for w in set(s))))


def _shingles(ids: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of every run of n term numbers."""
    m = len(ids) - n + 1
    if n < 1 or m < 1:
        return np.zeros(0, np.uint64)
    h = np.full(m, n, dtype=np.uint64)
    for k in range(n):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + m].astype(np.uint64))
    return np.unique(h)


def _flat(arrays: list[np.ndarray], kind) -> tuple[np.ndarray, np.ndarray]:
    """Arrays end to end, and where each begins (one more at the end)."""
    return np.concatenate([np.zeros(0, kind), *arrays]), np.cumsum([0, *map(len, arrays)])


class Index:
    """The inverted index of test items, in flat arrays.

    Postings lie term by term, sorted by item; so do the maxima of their blocks.
    """

    def __init__(self, items: list[tuple[int | None, str | None]], statistics: Statistics | None = None):
        rows = sorted(((i, t or "") for i, t in items), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        stats = statistics or Statistics.of([t for _, t in rows])
        self.ids = [i for i, _ in rows]
        halves = [question_and_answer(t) for _, t in rows]
        split = [words_of(t) for _, t in rows]
        self.longest, self.window = stats.longest, max(64, 2 * stats.longest)
        self.term = {w: k for k, w in enumerate(sorted({w for s in split for w in s}))}
        numbers = [np.array([self.term[w] for w in s], dtype=np.int64) for s in split]
        parts = [[np.array([self.term[w] for w in p], dtype=np.int64) for p in h] for h in halves]
        self.sizes = [shingle_sizes(len(q), len(a)) for q, a in parts]
        self.shingles, self.shingle_at = _flat([_shingles(p, n) for h, sizes in zip(parts, self.sizes, strict=True) for p, n in zip(h, sizes, strict=True)], np.uint64)
        words, _ = _flat(numbers, np.int64)
        length = np.array([len(x) for x in numbers], dtype=np.int64)
        pair, tf = np.unique(words << 32 | np.repeat(np.arange(len(rows)), length), return_counts=True)  # by term, then item
        term, item = pair >> 32, pair & 0xFFFFFFFF
        idf = np.array([math.log(1 + (stats.n - x + 0.5) / (x + 0.5)) for x in (stats.df[w] for w in self.term)])
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / stats.mean)) if len(term) else np.zeros(0)
        share = weight / np.maximum(np.bincount(item, weights=weight, minlength=len(rows))[item], 1e-300)
        self.item, self.share = item.astype(np.int32), share
        self.at = np.searchsorted(term, np.arange(len(self.term) + 1))
        self.list_max = np.maximum.reduceat(share, self.at[:-1]) if len(term) else np.zeros(0)
        new = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(item // BLOCK, prepend=-1) != 0))
        self.block = (item[new] // BLOCK).astype(np.int32)
        self.block_max = np.maximum.reduceat(share, new) if len(new) else np.zeros(0)
        self.block_at = np.searchsorted(term[new], np.arange(len(self.term) + 1))
        self.coarse = np.zeros((len(self.term) + 1, COARSE), dtype=np.float32)
        np.maximum.at(self.coarse, (term, item // max(1, -(-len(rows) // COARSE))), np.nextafter(share.astype(np.float32), np.float32(2)))

    @cached_property
    def _views(self) -> tuple:
        """The arrays as views that give plain numbers."""
        return tuple(memoryview(x) for x in (self.item, self.share, self.at, self.list_max, self.block, self.block_max, self.block_at))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_views"}

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """(item number, score) of all items of at least the threshold: block-max WAND."""
        item_of, share, at, list_max, block_no, block_max, block_at = self._views
        threshold -= 1e-6

        def top(t: int, block: int) -> float:
            k = bisect_left(block_no, block, block_at[t], block_at[t + 1])
            return block_max[k] if k < block_at[t + 1] and block_no[k] == block else 0.0

        cursors = [[item_of[at[t]], at[t], t] for t in terms]
        out = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += list_max[c[2]]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                return out
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK
            if sum(top(c[2], block) for c in cursors[: pivot + 1]) < threshold:
                # nothing up to the end of the block, or to the next list's item, can reach it
                to = (block + 1) * BLOCK
                if pivot + 1 < len(cursors):
                    to = min(to, cursors[pivot + 1][0])
                to = max(to, item + 1)
            elif cursors[0][0] == item:
                score = sum(share[c[1]] for c in cursors[: pivot + 1])
                if score >= threshold:
                    out.append((item, score))
                to = item + 1
            else:
                to = item
            for c in cursors[: pivot + 1]:
                end = at[c[2] + 1]
                c[1] = bisect_left(item_of, to, c[1], end)
                c[0] = item_of[c[1]] if c[1] < end else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return out

    def overlaps(self, k: int, ids: np.ndarray, have: dict[int, np.ndarray]) -> tuple[float, float]:
        """Shares of the question's and the answer's shingles that stand in a passage of these term numbers.

        ``have`` holds the passage's shingles by size, as far as they were needed.
        """
        shares = []
        for j, n in enumerate(self.sizes[k]):
            if n not in have:
                have[n] = _shingles(ids, n)
            part = self.shingles[self.shingle_at[2 * k + j] : self.shingle_at[2 * k + j + 1]]
            shares.append(float(np.isin(part, have[n], assume_unique=True).mean()) if len(part) else 1.0)
        return shares[0], shares[1]

    def hits(self, docs: list[str], threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[list[tuple[int, float, float, float]]]:
        """For each text its verified items: (item id, score, question and answer overlap)."""
        out: list[list[tuple[int, float, float, float]]] = [[] for _ in docs]
        if not self.longest:
            return out
        get, none = self.term.get, len(self.term)
        cut = [list(slices(d)) for d in docs]
        distinct, number, n = numbered_words([_spaced(p) for parts in cut for p in parts])
        sizes = np.zeros(len(docs), dtype=np.int64)
        np.add.at(sizes, np.repeat(np.arange(len(docs)), [len(parts) for parts in cut]), n)
        ids = np.array([get(w, none) for w in distinct.cast(pa.large_binary()).to_pylist()], dtype=np.int32)[number]
        starts = np.cumsum(sizes) - sizes
        step = self.window // 2
        # every word is in the half-window it stands in; a passage is two neighbouring ones
        halves = np.maximum(1, -(-sizes // step)) * (sizes > 0)
        first = np.cumsum(halves) - halves
        doc = np.repeat(np.arange(len(docs)), halves)
        place = np.arange(len(ids)) - np.repeat(starts, sizes)
        half = np.repeat(first, sizes) + place // step
        known = ids < none
        pair = np.unique((half[known].astype(np.int64) << 32) | ids[known])
        h, t = pair >> 32, pair & 0xFFFFFFFF
        bound = np.zeros((len(doc) + 1, COARSE), dtype=np.float32)
        if len(h):
            edges = np.flatnonzero(np.diff(h, prepend=-1))
            for a in range(0, len(edges), 4096):
                e = edges[a : a + 4096]
                end = edges[a + 4096] if a + 4096 < len(edges) else len(h)
                bound[h[e]] = np.add.reduceat(self.coarse[t[e[0] : end]], e - e[0], axis=0)
        follows = np.zeros(len(doc), dtype=bool)
        follows[:-1] = doc[1:] == doc[:-1]
        total = bound[:-1] + np.where(follows[:, None], bound[1:], 0)
        seen: dict[tuple[int, int], tuple[int, float, float, float]] = {}
        for p in np.flatnonzero(total.max(axis=1, initial=0) >= threshold - 1e-4).tolist():
            d = int(doc[p])
            begin = (p - int(first[d])) * step
            at = int(starts[d]) + begin
            passage = ids[at : at + min(2 * step, int(sizes[d]) - begin)]
            terms, have = np.unique(passage), {}
            for k, score in self.search(terms[terms < none].tolist(), threshold):
                q, a = self.overlaps(k, passage, have)
                if q >= overlap and a >= overlap and (old := seen.get((d, k), (0, 0.0, 0.0, 0.0)))[1] <= score:
                    seen[d, k] = max(old, (self.ids[k], score, q, a), key=lambda x: x[1:])
        for (d, _), x in sorted(seen.items()):
            out[d].append(x)
        return out


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))


def part_count(benchmark: DataFrame, most: int | None = None) -> int:
    """In how many parts of about ``most`` bytes of text a benchmark is indexed."""
    size = _items(benchmark).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(1, -(-size // (most or INDEX_BYTES)))


def indexes(benchmark: DataFrame, most: int | None = None) -> Iterator[Index]:
    """The index, in parts of at most about ``most`` bytes of text, all with the statistics of the whole."""
    items, parts = _items(benchmark), part_count(benchmark, most)
    if parts == 1:
        yield Index([tuple(r) for r in items.collect()])  # at most ``most`` bytes
        return

    def terms(b: pa.RecordBatch) -> pa.RecordBatch:
        split = [words_of(t) for t in texts(b)]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([len(x) for x in split], pa.int64()), pa.array([sorted(set(x)) for x in split], pa.list_(pa.binary()))], ["part", "item_id", "text", "n", "terms"])

    dealt = items.select(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).alias("part"), "item_id", "text")
    dealt = written(map_batches(dealt, terms, "part long, item_id long, text string, n long, terms array<binary>"))
    n, mean, longest = dealt.agg(F.count(F.lit(1)), F.avg("n"), F.max("n")).first()
    df = written(dealt.select(F.explode("terms").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df")))
    for k in range(parts):
        mine = dealt.where(F.col("part") == k)
        known = df.join(mine.select(F.explode("terms").alias("w")).distinct(), "w", "left_semi").collect()  # the words of one part
        yield Index([tuple(r) for r in mine.select("item_id", "text").collect()], Statistics(n, max(1.0, mean), longest, {bytes(r.w): r.df for r in known}))


def _searched(benchmark: DataFrame, search: Callable[[Broadcast], DataFrame]) -> DataFrame:
    """The union of ``search`` over all parts of the index; of several parts, one after the other."""
    several, found = part_count(benchmark) > 1, []
    for index in indexes(benchmark):
        shared = benchmark.sparkSession.sparkContext.broadcast(index)
        if not several:
            return search(shared)
        found.append(written(search(shared)))
        shared.destroy()
    return reduce(DataFrame.unionAll, found)


def find_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item found in it."""

    def search(shared: Broadcast) -> DataFrame:
        def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
            ids = b.column(0).to_pylist()
            rows = [(i, *x) for i, found in zip(ids, shared.value.hits(texts(b)), strict=True) for x in found]
            if not rows:
                return None
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")

    return _searched(benchmark, search)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no item is found, with all their columns; those without text stay.

    With an index of several parts, the digests of the texts in which any part finds an item are
    collected part by part, and documents with such a text go in one more pass.
    """
    if part_count(benchmark) == 1:
        shared = docs.sparkSession.sparkContext.broadcast(next(indexes(benchmark)))
        return keep_rows(docs, lambda t: np.array([not x for x in shared.value.hits(t)], dtype=bool))
    key = F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("t")

    def search(shared: Broadcast) -> DataFrame:
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([b.column(0).filter(pa.array([bool(x) for x in shared.value.hits(texts(b))], pa.bool_()))], ["t"])

        return map_batches(docs.select(key, "text"), run, "t binary").distinct()

    gone = written(_searched(benchmark, search).distinct())
    t = unused(docs, "t")
    unsure, clear = IdFilter(gone, "t").part(docs.withColumn(t, key), t)
    return clear.unionAll(unsure.join(gone.withColumnRenamed("t", t), t, "left_anti").select(clear.columns)).select(docs.columns)
