"""Maximal periodic runs of words, by the tandem repeats of Stoye and Gusfield's suffix tree.

A run is a stretch of words with smallest period q, at least ``min_length`` words and
``min_exponent`` periods long, that no neighbouring word extends with that period.

The suffix tree is held as a suffix array (prefix doubling, all texts of a batch at once,
with the text as part of the first key, so that no node has leaves of two texts) and the
intervals of its longest common prefixes, one for each inner node.  For every node v of
depth D, all leaves but those of its largest child (the smaller halves, n log n in all) are
asked whether the leaf D words on, or D words back, is below v too, by another child: that is a
branching tandem repeat, whose period breaks off right behind it.  Rotating it to the left
as long as words D apart agree gives the maximal stretch of that period; stretches of a
multiple of a period that is known to end there are merged into the known one.

A run of L words and period q repeats a window of L - q words, q words on.  So only texts
that repeat some window of ``min_length`` - ``min_length`` / ``min_exponent`` words have
runs, and trees are built of those alone.

Words stand between ASCII white space.  Null and empty texts have no run and an empty
collapsed text; rows with null or repeated ids are rows like others; an empty table gives
an empty table; only doc_id and text are read, so other columns may have any name.  A
task holds one batch of texts, or one longer text (about 250 bytes a word); no text is cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from commlens.llm.common import grouped, map_batches, mix64, ragged, slices, texts
from commlens.llm.words import numbered_words

MIN_LENGTH, MIN_EXPONENT = 24, 3
#: Characters of the texts whose words are numbered, or whose trees are built, at once.
GROUP = 1 << 20
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def repeats_window(words: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    """The owners (texts) of which some window of ``size`` words stands twice (by hash: now and then one too many)."""
    m = len(words) - size + 1
    if m < 2:
        return np.zeros(0, dtype=owner.dtype)
    h = mix64(words.astype(np.uint64) + np.uint64(1))
    covered, out = 1, h
    while covered < size:  # windows of twice the size, or overlapping ones, from smaller ones
        step = min(covered, size - covered)
        out = mix64(out[: len(out) - step] * np.uint64(0x9E3779B97F4A7C15) + out[step:])
        covered += step
    whole = owner[:m] == owner[size - 1 :]
    key = mix64(out[whole] ^ mix64(owner[:m][whole].astype(np.uint64)))
    own = owner[:m][whole]
    order = np.argsort(key)
    twice = key[order[1:]] == key[order[:-1]]
    return np.unique(own[order[1:][twice]])


def suffix_ranks(first: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... elements, until they are distinct.

    Equal ranks at level k mean equal first 2**k elements.  The elements are dense from 0,
    and the last of each text is unlike any other, so no comparison runs past a text.
    """
    n = len(first)
    order = np.argsort(first, kind="stable")
    sorted_ = first[order]
    new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    rank = np.empty(n + 1, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[n] = -1
    levels = [rank]
    h = 1
    # suffixes that share their rank with a neighbour, in the order of their ranks
    open_ = order[~new | np.concatenate([~new[1:], [False]])]
    while len(open_):
        base = rank[open_]
        key = rank[np.minimum(open_ + h, n)]
        by = np.lexsort((key, base))
        open_, base, key = open_[by], base[by], key[by]
        group = np.concatenate([[True], base[1:] != base[:-1]])
        new = group | np.concatenate([[True], key[1:] != key[:-1]])
        at = np.arange(len(open_))
        rank = rank.copy()
        rank[open_] = base + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        levels.append(rank)
        open_ = open_[~new | np.concatenate([~new[1:], [False]])]
        h *= 2
    return levels


def common_prefixes(levels: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of each suffix in ``order`` and the one before it (0 for the first)."""
    out = np.zeros(len(order), dtype=np.int64)
    at = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    a, b, n = order[at], order[at - 1], np.zeros(len(at), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        n += (levels[k][a + n] == levels[k][b + n]).astype(np.int64) << k
    out[at] = n
    return out


def inner_nodes(lcp: np.ndarray) -> tuple[np.ndarray, ...]:
    """depth, first and last leaf, first and last leaf of the largest child, of every inner node but the root."""
    found: list[tuple[int, int, int, int, int]] = []
    depths, firsts, big_first, big_last = [0], [0], [0], [0]  # the nodes on the way to the current leaf

    def close(last: int) -> tuple[int, int]:
        """Pop the deepest node; its interval."""
        first = firsts.pop()
        found.append((depths.pop(), first, last, big_first.pop(), big_last.pop()))
        return first, last

    # leaves between which nothing is shared but the root need no visit
    some = np.flatnonzero(lcp)
    heads = np.unique(np.concatenate([some, some + 1]))
    for k, d in zip(heads.tolist(), np.append(lcp, 0)[heads].tolist(), strict=True):
        child = (k - 1, k - 1)
        while depths[-1] > d:
            if child[1] - child[0] > big_last[-1] - big_first[-1]:
                big_first[-1], big_last[-1] = child
            child = close(k - 1)
        if d == 0:
            continue
        if depths[-1] < d:
            depths.append(d)
            firsts.append(child[0])
            big_first.append(child[0])
            big_last.append(child[1])
        elif child[1] - child[0] > big_last[-1] - big_first[-1]:
            big_first[-1], big_last[-1] = child
    return tuple(np.array(found, dtype=np.int64).reshape(-1, 5).T)


def branching_repeats(elements: np.ndarray, longest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """start and period of every branching tandem repeat whose period is at most ``longest`` at its start."""
    levels = suffix_ranks(elements)
    n = len(elements)
    rank = levels[-1][:n]
    order = np.empty(n, dtype=np.int64)
    order[rank] = np.arange(n)
    depth, first, last, big_first, big_last = inner_nodes(common_prefixes(levels, order))
    keep = depth <= longest[order[first]]
    depth, first, last, big_first, big_last = (x[keep] for x in (depth, first, last, big_first, big_last))
    starts, periods = [], []
    nodes = np.arange(len(depth))
    sizes = np.concatenate([big_first - first, last - big_last])  # leaves before and behind the largest child
    begin, node = np.concatenate([first, big_last + 1]), np.concatenate([nodes, nodes])
    ends = np.cumsum(sizes)
    done = 0
    while done < len(sizes):  # about GROUP leaves at once
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + GROUP, "right")))
        leaf = order[ragged(begin[done:upto], sizes[done:upto])]
        v = np.repeat(node[done:upto], sizes[done:upto])
        d = depth[v]
        for start in (leaf, leaf - d):  # the leaf is the first or the second half's start
            ok = (start >= 0) & (start + 2 * d < n)
            s, p, w = start[ok], d[ok], v[ok]
            other = rank[np.where(leaf[ok] == s, s + p, s)]
            ok = (other >= first[w]) & (other <= last[w])
            s, p = s[ok], p[ok]
            ok = elements[s + p] != elements[s + 2 * p]
            starts.append(s[ok])
            periods.append(p[ok])
        done = upto
    start, period = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (starts, periods))
    both = np.unique(np.stack([period, start], axis=1), axis=0)
    return both[:, 1], both[:, 0]


def maximal_runs(words: np.ndarray, counts: np.ndarray, min_length: int, min_exponent: int) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of each text's runs, by start, then period; texts end to end."""
    texts_ = np.repeat(np.arange(len(counts)), counts)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    n = offsets[-1] + len(counts)
    # a text's words, then its end: numbers that stand in no other text
    place = np.arange(offsets[-1]) + texts_
    keys = np.empty(n, dtype=np.int64)
    width = int(words.max(initial=0)) + 2
    keys[place] = texts_ * width + words
    keys[offsets[1:] + np.arange(len(counts))] = np.arange(len(counts)) * width + width - 1
    elements = np.unique(keys, return_inverse=True)[1]
    owner = np.empty(n, dtype=np.int64)
    owner[place] = texts_
    owner[offsets[1:] + np.arange(len(counts))] = np.arange(len(counts))
    begin = offsets[:-1] + np.arange(len(counts))
    out: list[list[tuple[int, int, int]]] = [[] for _ in counts]
    ending: dict[int, list[tuple[int, int]]] = {}
    values = elements.tolist()
    for s, p in zip(*(x.tolist() for x in branching_repeats(elements, (counts // min_exponent)[owner])), strict=True):
        end, text = s + 2 * p, int(owner[s])
        known = ending.setdefault(end, [])
        if any(p % q == 0 and left <= s for left, q in known):
            continue  # a multiple of a period found before
        low = int(begin[text])
        left = s
        while left > low and values[left - 1] == values[left - 1 + p]:  # rotate
            left -= 1
        known.append((left, p))
        if end - left >= max(min_length, min_exponent * p):
            out[text].append((left - low, end - left, p))
    for x in out:
        x.sort(key=lambda r: (r[0], r[2]))
    return out


def text_runs(docs: list[str], min_length: int, min_exponent: int) -> list[list[tuple[int, int, int]]]:
    """The runs of every text."""
    window = min_length - min_length // min_exponent
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    for a, z in grouped(docs, GROUP):
        parts = docs[a:z] if z - a > 1 else list(slices(docs[a]))
        _, words, counts = numbered_words(parts)
        if z - a == 1:
            counts = np.array([counts.sum()])
        owner = np.repeat(np.arange(z - a), counts)
        some = repeats_window(words, owner, window)
        if len(some):
            inside = np.isin(owner, some)
            for k, found in zip(some.tolist(), maximal_runs(words[inside], counts[some], min_length, min_exponent), strict=True):
                out[a + k] = found
    return out


def collapse(text: str, runs: list[tuple[int, int, int]]) -> str:
    """The text's words, joined by a space, without those behind the first period of a run."""
    words = text.encode("utf-8", "surrogatepass").split()  # at ASCII white space
    if runs:
        gone = np.zeros(len(words) + 1, dtype=np.int64)
        for start, length, period in runs:
            gone[start + period] += 1
            gone[start + length] -= 1
        words = [w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g]
    return b" ".join(words).decode("utf-8", "surrogatepass")


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """doc_id, runs (start, length, period; by start, then period), collapsed (the text without repeated periods)."""
    if min_length < 2 * min_exponent or min_exponent < 2:
        raise ValueError("a run has two periods and two words a period at least")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        own = texts(b)
        found = text_runs(own, min_length, min_exponent)
        rows = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in x] for x in found], RUNS)
        return pa.RecordBatch.from_arrays([b.column(0), rows, pa.array(map(collapse, own, found), pa.string())], ["doc_id", "runs", "collapsed"])

    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string")
