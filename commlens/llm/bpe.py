"""Byte-level BPE encoding and decoding on length-bucketed numpy matrices.

Texts are cut into the pretokenizer's matches; every distinct match is encoded once.
Matches that are not in the vocabulary themselves go, by length, into padded
matrices of byte ids.  Each round every row merges its leftmost pair of minimum
rank; ranks come from an open-addressing hash table; each merge shortens the row by
one and the matrix is compacted.  Rows without a mergeable pair leave.

Very long matches (over ``LONG_BYTES``) would make wide matrices, so they are merged
one by one with a heap; the merge order is the same.

Nulls encode as empty texts (no ids); repeated rows give repeated results; an empty
table gives an empty table; only doc_id and text are read, so other columns may have any
name.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from commlens.llm.common import map_batches, ragged, texts

#: Above this many bytes a match is merged with a heap, not in a matrix.
LONG_BYTES = 512
#: Rows of one matrix at most (memory: rows x bucket width x 12 bytes).
MATRIX_CELLS = 1 << 21
#: Chunks (and matches) a worker remembers in each of two generations.
MEMO_CHUNKS = 150_000
#: Characters of the longest one it remembers.
LONGEST = 64
_NONE = np.int32(2**31 - 1)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token -> rank of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Memo(dict):
    """A memo of two generations, bounded in number and bytes: what is still in use outlives a full one.

    Keys of more than ``LONGEST`` characters are held for one batch only.
    """

    def __init__(self, most: int = MEMO_CHUNKS):
        super().__init__()
        self.most, self.old, self.long = most, {}, {}

    def __missing__(self, key: str) -> bytes:
        return self.long[key]

    def learn(self, pairs: Iterable[tuple[str, bytes]]) -> None:
        for k, v in pairs:
            (self if len(k) <= LONGEST else self.long)[k] = v

    def turn(self) -> None:
        """Start a batch, and a new generation if this one is full."""
        self.long.clear()
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()

    def missing(self, keys: set[str]) -> list[str]:
        """The keys that are in neither generation; the others are in the new one afterwards."""
        self.turn()
        new = {k for k in keys if k not in self}
        old = self.old
        if old and new:
            known = {k: old[k] for k in new if k in old}
            self.update(known)
            new -= known.keys()
        return list(new)


class PairTable:
    """(left id, right id) -> merged id by open addressing with linear probing."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        bits = max(4, (4 * max(1, len(pairs)) - 1).bit_length())
        self.mask = (1 << bits) - 1
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.values = np.full(1 << bits, _NONE, dtype=np.int32)
        self.probes = 1
        if not pairs:
            return
        ab = np.array(list(pairs), dtype=np.int64)
        todo_key, todo_value = (ab[:, 0] << 32) | ab[:, 1], np.array(list(pairs.values()), dtype=np.int32)
        slot, step = self._slot(todo_key), 0
        while len(todo_key):
            at = (slot + step) & self.mask
            free = self.keys[at] == -1
            first = np.zeros(len(at), dtype=bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]], self.values[at[put]] = todo_key[put], todo_value[put]
            todo_key, todo_value, slot = todo_key[~put], todo_value[~put], slot[~put]
            step += 1
        self.probes = step

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids; _NONE where the pair does not merge or an id is padding."""
        shape = left.shape
        key = ((left.astype(np.int64) << 32) | right.astype(np.int64)).ravel()
        out = np.full(key.shape, _NONE, dtype=np.int32)
        open_ = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        k = key[open_]
        slot = self._slot(k)
        for step in range(self.probes):
            at = (slot + step) & self.mask
            found = self.keys[at]
            hit = found == k
            out[open_[hit]] = self.values[at[hit]]
            more = ~hit & (found != -1)
            if not more.any():
                break
            open_, k, slot = open_[more], k[more], slot[more]
        return out.reshape(shape)


class MatrixMerger:
    """Merges byte ids by rank, for many pieces at once.

    pairs: (left id, right id) -> rank; id_of_rank: the id that a merge makes;
    last_byte_ids: ids of a piece's last byte; whole: pieces that need no merging.
    """

    def __init__(self, pairs: dict[tuple[int, int], int], id_of_rank: np.ndarray, byte_ids: np.ndarray, last_byte_ids: np.ndarray, whole: dict[bytes, int]):
        self.pairs, self.pair_dict, self.id_of_rank = PairTable(pairs), pairs, id_of_rank
        self.byte_ids, self.last_byte_ids, self.whole = byte_ids, last_byte_ids, whole

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (whole := self.whole.get(p)) is not None:
                out[i] = whole.to_bytes(4, "little")
                continue
            if len(p) > LONG_BYTES:
                out[i] = self._heap(p)
            else:
                buckets.setdefault(max(2, (len(p) - 1).bit_length()), []).append(i)
        for bits, rows in buckets.items():
            step = max(1, MATRIX_CELLS >> bits)
            for k in range(0, len(rows), step):
                self._matrix([pieces[i] for i in rows[k : k + step]], rows[k : k + step], out)
        return out

    def _matrix(self, pieces: list[bytes], rows: list[int], out: list) -> None:
        width = max(map(len, pieces))
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(-1, width)
        lengths = np.array([len(p) for p in pieces])
        ids = np.where(np.arange(width) < lengths[:, None], self.byte_ids[flat], np.int32(-1))
        ids[np.arange(len(ids)), lengths - 1] = self.last_byte_ids[flat[np.arange(len(ids)), lengths - 1]]
        rank = self.pairs.get(ids[:, :-1], ids[:, 1:])
        row = np.array(rows)
        while len(row):
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(row), dtype=np.int64)
            lines = np.arange(len(row))
            best = rank[lines, at] if rank.shape[1] else np.full(len(row), _NONE)
            done = best == _NONE
            if done.any():
                left = ids[done]
                real = left >= 0
                flat, ends = left[real].astype("<u4").tobytes(), (4 * real.sum(axis=1)).cumsum().tolist()
                begin = 0
                for r, end in zip(row[done].tolist(), ends, strict=True):
                    out[r] = flat[begin:end]
                    begin = end
                live = ~done
                row, ids, rank, at, best = row[live], ids[live], rank[live], at[live], best[live]
                if not len(row):
                    return
                lines = np.arange(len(row))
            ids[lines, at] = self.id_of_rank[best]
            n, width = ids.shape
            keep = np.ones((n, width), dtype=bool)
            keep[lines, at + 1] = False
            ids = ids[keep].reshape(n, width - 1)
            # of the two ranks at the merged pair one goes; those beside it are looked up again
            keep = np.ones((n, width - 1), dtype=bool)
            keep[lines, at] = False
            rank = rank[keep].reshape(n, width - 2)
            for j in (at - 1, at):
                ok = (j >= 0) & (j < width - 2)
                i, k = lines[ok], j[ok]
                rank[i, k] = self.pairs.get(ids[i, k], ids[i, k + 1])

    def _heap(self, piece: bytes) -> bytes:
        ids = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)].tolist()
        ids[-1] = int(self.last_byte_ids[piece[-1]])
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pair_dict.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.id_of_rank[r]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (x := self.pair_dict.get((ids[left], ids[right]))) is not None:
                    heapq.heappush(heap, (x, left, ids[left], ids[right]))
        return np.array([x for x in ids if x >= 0], dtype="<u4").tobytes()

class ByteBPE(MatrixMerger):
    """Encoder and decoder for one rank file and one pretokenizer pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            tokens[i] = token
        self.token_bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.token_sizes = np.array([len(x) for x in tokens], dtype=np.int64)
        self.token_starts = self.token_sizes.cumsum() - self.token_sizes
        # \s means Unicode white space, without the separators \x1c-\x1f
        self.pattern = regex.compile(pattern.replace(r"(?!\S)", r"(?!\P{White_Space})").replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}"))
        pairs = {}
        for token, i in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = i
        byte_ids = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        super().__init__(pairs, np.arange(len(tokens), dtype=np.int32), byte_ids, byte_ids, ranks)
        self.chunk_memo, self.piece_memo = Memo(), Memo()
        self.odd_space = regex.compile(r"\s[ ](?:\s|\Z)")

    def _pieces(self, chunks: list[str]) -> list[list[str]]:
        """Matches of each chunk; plain chunks are matched together, with line feeds between."""
        plain = [c for c in chunks if len(x := c.split()) == 1 and c in (x[0], " " + x[0])]
        out = dict.fromkeys(plain)
        at: list[str] = []
        pieces = iter(plain)
        for m in self.pattern.findall("\n".join(plain)):
            if m == "\n":
                out[next(pieces)] = at
                at = []
            else:
                at.append(m)
        if plain:
            out[next(pieces)] = at
        return [out[c] if c in out else self.pattern.findall(c) for c in chunks]

    def _known(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk."""
        memo = self.chunk_memo
        if new := memo.missing(set(chunks)):
            split = self._pieces(new)
            pieces = self.piece_memo
            if unknown := pieces.missing(set().union(*split)):
                pieces.learn(zip(unknown, self.merge([p.encode("utf-8", "surrogatepass") for p in unknown]), strict=True))
            memo.learn((c, pieces[s[0]] if len(s) == 1 else b"".join([pieces[p] for p in s])) for c, s in zip(new, split, strict=True))
        return [memo[c] for c in chunks]

    def encode(self, docs: Iterable[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        A match never runs from a non-space into a space, so a text may be cut before every
        space, unless the space stands inside (or ends) a longer run of white space.  Arrow
        cuts the texts and numbers the distinct chunks, which are encoded once.
        """
        docs = list(docs)
        out = [b""] * len(docs)
        odd = [i for i, d in enumerate(docs) if self.odd_space.search(d)]
        for i in odd:
            out[i] = b"".join(self._known(self.pattern.findall(docs[i])))
        whole = set(odd)
        plain = [i for i in range(len(docs)) if i not in whole]
        split = pc.split_pattern(pa.array([docs[i] for i in plain], pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        # a text's first chunk has no space before it
        known = self._known([" " + x for x in distinct] + [docs[i].split(" ", 1)[0] for i in plain])
        at = np.asarray(split.offsets).astype(np.int64)
        chunk = coded.indices.to_numpy(zero_copy_only=False).copy()
        chunk[at[:-1]] = len(distinct) + np.arange(len(plain))
        size = np.array([len(x) // 4 for x in known], dtype=np.int64)
        n = size[chunk]
        flat = np.frombuffer(b"".join(known), dtype="<u4")
        ids = flat[ragged((np.cumsum(size) - size)[chunk], n)].tobytes()
        ends = (4 * np.concatenate([[0], np.cumsum(n)])[at]).tolist()
        for i, begin, end in zip(plain, ends, ends[1:], strict=False):
            out[i] = ids[begin:end]
        return out

    def decode(self, ids: bytes) -> bytes:
        """Bytes of ids given as little-endian unsigned 32-bit integers."""
        index = np.frombuffer(ids, dtype="<u4")
        return self.token_bytes[ragged(self.token_starts[index], self.token_sizes[index])].tobytes()


@lru_cache(maxsize=2)
def _loaded(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(read_ranks(path), pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (binary, little-endian uint32) and the bytes decoded from them."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        bpe = _loaded(ranks_path, pattern)
        ids = bpe.encode(texts(b))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.binary())], ["doc_id", "ids", "decoded"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, ids binary, decoded binary")


def digest_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode, decode, and return counts and digests only (ids never leave the worker)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        bpe = _loaded(ranks_path, pattern)
        ids = bpe.encode(texts(b))
        return pa.RecordBatch.from_arrays(
            [
                b.column(0),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string()),
            ],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
