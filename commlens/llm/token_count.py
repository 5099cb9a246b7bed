"""Token counts of whole texts by overlap resynchronisation.

A tokenizer of the ``tokenizers`` library whose pretokenizer drops white space
encodes white-space-delimited words independently of each other.  A text longer than
``chunk`` characters is encoded as overlapping chunks with character offsets; two
neighbours are spliced at a stable boundary: the start of a word that both chunks
hold whole (not the first of the right chunk, which may have lost its beginning, nor
the last of the left one, which may have lost its end), at the same offset and with
the same ids.  If an overlap has no such word it is widened (doubled) and both chunks
are encoded anew, up to the whole rest of the text; so the result is always that of
the whole text.

Words are found and numbered by Arrow; each distinct one of a batch goes to the library
once, many in one call: they are joined by a special token, which the library never
merges with its neighbours and whose id parts their ids again.  (Where the file lower-cases
and parts marks from letters, a word's closing marks go apart from it.)  Texts that hold a special
token themselves, and texts with the separators \\x1c-\\x1f (white space to Arrow, none to
the library), go to the library as they are.  Words are remembered in a bounded memo.

Null texts count as empty: 0 bytes, 0 tokens.  Repeated rows (of texts or ids) give
repeated results; an empty table gives an empty table; only the id and text columns are
read, so other columns may have any name.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from commlens.llm.bpe import Memo
from commlens.llm.common import map_batches, ragged, slices, texts

#: Characters of a chunk and of the first overlap.
CHUNK, OVERLAP = 32768, 512
#: Words handed to the library in one call.
_BATCH = 2048
#: Words a worker remembers in each of two generations.
MEMO_WORDS = 450_000
#: A pretokenizer that parts letters and digits from the marks after them, as it stands in a tokenizer file.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_MARKS = ".,;:!?*$%&#)]}\""
_WORD = regex.compile(r"\P{White_Space}+")
_PLAIN = np.array([c < 128 and chr(c).isalnum() for c in range(256)])


class WordEncoder:
    """Ids of white-space-delimited words, as little-endian unsigned 16- or 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        names = "|".join(regex.escape(t.content) for t in added.values()) or r"(?!)"
        self.special, self.whole = regex.compile(names), regex.compile("[\x1c-\x1f]|" + names, regex.I)
        self.leads = sorted({"\x1c", "\x1d", "\x1e", "\x1f"} | {c for t in added.values() for c in (t.content[0].lower(), t.content[0].upper())})
        apart = [(i, t.content) for i, t in sorted(added.items()) if t.special and not (t.lstrip or t.rstrip or t.single_word)]
        self.apart = apart[0] if apart else None
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0].get("pattern")
        lower = any(x["type"] == "Lowercase" for x in (spec.get("normalizer") or {}).get("normalizers", []))
        self.cuts = lower and first == {"Regex": _SPLIT}
        self.memo = Memo(MEMO_WORDS)

    def _alone(self, items: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(items, add_special_tokens=False)]

    def _library(self, words: list[str]) -> list[bytes]:
        """Ids of words without a special token, many in one call."""
        if self.apart is None:
            return self._alone(words)
        mark, between = self.apart
        out: list[bytes] = []
        for k in range(0, len(words), _BATCH):
            part = words[k : k + _BATCH]
            ids = np.array(self.tokenizer.encode_batch_fast([between.join(part)], add_special_tokens=False)[0].ids, dtype=self.dtype)
            ends = np.append(np.flatnonzero(ids == mark), len(ids))
            if len(ends) != len(part):
                out += self._alone(part)
                continue
            flat, begin = ids.tobytes(), 0
            for end in (ends * self.width).tolist():
                out.append(flat[begin:end])
                begin = end + self.width
        return out

    def ids(self, words: list[str]) -> list[bytes]:
        """Ids of each word."""
        memo = self.memo
        memo.turn()
        out = [*map(memo.get, words)]
        open_ = [i for i, x in enumerate(out) if x is None]
        if open_ and memo.old:
            for i in open_:
                if (x := memo.old.get(words[i])) is not None:
                    out[i] = memo[words[i]] = x
            open_ = [i for i in open_ if out[i] is None]
        if open_:
            plain, odd = [], []
            for w in {words[i] for i in open_}:
                (odd if self.special.search(w) else plain).append(w)
            known = dict(zip(plain + odd, self._library(plain) + self._alone(odd), strict=True))
            for i in open_:
                out[i] = known[words[i]]
            memo.learn(known.items())
        return out

    @staticmethod
    def _halves(words: pa.LargeStringArray) -> pa.LargeStringArray:
        """Each word without its closing marks, and these marks, in turn; nothing is copied."""
        if not len(words):
            return words
        _, at, data = words.buffers()
        at = np.frombuffer(at, np.int64)[words.offset : words.offset + len(words) + 1]
        size = pc.binary_length(pc.utf8_rtrim(words, characters=_MARKS)).to_numpy(zero_copy_only=False)
        raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        parts = (size > 0) & (size < np.diff(at))
        parts[parts] = _PLAIN[raw[(at[:-1] + size - 1)[parts]]]
        both = np.empty(2 * len(words) + 1, dtype=np.int64)
        both[0::2], both[1::2] = at, np.where(parts, at[:-1] + size, at[1:])
        return pa.LargeStringArray.from_buffers(2 * len(words), pa.py_buffer(both), data)

    def encode(self, docs: list[str], counts_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end (or none), and how many each has."""
        whole = [i for i, d in enumerate(docs) if any(c in d for c in self.leads) and self.whole.search(d)]
        odd = set(whole)
        owner, parts = [], []
        for i, d in enumerate(docs):
            for p in () if i in odd else slices(d):
                owner.append(i)
                parts.append(p)
        text = pa.array(parts, pa.large_string())
        split = pc.utf8_split_whitespace(pc.ascii_lower(text) if self.cuts else text)
        words, ends = split.flatten(), np.asarray(split.offsets).astype(np.int64)
        if self.cuts:
            words, ends = self._halves(words), 2 * ends
        coded = words.dictionary_encode()
        known = self.ids(coded.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(known), dtype=self.dtype)
        size = np.array([len(x) // self.width for x in known], dtype=np.int64)
        word = coded.indices.to_numpy(zero_copy_only=False)
        n = size[word]
        counts = np.zeros(len(docs), dtype=np.int64)
        np.add.at(counts, np.array(owner, dtype=np.int64), np.diff(np.concatenate([[0], np.cumsum(n)])[ends - ends[0]]))
        ids = flat[:0] if counts_only else flat[ragged((np.cumsum(size) - size)[word], n)]
        if whole:  # these are put between the others
            out = [] if counts_only else np.split(ids, np.cumsum(counts)[:-1])
            for i in whole:
                x = np.frombuffer(b"".join(self._alone(list(slices(docs[i])))), dtype=self.dtype)
                counts[i] = len(x)
                if out:
                    out[i] = x
            ids = np.concatenate(out) if out else ids
        return ids, counts

    def encode_chunk(self, chunk: str, offset: int) -> tuple[np.ndarray, list[bytes]]:
        """Offset of each word, and its ids."""
        spans = [m.span() for m in _WORD.finditer(chunk)]
        return np.array([a for a, _ in spans], dtype=np.int64) + offset, self.ids([chunk[a:b] for a, b in spans])


def _boundary(left: tuple[np.ndarray, list[bytes]], right: tuple[np.ndarray, list[bytes]]) -> tuple[int, int] | None:
    """Where to splice: the index of the first stable word in either chunk."""
    common, i, j = np.intersect1d(left[0][:-1], right[0][1:], assume_unique=True, return_indices=True)
    for a, b in zip(i.tolist(), (j + 1).tolist(), strict=True):
        if left[1][a] == right[1][b]:
            return a, b
    return None


def encode_overlapping(encoder: WordEncoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> bytes:
    """Ids of a whole text, encoded as overlapping chunks."""
    chunk, overlap = max(1, chunk), max(1, overlap)
    out: list[bytes] = []
    begin, left = 0, encoder.encode_chunk(text[: chunk + overlap], 0)
    skip = 0  # words of the left chunk that are already out
    while begin + chunk + overlap < len(text):
        wide, at = overlap, begin + chunk
        while True:
            right = encoder.encode_chunk(text[at : at + chunk + wide], at)
            if cut := _boundary((left[0][skip:], left[1][skip:]), right):
                out += left[1][skip : skip + cut[0]]
                begin, left, skip = at, right, cut[1]
                chunk_end = at + chunk + wide
                break
            wide *= 2
            left = encoder.encode_chunk(text[begin : at + wide], begin)
            if at + wide >= len(text):
                return b"".join([*out, *left[1][skip:]])
        if chunk_end >= len(text):
            break
    return b"".join([*out, *left[1][skip:]])


@lru_cache(maxsize=2)
def loaded(path: str) -> WordEncoder:
    return WordEncoder(path)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        encoder, docs_ = loaded(tokenizer_path), texts(b)
        short = [i for i, d in enumerate(docs_) if len(d) <= chunk + overlap]
        n = np.zeros(len(docs_), dtype=np.int64)
        n[short] = encoder.encode([docs_[i] for i in short], counts_only=True)[1]
        for i in sorted(set(range(len(docs_))) - set(short)):
            n[i] = len(encode_overlapping(encoder, docs_[i], chunk, overlap)) // encoder.width
        return pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([len(x.encode("utf-8")) for x in docs_], pa.int64()), pa.array(n), pa.array(n > limit)],
            ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
