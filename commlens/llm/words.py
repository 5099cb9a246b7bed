"""Words of many texts and their hashes, found and numbered by Arrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


def numbered_words(parts: list, lower: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the number of each word in order, and how many words each part has.

    Words stand between ASCII white space; ``lower`` lower-cases A-Z first.  Only distinct
    words become Python objects, so memory stays near the size of the parts.
    """
    text = pa.array(parts, pa.large_string())
    split = pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text)
    words = split.flatten()
    ends = np.asarray(split.offsets).astype(np.int64)
    some = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # a part may begin or end with white space
    counts = np.diff(np.concatenate([[0], np.cumsum(some)])[ends - ends[0]])
    coded = words.filter(pa.array(some)).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), counts


def hashed_words(parts: list, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and how many words each part has."""
    distinct, number, counts = numbered_words(parts, lower)
    known = distinct.cast(pa.large_binary()).to_pylist()
    return np.fromiter(map(xxhash.xxh64_intdigest, known), dtype=np.uint64, count=len(known))[number], counts
