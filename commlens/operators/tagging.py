"""Parts of speech by a hidden Markov model, and imperative sentences by their root verb.

The model is counted from tagged sentences (word, tag, place) in aggregations: transitions of
tags, tags of words, and tags of word endings, which stand in for words that are rare or new.
Decoding is Viterbi's algorithm over all sentences of a batch at once.  The model goes to the
tasks whole: its size is that of the tagged corpus' vocabulary, at most ``MOST_WORDS``.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commlens.functions.tagged_mail import SENTENCES

#: Characters of the longest ending; weight of the shorter ending; weight of endings beside a word's own counts.
ENDING, SHORTER, ENDINGS = 4, 1.0, 0.5
#: Share of a transition that is the tag's own frequency.
SMOOTH = 0.1
#: Words that are decoded at once, with the gaps behind shorter sentences.
CELLS = 1 << 19
#: Words of a model, at most (some 100 MB).
MOST_WORDS = 500_000
#: Tokens: contractions are parted, punctuation stands alone.
TOKEN = re.compile(r"\w+?(?=n['’]t\b)|n['’]t\b|\w+|['’]\w+|[^\w\s]")
# Words before a root verb that change nothing, conjunctions of clauses before it, subjects in the nominative.
OPENERS = ["please", "kindly", "just", "then", "also", "ok", "okay", "so", "and", "but", "thanks", "now", "again"]
CLAUSES = ["if", "when", "once", "after", "before", "unless", "until", "while", "as", "whenever", "since", "because"]
NOMINATIVES = ["i", "we", "he", "she", "they"]


def tokens(sentence: str) -> list[str]:
    return TOKEN.findall(sentence)


def shape(word: str) -> str:
    """The word as the model knows it: numbers and punctuation by kind, others in lower case."""
    if any(c.isdigit() for c in word):
        return "#number"
    return word.lower().replace("’", "'") if any(c.isalpha() for c in word) else "#end" if word in ".!?" else "#mark"


def endings(word: str, capital: bool) -> list[str]:
    """The word's endings from the shortest, with a mark for capitals within a sentence."""
    return ["^" * capital + word[-n:] for n in range(1, min(ENDING, len(word)) + 1)] if word[0] != "#" else []


def tagged_mail(spark: SparkSession) -> DataFrame:
    """The tagged sentences of this package: sentence, place, word, tag."""
    rows = [(k, i, *x.rsplit("/", 1)) for k, s in enumerate(SENTENCES) for i, x in enumerate(s.split())]
    return spark.createDataFrame(rows, "sentence int, place int, word string, tag string")


class Tagger:
    """Log-probabilities of the model, and decoding."""

    def __init__(self, tags: list[str], steps: np.ndarray, words: dict[str, dict[str, int]], ends: dict[str, dict[str, int]]):
        self.tags, self.words, self.ends = tags, words, ends
        at = {t: i for i, t in enumerate(tags)}
        self.prior = np.zeros(len(tags))
        for found in words.values():
            for t, n in found.items():
                self.prior[at[t]] += n
        self.prior /= self.prior.sum()
        self.at = at
        rows = steps / np.maximum(steps.sum(axis=1, keepdims=True), 1)
        mixed = (1 - SMOOTH) * rows + SMOOTH * np.append(self.prior, 0)  # the last column is the end of the sentence
        mixed[:, -1] = np.maximum(rows[:, -1], 1e-4)
        self.into = np.ascontiguousarray(np.log(mixed[:-1, :-1]).T)
        self.start, self.step, self.stop = np.log(mixed[-1, :-1]), np.log(mixed[:-1, :-1]), np.log(mixed[:-1, -1])
        self._clear()

    def _counts(self, found: dict[str, int]) -> np.ndarray:
        out = np.zeros(len(self.tags))
        for t, n in found.items():
            out[self.at[t]] = n
        return out

    def _clear(self) -> None:
        """Forget what was looked up: rows by word, and their table; endings have rows of their own."""
        self.rows: dict[tuple[str, bool], int] = {}
        self.table = np.zeros((1024, len(self.tags)))
        self.by_end: dict[str, np.ndarray] = {}

    def _ending(self, e: str) -> np.ndarray:
        """P(tag | ending), from the shorter ending's."""
        if e not in self.by_end:
            short = "^" + e[2:] if e[0] == "^" else e[1:]
            p = self._ending(short) if short.strip("^") else self.prior
            n = self.ends.get(e)
            if n is None:
                return p
            n = self._counts(n)
            self.by_end[e] = (n + SHORTER * p) / (n.sum() + SHORTER)
        return self.by_end[e]

    def row(self, word: str, first: bool) -> int:
        """Where the word's emissions are in the table."""
        capital = not first and word[0].isupper()
        at = self.rows.get((word, capital))
        if at is None:
            known = shape(word)
            ends = endings(known, capital)
            p = self._ending(ends[-1]) if ends else self.prior
            if (n := self.words.get(known)) is not None:
                n = self._counts(n)
                p = (n + ENDINGS * p) / (n.sum() + ENDINGS)
            at = self.rows[word, capital] = len(self.rows)
            if at == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[at] = np.log(np.maximum(p, 1e-9)) - np.log(self.prior)
        return at

    def emission(self, word: str, first: bool) -> np.ndarray:
        """log P(tag | word) - log P(tag), which is log P(word | tag) but for a constant."""
        return self.table[self.row(word, first)]

    def score(self, words: list[str], tags: list[str]) -> float:
        """Log-probability (but for a constant of the words) of one tagging."""
        k = [self.at[t] for t in tags]
        e = sum(self.emission(w, i == 0)[t] for i, (w, t) in enumerate(zip(words, k, strict=True)))
        return float(self.start[k[0]] + e + sum(self.step[a, b] for a, b in zip(k, k[1:], strict=False)) + self.stop[k[-1]])

    def decode(self, sentences: list[list[str]]) -> list[list[str]]:
        """The likeliest tags of every sentence; many sentences at once, the longest first."""
        if len(self.rows) > 200_000:
            self._clear()
        out: list[list[str]] = [[] for _ in sentences]
        order = sorted((i for i, s in enumerate(sentences) if s), key=lambda i: -len(sentences[i]))
        while order:
            n = max(1, CELLS // len(sentences[order[0]]))
            self._decode([sentences[i] for i in order[:n]], order[:n], out)
            order = order[n:]
        return out

    def _decode(self, some: list[list[str]], numbers: list[int], out: list[list[str]]) -> None:
        sizes = np.array([len(s) for s in some])
        going = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")  # how many sentences are longer than k words
        rows = np.zeros((sizes[0], len(some)), dtype=np.int64)
        for i, s in enumerate(some):
            rows[: len(s), i] = [self.row(w, k == 0) for k, w in enumerate(s)]
        best = self.start + self.table[rows[0]]
        back = np.zeros((sizes[0], len(some), len(self.tags)), dtype=np.int8)
        for k in range(1, sizes[0]):
            n = going[k]
            reach = best[:n, None, :] + self.into
            back[k, :n] = reach.argmax(axis=2)
            best[:n] = reach.max(axis=2) + self.table[rows[k, :n]]
        path = np.zeros((sizes[0], len(some)), dtype=np.int8)
        last = (best + self.stop).argmax(axis=1)
        for k in range(sizes[0] - 1, -1, -1):
            n = going[k]
            path[k, :n] = last[:n]
            last[:n] = back[k, np.arange(n), last[:n]]
        for i, number in enumerate(numbers):
            out[number] = [self.tags[t] for t in path[: sizes[i], i].tolist()]


def train(rows: DataFrame) -> Tagger:
    """Count a model from (sentence, place, word, tag)."""
    # over the tagged corpus alone
    model_word, ends = F.udf(shape, "string", useArrow=False), F.udf(endings, "array<string>", useArrow=False)
    x = rows.withColumn("shape", model_word("word")).withColumn("capital", (F.col("place") > 0) & F.rlike("word", F.lit(r"^\p{Lu}")))
    # the tag before, and the end of each sentence, by place
    after = rows.select("sentence", (F.col("place") + 1).alias("place"), F.col("tag").alias("before"))
    steps = rows.select("sentence", "place", "tag").join(after, ["sentence", "place"], "full").groupBy("before", "tag").count().collect()  # tags squared
    words = x.groupBy("shape", "tag").count()
    n = words.select("shape").distinct().count()
    if not n or n > MOST_WORDS:
        raise ValueError(f"a tagged corpus of 1 to {MOST_WORDS} words is needed, not {n}")
    found = words.collect()
    by_end = x.select("tag", F.explode(ends("shape", "capital")).alias("end")).groupBy("end", "tag").count().collect()  # at most 8 a word
    tags = sorted({r.tag for r in found})
    at = {t: i for i, t in enumerate(tags)}
    table = np.zeros((len(tags) + 1, len(tags) + 1))
    for r in steps:
        table[at.get(r.before, -1), at.get(r.tag, -1)] += r["count"]
    both: tuple[dict, dict] = ({}, {})
    for r in found:
        both[0].setdefault(r.shape, {})[r.tag] = r["count"]
    for r in by_end:
        both[1].setdefault(r.end, {})[r.tag] = r["count"]
    return Tagger(tags, table, *both)


def is_imperative(words: list[str], tags: list[str]) -> bool:
    """Whether the root is a base verb without a subject.

    Before the root there may be adverbs, interjections, an address (names and a comma) and a
    clause with its conjunction, up to a comma.
    """
    low = [w.lower() for w in words]
    i = 0
    while i < len(words):
        if low[i] in CLAUSES and "," in words[i:]:
            i = words.index(",", i) + 1
        elif tags[i] in ("RB", "UH", "CC", "#") or low[i] in OPENERS:
            i += 1
        elif tags[i] == "NNP" and "," in words[i : i + 3] and all(t == "NNP" for t in tags[i : words.index(",", i)]):
            i = words.index(",", i) + 1
        else:
            break
    return i < len(words) and tags[i] == "VB" and (i + 1 == len(words) or low[i + 1] not in NOMINATIVES) and words[-1] != "?"


def _decoded(column: pd.Series, tagger: Tagger) -> list[list[tuple[list[str], list[str], bool]]]:
    """words, tags and imperative of every sentence of every row."""
    cut = [[tokens(s) for s in ([] if x is None else x)] for x in column]
    decoded = iter(tagger.decode([s for x in cut for s in x]))
    return [[(w, t := next(decoded), is_imperative(w, t)) for w in x] for x in cut]


def tagged_sentences(df: DataFrame, sentences: str, tagger: Tagger, alias: str = "tagged") -> DataFrame:
    """df with ``alias``: for each of the array's sentences its words, their tags, and whether it is imperative."""
    shared = df.sparkSession.sparkContext.broadcast(tagger)

    @F.pandas_udf("array<struct<words: array<string>, tags: array<string>, imperative: boolean>>")
    def tag(column: pd.Series) -> pd.Series:
        return pd.Series([[{"words": w, "tags": t, "imperative": i} for w, t, i in x] for x in _decoded(column, shared.value)], dtype=object)

    return df.withColumn(alias, tag(sentences))


def imperative_sentences(df: DataFrame, sentences: str, tagger: Tagger, alias: str = "imperative") -> DataFrame:
    """df with ``alias``: for each of the array's sentences whether it is imperative."""
    shared = df.sparkSession.sparkContext.broadcast(tagger)

    @F.pandas_udf("array<boolean>")
    def roots(column: pd.Series) -> pd.Series:
        return pd.Series([[i for _, _, i in x] for x in _decoded(column, shared.value)], dtype=object)

    return df.withColumn(alias, roots(sentences))
