"""From raw documents to training data: toxicity, language, near-duplicates, leaks, tokens.

Every stage takes (spark, docs, sf_dir) and works on all documents that the stage before
it kept; models are fitted anew on those documents.  All but the last return the columns
of documents.  ``run`` writes each stage's documents to the shared folder, so that a lost
executor costs one stage at most.

Texts are read whole, whatever their length.  Null texts count as empty: the language stage
drops them with all texts without a letter, the others keep them.  Rows without an id are
judged by their text like any other, and so are repeated rows, of which the near-duplicate
stage keeps one where they hold a word.  Columns beside doc_id and text pass through under
their names, whatever these are; the last stage returns its own columns, a row for each row.
No documents give none; no labels, languages or benchmark items reject nothing but texts
without a letter.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commlens.llm import bpe, decontam, langid, neardup, toxicity
from commlens.llm.common import forget, read, written

#: A document is toxic from this score on.
TOXIC = 0.5
#: A text is in a language whose n-grams cover at least this share of what they cover of a typical text.
LEAST_COVERAGE = 0.35
#: Words of a shingle, and per cent of similarity, of the near-duplicate stage.
SHINGLE, SIMILAR = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; rows without words stay."""
    model = toxicity.train(docs, toxicity.training_part(read(spark, sf_dir, "labels")))
    return toxicity.keep_below(docs, model, TOXIC)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the corpus' languages; texts without a letter go."""
    return langid.keep_covered(docs, langid.train(docs), LEAST_COVERAGE)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, with its smallest id; rows without words stay."""
    return neardup.one_of_each(docs, SHINGLE, SIMILAR)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontam.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the remaining documents, encoded and decoded again."""
    return bpe.digest_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_known_language),
    ("near_duplicates", one_of_each_group),
    ("decontamination", drop_leaks),
    ("encoding", encode),
]

#: The toxicity and language models and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs, before = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
