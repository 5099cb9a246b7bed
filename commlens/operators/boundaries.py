"""Sentence boundaries learnt from the corpus itself, without labels.

A type that stands before a period much more often than chance allows is an abbreviation
(log-likelihood of the collocation, scaled down for long types, for types that stand without
the period too, and up for inner periods).  A period of an abbreviation ends a sentence only
before a capitalised word that is otherwise written small, and never capitalised in the middle
of a sentence.  Line ends, ! and ? always end one; a period inside a word (3.5, e.g) never does.

All figures are counts of types, summed up where the texts are read; whole texts meet only the
few places that an abbreviation joins again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least score of an abbreviation; characters of a word that can be one.
LEAST_SCORE, LONGEST = 0.3, 64
#: The last run of letters and digits of a word (with inner periods, hyphens, apostrophes), and the period behind it.
TYPE = r"([\p{L}\p{N}](?:[\p{L}\p{N}.'-]*[\p{L}\p{N}])?)(\.?)[^\p{L}\p{N}]*$"
SPACE = r"[ \t\r]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t\r\n]+"), lambda w: w != "")


def _ends(word: Column) -> Column:
    """Whether a sentence may end with this word."""
    return F.rlike(word, F.lit(r"[.!?][^\p{L}\p{N}]*$"))


def _is_upper(kind: Column) -> Column:
    first = F.substring(kind, 1, 1)
    return first != F.lower(first)


def type_counts(df: DataFrame, text: str) -> DataFrame:
    """type, dotted, bare (how often with and without a period), low, inside (written small; capitalised within a sentence)."""
    words = _words(F.col(text))
    before = F.concat(F.array(F.lit(".")), words)  # the word before each one; a text's first begins a sentence
    rows = df.select(F.explode(F.arrays_zip(words.alias("word"), before.alias("before"))).alias("x")).where("x.word IS NOT NULL AND length(x.word) <= " + str(LONGEST))
    rows = rows.select(F.regexp_extract("x.word", TYPE, 1).alias("kind"), F.regexp_extract("x.word", TYPE, 2).alias("dot"), _ends(F.col("x.before")).alias("after_end")).where("kind <> ''")
    upper = _is_upper(F.col("kind"))
    return rows.groupBy(F.lower("kind").alias("type")).agg(
        F.count_if(F.col("dot") == ".").alias("dotted"), F.count_if(F.col("dot") == "").alias("bare"),
        F.count_if(~upper).alias("low"), F.count_if(upper & ~F.col("after_end")).alias("inside"),
    )


def abbreviations(types: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """type, score of the abbreviations among the types."""
    total = types.agg(F.sum("dotted").cast("double").alias("periods"), F.sum(F.col("dotted") + F.col("bare")).cast("double").alias("words"))
    x = types.where("dotted > 0").crossJoin(F.broadcast(total))  # a single row
    k, n = F.col("dotted"), F.col("dotted") + F.col("bare")
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col("periods") / F.col("words")))
    ratio = -2 * (k * F.log(p) + (n - k) * F.log(1 - p) - k * F.log(F.lit(0.99)) - (n - k) * F.log(F.lit(0.01)))
    inner = F.length("type") - F.length(F.replace("type", F.lit("."), F.lit("")))
    letters = F.length("type") - inner
    score = ratio * F.exp(-letters) * (inner + 1) * F.exp(-F.col("bare") * F.log(letters))
    return x.select("type", F.round(score, 6).alias("score")).where(F.col("score") >= least)


def starters(types: DataFrame) -> DataFrame:
    """Types that are capitalised only where a sentence begins."""
    return types.where("low > 0 AND inside = 0").select("type")


def _lines(text: Column) -> Column:
    """Lines, each cut behind . ! ? and white space; blank lines and pieces are left out."""
    some = lambda x: F.filter(x, lambda s: F.trim(s) != "")
    return F.transform(some(F.split(F.coalesce(text, F.lit("")), r"\n+")), lambda line: some(F.split(line, r"(?<=[.!?])" + SPACE)))


def split_sentences(df: DataFrame, uid: str, text: str, found: DataFrame, first: DataFrame, alias: str = "sentences") -> DataFrame:
    """df with its texts as arrays of sentences; ``uid`` must be unique.

    found: abbreviations, first: starters.  Only (uid, place, two words) of the pieces that end with
    a period are shuffled, if the tables of types are too large to be broadcast.
    """
    cut = df.withColumn("_lines", _lines(F.col(text)))
    last = lambda s: F.element_at(_words(s), -1)
    places = lambda line, at: F.transform(F.sequence(F.lit(1), F.size(line) - 1), lambda i: F.struct(at.alias("line"), i.alias("piece"), last(F.element_at(line, i)).alias("word"), F.element_at(_words(F.element_at(line, i + 1)), 1).alias("next")))
    joints = F.flatten(F.transform("_lines", lambda line, at: F.when(F.size(line) > 1, places(line, at)).otherwise(F.array().cast("array<struct<line: int, piece: int, word: string, next: string>>"))))
    ends = cut.select(uid, F.explode(joints).alias("x")).where(f"length(x.word) <= {LONGEST}").select(uid, "x.line", "x.piece", F.lower(F.regexp_extract("x.word", TYPE, 1)).alias("type"), F.regexp_extract("x.word", TYPE, 2).alias("dot"), F.regexp_extract("x.next", r"^[^\p{L}\p{N}]*([\p{L}\p{N}](?:[\p{L}\p{N}.'-]*[\p{L}\p{N}])?)", 1).alias("kind"))
    inner = ends.where("dot = '.'").join(found.select("type"), "type").withColumn("next_type", F.lower("kind"))
    begins = first.select(F.col("type").alias("next_type"), F.lit(True).alias("begins"))
    kept = inner.join(begins, "next_type", "left").where(~(_is_upper(F.col("kind")) & F.coalesce("begins", F.lit(False))))
    glue = kept.groupBy(uid).agg(F.collect_set(F.struct("line", "piece")).alias("_glue"))
    none = F.array().cast("array<string>")

    def join(line: Column, at: Column) -> Column:
        def step(done: Column, s: Column) -> Column:
            glued = F.array_contains("_glue", F.struct(at.alias("line"), s["at"].alias("piece")))
            more = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat_ws(" ", F.element_at(done, -1), s["piece"])))
            return F.when(glued, more).otherwise(F.concat(done, F.array(s["piece"])))

        return F.aggregate(F.transform(line, lambda p, i: F.struct(i.alias("at"), p.alias("piece"))), none, step)

    out = cut.join(glue, uid, "left")
    sentences = F.flatten(F.transform("_lines", lambda line, at: F.when(F.col("_glue").isNull(), line).otherwise(join(line, at))))
    return out.withColumn(alias, sentences).drop("_lines", "_glue")
