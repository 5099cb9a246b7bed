"""Lexical message features, the composite score and its validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commlens.functions.text import has_deadline, phrase_hits, sentences, token_hits
from commlens.operators.ranks import average_ranks, small

# Obligation modals and phrases; (tokens, phrases) of each lexicon.
OBLIGATION_MODALS = ["must", "should", "shall", "need", "needs", "required"]
OBLIGATION_PHRASES = ["have to", "has to", "need to", "needs to"]
HEDGES = (
    ["perhaps", "maybe", "possibly", "probably", "somewhat", "presumably", "arguably", "apparently", "seemingly", "roughly"],
    ["i think", "i guess", "i believe", "i suppose", "i assume", "it seems", "it seems like", "sort of", "kind of", "i'm not sure", "im not sure", "not certain", "correct me if i'm wrong", "as far as i know", "i could be wrong"],
)
DEFERENCE = (
    [],
    ["would you mind", "if you don't mind", "if you dont mind", "if possible", "if it's not too much trouble", "when you get a chance", "when you have a chance", "no rush", "no worries if not", "sorry to bother", "sorry for the trouble", "at your convenience", "would it be possible", "i was wondering if", "i hope this is ok", "i hope that's ok", "please let me know if", "thanks in advance", "thank you in advance"],
)
COMMITMENT = ([], ["i will", "i'll", "i promise", "i plan to", "i intend to", "i'm going to", "im going to", "we will", "we'll", "i shall", "i commit to"])
#: Base verbs that open a request: this first-word heuristic stands in for a parser and is approximate.
REQUEST_VERBS = ["please", "send", "call", "let", "make", "give", "check", "review", "forward", "get", "keep", "note", "provide", "confirm", "see", "fix", "prepare", "schedule", "update"]
MAX_BODY_CHARS = 100_000


def eligible_bodies(messages: DataFrame, body: str, is_empty: str, most: int = MAX_BODY_CHARS) -> DataFrame:
    return messages.where(~F.col(is_empty) & (F.length(body) <= most))


def oversized(messages: DataFrame, body: str, most: int = MAX_BODY_CHARS) -> DataFrame:
    return messages.agg(F.count_if(F.length(body) > most).alias("oversized"))


def lexical_features(df: DataFrame, uid: str, body: str, hedges=HEDGES, deference=DEFERENCE, commitment=COMMITMENT, cut: Column | None = None, roots: Column | None = None) -> DataFrame:
    """Sentence-level shares; a sentence counts once however many hits it has; no sentence: zeros.

    cut: the body's sentences, where the built-in rule is not to cut them (see ``boundaries``);
    roots: for each of them whether its root is imperative (see ``tagging``), in place of the
    first-word rule.
    """
    n = F.size("sentences")

    def lexicon(x: Column, pair) -> Column:
        tokens, phrases = pair
        return token_hits(x["words"], tokens) | phrase_hits(x["low"], phrases)

    def imperative(x: Column) -> Column:
        request = F.try_element_at(x["words"], F.lit(1)).isin(REQUEST_VERBS) if roots is None else x["root"]
        return F.coalesce(request, F.lit(False)) | token_hits(x["words"], OBLIGATION_MODALS) | phrase_hits(x["low"], OBLIGATION_PHRASES)

    # every sentence is lower-cased and cut into words once
    root = lambda i: F.lit(False) if roots is None else F.get(roots, i)
    told = F.transform(sentences(F.col(body)) if cut is None else cut, lambda x, i: F.struct(F.lower(x).alias("low"), F.regexp_extract_all(F.lower(x), F.lit(r"(?U)\w+"), 0).alias("words"), root(i).alias("root")))
    tests = {
        "question_ratio": lambda x: F.endswith(F.rtrim(x["low"]), F.lit("?")),
        "imperative_ratio": imperative,
        "hedge_rate": lambda x: lexicon(x, hedges),
        "deference_rate": lambda x: lexicon(x, deference),
        "commitment_rate": lambda x: lexicon(x, commitment),
    }
    hits = F.transform("sentences", lambda x: F.struct(*[f(x).cast("int").alias(c) for c, f in tests.items()]))
    words = F.aggregate("sentences", F.lit(0), lambda k, x: k + F.size(x["words"]))
    x = df.select(uid, has_deadline(F.col(body)).alias("has_deadline"), told.alias("sentences"))
    x = x.select(uid, "has_deadline", words.alias("words"), n.alias("n"), hits.alias("hits"))

    def share(c: str) -> Column:
        return F.when(F.col("n") == 0, 0.0).otherwise(F.aggregate("hits", F.lit(0), lambda k, h: k + h[c]) / F.col("n"))

    return x.select(
        uid,
        F.col("words").cast("long").alias("n_tokens"),
        F.col("n").cast("long").alias("n_sentences"),
        F.when(F.col("n") == 0, 0.0).otherwise(F.col("words") / F.col("n")).alias("mean_sentence_len"),
        *[share(c).alias(c) for c in tests],
        "has_deadline",
    )


def joined_features(messages: DataFrame, layer_a: DataFrame, layer_b: DataFrame, uid: str, sender: str, recipients: str, address: str = "address", many: int = 10) -> DataFrame:
    """Messages with features of their own (inner), is_broadcast, and features of their sender (left).

    Messages and their features that are written in buckets of ``uid`` (``session.bucketed``) are
    joined without an exchange; senders are few beside messages, and their table is broadcast or
    shuffled as its size is.
    """
    flag = F.when(F.col(recipients) >= many, 1.0).otherwise(0.0)
    return messages.join(layer_a, uid).withColumn("is_broadcast", flag).join(layer_b.withColumnRenamed(address, sender), sender, "left")


def power_score(df: DataFrame, weights: dict[str, float], min_components: int = 3) -> DataFrame:
    """power_score = sum(w z) / sum(|w|) over the available z-scores; null below
    ``min_components``.  Means and sample deviations come from one aggregation of the same
    input; a column without variance is ignored.  Unknown weights are an error."""
    if unknown := sorted(set(weights) - set(df.columns)):
        raise ValueError(f"unknown score components: {unknown}")
    moments = df.agg(*[f(F.col(c).cast("double")).alias(f"{p}_{c}") for c in weights for p, f in (("m", F.avg), ("s", F.stddev_samp))])
    x = df.crossJoin(F.broadcast(moments))
    z = {c: F.when(F.col(f"s_{c}") > 0, (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")) for c in weights}
    number = sum((z[c].isNotNull().cast("long") for c in weights), F.lit(0).cast("long"))
    top = sum((F.coalesce(z[c] * w, F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    bottom = sum((F.when(z[c].isNotNull(), abs(w)).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    out = x.withColumns({"n_power_components": number, "power_score": F.when((number >= min_components) & (bottom > 0), top / bottom)})
    return out.select(*df.columns, "power_score", "n_power_components")


def score_by_rank(df: DataFrame, rank: str, score: str) -> DataFrame:
    return df.where(F.col(rank).isNotNull() & F.col(score).isNotNull()).groupBy(rank).agg(F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"), F.count(F.lit(1)).alias("n"))


def is_monotone(ranked: DataFrame, rank: str, value: str) -> DataFrame:
    """Whether the value never falls from one rank to the next (a table of a few ranks)."""
    before = F.lag(value).over(Window.orderBy(rank))
    return ranked.withColumn("_ok", F.coalesce(F.col(value) >= before, F.lit(True))).agg(F.coalesce(F.bool_and("_ok"), F.lit(True)).alias("is_monotone"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman's rho of two columns over rows that have both, and their number.

    Ranks are joined with a histogram of the pairs; a table of few ranks is broadcast, so
    that a value which many rows share is no hot key.
    """
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = pairs.join(small(average_ranks(rows, a, "ra")), a).join(small(average_ranks(rows, b, "rb")), b)
    n, x, y = F.col("n"), F.col("ra"), F.col("rb")
    mean = (F.sum(n) + 1) / 2
    sums = ranked.agg(F.sum(n).alias("n"), mean.alias("m"), F.sum(n * x * y).alias("xy"), F.sum(n * x * x).alias("xx"), F.sum(n * y * y).alias("yy"))
    square = F.col("n") * F.col("m") * F.col("m")
    spread = (F.col("xx") - square) * (F.col("yy") - square)
    return sums.select(F.when(spread > 0, (F.col("xy") - square) / F.sqrt(spread)).alias("rho"), F.coalesce("n", F.lit(0)).alias("n"))
