"""URL filter by a character language-model ratio, in DataFrame operations only.

Domain rules give a verdict of their own, and the labels: URLs that a rule allows train
the accepting model, those that a rule blocks the rejecting one.  Both are variable-order
Markov models over characters with Witten-Bell smoothing: the probability of a character
after the longest context is mixed with that after the next shorter one, down to a
uniform base.  A URL that no rule fits is judged by the difference of its length-normalised
log-likelihoods, calibrated to the middle between the two classes' means weighted by their
spread (measured on the rule-labelled URLs).

N-gram probabilities are a table that is joined, never broadcast: it grows with the
corpus.  URLs are reduced to host and path first (the scheme, query and fragment say
nothing of the site), and every distinct one is scored once.

Null URLs and URLs without "://" have an empty host and path and are allowed (no evidence).
Without URLs of both classes every unruled URL is allowed.  Repeated URLs count as often as
they occur and get equal results; an empty table gives an empty table; ties (a URL at the cut)
are allowed.  Only page_id and url are read, so other columns may have any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commlens.llm.common import written

#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
ORDER = 4
#: Characters the uniform base knows; rarer ones share its last place.
ALPHABET = 256

_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    bare = F.regexp_extract(rest, r"(?s)\A([^?#]*)", 1)
    host = F.translate(F.regexp_extract(bare, r"(?s)\A([^/]*)", 1), _AZ, _az)
    path = F.regexp_extract(bare, r"(?s)\A[^/]*(.*)\z", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule (host and path together) that fits, and its verdict; else nulls."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [(((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)), h + p, v) for v, h, p in ordered]
    name = reduce(lambda out, x: F.when(x[0], x[1]).otherwise(out), reversed(fits), F.lit(None).cast("string"))
    verdict = reduce(lambda out, x: F.when(x[0], x[2]).otherwise(out), reversed(fits), F.lit(None).cast("string"))
    return name, verdict


def _grams(urls: DataFrame, order: int) -> DataFrame:
    """One row for each character of a URL, with its longest context before it."""
    padded = F.concat(F.lit("\u0002" * order), F.col("u"), F.lit("\u0003"))
    at = F.explode(F.sequence(F.lit(1), F.length("u") + 1)).alias("i")
    return urls.select("*", padded.alias("x"), at).select(*urls.columns, F.substr("x", F.col("i"), F.lit(order + 1)).alias("g")).drop("x")


def probabilities(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, llr: log ratio of the accepting to the rejecting model for every n-gram that occurs.

    ``urls`` holds u and the weights a and b (how many accepted and rejected URLs are u).
    """
    level = _grams(urls, order).groupBy("g").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    level = written(level)  # each level is read twice, and the next shorter one comes from it
    levels = {order: level}
    for k in range(order - 1, -1, -1):
        level = level.groupBy(F.substr("g", F.lit(2)).alias("g")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        level = written(level)
        levels[k] = level
    p = None
    for k in range(order + 1):
        grams = levels[k].withColumns({"h": F.substr("g", F.lit(1), F.lit(k)), "s": F.substr("g", F.lit(2))})
        heads = grams.groupBy("h").agg(*[F.sum(c).alias(f"n{c}") for c in "ab"], *[F.count_if(F.col(c) > 0).alias(f"k{c}") for c in "ab"])
        x = grams.join(heads, "h")
        if p is None:
            x = x.withColumns({"pa": F.lit(1.0 / ALPHABET), "pb": F.lit(1.0 / ALPHABET)})
        else:
            x = x.join(p.withColumnRenamed("g", "s"), "s")
        mixed = [F.when(F.col(f"n{c}") > 0, (F.col(c) + F.col(f"k{c}") * F.col(f"p{c}")) / (F.col(f"n{c}") + F.col(f"k{c}"))).otherwise(F.col(f"p{c}")).alias(f"p{c}") for c in "ab"]
        p = x.select("g", *mixed)
    return p.select("g", F.log(F.col("pa") / F.col("pb")).alias("llr"))


def judge(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict and llr of every page."""
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    ruled = parts.withColumns({"rule": rule, "verdict": verdict, "u": F.concat("host", "path")})
    distinct = ruled.groupBy("u").agg(F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("b"))
    distinct = written(distinct)
    # a row for each of a URL's n-grams meets its probability; their mean is the score.
    # Common n-grams have many rows on this side and one on the other: adaptive joins split them
    pieces = _grams(distinct, ORDER)
    scored = pieces.join(probabilities(distinct), "g").groupBy("u").agg(F.round(F.avg("llr"), 9).alias("llr"), F.first("a").alias("a"), F.first("b").alias("b"))
    moments = scored.agg(*[F.sum(F.col(c) * x).alias(f"{c}{n}") for c in "ab" for n, x in enumerate([F.lit(1.0), F.col("llr"), F.col("llr") * F.col("llr")])])
    spread = {c: F.sqrt(F.greatest(F.col(f"{c}2") / F.col(f"{c}0") - F.pow(F.col(f"{c}1") / F.col(f"{c}0"), 2), F.lit(1e-12))) for c in "ab"}
    middle = (F.col("a1") / F.col("a0") * spread["b"] + F.col("b1") / F.col("b0") * spread["a"]) / (spread["a"] + spread["b"])
    cut = moments.select(F.when((F.col("a0") > 0) & (F.col("b0") > 0), middle).alias("cut"))
    by_model = scored.crossJoin(F.broadcast(cut)).select("u", "llr", F.when(F.col("llr") < F.col("cut"), "block").otherwise("allow").alias("by_model"))
    # a URL without host is without evidence
    out = ruled.join(by_model, "u", "left")
    method = F.when(F.length("u") == 0, "allow").otherwise(F.coalesce("by_model", F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"), "llr")
