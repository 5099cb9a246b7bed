"""Rubric scoring and origin rating of messages, by the cache-first run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commlens.functions.text import deterministic_choice
from commlens.operators.runs import request_key

# The rubric's items by group, and the scale.
FIDELITY = ["role_consistency", "contextual_fit", "corpus_plausibility"]
PERFORMANCE = ["clarity", "politeness_appropriateness", "conflict_management"]
SCALE = [1, 2, 3, 4, 5]
# The order of the items in each phrasing of the rubric.
VARIANTS = {"neutral": FIDELITY + PERFORMANCE, "reordered": PERFORMANCE[::-1] + FIDELITY[::-1], "role_framed": FIDELITY + PERFORMANCE}
# Levels as numbers.
ORDINAL = {"low": 1, "medium": 2, "high": 3}
OPENERS = {"neutral": "Rate the message on each item.", "reordered": "Read the message, then rate it on each item.", "role_framed": "As the person who receives the message, rate it on each item."}
ORIGIN = "Was this message written for a study (1) or taken from an archive (5)? Quote evidence, then rate from 1 to 5."


def ordinal(value: Column, codes: dict[str, float] = ORDINAL, default: float | None = None) -> Column:
    """A level's number; null (or the default) for others."""
    out = F.lit(default).cast("double")
    for k, v in codes.items():
        out = F.when(value == k, float(v)).otherwise(out)
    return out


def rubric(variant: Column) -> Column:
    """The rubric's text in one of its phrasings; an unknown one is an error."""
    out = F.raise_error(F.concat(F.lit("unknown variant "), F.coalesce(variant, F.lit("null")))).cast("string")
    for name, keys in VARIANTS.items():
        out = F.when(variant == name, "\n".join([OPENERS[name], *(f"- {k}: 1 to 5" for k in keys)])).otherwise(out)
    return out


def _requests(items: DataFrame, system: Column, provider: str, model: str, max_tokens: int, replicate: int) -> DataFrame:
    user = F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))
    return items.select(
        "*", F.lit(provider).alias("provider"), F.lit(model).alias("model"), system.alias("system"), F.array(user).alias("messages"),
        F.lit(max_tokens).alias("max_tokens"), F.lit(None).cast("string").alias("output_schema"), F.lit(replicate).alias("variant"),
    ).withColumn("key", request_key())


def rubric_requests(items: DataFrame, provider: str, model: str, replicate: int = 1) -> DataFrame:
    """One request an item (item_id, text, phrasing): the rubric is the cached system prompt."""
    return _requests(items, rubric(F.col("phrasing")), provider, model, 1024, replicate)


def origin_requests(items: DataFrame, provider: str, model: str, replicate: int = 1) -> DataFrame:
    """One request an item (item_id, text): the judge never sees the true origin."""
    return _requests(items, F.lit(ORIGIN), provider, model, 512, replicate)


def stub_scores(requests: DataFrame) -> DataFrame:
    """key, response: deterministic scores for every rubric item."""
    one = lambda k: F.struct(F.lit("made offline").alias("evidence"), deterministic_choice(F.concat("key", F.lit(k)), SCALE).alias("score"))
    parsed = F.to_json(F.struct(*[one(k).alias(k) for k in VARIANTS["neutral"]]))
    return _response(requests, parsed)


def stub_origins(requests: DataFrame) -> DataFrame:
    """key, response: a deterministic rating."""
    return _response(requests, F.to_json(F.struct(F.lit("made offline").alias("evidence"), deterministic_choice(F.col("key"), SCALE).alias("likely_origin"))))


def _response(requests: DataFrame, parsed: Column) -> DataFrame:
    zero = F.lit(0).cast("long")
    fields = [parsed.alias("parsed"), F.concat(F.lit("stub-"), "model").alias("model"), zero.alias("input_tokens"), zero.alias("cache_creation_input_tokens"), zero.alias("cache_read_input_tokens"), zero.alias("output_tokens")]
    return requests.select("key", F.struct(*fields).alias("response"))


def rubric_scores(done: DataFrame, *keep: str) -> DataFrame:
    """One row an item with scores and evidence as maps, and is_valid: every rubric item has evidence and a score of the scale."""
    entries = F.from_json("response.parsed", "map<string,struct<score:int,evidence:string>>")
    x = done.select(*keep, "from_cache", entries.alias("e"))
    # the parsed reply stands in the test once, so that a filter on it parses once
    fine = F.map_filter("e", lambda k, v: k.isin(VARIANTS["neutral"]) & v["score"].isin(SCALE) & v["evidence"].isNotNull())
    return x.withColumn("is_valid", F.coalesce(F.size(fine) == len(VARIANTS["neutral"]), F.lit(False)))


def scores_long(scored: DataFrame, *keep: str) -> DataFrame:
    """One row for each valid item and rubric key: key, score, evidence."""
    entries = scored.where("is_valid").select(*keep, F.explode("e").alias("key", "v")).where(F.col("key").isin(VARIANTS["neutral"]))
    return entries.select(*keep, "key", "v.score", "v.evidence")


def score_table(scored: DataFrame, *keep: str) -> DataFrame:
    """One row for each valid one, with score_* and evidence_* columns, straight from the map of its reply."""
    fields = [F.col("e")[k][v].alias(f"{v}_{k}") for k in VARIANTS["neutral"] for v in ("score", "evidence")]
    return scored.where("is_valid").select(*keep, *fields)


def origin_ratings(done: DataFrame, *keep: str) -> DataFrame:
    """likely_origin, evidence and is_valid of every item."""
    r = F.from_json("response.parsed", "likely_origin int, evidence string")
    x = done.select(*keep, "from_cache", r.alias("r")).select(*keep, "from_cache", "r.likely_origin", "r.evidence")
    return x.withColumn("is_valid", F.coalesce(F.col("likely_origin").isin(SCALE) & F.col("evidence").isNotNull(), F.lit(False)))


def scoring_summary(scored: DataFrame) -> DataFrame:
    """Requested, scored, invalid and cached items."""
    return scored.agg(F.count(F.lit(1)).alias("n_requested"), F.count_if("is_valid").alias("n_scored"), F.count_if(~F.col("is_valid")).alias("n_invalid"), F.count_if("from_cache").alias("n_from_cache"))


def require_paired(df: DataFrame, a: str, b: str) -> int:
    """The number of pairs; an error without any, or where one side lacks a value."""
    n, na, nb = df.agg(F.count(F.lit(1)), F.count(a), F.count(b)).first()
    if na != nb or na != n:
        raise ValueError(f"paired scores differ in number: {na} and {nb} of {n}")
    if not n:
        raise ValueError("no paired scores")
    return n
