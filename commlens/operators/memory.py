"""Memory generation: observations of a persona, and reflections over batches of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commlens.functions import prompts
from commlens.operators.experiment import reflection_batches
from commlens.operators.judging import ordinal

# Counts, the window in hours, importance of levels and of reflections.
OBSERVATIONS, WINDOW_HOURS, BATCH, REFLECTIONS = 15, 500.0, 5, 3
IMPORTANCE, DEFAULT_IMPORTANCE, REFLECTION_IMPORTANCE = {"low": 0.2, "medium": 0.5, "high": 0.9}, 0.5, 0.9
MEMORY = ["persona_id", "position", "text", "importance", "hours_ago", "kind"]


def linear_spread(place: Column, n: Column, window: float = WINDOW_HOURS) -> Column:
    """From the whole window for place 0 down to 0 for the last of n."""
    return F.lit(window) * (1 - place / F.greatest(n - 1, F.lit(1)))


def observations(responses: DataFrame, n: int = OBSERVATIONS) -> DataFrame:
    """The first n observations of each reply (persona_id, parsed), oldest first; those without text are left out."""
    raw = F.slice(F.coalesce(F.from_json("parsed", "observations array<struct<text:string,importance:string>>")["observations"], F.array()), 1, n)
    x = responses.select("persona_id", raw.alias("raw"))
    made = F.transform("raw", lambda e, i: F.struct(F.trim(e["text"]).alias("text"), ordinal(e["importance"], IMPORTANCE, DEFAULT_IMPORTANCE).alias("importance"), linear_spread(i, F.size("raw")).alias("hours_ago")))
    kept = F.filter(made, lambda m: F.coalesce(m["text"], F.lit("")) != "")
    rows = x.select("persona_id", F.posexplode(kept).alias("position", "m"))
    return rows.select("persona_id", "position", "m.text", "m.importance", "m.hours_ago", F.lit("observation").alias("kind"))


def reflection_prompts(items: DataFrame, size: int = BATCH, n: int = REFLECTIONS) -> DataFrame:
    """persona_id, batch, hours_ago of its newest item, prompt; of full batches only."""
    full = reflection_batches(items, "persona_id", "position", size)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda m: m["text"])  # ``size`` items
    groups = full.groupBy("persona_id", "batch").agg(F.min("hours_ago").alias("hours_ago"), listed.alias("texts"))
    return groups.select("persona_id", "batch", "hours_ago", F.concat(F.lit(prompts.REFLECTIONS.format(n=n) + "\n- "), F.array_join("texts", "\n- ")).alias("prompt"))


def reflections(replies: DataFrame, n: int = REFLECTIONS) -> DataFrame:
    """Items of (persona_id, batch, hours_ago, parsed): as recent as the newest one of their batch."""
    raw = F.slice(F.coalesce(F.from_json("parsed", "reflections array<string>")["reflections"], F.array().cast("array<string>")), 1, n)
    kept = F.filter(F.transform(raw, lambda t: F.trim(t)), lambda t: F.coalesce(t, F.lit("")) != "")
    rows = replies.select("persona_id", "batch", "hours_ago", F.posexplode(kept).alias("place", "text"))
    position = (F.lit(OBSERVATIONS) + F.col("batch") * n + F.col("place")).cast("int")
    return rows.select("persona_id", position.alias("position"), "text", F.lit(REFLECTION_IMPORTANCE).alias("importance"), "hours_ago", F.lit("reflection").alias("kind"))


def generate(personas: DataFrame, answer: Callable[[DataFrame], DataFrame], n: int = OBSERVATIONS) -> DataFrame:
    """Each persona's memory; ``answer`` adds ``parsed`` to rows with a prompt."""
    ask = prompts.fill(prompts.OBSERVATIONS, rank_label=F.col("rank_label"), department=F.col("department"), n=F.lit(n))
    seen = observations(answer(personas.select("persona_id", ask.alias("prompt"))), n)
    return seen.select(MEMORY).unionByName(reflections(answer(reflection_prompts(seen))).select(MEMORY))
