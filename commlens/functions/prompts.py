"""Prompt templates as column expressions.

A prompt has a stable prefix, equal for all cells of a cache group (persona and
direction), and a variable suffix (the scenario).  The wording is this package's own;
every template is a parameter of the functions that use it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How a direction is put into words.
DIRECTION_PHRASES = {"up": "to someone senior to you", "lateral": "to a peer at your own level", "down": "to someone junior to you"}

FRAMING = "Write one reply e-mail as the person described below."
ROLE = "You are a {rank_label} in the {department} department."
HABIT = "You write about {words} words and put a question in {questions} per cent of your sentences."
DECISIONS = "Your reply takes one decision: accept, decline, defer, escalate or none."
OUTPUT = "Answer as JSON with subject, body, decision, confidence and reasoning_brief."
MEMORY_HEADING = "What you remember:"
OBSERVATIONS = "You are a {rank_label} in the {department} department. List {n} small events of your last weeks at work, and how much each one matters: low, medium or high."
REFLECTIONS = "State at most {n} general conclusions from these events:"


def fill(template: str, **values: Column) -> Column:
    """The template with its {names} replaced; nulls as empty."""
    out: list[Column] = []
    rest = template
    while "{" in rest:
        before, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        out += [F.lit(before), F.coalesce(values[name].cast("string"), F.lit(""))]
    return F.concat(*out, F.lit(rest))


def direction(stimulus_rank: Column, replier_rank: Column) -> Column:
    """From the replier's place: a higher rank than the stimulus writes down, a lower one up."""
    return F.when(replier_rank > stimulus_rank, "down").when(replier_rank < stimulus_rank, "up").when(replier_rank == stimulus_rank, "lateral")


def direction_phrase(value: Column) -> Column:
    """The direction in words; an unknown one is an error."""
    phrase = F.lit(None).cast("string")
    for k, v in DIRECTION_PHRASES.items():
        phrase = F.when(value == k, v).otherwise(phrase)
    return F.coalesce(phrase, F.raise_error(F.concat(F.lit("unknown direction "), F.coalesce(value, F.lit("null")))).cast("string"))


def memory_query(rank_label: Column, department: Column, value: Column) -> Column:
    """What memories are retrieved against: the same for all scenarios of a cache group."""
    return F.concat(rank_label, F.lit(" in "), department, F.lit(", writing "), direction_phrase(value))


def memory_block(memories: Column) -> Column:
    """A list of remembered texts; null without any, so that its section is left out."""
    lines = F.concat(F.lit(MEMORY_HEADING), F.lit("\n- "), F.array_join(memories, "\n- "))
    return F.when(F.size(memories) > 0, lines)


def stable_prefix(persona: dict[str, Column], value: Column, memories: Column) -> Column:
    """All that is equal for a persona and direction; sections are parted by empty lines."""
    sections = [F.lit(FRAMING), fill(ROLE, **persona), fill(HABIT, **persona), F.lit(DECISIONS), memory_block(memories), F.concat(F.lit("You are writing "), direction_phrase(value), F.lit("."))]
    return F.concat_ws("\n\n", *sections)


def variable_suffix(scenario: Column) -> Column:
    return F.concat_ws("\n\n", scenario, F.lit(OUTPUT))


def estimated_tokens(*texts: Column) -> Column:
    """About four characters a token, at least one."""
    n = sum((F.length(F.coalesce(t, F.lit(""))) for t in texts), F.lit(0))
    return F.greatest(F.lit(1), F.floor(n / 4)).cast("long")
