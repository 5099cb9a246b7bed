"""Experiment runs: requests, the cache-first run with its ledger and totals, batches, budget.

A request is a row with the columns of ``REQUEST``; a cached response is (key, response).
Nothing here loops over cells: a run is joins and aggregations of whole tables.
"""

from __future__ import annotations

import hashlib
import json
import subprocess
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commlens.functions import prompts
from commlens.functions import text as T
from commlens.operators.experiment import CONFIDENCES, DECISIONS, batch_chunks, cost_usd
from commlens.session import durable
from commlens.sources.cache import put
from commlens.sources.stores import open_store

FORMAT_VERSION, MAX_OUTPUT_TOKENS, MAX_BATCH = 1, 2048, 10_000
REQUEST = ["provider", "model", "system", "messages", "max_tokens", "output_schema", "variant"]
USAGE = ["input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "output_tokens"]
RESPONSE = "parsed string, model string, input_tokens long, cache_creation_input_tokens long, cache_read_input_tokens long, output_tokens long"
# What a model's id begins with if no provider was paid.
STUB_PREFIX, LOCAL_PREFIX = "stub-", "local/"


class CacheMissError(RuntimeError):
    """A run that may only use the cache lacks a response."""


class BudgetExceededError(RuntimeError):
    """The projected cost is above the ceiling."""


class DirtyWorkingTreeError(RuntimeError):
    """A run that is no pilot starts from code that isn't committed."""


# ---- requests ----------------------------------------------------------------------


def request_key() -> Column:
    """sha256 of the canonical JSON of all that reaches the provider, and the draw (variant)."""
    messages = F.transform("messages", lambda m: F.struct(m["content"].alias("content"), m["role"].alias("role")))
    return T.cache_key({c: F.col(c) for c in REQUEST if c != "messages"} | {"messages": messages, "v": F.lit(FORMAT_VERSION)})


def build_requests(cells: DataFrame, personas: DataFrame, scenarios: DataFrame, memories: DataFrame, provider: str, output_schema: str | None = None, max_tokens: int = MAX_OUTPUT_TOKENS) -> DataFrame:
    """One request a cell: prefix by persona, direction and memories; suffix by scenario.

    memories: (persona_id, direction, memories array<string>), retrieved once a cache group;
    personas: (persona_id, rank_label, department, words, questions); scenarios:
    (scenario_id, scenario).  The replicate is the draw, so that replicates don't share a key.
    """
    x = cells.join(personas, "persona_id").join(scenarios.select("scenario_id", "scenario"), "scenario_id").join(memories, ["persona_id", "direction"], "left")
    persona = {c: F.col(c) for c in ("rank_label", "department", "words", "questions")}
    system = prompts.stable_prefix(persona, F.col("direction"), F.col("memories"))
    user = F.struct(F.lit("user").alias("role"), prompts.variable_suffix(F.col("scenario")).alias("content"))
    return x.select(
        "cell_id", "cache_group", F.lit(provider).alias("provider"), "model", system.alias("system"), F.array(user).alias("messages"),
        F.lit(max_tokens).alias("max_tokens"), F.lit(output_schema).cast("string").alias("output_schema"), F.col("replicate").alias("variant"),
    ).withColumn("key", request_key())


def stub_responses(requests: DataFrame) -> DataFrame:
    """key, response of a deterministic stand-in client, as pure column expressions."""
    prompt = F.concat(F.coalesce("system", F.lit("")), F.array_join(F.transform("messages", lambda m: m["content"]), ""))
    seed = F.concat(prompt, F.lit("|"), F.col("variant").cast("string"))
    decision = T.deterministic_choice(seed, DECISIONS)
    payload = F.struct(
        F.lit("Re: the item below").alias("subject"), F.concat(F.lit("My answer: "), decision).alias("body"), decision.alias("decision"),
        T.deterministic_choice(F.concat(seed, F.lit("c")), CONFIDENCES).alias("confidence"), F.lit("made offline").alias("reasoning_brief"),
    )
    x = requests.select("key", F.concat(F.lit(STUB_PREFIX), "model").alias("model"), F.to_json(payload).alias("parsed"), prompts.estimated_tokens(prompt).alias("input_tokens"))
    usage = [F.lit(0).cast("long").alias("cache_creation_input_tokens"), F.lit(0).cast("long").alias("cache_read_input_tokens"), F.floor(F.length("parsed") / 4).alias("output_tokens")]
    return x.select("key", F.struct("parsed", "model", "input_tokens", *usage).alias("response"))


# ---- running -----------------------------------------------------------------------


def is_stub(model: Column) -> Column:
    return F.startswith(model, F.lit(STUB_PREFIX))


def is_local(model: Column) -> Column:
    return F.startswith(model, F.lit(LOCAL_PREFIX))


def is_billable(model: Column, from_cache: Column) -> Column:
    """Neither cached nor made by the stub or on this machine."""
    return ~from_cache & ~is_stub(model) & ~is_local(model)


def require_cached(requests: DataFrame, cache: DataFrame) -> None:
    """An error if any request has no cached response."""
    missing = requests.select("key").distinct().join(cache.select("key"), "key", "left_anti")
    if n := missing.count():
        raise CacheMissError(f"{n} responses are not in the cache, such as {missing.first()[0]}")


def answered(requests: DataFrame, cache: DataFrame, answer: Callable[[DataFrame], DataFrame], uid: str, cache_only: bool = False) -> DataFrame:
    """Every request with its response and from_cache.

    ``answer`` gets each missing key once; of the requests that share it, the first one in
    the order of ``uid`` paid for it and the others find it in the cache.  The requests are
    written first, so that prompts and keys are made once and the joins on keys read no texts.
    """
    requests = durable(requests)
    if cache_only:
        require_cached(requests, cache)
    first = requests.groupBy("key").agg(F.min(uid).alias("first_uid"))
    held = cache.select("key", "response")
    # by key and id: a key that many requests share is no hot one
    paying = first.join(held, "key", "left_anti").withColumnRenamed("first_uid", uid)
    missing = requests.join(paying, ["key", uid], "left_semi").dropDuplicates(["key"])
    known = held.withColumn("cached", F.lit(True)).unionByName(answer(missing).select("key", "response").withColumn("cached", F.lit(False)))
    out = requests.join(known.join(first, "key"), "key")
    return out.withColumn("from_cache", F.col("cached") | (F.col(uid) != F.col("first_uid"))).drop("cached", "first_uid")


def new_entries(done: DataFrame, created: Column) -> DataFrame:
    """What a run adds to the cache: key, created, the whole request, the response."""
    return done.where(~F.col("from_cache")).select("key", created.alias("created"), F.struct(*REQUEST).alias("request"), "response")


def parsed_reply(parsed: Column) -> tuple[Column, Column]:
    """The fields of a reply, and whether it is valid: keys present, decision and confidence in their domain."""
    r = F.from_json(parsed, "subject string, body string, decision string, confidence string")
    ok = r["subject"].isNotNull() & r["body"].isNotNull() & r["decision"].isin(DECISIONS) & r["confidence"].isin(CONFIDENCES)
    return r, F.coalesce(ok, F.lit(False))


def with_validity(done: DataFrame) -> DataFrame:
    """The fields of each reply (r) and is_valid."""
    r, ok = parsed_reply(F.col("response.parsed"))
    return done.withColumn("r", r).withColumn("is_valid", ok)


def results(done: DataFrame, *keep: str) -> DataFrame:
    """Rows of the valid replies."""
    return with_validity(done).where("is_valid").select(*keep, F.col("response.model").alias("response_model"), "from_cache", "r.subject", "r.body", "r.decision", "r.confidence", *[f"response.{u}" for u in USAGE])


def ledger(valid: DataFrame, prices: DataFrame, run_id: str, kind: str) -> DataFrame:
    """Ledger rows of valid replies (model, response_model, from_cache and usage); what was not paid costs 0."""
    paid = is_billable(F.col("response_model"), F.col("from_cache"))
    x = valid.withColumn("_paid", paid).withColumnsRenamed({"cache_creation_input_tokens": "cache_write_tokens", "cache_read_input_tokens": "cache_read_tokens"})
    priced = cost_usd(x.where("_paid"), prices, F.lit(False)).unionByName(x.where("NOT _paid").withColumn("cost_usd", F.lit(0.0)))
    return priced.select(
        F.lit(run_id).alias("run_id"), "model", F.when(is_stub(F.col("response_model")), f"{kind}-stub").otherwise(kind).alias("call_kind"), (~F.col("_paid")).alias("from_cache"),
        "input_tokens", F.col("cache_write_tokens").alias("cache_creation_input_tokens"), F.col("cache_read_tokens").alias("cache_read_input_tokens"), "output_tokens", "cost_usd",
    )


def usage_totals(rows: DataFrame, *by: str) -> DataFrame:
    """Sums of every usage field, and all input tokens however they were billed."""
    sums = [F.coalesce(F.sum(u), F.lit(0)).alias(u) for u in USAGE]
    return rows.groupBy(*by).agg(*sums).withColumn("total_input_tokens", F.col(USAGE[0]) + F.col(USAGE[1]) + F.col(USAGE[2]))


def run_totals(done: DataFrame) -> DataFrame:
    """One row: counts, whether any reply was made offline, usage of the valid replies."""
    x = with_validity(done)
    model = F.col("response.model")
    sums = [F.coalesce(F.sum(F.when(F.col("is_valid"), F.col(f"response.{u}"))), F.lit(0)).alias(u) for u in USAGE]
    counts = {"n_cells": F.lit(True), "n_from_cache": F.col("from_cache"), "n_generated": ~F.col("from_cache"), "n_invalid": ~F.col("is_valid")}
    offline = F.coalesce(F.bool_or(F.col("is_valid") & (is_stub(model) | is_local(model))), F.lit(False))
    return x.agg(*[F.count_if(c).alias(n) for n, c in counts.items()], offline.alias("offline"), *sums)


def manifest(totals: dict, run_id: str, commit: tuple[str, bool], config: dict, models: list[str], **more) -> dict:
    """Where a set of results came from."""
    return {"run_id": run_id, "git_commit": commit[0], "git_dirty": commit[1], "config_hash": config_hash(config), "models": sorted(models), **totals, **more}


def write_manifest(record: dict, path: str) -> None:
    """A run's manifest as JSON with sorted keys, in whatever store the path names."""
    store, base = open_store(path)
    store.create_dir(base.rpartition("/")[0])
    with store.open_output_stream(base) as f:
        f.write(json.dumps(record, indent=2, sort_keys=True, default=str).encode() + b"\n")


# ---- batches -----------------------------------------------------------------------


def custom_ids(requests: DataFrame, uid: str, size: int = MAX_BATCH) -> DataFrame:
    """uid, custom_id, chunk; an error if two ids share a custom id."""
    ids = batch_chunks(requests, uid, size)
    clash = ids.groupBy("custom_id").agg(F.countDistinct(uid).alias("n"), F.min(uid).alias("a"), F.max(uid).alias("b")).where("n > 1").first()
    if clash:
        raise ValueError(f"custom id collision: {clash.a!r} and {clash.b!r} -> {clash.custom_id}")
    return ids


def submit(requests: DataFrame, cache: DataFrame, uid: str, client, folder: str, run_id: str, size: int = MAX_BATCH) -> dict:
    """Hand every uncached request to ``client.submit_batch`` in chunks; the state, on record after each chunk.

    The id mapping is a table beside the state; both lie below ``folder``.
    """
    open_ = requests.join(cache.select("key").distinct(), "key", "left_anti")
    ids = custom_ids(open_, uid, size)
    ids.write.mode("overwrite").parquet(f"{folder}/{run_id}/ids")
    ids = requests.sparkSession.read.parquet(f"{folder}/{run_id}/ids")
    n, sizes = requests.count(), {r["chunk"]: r["count"] for r in ids.groupBy("chunk").count().collect()}  # a row a chunk
    # requests meet their chunk once; each batch reads its own folder
    rows = open_.join(ids, uid)
    rows.write.mode("overwrite").partitionBy("chunk").parquet(f"{folder}/{run_id}/requests")
    rows = requests.sparkSession.read.schema(rows.schema).parquet(f"{folder}/{run_id}/requests")
    state = {"run_id": run_id, "batch_ids": [], "collected_batch_ids": [], "n_submitted": 0, "n_skipped_cached": n - sum(sizes.values())}
    write_state(requests.sparkSession, state, folder)
    for k in sorted(sizes):
        state["batch_ids"].append(client.submit_batch(rows.where(F.col("chunk") == k).drop("chunk")))
        state["n_submitted"] += sizes[k]
        write_state(requests.sparkSession, state, folder)
    return state


def map_results(results: DataFrame, ids: DataFrame, requests: DataFrame, uid: str) -> DataFrame:
    """(custom_id, response) with the request it answers; is_mapped is false where there is none."""
    known = ids.select("custom_id", uid).join(requests, uid)
    return results.join(known, "custom_id", "left").withColumn("is_mapped", F.col(uid).isNotNull())


def collect(state: dict, client, requests: DataFrame, uid: str, folder: str, cache_path: str, created: Column) -> dict[str, int]:
    """Put the responses of finished batches into the cache; may be called again until all have come."""
    spark = requests.sparkSession
    ids = spark.read.parquet(f"{folder}/{state['run_id']}/ids")
    counts = {"written": 0, "pending_batches": 0, "missing": 0}
    for batch_id in [b for b in state["batch_ids"] if b not in state["collected_batch_ids"]]:
        got = client.fetch_batch(batch_id)
        if got is None:
            counts["pending_batches"] += 1
            continue
        # written, as the cache and the counts both read it
        mapped = f"{folder}/{state['run_id']}/mapped/{len(state['collected_batch_ids'])}"
        map_results(got, ids, requests, uid).write.mode("overwrite").parquet(mapped)
        mapped = spark.read.parquet(mapped)
        fine = mapped.where("is_mapped")
        put(fine.select("key", created.alias("created"), F.struct(*REQUEST).alias("request"), "response"), cache_path)
        n = mapped.agg(F.count_if("is_mapped"), F.count_if(~F.col("is_mapped"))).first()
        counts["written"] += n[0]
        counts["missing"] += n[1]
        state["collected_batch_ids"].append(batch_id)
        write_state(spark, state, folder)
    return counts


def write_state(spark: SparkSession, state: dict, folder: str) -> None:
    """The state of a submission as one JSON line."""
    spark.createDataFrame([(json.dumps(state, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{state['run_id']}/state")


def read_state(spark: SparkSession, folder: str, run_id: str) -> dict:
    """A submission's state, in a new process too."""
    return json.loads(spark.read.text(f"{folder}/{run_id}/state").first()[0])


# ---- budget, models, provenance ----------------------------------------------------


def project_cost(prices: DataFrame, calls: DataFrame, batch: bool = False) -> DataFrame:
    """model, projected_usd of (model, n_calls, input_tokens_each, output_tokens_each), without cache reads."""
    zero = F.lit(0)
    usage = calls.withColumns({"input_tokens": F.col("input_tokens_each") * F.col("n_calls"), "output_tokens": F.col("output_tokens_each") * F.col("n_calls"), "cache_write_tokens": zero, "cache_read_tokens": zero})
    return cost_usd(usage, prices, F.lit(batch)).select("model", F.col("cost_usd").alias("projected_usd"))


def guard_budget(projected_usd: float, max_cost_usd: float) -> None:
    """An error, before anything is spent, if the projection is above the ceiling."""
    if projected_usd > max_cost_usd:
        raise BudgetExceededError(f"projected cost {projected_usd:.2f} USD is above the ceiling of {max_cost_usd:.2f} USD")


def with_capabilities(models: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Rows with their model's capabilities (model, min_cacheable_tokens, ...); an unknown model is an error."""
    x = models.join(F.broadcast(capabilities.withColumn("_known", F.lit(True))), "model", "left")  # a row a model
    unknown = F.raise_error(F.concat(F.lit("no recorded capabilities for "), F.coalesce("model", F.lit("null")))).cast("boolean")
    return x.where(F.coalesce("_known", unknown)).drop("_known")


def prefix_caches(prefixes: DataFrame, capabilities: DataFrame, prefix: str) -> DataFrame:
    """Estimated tokens of each prefix, and whether its model caches that many."""
    x = with_capabilities(prefixes, capabilities).withColumn("n_tokens", prompts.estimated_tokens(F.col(prefix)))
    return x.withColumn("will_cache", F.col("n_tokens") >= F.col("min_cacheable_tokens"))


def unavailable(pinned: DataFrame, available: DataFrame, limit: int = 12) -> DataFrame:
    """Pinned models (provider, model) that their provider doesn't list, with those of the same family.

    The family is what stands before the first hyphen.  Model lists are small tables.
    """
    missing = pinned.join(available, ["provider", "model"], "left_anti").withColumn("family", F.lower(F.split_part("model", F.lit("-"), F.lit(1))))
    listed = available.select(F.col("provider").alias("p"), F.col("model").alias("other"))
    near = missing.join(listed, (F.col("provider") == F.col("p")) & F.startswith(F.lower("other"), F.col("family")), "left")
    return near.groupBy("provider", "model").agg(F.array_join(F.slice(F.array_sort(F.collect_list("other")), 1, limit), ",").alias("suggestions"))


def config_hash(config: dict) -> str:
    """The first 16 digits of the sha256 of the configuration's canonical JSON."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def git_state(folder: str | None = None) -> tuple[str, bool]:
    """Commit and whether the working tree differs from it; unknown counts as differing."""
    try:
        ask = [subprocess.run(["git", *a], cwd=folder, check=True, capture_output=True, text=True).stdout.strip() for a in (["rev-parse", "HEAD"], ["status", "--porcelain"])]
    except (OSError, subprocess.CalledProcessError):
        return "unknown", True
    return ask[0], bool(ask[1])


def require_clean(state: tuple[str, bool], pilot: bool = False) -> None:
    """Only a pilot may run from a working tree that isn't committed."""
    if state[1] and not pilot:
        raise DirtyWorkingTreeError(f"uncommitted changes on {state[0]}: commit them or run a pilot")
