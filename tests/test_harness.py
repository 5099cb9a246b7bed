"""Runs, batches, judging and memory on small fixtures."""

from __future__ import annotations

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from commlens.functions import prompts
from commlens.functions import text as T
from commlens.operators import judging as J
from commlens.operators import memory as Y
from commlens.operators import runs as R

def now():
    return F.lit("2001-01-01 00:00:00").cast("timestamp")


@pytest.fixture(scope="module")
def requests(spark):
    cells = spark.createDataFrame([(f"m__p{p}__s{s}__r{r}", f"m__p{p}__up", "m", f"p{p}", "up", f"s{s}", r) for p in range(2) for s in range(3) for r in (1, 2)], "cell_id string, cache_group string, model string, persona_id string, direction string, scenario_id string, replicate int")
    personas = spark.createDataFrame([(f"p{p}", "clerk", "legal", 80, 0.1) for p in range(2)], "persona_id string, rank_label string, department string, words int, questions double")
    scenarios = spark.createDataFrame([(f"s{s}", f'Reply to "{s}" – né?') for s in range(3)], "scenario_id string, scenario string")
    memories = spark.createDataFrame([("p1", "up", ["a", "b"])], "persona_id string, direction string, memories array<string>")
    return R.build_requests(cells, personas, scenarios, memories, "stub")


def test_keys_are_those_of_canonical_json(requests):
    for r in requests.collect():
        fields = {"v": 1, "provider": r.provider, "model": r.model, "system": r.system, "messages": [m.asDict() for m in r.messages], "max_tokens": r.max_tokens, "output_schema": None, "variant": r.variant}
        blob = json.dumps(fields, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert r.key == hashlib.sha256(blob.encode()).hexdigest()
    rows = requests.collect()
    assert len({r.key for r in rows}) == 12
    assert {r.system for r in rows if "__p0__" in r.cell_id} != {r.system for r in rows if "__p1__" in r.cell_id}
    assert all(len({r.system for r in rows if r.cache_group == g}) == 1 for g in {r.cache_group for r in rows})


def test_a_second_run_is_all_cached(spark, requests, tmp_path):
    from commlens.sources.tables import cache_entries

    empty = spark.createDataFrame([], f"key string, response struct<{R.RESPONSE}>")
    done = R.answered(requests, empty, R.stub_responses, "cell_id")
    assert R.run_totals(done).first().asDict() | {"n_cells": 12, "n_from_cache": 0, "n_generated": 12, "n_invalid": 0, "offline": True} == R.run_totals(done).first().asDict()
    path = str(tmp_path / "cache")
    R.put(R.new_entries(done, now()), path)
    cache = cache_entries(spark, path, f"struct<{R.RESPONSE}>")
    again = R.answered(requests, cache, R.stub_responses, "cell_id", cache_only=True)
    assert again.where("from_cache").count() == 12
    assert {(r.cell_id, r.response) for r in again.collect()} == {(r.cell_id, r.response) for r in done.collect()}
    with pytest.raises(R.CacheMissError):
        R.answered(requests, cache.limit(3), R.stub_responses, "cell_id", cache_only=True)


def test_requests_with_one_key_are_answered_once(spark, requests):
    twice = requests.unionByName(requests.withColumn("cell_id", F.concat(F.lit("z"), "cell_id")))
    empty = spark.createDataFrame([], f"key string, response struct<{R.RESPONSE}>")
    done = R.answered(twice, empty, R.stub_responses, "cell_id")
    assert {r.cell_id[0]: r.n for r in done.where("from_cache").groupBy(F.substring("cell_id", 1, 1).alias("cell_id")).agg(F.count(F.lit(1)).alias("n")).collect()} == {"z": 12}


class FakeClient:
    """Batches as tables in memory; the second one is slow, and one result has a foreign id."""

    def __init__(self, spark):
        self.spark, self.batches, self.slow = spark, {}, 1

    def submit_batch(self, rows):
        name = f"b{len(self.batches)}"
        self.batches[name] = rows.select("custom_id", "key").join(R.stub_responses(rows), "key").select("custom_id", "response").collect()
        return name

    def fetch_batch(self, name):
        if name == "b1" and self.slow:
            self.slow = 0
            return None
        kind = f"custom_id string, response struct<{R.RESPONSE}>"
        return self.spark.createDataFrame([tuple(r) for r in self.batches[name]] + [("c_nobody", self.batches[name][0][1])], kind)


def test_batches_are_submitted_collected_and_resumed(spark, requests, tmp_path):
    from commlens.sources.tables import cache_entries

    empty = spark.createDataFrame([], f"key string, response struct<{R.RESPONSE}>")
    client, folder, path = FakeClient(spark), str(tmp_path / "state"), str(tmp_path / "cache")
    state = R.submit(requests, empty, "cell_id", client, folder, "r1", size=5)
    assert state["batch_ids"] == ["b0", "b1", "b2"] and state["n_submitted"] == 12 and state == R.read_state(spark, folder, "r1")
    assert R.collect(state, client, requests, "cell_id", folder, path, now()) == {"written": 7, "pending_batches": 1, "missing": 2}
    state = R.read_state(spark, folder, "r1")  # as a new process would
    assert R.collect(state, client, requests, "cell_id", folder, path, now()) == {"written": 5, "pending_batches": 0, "missing": 1}
    assert R.collect(state, client, requests, "cell_id", folder, path, now())["written"] == 0
    cache = cache_entries(spark, path, f"struct<{R.RESPONSE}>")
    assert R.answered(requests, cache, R.stub_responses, "cell_id", cache_only=True).count() == 12
    assert R.submit(requests, cache, "cell_id", client, folder, "r2")["n_skipped_cached"] == 12


def test_colliding_custom_ids_are_refused(spark, monkeypatch):
    monkeypatch.setattr(R, "batch_chunks", lambda rows, uid, size: rows.select(uid, F.lit("c_same").alias("custom_id"), F.lit(0).alias("chunk")))
    with pytest.raises(ValueError, match="collision"):
        R.custom_ids(spark.createDataFrame([("a",), ("b",)], "cell_id string"), "cell_id")


def test_budget_models_and_provenance(spark, tmp_path):
    R.guard_budget(5.0, 5.0)
    with pytest.raises(R.BudgetExceededError):
        R.guard_budget(5.01, 5.0)
    known = spark.createDataFrame([("m", 100)], "model string, min_cacheable_tokens int")
    prefixes = spark.createDataFrame([("m", "x" * 400), ("m", "x" * 396)], "model string, prefix string")
    assert sorted((r.n_tokens, r.will_cache) for r in R.prefix_caches(prefixes, known, "prefix").collect()) == [(99, False), (100, True)]
    with pytest.raises(Exception, match="no recorded capabilities"):
        R.with_capabilities(spark.createDataFrame([("other",)], "model string"), known).collect()
    prices = spark.createDataFrame([("m", 1.0, 2.0)], "model string, rate_in double, rate_out double")
    calls = spark.createDataFrame([("n", 1, 1, 1)], "model string, n_calls int, input_tokens_each int, output_tokens_each int")
    with pytest.raises(Exception, match="no price"):
        R.project_cost(prices, calls).collect()
    assert R.config_hash({"b": 1, "a": {"x": 2}}) == hashlib.sha256(b'{"a":{"x":2},"b":1}').hexdigest()[:16]
    assert R.git_state(str(tmp_path)) == ("unknown", True)
    R.require_clean(("unknown", True), pilot=True)
    with pytest.raises(R.DirtyWorkingTreeError):
        R.require_clean(("unknown", True))
    assert R.manifest({"n_cells": 2}, "r", ("c", False), {}, ["b", "a"])["models"] == ["a", "b"]


def test_prompts(spark):
    one = spark.createDataFrame([("up", 3, 2)], "d string, a int, b int")
    assert one.select(prompts.memory_query(F.lit("clerk"), F.lit("legal"), F.col("d"))).first()[0] == "clerk in legal, writing to someone senior to you"
    assert one.select(prompts.direction(F.col("b"), F.col("a")), prompts.direction(F.col("a"), F.col("b")), prompts.direction(F.col("a"), F.col("a"))).first() == ("down", "up", "lateral")
    assert one.select(prompts.memory_block(F.array().cast("array<string>"))).first()[0] is None
    with pytest.raises(Exception, match="unknown direction"):
        one.select(prompts.direction_phrase(F.lit("sideways"))).collect()
    assert one.select(prompts.estimated_tokens(F.lit(None).cast("string"))).first()[0] == 1


def test_judging_skips_what_is_invalid(spark):
    good = {k: {"score": 3, "evidence": "e"} for k in J.VARIANTS["neutral"]}
    replies = [good, good | {"clarity": {"score": 6, "evidence": "e"}}, {k: v for k, v in good.items() if k != "clarity"}, good | {"clarity": {"score": 3}}, good | {"more": {"score": 9}}]
    done = spark.createDataFrame([(i, False, (json.dumps(r),)) for i, r in enumerate(replies)] + [(9, True, ("not json",))], "item_id int, from_cache boolean, response struct<parsed:string>")
    scored = J.rubric_scores(done, "item_id")
    assert {r.item_id for r in scored.where("is_valid").collect()} == {0, 4}
    assert J.scoring_summary(scored).first() == (6, 2, 4, 1)
    assert {r.score_clarity for r in J.score_table(scored, "item_id").collect()} == {3}
    with pytest.raises(Exception, match="unknown variant"):
        spark.range(1).select(J.rubric(F.lit("loud"))).collect()
    orders = {v: [line.split()[1][:-1] for line in spark.range(1).select(J.rubric(F.lit(v))).first()[0].split("\n")[1:]] for v in J.VARIANTS}
    assert orders["reordered"] == orders["neutral"][:2:-1] + orders["neutral"][2::-1] and orders["role_framed"] == orders["neutral"]


def test_paired_guard(spark):
    kind = "a double, b double"
    assert J.require_paired(spark.createDataFrame([(1.0, 2.0)], kind), "a", "b") == 1
    for rows in ([], [(1.0, None)]):
        with pytest.raises(ValueError):
            J.require_paired(spark.createDataFrame(rows, kind), "a", "b")


def test_memory_generation(spark):
    def answer(asked):
        made = F.to_json(F.struct(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.struct(F.concat(F.lit("t"), i.cast("string")).alias("text"), F.lit("high").alias("importance"))).alias("observations")))
        return asked.withColumn("parsed", made if "batch" not in asked.columns else F.lit('{"reflections": [" r1 ", "", "r2", "r3"]}'))

    people = spark.createDataFrame([("p", "clerk", "legal")], "persona_id string, rank_label string, department string")
    out = Y.generate(people, answer).orderBy("position").collect()
    seen, thought = [r for r in out if r.kind == "observation"], [r for r in out if r.kind == "reflection"]
    assert [r.text for r in seen] == [f"t{i}" for i in range(12)] and seen[0].hours_ago == 500 and seen[-1].hours_ago == 0 and {r.importance for r in seen} == {0.9}
    # two full batches of five, of whose three texts one is empty
    assert [(r.text, round(r.hours_ago, 6)) for r in thought] == [(t, round(seen[k].hours_ago, 6)) for k in (4, 9) for t in ("r1", "r2")]
    nothing = spark.createDataFrame([("p", None), ("q", "{}"), ("r", "broken")], "persona_id string, parsed string")
    assert Y.observations(nothing).count() == 0


def test_quoted_text_by_a_plain_statement_of_the_rule(spark):
    banners = [(r"^-+\s*Original Message\s*-+", re.I), (r"^-+\s*Forwarded by\b.*$", re.I), (r"^\s*_{10,}\s*$", 0), (r"^\s*-{10,}\s*$", 0), (r"^On\b.{0,160}\bwrote:\s*$", 0)]

    def plain(body):
        cuts = [m.start() for p, f in banners if (m := re.search(p, body, f | re.M))]
        for m in re.finditer(r"^\s*From:\s+\S.*$", body, re.M):
            after = body[m.end() : m.end() + 400].split("\n")[:4]
            if re.search(T.FROM_CONFIRM.replace("(?mdU)", ""), "\n".join(after), re.M):
                cuts.append(m.start())
                break
        return "\n".join(x for x in body[: min(cuts, default=len(body))].split("\n") if not re.match(r"\s*>", x))

    rng = random.Random(3)
    lines = ["From: a b", "From: x", "To: z", "  Sent: now", "Subject: ", "> q", "----- Original Message -----", "hello", "", "\t\r", "On Monday A wrote:", "x" * 390, "-----------", "From:", "Date: 1", " y", "--", " "]
    bodies = ["\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 12))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, b string")
    assert all(r.q == plain(bodies[r.i]) for r in df.select("i", T.strip_quoted(F.col("b")).alias("q")).collect())


def test_white_space_that_is_not_ascii(spark):
    one = lambda v, f: spark.createDataFrame([(v,)], "x string").select(f(F.col("x"))).first()[0]
    assert one("A   \x1cB ", T.collapse) == "a b"
    assert one("Text\n\t\r\nJo\n713-555-1234\r\n \r\na@b.com\r\n", T.clean_body) == "Text\n\t\r\nJo"
