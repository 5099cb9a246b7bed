"""Queries of the experiment harness over stand-in tables, and their SQL.

Personas are nations, scenarios come from regions, cells are the grid of the catalog; half
of the replies stand in a cache, the others come from the stub client.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from commlens.functions import prompts
from commlens.operators import judging as J
from commlens.operators import memory as Y
from commlens.operators import messages as M
from commlens.operators import runs as R
from commlens.operators import sampling as P
from commlens.operators import threads as H
from commlens.plans import catalog as C
from commlens.plans.catalog import query, read
from commlens.streaming import batches

_NN = "chr(10) || chr(10)"
_REQUESTS = f"""WITH p AS (SELECT n_name AS persona_id, r_name AS rank_label, n_nationkey * 10 AS words, n_regionkey AS questions, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey),
req AS (SELECT c.cell_id, c.cache_group, c.model, c.replicate AS variant, p.n_nationkey,
  'Write one reply e-mail as the person described below.' || {_NN} || 'You are a ' || rank_label || ' in the trade department.' || {_NN}
  || 'You write about ' || words || ' words and put a question in ' || questions || ' per cent of your sentences.' || {_NN}
  || 'Your reply takes one decision: accept, decline, defer, escalate or none.' || {_NN}
  || CASE WHEN n_nationkey % 2 = 0 THEN 'What you remember:' || chr(10) || '- ' || persona_id || chr(10) || '- ' || c.direction || {_NN} ELSE '' END
  || 'You are writing ' || CASE c.direction WHEN 'up' THEN 'to someone senior to you' WHEN 'down' THEN 'to someone junior to you' ELSE 'to a peer at your own level' END || '.' AS system,
  'Task ' || task_type || ', stakes ' || stakes || {_NN} || 'Answer as JSON with subject, body, decision, confidence and reasoning_brief.' AS content
  FROM {C._GRID_CELLS} c JOIN p USING (persona_id) JOIN {C._SCENARIOS} s USING (scenario_id)),
keyed AS (SELECT *, sha256('{{"max_tokens":2048,"messages":[{{"content":' || to_json(content) || ',"role":"user"}}],"model":"' || model || '","output_schema":null,"provider":"stub","system":' || to_json(system) || ',"v":1,"variant":' || variant || '}}') AS key FROM req)"""


def _requests(spark, sf_dir):
    regions = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("rank_label"))
    nations = read(spark, sf_dir, "nation").join(regions, "n_regionkey")
    personas = nations.select(F.col("n_name").alias("persona_id"), "rank_label", F.lit("trade").alias("department"), (F.col("n_nationkey") * 10).alias("words"), F.col("n_regionkey").alias("questions"))
    direction = F.explode(F.array(*[F.lit(d) for d in C._DIRECTIONS])).alias("direction")
    memories = nations.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("persona_id"), direction).withColumn("memories", F.array("persona_id", "direction"))
    scenarios = C._scenarios(spark, sf_dir).withColumn("scenario", F.concat(F.lit("Task "), "task_type", F.lit(", stakes "), "stakes"))
    return R.build_requests(C._grid(spark, sf_dir), personas, scenarios, memories, "stub")


@query(f"{_REQUESTS} SELECT cell_id, system, content FROM req")
def request_prompts(spark, sf_dir):
    return _requests(spark, sf_dir).select("cell_id", "system", F.col("messages")[0]["content"].alias("content"))


@query(f"{_REQUESTS} SELECT cell_id, key FROM keyed")
def cache_key(spark, sf_dir):
    return _requests(spark, sf_dir).select("cell_id", "key")


_CACHED = """{"subject":"s","body":"b","decision":"accept","confidence":"low"}"""
_BROKEN = """{"subject":"s","decision":"perhaps"}"""


def _run(spark, sf_dir):
    """The run: replicate 1 is cached (in part with broken replies); model-a is paid, model-b runs here."""
    requests = _requests(spark, sf_dir)
    parsed = F.when(F.startswith("cell_id", F.lit("model-a__A")), _BROKEN).otherwise(_CACHED).alias("parsed")
    usage = [F.lit(n).cast("long").alias(u) for n, u in zip((7, 3, 2, 5), R.USAGE, strict=True)]
    cache = requests.where("variant = 1").select("key", F.struct(parsed, F.lit("model-x").alias("model"), *usage).alias("response"))

    def answer(missing):
        made = R.stub_responses(missing).join(missing.select("key", "model"), "key")
        model = F.when(F.col("model") == "model-a", "model-a").otherwise(F.concat(F.lit("local/"), "model"))
        return made.select("key", F.struct("response.parsed", model.alias("model"), *[f"response.{u}" for u in R.USAGE]).alias("response"))

    return R.answered(requests, cache, answer, "cell_id")


_RUN = f"""{_REQUESTS}, seeded AS (SELECT *, variant = 1 AS from_cache, system || content || '|' || variant AS seed FROM keyed),
picked AS (SELECT *, {C._pick('seed', C.X.DECISIONS)} AS d, {C._pick("seed || 'c'", C.X.CONFIDENCES)} AS c FROM seeded),
done AS (SELECT cell_id, model, from_cache, NOT (from_cache AND cell_id LIKE 'model-a\\_\\_A%' ESCAPE '\\') AS is_valid,
  CASE WHEN from_cache THEN 'accept' ELSE d END AS decision, CASE WHEN from_cache THEN 'low' ELSE c END AS confidence,
  CASE WHEN from_cache THEN 'model-x' WHEN model = 'model-a' THEN model ELSE 'local/' || model END AS response_model,
  CASE WHEN from_cache THEN 7 ELSE greatest(1, length(system || content) // 4) END AS input_tokens, CASE WHEN from_cache THEN 3 ELSE 0 END AS cache_creation_input_tokens, CASE WHEN from_cache THEN 2 ELSE 0 END AS cache_read_input_tokens,
  CASE WHEN from_cache THEN 5 ELSE length('{{"subject":"Re: the item below","body":"My answer: ' || d || '","decision":"' || d || '","confidence":"' || c || '","reasoning_brief":"made offline"}}') // 4 END AS output_tokens FROM picked)"""


@query(f"{_RUN} SELECT cell_id, from_cache, decision, confidence, response_model, input_tokens, output_tokens FROM done WHERE is_valid")
def grid_run(spark, sf_dir):
    return R.results(_run(spark, sf_dir), "cell_id").select("cell_id", "from_cache", "decision", "confidence", "response_model", "input_tokens", "output_tokens")


@query(
    f"{_RUN} SELECT count(*) AS n_cells, count(*) FILTER (WHERE from_cache) AS n_from_cache, count(*) FILTER (WHERE NOT from_cache) AS n_generated, count(*) FILTER (WHERE NOT is_valid) AS n_invalid, bool_or(is_valid AND response_model LIKE 'local/%') AS offline, "
    + ", ".join(f"CAST(sum({u}) FILTER (WHERE is_valid) AS BIGINT) AS {u}" for u in R.USAGE)
    + " FROM done"
)
def run_totals(spark, sf_dir):
    return R.run_totals(_run(spark, sf_dir))


@query(
    f"{_RUN} SELECT model, from_cache OR response_model LIKE 'local/%' AS from_cache, count(*) AS calls, round(sum(CASE WHEN from_cache OR response_model LIKE 'local/%' THEN 0 ELSE (input_tokens * 3 + output_tokens * 15) / 1e6 END), 6) AS cost_usd FROM done WHERE is_valid GROUP BY 1, 2"
)
def run_ledger(spark, sf_dir):
    valid = R.results(_run(spark, sf_dir), "model")
    return R.ledger(valid, C._prices(spark), "r1", "simulate").groupBy("model", "from_cache").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))


@query(f"{_RUN} SELECT model, {', '.join(f'CAST(sum({u}) AS BIGINT) AS {u}' for u in R.USAGE)}, CAST(sum(input_tokens + cache_creation_input_tokens + cache_read_input_tokens) AS BIGINT) AS total_input_tokens FROM done WHERE is_valid GROUP BY 1")
def usage_totals(spark, sf_dir):
    return R.usage_totals(R.results(_run(spark, sf_dir), "model"), "model")


@query("SELECT p_partkey, m AS model, m LIKE 'stub-%' AS is_stub, m LIKE 'local/%' AS is_local, NOT (m LIKE 'stub-%' OR m LIKE 'local/%') AND p_size > 10 AS is_billable FROM (SELECT p_partkey, p_size, CASE p_partkey % 3 WHEN 0 THEN 'stub-' WHEN 1 THEN 'local/' ELSE 'x' END || p_brand AS m FROM part)")
def provenance_flags(spark, sf_dir):
    k = F.col("p_partkey") % 3
    model = F.concat(F.when(k == 0, "stub-").when(k == 1, "local/").otherwise("x"), "p_brand")
    x = read(spark, sf_dir, "part").select("p_partkey", model.alias("model"), (F.col("p_size") <= 10).alias("cached"))
    return x.select("p_partkey", "model", R.is_stub(F.col("model")).alias("is_stub"), R.is_local(F.col("model")).alias("is_local"), R.is_billable(F.col("model"), F.col("cached")).alias("is_billable"))


@query(
    "WITH a AS (SELECT DISTINCT p_brand AS provider, p_type || p_size AS model FROM part), p AS (SELECT DISTINCT p_brand AS provider, p_type || '-' || p_size % 5 AS model FROM part) SELECT p.provider, p.model, coalesce(array_to_string(list_sort(list(a.model))[1:12], ','), '') AS suggestions FROM p LEFT JOIN a ON a.provider = p.provider AND starts_with(lower(a.model), lower(split_part(p.model, '-', 1))) GROUP BY 1, 2"
)
def model_suggestions(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    available = part.select(F.col("p_brand").alias("provider"), F.concat("p_type", "p_size").alias("model")).distinct()
    pinned = part.select(F.col("p_brand").alias("provider"), F.concat("p_type", F.lit("-"), F.col("p_size") % 5).alias("model")).distinct()
    return R.unavailable(pinned, available)


@query(f"{_REQUESTS} SELECT cell_id, greatest(1, length(system) // 4) AS n_tokens, greatest(1, length(system) // 4) >= CASE model WHEN 'model-a' THEN 80 ELSE 90 END AS will_cache FROM req")
def prefix_floor(spark, sf_dir):
    floors = spark.createDataFrame([("model-a", 80), ("model-b", 90)], "model string, min_cacheable_tokens int")
    return R.prefix_caches(_requests(spark, sf_dir), floors, "system").select("cell_id", "n_tokens", "will_cache")


@query("SELECT doc_id, greatest(1, length(coalesce(text, '')) // 4) AS n_tokens FROM documents")
def token_estimate(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", prompts.estimated_tokens(F.col("text")).alias("n_tokens"))


@query(f"SELECT model, round((sum(length(cell_id)) * i + count(*) * 100 * o) / 1e6 * 0.5, 6) AS projected_usd FROM {C._GRID_CELLS} JOIN (VALUES ('model-a', 3.0, 15.0), ('model-b', 1.0, 5.0)) r(model, i, o) USING (model) GROUP BY 1, i, o")
def projected_cost(spark, sf_dir):
    calls = C._grid(spark, sf_dir).groupBy("model").agg(F.count(F.lit(1)).alias("n_calls"), (F.sum(F.length("cell_id")) / F.count(F.lit(1))).alias("input_tokens_each"), F.lit(100).alias("output_tokens_each"))
    return R.project_cost(C._prices(spark), calls, batch=True).select("model", F.round("projected_usd", 6).alias("projected_usd"))


@query(
    "WITH ids AS (SELECT o_orderkey, 'c_' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 16) AS custom_id FROM orders), got AS (SELECT 'c_' || substr(sha256(CAST(l_orderkey AS VARCHAR) || CASE WHEN l_orderkey % 4 = 0 THEN 'x' ELSE '' END), 1, 16) AS custom_id FROM lineitem WHERE l_linenumber = 1) SELECT custom_id, o_orderkey, o_orderkey IS NOT NULL AS is_mapped FROM got LEFT JOIN ids USING (custom_id)"
)
def batch_collect(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey")
    name = F.concat(F.col("l_orderkey").cast("string"), F.when(F.col("l_orderkey") % 4 == 0, "x").otherwise(""))
    got = read(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(C.T.short_id(name).alias("custom_id"))
    return R.map_results(got, R.custom_ids(orders, "o_orderkey", 500), orders, "o_orderkey").select("custom_id", "o_orderkey", "is_mapped")


# every event is a request; its result comes after 0 to 29 hours, of each seventh never, of each fifth twice
_HOUR = 3_600_000
_CAME = f"""(SELECT event_id, event_type, event_id * 37 % 30 * {_HOUR} AS delay FROM events WHERE event_id % 7 <> 0)"""


@query(
    f"""WITH newest AS (SELECT max(t) AS t FROM (SELECT epoch_ms(ts) + CASE WHEN event_id % 7 <> 0 THEN event_id * 37 % 30 * {_HOUR} + CASE WHEN event_id % 5 = 0 THEN {_HOUR} ELSE 0 END ELSE 0 END AS t FROM events))
SELECT CAST(event_id AS VARCHAR) AS custom_id, CAST(event_id AS VARCHAR) AS uid, CASE WHEN delay <= 24 * {_HOUR} THEN 'collected' ELSE 'late' END AS status, event_type AS response, delay AS delay_ms FROM {_CAME}
UNION ALL SELECT CAST(event_id AS VARCHAR), CAST(event_id AS VARCHAR), 'repeated', event_type, delay + {_HOUR} FROM {_CAME} WHERE event_id % 5 = 0
UNION ALL SELECT CAST(event_id AS VARCHAR), CAST(event_id AS VARCHAR), 'missing', NULL, NULL FROM events, newest WHERE event_id % 7 = 0 AND epoch_ms(ts) + 24 * {_HOUR} < t
UNION ALL SELECT 'x' || event_id, NULL, 'unknown', event_type, NULL FROM events, newest WHERE event_id % 11 = 0 AND epoch_ms(ts) + 24 * {_HOUR} < t"""
)
def collected_results(spark, sf_dir):
    # the state machine of the stream, over all events
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    name = F.col("event_id").cast("string")
    later = lambda hours: F.timestamp_micros(F.unix_micros("ts") + hours * F.lit(_HOUR * 1000))
    hours = F.col("event_id") * 37 % 30
    result = lambda id_, created: (id_.alias("custom_id"), F.col("event_type").alias("response"), created.alias("created"))
    came = e.where("event_id % 7 <> 0")
    results = came.select(*result(name, later(hours)))
    results = results.unionAll(came.where("event_id % 5 = 0").select(*result(name, later(hours + 1))))
    results = results.unionAll(e.where("event_id % 11 = 0").select(*result(F.concat(F.lit("x"), name), F.col("ts"))))
    return batches.collect_all(e.select(name.alias("custom_id"), name.alias("uid"), F.col("ts").alias("submitted")), results)


# ---- judging --------------------------------------------------------------------------

_ITEMS = "SELECT o_orderkey AS item_id, 'order ' || o_orderkey || ' ' || o_orderpriority AS text, CASE o_orderkey % 3 WHEN 0 THEN 'neutral' WHEN 1 THEN 'reordered' ELSE 'role_framed' END AS phrasing FROM orders"
_JUDGE_KEY = "sha256('{{\"max_tokens\":{n},\"messages\":[{{\"content\":' || to_json(text) || ',\"role\":\"user\"}}],\"model\":\"judge\",\"output_schema\":null,\"provider\":\"stub\",\"system\":' || to_json({system}) || ',\"v\":1,\"variant\":1}}')"
_KEYS = ["role_consistency", "contextual_fit", "corpus_plausibility", "clarity", "politeness_appropriateness", "conflict_management"]


def _rubric_sql(opener: str, keys: list[str]) -> str:
    return " || ".join([f"'{opener}'", *(f"chr(10) || '- {k}: 1 to 5'" for k in keys)])


_RUBRIC = f"CASE phrasing WHEN 'neutral' THEN {_rubric_sql('Rate the message on each item.', _KEYS)} WHEN 'reordered' THEN {_rubric_sql('Read the message, then rate it on each item.', _KEYS[:2:-1] + _KEYS[2::-1])} ELSE {_rubric_sql('As the person who receives the message, rate it on each item.', _KEYS)} END"


def _items(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    text = F.concat_ws(" ", F.lit("order"), "o_orderkey", "o_orderpriority")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), text.alias("text"), F.when(k == 0, "neutral").when(k == 1, "reordered").otherwise("role_framed").alias("phrasing"))


def _no_cache(spark):
    return spark.createDataFrame([], f"key string, response struct<{R.RESPONSE}>")


def _score_sql(k: str) -> str:
    return f"CAST(('0x' || substr(sha256(key || '{k}'), 1, 2)) AS INTEGER) % 5 + 1 AS score_{k}"


@query(f"SELECT item_id, {', '.join(_score_sql(k) for k in _KEYS)} FROM (SELECT item_id, {_JUDGE_KEY.format(n=1024, system=_RUBRIC)} AS key FROM ({_ITEMS}))")
def rubric_scores(spark, sf_dir):
    done = R.answered(J.rubric_requests(_items(spark, sf_dir), "stub", "judge"), _no_cache(spark), J.stub_scores, "item_id")
    return J.score_table(J.rubric_scores(done, "item_id"), "item_id").select("item_id", *[f"score_{k}" for k in _KEYS])


_ORIGIN = "'Was this message written for a study (1) or taken from an archive (5)? Quote evidence, then rate from 1 to 5.'"
_RATED = f"(SELECT item_id, CAST(('0x' || substr(sha256(key), 1, 2)) AS INTEGER) % 5 + 1 AS likely_origin FROM (SELECT item_id, {_JUDGE_KEY.format(n=512, system=_ORIGIN)} AS key FROM ({_ITEMS})))"


def _ratings(spark, sf_dir):
    done = R.answered(J.origin_requests(_items(spark, sf_dir), "stub", "judge"), _no_cache(spark), J.stub_origins, "item_id")
    return J.origin_ratings(done, "item_id")


@query(f"SELECT item_id, likely_origin FROM {_RATED}")
def origin_ratings(spark, sf_dir):
    return _ratings(spark, sf_dir).where("is_valid").select("item_id", "likely_origin")


@query(f"SELECT count(*) AS n_requested, count(*) FILTER (WHERE likely_origin <= 5) AS n_scored, 0::BIGINT AS n_invalid, 0::BIGINT AS n_from_cache FROM {_RATED}")
def scoring_summary(spark, sf_dir):
    return J.scoring_summary(_ratings(spark, sf_dir))


@query(
    "SELECT event_id, CASE WHEN json_valid(props) AND k BETWEEN 1 AND 5 THEN k END AS likely_origin, coalesce(json_valid(props) AND k BETWEEN 1 AND 5, FALSE) AS is_valid FROM (SELECT event_id, props, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"
)
def response_validate(spark, sf_dir):
    parsed = F.concat(F.lit('{"evidence":"e","likely_origin":'), F.coalesce(F.get_json_object("props", "$.k"), F.lit("null")), F.lit("}"))
    done = read(spark, sf_dir, "events").select("event_id", F.lit(False).alias("from_cache"), F.struct(parsed.alias("parsed")).alias("response"))
    return J.origin_ratings(done, "event_id").select("event_id", F.when(F.col("is_valid"), F.col("likely_origin")).alias("likely_origin"), "is_valid")


@query("SELECT o_orderkey, CAST(CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 3 WHEN '2' THEN 3 WHEN '3' THEN 2 WHEN '5' THEN 1 END AS DOUBLE) AS code FROM orders")
def ordinal_codes(spark, sf_dir):
    k = F.substring("o_orderpriority", 1, 1)
    level = F.when(k.isin("1", "2"), "high").when(k == "3", "medium").when(k == "5", "low").otherwise("none of these")
    return read(spark, sf_dir, "orders").select("o_orderkey", J.ordinal(level).alias("code"))


# ---- memory -------------------------------------------------------------------------------

_OBSERVED = "(SELECT c_custkey AS persona_id, row_number() OVER (PARTITION BY c_custkey ORDER BY i) - 1 AS position, 'e' || i AS text, CAST(CASE i % 4 WHEN 0 THEN 0.2 WHEN 1 THEN 0.5 WHEN 2 THEN 0.9 ELSE 0.5 END AS DOUBLE) AS importance, round(500 * (1 - i / greatest(least(c_custkey % 20, 15) - 1, 1)), 6) AS hours_ago FROM customer, unnest(range(least(c_custkey % 20, 15))) u(i) WHERE NOT (i = 1 AND c_custkey % 5 = 0))"


def _observed(spark, sf_dir):
    i = F.col("c_custkey") % 20
    level = lambda n: F.when(n % 4 == 0, "low").when(n % 4 == 1, "medium").when(n % 4 == 2, "high").otherwise("other")
    text = lambda n: F.when((n == 1) & (F.col("c_custkey") % 5 == 0), "  ").otherwise(F.concat(F.lit(" e"), n.cast("string")))
    entries = F.when(i > 0, F.transform(F.sequence(F.lit(0), i - 1), lambda n: F.struct(text(n).alias("text"), level(n).alias("importance"))))
    parsed = F.to_json(F.struct(entries.alias("observations")))
    return Y.observations(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("persona_id"), parsed.alias("parsed")))


@query(f"SELECT * FROM {_OBSERVED}")
def memory_observations(spark, sf_dir):
    return _observed(spark, sf_dir).select("persona_id", F.col("position").cast("long").alias("position"), "text", F.col("importance"), F.round("hours_ago", 6).alias("hours_ago"))


@query(
    f"SELECT persona_id, position // 5 AS batch, min(hours_ago) AS hours_ago, 'State at most 3 general conclusions from these events:' || chr(10) || '- ' || string_agg(text, chr(10) || '- ' ORDER BY position) AS prompt FROM {_OBSERVED} GROUP BY 1, 2 HAVING count(*) = 5"
)
def reflection_prompts(spark, sf_dir):
    return Y.reflection_prompts(_observed(spark, sf_dir)).withColumn("hours_ago", F.round("hours_ago", 6))


# ---- small operators ---------------------------------------------------------------------------


@query(
    "WITH x AS (SELECT 'box' || doc_id % 10 || '/' || CASE doc_id % 5 WHEN 0 THEN 'Sent' WHEN 1 THEN '_sent_mail' WHEN 2 THEN 'inbox' WHEN 3 THEN 'sent items' ELSE 'sent_old' END || '/' || doc_id AS path FROM documents) SELECT split_part(path, '/', 1) AS mailbox, count(*) AS n_sent FROM x WHERE lower(split_part(path, '/', 2)) IN ('sent', 'sent_items', '_sent_mail', 'sent items') GROUP BY 1"
)
def sent_folders(spark, sf_dir):
    k = F.col("doc_id") % 5
    folder = F.when(k == 0, "Sent").when(k == 1, "_sent_mail").when(k == 2, "inbox").when(k == 3, "sent items").otherwise("sent_old")
    path = F.concat(F.lit("box"), (F.col("doc_id") % 10).cast("string"), F.lit("/"), folder, F.lit("/"), F.col("doc_id").cast("string"))
    x = read(spark, sf_dir, "documents").select(path.alias("path"))
    return x.where(M.in_sent_folder(F.col("path"))).groupBy(C.T.path_part(F.col("path"), 1).alias("mailbox")).agg(F.count(F.lit(1)).alias("n_sent"))


@query("SELECT o_custkey % 10 AS mailbox, string_agg(DISTINCT lower(substr(o_orderpriority, 3)) || ' x', ';' ORDER BY lower(substr(o_orderpriority, 3)) || ' x') AS display_names FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def owner_names(spark, sf_dir):
    name = F.concat(F.lit("\""), F.substring("o_orderpriority", 3, 99), F.lit(",  X\" /OU=a <b@c.d>"))
    sent = read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select((F.col("o_custkey") % 10).alias("mailbox"), name.alias("name"))
    return M.owner_names(sent, "mailbox", "name").select("mailbox", F.array_join("display_names", ";").alias("display_names"))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey BETWEEN 1 AND 5")
def persona_filter(spark, sf_dir):
    return read(spark, sf_dir, "customer").where(P.in_persona_cells("c_mktsegment", "c_nationkey", ["BUILDING", "MACHINERY"], 1, 5)).select("c_custkey")


@query(f"SELECT bool_and(coalesce(mean >= before, TRUE)) AS is_monotone FROM (SELECT mean, lag(mean) OVER (ORDER BY r) AS before FROM (SELECT doc_id % 6 + 1 AS r, avg(power_score) AS mean FROM {C._POWER} WHERE power_score IS NOT NULL GROUP BY 1))")
def power_monotone(spark, sf_dir):
    ranked = C.S.score_by_rank(C._power(spark, sf_dir).withColumn("rank", F.col("doc_id") % 6 + 1), "rank", "power_score")
    return C.S.is_monotone(ranked, "rank", "mean")


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY 1")
def order_years(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy(C.T.year(F.col("o_orderdate")).alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH t AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, count(role) OVER (PARTITION BY conv_id) AS people FROM conversations), c AS (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT role) > 1), s AS (SELECT conv_id FROM c ORDER BY sha256(conv_id || '|{C._SEED}') LIMIT 12) SELECT conv_id, 'THREAD ' || conv_id || '  (' || max(n) || ' messages)   [ ] CORRECT  [ ] WRONG' || chr(10) || string_agg('  ' || lpad(CAST(turn AS VARCHAR), 2, ' ') || '. ' || role, chr(10) ORDER BY turn) AS block FROM t SEMI JOIN s USING (conv_id) GROUP BY 1"
)
def thread_review(spark, sf_dir):
    return H.review_sample(C._turns(spark, sf_dir), "conv_id", "turn", F.col("role"), 12, C._SEED)
