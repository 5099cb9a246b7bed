"""Registered queries over the driver's tables, and their SQL.

Mail concepts stand on stand-in tables: a message is an order (sender: customer), its
recipients are the suppliers of its lines, a body is a document's text, a thread's turns
are conversation turns, and the latency stream is events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from commlens.functions import text as T
from commlens.operators import experiment as X
from commlens.operators import features as S
from commlens.operators import messages as M
from commlens.operators import network as N
from commlens.operators import sampling as P
from commlens.operators import statistics as Z
from commlens.operators import threads as H
from commlens.session import bucketed, durable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# ---- text ---------------------------------------------------------------------


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS n_tokens FROM documents")
def token_counts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.token_count(F.col("text")).alias("n_tokens"))


# a body is the text on one line, with one of four tails: a forwarded message, quoted lines, a
# signature below its mark, contact lines without one
_W = r"[\p{L}\p{M}\p{N}_]"
_CONTACT_SQL = rf"(?i)\(\d{{3}}\)\s*\d{{3}}[-.\s]?\d{{4}}|(?:^|[^\p{{L}}\p{{M}}\p{{N}}_])(?:\d{{3}}[-.]\d{{3}}[-.]\d{{4}}|tel|telephone|fax|phone|mobile|cell|e-?mail|ext)(?:$|[^\p{{L}}\p{{M}}\p{{N}}_])|(?:{_W}|[.+-])+@(?:{_W}|[.-])+\.{_W}{{2,}}"


@query(
    rf"""WITH x AS (SELECT doc_id, doc_id % 4 AS k, regexp_replace(coalesce(text, ''), '\s+', ' ', 'g') AS line FROM documents)
SELECT doc_id, trim(CASE WHEN k = 1 THEN line || chr(10) || 'last words' WHEN regexp_matches(line, '{_CONTACT_SQL}') THEN '' ELSE line END, ' ' || chr(10)) AS body_clean FROM x"""
)
def clean_body(spark, sf_dir):
    line = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", " ")
    k = F.col("doc_id") % 4
    tails = ["\n----- Original Message -----\nold", "\n> quoted\nlast words", "\n-- \nJo\n713-555-1234", "\n\n713-555-1234\n \t\nme@b.com\n"]
    tail = F.element_at(F.array(*[F.lit(t) for t in tails]), (k + 1).cast("int"))
    body = F.concat(F.when(k == 1, "> first\n").otherwise(""), line, tail)
    return read(spark, sf_dir, "documents").select("doc_id", T.clean_body(body).alias("body_clean"))


@query(
    r"SELECT doc_id, lower(trim(regexp_replace(regexp_replace(split_part(text, chr(10), 1), '^(?:\s*(?:re|fw|fwd|aw|antw|tr|rv|sv|vs)\s*(?:\[\d+\])?\s*:\s*)+', '', 'i'), '\s+', ' ', 'g'))) AS subject_norm FROM documents"
)
def subject_normalize(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.normalize_subject(F.split_part("text", F.lit("\n"), F.lit(1))).alias("subject_norm"))


@query(
    r"SELECT doc_id, address FROM (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9._%+''-]+@[A-Za-z0-9.-]+'))) AS address FROM documents)"
)
def address_extract(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(T.extract_addresses(F.col("text"))).alias("address"))


@query(f"SELECT doc_id, regexp_matches(text, '{T.DEADLINE}') AS has_deadline FROM documents")
def deadline_flag(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.has_deadline(F.col("text")).alias("has_deadline"))


_FINGERPRINT = r"sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))))"


def _printed(spark, sf_dir):
    return read(spark, sf_dir, "documents").withColumn("message_uid", T.fingerprint(T.collapse(F.col("text"))))


@query(f"SELECT {_FINGERPRINT} AS message_uid, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def fingerprint_dedup(spark, sf_dir):
    return M.keep_first(_printed(spark, sf_dir).select("message_uid", "doc_id"), "message_uid", "doc_id")


@query(
    f"SELECT CAST(count(*) AS BIGINT) AS scanned, count(DISTINCT k) AS unique_messages, count(*) - count(DISTINCT k) AS duplicates, round(count(*) / count(DISTINCT k), 6) AS factor, count(DISTINCT k) FILTER (WHERE e) AS empty_after_clean FROM (SELECT {_FINGERPRINT} AS k, length(trim(text)) = 0 AS e FROM documents)"
)
def duplication_report(spark, sf_dir):
    return M.duplication_report(_printed(spark, sf_dir), "message_uid", F.length(F.trim("text")) == 0)


# ---- eligibility, identity, roles -----------------------------------------------


def _orders(spark, sf_dir):
    return read(spark, sf_dir, "orders")


def _eligible():
    return M.eligible(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice"), F.col("o_orderdate"), F.col("o_orderstatus") == "O", 1000.0, 200000.0, "1996-01-01", "1999-12-31")


_ELIGIBLE = "(o_orderkey % 7 <> 0 AND o_totalprice BETWEEN 1000 AND 200000 AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31' AND o_orderstatus = 'O')"


@query(f"SELECT o_orderkey, o_custkey FROM orders WHERE {_ELIGIBLE}")
def eligible_messages(spark, sf_dir):
    return _orders(spark, sf_dir).where(_eligible()).select("o_orderkey", "o_custkey")


@query(
    f"SELECT count(*) AS messages, count(*) FILTER (WHERE {_ELIGIBLE}) AS eligible, count(*) FILTER (WHERE {_ELIGIBLE} AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')) AS eligible_known, round(count(*) FILTER (WHERE {_ELIGIBLE} AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')) / count(*) FILTER (WHERE {_ELIGIBLE}), 6) AS share_known FROM orders"
)
def corpus_report(spark, sf_dir):
    known = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("known"))
    return M.eligibility_report(_orders(spark, sf_dir).join(known, "o_custkey", "left"), _eligible(), F.coalesce("known", F.lit(False)))


@query(
    "WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS p, count(*) OVER () AS all_senders FROM n) SELECT max(all_senders) AS all_senders, count(*) FILTER (WHERE n >= 12) AS active, max(n) FILTER (WHERE p = all_senders // 2 + 1) AS middle FROM r"
)
def sender_median(spark, sf_dir):
    return M.sender_counts_middle(_orders(spark, sf_dir), "o_custkey", 12)


@query("SELECT DISTINCT l_orderkey AS message_uid, l_suppkey AS address, CASE WHEN l_returnflag = 'R' THEN 'cc' ELSE 'to' END AS field FROM lineitem")
def recipient_explode(spark, sf_dir):
    cc = F.col("l_returnflag") == "R"
    lists = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("message_uid")).agg(F.collect_list(F.when(~cc, F.col("l_suppkey"))).alias("to"), F.collect_list(F.when(cc, F.col("l_suppkey"))).alias("cc"))
    return M.explode_recipients(lists, "message_uid", {"to": "to", "cc": "cc"})


# recipients and, beside them, the sender
_PEOPLE_OF = "r AS (SELECT l_orderkey AS uid, l_suppkey AS address FROM lineitem UNION SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL)"


def _candidates(spark, sf_dir):
    # some customers share a subject; every fourth subject is short, and links only from four characters on
    topic = F.floor(F.col("o_custkey") / 4)
    subject = F.concat(F.when(topic % 4 == 0, "p").otherwise("plan "), topic)
    m = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("uid"), F.col("o_custkey").alias("sender"), F.col("o_orderdate").alias("at"), subject.alias("subject_norm"))
    r = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("uid"), F.col("l_suppkey").alias("address"))
    return M.thread_candidates(m, r, "uid", "at", "address", "sender")


@query(
    f"WITH {_PEOPLE_OF} SELECT uid, count(address) AS n_participants, coalesce(string_agg(CAST(address AS VARCHAR), ',' ORDER BY CAST(address AS VARCHAR)), '') AS participants FROM (SELECT o_orderkey AS uid FROM orders WHERE o_orderdate IS NOT NULL) LEFT JOIN r USING (uid) GROUP BY 1"
)
def thread_candidates(spark, sf_dir):
    text = F.array_join(F.array_sort(F.transform("participants", lambda x: x.cast("string"))), ",")
    return _candidates(spark, sf_dir).select("uid", F.size("participants").cast("long").alias("n_participants"), text.alias("participants"))


_SENT = "(SELECT l_suppkey AS mailbox, o_custkey AS sender FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
_OWNERS = f"(SELECT mailbox, sender, n_sent, round(n_sent / total, 6) AS share, p = 1 AS is_primary FROM (SELECT *, sum(n_sent) OVER (PARTITION BY mailbox) AS total, row_number() OVER (PARTITION BY mailbox ORDER BY n_sent DESC, sender) AS p FROM (SELECT mailbox, sender, count(*) AS n_sent FROM {_SENT} GROUP BY 1, 2)) WHERE n_sent / total >= 0.006 OR p = 1)"


def _owners(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("mailbox"))
    sent = lines.join(_orders(spark, sf_dir).select("o_orderkey", F.col("o_custkey").alias("sender")), "o_orderkey")
    return M.resolve_owners(sent, "mailbox", "sender", 0.006)


@query(f"SELECT * FROM {_OWNERS}")
def owner_resolution(spark, sf_dir):
    return _owners(spark, sf_dir)


@query(f"SELECT sender, min(mailbox) AS mailbox FROM {_OWNERS} GROUP BY 1 HAVING count(DISTINCT mailbox) = 1")
def address_index(spark, sf_dir):
    return M.uncontested(_owners(spark, sf_dir), "sender", "mailbox")


@query(f"SELECT count(*) AS messages, count(*) FILTER (WHERE o_custkey IN (SELECT sender FROM {_OWNERS})) AS known FROM orders")
def sender_coverage(spark, sf_dir):
    return M.coverage(_orders(spark, sf_dir), "o_custkey", _owners(spark, sf_dir), "sender")


def _roles(spark, sf_dir):
    nation = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    people = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey", "c_mktsegment")
    return M.match_unambiguous(nation, people, "n_nationkey").select("c_custkey", "n_name", "r_name", (F.col("r_regionkey") + 1).alias("seniority_rank"), "c_mktsegment")


@query("SELECT c_custkey, n_name, r_name, r_regionkey + 1 AS seniority_rank, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def role_index(spark, sf_dir):
    return _roles(spark, sf_dir)


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "SELECT r_name, "
    + ", ".join(f"count(*) FILTER (WHERE c_mktsegment = '{s}') AS {s.lower()}" for s in _SEGMENTS)
    + " FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"
)
def role_crosstab(spark, sf_dir):
    return M.crosstab(_roles(spark, sf_dir), "r_name", "c_mktsegment", _SEGMENTS).select("r_name", *[F.col(s).alias(s.lower()) for s in _SEGMENTS])


@query("SELECT count(*) AS messages, count(*) FILTER (WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10)) AS known FROM orders")
def role_coverage(spark, sf_dir):
    return M.coverage(_orders(spark, sf_dir), "o_custkey", read(spark, sf_dir, "customer").where("c_nationkey < 10"), "c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def unmatched_roles(spark, sf_dir):
    return M.unmatched(_orders(spark, sf_dir).select("o_orderkey"), read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


# ---- threads ----------------------------------------------------------------------

_LINKS = f"""
m AS (SELECT o_orderkey AS uid, o_custkey AS sender, o_orderdate AS at, CASE WHEN o_custkey // 4 % 4 = 0 THEN 'p' ELSE 'plan ' END || o_custkey // 4 AS subject FROM orders),
{_PEOPLE_OF},
s AS (SELECT subject FROM m WHERE length(subject) >= 4 AND m.at IS NOT NULL GROUP BY 1 HAVING count(*) <= 500),
x AS (SELECT m.uid, m.subject, m.at, r.address FROM m JOIN r USING (uid) SEMI JOIN s USING (subject)),
links AS (SELECT a.uid AS a, b.uid AS b FROM x a JOIN x b ON a.subject = b.subject AND a.address = b.address
  AND (a.at < b.at OR (a.at = b.at AND a.uid < b.uid)) AND b.at <= a.at + INTERVAL 365 DAYS GROUP BY 1, 2 HAVING count(*) >= 2)"""
_THREADS = f"""WITH RECURSIVE {_LINKS},
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT uid AS a, uid AS b FROM m UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
th AS (SELECT a AS uid, min(b) AS thread_id FROM reach GROUP BY 1),
tp AS (SELECT thread_id, m.uid, m.sender, m.at, row_number() OVER w - 1 AS position_in_thread, count(*) OVER (PARTITION BY thread_id) AS thread_size,
  CASE WHEN row_number() OVER w > 1 THEN CAST(epoch(m.at) - min(epoch(m.at)) OVER (PARTITION BY thread_id) AS BIGINT) END AS reply_latency_seconds
  FROM m JOIN th USING (uid) WINDOW w AS (PARTITION BY thread_id ORDER BY m.at, m.uid))"""


def _links(spark, sf_dir):
    return H.links(_candidates(spark, sf_dir), "uid", "subject_norm", "at", "participants", days=365)


def _threads(spark, sf_dir):
    m = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("uid"), F.col("o_custkey").alias("sender"), F.col("o_orderdate").alias("at"))
    return H.positions(H.components(m, _links(spark, sf_dir), "uid"), "thread_id", "uid", "at", "sender")


@query(f"WITH {_LINKS} SELECT a, b FROM links")
def thread_links(spark, sf_dir):
    return _links(spark, sf_dir).select("a", "b")


@query(f"{_THREADS} SELECT uid, thread_id FROM th")
def thread_components(spark, sf_dir):
    m = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("uid"))
    return H.components(m, _links(spark, sf_dir), "uid").select("uid", "thread_id")


@query(f"{_THREADS} SELECT uid, thread_id, position_in_thread, thread_size, reply_latency_seconds FROM tp")
def thread_positions(spark, sf_dir):
    return _threads(spark, sf_dir).select("uid", "thread_id", F.col("position_in_thread").cast("long").alias("position_in_thread"), "thread_size", "reply_latency_seconds")


@query(
    f"{_THREADS}, g AS (SELECT thread_id, count(*) AS size, count(DISTINCT sender) > 1 AND count(*) > 1 AS c FROM tp GROUP BY 1) SELECT CAST(sum(size) AS BIGINT) AS messages, count(*) AS threads, count(*) FILTER (WHERE c) AS conversations, count(*) FILTER (WHERE c AND size >= 3) AS conversations_of_3, count(*) FILTER (WHERE size > 1 AND NOT c) AS single_sender_groups, count(*) FILTER (WHERE size = 1) AS singletons, max(size) AS largest, round(sum(size * size) / sum(size), 6) AS mean_thread_size FROM g"
)
def thread_summary(spark, sf_dir):
    return H.summary(_threads(spark, sf_dir), "thread_id")


@query(f"{_THREADS} SELECT thread_size, count(DISTINCT thread_id) AS threads FROM tp WHERE thread_size > 1 GROUP BY 1 ORDER BY 1 LIMIT 10")
def thread_sizes(spark, sf_dir):
    return H.size_histogram(_threads(spark, sf_dir), "thread_id")


_TURNS = "(SELECT conv_id, turn, role, turn AS position_in_thread, count(*) OVER (PARTITION BY conv_id) AS thread_size FROM conversations)"


def _turns(spark, sf_dir):
    t = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    n = t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("thread_size"), F.countDistinct("role").alias("n_distinct_senders"))
    t = t.join(n, "conv_id").withColumn("position_in_thread", F.col("turn"))
    return t.withColumn("is_conversation", (F.col("thread_size") > 1) & (F.col("n_distinct_senders") > 1))


@query("SELECT conv_id, count(*) AS thread_size, count(DISTINCT role) AS n_distinct_senders, count(*) > 1 AND count(DISTINCT role) > 1 AS is_conversation FROM conversations GROUP BY 1")
def conversation_flags(spark, sf_dir):
    return _turns(spark, sf_dir).groupBy("conv_id").agg(F.max("thread_size").alias("thread_size"), F.max("n_distinct_senders").alias("n_distinct_senders"), F.bool_or("is_conversation").alias("is_conversation"))


@query(
    "WITH t AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), c AS (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT role) > 1) SELECT role, round(avg(CAST(turn = 0 AS DOUBLE)), 6) AS thread_initiation_rate, round(avg(CAST(turn = n - 1 AS DOUBLE)), 6) AS last_word_rate FROM t JOIN c USING (conv_id) WHERE role IS NOT NULL GROUP BY 1"
)
def participation_rates(spark, sf_dir):
    out = N.participation(_turns(spark, sf_dir), "role")
    return out.select("role", *[F.round(c, 6).alias(c) for c in ("thread_initiation_rate", "last_word_rate")])


# ---- network ------------------------------------------------------------------------


def _graph(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("uid"), F.col("l_suppkey").alias("address"))
    n = lines.groupBy("uid").agg(F.count(F.lit(1)).alias("n_recipients"))
    m = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("uid"), F.col("o_custkey").alias("sender")).join(n, "uid")
    return N.edges(m, lines, "uid", "sender", "address", "n_recipients")


_EDGES = "(SELECT o_custkey AS src, l_suppkey AS dst, count(*) AS weight FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) ON k = o_orderkey WHERE n < 10 AND o_custkey <> l_suppkey GROUP BY 1, 2)"


@query(f"SELECT * FROM {_EDGES}")
def correspondence_edges(spark, sf_dir):
    return _graph(spark, sf_dir)


@query(f"SELECT address, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT src AS address, 1 AS o, 0 AS i FROM {_EDGES} UNION ALL SELECT dst, 0, 1 FROM {_EDGES}) GROUP BY 1")
def degrees(spark, sf_dir):
    return N.degrees(_graph(spark, sf_dir))


@query(
    "SELECT o_custkey, count(*) AS messages, round(avg(CAST(coalesce(n, 0) >= 6 AS DOUBLE)), 6) AS broadcast_rate FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1"
)
def broadcast_rate(spark, sf_dir):
    n = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    m = _orders(spark, sf_dir).join(n, "o_orderkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = N.broadcast_rate(m, "o_custkey", "n", 6)
    return out.select("o_custkey", "messages", F.round("broadcast_rate", 6).alias("broadcast_rate"))


_ROUNDS = 8
_STEP = "x{k} AS MATERIALIZED (SELECT address, z / sqrt(sum(z * z) OVER ()) AS x FROM (SELECT x{j}.address, x{j}.x + coalesce(y, 0) AS z FROM x{j} LEFT JOIN (SELECT dst, sum(weight * x) AS y FROM g JOIN x{j} ON src = address GROUP BY 1) ON dst = address))"


@query(
    "WITH g AS MATERIALIZED (SELECT user_id AS src, nxt AS dst, count(*) AS weight FROM (SELECT user_id, lead(user_id) OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt <> user_id GROUP BY 1, 2), nodes AS (SELECT src AS address FROM g UNION SELECT dst FROM g), x0 AS MATERIALIZED (SELECT address, 1.0 / (SELECT count(*) FROM nodes) AS x FROM nodes), "
    + ", ".join(_STEP.format(k=k, j=k - 1) for k in range(1, _ROUNDS + 1))
    + f" SELECT address, round(x, 6) AS centrality FROM x{_ROUNDS}"
)
def eigenvector_centrality(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    # the stand-in's edges: from each event's user to that of the next event of the same hour
    nxt = e.withColumn("dst", F.lead("user_id").over(Window.partitionBy(F.date_trunc("hour", "ts")).orderBy("ts", "event_id")))
    g = durable(nxt.where("dst <> user_id").groupBy(F.col("user_id").alias("src"), "dst").agg(F.count(F.lit(1)).alias("weight")))
    return N.eigenvector_centrality(g, exact_rounds=_ROUNDS).select("address", F.round("centrality", 6).alias("centrality"))


_LAT = "(SELECT user_id AS thread, event_type AS replier, lag(event_type) OVER w AS author, CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(lag(epoch(ts)) OVER w) AS BIGINT) AS latency FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


def _latencies(spark, sf_dir):
    return N.turn_latencies(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", "ts")


@query(f"SELECT replier, author, count(*) AS n, CAST(sum(latency) AS BIGINT) AS total FROM {_LAT} WHERE replier IS NOT NULL AND author IS NOT NULL AND latency >= 0 GROUP BY 1, 2")
def turn_latency(spark, sf_dir):
    return _latencies(spark, sf_dir).groupBy("replier", "author").agg(F.count(F.lit(1)).alias("n"), F.sum("latency").alias("total"))


_ASYM = f"(SELECT address, count(o) AS n_out, count(i) AS n_in, CASE WHEN count(o) >= 3 AND count(i) >= 3 THEN median(o) - median(i) END AS reply_latency_asymmetry FROM (SELECT replier AS address, latency AS o, NULL AS i FROM {_LAT} WHERE author IS NOT NULL AND latency >= 0 UNION ALL SELECT author, NULL, latency FROM {_LAT} WHERE author IS NOT NULL AND latency >= 0) GROUP BY 1)"


@query(f"SELECT * FROM {_ASYM}")
def latency_asymmetry(spark, sf_dir):
    return N.latency_asymmetry(_latencies(spark, sf_dir))


@query(
    f"SELECT coalesce(a.address, b.address) AS address, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in, coalesce(events, 0) AS events, reply_latency_asymmetry FROM {_ASYM} a FULL JOIN (SELECT event_type AS address, count(*) AS events FROM events GROUP BY 1) b ON a.address = b.address"
)
def sender_features(spark, sf_dir):
    n = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("address")).agg(F.count(F.lit(1)).alias("events"))
    return N.sender_features(N.latency_asymmetry(_latencies(spark, sf_dir)), n).select("address", "n_out", "n_in", "events", "reply_latency_asymmetry")


# ---- features and score ----------------------------------------------------------------


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _lexical_sql(source: str, hedges, deference, commitment) -> str:
    """The shares over the (doc_id, text) of ``source``: sentences as structs of lower case and words."""

    def hit(tokens: list[str], phrases: list[str]) -> str:
        words = f"list_has_any(x.w, {_sql_list(tokens)})" if tokens else "FALSE"
        return f"({words} OR len(list_filter({_sql_list(phrases)}, lambda p: contains(x.l, p))) > 0)"

    tests = {
        "question_ratio": "rtrim(x.l, ' ') LIKE '%?'",
        "imperative_ratio": f"(coalesce(list_contains({_sql_list(S.REQUEST_VERBS)}, x.w[1]), FALSE) OR {hit(S.OBLIGATION_MODALS, S.OBLIGATION_PHRASES)})",
        "hedge_rate": hit(*hedges), "deference_rate": hit(*deference), "commitment_rate": hit(*commitment),
    }
    shares = ", ".join(f"CASE WHEN len(s) = 0 THEN 0 ELSE round(len(list_filter(s, lambda x: {t})) / len(s), 6) END AS {c}" for c, t in tests.items())
    return rf"""WITH d AS ({source}),
s AS (SELECT doc_id, text, list_transform(list_filter(regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1) || '|\n+'), lambda x: trim(x) <> ''), lambda x: {{'l': lower(x), 'w': regexp_extract_all(lower(x), '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}]+')}}) AS s FROM d),
n AS (SELECT *, CAST(coalesce(list_sum(list_transform(s, lambda x: len(x.w))), 0) AS BIGINT) AS n_tokens FROM s)
SELECT doc_id, n_tokens, CAST(len(s) AS BIGINT) AS n_sentences, CASE WHEN len(s) = 0 THEN 0 ELSE round(n_tokens / len(s), 6) END AS mean_sentence_len, {shares} FROM n"""


_RATES = ["mean_sentence_len", "question_ratio", "imperative_ratio", "hedge_rate", "deference_rate", "commitment_rate"]


def _rounded(features):
    return features.select("doc_id", "n_tokens", "n_sentences", *[F.round(c, 6).alias(c) for c in _RATES])


@query(_lexical_sql("SELECT doc_id, text FROM documents", S.HEDGES, S.DEFERENCE, S.COMMITMENT))
def lexical_features(spark, sf_dir):
    return _rounded(S.lexical_features(read(spark, sf_dir, "documents"), "doc_id", "text"))


# lexicons and marks that do occur in the invented prose
_STAND_INS = ((["the", "de", "und"], ["tion"]), ([], ["ing", "ment"]), (["la"], ["ou", "er "]))


@query(_lexical_sql("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, '.', '?') ELSE text END AS text FROM documents", *_STAND_INS))
def sentence_rates(spark, sf_dir):
    d = read(spark, sf_dir, "documents").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("."), F.lit("?"))).otherwise(F.col("text")))
    return _rounded(S.lexical_features(d, "doc_id", "text", *_STAND_INS))


_COUNTED = "(SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)"


def _joined(spark, sf_dir, buckets=8):
    """A message is the document with its order's number: sender and recipients are the order's."""
    n = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_recipients"))
    orders = _orders(spark, sf_dir).join(n, "o_orderkey", "left").withColumn("n_recipients", F.coalesce("n_recipients", F.lit(0)))
    messages = orders.select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("sender"), "n_recipients")
    layer_a = S.lexical_features(S.eligible_bodies(_sized(spark, sf_dir), "text", "is_empty", 20_000), "doc_id", "text")
    layer_b = N.broadcast_rate(orders.where("o_custkey % 3 > 0"), "o_custkey", "n_recipients", 6).withColumnRenamed("o_custkey", "address")
    return S.joined_features(bucketed(messages, "doc_id", buckets), bucketed(layer_a, "doc_id", buckets), layer_b, "doc_id", "sender", "n_recipients", many=6)


def _sized(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "text", (F.length(F.trim("text")) == 0).alias("is_empty"))


@query(
    f"""WITH f AS ({_lexical_sql("SELECT doc_id, text FROM documents WHERE length(trim(text)) > 0 AND length(text) <= 20000", S.HEDGES, S.DEFERENCE, S.COMMITMENT)}),
m AS (SELECT o_orderkey AS doc_id, o_custkey AS sender, coalesce(n, 0) AS n_recipients FROM orders LEFT JOIN {_COUNTED} ON l_orderkey = o_orderkey)
SELECT doc_id, sender, n_recipients, CAST(n_recipients >= 6 AS DOUBLE) AS is_broadcast, imperative_ratio, question_ratio, round(broadcast_rate, 6) AS broadcast_rate
FROM m JOIN f USING (doc_id) LEFT JOIN (SELECT sender, avg(CAST(n_recipients >= 6 AS DOUBLE)) AS broadcast_rate FROM m WHERE sender % 3 > 0 GROUP BY 1) USING (sender)"""
)
def joined_features(spark, sf_dir):
    rounded = [F.round(c, 6).alias(c) for c in ("imperative_ratio", "question_ratio", "broadcast_rate")]
    return _joined(spark, sf_dir).select("doc_id", "sender", "n_recipients", "is_broadcast", *rounded)


@query("SELECT count(*) AS bodies, count(*) FILTER (WHERE length(trim(text)) > 0 AND length(text) <= 2000) AS eligible, count(*) FILTER (WHERE length(text) > 2000) AS oversized FROM documents")
def body_sizes(spark, sf_dir):
    d = _sized(spark, sf_dir)
    kept = S.eligible_bodies(d, "text", "is_empty", 2000).agg(F.count(F.lit(1)).alias("eligible"))
    return d.agg(F.count(F.lit(1)).alias("bodies")).crossJoin(kept).crossJoin(S.oversized(d, "text", 2000)).select("bodies", "eligible", "oversized")  # single rows


_WEIGHTS = {"n_chars": 0.5, "quality": -0.25, "toxic": 1.0}
_Z = "CASE WHEN stddev_samp({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () END AS z_{c}"
_POWER = (
    "(SELECT doc_id, n_power_components, CASE WHEN n_power_components >= 2 THEN num / den END AS power_score FROM (SELECT doc_id, "
    + " + ".join(f"CAST(z_{c} IS NOT NULL AS BIGINT)" for c in _WEIGHTS)
    + " AS n_power_components, "
    + " + ".join(f"coalesce({w} * z_{c}, 0)" for c, w in _WEIGHTS.items())
    + " AS num, "
    + " + ".join(f"CASE WHEN z_{c} IS NULL THEN 0 ELSE {abs(w)} END" for c, w in _WEIGHTS.items())
    + " AS den FROM (SELECT doc_id, "
    + ", ".join(_Z.format(c=c) for c in _WEIGHTS)
    + " FROM documents LEFT JOIN labels USING (doc_id))))"
)


def _power(spark, sf_dir):
    joined = read(spark, sf_dir, "documents").select("doc_id", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return S.power_score(joined, _WEIGHTS, 2)


@query(f"SELECT doc_id, round(power_score, 6) AS power_score, n_power_components FROM {_POWER}")
def power_score(spark, sf_dir):
    return _power(spark, sf_dir).select("doc_id", F.round("power_score", 6).alias("power_score"), "n_power_components")


@query(f"SELECT doc_id % 6 + 1 AS seniority_rank, round(avg(power_score), 6) AS mean, round(stddev_samp(power_score), 6) AS std, count(*) AS n FROM {_POWER} WHERE power_score IS NOT NULL GROUP BY 1")
def power_by_rank(spark, sf_dir):
    out = S.score_by_rank(_power(spark, sf_dir).withColumn("seniority_rank", F.col("doc_id") % 6 + 1), "seniority_rank", "power_score")
    return out.select("seniority_rank", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@query(
    f"WITH p AS (SELECT doc_id % 6 + 1 AS a, power_score AS b FROM {_POWER} WHERE power_score IS NOT NULL), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM p) SELECT round(corr(ra, rb), 6) AS rho, count(*) AS n FROM r"
)
def power_spearman(spark, sf_dir):
    out = S.spearman(_power(spark, sf_dir).withColumn("seniority_rank", F.col("doc_id") % 6 + 1), "seniority_rank", "power_score")
    return out.select(F.round("rho", 6).alias("rho"), "n")


# ---- sampling, personas, grid -------------------------------------------------------------

_SEED = 20260807
_QUOTA = "(SELECT c_mktsegment, c_nationkey, size, CAST(least(size, greatest(0, q + CASE WHEN place = 1 THEN 300 - sum(q) OVER () ELSE 0 END)) AS BIGINT) AS quota FROM (SELECT *, CAST(round_even(size * 300 / sum(size) OVER (), 0) AS BIGINT) AS q, row_number() OVER (ORDER BY size DESC, c_mktsegment, c_nationkey) AS place FROM (SELECT c_mktsegment, c_nationkey, count(*) AS size FROM customer GROUP BY 1, 2)))"


@query(f"SELECT * FROM {_QUOTA}")
def stratified_quota(spark, sf_dir):
    return P.quotas(read(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"], 300)


@query(
    f"SELECT c_custkey, c_mktsegment, c_nationkey FROM (SELECT c.c_custkey, c.c_mktsegment, c.c_nationkey, quota, row_number() OVER (PARTITION BY c.c_mktsegment, c.c_nationkey ORDER BY sha256(c.c_custkey || '|{_SEED}')) AS p FROM customer c JOIN {_QUOTA} q ON c.c_mktsegment = q.c_mktsegment AND c.c_nationkey = q.c_nationkey) WHERE p <= quota"
)
def stratified_sample(spark, sf_dir):
    return P.stratified_sample(read(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"], "c_custkey", 300, _SEED).select("c_custkey", "c_mktsegment", "c_nationkey")


@query("SELECT conv_id FROM conversations GROUP BY 1 HAVING bool_and(coalesce(length(text) >= 40, FALSE))")
def fully_eligible_threads(spark, sf_dir):
    return P.fully_eligible(read(spark, sf_dir, "conversations"), "conv_id", F.length("text") >= 40)


@query(
    f"WITH ok AS (SELECT conv_id FROM conversations GROUP BY 1 HAVING bool_and(coalesce(length(text) >= 40, FALSE)) ORDER BY sha256(conv_id || '|{_SEED}') LIMIT 20), r AS (SELECT conv_id, turn FROM conversations SEMI JOIN ok USING (conv_id)), rep AS (SELECT conv_id, turn FROM r WHERE turn > 0 ORDER BY sha256((conv_id * 1000 + turn) || '|{_SEED}') LIMIT 40) SELECT 'shot' AS kind, conv_id, turn FROM r WHERE turn = 0 UNION ALL SELECT 'reply', conv_id, turn FROM rep"
)
def shots_and_replies(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").withColumn("uid", F.col("conv_id") * 1000 + F.col("turn"))
    shots, replies = P.shots_and_replies(turns, "conv_id", "turn", "uid", F.length("text") >= 40, 20, 40, _SEED)
    cols = ["kind", "conv_id", "turn"]
    return shots.withColumn("kind", F.lit("shot")).select(cols).unionAll(replies.withColumn("kind", F.lit("reply")).select(cols))


_STYLE = ["mean_price", "mean_lines"]
_DEPARTMENTS = [*_SEGMENTS, "LEGAL", "TAX"]
_PEOPLE = "(SELECT n_regionkey AS rank, c_mktsegment AS department, o_custkey AS person, o_totalprice AS mean_price, CAST(o_orderkey % 7 AS DOUBLE) AS mean_lines FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"
_CELLS = f"(SELECT rank, department, CAST(grouping(department) AS INTEGER) AS pooled, count(DISTINCT person) AS n_people, count(*) AS n_messages, avg(mean_price) AS mean_price, avg(mean_lines) AS mean_lines FROM {_PEOPLE} GROUP BY GROUPING SETS ((rank, department), (rank)))"


def _cells(spark, sf_dir):
    people = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person"), F.col("c_mktsegment").alias("department"), F.col("c_nationkey").alias("n_nationkey"))
    people = people.join(read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("rank")), "n_nationkey")
    m = _orders(spark, sf_dir).select(F.col("o_custkey").alias("person"), F.col("o_totalprice").alias("mean_price"), (F.col("o_orderkey") % 7).cast("double").alias("mean_lines"))
    return P.persona_cells(m.join(people, "person"), "rank", "department", "person", _STYLE)


def _personas(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    grid = cells.where("pooled = 1").select("rank", F.explode(F.array(*[F.lit(s) for s in _DEPARTMENTS])).alias("department"))
    return P.with_fallback(cells, grid, "rank", "department", _STYLE, 60)


@query(f"SELECT rank, department, pooled, n_people, n_messages, round(mean_price, 1) AS mean_price, round(mean_lines, 3) AS mean_lines FROM {_CELLS}")
def persona_cells(spark, sf_dir):
    return _cells(spark, sf_dir).select("rank", "department", "pooled", "n_people", "n_messages", F.round("mean_price", 1).alias("mean_price"), F.round("mean_lines", 3).alias("mean_lines"))


_GRID = f"(SELECT p.rank, d.department, CASE WHEN coalesce(o.n_people, 0) >= 60 THEN 'cell' ELSE 'rank_pooled' END AS derivation, CASE WHEN coalesce(o.n_people, 0) >= 60 THEN o.n_people ELSE p.n_people END AS n_people, CASE WHEN coalesce(o.n_people, 0) >= 60 THEN o.n_messages ELSE p.n_messages END AS n_messages, round(CASE WHEN coalesce(o.n_people, 0) >= 60 THEN o.mean_price ELSE p.mean_price END, 1) AS mean_price, round(CASE WHEN coalesce(o.n_people, 0) >= 60 THEN o.mean_lines ELSE p.mean_lines END, 3) AS mean_lines FROM {_CELLS} p CROSS JOIN (SELECT unnest([{', '.join(repr(s) for s in _DEPARTMENTS)}]) AS department) d LEFT JOIN {_CELLS} o ON o.rank = p.rank AND o.department = d.department AND o.pooled = 0 WHERE p.pooled = 1)"


@query(f"SELECT * FROM {_GRID}")
def persona_fallback(spark, sf_dir):
    return _personas(spark, sf_dir).withColumns({"mean_price": F.round("mean_price", 1), "mean_lines": F.round("mean_lines", 3)})


# ranks 0 and 1 have personas of departments without people only, so theirs are all the same pool
@query(f"SELECT rank, count(*) AS n_personas FROM {_GRID} WHERE rank > 1 OR department IN ('LEGAL', 'TAX') GROUP BY 1 HAVING count(*) > 1 AND bool_and(derivation = 'rank_pooled') AND count(DISTINCT (mean_price, mean_lines)) = 1")
def collapsed_ranks(spark, sf_dir):
    some = _personas(spark, sf_dir).where((F.col("rank") > 1) | F.col("department").isin("LEGAL", "TAX"))
    return P.collapsed_ranks(some, "rank", _STYLE)


_DIRECTIONS, _STAKES, _MODELS, _REPLICATES = ["up", "down", "lateral"], ["low", "high"], ["model-a", "model-b"], 3
_SCENARIOS = "(SELECT task_type, direction, stakes, task_type || '_' || direction || '_' || stakes AS scenario_id FROM (SELECT r_name AS task_type FROM region) CROSS JOIN (SELECT unnest(['up', 'down', 'lateral']) AS direction) CROSS JOIN (SELECT unnest(['low', 'high']) AS stakes))"
_GRID_CELLS = f"(SELECT model || '__' || persona_id || '__' || scenario_id || '__r' || replicate AS cell_id, model || '__' || persona_id || '__' || direction AS cache_group, persona_id, scenario_id, direction, model, CAST(replicate AS INTEGER) AS replicate FROM (SELECT n_name AS persona_id FROM nation) CROSS JOIN {_SCENARIOS} CROSS JOIN (SELECT unnest(['model-a', 'model-b']) AS model) CROSS JOIN (SELECT unnest([1, 2, 3]) AS replicate))"


def _scenarios(spark, sf_dir):
    return P.scenario_grid(read(spark, sf_dir, "region").select(F.col("r_name").alias("task_type")), _DIRECTIONS, _STAKES)


def _grid(spark, sf_dir):
    personas = read(spark, sf_dir, "nation").select(F.col("n_name").alias("persona_id"))
    return P.expand_grid(personas, _scenarios(spark, sf_dir), _MODELS, _REPLICATES)


@query(f"SELECT * FROM {_SCENARIOS}")
def scenario_grid(spark, sf_dir):
    return _scenarios(spark, sf_dir)


@query(f"SELECT * FROM {_GRID_CELLS}")
def cell_expand(spark, sf_dir):
    return _grid(spark, sf_dir)


@query(f"SELECT CAST(sum(n) AS BIGINT) AS cells, CAST(sum(d) AS BIGINT) AS distinct_cells, count(*) AS cache_groups, round(avg(n), 6) AS mean_group_size FROM (SELECT cache_group, count(*) AS n, count(DISTINCT cell_id) AS d FROM {_GRID_CELLS} GROUP BY 1)")
def design_summary(spark, sf_dir):
    return P.design_summary(_grid(spark, sf_dir))


@query(f"SELECT cache_group, cell_id FROM {_GRID_CELLS} ORDER BY 1, 2")
def cache_order(spark, sf_dir):
    return _grid(spark, sf_dir).select("cache_group", "cell_id").orderBy("cache_group", "cell_id")


# ---- completions, cost, memory ---------------------------------------------------------------

_PICK = "list_extract([{o}], CAST(('0x' || substr(sha256({s}), 1, 2)) AS INTEGER) % {n} + 1)"


def _pick(seed: str, options: list[str]) -> str:
    return _PICK.format(o=", ".join(repr(o) for o in options), s=seed, n=len(options))


@query(f"SELECT o_orderkey, {_pick(repr('order-') + ' || o_orderkey || ' + repr('|decision'), X.DECISIONS)} AS decision, {_pick(repr('order-') + ' || o_orderkey || ' + repr('|confidence'), X.CONFIDENCES)} AS confidence FROM orders")
def stub_completion(spark, sf_dir):
    seed = F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"))
    return X.stub_completion(_orders(spark, sf_dir).select("o_orderkey"), seed)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%')")
def pending_cells(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return X.pending(o.select("o_orderkey"), o.where(F.startswith("o_orderpriority", F.lit("1"))), "o_orderkey")


@query("SELECT o_orderkey, 'c_' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 16) AS custom_id, (row_number() OVER (ORDER BY o_orderkey) - 1) // 500 AS chunk FROM orders")
def batch_chunks(spark, sf_dir):
    return X.batch_chunks(_orders(spark, sf_dir), "o_orderkey", 500)


_PRICES = [("model-a", 3.0, 15.0), ("model-b", 1.0, 5.0)]


def _prices(spark):
    return spark.createDataFrame(_PRICES, "model string, rate_in double, rate_out double")


@query(
    f"WITH g AS (SELECT cache_group, min_by(model, cell_id) AS model, min_by(length(cell_id) * 10, cell_id) AS tokens, count(*) AS n FROM {_GRID_CELLS} GROUP BY 1) SELECT g.model, CAST(sum(n) AS BIGINT) AS cells, round(sum((tokens * i + 512 * o) / 1e6 * n), 6) AS cost_usd FROM g JOIN (VALUES ('model-a', 3.0, 15.0), ('model-b', 1.0, 5.0)) p(model, i, o) ON g.model = p.model GROUP BY 1"
)
def dry_run_cost(spark, sf_dir):
    return X.dry_run(_grid(spark, sf_dir), _prices(spark), F.length("cell_id") * 10)


def _ledger(spark, sf_dir):
    usage = read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("model-"), F.when(F.col("l_returnflag") == "R", "a").otherwise("b")).alias("model"), F.col("l_partkey").alias("input_tokens"),
        F.col("l_suppkey").alias("cache_write_tokens"), F.col("l_linenumber").alias("cache_read_tokens"), F.col("l_quantity").alias("output_tokens"), (F.col("l_linestatus") == "O").alias("batch"),
    )
    return X.cost_usd(usage, _prices(spark), F.col("batch"))


@query(
    "SELECT model, count(*) AS calls, round(sum(c), 4) AS total_usd FROM (SELECT 'model-' || CASE WHEN l_returnflag = 'R' THEN 'a' ELSE 'b' END AS model, CASE WHEN l_linestatus = 'O' THEN 0.5 ELSE 1 END * ((l_partkey + l_suppkey * 1.25 + l_linenumber * 0.1) * CASE WHEN l_returnflag = 'R' THEN 3 ELSE 1 END + l_quantity * CASE WHEN l_returnflag = 'R' THEN 15 ELSE 5 END) / 1e6 AS c FROM lineitem) GROUP BY 1"
)
def ledger_total(spark, sf_dir):
    return _ledger(spark, sf_dir).groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("cost_usd"), 4).alias("total_usd"))


@query("SELECT doc_id, round(pow(0.995, doc_id % 500), 6) AS recency FROM documents")
def memory_recency(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.round(X.recency(F.col("doc_id") % 500), 6).alias("recency"))


@query("SELECT doc_id, round(CASE WHEN max(n_chars) OVER w = min(n_chars) OVER w THEN 1 ELSE (n_chars - min(n_chars) OVER w) / (max(n_chars) OVER w - min(n_chars) OVER w) END, 6) AS importance FROM documents WINDOW w AS (PARTITION BY source)")
def memory_minmax(spark, sf_dir):
    return X.min_max(read(spark, sf_dir, "documents"), ["source"], "n_chars", "importance").select("doc_id", F.round("importance", 6).alias("importance"))


_TFIDF = r"""WITH q AS (SELECT source, 'the of de la que der und' AS q, count(*) AS n FROM documents GROUP BY 1),
w AS (SELECT source, CAST(doc_id AS VARCHAR) AS u, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) AS w FROM documents UNION ALL SELECT source, NULL, unnest(regexp_extract_all(q, '[a-z0-9_]{2,}')) FROM q),
tf AS (SELECT source, u, w, count(*) AS tf FROM w GROUP BY 1, 2, 3),
x AS (SELECT tf.source, tf.u, tf.w, tf * (ln((n + 2) / (df + 1)) + 1) AS x FROM tf JOIN (SELECT source, w, count(*) AS df FROM tf GROUP BY 1, 2) d ON d.source = tf.source AND d.w = tf.w JOIN q ON q.source = tf.source),
ny AS (SELECT source, sqrt(sum(x * x)) AS ny FROM x WHERE u IS NULL GROUP BY 1),
s AS (SELECT x.source, x.u, sum(x.x * coalesce(y.x, 0)) / (sqrt(sum(x.x * x.x)) * max(ny)) AS r FROM x JOIN ny ON ny.source = x.source LEFT JOIN x y ON y.u IS NULL AND y.source = x.source AND y.w = x.w WHERE x.u IS NOT NULL GROUP BY 1, 2),
rel AS (SELECT doc_id, documents.source, round(coalesce(r, 0), 5) AS relevance FROM documents LEFT JOIN s ON s.u = CAST(doc_id AS VARCHAR) AND s.source = documents.source)"""


def _relevance(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "text", F.lit("the of de la que der und").alias("query"))
    out = X.tfidf_relevance(d, "source", "doc_id", "text", "query", token="[a-z0-9_]{2,}")
    return out.select("doc_id", "source", F.round("relevance", 5).alias("relevance"))


@query(f"{_TFIDF} SELECT * FROM rel")
def tfidf_relevance(spark, sf_dir):
    return _relevance(spark, sf_dir)


@query(f"{_TFIDF} SELECT source, doc_id, place FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY relevance DESC, doc_id) AS place FROM rel) WHERE place <= 8")
def memory_topk(spark, sf_dir):
    return X.top_memories(_relevance(spark, sf_dir), ["source"], "relevance", "doc_id").select("source", "doc_id", F.col("place").cast("long").alias("place"))


_RETRIEVED = f"""{_TFIDF},
parts AS (SELECT source, doc_id, pow(0.995, doc_id % 500) AS r, n_chars AS i, relevance AS v FROM rel JOIN documents USING (doc_id, source)),
scaled AS (SELECT source, doc_id, round({" + ".join(f"CASE WHEN max({c}) OVER w = min({c}) OVER w THEN 1 ELSE ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) END" for c in "riv")}, 9) AS score FROM parts WINDOW w AS (PARTITION BY source))"""


@query(f"{_RETRIEVED} SELECT source, doc_id, round(score, 5) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS place FROM scaled) WHERE place <= 8")
def memory_retrieve(spark, sf_dir):
    def scorer(items, *columns):
        return X.tfidf_relevance(items, *columns, token="[a-z0-9_]{2,}").withColumn("relevance", F.round("relevance", 5))

    d = read(spark, sf_dir, "documents").select("doc_id", "source", "text", "n_chars", (F.col("doc_id") % 500).alias("hours"), F.lit("the of de la que der und").alias("query"))
    out = X.retrieve(d, "source", "doc_id", "text", "query", "n_chars", "hours", relevance=scorer)
    return out.select("source", "doc_id", F.round("score", 5).alias("score"), F.col("place").cast("long").alias("place"))


@query("SELECT conv_id, turn // 3 AS batch, turn FROM conversations SEMI JOIN (SELECT conv_id, turn // 3 AS b FROM conversations GROUP BY 1, 2 HAVING count(*) = 3) f ON f.conv_id = conversations.conv_id AND f.b = conversations.turn // 3")
def reflection_batches(spark, sf_dir):
    return X.reflection_batches(read(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn", 3).select("conv_id", "batch", "turn")


def _pairs(spark, sf_dir, every=False):
    """Replies and the personas of their repliers: of two thirds, but for one department, or of every one."""
    replier = F.col("conv_id") + 1
    if not every:
        replier = F.when((F.col("conv_id") + F.col("turn")) % 3 > 0, replier)
    t = read(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") % 5).alias("stimulus_rank"), replier.alias("c_custkey"))
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").cast("long").alias("seniority_rank"))
    ranks = read(spark, sf_dir, "customer").join(nation, "c_nationkey").select("c_custkey", "seniority_rank", F.col("c_mktsegment").alias("department"))
    roles = ranks if every else ranks.where("department <> 'FURNITURE'")
    personas = roles.select("seniority_rank", "department").distinct().withColumn("persona_id", F.concat_ws("-", "department", "seniority_rank"))
    return X.stimulus_pairs(t, "conv_id", "turn", ranks, "c_custkey", personas)


_PAIRS = "(SELECT a.conv_id, b.turn, a.text AS stimulus_body, b.text AS reply_body, n_regionkey, c_mktsegment AS department, CASE WHEN c_mktsegment <> 'FURNITURE' THEN c_mktsegment || '-' || n_regionkey END AS persona_id, CASE WHEN n_regionkey > a.conv_id % 5 THEN 'down' WHEN n_regionkey < a.conv_id % 5 THEN 'up' WHEN n_regionkey = a.conv_id % 5 THEN 'lateral' END AS direction FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn > 0 LEFT JOIN (SELECT * FROM customer JOIN nation ON n_nationkey = c_nationkey) c ON c_custkey = a.conv_id + 1 AND (b.conv_id + b.turn) % 3 > 0)"


@query(
    "SELECT a.conv_id, b.turn, c_mktsegment AS department, c_mktsegment || '-' || n_regionkey AS persona_id, CASE WHEN n_regionkey > a.conv_id % 5 THEN 'down' WHEN n_regionkey < a.conv_id % 5 THEN 'up' WHEN n_regionkey = a.conv_id % 5 THEN 'lateral' END AS direction FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn > 0 JOIN customer ON c_custkey = a.conv_id + 1 JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment IS NOT NULL AND n_regionkey IS NOT NULL"
)
def real_stimulus_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir, every=True).where("persona_id IS NOT NULL").select("conv_id", "turn", "department", "persona_id", "direction")


@query(
    f"""SELECT conv_id, turn, 'analyst__real_' || conv_id || '__' || (conv_id * 1000 + turn) AS cell_id, 'real_' || conv_id AS scenario_id, direction, persona_id, 'model-a' AS model,
  'Subject: plan ' || conv_id || chr(10) || chr(10) || coalesce(stimulus_body, '') AS stimulus_text, 'Subject: Re: plan ' || conv_id || chr(10) || chr(10) || coalesce(reply_body, '') AS reply_text
  FROM {_PAIRS} WHERE persona_id IS NOT NULL ORDER BY conv_id, turn"""
)
def real_stimulus_texts(spark, sf_dir):
    uid = (F.col("conv_id") * 1000 + F.col("turn")).alias("uid")
    subject = F.concat(F.when(F.col("turn") > 0, "Re: plan ").otherwise("plan "), F.col("conv_id")).alias("subject")
    texts = read(spark, sf_dir, "conversations").select("conv_id", uid, subject, F.col("text").alias("body"))
    pairs = _pairs(spark, sf_dir).withColumns({"stimulus_uid": F.col("conv_id") * 1000, "reply_uid": F.col("conv_id") * 1000 + F.col("turn")})
    cells = X.stimulus_cells(pairs, texts.drop("conv_id"), "conv_id", "model-a", "analyst")
    return cells.orderBy("conv_id", "reply_uid").select("conv_id", "turn", "cell_id", "scenario_id", "direction", "persona_id", "model", "stimulus_text", "reply_text")


@query(f"SELECT count(*) AS pairs, count(*) FILTER (WHERE persona_id IS NULL) AS unmatched FROM {_PAIRS}")
def unmatched_pairs(spark, sf_dir):
    return X.unmatched_pairs(_pairs(spark, sf_dir))


# ---- judging and statistics ---------------------------------------------------------------------


@query(
    "SELECT o_custkey, "
    + ", ".join(f"max(CASE WHEN k = '{k}' THEN o_totalprice END) AS score_{k}, max(CASE WHEN k = '{k}' THEN o_orderstatus END) AS evidence_{k}" for k in "12345")
    + " FROM (SELECT *, substr(o_orderpriority, 1, 1) AS k FROM orders) GROUP BY 1"
)
def judge_wide(spark, sf_dir):
    long = _orders(spark, sf_dir).select("o_custkey", F.substring("o_orderpriority", 1, 1).alias("k"), F.col("o_totalprice").alias("score"), F.col("o_orderstatus").alias("evidence"))
    return X.scores_wide(long, ["o_custkey"], "k", list("12345"))


@query(
    "WITH x AS (SELECT toxic = 1 AS l, n_chars AS s FROM labels JOIN documents USING (doc_id)), r AS (SELECT l, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r FROM x) SELECT round((sum(r) FILTER (WHERE l) - count(*) FILTER (WHERE l) * (count(*) FILTER (WHERE l) + 1) / 2) / (count(*) FILTER (WHERE l) * count(*) FILTER (WHERE NOT l)), 6) AS auc FROM r"
)
def discrimination_auc(spark, sf_dir):
    x = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").withColumn("label", F.col("toxic") == 1)
    return X.roc_auc(x, "label", "n_chars").select(F.round("auc", 6).alias("auc"))


_PAIRED = "(SELECT l_quantity AS a, l_discount * 500 AS b FROM lineitem)"


def _paired(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("a"), (F.col("l_discount") * 500).alias("b"))


@query(
    f"WITH d AS (SELECT a - b AS d FROM {_PAIRED}), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r FROM d WHERE d <> 0) SELECT least(coalesce(sum(r) FILTER (WHERE d > 0), 0), coalesce(sum(r) FILTER (WHERE d < 0), 0)) AS w, count(*) AS n, (SELECT round(median(d), 6) FROM d) AS median_difference FROM r"
)
def wilcoxon_w(spark, sf_dir):
    return X.wilcoxon(_paired(spark, sf_dir), "a", "b").select("w", "n", F.round("median_difference", 6).alias("median_difference"))


@query(f"SELECT count(*) AS n, round(avg(a - b), 6) AS mean, round(stddev_samp(a - b) / sqrt(count(*)), 6) AS se FROM {_PAIRED}")
def tost(spark, sf_dir):
    return X.tost_moments(_paired(spark, sf_dir), "a", "b").select("n", F.round("mean", 6).alias("mean"), F.round("se", 6).alias("se"))


# pairs of each group of orders: whole numbers, which tie, in every other group, and prices in the others
_GROUPED = "(SELECT l_orderkey // 5 AS g, CASE WHEN l_orderkey // 5 % 2 = 0 THEN l_quantity ELSE l_extendedprice END AS a, CASE WHEN l_orderkey // 5 % 2 = 0 THEN l_discount * 500 ELSE l_quantity * 1500 END AS b FROM lineitem)"


def _grouped(spark, sf_dir):
    g = F.floor(F.col("l_orderkey") / 5)
    pick = lambda x, y: F.when(g % 2 == 0, x).otherwise(y)
    return read(spark, sf_dir, "lineitem").select(g.alias("g"), pick(F.col("l_quantity"), F.col("l_extendedprice")).alias("a"), pick(F.col("l_discount") * 500, F.col("l_quantity") * 1500).alias("b"))


@query(
    f"""WITH RECURSIVE ways AS (SELECT 0 AS n, list_transform(range(0, 1276), lambda i: CASE WHEN i = 0 THEN 1::DOUBLE ELSE 0 END) AS a UNION ALL SELECT n + 1, list_transform(range(1, 1277), lambda i: a[i] + CASE WHEN i > n + 1 THEN a[i - n - 1] ELSE 0 END) FROM ways WHERE n < {Z.EXACT}),
d AS (SELECT g, a - b AS d FROM {_GROUPED}),
r AS (SELECT g, d, rank() OVER (PARTITION BY g ORDER BY abs(d)) + (count(*) OVER (PARTITION BY g, abs(d)) - 1) / 2 AS r, count(*) OVER (PARTITION BY g, abs(d)) AS t FROM d WHERE d <> 0),
s AS (SELECT g, count(*) AS n, least(coalesce(sum(r) FILTER (WHERE d > 0), 0), coalesce(sum(r) FILTER (WHERE d < 0), 0)) AS w, sum(t * t - 1)::DOUBLE AS ties FROM r GROUP BY 1),
e AS (SELECT d.g, count(*) AS n_pairs, median(d) AS m FROM d GROUP BY 1),
x AS (SELECT *, abs(w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) / sqrt(2) AS x FROM s)
SELECT e.g, n_pairs, coalesce(x.n, 0) AS n, coalesce(w, 0) AS w, round(m, 6) AS median_difference, round(CASE WHEN x.n IS NULL THEN 1 WHEN x.n <= {Z.EXACT} AND ties = 0 THEN least(1, 2 * list_sum(ways.a[1:CAST(floor(w) AS BIGINT) + 1]) / pow(2, x.n)) WHEN x = 0 THEN 1 ELSE greatest(0, 1 - list_sum(list_transform(range(0, 150), lambda k: exp((2 * k + 1) * ln(x) - lgamma(k + 1.5) - x * x)))) END, 6) AS p_value
FROM e LEFT JOIN x USING (g) LEFT JOIN ways ON ways.n = x.n"""
)
def wilcoxon_p(spark, sf_dir):
    return Z.wilcoxon_by(_grouped(spark, sf_dir), ["g"], "a", "b").select("g", "n_pairs", "n", "w", F.round("median_difference", 6).alias("median_difference"), F.round("p_value", 6).alias("p_value"))


# the distribution by Simpson's rule over the angle whose tangent is t / sqrt(df)
_T_ABOVE = "0.5 - exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(pi()) * atan({t} / sqrt(v)) / 6000 * list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(cos(atan({t} / sqrt(v)) * i / 2000), v - 1)))"


@query(
    f"""WITH s AS (SELECT g, count(*) AS n_pairs, avg(a - b) AS m, coalesce(stddev_samp(a - b) / sqrt(count(*)), 0) AS se, (count(*) - 1)::DOUBLE AS v FROM {_GROUPED} GROUP BY 1),
t AS (SELECT *, (m + 3) / nullif(se, 0) AS lo, (3 - m) / nullif(se, 0) AS hi FROM s),
p AS (SELECT *, CASE WHEN se = 0 THEN CASE WHEN abs(m) < 3 THEN 0 ELSE 1 END ELSE {_T_ABOVE.format(t="lo")} END AS p_lower, CASE WHEN se = 0 THEN CASE WHEN abs(m) < 3 THEN 0 ELSE 1 END ELSE {_T_ABOVE.format(t="hi")} END AS p_upper FROM t)
SELECT g, n_pairs, round(m, 8) AS mean_difference, round(p_lower, 6) AS p_lower, round(p_upper, 6) AS p_upper, p_lower < 0.2 AND p_upper < 0.2 AS equivalent FROM p"""
)
def tost_p(spark, sf_dir):
    out = Z.tost_by(_grouped(spark, sf_dir), ["g"], "a", "b", margin=3.0, alpha=0.2)
    return out.select("g", "n_pairs", F.round("mean_difference", 8).alias("mean_difference"), F.round("p_lower", 6).alias("p_lower"), F.round("p_upper", 6).alias("p_upper"), "equivalent")


@query()
def model_free_auc(spark, sf_dir):
    x = read(spark, sf_dir, "documents").select("doc_id", "text").join(read(spark, sf_dir, "labels"), "doc_id")
    return X.text_auc(x, "doc_id", "text", "quality").select("folds", F.round("mean_auc", 4).alias("mean_auc"))
