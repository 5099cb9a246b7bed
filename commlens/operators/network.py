"""Correspondence graph and per-sender features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from commlens.operators.ranks import medians


def edges(messages: DataFrame, recipients: DataFrame, uid: str, sender: str, address: str, n_recipients: str, broadcast_from: int = 10) -> DataFrame:
    """src, dst, weight without broadcasts and mail to oneself."""
    m = messages.where(F.col(sender).isNotNull() & (F.col(n_recipients) < broadcast_from)).select(uid, F.col(sender).alias("src"))
    r = recipients.select(uid, F.col(address).alias("dst"))
    return m.join(r, uid).where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def degrees(graph: DataFrame) -> DataFrame:
    """Distinct neighbours each way: one pass over the edges, one shuffle."""
    ends = graph.select(F.explode(F.array(F.struct(F.col("src").alias("address"), F.lit(1).alias("out"), F.lit(0).alias("in")), F.struct(F.col("dst").alias("address"), F.lit(0).alias("out"), F.lit(1).alias("in")))).alias("e"))
    return ends.groupBy("e.address").agg(F.sum("e.out").alias("out_degree"), F.sum("e.in").alias("in_degree"))


def eigenvector_centrality(graph: DataFrame, rounds: int = 1000, tolerance: float = 1e-6, exact_rounds: int | None = None) -> DataFrame:
    """Weighted eigenvector centrality by power iteration: x + A x, normalised, until the
    summed change is below n * tolerance; degree centrality if it doesn't settle.

    The iterate is checkpointed every round (reliably, to the shared folder), so the plan
    stays that of one round; the edge list is the only large table.
    ``exact_rounds`` does so many rounds without tests.
    """
    from commlens.session import durable

    nodes = graph.select(F.explode(F.array("src", "dst")).alias("address")).distinct()
    n = nodes.count()
    if not n:
        return nodes.withColumn("centrality", F.lit(0.0))
    x = nodes.withColumn("x", F.lit(1.0 / n))
    step = exact_rounds or rounds
    for k in range(step):
        flow = graph.join(x, graph.src == x.address).groupBy(F.col("dst").alias("address")).agg(F.sum(F.col("weight") * F.col("x")).alias("y"))
        raw = x.join(flow, "address", "left").select("address", "x", (F.col("x") + F.coalesce("y", F.lit(0.0))).alias("z"))
        norm = raw.agg(F.sqrt(F.sum(F.col("z") * F.col("z"))).alias("norm"))
        moved = raw.crossJoin(F.broadcast(norm)).select("address", "x", (F.col("z") / F.col("norm")).alias("z"))
        last = k == step - 1
        if exact_rounds and last:
            return moved.select("address", F.col("z").alias("centrality"))
        moved = durable(moved)  # the iterate is used twice a round: without this the plan grows as 4**k
        if exact_rounds:
            x = moved.select("address", F.col("z").alias("x"))
            continue
        change = moved.agg(F.sum(F.abs(F.col("z") - F.col("x")))).first()[0]
        x = moved.select("address", F.col("z").alias("x"))
        if change < n * tolerance:
            return x.select("address", F.col("x").alias("centrality"))
    return degrees(graph).select("address", ((F.col("in_degree") + F.col("out_degree")) / max(1, n - 1)).alias("centrality"))


def broadcast_rate(messages: DataFrame, sender: str, n_recipients: str, broadcast_from: int = 10) -> DataFrame:
    return messages.where(F.col(sender).isNotNull()).groupBy(sender).agg(F.count(F.lit(1)).alias("messages"), F.avg((F.col(n_recipients) >= broadcast_from).cast("double")).alias("broadcast_rate"))


def participation(threads: DataFrame, sender: str) -> DataFrame:
    """Shares of a sender's conversation messages that open and that close a thread."""
    t = threads.where(F.col("is_conversation") & F.col(sender).isNotNull())
    return t.groupBy(sender).agg(
        F.avg((F.col("position_in_thread") == 0).cast("double")).alias("thread_initiation_rate"),
        F.avg((F.col("position_in_thread") == F.col("thread_size") - 1).cast("double")).alias("last_word_rate"),
    )


def turn_latencies(turns: DataFrame, thread: str, order: list[str], sender: str, date: str) -> DataFrame:
    """Seconds from each message to its predecessor in the thread; a null sender breaks the chain."""
    w = Window.partitionBy(thread).orderBy(*order)
    seconds = F.unix_seconds(F.col(date).cast("timestamp"))
    pairs = turns.select(thread, F.col(sender).alias("replier"), F.lag(sender).over(w).alias("author"), (seconds - F.lag(seconds).over(w)).alias("latency"))
    return pairs.where("replier IS NOT NULL AND author IS NOT NULL AND latency >= 0")


def latency_asymmetry(latencies: DataFrame, least: int = 3) -> DataFrame:
    """Median time others take to answer, less the median time the person takes; null unless
    both have ``least`` observations.  Exact medians of both sides, by position."""
    both = latencies.select(F.explode(F.array(F.struct(F.col("replier").alias("address"), F.lit("out").alias("side"), "latency"), F.struct(F.col("author").alias("address"), F.lit("in").alias("side"), "latency"))).alias("e"))
    both = both.select("e.*")
    sides = ("out", "in")
    n = both.groupBy("address").agg(*[F.count_if(F.col("side") == s).alias(f"n_{s}") for s in sides])
    middle = medians(both, ["address", "side"], "latency", "median").groupBy("address").agg(*[F.max(F.when(F.col("side") == s, F.col("median"))).alias(f"median_{s}") for s in sides])
    out = n.join(middle, "address")
    fine = (F.col("n_out") >= least) & (F.col("n_in") >= least)
    return out.select("address", "n_out", "n_in", F.when(fine, F.col("median_out") - F.col("median_in")).alias("reply_latency_asymmetry"))


def sender_features(*parts: DataFrame, key: str = "address", nullable: tuple[str, ...] = ("reply_latency_asymmetry",)) -> DataFrame:
    """Union of all senders; what a part doesn't know is 0, but for the nullable columns."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, key, "full")
    return out.na.fill(0, [c for c in out.columns if c != key and c not in nullable])


