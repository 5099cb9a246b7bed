"""Threads: linking, components, positions and summaries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commlens.functions.text import is_linkable_subject, seeded_order
from commlens.operators.ranks import small


def links(candidates: DataFrame, uid: str, subject: str, date: str, participants: str, days: int = 30, shared: int = 2, largest_group: int = 500) -> DataFrame:
    """Pairs (a, b) of messages with one subject, at most ``days`` apart, b not before a,
    with enough participants in common.  Subjects of under four characters link nothing, and
    neither do those of larger groups, which are templates; so a subject yields a bounded
    number of pairs.

    Only the keys and dates meet in the self-join; equal days are bucketed, so that only
    neighbouring buckets of a subject are compared.
    """
    candidates = candidates.where(is_linkable_subject(F.col(subject)))
    size = candidates.groupBy(subject).agg(F.count(F.lit(1)).alias("n_subject"))
    # the few template subjects are left out where rows are read, so that their rows don't meet in one task
    template = size.where(F.col("n_subject") > largest_group).select(subject)
    candidates = candidates.join(small(template), subject, "left_anti")
    size = size.where(F.col("n_subject").between(2, largest_group)).select(subject)
    day = F.floor(F.unix_seconds(F.col(date).cast("timestamp")) / (86400 * days))
    m = candidates.join(size, subject).select(F.col(subject).alias("subject"), F.col(uid).alias("uid"), F.col(date).alias("at"), F.col(participants).alias("who"), day.alias("bin"))
    a = m.select("subject", F.col("uid").alias("a"), F.col("at").alias("at_a"), F.col("who").alias("who_a"), F.explode(F.array("bin", F.col("bin") + 1)).alias("bin"))
    b = m.select("subject", "bin", F.col("uid").alias("b"), F.col("at").alias("at_b"), F.col("who").alias("who_b"))
    order = (F.col("at_a") < F.col("at_b")) | ((F.col("at_a") == F.col("at_b")) & (F.col("a") < F.col("b")))
    close = F.col("at_b") <= F.col("at_a") + F.expr(f"INTERVAL {days} DAYS")
    common = F.size(F.array_intersect("who_a", "who_b")) >= shared
    return a.join(b, ["subject", "bin"]).where(order & close & common).select("subject", "a", "b")


def _union_find(pdf: pd.DataFrame) -> pd.DataFrame:
    root: dict = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(pdf["a"], pdf["b"], strict=True):
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return pd.DataFrame({"uid": list(root), "thread_id": [find(x) for x in root]})


def components(messages: DataFrame, pairs: DataFrame, uid: str, kind: str = "long") -> DataFrame:
    """thread_id (the smallest uid that is linked) of every message.

    Links never cross a subject and a subject has at most 500 messages, so each group is
    bounded and solved in one task; no iteration over the whole graph is needed.
    """
    found = pairs.groupBy("subject").applyInPandas(_union_find, f"uid {kind}, thread_id {kind}")
    return messages.join(found.withColumnRenamed("uid", uid), uid, "left").withColumn("thread_id", F.coalesce("thread_id", F.col(uid)))


def positions(messages: DataFrame, thread: str, uid: str, date: str, sender: str) -> DataFrame:
    """Position, size, root flag, senders, conversation flag and seconds since the root."""
    w = Window.partitionBy(thread)
    at = F.row_number().over(w.orderBy(date, uid)) - 1
    seconds = F.unix_seconds(F.col(date).cast("timestamp"))
    out = messages.withColumns(
        {
            "position_in_thread": at,
            "thread_size": F.count(F.lit(1)).over(w),
            "n_distinct_senders": F.size(F.collect_set(sender).over(w)).cast("long"),
            "since_root": seconds - F.min(seconds).over(w),
        }
    )
    return out.withColumns(
        {
            "is_root": F.col("position_in_thread") == 0,
            "is_conversation": (F.col("thread_size") > 1) & (F.col("n_distinct_senders") > 1),
            "reply_latency_seconds": F.when(F.col("position_in_thread") > 0, F.col("since_root")),
        }
    ).drop("since_root")


def summary(threads: DataFrame, thread: str) -> DataFrame:
    """Counts over all threads; the mean size is over message rows."""
    one = threads.groupBy(thread).agg(F.max("thread_size").alias("size"), F.max("is_conversation").alias("conversation"), F.count(F.lit(1)).alias("rows"))
    return one.agg(
        F.sum("rows").alias("messages"),
        F.count(F.lit(1)).alias("threads"),
        F.count_if("conversation").alias("conversations"),
        F.count_if(F.col("conversation") & (F.col("size") >= 3)).alias("conversations_of_3"),
        F.count_if((F.col("size") > 1) & ~F.col("conversation")).alias("single_sender_groups"),
        F.count_if(F.col("size") == 1).alias("singletons"),
        F.max("size").alias("largest"),
        F.round(F.sum(F.col("size") * F.col("rows")) / F.sum("rows"), 6).alias("mean_thread_size"),
    )


def review_sample(threads: DataFrame, thread: str, position: str, line: Column, n: int, seed: int) -> DataFrame:
    """One text block for each of n conversations, in a seeded hash order, to be judged by hand."""
    chosen = threads.where("is_conversation").select(thread).distinct().orderBy(seeded_order(seed, F.col(thread))).limit(n)
    rows = threads.join(F.broadcast(chosen), thread).select(thread, F.struct(F.col(position).alias("at"), F.format_string("  %2d. %s", F.col(position), line).alias("line")).alias("x"))
    blocks = rows.groupBy(thread).agg(F.array_sort(F.collect_list("x")).alias("x"))
    head = F.format_string("THREAD %s  (%d messages)   [ ] CORRECT  [ ] WRONG", F.col(thread).cast("string"), F.size("x"))
    return blocks.select(thread, F.concat_ws("\n", head, F.transform("x", lambda r: r["line"])).alias("block"))


def size_histogram(threads: DataFrame, thread: str, most: int = 10) -> DataFrame:
    """Threads of each of the smallest sizes above one."""
    return threads.where("thread_size > 1").groupBy("thread_size").agg(F.countDistinct(thread).alias("threads")).orderBy("thread_size").limit(most)
