"""Ingest, eligibility, identity and role operators, parameterised by column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commlens.functions.text import normalize_display_name


def keep_first(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key (the survivor of a dedup).

    One aggregation with map-side combine; no window, so a hot key is no hot task.
    """
    rest = [c for c in df.columns if c != key]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("kept")
    return df.groupBy(key).agg(first).select(key, *[F.col("kept")[c].alias(c) for c in rest])


def duplication_report(df: DataFrame, key: str, is_empty: Column) -> DataFrame:
    """Rows, unique keys, duplicates, factor and empty survivors, in two aggregations."""
    groups = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(is_empty).alias("empty"))
    return groups.agg(
        F.sum("n").alias("scanned"),
        F.count(F.lit(1)).alias("unique_messages"),
        (F.sum("n") - F.count(F.lit(1))).alias("duplicates"),
        F.round(F.sum("n") / F.count(F.lit(1)), 6).alias("factor"),
        F.count_if("empty").alias("empty_after_clean"),
    )


def eligible(is_empty: Column, tokens: Column, date: Column, internal: Column, least: float, most: float, begin: str, end: str) -> Column:
    """Not empty, size and date in range (the end date counts up to its midnight), internal sender."""
    return ~is_empty & tokens.between(least, most) & date.between(F.lit(begin).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")) & internal


def eligibility_report(df: DataFrame, eligible_: Column, known_sender: Column) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("messages"), F.count_if(eligible_).alias("eligible"), F.count_if(eligible_ & known_sender).alias("eligible_known"),
    ).withColumn("share_known", F.round(F.col("eligible_known") / F.col("eligible"), 6))


def sender_counts_middle(df: DataFrame, sender: str, many: int) -> DataFrame:
    """Per-sender counts: the number of senders, the middle one (the element at n // 2 in
    descending order, no average) and how many have at least ``many``.

    The middle comes from a histogram of counts, not from a sort of all senders.
    """
    n = df.groupBy(sender).agg(F.count(F.lit(1)).alias("n"))
    histogram = n.groupBy("n").agg(F.count(F.lit(1)).alias("senders"))
    total = histogram.agg(F.sum("senders").alias("all_senders"), F.coalesce(F.sum(F.when(F.col("n") >= many, F.col("senders"))), F.lit(0)).alias("active"))
    w = Window.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, 0)  # one row a distinct count
    ranked = histogram.withColumn("upto", F.sum("senders").over(w)).crossJoin(F.broadcast(total))
    return ranked.where(F.col("upto") > F.floor(F.col("all_senders") / 2)).groupBy("all_senders", "active").agg(F.max("n").alias("middle"))


def explode_recipients(df: DataFrame, uid: str, fields: dict[str, str]) -> DataFrame:
    """One row for each address in each field; distinct within a field only."""

    def pairs(field: str) -> Column:
        return F.transform(F.array_distinct(F.col(fields[field])), lambda a: F.struct(a.alias("address"), F.lit(field).alias("field")))

    return df.select(uid, F.explode(F.concat(*map(pairs, fields))).alias("r")).select(uid, "r.address", "r.field").where("address IS NOT NULL")


def thread_candidates(messages: DataFrame, recipients: DataFrame, uid: str, date: str, address: str, sender: str) -> DataFrame:
    """Dated messages with their participants, sender and recipients, as a sorted list (a null sender is none)."""
    lists = recipients.groupBy(uid).agg(F.collect_set(address).alias("participants"))
    kind = dict(lists.dtypes)["participants"]
    people = F.array_union(F.coalesce("participants", F.array().cast(kind)), F.array_compact(F.array(F.col(sender))).cast(kind))
    return messages.where(F.col(date).isNotNull()).join(lists, uid, "left").withColumn("participants", F.array_sort(people))


# Folders that hold a mailbox's own mail.
SENT_FOLDERS = ["sent", "sent_items", "_sent_mail", "sent items"]


def in_sent_folder(path: Column) -> Column:
    """Whether the second part of a message's path is a folder of sent mail."""
    return F.lower(F.split_part(path, F.lit("/"), F.lit(2))).isin(SENT_FOLDERS)


def owner_names(sent: DataFrame, mailbox: str, name: str) -> DataFrame:
    """The distinct normalised display names of each mailbox's sent mail, in order."""
    one = sent.select(mailbox, normalize_display_name(F.col(name)).alias("name")).where("name <> ''").distinct()
    return one.groupBy(mailbox).agg(F.array_sort(F.collect_list("name")).alias("display_names"))


def resolve_owners(sent: DataFrame, mailbox: str, sender: str, least_share: float = 0.02) -> DataFrame:
    """Addresses of each mailbox: those with a large enough share of its sent mail, or else
    its most frequent one; the primary one is the most frequent (ties: the smaller)."""
    n = sent.where(F.col(sender).isNotNull()).groupBy(mailbox, sender).agg(F.count(F.lit(1)).alias("n_sent"))
    best = n.groupBy(mailbox).agg(F.sum("n_sent").alias("total"), F.min(F.struct((-F.col("n_sent")).alias("k"), F.col(sender).alias("v"))).alias("top"))
    share = F.col("n_sent") / F.col("total")
    # many rows of n share a mailbox only up to its number of addresses
    out = n.join(best, mailbox).withColumns({"share": F.round(share, 6), "is_primary": F.col(sender) == F.col("top.v")})
    return out.where((share >= least_share) | F.col("is_primary")).select(mailbox, sender, "n_sent", "share", "is_primary")


def uncontested(owners: DataFrame, address: str, mailbox: str) -> DataFrame:
    """address -> mailbox where only one mailbox claims the address."""
    return owners.groupBy(address).agg(F.min(mailbox).alias(mailbox), F.max(mailbox).alias("other")).where(F.col(mailbox) == F.col("other")).drop("other")


def coverage(df: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Rows, and rows whose key is known; a null key is not."""
    flags = known.select(F.col(known_key).alias(key), F.lit(True).alias("hit")).distinct()
    return df.join(flags, key, "left").agg(F.count(F.lit(1)).alias("messages"), F.count_if("hit").alias("known"))


def match_unambiguous(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on a key that the left side must have only once."""
    once = left.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(key)
    return left.join(once, key).join(right, key)


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right, key, "left_anti")


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of row by column; the column's values are given, so no extra job finds them."""
    return df.groupBy(row).pivot(column, values).count().na.fill(0)
