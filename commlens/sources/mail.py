"""Maildir scan and tolerant mail parsing."""

from __future__ import annotations

import email
import email.policy
from email.utils import getaddresses, parsedate_to_datetime
from datetime import timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commlens.functions import text as T
from commlens.operators.messages import explode_recipients, keep_first
from commlens.sources.maildir import Maildir

PARSED = (
    "message_id string, in_reply_to string, references string, date timestamp_ntz, from_addr string, subject string, "
    "x_from string, x_to string, x_folder string, x_origin string, to array<string>, cc array<string>, bcc array<string>, body_raw string"
)


def files(spark: SparkSession, root: str, limit: int | None = None, **options: int) -> DataFrame:
    """source_path, length, content and error of every file (see ``maildir``)."""
    spark.dataSource.register(Maildir)
    reader = spark.read.format("maildir").option("path", root).options(**options)
    return (reader if limit is None else reader.option("limit", limit)).load()


def scan(spark: SparkSession, root: str, limit: int | None = None, **options: int) -> DataFrame:
    """source_path, content of the files that can be read.  The order of paths is by their parts, so
    that the surviving copy of a message does not depend on how separators sort.

    A limit takes the first paths, readable or not; only these files are opened.
    """
    return files(spark, root, limit, **options).where("error IS NULL").select("source_path", "content")


def scan_report(spark: SparkSession, root: str) -> DataFrame:
    """Files found, and those that can't be read (skipped by ``scan``)."""
    return files(spark, root).agg(F.count(F.lit(1)).alias("files_found"), F.count("error").alias("files_unreadable"))


def _header(msg, name: str) -> str | None:
    try:
        value = msg.get(name)
        return None if value is None else str(value).strip() or None
    except Exception:  # a header that the parser chokes on counts as absent
        return None


def _addresses(msg, *names: str) -> list[str]:
    values = [v for n in names if (v := _header(msg, n))]
    found = (a.strip().strip("<>").lower() for _, a in getaddresses(values))
    return list(dict.fromkeys(a for a in found if "@" in a))


def _date(value: str | None):
    try:
        d = parsedate_to_datetime(value)
        return d.astimezone(timezone.utc).replace(tzinfo=None) if d.tzinfo else d
    except (TypeError, ValueError, OverflowError, IndexError):
        return None


def _body(msg) -> str:
    for part in msg.walk():
        if part.get_content_type() == "text/plain" and not part.is_multipart():
            data = part.get_payload(decode=True) or b""
            for charset in (part.get_content_charset(), "utf-8", "cp1252"):
                try:
                    return data.decode(charset or "utf-8")
                except (LookupError, UnicodeDecodeError):
                    continue
            return data.decode("latin-1")
    return ""


def parse(raw: bytes) -> tuple:
    """Fields of one message, in the order of PARSED; never raises."""
    msg = email.message_from_bytes(bytes(raw or b""), policy=email.policy.compat32)
    return (
        *(_header(msg, n) for n in ("Message-ID", "In-Reply-To", "References")), _date(_header(msg, "Date")),
        next(iter(_addresses(msg, "From")), None), *(_header(msg, n) for n in ("Subject", "X-From", "X-To", "X-Folder", "X-Origin")),
        _addresses(msg, "To"), _addresses(msg, "Cc", "X-cc"), _addresses(msg, "Bcc", "X-bcc"), _body(msg),
    )


def parsed(files: DataFrame) -> DataFrame:
    """Parsed messages; the mail grammar is the one thing that needs Python."""
    names = [x.split()[0] for x in PARSED.split(", ")]

    @F.pandas_udf(f"struct<{PARSED.replace(' ', ':').replace(',:', ',')}>")
    def fields(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(x) for x in content], columns=names)

    return files.select("source_path", fields("content").alias("m")).select("source_path", "m.*")


def ingest(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unique messages (first copy in path order) and their recipients."""
    p = parsed(files)
    first_id = lambda c: F.get(T.message_ids(F.col(c)), 0)
    uid = T.content_fingerprint(F.col("from_addr"), F.col("date"), F.col("subject"), F.col("body_raw"))
    p = p.withColumns({"message_uid": uid, "path_parts": F.split("source_path", "/"), "reference_ids": T.message_ids(F.col("references")), "message_id": first_id("message_id"), "in_reply_to": first_id("in_reply_to")})
    one = keep_first(p, "message_uid", "path_parts").drop("path_parts")
    clean = T.clean_body(F.col("body_raw"))
    out = one.withColumns({"body_clean": clean, "n_to": F.size("to"), "n_cc": F.size("cc"), "n_bcc": F.size("bcc")})
    out = out.withColumns({"n_recipients": F.col("n_to") + F.col("n_cc") + F.col("n_bcc"), "n_tokens_clean": T.token_count(F.col("body_clean")), "is_empty_after_clean": F.length("body_clean") == 0})
    recipients = explode_recipients(out, "message_uid", {"to": "to", "cc": "cc", "bcc": "bcc"})
    return out, recipients


def ingest_report(parsed_: DataFrame, unique: DataFrame, recipients: DataFrame) -> DataFrame:
    """Counters over all readable files, over the unique messages, and over recipients."""
    every = parsed_.agg(
        F.count(F.lit(1)).alias("scanned"), F.countDistinct("message_id").alias("distinct_message_ids"),
        F.count_if(F.col("date").isNull()).alias("missing_date"), F.count_if(F.col("from_addr").isNull()).alias("missing_from"),
        F.count_if(F.col("in_reply_to").isNotNull() | F.col("references").isNotNull()).alias("has_threading_headers"),
    )
    kept = unique.agg(F.count(F.lit(1)).alias("unique_messages"), F.count_if("is_empty_after_clean").alias("empty_after_clean"))
    rows = recipients.agg(F.count(F.lit(1)).alias("recipient_rows"))
    one = every.crossJoin(kept).crossJoin(rows)  # three single rows
    return one.withColumns({"duplicates": F.col("scanned") - F.col("unique_messages"), "factor": F.col("scanned") / F.col("unique_messages")})
