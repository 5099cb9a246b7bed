"""Readers and writers of tables, snapshots, ledgers, caches and configuration."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EMPLOYEES = "employee_id int, full_name string, department string, department_long string, title string, gender string, given_seniority string"
TITLES = "title string, seniority_rank int, rank_label string, given_seniority string"
LEDGER = "timestamp string, run_id string, provider string, model string, call_kind string, batch int, from_cache int, input_tokens long, cache_creation_input_tokens long, cache_read_input_tokens long, output_tokens long, cost_usd double"


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def employees(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated, without header and quoting; blank lines are skipped."""
    return spark.read.schema(EMPLOYEES).option("sep", "\t").option("quote", "").csv(path).where("full_name IS NOT NULL")


def title_ranks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TITLES).option("header", "true").csv(path)


def known_addresses(spark: SparkSession, addresses: Iterable[str], name: str) -> DataFrame:
    """A temporary view of addresses; values are never put into SQL text."""
    df = spark.createDataFrame([(a,) for a in addresses], "address string")
    df.createOrReplaceTempView(name)
    return df


def ledger_total(spark: SparkSession, path: str) -> float:
    """Sum of the ledger; 0 without one."""
    if not exists(spark, path):
        return 0.0
    return spark.read.schema(LEDGER).option("header", "true").csv(path).agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0))).first()[0]


def append_ledger(rows: DataFrame, path: str) -> None:
    """Append rows; every file of the ledger has a header."""
    rows.select([x.split()[0] for x in LEDGER.split(", ")]).write.mode("append").option("header", "true").csv(path)


def write_parts(df: DataFrame, path: str, rows_per_file: int = 20_000) -> None:
    """zstd Parquet parts of bounded size; stale parts go."""
    df.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)


def json_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def memory_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """persona -> memories, one row a memory with its position."""
    items = "map<string,array<struct<text:string,importance:double,hours_ago:double,kind:string>>>"
    text = spark.read.option("wholetext", "true").text(path)
    stores = text.select(F.explode(F.from_json("value", items)).alias("persona_id", "memories"))
    return stores.select("persona_id", F.posexplode("memories").alias("position", "m")).select("persona_id", "position", "m.*")


def freeze(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_report(df: DataFrame, path: str) -> dict:
    """A one-row report as JSON with sorted keys, on the driver's machine."""
    report = df.first().asDict(recursive=True)
    Path(path).write_text(json.dumps(report, indent=2, sort_keys=True, default=str) + "\n")
    return report


def markdown(report: dict, title: str) -> str:
    """A report as Markdown: a table of its figures, and a section for each nested report."""

    def table(figures: dict) -> list[str]:
        rows = [f"| {k} | {v:,.4f} |" if isinstance(v, float) else f"| {k} | {v:,} |" if isinstance(v, int) and not isinstance(v, bool) else f"| {k} | {v} |" for k, v in figures.items()]
        return ["| figure | value |", "| --- | ---: |", *rows] if rows else []

    lines = [f"# {title}", "", *table({k: v for k, v in sorted(report.items()) if not isinstance(v, dict)})]
    for name, part in report.items():
        if isinstance(part, dict):
            lines += ["", f"## {name}", "", *table(part)]
    return "\n".join(lines) + "\n"


def cache_entries(spark: SparkSession, path: str, response: str) -> DataFrame:
    """The newest entry of each key of an append-only response cache, sharded folders included."""
    rows = spark.read.schema(f"key string, created timestamp, response {response}").option("recursiveFileLookup", "true").json(path)
    return rows.groupBy("key").agg(F.max_by("response", "created").alias("response"))


def cache_manifest(spark: SparkSession, path: str) -> dict:
    """Entries of a folder of one file a key, and the sha256 over all keys and their files' sha256 in key order.

    For a cache that is written by Spark see ``cache.write_manifest``.
    Files are hashed on the executors; the driver streams the sorted pairs and holds one
    range of them at a time.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    pairs = files.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("key"), F.sha2("content", 256).alias("digest")).orderBy("key", "digest")
    whole, n = hashlib.sha256(), 0
    for r in pairs.toLocalIterator():
        whole.update(f"{r.key}{r.digest}".encode())
        n += 1
    return {"n_entries": n, "combined_sha256": whole.hexdigest()}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store Spark reads it from."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def live_or_snapshot(spark: SparkSession, live: list[str], derive: Callable[[], DataFrame], snapshot: Callable[[], DataFrame]) -> tuple[str, DataFrame]:
    """Derived from the processed tables if all of them are there, else the frozen snapshot."""
    if all(exists(spark, p) for p in live):
        return "live", derive()
    return "snapshot", snapshot()


def read_config(*paths: str) -> dict:
    """Layered YAML (or JSON) files; an empty one counts as no settings."""
    layers = []
    for p in paths:
        text = Path(p).read_text(encoding="utf-8")
        layer = json.loads(text) if p.endswith(".json") else _yaml(text)
        if not isinstance(layer or {}, dict):
            raise TypeError(f"{p} must hold a mapping")
        layers.append(layer or {})
    return layered_config(*layers)


def _yaml(text: str):
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML configuration needs the yaml package; use JSON files") from e
    return yaml.safe_load(text)


def layered_config(*layers: dict) -> dict:
    """Later layers override earlier ones, nested mappings key by key."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = layered_config(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out
