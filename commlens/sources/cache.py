"""A response cache sharded by key: a sink with commit and abort, point lookups, and a manifest.

``<path>/prefix=ab/`` holds the entries whose key begins with ab, one JSON line each, in the order
of their keys.  Tasks write below ``_staging``, which readers pass over; the commit moves whole files
into place, and an abort deletes what was staged.  A commit that breaks off leaves complete
entries only, and putting them again is harmless: readers take the newest entry of a key.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from commlens.sources.stores import open_store

#: Characters of a prefix: 256 shards of hexadecimal keys.
WIDTH = 2
ROW = "prefix string, key string, entry string"


@dataclass
class Staged(WriterCommitMessage):
    files: list[str]
    n: int


class CacheWriter(DataSourceArrowWriter):
    """Files of rows that come sorted by prefix and key."""

    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        store, base = open_store(self.path)
        staged, out, at, last, n = Staged([], 0), None, None, None, 0
        try:
            for b in iterator:
                for prefix, key, entry in zip(*(b.column(c).to_pylist() for c in ("prefix", "key", "entry")), strict=True):
                    if key == last:
                        raise ValueError(f"two entries of the key {key}")
                    last = key
                    if prefix != at:
                        if out is not None:
                            out.close()
                        at, file = prefix, f"prefix={prefix}/{self.job}-{uuid.uuid4().hex}.json"
                        store.create_dir(f"{base}/_staging/{self.job}/prefix={prefix}")
                        out = store.open_output_stream(f"{base}/_staging/{self.job}/{file}")
                        staged.files.append(file)
                    out.write(entry.encode() + b"\n")
                    n += 1
        finally:
            if out is not None:
                out.close()
        staged.n = n
        return staged

    def commit(self, messages: list[Staged | None]) -> None:
        store, base = open_store(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        for prefix in {f.partition("/")[0] for f in files}:
            store.create_dir(f"{base}/{prefix}")
        for f in files:
            store.move(f"{base}/_staging/{self.job}/{f}", f"{base}/{f}")
        self._clear(store, base)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear(*open_store(self.path))

    def _clear(self, store: fs.FileSystem, base: str) -> None:
        if store.get_file_info(f"{base}/_staging/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/_staging/{self.job}")


class ResponseCache(DataSource):
    @classmethod
    def name(cls) -> str:
        return "responsecache"

    def schema(self) -> str:
        return ROW

    def writer(self, schema, overwrite: bool) -> CacheWriter:
        return CacheWriter(self.options["path"])


def _prefix(key: str = "key"):
    return F.substring(key, 1, WIDTH)


def put(entries: DataFrame, path: str) -> None:
    """Add (key, created, request, response): the newest of each key, all of them or none."""
    spark = entries.sparkSession
    spark.dataSource.register(ResponseCache)
    line = F.to_json(F.struct("key", "created", "request", "response"), {"ignoreNullFields": "false"})
    one = entries.groupBy("key").agg(F.max_by(line, "created").alias("entry"))
    rows = one.select(_prefix().alias("prefix"), "key", "entry").repartition("prefix").sortWithinPartitions("prefix", "key")
    rows.write.format("responsecache").option("path", path).mode("append").save()


def entries(spark: SparkSession, path: str, response: str) -> DataFrame:
    """prefix, key, response: the newest entry of each key."""
    rows = spark.read.schema(f"key string, created timestamp, response {response}, prefix string").json(path)
    return rows.groupBy("prefix", "key").agg(F.max_by("response", "created").alias("response"))


def lookup(requests: DataFrame, path: str, response: str) -> DataFrame:
    """key, response of the requests' keys that are cached; only the folders of their prefixes are read."""
    some = [r[0] for r in requests.select(_prefix()).distinct().collect()]  # at most 16**WIDTH
    rows = requests.sparkSession.read.schema(f"key string, created timestamp, response {response}, prefix string").json(path).where(F.col("prefix").isin(some))
    return rows.join(requests.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.max_by("response", "created").alias("response"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """prefix, key, sha256 of the newest entry's line, for every key."""
    lines = spark.read.schema("value string, prefix string").text(path)
    told = lines.select("prefix", F.get_json_object("value", "$.key").alias("key"), F.get_json_object("value", "$.created").cast("timestamp").alias("created"), F.sha2("value", 256).alias("sha256"))
    return told.groupBy("prefix", "key").agg(F.max_by("sha256", "created").alias("sha256"))


def write_manifest(spark: SparkSession, path: str, target: str) -> dict:
    """Write the manifest's table to ``target``, and its summary to ``target``/summary.json; the summary.

    Each shard's digest is that of its keys and their digests in the order of the keys; the
    combined one is that of the shards' digests, so the driver holds a row a shard.
    """
    manifest(spark, path).repartition("prefix").sortWithinPartitions("prefix", "key").write.mode("overwrite").parquet(f"{target}/entries")
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("key", "sha256"))), lambda x: F.concat(x["key"], x["sha256"]))
    shards = spark.read.parquet(f"{target}/entries").groupBy("prefix").agg(F.sha2(F.concat_ws("", pairs), 256).alias("digest"), F.count(F.lit(1)).alias("n"))
    rows = sorted(shards.collect())
    combined = spark.range(1).select(F.sha2(F.lit("".join(r.prefix + r.digest for r in rows)), 256)).first()[0]
    summary = {"n_entries": sum(r.n for r in rows), "n_shards": len(rows), "combined_sha256": combined}
    store, base = open_store(target)
    with store.open_output_stream(f"{base}/summary.json") as f:
        f.write(json.dumps(summary, indent=2, sort_keys=True).encode() + b"\n")
    return summary
