"""The mail data source, and the cache sink with its lookups and manifest."""

from __future__ import annotations

import hashlib
import json
import os
import re
import socket

import pytest
from pyspark.sql import functions as F

from commlens.operators import runs as R
from commlens.sources import cache, mail, tables
from commlens.sources.maildir import Folder, MaildirReader

MAIL = "Message-ID: <{}>\nFrom: a@x.com\nTo: b@x.com\nSubject: Hi\n\nBody {}\n"


@pytest.fixture
def box(tmp_path, monkeypatch):
    """Folders with quotes, spaces and percent signs, nested ones, files at the top, and a socket."""
    root = tmp_path / "it's 100% mail"
    for i, name in enumerate(["zoe o'b/sent items/1.", "a-b/inbox/1.", "a/inbox/2.", "a/inbox/10.", "a/1.", "a/deep/er/1.", "top."]):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(MAIL.format(i, i))
    monkeypatch.chdir(root / "a/inbox")
    with socket.socket(socket.AF_UNIX) as s:  # listed, but can't be opened
        s.bind("broken.")
    (root / "empty").mkdir()
    return root


@pytest.mark.parametrize("options", [{}, {"depth": 0}, {"depth": 2, "splits": 3}, {"splits": 2, "batch_bytes": 1}])
def test_every_file_is_read_once(spark, box, options):
    out = mail.files(spark, str(box), **options).collect()
    want = sorted(os.path.relpath(os.path.join(d, f), box) for d, _, names in os.walk(box) for f in names)
    assert sorted(r.source_path for r in out) == want and len(want) == 8
    assert [r.source_path for r in out if r.error] == ["a/inbox/broken."] and all((r.content is None) == (r.error is not None) for r in out)
    assert {bytes(r.content) for r in out if r.content} == {(box / p).read_bytes() for p in want if "broken" not in p}


def test_limits_open_the_first_files_in_path_order(spark, box):
    order = ["a/1.", "a/deep/er/1.", "a/inbox/10.", "a/inbox/2.", "a/inbox/broken.", "a-b/inbox/1.", "top.", "zoe o'b/sent items/1."]
    for n in range(10):
        reader = MaildirReader({"path": str(box), "limit": str(n)})
        assert sorted(p[len(str(box)) + 1 :] for f in reader.partitions() for p in f.names) == sorted(order[:n])
    assert {r.source_path for r in mail.scan(spark, f"file://{box}", 6).collect()} == set(order[:6]) - {"a/inbox/broken."}
    assert mail.scan_report(spark, str(box)).first() == (8, 1)


def test_plans_name_folders_not_files(box):
    plan = MaildirReader({"path": str(box), "depth": "1", "splits": "2"}).partitions()
    assert all(isinstance(p, Folder) and p.names is None for p in plan) and len(plan) == 1 + 2 * 4
    many = MaildirReader({"path": str(box), "batch_bytes": "1"})
    assert [b.num_rows for b in many.read(Folder(f"{box}/a/inbox", True))] == [1, 1, 1]  # the third has no content
    gone = list(many.read(Folder(f"{box}/gone", True)))
    assert [b.column("error")[0].is_valid for b in gone] == [True] and gone[0].column("source_path")[0].as_py() == "gone"


def test_ingest_counts_what_was_skipped(spark, box):
    unique, recipients = mail.ingest(mail.scan(spark, str(box), splits=2))
    assert unique.count() == 7 == recipients.count()


# ---- cache ----------------------------------------------------------------------

RESPONSE = f"struct<{R.RESPONSE}>"


def entries(spark, numbers, made="2001-01-01 00:00:00", text="t"):
    rows = [(hashlib.sha256(str(i).encode()).hexdigest(), made, f"{text}{i}") for i in numbers]
    x = spark.createDataFrame(rows, "key string, at string, parsed string")
    usage = [F.lit(1).cast("long").alias(u) for u in R.USAGE]
    return x.select("key", F.col("at").cast("timestamp").alias("created"), F.struct(F.lit("m").alias("model")).alias("request"), F.struct("parsed", F.lit("m").alias("model"), *usage).alias("response"))


def held(spark, path):
    return {r.key: r.response.parsed for r in cache.entries(spark, path, RESPONSE).collect()}


def test_entries_are_sharded_by_key_and_the_newest_counts(spark, tmp_path):
    path = str(tmp_path / "c a'che")
    twice = entries(spark, range(40)).unionByName(entries(spark, [5, 5], "2001-01-02 00:00:00", "new"))
    cache.put(twice, path)
    cache.put(entries(spark, [7], "2000-01-01 00:00:00", "old").unionByName(entries(spark, [8, 99], "2002-01-01 00:00:00", "late")), path)
    found = held(spark, path)
    key = lambda i: hashlib.sha256(str(i).encode()).hexdigest()
    assert len(found) == 41 and (found[key(5)], found[key(7)], found[key(8)], found[key(99)]) == ("new5", "t7", "late8", "late99")
    for folder in os.listdir(path):
        if folder.startswith("prefix="):
            for f in os.listdir(f"{path}/{folder}"):
                if f.endswith(".json"):
                    keys = [json.loads(x)["key"] for x in open(f"{path}/{folder}/{f}")]
                    assert keys == sorted(set(keys)) and {k[:2] for k in keys} == {folder[-2:]}
    assert os.listdir(f"{path}/_staging") == []
    # the older reader finds them too
    assert tables.cache_entries(spark, path, RESPONSE).count() == 41


def test_lookups_read_the_folders_of_their_keys(spark, tmp_path):
    path = str(tmp_path / "cache")
    cache.put(entries(spark, range(300)), path)
    asked = entries(spark, [1, 2, 1000]).select("key")
    out = cache.lookup(asked, path, RESPONSE)
    assert {r.response.parsed for r in out.collect()} == {"t1", "t2"}
    plan = out._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*prefix", plan)
    read = {f for f in out.inputFiles()}
    assert read  # all files of the relation; the scan itself prunes them
    assert R.answered(asked.where("false").withColumn("cell_id", F.lit("c")), out, lambda m: m.select("key", F.lit(None).cast(RESPONSE).alias("response")), "cell_id").count() == 0


def test_a_failed_put_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "cache")
    cache.put(entries(spark, range(5)), path)
    boom = F.when(F.col("key") == hashlib.sha256(b"57").hexdigest(), F.raise_error(F.lit("boom")).cast("string")).otherwise(F.col("key"))
    spark.dataSource.register(cache.ResponseCache)
    rows = entries(spark, range(50, 60)).select(F.substring("key", 1, 2).alias("prefix"), boom.alias("key"), F.lit("{}").alias("entry")).repartition(4)
    with pytest.raises(Exception, match="boom"):
        rows.write.format("responsecache").option("path", path).mode("append").save()
    assert len(held(spark, path)) == 5 and os.listdir(f"{path}/_staging") == []
    same = entries(spark, [1]).select(F.lit("ab").alias("prefix"), F.lit("abc").alias("key"), F.lit("{}").alias("entry"))
    with pytest.raises(Exception, match="two entries"):
        same.unionAll(same).coalesce(1).write.format("responsecache").option("path", path).mode("append").save()


def test_the_manifest_lists_the_keys_that_put_wrote(spark, tmp_path):
    path, target = str(tmp_path / "cache"), str(tmp_path / "manifest")
    cache.put(entries(spark, range(60)), path)
    summary = cache.write_manifest(spark, path, target)
    lines = {}
    for d, _, names in os.walk(path):
        for n in names:
            if n.endswith(".json"):
                lines |= {json.loads(x)["key"]: hashlib.sha256(x.rstrip("\n").encode()).hexdigest() for x in open(f"{d}/{n}")}
    assert {r.key: r.sha256 for r in spark.read.parquet(f"{target}/entries").collect()} == lines and len(lines) == 60
    shards = {}
    for k, v in sorted(lines.items()):
        shards[k[:2]] = shards.get(k[:2], "") + k + v
    whole = "".join(p + hashlib.sha256(s.encode()).hexdigest() for p, s in sorted(shards.items()))
    assert summary == {"n_entries": 60, "n_shards": len(shards), "combined_sha256": hashlib.sha256(whole.encode()).hexdigest()} == json.load(open(f"{target}/summary.json"))
    cache.put(entries(spark, [3], "2005-01-01 00:00:00", "changed"), path)
    again = cache.write_manifest(spark, path, target)
    assert again["n_entries"] == 60 and again["combined_sha256"] != summary["combined_sha256"]


def test_run_manifests_are_written(tmp_path):
    R.write_manifest(R.manifest({"n_cells": 2}, "r", ("c", False), {}, ["b", "a"]), f"{tmp_path}/runs/r.json")
    assert json.load(open(f"{tmp_path}/runs/r.json"))["models"] == ["a", "b"]
