"""Collection of batch results as state: restarts, late, missing, unknown and repeated results."""

import pytest

from commlens.streaming import batches as B

HOUR = 3600


def _records(spark, asked, came):
    when = "timestamp_seconds(at)"
    requests = spark.createDataFrame(asked, "custom_id string, uid string, at long").selectExpr("custom_id", "uid", f"{when} AS submitted")
    results = spark.createDataFrame(came, "custom_id string, response string, at long").selectExpr("custom_id", "response", f"{when} AS created")
    return B.records(requests, results)


def _run(spark, folder, rows, **span):
    rows.write.mode("append").parquet(f"{folder}/in")
    B.collect_new(spark, f"{folder}/in", f"{folder}/out", f"{folder}/state", **span).awaitTermination()
    return sorted((r.custom_id, r.status, r.uid, r.response, r.delay_ms) for r in spark.read.schema(B.OUTCOME).parquet(f"{folder}/out").collect())


def test_outcomes_over_restarts(spark, tmp_path):
    t = 1_000_000_000
    span = {"within_s": 24 * HOUR, "remember_s": 72 * HOUR}
    first = _records(spark, [("a", "1", t), ("b", "2", t), ("c", "3", t), ("d", "4", t), (None, "5", t)], [("a", "A", t + HOUR), ("x", "X", t + HOUR), ("y", "Y", t + HOUR), (None, "Z", t)])
    assert _run(spark, tmp_path, first, **span) == [("a", "collected", "1", "A", HOUR * 1000)]
    # a restart: x meets its request, a comes again, and time goes on so that b, c, d and y have waited too long
    second = _records(spark, [("x", "6", t + 2 * HOUR), ("a", "1", t + 2 * HOUR), ("e", "7", t + 26 * HOUR)], [("a", "A2", t + 2 * HOUR), ("d", "D", t + 25 * HOUR), ("b", None, t + 23 * HOUR)])
    got = _run(spark, tmp_path, second, **span)
    want = [
        ("a", "collected", "1", "A", HOUR * 1000), ("a", "repeated", "1", "A2", 2 * HOUR * 1000), ("b", "collected", "2", None, 23 * HOUR * 1000), ("c", "missing", "3", None, None),
        ("d", "late", "4", "D", 25 * HOUR * 1000), ("x", "collected", "6", "X", -HOUR * 1000), ("y", "unknown", None, "Y", None),
    ]
    assert sorted(got, key=str) == sorted(want, key=str)
    # c is late after all; e is still open; what is older than the span is left out
    third = _records(spark, [("f", "8", t + 40 * HOUR)], [("c", "C", t + 30 * HOUR), ("c", "C", t + 31 * HOUR)])
    got = _run(spark, tmp_path, third, **span)
    assert sorted(got, key=str) == sorted([*want, ("c", "late", "3", "C", 30 * HOUR * 1000), ("c", "repeated", "3", "C", 31 * HOUR * 1000)], key=str)
    fourth = _records(spark, [("g", "9", t + 200 * HOUR)], [])
    got = _run(spark, tmp_path, fourth, **span)
    assert [g for g in got if g[0] in "efg"] == [("e", "missing", "7", None, None), ("f", "missing", "8", None, None)]
    fifth = _records(spark, [("a", "1", t + 150 * HOUR)], [("a", "A3", t + 3 * HOUR), ("a", "A4", t + 151 * HOUR)])
    got = _run(spark, tmp_path, fifth, **span)
    # the state of a was forgotten: its id may be used again, and the old result is not read
    assert [g[3] for g in got if g[0] == "a"] == ["A", "A4", "A2"]


def test_tables_and_empty_tables(spark):
    provider = spark.conf.get(B._PROVIDER)
    t = 1_000_000_000
    requests = spark.createDataFrame([(i, f"u{i}", t) for i in range(50)], "custom_id long, uid string, s long").selectExpr("*", "timestamp_seconds(s) AS submitted", "1 AS at")
    results = requests.where("custom_id % 2 = 0").selectExpr("custom_id", "submitted + INTERVAL 1 HOUR AS created", "'r' AS response", "2 AS ms")
    done = B.collect_all(requests, results, HOUR, HOUR)
    assert {r.status: r["count"] for r in done.groupBy("status").count().collect()}["collected"] == 25
    assert B.collect_all(requests.limit(0), results.limit(0)).count() == 0
    assert spark.conf.get(B._PROVIDER) == provider
    with pytest.raises(ValueError):
        B.outcomes(requests, 2, 1)
