"""Distributions as columns, paired tests of groups, and joins of bucketed features."""

from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from commlens.operators import experiment as X
from commlens.operators import features as S
from commlens.operators import statistics as Z
from commlens.plans import catalog
from commlens.session import bucketed


def column(spark, values, f):
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, " + ", ".join(f"x{k} double" for k in range(len(values[0]))))
    return [r.y for r in df.select("i", f(*[F.col(f"x{k}") for k in range(len(values[0]))]).alias("y")).orderBy("i").collect()]


def test_error_function_and_gamma(spark):
    x = [0.0, 1e-9, 0.1, 0.5, 1.0, 2.0, 2.49, 2.5, 2.51, 3.0, 5.0, 9.0, 20.0]
    for got, v in zip(column(spark, [(v,) for v in x], Z.erfc), x, strict=True):
        assert math.isclose(got, math.erfc(v), rel_tol=1e-12 if v > 2.6 or v < 2 else 1e-10)
    x = [0.5, 0.75, 1.0, 1.5, 2.0, 3.7, 10.0, 170.5, 1e4, 1e6]
    for got, v in zip(column(spark, [(v,) for v in x], Z.ln_gamma), x, strict=True):
        assert math.isclose(got, math.lgamma(v), rel_tol=1e-12, abs_tol=1e-12)


def above(t, df):
    """P(T > t) by Simpson's rule over the angle."""
    n, top = 20_000, math.atan(abs(t) / math.sqrt(df))
    s = sum((1 if i in (0, n) else 4 if i % 2 else 2) * math.cos(top * i / n) ** (df - 1) for i in range(n + 1)) * top / n / 3
    half = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi) * s
    return 0.5 - half if t > 0 else 0.5 + half


def test_students_t(spark):
    points = [(t, df) for t in (-30.0, -2.228, -1.0, -1e-6, 0.0, 1e-6, 0.3, 1.0, 2.0, 2.228, 5.0, 12.706) for df in (1.0, 2.0, 3.0, 10.0, 29.0, 200.0)]
    for got, (t, df) in zip(column(spark, points, Z.t_above), points, strict=True):
        assert math.isclose(got, above(t, df), rel_tol=1e-7, abs_tol=1e-11), (t, df)
    # far tails keep their digits: df 1 is the Cauchy distribution
    assert math.isclose(column(spark, [(1e6, 1.0)], Z.t_above)[0], math.atan(1e-6) / math.pi, rel_tol=1e-9)


def test_null_distribution_by_all_sign_patterns(spark):
    table = {r.n: r.ways for r in Z.signed_rank_table(spark).collect()}
    for n in range(1, 11):
        ways = [0.0] * (n * (n + 1) // 2 + 1)
        for signs in itertools.product((0, 1), repeat=n):
            ways[sum(r for r, s in zip(range(1, n + 1), signs, strict=True) if s)] += 1
        assert table[n] == ways
    assert len(table) == 50 and sum(table[50]) == 2.0**50


def brute_wilcoxon(d):
    own = [x for x in d if x]
    n = len(own)
    size = [abs(x) for x in own]
    rank = {s: (size.count(s) + 1) / 2 + sum(x < s for x in size) for s in size}
    plus, minus = (sum((rank[abs(x)] for x in own if (x > 0) == up), 0.0) for up in (True, False))
    ties = sum(size.count(s) ** 3 - size.count(s) for s in set(size))
    return n, min(plus, minus), float(ties), X.wilcoxon_p(min(plus, minus), n, ties)


def test_signed_rank_tests_of_groups(spark):
    rng = random.Random(5)
    groups = {"zero": [0.0] * 4, "one": [2.0], "all": [float(k) for k in range(1, 51)], "many": [rng.gauss(0.3, 1) for _ in range(51)], "even": [1.0, -1.0, 2.0, -2.0], None: [0.5, 0.25, -4.0]}
    groups |= {f"g{k}": [rng.choice([rng.gauss(0, 1), float(rng.randrange(-4, 5))]) for _ in range(rng.randrange(1, 60))] for k in range(20)}
    rows = [(g, x + 1, 1.0) for g, d in groups.items() for x in d] + [("zero", None, 1.0), ("gone", None, 2.0)]
    df = spark.createDataFrame(rows, "g string, a double, b double").repartition(5)
    # null groups meet no others in joins; a group is named where it may be null
    out = {r.g: r for r in Z.wilcoxon_by(df.withColumn("g", F.coalesce("g", F.lit("-"))), ["g"], "a", "b").collect()}
    assert len(out) == len(groups)
    for g, d in groups.items():
        d = [(x + 1) - 1.0 for x in d]
        r = out[g or "-"]
        n, w, ties, p = brute_wilcoxon(d)
        assert (r.n_pairs, r.n, r.w, r.ties) == (len(d), n, w, ties)
        assert math.isclose(r.p_value, p, rel_tol=1e-9, abs_tol=1e-12)
    assert Z.wilcoxon_by(df.limit(0), ["g"], "a", "b").count() == 0


def test_equivalence_tests_of_groups(spark):
    rng = random.Random(6)
    groups = {f"g{k}": [rng.gauss(rng.choice([0, 0.3, 1]), 0.5) for _ in range(rng.randrange(2, 40))] for k in range(15)} | {"same": [0.25] * 5, "far": [0.75] * 3, "single": [0.25], "edge": [0.5, 0.5]}
    df = spark.createDataFrame([(g, x, 0.0) for g, d in groups.items() for x in d] + [("g0", None, 1.0)], "g string, a double, b double")
    out = {r.g: r for r in Z.tost_by(df, ["g"], "a", "b", margin=0.5).collect()}
    assert len(out) == len(groups)
    for g, d in groups.items():
        n, m = len(d), sum(d) / len(d)
        se = math.sqrt(sum((x - m) ** 2 for x in d) / (n - 1) / n) if n > 1 else 0.0
        lower, upper = (float(not -0.5 < m < 0.5),) * 2 if not se else (above((m + 0.5) / se, n - 1), above((0.5 - m) / se, n - 1))
        r = out[g]
        assert math.isclose(r.p_lower, lower, abs_tol=1e-8) and math.isclose(r.p_upper, upper, abs_tol=1e-8)
        assert r.equivalent == (lower < 0.05 and upper < 0.05) and math.isclose(r.mean_difference, m, abs_tol=1e-12)
    assert out["same"].equivalent and out["single"].equivalent and not out["far"].equivalent and not out["edge"].equivalent


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bucketed_messages_meet_their_features_without_an_exchange(spark, no_broadcast):
    messages = spark.createDataFrame([(i, f"s{i % 3}", i) for i in range(20)], "uid int, sender string, n int")
    layer_a = spark.createDataFrame([(i, i / 10) for i in range(2, 30)], "uid int, hedge_rate double")
    layer_b = spark.createDataFrame([("s0", 0.5), ("s1", 0.25)], "address string, centrality double")
    out = S.joined_features(bucketed(messages, "uid", 4), bucketed(layer_a, "uid", 4), layer_b, "uid", "sender", "n")
    rows = {r.uid: r for r in out.collect()}
    assert set(rows) == set(range(2, 20)) and [rows[i].is_broadcast for i in (9, 10)] == [0.0, 1.0]
    assert rows[3].centrality == 0.5 and rows[5].centrality is None
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(sender" in plan and "Exchange hashpartitioning(uid" not in plan
    plan = catalog._joined(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(sender" in plan and "Exchange hashpartitioning(doc_id" not in plan


def test_cross_validation_equals_a_fold_in_numpy(spark):
    import numpy as np
    from pyspark.ml.feature import StopWordsRemover

    rng = random.Random(9)
    vocabulary = ["alpha", "beta", "gamma", "delta", "the", "x", "omega", "sigma"]
    rows = [(i, " ".join(rng.choice(vocabulary[(i % 2) :]) for _ in range(rng.randrange(1, 12))) + f" only{i}", i % 2) for i in range(41)] + [(90, None, 1), (91, "the", 0)]
    df = spark.createDataFrame(rows, "i int, t string, y int")
    fitted = {}
    plain = X.features

    def spy(counts, idf):
        out = plain(counts, idf)
        fitted[len(fitted), id(idf)] = (out.collect(), idf)
        return out

    X.features = spy
    try:
        got = X.text_auc(df, "i", "t", "y", folds=3, rounds=100, tol=1e-9).first()
    finally:
        X.features = plain
    stop = set(StopWordsRemover.loadDefaultStopWords("english"))
    words = {i: [w for w in (t or "").split() if len(w) > 1 and w not in stop] for i, t, _ in rows}
    folds = {r.uid: r.fold for r in next(iter(fitted.values()))[0]}
    assert got.folds == 3 and len(fitted) == 3 and len(folds) == 43
    values = []
    for held in range(3):
        train = [i for i in words if folds[i] != held]
        known = {w for i in train for w in words[i]}
        idf = {w: math.log((len(train) + 1) / (sum(w in words[i] for i in train) + 1)) + 1 for w in known}
        every = sorted({w for x in words.values() for w in x})
        full = [idf.get(w, 0.0) for w in every]  # words that no training row has weigh nothing
        out = next(rows_ for rows_, weights in fitted.values() if len(weights) == len(full) and all(map(math.isclose, weights, full)))
        place = {w: k for k, w in enumerate(every)}
        number = {w: k for k, w in enumerate(sorted(known))}
        x = {i: np.zeros(len(known)) for i in words}
        for i, ws in words.items():
            for w in ws:
                if w in known:
                    x[i][number[w]] += idf[w]
            x[i] /= np.linalg.norm(x[i]) or 1
        for r in out:
            v = r.features
            assert all(math.isclose(v[place[w]], x[r.uid][number[w]], abs_tol=1e-12) for w in known) and math.isclose(v.norm(2) ** 2, float(x[r.uid] @ x[r.uid]), abs_tol=1e-9)
        # ridge-penalised logistic regression by Newton's method, the intercept without penalty
        a = np.array([[1.0, *x[i]] for i in train])
        y = np.array([rows[[q[0] for q in rows].index(i)][2] for i in train], dtype=float)
        w, ridge = np.zeros(a.shape[1]), np.diag([0.0] + [1.0] * len(known)) / len(train)
        for _ in range(60):
            p = 1 / (1 + np.exp(-a @ w))
            w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a / len(train) + ridge, a.T @ (p - y) / len(train) + ridge @ w)
        test = [i for i in words if folds[i] == held]
        score = {i: w[0] + x[i] @ w[1:] for i in test}
        label = {q[0]: q[2] for q in rows}
        pairs = [(score[i] > score[j]) + (math.isclose(score[i], score[j], abs_tol=1e-9)) / 2 for i in test for j in test if label[i] == 1 and label[j] == 0]
        values.append(sum(pairs) / len(pairs))
    assert math.isclose(got.mean_auc, sum(values) / 3, abs_tol=1e-6)
