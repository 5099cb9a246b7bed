"""Periodic runs, exact duplicates and the Merkle manifest against brute force and edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from commlens.llm import exact_dedup, merkle, periodic, queries

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = {"runs": 1, "collapsed": "x", "print": 2, "digest": "d", "row": 3, "bits": "b", "maybe": True, "grp": "g", "part": 4, "pos": 5, "level": 6, "idx": 7, "at": 8, "id": 9, "salt": 10, "line": 11}


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents with nulls, empty and long texts, repeated ids and rows, copies, capitals, periodic texts, clashing columns."""
    rng = random.Random(11)
    word = lambda: rng.choice(["ka", "To", "mi", "RU", "né", "漢", "x"])
    rows = [(i, " ".join(word() for _ in range(rng.randrange(0, 90))), rng.choice(["aa", "bb", None, "", "é"]), rng.choice(["s", None, "web"]), rng.choice([None, 3, -4])) for i in range(230)]
    rows += [(300 + i, "  one two\tthree\n" * (8 + i) + rows[i][1], "aa", "s", i) for i in range(6)]
    rows += [(400 + i, rows[i % 3][1], "bb", "s", 1) for i in range(40)]  # copies of three texts
    rows += [(500, None, "aa", None, None), (501, "", "aa", "s", 0), (502, " \t\n\v\f\r ", "aa", "s", 7), (None, rows[5][1], "cc", "s", 1), (None, "Alone Without Id", None, None, None), (None, None, "one", None, None)]
    rows += [(7, rows[7][1], "aa", "s", 1), (7, "another TEXT of the same id", "aa", "s", 1), (503, "twin", "dd", "s", 4), (503, "twin", "dd", "s", 4), (503, "twin", "dd", "s", 4)]
    rows += [(600, "z" * 60_000 + " " + " ".join(word() for _ in range(30_000)) + " p q" * 4000, "aa", "s", 1), (601, "w " * 20_000, "bb", "s", 2)]
    where = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, COLUMNS).withColumns({k: F.lit(v) for k, v in CLASH.items()}).repartition(5).write.parquet(f"{where}/documents.parquet")
    return where


@pytest.fixture(scope="module")
def rows(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()


def same(spark, folder, name):
    """The query's rows are those of its SQL."""
    got = queries.QUERIES[name](spark, folder)
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
        want = con.execute(queries.ORACLE_SQL[name])
        assert got.columns == [c[0] for c in want.description]
        return Counter(map(tuple, got.collect())), Counter(want.fetchall())


# ---- periodic runs --------------------------------------------------------------


def brute_runs(words, least, exponent):
    """Maximal stretches of every period, longest ones first found by their smallest period."""
    code = {w: i for i, w in enumerate(dict.fromkeys(words))}
    w = np.array([code[x] for x in words], dtype=np.int64)
    found = {}
    for p in range(1, len(w) // exponent + 1):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (w[:-p] == w[p:]).astype(int), [0]])))
        for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if z + p - a >= max(least, exponent * p):
                found.setdefault((a, z + p - a), p)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=60), min_size=1, max_size=5), st.sampled_from([(24, 3), (4, 2), (6, 2), (9, 3)]))
def test_runs_of_random_texts(texts, least):
    assert periodic.text_runs([" ".join(t) for t in texts], *least) == [brute_runs(t, *least) for t in texts]


def test_runs_of_built_texts():
    rng = random.Random(2)
    texts = []
    for _ in range(60):
        t = [rng.choice("abcdefgh") for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(4)):
            t += [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))] * rng.randrange(1, 12) + [rng.choice("abc")] * rng.randrange(30)
        texts.append(t)
    fibonacci = ["a", "ab"]
    while len(fibonacci) < 14:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    texts += [list(x) for x in fibonacci] + [["a"] * 300, list("ab" * 150), []]
    for least in ((24, 3), (4, 2)):
        assert periodic.text_runs([" ".join(t) for t in texts], *least) == [brute_runs(t, *least) for t in texts]


def test_a_window_is_not_missed_and_a_hash_is_no_answer():
    words, owner = np.array([1, 2, 3, 1, 2, 3, 9, 1, 2, 3]), np.array([0] * 6 + [1] * 4)
    assert periodic.repeats_window(words, owner, 3).tolist() == [0]
    assert periodic.repeats_window(words, owner, 4).tolist() == [] and periodic.repeats_window(words[:2], owner[:2], 3).tolist() == []
    with pytest.raises(ValueError):
        periodic.find_runs(None, 3, 3)


def test_op11(spark, folder, rows):
    want = Counter()
    for r in rows:
        words, n = words_of(r.text), len(words_of(r.text))
        h = zlib.crc32(str(r.doc_id).encode()) if r.doc_id is not None else 1
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words, 24, 3)
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=(None,) * 3)
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        figures = [len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))]
        want[(r.doc_id, *figures)] += 1
    out = queries.QUERIES["op11_periodic_runs"](spark, folder)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(map(tuple, out.collect())) == want
    assert sum(n for x, n in want.items() if x[1]) >= 15


def test_runs_and_collapsed_texts(spark):
    docs = spark.createDataFrame([("k", "x " + "a b c " * 9 + "y"), (None, None), ("e", "")], "doc_id string, text string")
    out = {r.doc_id: r for r in periodic.find_runs(docs).collect()}
    assert [tuple(x) for x in out["k"].runs] == [(1, 27, 3)] and out["k"].collapsed == "x a b c y"
    assert out[None].runs == [] and out[None].collapsed == "" == out["e"].collapsed
    assert periodic.find_runs(docs.limit(0)).count() == 0


# ---- exact duplicates -----------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), min_size=1, max_size=60), st.integers(0, 1 << 20))
def test_golomb_codes_are_lossless(numbers, low):
    x = np.sort(np.array(numbers, dtype=np.int64)) + low
    assert exact_dedup.ungolomb(exact_dedup.golomb(x, low), len(x), low).tolist() == x.tolist()


def test_golomb_codes_are_short():
    x = np.unique(np.random.default_rng(1).integers(0, 1 << 36, 50_000))
    assert len(exact_dedup.golomb(x, 0)) * 8 / len(x) < 36 - np.log2(len(x)) + 2


def brute_groups(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.text or "", []).append(r.doc_id)
    want = Counter()
    for t, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        for k, i in enumerate(sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True)):
            want[i, best, len(ids), k == 0, sha(t)] += 1
    return want


@pytest.mark.parametrize("chunk,owned", [(exact_dedup.CHUNK, exact_dedup.OWNED), (7, 20)])
def test_duplicates_equal_brute_force(spark, folder, rows, chunk, owned):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = brute_groups(rows)
    got = exact_dedup.find_duplicates(docs, chunk, owned)
    assert Counter(map(tuple, got.collect())) == want
    left = exact_dedup.drop_duplicates(docs, chunk, owned)
    assert left.columns == docs.columns
    kept = Counter((r.doc_id, sha(r.text or "")) for r in left.collect())
    assert kept == Counter((i, t) for i, _, _, k, t in want.elements() if k)


def test_few_are_suspected_and_no_copy_is_missed(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.when(F.col("id") < 3990, F.col("id")).otherwise(5).cast("string")).alias("text"))
    judged, _ = exact_dedup._judged(docs, 300, 900)
    suspects = {r.doc_id for r in judged.where("suspect").collect()}
    assert {5, *range(3990, 4000)} <= suspects and len(suspects) < 40 and judged.count() == 4000


def test_op12(spark, folder, rows):
    got = queries.QUERIES["op12_exact_dedup"](spark, folder)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, got.collect())) == brute_groups(rows)
    # the SQL has no rule for rows without an id or with the same one
    once = [i for i, n in Counter(r.doc_id for r in rows).items() if n == 1 and i is not None]
    got, want = same(spark, folder, "op12_exact_dedup")
    assert {x for x in got if x[0] in once} == {x for x in want if x[0] in once}
    empty = spark.createDataFrame([], COLUMNS)
    assert exact_dedup.find_duplicates(empty).count() == 0 == exact_dedup.drop_duplicates(empty).count()


# ---- Merkle manifest ------------------------------------------------------------


def tree(leaves, fanout):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    return levels


def siblings(levels, i, fanout):
    out = []
    for nodes in levels[:-1]:
        first = i // fanout * fanout
        out.append((nodes[first:i], nodes[i + 1 : first + fanout]))
        i //= fanout
    return out


@pytest.mark.parametrize("fanout,total", [(2, 1), (2, 2), (3, 3), (3, 28), (8, 8), (8, 9), (8, 600), (2, 77)])
def test_mountain_ranges_of_cut_leaves_meet(fanout, total):
    """Whatever the cuts, complete nodes and merged edges are the tree's nodes, each once."""
    rng = random.Random(total)
    leaves = [sha(str(i)) for i in range(total)]
    levels = tree(leaves, fanout)
    for _ in range(20):
        cuts = sorted({0, total, *(rng.randrange(total) for _ in range(rng.randrange(6)))})
        nodes = []
        for a, z in zip(cuts, cuts[1:], strict=False):
            hills = merkle.Range(a, total, fanout)
            nodes += [x for d in leaves[a:z] for x in hills.add(d)] + list(hills.rest())
        edges = {(k, i): d for k, i, d, e in nodes if e}
        for k, level in enumerate(levels[:-1]):  # as ``merged`` does
            for up in {i // fanout for lv, i in edges if lv == k}:
                edges[k + 1, up] = sha("".join(edges[k, i] for i in range(up * fanout, min((up + 1) * fanout, len(level)))))
        got = {(k, i): d for k, i, d, _ in nodes} | edges
        assert got == {(k, i): d for k, level in enumerate(levels) for i, d in enumerate(level)}
        assert edges[len(levels) - 1, 0] == levels[-1][0] and len(nodes) == len({(k, i) for k, i, _, _ in nodes})


@pytest.mark.parametrize("fanout,run", [(8, 9), (2, 3), (3, 1000)])
def test_the_manifest_equals_the_trees(spark, fanout, run):
    rng = random.Random(fanout)
    leaves = [(i, f"={'abcdefghij'[min(9, rng.randrange(14))]}" if i % 7 else "", sha(str(i)), sha(str(i if i % 3 else -i))) for i in rng.sample(range(900), 260)]
    book = merkle.Manifest(spark.createDataFrame(leaves, "id long, grp string, digest string, claimed string").repartition(4), fanout, run)
    groups = {}
    for x in sorted(leaves):
        groups.setdefault(x[1], []).append(x)
    trees = {g: tree([x[2] for x in v], fanout) for g, v in groups.items()}
    names = sorted(groups)
    over = tree([trees[g][-1][0] for g in names], fanout)
    want = {("group", g, k, i, d) for g, t in trees.items() for k, level in enumerate(t) if k for i, d in enumerate(level)}
    want |= {("all", "", k, i, d) for k, level in enumerate(over) if k for i, d in enumerate(level)}
    records = [tuple(r) for r in book.records().collect()]
    assert set(records) == want and len(records) == len(want)
    if run < 100:
        assert book.trees.runs.count() > len(groups)
    got = {r.id: r for r in book.proofs().collect()}
    assert len(got) == len(leaves)
    for g, v in groups.items():
        for i, x in enumerate(v):
            path = siblings(trees[g], i, fanout) + siblings(over, names.index(g), fanout)
            folded = merkle.fold(x[3], path)
            assert tuple(got[x[0]])[1:] == (x[2], trees[g][-1][0], over[-1][0], sha("".join(s for a, z in path for s in a + z)), folded, folded == over[-1][0])
            assert got[x[0]].verified == (x[0] % 3 != 0 or x[0] == 0)


def test_op13(spark, folder, rows):
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: sha("".join(map(value, (r.doc_id, r.source, r.lang, r.n_chars, t))))
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: x[:3])
        trees[g] = tree([x[2] for x in groups[g]], 8)
    over = tree([trees[g][-1][0] for g in names], 8)
    want = Counter()
    for k, g in enumerate(names):
        for i, (_, _, own, r) in enumerate(groups[g]):
            path = siblings(trees[g], i, 8) + siblings(over, k, 8)
            claimed = own
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and r.text is not None:
                claimed = leaf(r, re.sub("[A-Z]", lambda m: m[0].lower(), r.text))
            folded = merkle.fold(claimed, path)
            want[r.doc_id, own, trees[g][-1][0], over[-1][0], sha("".join(s for a, z in path for s in a + z)), folded, folded == over[-1][0]] += 1
    out = queries.QUERIES["op13_merkle_manifest"](spark, folder)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, out.collect())) == want
    assert sum(n for x, n in want.items() if not x[-1]) > 20


def test_op13_sql_and_empty_table(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").dropDuplicates(["doc_id"]).where("doc_id IS NOT NULL")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got, want = same(spark, str(tmp_path), "op13_merkle_manifest")
    assert got == want and len(got) > 250
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    for n in ("op11_periodic_runs", "op12_exact_dedup", "op13_merkle_manifest"):
        assert queries.QUERIES[n](spark, f"{tmp_path}/none").count() == 0
