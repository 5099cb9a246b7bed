"""Indexes and filters in several parts, and columns with the names that operators use inside."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from commlens.llm import common, decontam, langid, neardup, toxicity

NAMES = ["t", "T_", "_t", "score", "_score", "at", "md5", "digest", "id", "commlens_md5", "commlens_at", "lang_pred", "coverage", "known", "h0", "n"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    sounds = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sch", "ung", "der", "ach"], "cc": ["que", "oux", "les", "ent"]}
    text = lambda lang, n: " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = []
    for i in range(120):
        lang = rng.choice(list(sounds))
        rows.append((i, text(lang, rng.randrange(20, 60)) + (" vile scum" * 3 if i % 5 == 0 else ""), lang if i % 4 else None))
    rows += [(200, None, "aa"), (201, "", None), (202, "12", "bb"), (203, "xqz wvk " * 30, None), (204, "漢字", None), (3, rows[4][1], "aa"), (None, rows[8][1], "bb"), (205, rows[9][1], "cc")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(c) for c in NAMES}).repartition(3)


def same_rows(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_names_that_no_column_has(spark):
    df = spark.createDataFrame([(1, 2)], "T int, t_ int")
    assert common.unused(df, "t") == "t__" and common.unused(df, "x") == "x"


def test_filters_in_parts_give_the_same_languages(spark, docs):
    whole, parts = langid.train(docs), langid.train(docs, most_log2=10)
    assert isinstance(whole, langid.Filters) and isinstance(parts, langid.Parts) and parts.parts >= 4
    each = list(parts.each())
    assert {f.part for f in each} == set(range(parts.parts)) and all(len(f.slots) == 1 << parts.log2 for f in each)
    # every n-gram is in exactly one part, and no part misses its own
    texts = [r.text or "" for r in docs.collect()]
    n = sum(f.hits(texts)[0] for f in each)
    assert n.tolist() == whole.hits(texts)[0].tolist()
    a, b = ({(r.doc_id, r.lang_pred, round(r.score, 1)) for r in langid.predict(docs, f).collect()} for f in (whole, parts))
    assert {x[:2] for x in a} == {x[:2] for x in b} and len(a ^ b) < 0.1 * len(a)
    assert langid.predict(docs, parts).count() == docs.count()
    for share in (0.35, 0.0, 2.0):
        kept = langid.keep_covered(docs, parts, share)
        assert kept.columns == docs.columns and same_rows(kept, langid.keep_covered(docs, whole, share))


def test_typical_coverage_is_the_median_of_all_labelled_texts(spark):
    rng = random.Random(12)
    word = lambda sounds: "".join(rng.choice(sounds) for _ in range(4))
    rows = [(i if i % 7 else None, " ".join(word(["ka", "to", "mi", "ru"] if rng.random() < i / 6001 else ["xq", "vw", "zj"]) for _ in range(rng.randrange(8, 40))), "aa" if i % 3 else None) for i in range(9001)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    fitted = spark.createDataFrame([(" ".join(word(["ka", "to", "mi", "ru"]) for _ in range(12)), "aa") for _ in range(40)], "text string, lang string")
    for filters in (langid.train(fitted), langid.train(fitted, most_log2=10)):
        if isinstance(filters, langid.Parts):
            whole = {r.t: r.coverage for r in filters.measured(df).collect()}
            each = [whole[r.t] for r in df.where("lang IS NOT NULL").select(langid.text_key()).collect()]
        else:
            each = filters.measure([t for _, t, lang in rows if lang])[2].tolist()
        assert len(each) == 6000 and len(set(each)) > 100
        assert abs(langid.typical_coverage(df, filters) - np.median(each)) < 1e-12


def test_false_positives_are_no_more_frequent_in_parts(spark):
    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9000, 400))) for _ in range(60)]  # almost every n-gram is new
    df = spark.createDataFrame([(i, t, "ab"[i % 2] * 2) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    parts = langid.train(df, most_log2=12)
    assert isinstance(parts, langid.Parts) and all(f.false_rate.max() < 0.05 for f in parts.each())
    assert {(r.doc_id, r.lang_pred) for r in langid.predict(df, parts).collect()} == {(i, "ab"[i % 2] * 2) for i in range(60)}


def test_an_index_in_parts_gives_the_same_hits(spark, docs, monkeypatch):
    rng = random.Random(4)
    item = lambda: " ".join("".join(rng.choice("bcdfghaeiou") for _ in range(5)) for _ in range(40)).capitalize() + "."
    items = [(i, f"{item()} {item()}") for i in range(12)]
    bench = spark.createDataFrame([*items, (50, ""), (51, None)], "item_id long, text string")
    leaks = [(300 + i, f"ka to mi {items[i][1]} ru ka", "aa") for i in (0, 5, 11)]
    more = docs.unionByName(spark.createDataFrame(leaks, "doc_id long, text string, lang string").withColumns({c: F.lit(c) for c in NAMES}))
    whole, clean = decontam.find_contaminated(more, bench), decontam.keep_clean(more, bench)
    want, left = sorted(map(str, whole.collect())), sorted(map(str, clean.collect()))
    assert {(r.doc_id, r.item_id) for r in whole.collect()} == {(300, 0), (305, 5), (311, 11)} and len(left) == more.count() - 3
    monkeypatch.setattr(decontam, "INDEX_BYTES", 1500)
    assert decontam.part_count(bench) > 3
    alive = []
    plain = spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda x: alive.append(plain(x)) or alive[-1])
    assert sorted(map(str, decontam.find_contaminated(more, bench).collect())) == want
    assert len(alive) == decontam.part_count(bench)
    out = decontam.keep_clean(more, bench)
    assert out.columns == more.columns and sorted(map(str, out.collect())) == left
    none = bench.limit(0)
    assert decontam.keep_clean(more, none).count() == more.count() and decontam.find_contaminated(more, none).count() == 0


def test_columns_with_the_names_used_inside_stay_as_they_are(spark, docs, monkeypatch):
    labels = docs.select("doc_id", (F.col("doc_id") % 5 == 0).cast("int").alias("toxic")).where("doc_id < 120")
    kept = {}
    for most in (toxicity.BROADCAST_GRAMS, 0):
        monkeypatch.setattr(toxicity, "BROADCAST_GRAMS", most)
        out = toxicity.keep_below(docs, toxicity.train(docs, labels), 0.5)
        assert out.columns == docs.columns and out.select(*NAMES).distinct().collect() == docs.select(*NAMES).distinct().collect()
        kept[most] = sorted(map(str, out.select("doc_id", "text").collect()))
    assert len(set(map(tuple, kept.values()))) == 1 and 60 < len(kept[0]) < docs.count()
    one = neardup.one_of_each(docs, 5, 80)
    assert one.columns == docs.columns and one.select(*NAMES).distinct().count() == 1
    assert one.where("doc_id = 205").count() == 0 and one.where("doc_id = 9").count() == 1
