"""Tags, root verbs and sentence boundaries against brute force and sentences judged by hand."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from commlens.operators import boundaries as B
from commlens.operators import features as S
from commlens.operators import tagging as G
from commlens.plans import language


@pytest.fixture(scope="module")
def tagger(spark):
    return G.train(G.tagged_mail(spark))


def test_counts_are_those_of_the_tagged_sentences(spark, tagger):
    rows = G.tagged_mail(spark).collect()
    want = Counter((G.shape(r.word), r.tag) for r in rows)
    assert {(w, t): n for w, x in tagger.words.items() for t, n in x.items()} == want
    ends = Counter((e, r.tag) for r in rows for e in G.endings(G.shape(r.word), r.place > 0 and r.word[0].isupper()))
    assert {(e, t): n for e, x in tagger.ends.items() for t, n in x.items()} == ends
    assert math.isclose(np.exp(tagger.start).sum() , (1 - G.SMOOTH) + G.SMOOTH, rel_tol=1e-6)


def test_viterbi_finds_the_best_of_all_taggings(tagger):
    rng = random.Random(1)
    small = G.Tagger(["DT", "NN", "VB"], np.array([[0, 5, 1, 0], [1, 1, 2, 4], [4, 1, 0, 1], [3, 2, 4, 0]]), {"a": {"DT": 3, "NN": 1}, "b": {"NN": 2, "VB": 2}, "c": {"VB": 3}}, {"c": {"VB": 3}})
    for _ in range(60):
        words = [rng.choice("abcd") for _ in range(rng.randrange(1, 7))]
        best = max(small.score(words, list(p)) for p in itertools.product(small.tags, repeat=len(words)))
        assert math.isclose(small.score(words, small.decode([words])[0]), best)
    # the whole model, step by step in plain Python; sentences of one length are decoded together
    sentences = [G.tokens(s) for s in ("Send me the report.", "Reports are due.", "Foo bars the baz !", "Zork", "", "a " * 300)]
    for words, tags in zip(sentences, tagger.decode(sentences), strict=True):
        if not words:
            assert tags == []
            continue
        row = {t: tagger.start[k] + tagger.emission(words[0], True)[k] for k, t in enumerate(tagger.tags)}
        for w in words[1:]:
            e = tagger.emission(w, False)
            row = {t: max(row[b] + tagger.step[tagger.at[b], k] for b in row) + e[k] for k, t in enumerate(tagger.tags)}
        assert math.isclose(tagger.score(words, tags), max(row[t] + tagger.stop[k] for k, t in enumerate(tagger.tags)))


@pytest.mark.parametrize(
    "sentence,want",
    [
        ("Send me the report by Friday.", True), ("He sends the report every Friday.", False), ("Send the report.", True), ("The weather is nice.", False),
        ("I agree.", False), ("Thanks for your help.", False), ("Please send this by 3/15.", True), ("Pay the bill.", True), ("Are we still on for Friday?", False),
        ("Did you read his will?", False), ("The meeting went well.", False), ("Sure thing.", False), ("Don't worry about it.", True), ("John, send it.", True),
        ("If you can, review the numbers.", True), ("Reports are due on Friday.", False), ("Sending it now.", False), ("Do you know him?", False), ("", False),
    ],
)
def test_imperatives_of_sentences_judged_by_hand(tagger, sentence, want):
    words = G.tokens(sentence)
    assert G.is_imperative(words, tagger.decode([words])[0]) is want


def test_tags_of_sentences_tagged_by_hand(tagger):
    own = {"The lawyers sent the signed contract yesterday .": "DT NNS VBD DT VBN NN NN #", "We will review your order on Monday .": "PRP MD VB DT NN IN NNP #", "She wants to close the deal .": "PRP VBZ TO VB DT NN #", "Check these files carefully .": "VB DT NNS RB #"}
    right = [(a, b) for s, t in own.items() for a, b in zip(tagger.decode([s.split()])[0], t.split(), strict=True)]
    assert sum(a == b for a, b in right) / len(right) > 0.85


def test_features_of_tagged_sentences(spark, tagger):
    df = spark.createDataFrame([(1, "Send the report. The weather is nice. I agree. Thanks for your help."), (2, ""), (3, None), (4, "You must go. Forward it.")], "id int, body string")
    cut = df.withColumn("s", B._lines(F.col("body"))).withColumn("s", F.flatten("s"))
    tagged = G.tagged_sentences(cut, "s", tagger)
    out = {r.id: r for r in S.lexical_features(tagged, "id", "body", cut=F.col("s"), roots=F.transform("tagged", lambda x: x["imperative"])).collect()}
    assert [(out[i].n_sentences, out[i].imperative_ratio) for i in (1, 2, 3, 4)] == [(4, 0.25), (0, 0.0), (0, 0.0), (2, 1.0)]
    with pytest.raises(ValueError):
        G.train(G.tagged_mail(spark).limit(0))


def corpus(spark):
    rng = random.Random(3)
    names = ["Smith", "Jones", "Lee", "Wood"]
    rows = []
    for i in range(300):
        rows.append((i, f"We met Mr. {rng.choice(names)} about approx. {rng.randrange(2, 99)}.5 tons. The price went up e.g. by oil costs. He left at noon.\nThat is all!  See you"))
        rows.append((400 + i, "the tons of costs at noon rose"))
    return spark.createDataFrame([*rows, (900, None), (901, ""), (902, "x" * 5000 + ". End. " + "word " * 3000)], "id int, t string")


def brute_types(texts):
    out = {}
    for t in texts:
        words = [w for w in re.split("[ \t\r\n]+", t or "") if w]
        for before, w in zip([".", *words], words, strict=False):
            m = re.search(r"([^\W_](?:[\w.'-]*[^\W_])?)(\.?)[\W_]*$", w)
            if len(w) <= B.LONGEST and m:
                c = out.setdefault(m[1].lower(), [0, 0, 0, 0])
                c[0 if m[2] else 1] += 1
                up = m[1][0] != m[1][0].lower()
                c[2] += not up
                c[3] += up and not re.search(r"[.!?][\W_]*$", before)
    return out


def test_types_and_abbreviations_equal_brute_force(spark):
    df = corpus(spark)
    types = B.type_counts(df, "t")
    want = brute_types([r.t for r in df.collect()])
    assert {r.type: [r.dotted, r.bare, r.low, r.inside] for r in types.collect()} == want
    p = sum(c[0] for c in want.values()) / sum(c[0] + c[1] for c in want.values())
    found = {}
    for t, (k, bare, _, _) in want.items():
        if k:
            ratio = -2 * (k * math.log(p) + bare * math.log(1 - p) - k * math.log(0.99) - bare * math.log(0.01))
            letters = len(t.replace(".", ""))
            if (score := ratio * math.exp(-letters) * (t.count(".") + 1) * letters ** float(-bare)) >= B.LEAST_SCORE:
                found[t] = round(score, 6)
    assert {r.type: r.score for r in B.abbreviations(types).collect()} == pytest.approx(found)
    assert {"mr", "approx", "e.g"} <= set(found) and not {"noon", "costs", "tons"} & set(found)


def test_no_split_behind_abbreviations_or_inside_numbers(spark):
    df = corpus(spark)
    types = B.type_counts(df, "t")
    found, first = B.abbreviations(types), B.starters(types)
    out = {r.id: r.sentences for r in B.split_sentences(df, "id", "t", found, first).collect()}
    assert len(out) == 603 and out[900] == out[901] == []
    assert all(len(out[i]) == 5 for i in range(300))
    assert re.fullmatch(r"We met Mr\. \w+ about approx\. \d+\.5 tons\.", out[0][0]) and out[0][1:] == ["The price went up e.g. by oil costs.", "He left at noon.", "That is all!", "See you"]
    # an abbreviation at the end of a sentence, before a word that is capitalised only there
    first = first.unionByName(spark.createDataFrame([("we",)], "type string"))
    more = spark.createDataFrame([(1, "It was Mr. We left. It was Mr. Lee."), (2, "Mr. smith. 3.5. Ok")], "id int, t string")
    out = {r.id: r.sentences for r in B.split_sentences(more, "id", "t", found, first).collect()}
    assert out[1] == ["It was Mr.", "We left.", "It was Mr. Lee."] and out[2] == ["Mr. smith.", "3.5.", "Ok"]


def test_the_query_tags_every_body(spark):
    sf = "/root/testdata/sf0.001"
    out = {r.doc_id: r for r in language.tagged_features(spark, sf).collect()}
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.n_sentences >= 1 for r in out.values()) and len({r.imperative_ratio for r in out.values()}) > 3
