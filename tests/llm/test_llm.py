"""The training-data operators against brute force, round trips and edge cases."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from commlens.llm import ann, bpe, components, decontam, langid, license_scan, neardup, records, token_count, toxicity, url_filter

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string"
ODD = ["", None, " ", "a", "a", "don't  stop \n\n it", "ÉTÉ été <|endoftext|> Σας", "x" * 3000, "\x1c a\x1cb \u00a0c", "漢字 かな 😀", "1 2  3\t", "the the the the"]


def docs(spark, texts, start=0):
    rows = [(start + i, t, "en", "s", len(t or ""), 0.5, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def noise(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(n))


# ---- tokens ---------------------------------------------------------------------


def reference_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD).encode(text, add_special_tokens=False).ids


def random_texts(n, seed=1):
    rng = random.Random(seed)
    alphabet = "ab é\n\t  \x1c\x85's<|endoftext|>0 9,.ñßΣ漢字😀  \u200b"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_word_ids_equal_the_library():
    encoder = token_count.WordEncoder(WORD)
    texts = [t or "" for t in ODD] + random_texts(300) + ["a<|EndOfText|> <|end b", "End. end, 'x', É; ñ. $$ #a#"]
    ids, n = encoder.encode(texts)
    for t, part in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert part.tolist() == reference_ids(t)
    assert encoder.encode(texts, counts_only=True)[1].tolist() == n.tolist()
    assert encoder.encode([])[1].tolist() == []


@pytest.mark.parametrize("chunk,overlap", [(10, 3), (1, 1), (40, 20)])
def test_overlaps_splice_to_the_whole(chunk, overlap):
    encoder = token_count.WordEncoder(WORD)
    for t in [t or "" for t in ODD if len(t or "") < 100] + random_texts(100, 2) + ["y" * 90 + " z " + "w" * 90]:
        assert np.frombuffer(token_count.encode_overlapping(encoder, t, chunk, overlap), "<u2").tolist() == reference_ids(t)


def test_a_word_longer_than_a_chunk_widens_both_chunks_only(monkeypatch):
    encoder = token_count.WordEncoder(WORD)
    text = "q " * 50 + "z" * 500 + " " + "ab cd " * 400
    sizes = []
    plain = encoder.encode_chunk
    monkeypatch.setattr(encoder, "encode_chunk", lambda chunk, offset: (sizes.append(len(chunk)), plain(chunk, offset))[1])
    assert np.frombuffer(token_count.encode_overlapping(encoder, text, 40, 8), "<u2").tolist() == reference_ids(text)
    assert max(sizes) < 1500 < len(text)


def test_token_counts_edges(spark):
    out = rows(token_count.count_tokens(docs(spark, ODD), WORD, limit=1))
    for i, t in enumerate(ODD):
        assert out[i].n_tokens == len(reference_ids(t or "")) and out[i].n_bytes == len((t or "").encode())
        assert out[i].over_limit == (out[i].n_tokens > 1)
    assert token_count.count_tokens(docs(spark, []), WORD).count() == 0


def test_byte_bpe_equals_tiktoken(spark):
    import tiktoken

    ranks = bpe.read_ranks(BYTE)
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.ByteBPE(ranks, public_tokenizers.PATTERN)
    texts = [t or "" for t in ODD] + random_texts(400, 3)
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(t)
        assert own.decode(ids) == t.encode()
    out = rows(bpe.digest_documents(docs(spark, ODD), BYTE, public_tokenizers.PATTERN))
    for i, t in enumerate(ODD):
        ids = reference.encode_ordinary(t or "")
        assert out[i].n_tokens == len(ids)
        assert out[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_records_round_trip(spark):
    texts = [t if t is None or "<|" not in t else "plain" for t in ODD] * 3
    out = rows(records.round_trip(docs(spark, texts), WORD, 2))
    start = 0
    for i, t in enumerate(texts):
        ids = [*reference_ids(t or ""), 2]
        assert (out[i].start, out[i].n_tokens, out[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert records.round_trip(docs(spark, []), WORD, 2).count() == 0


def test_shuffled_reads_by_the_index(spark, tmp_path):
    texts = [f"word{i} " * (i % 7) for i in range(60)]
    folder = f"file://{tmp_path}/records"
    manifest = records.write_records(docs(spark, texts), WORD, folder, 2, shard_bytes=500).collect()
    assert len(manifest) > 2 and sum(r.n_docs for r in manifest) == 60
    first, again, other = ([(r.doc_id, r.ids) for r in records.read_shuffled(spark, folder, seed).collect()] for seed in (1, 1, 2))
    assert sorted(first) == [(i, [*reference_ids(t), 2]) for i, t in enumerate(texts)] == sorted(other)
    assert [i for i, _ in first] == [i for i, _ in again] != [i for i, _ in other]
    assert [i for i, _ in first] != sorted(i for i, _ in first)


def test_shards_end_inside_their_range(spark, tmp_path, monkeypatch):
    texts = [f"word{i} " * (1 + i % 9) for i in range(200)]
    whole = rows(records.round_trip(docs(spark, texts), WORD, 2))
    monkeypatch.setattr(records, "MOST_RANGES", 3)
    folder = f"file://{tmp_path}/records"
    manifest = records.write_records(docs(spark, texts), WORD, folder, 2, shard_bytes=600).collect()
    buckets = {b: sorted(r.part for r in manifest if r.bucket == b) for b in {r.bucket for r in manifest}}
    assert len(buckets) <= 3 < len(manifest) and all(parts == list(range(len(parts))) for parts in buckets.values())
    assert rows(records.read_digests(spark, folder)) == whole
    got = [(r.doc_id, r.ids) for r in records.read_shuffled(spark, folder, 4).collect()]
    assert sorted(got) == [(i, [*reference_ids(t), 2]) for i, t in enumerate(texts)] != got


def test_records_of_repeated_and_missing_ids(spark):
    table = spark.createDataFrame([(None if i % 3 == 0 else 5 if i % 3 == 1 else i, f"text {i // 2}") for i in range(300)], "doc_id long, text string").repartition(5)
    out = records.round_trip(table, WORD, 2).orderBy("start").collect()
    assert [r.doc_id for r in out] == sorted((r.doc_id for r in out), key=lambda d: (d is not None, d or 0)) and len(out) == 300
    assert [r.start for r in out] == np.cumsum([0] + [r.n_tokens for r in out])[:-1].tolist()


def test_damaged_records_are_refused():
    import io

    data = bytearray(records.frame(records.pack(7, 2, b"\1\0\2\0")))
    assert records.unpack(records.read_record(io.BytesIO(data)))[1].tolist() == [1, 2]
    for at in (3, 9, 15, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            records.read_record(io.BytesIO(bad))


# ---- classifiers ------------------------------------------------------------------


def test_toxicity_learns_and_survives_edges(spark):
    rng = random.Random(5)
    texts, labels = [], []
    for i in range(600):
        words = noise(rng, 40).split()
        toxic = i % 5 == 0
        if toxic:
            for w in ("scum", "vermin", "wretch"):
                words.insert(rng.randrange(len(words)), w)
        texts.append(" ".join(words))
        labels.append((i, int(toxic)))
    frame = docs(spark, texts + ODD)
    marks = spark.createDataFrame([*labels, (1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    model = toxicity.train(frame, toxicity.training_part(marks))
    out = rows(toxicity.score(frame, model))
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(out[i].score >= 0.5) == (i % 5 == 0) for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in out.values()) and len(out) == len(texts) + len(ODD)
    empty = toxicity.train(frame, marks.where("doc_id < 0"))
    assert all(r.score < 0.5 for r in toxicity.score(frame, empty).collect())
    assert toxicity.score(docs(spark, []), model).count() == 0


def test_toxicity_keeps_every_ngram_with_evidence(spark, monkeypatch):
    rng = random.Random(8)
    texts = [noise(rng, 60) + (" scum vermin wretch" if i % 5 == 0 else "") for i in range(300)] + ODD
    frame = docs(spark, texts)
    marks = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")
    kept, own = [], toxicity.kneser_ney

    def noted(counts):
        kept.append(own(counts).count())
        return own(counts)

    monkeypatch.setattr(toxicity, "kneser_ney", noted)
    model = toxicity.train(frame, marks)
    assert len(model.keys) == kept[0] > 0 and len(set(model.keys.tolist())) == kept[0]
    assert np.allclose(model.find(model.keys), model.llr) and np.isnan(model.find(model.keys + np.uint64(1))).all()
    near = {i: r.score for i, r in rows(toxicity.score(frame, model)).items()}
    left = {r.doc_id for r in toxicity.keep_below(frame, model, 0.5).collect()}
    monkeypatch.setattr(toxicity, "BROADCAST_GRAMS", 0)
    joined = toxicity.train(frame, marks)
    assert joined.table.count() == kept[0] and not len(joined.keys)
    far = {i: r.score for i, r in rows(toxicity.score(frame, joined)).items()}
    assert near.keys() == far.keys() and max(abs(near[i] - far[i]) for i in near) < 1e-6
    out = toxicity.keep_below(frame, joined, 0.5)
    assert out.columns == frame.columns and left == {r.doc_id for r in out.collect()} and 0 < len(left) < len(texts)


def test_a_large_table_of_evidence_shuffles_no_text(spark, monkeypatch):
    rng = random.Random(18)
    frame = docs(spark, [noise(rng, 60) + (" scum vermin wretch" if i % 5 == 0 else "") for i in range(300)] + ODD)
    marks = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")
    near = {i: r.score for i, r in rows(toxicity.score(frame, toxicity.train(frame, marks))).items()}
    monkeypatch.setattr(toxicity, "BROADCAST_GRAMS", 0)
    monkeypatch.setattr(toxicity, "PART_GRAMS", 20)
    model = toxicity.train(frame, marks)
    assert model.table.count() > 80  # several parts
    for out in (toxicity.score(frame, model), toxicity.keep_below(frame, model, 0.5)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "Join" not in plan
    assert {i: r.score for i, r in rows(toxicity.score(frame, model)).items()} == near


def test_language_filters(spark):
    rng = random.Random(6)
    syllables = {"aa": ["lor", "mip", "tas"], "bb": ["qua", "zoe", "wix"], "cc": ["é", "ñu", "ço"]}
    texts, langs = [], []
    for _ in range(300):
        lang = rng.choice(list(syllables))
        texts.append(" ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(20)))
        langs.append(lang)
    frame = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(zip(texts, langs, strict=True))] + [(900, None, "aa"), (901, "123 !", None)], "doc_id long, text string, lang string")
    filters = langid.train(frame.where("doc_id % 3 <> 1"))
    out = rows(langid.predict(frame, filters))
    assert np.mean([out[i].lang_pred == langs[i] for i in range(300)]) > 0.99
    assert out[900].lang_pred == out[901].lang_pred == "und" and out[900].score == 0
    assert {r.lang_pred for r in langid.predict(frame, langid.train(frame.limit(0))).collect()} == {"und"}


def samples(pattern):
    """The shortest and the longest plain reading of a pattern: a space is a space."""
    from re import _constants as sre, _parser

    def read(items, longest):
        out = ""
        for op, arg in items:
            if op is sre.LITERAL:
                out += chr(arg)
            elif op is sre.IN:
                out += "x" if arg[0][0] is sre.CATEGORY else chr(arg[0][1] if arg[0][0] is sre.LITERAL else arg[0][1][0])
            elif op is sre.ANY:
                out += "x"
            elif op is sre.SUBPATTERN:
                out += read(arg[3], longest)
            elif op is sre.BRANCH:
                out += read(arg[1][-1 if longest else 0], longest)
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
                out += read(arg[2], longest) * (min(arg[1], max(1, arg[0])) if longest else arg[0])
            else:
                raise AssertionError(op)
        return out

    return [read(_parser.parse(pattern), longest) for longest in (False, True)]


def test_every_license_rule_matches_its_own_sample():
    own = []
    for label, (ids, names) in license_scan._NAMES.items():
        own += [(label, [x]) for i in ids for x in (f"SPDX-License-Identifier: {i}", f"license: {i}")]
        own += [(label, samples(n)) for n in names]
    own += [(label, samples(s)) for label, sentences in [*license_scan._TEXTS.items(), *license_scan._NOTICES.items()] for s in sentences]
    table, automaton = license_scan.rules()
    assert len(own) == len(table)
    by_label = {}
    for number, rule in enumerate(table):
        by_label.setdefault(rule[0], []).append(number)
    bad = []
    for label, texts in own:
        for text in texts:
            low = f"see {text}, ok".lower()
            tried = {k for _, numbers in automaton.iter(low) for k in numbers}
            if not any(k in tried and any(text.lower() in m.group() or m.group() in text.lower() for m in table[k][2].finditer(low)) for k in by_label[label]):
                bad.append((label, text))
    assert not bad


@pytest.mark.parametrize("name", ["by sa", "by nd", "by nc", "by nc sa", "by nc nd"])
def test_creative_commons_names(name):
    label = "cc-" + name.replace(" ", "-")
    for text in (f"cc {name}", f"cc-{name.replace(' ', '-')}", f"CC {name.replace(' ', '-').upper()} 4.0", f"CC-{name.upper()}"):
        assert [x for x, *_ in license_scan.detect(f"licensed under {text}.")] == [label], text


# ---- licences, URLs -----------------------------------------------------------------


def test_license_rules():
    assert license_scan.scan("Under the MIT License, and under-the mit license.")[:6] == (9, 2, 0, 5, "mit", "mit")
    assert license_scan.scan("SPDX-License-Identifier: GPL-3.0-or-later")[5] == "gpl-3"
    assert license_scan.scan("the GNU General Public\n * License, version 2")[5] == "gpl-2"  # the longer match suppresses gpl
    assert license_scan.scan("GNU Lesser General Public License")[5] == "lgpl"
    assert license_scan.scan("limited to the mitten")[5] == ""
    assert license_scan.scan("") == (0, 0, None, None, "", "", 0.0)
    assert len(license_scan.rules()[0]) >= 200


def test_license_scan_base_columns(spark):
    rng = random.Random(7)
    bits = ["under", "the", "MIT", "license", "apache", "version", "2", "cc", "by", "nc", "é", "-", ",", "\n"]
    texts = [" ".join(rng.choice(bits) for _ in range(30)) for _ in range(200)] + ODD
    out = rows(license_scan.scan_documents(docs(spark, texts)))
    import re

    for i, t in enumerate(texts):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [k for k in range(len(words)) for p in license_scan.PHRASES if words[k : k + len(p.split())] == p.split()]
        base = {x for p, x in license_scan.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()}
        r = out[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)))
        assert base <= set(r.labels.split(","))


def test_url_rules_and_model(spark):
    urls = [None, "", "no scheme", "http://A.example.NET/en/x", "https://net", "https://b.net/x?y#z", "http://example.com/de/1", "http://example.com/dx", "http://sub.org/fr/2", "http://notexample.com/de/1", "x://h?q/en/"]
    pages = spark.createDataFrame([(i, u, "", "clash") for i, u in enumerate(urls)], "page_id long, url string, html string, verdict string")
    out = rows(url_filter.judge(pages), "page_id")
    assert [out[i].rule for i in range(len(urls))] == [None, None, None, "example.net/en/", None, "net/", "example.com/de/", None, "org/fr/", None, None]
    assert out[3].host == "a.example.net" and out[3].path == "/en/x" and out[5].path == "/x" and (out[10].host, out[10].path) == ("h", "")
    assert out[5].verdict == "block" and out[3].verdict == "allow" and out[0].verdict == out[2].verdict == "allow"
    more = [f"http://good{i}.org/fr/{i}" for i in range(40)] + [f"http://evil{i}.net/{i}" for i in range(40)] + ["http://evilest.com/1", "http://goodest.com/fr/1"]
    out = rows(url_filter.judge(spark.createDataFrame([(i, u) for i, u in enumerate(more)], "page_id long, url string")), "page_id")
    assert out[80].verdict == "block" and out[81].verdict == "allow"
    assert url_filter.judge(pages.limit(0)).count() == 0


# ---- near-duplicates ------------------------------------------------------------------


def brute_components(texts, n, percent):
    sets = []
    for t in texts:
        w = (t or "").lower().encode().split()
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, n, percent):
    rng = random.Random(n)
    base = noise(rng, 70).split()
    texts = ["", None, "one two", "One  TWO", "solo"]
    for k in range(120):  # a cloud of copies that link in chains, or not at all
        words = list(base)
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(40)}"
        texts.append(" ".join(words))
    texts += [noise(rng, 30) for _ in range(30)] + [texts[20]] * 5
    monkeypatch.setattr(neardup, "BLOCK", 16)
    expected, sizes = brute_components(texts, n, percent)
    out = rows(neardup.components(docs(spark, texts), n, percent))
    assert [out[i].component_id for i in range(len(texts))] == expected
    assert [out[i].n_shingles for i in range(len(texts))] == sizes


def test_copies_without_id_do_not_part_a_component(spark):
    table = [(None, "same text of seven words in all"), (9, "same text of seven words in all"), (7, "same text of seven words in all"), (7, "same text of seven words in all"), (3, "another text that stands for itself")]
    out = neardup.components(spark.createDataFrame(table, "doc_id long, text string").repartition(3), 3, 85).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in out) == [(0, 7), (3, 3), (7, 7), (7, 7), (9, 7)]


def test_near_duplicates_of_nothing(spark):
    assert neardup.components(docs(spark, []), 3, 85).count() == 0
    assert {r.component_id for r in neardup.components(docs(spark, [None, ""]), 3, 85).collect()} == {0, 1}


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = np.sort(pool[:2000]), np.sort(pool[400:2400])
    s = neardup.super_minhash([a, b, a[:1], pool[:0]], 256)
    assert abs((s[0] == s[1]).mean() - 1600 / 2400) < 0.12
    assert sorted(np.floor(s[2]).astype(int)) == list(range(256)) and np.isinf(s[3]).all()


def test_components_of_a_long_chain(spark):
    pairs = [(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)]
    random.Random(2).shuffle(pairs)
    out = {r.node: r.root for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(out[i] == 0 for i in range(301)) and out[1001] == 1000


# ---- search ------------------------------------------------------------------------------


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1200, 16)) + 3 * rng.normal(size=(12, 16))[rng.integers(0, 12, 1200)]
    x[50:90] = x[50]
    table = [(i, [float(a) for a in v], 1) for i, v in enumerate(x)]
    table += [(5000, None, 1), (5100, [0.0] * 16, 1), (5200, [float("nan")] * 16, 1), (5300, [None] * 16, 1), (5400, [1.0], 1)]
    frame = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int")
    out = ann.search(frame, F.col("vec_id") % 50 == 0, 10).collect()
    queries = range(0, 1200, 50)
    assert {r.query_id for r in out} == set(queries)
    hit = 0
    for q in queries:
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        best = sorted((d[i], i) for i in range(1200) if i != q)[:10]
        got = sorted((r["rank"], r.vec_id, r.score) for r in out if r.query_id == q)
        assert [g[0] for g in got] == list(range(1, 11)) and all(abs(d[v] - s) < 1e-12 for _, v, s in got)
        hit += len({v for _, v, _ in got} & {i for _, i in best})
    assert hit / (10 * len(queries)) >= 0.9
    assert [r.vec_id for r in sorted((r for r in out if r.query_id == 50), key=lambda r: r["rank"])] == list(range(51, 61))
    assert ann.search(frame.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 11, 12, 400])
def test_every_vector_gets_its_full_number_of_neighbours(spark, n):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 8))
    if n == 400:
        for a in range(0, 60, 3):  # far groups of three equal vectors, and far single ones
            x[a : a + 3] = 40 * rng.normal(size=8)
        x[60:80] = 40 * rng.normal(size=(20, 8))
    table = [(i, [float(y) for y in v]) for i, v in enumerate(x)]
    out = ann.search(spark.createDataFrame(table, "vec_id long, embedding array<double>"), F.lit(True), 10).collect()
    assert len({(r.query_id, r.vec_id) for r in out}) == len(out)
    got = np.bincount([r.query_id for r in out], minlength=n)
    assert got.tolist() == [min(10, n - 1)] * n


def test_decontamination(spark, monkeypatch):
    rng = random.Random(9)
    items = [(i, f"{noise(rng, 25).capitalize()}. {noise(rng, 6).capitalize()}.") for i in range(60)] + [(90, ""), (91, None), (None, "x y")]
    texts = [noise(rng, 300) for _ in range(40)]
    planted = {}
    for d in range(0, 40, 4):
        k = rng.randrange(60)
        words = texts[d].split()
        at = rng.randrange(len(words))
        texts[d] = " ".join([*words[:at], items[k][1].upper(), *words[at:]])
        planted[d] = k
    texts[1] += " " + items[3][1].split(".")[0]  # the question alone
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = docs(spark, texts + ODD)
    out = {tuple(r) for r in decontam.find_contaminated(frame, bench).collect()}
    assert {r[:2] for r in out} == set(planted.items())
    monkeypatch.setattr(decontam, "INDEX_BYTES", 2000)
    parts = list(decontam.indexes(bench, 2000))
    assert len(parts) > 3 and sum(len(x.ids) for x in parts) == len(items)
    assert {tuple(r) for r in decontam.find_contaminated(frame, bench).collect()} == out  # scores and overlaps too
    clean = decontam.keep_clean(frame, bench)
    assert {r.doc_id for r in clean.collect()} == set(range(len(texts + ODD))) - set(planted) and clean.columns == frame.columns
    assert decontam.find_contaminated(frame, bench.limit(0)).count() == 0
    assert decontam.find_contaminated(docs(spark, []), bench).count() == 0


def test_an_item_without_id_does_not_leak(spark):
    rng = random.Random(12)
    item = f"{noise(rng, 40).capitalize()}. {noise(rng, 9).capitalize()}."
    bench = spark.createDataFrame([(None, item), (4, noise(rng, 30))], "item_id long, text string")
    edited = item.split()
    edited[44] = "changed"  # one word of the answer
    frame = docs(spark, [item, " ".join(edited), noise(rng, 60)])
    assert [(r.doc_id, r.item_id) for r in decontam.find_contaminated(frame, bench).orderBy("doc_id").collect()] == [(0, None), (1, None)]
    assert [r.doc_id for r in decontam.keep_clean(frame, bench).collect()] == [2]


def test_decontamination_equals_brute_force(spark):
    """Every passage against every item, by the definitions and without an index."""
    import math
    from collections import Counter

    rng = random.Random(13)
    words = [noise(rng, 1) for _ in range(80)]
    items = [" ".join(rng.choices(words, k=rng.randrange(8, 40))) + ". " + " ".join(rng.choices(words, k=rng.randrange(1, 12))) for _ in range(25)]
    texts = []
    for i in range(40):
        base = rng.choices(words, k=rng.randrange(0, 300))
        item = rng.choice(items).split()
        for _ in range(i % 5):
            item[rng.randrange(len(item))] = rng.choice(words)
        at = rng.randrange(len(base) + 1)
        texts.append(" ".join([*base[:at], *item, *base[at:]] if i % 4 else base))
    split = [decontam.words_of(x) for x in items]
    df, mean = Counter(w for s in split for w in set(s)), sum(map(len, split)) / len(split)
    window, expected = max(64, 2 * max(map(len, split))), set()

    def runs(x, n):
        return {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if n else set()

    for d, t in enumerate(texts):
        doc = decontam.words_of(t)
        for begin in range(0, max(1, len(doc)), window // 2):
            passage = doc[begin : begin + window]
            for i, (s, x) in enumerate(zip(split, items, strict=True)):
                weight = {w: math.log(1 + (len(items) - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(s) / mean)) for w, c in Counter(s).items()}
                score = sum(x for w, x in weight.items() if w in set(passage)) / sum(weight.values())
                shares = []
                halves = decontam.question_and_answer(x)
                for part, other in (halves, halves[::-1]):
                    n = min(len(part), 5 if len(part) >= 30 else 2 if len(part) >= 12 or len(other) < 12 else 1)
                    shares.append(len(runs(part, n) & runs(passage, n)) / len(runs(part, n)) if part else 1.0)
                if score >= 0.6 - 1e-9 and min(shares) >= 0.8:
                    expected.add((d, i))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.find_contaminated(docs(spark, texts), bench).collect()}
    assert found == expected and len(expected) > 8


def test_wand_returns_all_above_the_threshold():
    rng = random.Random(10)
    index = decontam.Index([(i, noise(rng, 12) + " the of and") for i in range(200)])
    for _ in range(60):
        i = rng.randrange(200)
        terms = sorted(rng.sample(range(len(index.term)), 20) + [t for t in range(len(index.term)) if i in index.item[index.at[t] : index.at[t + 1]] and rng.random() < 0.8])
        terms = sorted(set(terms))
        full = {}
        for t in terms:
            for k in range(index.at[t], index.at[t + 1]):
                full[int(index.item[k])] = full.get(int(index.item[k]), 0) + index.share[k]
        for threshold in (0.1, 0.4, 0.6):
            assert {k for k, _ in index.search(terms, threshold)} == {k for k, x in full.items() if x >= threshold - 1e-6}


# ---- the whole ---------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    kept = frame
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, sf)
        assert out.columns == frame.columns, name
        assert 0 < out.count() <= kept.count()
        kept = out
    last = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in kept.collect()}
