"""Every registered query of the subpackage on a small folder of tables with odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from commlens.llm import langid, license_scan, queries, toxicity, url_filter
from commlens.llm.common import mix64
from commlens.llm.words import hashed_words

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
# extra columns whose names the operators use inside
CLASH = {"cls": "x", "keys": "y", "at": 3, "bucket": "b", "key": 1, "score": 0.5, "fold": 2, "n": 4, "t": "t", "part": 9, "toxic_": 1}


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents (repeated ids, nulls, ties, a very long text and word, copies), labels, pages, embeddings, benchmark."""
    rng = random.Random(21)
    sounds = {"aa": ["ka", "to", "mi", "ru", "ne"], "bb": ["sch", "ung", "der", "ach", "ein"], "cc": ["que", "oux", "les", "ent", "eau"]}
    word = lambda lang: "".join(rng.choice(sounds[lang]) for _ in range(rng.randrange(1, 4)))
    text = lambda lang, n: " ".join(word(lang) for _ in range(n))
    rows = []
    for i in range(240):
        lang = rng.choice(list(sounds))
        t = text(lang, rng.randrange(30, 160))
        if i % 6 == 0:
            t += " vile wretched scum " * 3
        if i % 11 == 0:
            t += " Under the MIT License, cc-by-nc. "
        rows.append((i, t, lang if i % 5 else None))
    rows += [(300 + i, rows[i][1].replace("a", "A"), "aa") for i in range(10)]  # the same words in capitals
    rows += [(320 + i, rows[20 + i][1] + " coda", "bb") for i in range(10)]  # near copies
    items = [(i, f"{text('aa', 40).capitalize()}. {text('aa', 20).capitalize()}.") for i in range(8)] + [(None, f"{text('bb', 40).capitalize()}. {text('bb', 20)}."), (90, ""), (91, None)]
    rows += [(400 + i, f"{text('cc', 30)} {items[i][1]} {text('cc', 30)}", "cc") for i in (0, 3, 8)]
    rows += [(500, None, "aa"), (501, "", "aa"), (502, " \n\t", None), (503, "12 !?", None), (504, "漢字 кот", None), (7, rows[7][1], "aa"), (7, "another text of the same id", "aa"), (None, rows[9][1], "bb"), (505, "short", "aa"), (506, "short", "aa"), (507, "xyzzy qwfpg jluyb vkmhz " * 20, None)]
    rows += [(600, text("bb", 40_000), "bb"), (601, "z" * 70_000 + " " + text("aa", 200), "aa")]
    extra = {k: F.lit(v) for k, v in CLASH.items()}
    where = str(tmp_path_factory.mktemp("tables"))

    def save(rows, kind, name):
        spark.createDataFrame(rows, kind).withColumns(extra if name != "embeddings" else {}).repartition(3).write.parquet(f"{where}/{name}.parquet")

    save(rows, "doc_id long, text string, lang string", "documents")
    save([(i, int(i % 2), int(i % 6 == 0)) for i in range(0, 240, 1)] + [(6, 0, 0), (None, 1, 1), (8, 1, None), (9999, 0, 1)], "doc_id long, quality int, toxic int", "labels")
    save(items, "item_id long, text string", "benchmark")
    urls = [f"https://{h}/{p}/{text('aa', 1)}{i}?q#f" for i, (h, p) in enumerate((rng.choice(["www.example.net", "Example.COM", "a.org", "b.net", "c.io", "notnet", "org"]), rng.choice(["en", "de", "fr", "x"])) for _ in range(150))]
    save([(i, u) for i, u in enumerate([*urls, urls[0], None, "", "no scheme", "x://", "http://a.net", "http://a.net?x/y", "HTTP://A.NET#/"])], "page_id long, url string", "pages")
    vectors = np.random.default_rng(5).normal(size=(400, 6)).round(3).tolist()
    vectors[7] = vectors[8] = vectors[100]
    odd = [(900, None), (901, [0.0] * 6), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1000, [float("nan")] * 6), (1100, [float("inf")] * 6), (None, vectors[3])]
    save([(i, v) for i, v in enumerate(vectors)] + odd, "vec_id long, embedding array<double>", "embeddings")
    return where


@pytest.fixture(scope="module")
def documents(spark, folder):
    return [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def run(spark, folder, name):
    return queries.QUERIES[name](spark, folder).collect()


def by_text(documents):
    """Texts of each id; an id may have several rows."""
    out = {}
    for i, t, _ in documents:
        out.setdefault(i, []).append(t or "")
    return out


def library_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD).encode(text, add_special_tokens=False).ids


def test_op1(spark, folder):
    found = run(spark, folder, "op1_decontamination")
    assert sorted((r.doc_id, r.item_id) for r in found if r.doc_id >= 400 and r.item_id is not None) == [(400, 0), (403, 3)]
    assert [(r.doc_id, r.item_id) for r in found if r.item_id is None] == [(408, None)] and len(found) == 3


def test_op2(spark, folder, documents):
    texts = by_text(documents)
    got = {}
    for r in run(spark, folder, "op2_token_counts"):
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_tokens, r.over_limit))
    for i, ts in texts.items():
        want = [(len(t.encode()), n := len(library_ids(t)), n > 2048) for t in ts]
        assert sorted(got[i]) == sorted(want)
    assert len(got) == len(texts) and got[600][0][2]


def test_op3(spark, folder, documents):
    out = sorted(run(spark, folder, "op3_records"), key=lambda r: r.start)
    assert [r.doc_id for r in out] == sorted((i for i, _, _ in documents), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in out] == np.cumsum([0] + [r.n_tokens for r in out])[:-1].tolist()
    texts = by_text(documents)
    for r in out:
        ids = [np.array([*library_ids(t), 2], "<u4") for t in texts[r.doc_id]]
        assert (r.n_tokens, r.ids_crc32) in {(len(x), zlib.crc32(x.tobytes())) for x in ids}


def test_op4(spark, folder, documents):
    out = run(spark, folder, "op4_toxicity")
    assert len(out) == len(documents)
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (r.doc_id is not None and crc(r.doc_id, 5) == 0)
    held = [r for r in out if r.held_out and r.doc_id < 240]
    assert np.mean([(r.doc_id % 6 == 0) == bool(r.predicted) for r in held]) > 0.95


def test_op4_model_equals_brute_force(spark):
    """The table of evidence against Kneser-Ney written out over dictionaries."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab cd ef gh ij kl".split()) for _ in range(40)) + (" vile scum" * 4 if i % 3 == 0 else " calm") for i in range(40)]
    counts = {c: Counter() for c in "to"}
    for i, t in enumerate(texts):
        h = [int(x) for x in hashed_words([t])[0]]
        for k, w in enumerate(h):
            counts["t" if i % 3 == 0 else "o"][w, 1 + h[k - 1] % (toxicity.CONTEXTS - 1) if k else 0] += 1
    pairs = set(counts["t"]) | set(counts["o"])
    d = toxicity.DISCOUNT
    table = spark.createDataFrame([(int(np.uint64(w).astype(np.int64)), c, counts["t"][w, c], counts["o"][w, c]) for w, c in pairs], "w long, c int, t long, o long")
    got = {(r.w, r.c): r.llr for r in toxicity.kneser_ney(table).collect()}
    words = {w for w, _ in pairs}
    k = {w: sum(1 for x, _ in pairs if x == w) for w in words}
    kx = {x: {w: sum(1 for p in counts[x] if p[0] == w) for w in words} for x in "to"}
    low = {x: {w: max(kx[x][w] - d, 0) / sum(kx[x].values()) + (1 - sum(max(v - d, 0) for v in kx[x].values()) / sum(kx[x].values())) * k[w] / sum(k.values()) for w in words} for x in "to"}

    def top(x, w, c):
        mine = {p: n for p, n in counts[x].items() if p[1] == c}
        total = max(sum(mine.values()), 1)
        return max(mine.get((w, c), 0) - d, 0) / total + (1 - sum(max(n - d, 0) for n in mine.values()) / total) * low[x][w]

    want = {(w, c): np.log(top("t", w, c) / top("o", w, c)) for w, c in pairs if max(counts["t"][w, c], counts["o"][w, c]) > d}
    want |= {(w, None): np.log(low["t"][w] / low["o"][w]) for w in words if max(kx["t"][w], kx["o"][w]) > d}
    signed = {(int(np.uint64(w).astype(np.int64)), c): v for (w, c), v in want.items()}
    assert got.keys() == signed.keys() and len(got) > 10
    assert all(abs(got[x] - v) < 1e-9 for x, v in signed.items())


def test_op5(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    ok = [(i, np.array(v)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)]
    out = {}
    for r in run(spark, folder, "op5_nearest_neighbours"):
        out.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    assert set(out) == {0, 100, 200, 300}
    hits = 0
    for q, found in out.items():
        x = dict(ok)[q]
        near = sorted((float(np.sqrt(((v - x) ** 2).sum())), i) for i, v in ok if i != q)[:10]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11)) and [(s, i) for _, s, i in found] == sorted((s, i) for _, s, i in found)
        hits += len({i for _, _, i in found} & {i for _, i in near})
        assert all(abs(s - np.sqrt(((dict(ok)[i] - x) ** 2).sum())) < 1e-12 for _, s, i in found)
    assert hits >= 36
    assert [i for _, _, i in sorted(out[100])][:2] == [7, 8]  # equal vectors: the smaller id first


def test_op6(spark, folder, documents):
    import base64

    with open(BYTE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = by_text(documents)
    for r in run(spark, folder, "op6_byte_bpe"):
        want = set()
        for t in texts[r.doc_id]:
            ids = np.array(encoding.encode_ordinary(t), "<u4") if len(t) < 60_000 or " " in t[:1000] else None
            if ids is None:
                want.add((r.n_tokens, r.ids_sha256, hashlib.sha256(t.encode()).hexdigest()))  # a giant word: the round trip alone
            else:
                want.add((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) in want


def every_detection(text):
    """The accepted matches by trying every rule on the text, and every accepted match on every other."""
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    found = {(priority, m.start() - m.end(), m.start(), m.end(), label) for label, priority, pattern in license_scan.rules()[0] for m in pattern.finditer(low)}
    kept = []
    for f in sorted(found):
        if not any(k[2] <= f[2] and f[3] <= k[3] for k in kept):
            kept.append(f)
    return sorted(((label, a, b, priority) for priority, _, a, b, label in kept), key=lambda x: (x[1], x[2], x[0]))


def test_license_detections_equal_those_of_every_rule():
    rng = random.Random(3)
    pieces = ["SPDX-License-Identifier: MIT", "license: apache-2.0", "Under the MIT License", "Apache License, Version 2.0", "GNU Lesser General Public License", "the GNU General Public License version 2", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "This work is in the public domain", "Mozilla Public License", "BSD 3-Clause", "Permission is hereby granted, free of charge", "reserved font name", "license", "\n", "İ ſ", "und die"]
    hits = 0
    for _ in range(120):
        text = rng.choice([" ", ", ", "\n * "]).join(rng.choices(pieces, k=rng.randint(0, 12)))
        want = every_detection(text)
        assert license_scan.detect(text) == want, text
        hits += len(want)
    assert hits > 300


def test_op7(spark, folder, documents):
    import re

    phrases = {("under", "the", "mit", "license"): "mit", ("apache", "license", "version", "2"): "apache-2", ("cc", "by", "nc"): "cc-by-nc"}
    texts = by_text(documents)
    for r in run(spark, folder, "op7_license_scan"):
        want = []
        for t in texts[r.doc_id]:
            words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
            at = [(k, label) for p, label in phrases.items() for k in range(len(words)) if tuple(words[k : k + len(p)]) == p]
            want.append((len(words), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) in want
        own = [(set(filter(None, w[4].split(","))) | {x for x, *_ in every_detection(t)}) for w, t in zip(want, texts[r.doc_id], strict=True)]
        assert (r.base_labels, r.labels) in [(w[4], ",".join(sorted(x))) for w, x in zip(want, own, strict=True)]
        assert 0 <= r.score <= 1 and (r.score == 0) == (r.labels == "")


def brute_urls(urls, order=url_filter.ORDER):
    """Witten-Bell models of both kinds over dictionaries; llr of every distinct url."""
    rules = [("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("block", "net", "/")]
    parts = {}
    for u in urls:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        bare = rest.split("#")[0].split("?")[0]
        host, slash, path = bare.partition("/")
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and (slash + path).startswith(p)]
        parts.setdefault(u, (host, slash + path, *(max(fits)[1:] if fits else (None, None))))
    weight = {v: Counter(parts[u][0] + parts[u][1] for u in urls if parts[u][3] == v) for v in ("allow", "block")}
    counts = {v: Counter() for v in weight}
    for v, c in weight.items():
        for u, n in c.items():
            x = "\2" * order + u + "\3"
            for i in range(order, len(x)):
                for k in range(order + 1):
                    counts[v][x[i - k : i + 1]] += n
    heads = {v: {} for v in weight}
    for v, c in counts.items():
        for g, n in c.items():
            total, kinds = heads[v].get(g[:-1], (0, 0))
            heads[v][g[:-1]] = (total + n, kinds + 1)

    def p(v, g):
        low = 1 / url_filter.ALPHABET if len(g) == 1 else p(v, g[1:])
        total, kinds = heads[v].get(g[:-1], (0, 0))
        return (counts[v][g] + kinds * low) / (total + kinds) if total else low

    def llr(u):
        x = "\2" * order + u + "\3"
        grams = [x[i - order : i + 1] for i in range(order, len(x))]
        return float(np.mean([np.log(p("allow", g) / p("block", g)) for g in grams]))

    return parts, weight, llr


def test_op8(spark, folder):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    parts, weight, llr = brute_urls(list(urls.values()))
    value = {u: llr(u) for u in {p[0] + p[1] for p in parts.values()}}
    mean, spread = {}, {}
    for v, c in weight.items():
        x = np.repeat([value[u] for u in c], list(c.values()))
        mean[v], spread[v] = x.mean(), x.std()
    cut = (mean["allow"] * spread["block"] + mean["block"] * spread["allow"]) / (spread["allow"] + spread["block"])
    out = run(spark, folder, "op8_url_filter")
    assert len(out) == len(urls)
    for r in out:
        host, path, rule, verdict = parts[urls[r.page_id]]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert abs(r.llr - value[host + path]) < 1e-8
        assert r.verdict == (verdict or ("block" if host + path and value[host + path] < cut else "allow"))


def test_op9(spark, folder, documents):
    out = run(spark, folder, "op9_language_id")
    assert len(out) == len(documents)
    # exact sets in place of the filters
    counts = {}
    for i, t, lang in documents:
        if lang and t and (i is None or crc(i, 3) != 1) and i is not None:
            h, _ = langid._grams([langid._normal(t)], langid.NGRAM)
            counts.setdefault(lang, Counter()).update(h.tolist())
    share = {x: {g: n / sum(c.values()) for g, n in c.items()} for x, c in counts.items()}
    top = Counter()
    for s in share.values():
        for g, v in s.items():
            top[g] = max(top[g], v)
    own = {x: {g for g, v in s.items() if v >= langid.MAX_RATIO * top[g]} for x, s in share.items()}
    texts = by_text(documents)
    for r in out:
        assert r.held_out == (r.doc_id is not None and crc(r.doc_id, 3) == 1)
        want = []
        for t in texts[r.doc_id]:
            h = langid._grams([langid._normal(t)], langid.NGRAM)[0].tolist()
            n = {x: sum(g in own[x] for g in h) for x in sorted(own)}
            letters = any(c.isalpha() for c in t)
            want.append(max(n, key=n.get) if letters and sum(n.values()) else "und" if not letters else None)
        # a text none of whose n-grams is known may go to any learnt language, and to no other value
        assert r.lang_pred in {*want, *(own if None in want else ())} - {None}
        assert 0 <= r.score <= 1


def test_op10(spark, folder, documents):
    import re

    sets = []
    for i, t, _ in documents:
        words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append((i, {tuple(words[k : k + min(3, len(words))]) for k in range(max(1, len(words) - 2))} if words else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                root[find(a)] = find(b)
    low = {}
    for k, (i, s) in enumerate(sets):
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    want = Counter((i, len(s), low.get(find(k)) if s else i) for k, (i, s) in enumerate(sets))
    out = run(spark, folder, "op10_near_duplicates")
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out if r.doc_id is not None)
    assert sum(n for (i, _, c), n in want.items() if i != c) >= 20


def test_stages_keep_columns_and_take_odd_and_empty_tables(spark, folder, documents):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == columns
        left[name] = [r.doc_id for r in out.select("doc_id").collect()]
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert {500, 501, 502} <= set(left["toxicity"])  # without words: not rejected
    assert not {0, 6, 12, 18} & set(left["toxicity"])
    assert not {500, 501, 502, 503, 504, 507} & set(left["language"]) and {1, 2, 3} <= set(left["language"])
    assert not {400, 403, 408} & set(left["decontamination"]) and len(left["decontamination"]) == len(documents) - 3
    assert left["near_duplicates"].count(7) == 2 and not set(range(300, 310)) & set(left["near_duplicates"])
    assert not set(range(320, 330)) & set(left["near_duplicates"])
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs.limit(0), folder).count() == 0 and last(spark, docs, folder).count() == len(documents)


def test_without_languages_only_texts_without_letters_go(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, "12", None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in corpus_pipeline.keep_known_language(spark, docs, "").collect()] == [1]
    docs = spark.createDataFrame([(i, "plain words of some language " * 3, "aa") for i in range(9)] + [(10, "A.", None), (11, "xq zv", None)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.keep_known_language(spark, docs, "").collect()) == [*range(9), 10]


def test_the_whole_pipeline_is_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert sorted(map(str, docs.collect())) == sorted(map(str, corpus_pipeline.run(spark, folder).collect()))


def test_mix64_is_a_bijection():
    x = np.arange(100_000, dtype=np.uint64)
    assert len(np.unique(mix64(x))) == len(x)
