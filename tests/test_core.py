"""The reference's operators on small fixtures."""

from __future__ import annotations

import datetime as dt
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from commlens.functions import text as T
from commlens.operators import experiment as X
from commlens.operators import features as S
from commlens.operators import messages as M
from commlens.operators import network as N
from commlens.operators import sampling as P
from commlens.operators import threads as H
from commlens.plans import catalog, harness, language  # noqa: F401
from commlens.sources import mail, tables

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    return round(float(v), 5) if isinstance(v, (int, float)) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    got = sorted(str([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    c = con.execute(catalog.ORACLE_SQL[name])
    names = [x[0] for x in c.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert sorted(names) == sorted(df.columns)
    assert got == sorted(str([plain(r[i]) for i in order]) for r in c.fetchall())


def test_subjects(spark):
    for raw, want in {"RE: Re[2]: fw: Plan  A": "plan a", "Report: x": "report: x", None: "", "  AW : SV: b": "b"}.items():
        assert one(spark, raw, T.normalize_subject) == want


def test_bodies(spark):
    body = "Hi\n> old\nText\n----- Original Message -----\nFrom: x"
    assert one(spark, body, T.clean_body) == "Hi\nText"
    assert one(spark, "A\nFrom: b@c\nSent: today\nx", T.strip_quoted) == "A\n"
    assert one(spark, "A\nFrom: here on\nall is well", T.strip_quoted).startswith("A\nFrom: here")
    assert one(spark, "Text\n\nJo\n713-555-1234\n\na@b.com\n", T.strip_signature) == "Text\n\nJo"
    assert one(spark, "Text\n-- \nJo", T.strip_signature) == "Text"


@pytest.mark.parametrize("body", ["x" * 1_000_000, "a.b-" * 250_000, "\n" * 300_000 + "x", "- " * 500_000, "a@b " * 250_000, "From: x\n" * 100_000, "1" * 1_000_000 + "\n\n", "-" * 1_000_000 + "x", "a_" * 400_000 + "@x.org"])
def test_long_lines_take_time_in_proportion(spark, body):
    import time

    df = spark.createDataFrame([(body,)], "x string").select(F.length(T.clean_body(F.col("x"))), F.size(T.extract_addresses(F.col("x"))))
    df.collect()
    began = time.time()
    df.collect()
    assert time.time() - began < 3


def test_addresses_that_touch(spark):
    import random
    import re

    rng = random.Random(2)
    texts = ["".join(rng.choice("ab@@._%+'- ,A9") for _ in range(rng.randrange(40))) for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.extract_addresses(F.col("t")).alias("a"))
    for r in df.collect():
        assert r.a == list(dict.fromkeys(x.lower() for x in re.findall(r"[A-Za-z0-9._%+'-]+@[A-Za-z0-9.-]+", texts[r.i])))


def test_small_functions(spark):
    assert one(spark, " <A@B.c> ", T.normalize_address) == "a@b.c" and one(spark, "ab", T.normalize_address) is None
    assert one(spark, "a b\x1cc d", T.token_count) == 4
    assert one(spark, "<a@b> <c@d> <a@b>", T.message_ids) == ["a@b", "c@d"]
    assert one(spark, "John Q. Smith Jr.", T.mailbox_key) == "smith-j" and one(spark, "Cher", T.mailbox_key) is None
    assert one(spark, '"Smith, John" <j@x>/O', T.normalize_display_name) == "smith john"
    assert one(spark, "please by Friday", T.has_deadline) is True


def test_maildir(spark, tmp_path):
    text = "Message-ID: <{i}@x>\nDate: Mon, 14 May 2001 09:00:00 -0700\nFrom: A <a@x.com>\nTo: b@x.com, B@x.com\nSubject: Hi\n\nBody {b}\n"
    for path, i, b in (("u/sent/1.", 1, "one"), ("v/inbox/1.", 2, "one"), ("v/inbox/2.", 3, "two")):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text.format(i=i, b=b))
    (tmp_path / "v/inbox/3.").write_bytes(b"\xff\xfe\x00junk")
    unique, recipients = mail.ingest(mail.scan(spark, str(tmp_path)))
    rows = {r.source_path: r for r in unique.collect()}
    assert set(rows) == {"u/sent/1.", "v/inbox/2.", "v/inbox/3."}
    assert rows["u/sent/1."].date == dt.datetime(2001, 5, 14, 16) and rows["u/sent/1."].to == ["b@x.com"]
    assert recipients.count() == 2
    report = mail.ingest_report(mail.parsed(mail.scan(spark, str(tmp_path))), unique, recipients).first()
    assert (report.scanned, report.unique_messages, report.duplicates, report.missing_from) == (4, 3, 1, 1)


def test_owners(spark):
    rows = [("m", "a")] * 50 + [("m", "b")] * 5 + [("m", "c")] + [("n", "c")] * 20
    got = M.resolve_owners(spark.createDataFrame(rows, "mailbox string, sender string"), "mailbox", "sender", 0.02)
    assert {(r.mailbox, r.sender) for r in got.collect()} == {("m", "a"), ("m", "b"), ("n", "c")}


def test_two_people_who_answer_each_other_are_a_thread(spark):
    at = dt.datetime(2001, 5, 14, 9)
    m = spark.createDataFrame([("m1", "a@x", at, "plan"), ("m2", "b@x", at + dt.timedelta(hours=1), "plan"), ("m3", "a@x", at, "fyi"), ("m4", "b@x", at, "fyi"), ("m5", None, at, "plan"), ("m6", "a@x", None, "plan")], "uid string, sender string, at timestamp_ntz, subject_norm string")
    r = spark.createDataFrame([("m1", "b@x"), ("m2", "a@x"), ("m3", "b@x"), ("m4", "a@x")], "uid string, address string")
    c = M.thread_candidates(m, r, "uid", "at", "address", "sender")
    assert {x.uid: x.participants for x in c.collect()} == {**dict.fromkeys(["m1", "m2", "m3", "m4"], ["a@x", "b@x"]), "m5": []}
    # a subject of three characters links nothing
    assert [(x.a, x.b) for x in H.links(c, "uid", "subject_norm", "at", "participants").collect()] == [("m1", "m2")]


def test_stimuli_without_a_role_are_counted(spark):
    turns = spark.createDataFrame([(1, 0, 5, "a"), (1, 1, 5, "b"), (1, 2, 5, "c"), (1, 3, 5, "d")], "t int, position int, stimulus_rank int, replier string").withColumns({"stimulus_uid": F.lit("u0"), "reply_uid": F.concat(F.lit("u"), "position")})
    ranks = spark.createDataFrame([("b", 3, "Legal"), ("c", 5, "Tax")], "replier string, seniority_rank int, department string")
    personas = spark.createDataFrame([(3, "Legal", "p")], "seniority_rank int, department string, persona_id string")
    pairs = X.stimulus_pairs(turns, "t", "position", ranks, "replier", personas)
    assert X.unmatched_pairs(pairs).first() == (3, 2)
    texts = spark.createDataFrame([(f"u{i}", "s" if i else None, f"body {i}") for i in range(4)], "uid string, subject string, body string")
    cell = X.stimulus_cells(pairs, texts, "t", "m", "vp").first()
    assert (cell.cell_id, cell.scenario_id, cell.direction, cell.stimulus_text, cell.reply_text) == ("vp__real_1__u1", "real_1", "up", "Subject: \n\nbody 0", "Subject: s\n\nbody 1")


def test_every_reply_to_an_opener_is_a_pair(spark):
    pairs = catalog.QUERIES["real_stimulus_pairs"](spark, SF)
    turns, people = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("conversations", "customer"))
    openers = turns.where("turn = 0").join(people, F.col("c_custkey") == F.col("conv_id") + 1).select("conv_id")
    want = turns.where("turn > 0").join(openers, "conv_id").select("conv_id", "turn")
    assert sorted(map(tuple, pairs.select("conv_id", "turn").collect())) == sorted(map(tuple, want.collect()))


def threads(spark, days, people="1 2", subject="plan"):
    base = dt.datetime(2001, 5, 14, 9)
    rows = [(f"u{k:03}", subject, base + dt.timedelta(days=d), people.split()) for k, d in enumerate(days)]
    c = spark.createDataFrame(rows, "uid string, subject_norm string, at timestamp_ntz, participants array<string>")
    got = H.components(c, H.links(c, "uid", "subject_norm", "at", "participants"), "uid", "string")
    return len({r.thread_id for r in got.collect()})


def test_threads(spark):
    assert threads(spark, [0, 10]) == 1 and threads(spark, [0, 45]) == 2 and threads(spark, [0, 5], people="1") == 2
    assert threads(spark, [0, 25, 50, 75]) == 1
    assert threads(spark, [0] * 505) == 505


def test_network(spark):
    turns = spark.createDataFrame([(1, k, s, dt.datetime(2001, 1, 1, h)) for k, (s, h) in enumerate([("a", 0), ("b", 2), (None, 3), ("a", 5), ("b", 8)])], "thread int, position int, sender string, at timestamp_ntz")
    got = N.turn_latencies(turns, "thread", ["position"], "sender", "at").collect()
    assert sorted((r.replier, r.author, r.latency) for r in got) == [("b", "a", 7200), ("b", "a", 10800)]
    assert {r.reply_latency_asymmetry for r in N.latency_asymmetry(spark.createDataFrame(got)).collect()} == {None}
    graph = spark.createDataFrame([("h", x, 1) for x in "abcd"] + [(x, "h", 1) for x in "abcd"], "src string, dst string, weight long")
    c = {r.address: r.centrality for r in N.eigenvector_centrality(graph).collect()}
    assert abs(c["h"] - math.sqrt(0.5)) < 1e-3 and abs(c["a"] - math.sqrt(0.125)) < 1e-3


def test_power(spark):
    df = spark.createDataFrame([(1, 1.0, None, 5.0), (2, 2.0, 1.0, 5.0), (3, 3.0, 3.0, 5.0)], "id int, a double, b double, c double")
    got = {r.id: r for r in S.power_score(df, {"a": 1.0, "b": -1.0, "c": 1.0}, 1).collect()}
    assert got[1].power_score == -1.0 and got[1].n_power_components == 1 and abs(got[3].power_score - (1 - math.sqrt(0.5)) / 2) < 1e-9
    assert S.power_score(df, {"a": 1.0}, 2).where("power_score IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        S.power_score(df, {"zz": 1.0})


def test_features(spark):
    df = spark.createDataFrame([(1, "Please send it. Maybe we could? I will. You must go."), (2, "")], "id int, body string")
    r = {x.id: x for x in S.lexical_features(df, "id", "body").collect()}
    assert (r[1].n_sentences, r[1].question_ratio, r[1].hedge_rate, r[1].commitment_rate, r[1].imperative_ratio) == (4, 0.25, 0.25, 0.25, 0.5)
    assert r[2].hedge_rate == 0 and r[2].n_sentences == 0


def test_quotas(spark):
    pool = spark.createDataFrame([(i, "a" if i < 80 else "b") for i in range(100)], "id int, s string")
    assert {r.s: r.quota for r in P.quotas(pool, ["s"], 10).collect()} == {"a": 8, "b": 2}
    assert P.stratified_sample(pool, ["s"], "id", 200, 1).count() == 100


def test_statistics(spark):
    d = spark.createDataFrame([(float(a), float(b)) for a, b in [(1, 3), (2, 5), (4, 3), (6, 1), (7, 7)]], "a double, b double")
    r = X.wilcoxon(d, "a", "b").first()
    assert (r.w, r.n, r.median_difference) == (5.0, 4, 0.0) and X.wilcoxon_p(0, 6) == 0.03125 and X.wilcoxon_p(0, 0) == 1
    assert abs(X.t_cdf(2.228, 10) - 0.975) < 1e-4 and abs(X.t_cdf(-1.0, 3) - 0.1955) < 1e-4
    assert X.tost(20, 0.0, 0.1)[2] and not X.tost(20, 0.5, 0.1)[2] and X.tost(5, 0.1, 0.0)[2]
    auc = lambda rows: X.roc_auc(spark.createDataFrame(rows, "l boolean, s int"), "l", "s").first()[0]
    assert auc([(True, 2), (False, 1)]) == 1 and auc([(True, 1), (False, 1)]) == 0.5 and auc([(True, 1)]) is None


def test_cost_and_cache(spark):
    prices = spark.createDataFrame([("m", 3.0, 15.0)], "model string, rate_in double, rate_out double")
    use = lambda m: spark.createDataFrame([(m, 1000, 100, 1000, 200)], "model string, input_tokens long, cache_write_tokens long, cache_read_tokens long, output_tokens long")
    assert abs(X.cost_usd(use("m"), prices, F.lit(True)).first().cost_usd - 0.5 * ((1000 + 125 + 100) * 3 + 200 * 15) / 1e6) < 1e-12
    with pytest.raises(Exception, match="no price"):
        X.cost_usd(use("x"), prices, F.lit(False)).collect()
    requests = spark.createDataFrame([("k1",), ("k2",)], "key string")
    cache = spark.createDataFrame([("k1", "old")], "key string, answer string")
    got = X.complete(requests, cache, "key", lambda df: df.withColumn("answer", F.lit("new")))
    assert {(r.key, r.answer, r.from_cache) for r in got.collect()} == {("k1", "old", True), ("k2", "new", False)}
    bad = spark.createDataFrame([('{"subject":"s","body":"b","decision":"accept","confidence":"low"}',), ("{}",), ("x",)], "r string")
    assert [r.is_valid for r in X.validate(bad, "r").collect()] == [True, False, False]


def test_tables(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("1\tJohn \"J\" Doe\tL\tLegal\tVP\tm\tSenior\n\n")
    assert [r.full_name for r in tables.employees(spark, str(tmp_path / "e.tsv")).collect()] == ['John "J" Doe']
    (tmp_path / "m.json").write_text('{"p": [{"text": "a", "importance": 0.5, "hours_ago": 1, "kind": "observation"}]}')
    assert tables.memory_snapshot(spark, str(tmp_path / "m.json")).first().text == "a"
    assert tables.ledger_total(spark, str(tmp_path / "none")) == 0.0
    usage = {"timestamp": "t", "run_id": "r", "provider": "p", "model": "m", "call_kind": "k", "batch": 0, "from_cache": 0, "input_tokens": 1, "cache_creation_input_tokens": 0, "cache_read_input_tokens": 0, "output_tokens": 2, "cost_usd": 0.25}
    for _ in range(2):
        tables.append_ledger(spark.createDataFrame([usage]), str(tmp_path / "ledger"))
    assert tables.ledger_total(spark, str(tmp_path / "ledger")) == 0.5
    assert tables.layered_config({"a": {"b": 1, "c": 2}}, {"a": {"c": 3}}) == {"a": {"b": 1, "c": 3}}


def test_tables_of_ranks_and_addresses(spark, tmp_path):
    (tmp_path / "t.csv").write_text("title,seniority_rank,rank_label,given_seniority\nVP,5,Vice,Senior\n")
    assert tables.title_ranks(spark, str(tmp_path / "t.csv")).first() == ("VP", 5, "Vice", "Senior")
    tables.known_addresses(spark, ["paul.y'barbo@x.com"], "known")
    assert spark.sql("SELECT address FROM known").first().address == "paul.y'barbo@x.com"


def test_parts_are_bounded_and_stale_ones_go(spark, tmp_path):
    path = tmp_path / "parts"
    for n, parts in ((50, 5), (20, 2)):
        tables.write_parts(spark.range(n).coalesce(1), str(path), rows_per_file=10)
        files = list(path.glob("*.parquet"))
        assert len(files) == parts and all(f.name.endswith(".zstd.parquet") for f in files) and tables.parquet(spark, str(path)).count() == n


def test_reports_and_snapshots(spark, tmp_path):
    report = tables.write_report(spark.createDataFrame([(2, 0.5)], "n int, share double"), str(tmp_path / "r.json"))
    assert (tmp_path / "r.json").read_text().index("n") < (tmp_path / "r.json").read_text().index("share")
    text = tables.markdown({"files": 1200, "corpus": report}, "Report")
    assert "| files | 1,200 |" in text and "## corpus" in text and "| share | 0.5000 |" in text
    tables.freeze(spark.createDataFrame([("a", 1)], "persona_id string, n int"), str(tmp_path / "frozen"))
    frozen = lambda: spark.read.schema("persona_id string, n int").json(str(tmp_path / "frozen"))
    live = lambda: spark.createDataFrame([("b", 2)], "persona_id string, n int")
    assert [(w, df.first().persona_id) for w, df in (tables.live_or_snapshot(spark, p, live, frozen) for p in ([str(tmp_path)], [str(tmp_path), str(tmp_path / "no")]))] == [("live", "b"), ("snapshot", "a")]


def test_configuration_files(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text("run: {n: 1, m: 2}\n")
    (tmp_path / "b.yaml").write_text("run: {n: 3}\n")
    (tmp_path / "empty.yaml").write_text("")
    (tmp_path / "list.yaml").write_text("- 1\n")
    assert tables.read_config(*[str(tmp_path / f"{x}.yaml") for x in ("a", "empty", "b")]) == {"run": {"n": 3, "m": 2}}
    with pytest.raises(TypeError):
        tables.read_config(str(tmp_path / "list.yaml"))


def test_cache_manifest_over_sharded_folders(spark, tmp_path):
    import hashlib

    entries = {f"{k}{i}": f'{{"key": "{k}{i}"}}' for i, k in enumerate(["ab", "cd", "ab"])}
    for key, text in entries.items():
        (tmp_path / key[:2]).mkdir(exist_ok=True)
        (tmp_path / key[:2] / f"{key}.json").write_text(text)
    digests = {k: hashlib.sha256(t.encode()).hexdigest() for k, t in entries.items()}
    whole = hashlib.sha256("".join(f"{k}{v}" for k, v in sorted(digests.items())).encode()).hexdigest()
    assert tables.cache_manifest(spark, str(tmp_path)) == {"n_entries": 3, "combined_sha256": whole}
    assert {r.key for r in tables.cache_entries(spark, str(tmp_path), "string").collect()} == set(entries)


def test_first_files_in_path_order(spark, tmp_path):
    for name in ("a/2", "a-b/1", "a/1"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(f"Message-ID: <{name}>\nX-From: Jos\u00e9\n\nhi")
    assert sorted(r.source_path for r in mail.scan(spark, str(tmp_path), 2).collect()) == ["a/1", "a/2"]
    assert mail.scan_report(spark, str(tmp_path)).first() == (3, 0)
    assert mail.parsed(mail.scan(spark, str(tmp_path), 1)).first().message_id == "<a/1>"


def test_retrieval_with_any_scorer(spark):
    items = spark.createDataFrame([("g", i, f"text {i}", "q", 0.5, float(i)) for i in range(5)] + [("g", 9, "far", "q", 0.5, 4.0)], "g string, i int, t string, q string, importance double, hours double")
    by_length = lambda df, group, uid, text, query: df.withColumn("relevance", F.length(text).cast("double"))
    out = X.retrieve(items, "g", "i", "t", "q", "importance", "hours", k=3, relevance=by_length).orderBy("place").collect()
    assert [r.i for r in out] == [0, 1, 2]
    assert [r.i for r in X.retrieve(items.withColumn("t", F.when(F.col("i") == 9, "q").otherwise(F.col("t"))).withColumn("hours", F.lit(1.0)).withColumn("q", F.lit("text 3")), "g", "i", "t", "q", "importance", "hours", k=1).collect()] == [0]


def test_medians_and_ranks_by_position(spark):
    import random
    import statistics

    from commlens.operators import ranks

    rng = random.Random(4)
    rows = [(rng.choice("abc"), float(rng.randrange(12))) for _ in range(301)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    assert {r.g: r.m for r in ranks.medians(df, ["g"], "v", "m").collect()} == {g: statistics.median([v for k, v in rows if k == g]) for g in "abc"}
    assert ranks.medians(df, [], "v", "m").first().m == statistics.median([v for _, v in rows])
    assert ranks.medians(df.limit(0), [], "v", "m").first().m is None
    assert sorted(r.p for r in ranks.positions(df.distinct(), ["g", "v"], "p").collect()) == list(range(len(set(rows))))


def test_wilcoxon_p_with_ties():
    # by the tie-corrected normal approximation: n = 60, all differences equal in size
    n, ties = 60, 60**3 - 60
    assert math.isclose(X.wilcoxon_p(600, n, ties), math.erfc(abs(600 - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) / math.sqrt(2)))
    assert X.wilcoxon_p(0, 60) < 1e-10 and 0.02 < X.wilcoxon_p(0, 6, 6) < 0.04


def test_samples_fill_their_quota_with_repeated_ids(spark):
    pool = spark.createDataFrame([("a", 1)] * 40 + [("b", i) for i in range(60)], "s string, i int")
    out = P.stratified_sample(pool, ["s"], "i", 50, 1)
    assert {r.s: r.n for r in out.groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()} == {"a": 20, "b": 30} and out.columns == ["s", "i"]


def test_text_auc_needs_both_classes(spark):
    one = spark.createDataFrame([(i, "a b", 1) for i in range(10)], "i int, t string, y int")
    with pytest.raises(ValueError):
        X.text_auc(one, "i", "t", "y")


def test_results_are_collected_once(spark, tmp_path):
    from commlens.streaming import collect

    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = lambda ids: spark.createDataFrame([(i, "2001-01-01 00:00:00") for i in ids], "key string, at string").selectExpr("key", "CAST(at AS TIMESTAMP) AS at")
    for ids in (["a", "b", "a"], ["b", "c"]):
        rows(ids).write.mode("append").json(source)
        collect.collect_once(collect.arrivals(spark, source, "key string, at timestamp"), "key", "at", out, state).awaitTermination()
    assert sorted(r.key for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
