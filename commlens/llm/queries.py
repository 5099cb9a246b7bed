"""Contract queries of this subpackage, registered by __spark_entry__.py."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commlens.llm import ann, bpe, decontam, exact_dedup, langid, license_scan, merkle, neardup, periodic, records, token_count, toxicity, url_filter
from commlens.llm.common import crc_mod, read


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, toxicity.training_part(read(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_documents(read(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    filters = langid.train(docs.where(crc_mod("doc_id", 3) != 1))
    return langid.predict(docs, filters).select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neardup.components(read(spark, sf_dir, "documents"), n=3, percent=85)
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def planted_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text: texts whose id's checksum says so repeat their words periodically from a place on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size("words")
    told = docs.select("doc_id", "text", h.alias("h"), g.alias("g"), F.when(h % 10 == 0, words).alias("words"))
    told = told.withColumn("a", F.when(n > 0, F.col("g") % n))
    told = told.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    repeated = F.concat_ws(" ", F.transform(F.sequence(F.lit(0).cast("long"), n - F.lit(1).cast("long")), lambda i: F.get("words", place(i).cast("int"))))
    return told.select("doc_id", F.when((F.col("h") % 10 == 0) & (n > 0), repeated).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(planted_repeats(read(spark, sf_dir, "documents")))
    best = F.aggregate("runs", F.lit(None).cast("struct<start: long, length: long, period: long>"), lambda a, x: F.when(a.isNull() | (x["length"] * a["period"] > a["length"] * x["period"]), x).otherwise(a))
    lines = F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], F.concat(x["period"].cast("string"), F.lit("\n"))))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_duplicates(read(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    original = merkle.leaf(*values, F.col("text"))
    claimed = F.when(crc_mod("doc_id", 3) == 0, merkle.leaf(*values, tampered)).otherwise(original)
    leaves = docs.select(F.col("doc_id").alias("id"), merkle.group_key(F.col("lang")).alias("grp"), original.alias("digest"), claimed.alias("claimed"))
    return merkle.Manifest(leaves).proofs().withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_token_counts, op3_records, op4_toxicity, op5_nearest_neighbours, op6_byte_bpe, op7_license_scan, op8_url_filter, op9_language_id, op10_near_duplicates, op11_periodic_runs, op12_exact_dedup, op13_merkle_manifest)}


def _url_filter_sql(order: int = url_filter.ORDER, alphabet: int = url_filter.ALPHABET) -> str:
    """Rules and Witten-Bell models of op8, level by level."""
    levels = [
        f"""g{k} AS MATERIALIZED (SELECT right(g, {k + 1}) AS g, sum(a) AS a, sum(b) AS b FROM pieces GROUP BY 1),
h{k} AS (SELECT left(g, {k}) AS h, sum(a) AS na, sum(b) AS nb, count(*) FILTER (WHERE a > 0) AS ka, count(*) FILTER (WHERE b > 0) AS kb FROM g{k} GROUP BY 1),
p{k} AS MATERIALIZED (SELECT g{k}.g, CASE WHEN na > 0 THEN (g{k}.a + ka * {"pa" if k else f"(1.0::DOUBLE / {alphabet})"}) / (na + ka) ELSE {"pa" if k else f"1.0::DOUBLE / {alphabet}"} END AS pa, CASE WHEN nb > 0 THEN (g{k}.b + kb * {"pb" if k else f"(1.0::DOUBLE / {alphabet})"}) / (nb + kb) ELSE {"pb" if k else f"1.0::DOUBLE / {alphabet}"} END AS pb
  FROM g{k} JOIN h{k} ON h{k}.h = left(g{k}.g, {k}){f" JOIN (SELECT g AS s, pa, pb FROM p{k - 1}) q ON q.s = right(g{k}.g, {k})" if k else ""})"""
        for k in range(order + 1)
    ]
    return f"""WITH bare AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS x FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(x, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(x, length(regexp_extract(x, '^[^/]*')) + 1) AS path FROM bare),
dotted AS (SELECT *, '.' || host AS d FROM parts),
ruled AS (SELECT page_id, host, path, host || path AS u,
  CASE WHEN d LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/' WHEN d LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/' WHEN d LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN d LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM dotted),
judged AS (SELECT *, CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS by_rule FROM ruled),
urls AS (SELECT u, count(*) FILTER (WHERE by_rule = 'allow') AS a, count(*) FILTER (WHERE by_rule = 'block') AS b FROM judged GROUP BY 1),
pieces AS MATERIALIZED (SELECT u, a, b, substr(repeat(chr(2), {order}) || u || chr(3), CAST(i AS BIGINT), {order + 1}) AS g FROM urls, unnest(range(1, length(u) + 2)) t(i)),
{", ".join(levels)},
scored AS (SELECT u, round(avg(ln(pa / pb)), 9) AS llr, any_value(a) AS a, any_value(b) AS b FROM pieces JOIN p{order} USING (g) GROUP BY 1),
m AS (SELECT sum(a) AS na, sum(b) AS nb, sum(a * llr) / sum(a) AS ma, sum(b * llr) / sum(b) AS mb, sum(a * llr * llr) / sum(a) AS qa, sum(b * llr * llr) / sum(b) AS qb FROM scored),
s AS (SELECT *, sqrt(greatest(qa - ma * ma, 1e-12)) AS sa, sqrt(greatest(qb - mb * mb, 1e-12)) AS sb FROM m),
cut AS (SELECT CASE WHEN na > 0 AND nb > 0 THEN (ma * sb + mb * sa) / (sa + sb) END AS cut FROM s)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN length(judged.u) > 0 AND llr < cut THEN 'block' ELSE 'allow' END) AS verdict, llr FROM judged LEFT JOIN scored USING (u), cut"""


_NEAR_DUPLICATES = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
-- equal sets are one class; rare shingles are in few of them
c AS MATERIALIZED (SELECT min(doc_id) AS c, any_value(s) AS s, md5(array_to_string(list_sort(s), chr(10))) AS k FROM s WHERE len(s) > 0 GROUP BY 3),
x AS MATERIALIZED (SELECT c, len(s) AS n, md5_number_lower(unnest(s)) AS h FROM c),
pairs AS MATERIALIZED (SELECT a.c AS a, b.c AS b FROM x a JOIN x b ON a.h = b.h AND a.c < b.c GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT c AS a, c AS b FROM c UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
low AS (SELECT a AS c, min(b) AS component_id FROM reach GROUP BY 1)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(component_id, s.doc_id) AS component_id, coalesce(component_id, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON len(s.s) > 0 AND c.k = md5(array_to_string(list_sort(s.s), chr(10))) LEFT JOIN low ON low.c = c.c"""

_EXACT = """WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM t"""


def _manifest_sql(levels: int = 11, fanout: int = merkle.FANOUT) -> str:
    """op13 for trees of up to fanout**levels leaves: level by level up, then every row's path."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
    parts = [
        f"""r AS MATERIALIZED (SELECT doc_id, lang, {leaf("text")} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % 3 = 0 THEN {leaf(lower)} ELSE {leaf("text")} END AS claimed,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS i FROM documents)""",
        "n0 AS MATERIALIZED (SELECT lang, i, leaf AS d, count(*) OVER (PARTITION BY lang) AS n FROM r)",
    ]
    for tree, group in (("n", "lang"), ("m", "0")):
        if tree == "m":
            parts.append(f"s AS MATERIALIZED (SELECT lang, d AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS k FROM n{levels})")
            parts.append("m0 AS MATERIALIZED (SELECT 0 AS lang, k AS i, subroot AS d, count(*) OVER () AS n FROM s)")
        for k in range(levels):  # a tree that has one node is done, and passes on as it is
            parts.append(f"{tree}{k + 1} AS MATERIALIZED (SELECT lang, i // {fanout} AS i, CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d, (any_value(n) + {fanout - 1}) // {fanout} AS n FROM {tree}{k} GROUP BY lang, i // {fanout})")
            # what stands before and behind each node, among its siblings
            parts.append(f"b{tree}{k} AS MATERIALIZED (SELECT lang, i, n = 1 AS done, coalesce(string_agg(d, '') OVER (PARTITION BY lang, i // {fanout} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(d, '') OVER (PARTITION BY lang, i // {fanout} ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {tree}{k})")
    last = "r0"
    parts.append("r0 AS (SELECT r.*, subroot, k, claimed AS x, '' AS proof FROM r JOIN s ON r.lang IS NOT DISTINCT FROM s.lang)")
    for tree, at, on in (("n", "i", "IS NOT DISTINCT FROM q.lang"), ("m", "k", "")):
        for k in range(levels):
            where = f"q.lang IS NOT DISTINCT FROM b.lang AND q.{at} // {fanout**k} = b.i" if on else f"q.{at} // {fanout**k} = b.i"
            parts.append(f"r{tree}{k} AS (SELECT q.* EXCLUDE (x, proof), CASE WHEN done THEN x ELSE sha256(l || x || b.r) END AS x, CASE WHEN done THEN proof ELSE proof || l || b.r END AS proof FROM {last} q JOIN b{tree}{k} b ON {where})")
            last = f"r{tree}{k}"
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, m{levels}.d AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = m{levels}.d AS verified FROM {last}, m{levels}"


#: The others are beyond SQL (tokenizers, hashed models, approximate search) or too slow in it (periodic runs): their tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op8_url_filter": _url_filter_sql(), "op10_near_duplicates": _NEAR_DUPLICATES, "op12_exact_dedup": _EXACT, "op13_merkle_manifest": _manifest_sql()}
