"""Queries of the learnt sentence boundaries and tags, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from commlens.operators import boundaries as B
from commlens.operators import features as S
from commlens.operators import tagging as G
from commlens.plans.catalog import query, read
from commlens.session import durable

# common words of the invented prose stand for abbreviations
_DOTTED = {" la ": " approx. ", " the ": " e.g. ", " und ": " Dr. "}


def _dotted(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    for a, b in _DOTTED.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return read(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


def _replaced(text: str) -> str:
    for a, b in _DOTTED.items():
        text = f"replace({text}, '{a}', '{b}')"
    return text


_KIND = r"[\p{L}\p{N}](?:[\p{L}\p{N}.''-]*[\p{L}\p{N}])?"
_LAST = rf"({_KIND})(\.?)[^\p{{L}}\p{{N}}]*$"
_UPPER = "substr(kind, 1, 1) <> lower(substr(kind, 1, 1))"
_TYPES = rf"""d AS (SELECT doc_id, {_replaced("coalesce(text, '')")} AS text FROM documents),
l AS (SELECT list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda w: w <> '') AS l FROM d),
w AS (SELECT l[i] AS word, CASE WHEN i = 1 THEN '.' ELSE l[i - 1] END AS before FROM l, unnest(range(1, len(l) + 1)) t(i)),
k AS (SELECT regexp_extract(word, '{_LAST}', 1) AS kind, regexp_extract(word, '{_LAST}', 2) AS dot, regexp_matches(before, '[.!?][^\p{{L}}\p{{N}}]*$') AS after_end FROM w WHERE length(word) <= {B.LONGEST}),
types AS MATERIALIZED (SELECT lower(kind) AS type, count(*) FILTER (WHERE dot = '.') AS dotted, count(*) FILTER (WHERE dot = '') AS bare, count(*) FILTER (WHERE NOT {_UPPER}) AS low, count(*) FILTER (WHERE {_UPPER} AND NOT after_end) AS inside FROM k WHERE kind <> '' GROUP BY 1),
p AS (SELECT sum(dotted)::DOUBLE / sum(dotted + bare) AS p FROM types),
r AS (SELECT type, dotted + bare AS n, bare, -2 * (dotted * ln(p) + bare * ln(1 - p) - dotted * ln(0.99) - bare * ln(0.01)) AS ratio, length(type) - length(replace(type, '.', '')) AS inner_ FROM types, p WHERE dotted > 0),
found AS MATERIALIZED (SELECT * FROM (SELECT type, round(ratio * exp(-(length(type) - inner_)) * (inner_ + 1) * pow(length(type) - inner_, -bare), 6) AS score FROM r) WHERE score >= {B.LEAST_SCORE})"""


def _learnt(spark, sf_dir):
    types = durable(B.type_counts(_dotted(spark, sf_dir), "text"))
    return B.abbreviations(types), B.starters(types)


@query(f"WITH {_TYPES} SELECT * FROM found")
def abbreviations(spark, sf_dir):
    return B.abbreviations(B.type_counts(_dotted(spark, sf_dir), "text"))


@query(
    rf"""WITH {_TYPES},
lines AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(text, '\n+'), lambda s: trim(s) <> ''), lambda s: list_filter(string_split(regexp_replace(s, '([.!?])[ \t\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')) AS lines FROM d),
line AS (SELECT doc_id, unnest(lines) AS p FROM lines),
joints AS (SELECT doc_id, list_filter(regexp_split_to_array(p[i], '[ \t\r\n]+'), lambda w: w <> '')[-1] AS word, list_filter(regexp_split_to_array(p[i + 1], '[ \t\r\n]+'), lambda w: w <> '')[1] AS next FROM line, unnest(range(1, len(p))) t(i)),
ends AS (SELECT doc_id, lower(regexp_extract(word, '{_LAST}', 1)) AS type, regexp_extract(word, '{_LAST}', 2) AS dot, regexp_extract(next, '^[^\p{{L}}\p{{N}}]*({_KIND})', 1) AS kind FROM joints WHERE length(word) <= {B.LONGEST}),
glued AS (SELECT doc_id, count(*) AS n FROM ends WHERE dot = '.' AND type IN (SELECT type FROM found) AND NOT ({_UPPER} AND lower(kind) IN (SELECT type FROM types WHERE low > 0 AND inside = 0)) GROUP BY 1)
SELECT lines.doc_id, CAST(coalesce(list_sum(list_transform(lines, lambda p: len(p))), 0) AS BIGINT) AS n_pieces, CAST(coalesce(list_sum(list_transform(lines, lambda p: len(p))), 0) - coalesce(n, 0) AS BIGINT) AS n_sentences FROM lines LEFT JOIN glued USING (doc_id)"""
)
def sentence_boundaries(spark, sf_dir):
    out = B.split_sentences(_dotted(spark, sf_dir), "doc_id", "text", *_learnt(spark, sf_dir))
    pieces = F.aggregate(B._lines(F.col("text")), F.lit(0), lambda n, line: n + F.size(line))
    return out.select("doc_id", pieces.cast("long").alias("n_pieces"), F.size("sentences").cast("long").alias("n_sentences"))


# lines of work mail below the invented prose
_MAIL = ["Send me the report by Friday.", "He sends the report every Friday.", "If you agree, sign Dr. Smith's copies. Thanks for your help!", "You must complete this today.", "Reports are due on Friday. Could you call me?"]


@query()
def tagged_features(spark, sf_dir):
    line = F.element_at(F.array(*[F.lit(x) for x in _MAIL]), (F.col("doc_id") % len(_MAIL) + 1).cast("int"))
    bodies = _dotted(spark, sf_dir).withColumn("text", F.concat_ws("\n", "text", line))
    cut = B.split_sentences(bodies, "doc_id", "text", *_learnt(spark, sf_dir))
    tagged = G.imperative_sentences(cut, "sentences", G.train(G.tagged_mail(spark)))
    out = S.lexical_features(tagged, "doc_id", "text", cut=F.col("sentences"), roots=F.col("imperative"))
    return out.select("doc_id", "n_sentences", F.round("imperative_ratio", 6).alias("imperative_ratio"), F.round("mean_sentence_len", 6).alias("mean_sentence_len"))
