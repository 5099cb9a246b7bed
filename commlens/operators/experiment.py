"""Completions (stub), caching, batches, cost; memory retrieval; judging and statistics."""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commlens.functions.prompts import direction
from commlens.functions.text import deterministic_choice, seeded_order, short_id
from commlens.operators.ranks import average_ranks, medians, positions, small
from commlens.session import durable

# The closed domains of a response.
DECISIONS, CONFIDENCES = ["accept", "decline", "defer", "escalate", "none"], ["low", "medium", "high"]
#: Batch and prompt-cache multipliers of the base rates.
BATCH, CACHE_WRITE, CACHE_READ = 0.50, 1.25, 0.10


def pending(cells: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Cells without a cached response."""
    return cells.join(cache.select(key).distinct(), key, "left_anti")


def stub_completion(requests: DataFrame, seed: Column) -> DataFrame:
    """A deterministic stand-in response, as pure column expressions."""
    return requests.withColumns(
        {
            "decision": deterministic_choice(F.concat(seed, F.lit("|decision")), DECISIONS),
            "confidence": deterministic_choice(F.concat(seed, F.lit("|confidence")), CONFIDENCES),
        }
    )


def complete(requests: DataFrame, cache: DataFrame, key: str, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Cache first: cached answers, and ``answer`` of the misses, told apart by from_cache."""
    hits = requests.select(key).join(cache, key).withColumn("from_cache", F.lit(True))
    made = answer(pending(requests, cache, key)).select(*cache.columns).withColumn("from_cache", F.lit(False))
    return hits.unionByName(made)


def batch_chunks(rows: DataFrame, uid: str, size: int) -> DataFrame:
    """Custom ids and chunk numbers of at most ``size`` rows, in id order; no task numbers all rows."""
    return positions(rows.select(uid), [uid], "place").select(uid, short_id(F.col(uid).cast("string")).alias("custom_id"), F.floor(F.col("place") / size).alias("chunk"))


def cost_usd(usage: DataFrame, prices: DataFrame, batch: Column) -> DataFrame:
    """Cost of every call from (model, rate_in, rate_out) a million, a row a model; an unknown model is an error."""
    x = usage.join(F.broadcast(prices), "model", "left")
    cost = (F.col("input_tokens") + F.col("cache_write_tokens") * CACHE_WRITE + F.col("cache_read_tokens") * CACHE_READ) * F.col("rate_in") + F.col("output_tokens") * F.col("rate_out")
    known = F.when(F.col("rate_in").isNull(), F.raise_error(F.concat(F.lit("no price for model "), F.col("model"))).cast("double")).otherwise(cost / 1e6)
    return x.withColumn("cost_usd", F.when(batch, known * BATCH).otherwise(known)).drop("rate_in", "rate_out")


def dry_run(cells: DataFrame, prices: DataFrame, tokens: Column, output_tokens: int = 512) -> DataFrame:
    """Upper bound of cost: the first cell of each cache group stands for its group."""
    first = cells.withColumn("tokens", tokens).groupBy("cache_group").agg(F.min_by("model", "cell_id").alias("model"), F.min_by("tokens", "cell_id").alias("tokens"), F.count(F.lit(1)).alias("n"))
    one = (F.col("tokens") * F.col("rate_in") + output_tokens * F.col("rate_out")) / 1e6
    priced = first.join(F.broadcast(prices), "model", "left")  # a row a model
    unknown = F.raise_error(F.concat(F.lit("no price for model "), F.col("model"))).cast("double")
    priced = priced.withColumn("rate_in", F.coalesce("rate_in", unknown))
    return priced.groupBy("model").agg(F.sum("n").alias("cells"), F.round(F.sum(one * F.col("n")), 6).alias("cost_usd"))


def validate(responses: DataFrame, body: str) -> DataFrame:
    """Parsed responses with a validity flag: required keys present, enums in their domain."""
    parsed = F.from_json(body, "subject string, body string, decision string, confidence string")
    x = responses.withColumn("r", parsed)
    ok = F.col("r.subject").isNotNull() & F.col("r.body").isNotNull() & F.col("r.decision").isin(DECISIONS) & F.col("r.confidence").isin(CONFIDENCES)
    return x.withColumn("is_valid", F.coalesce(ok, F.lit(False))).drop("r")


# ---- memory -----------------------------------------------------------------


def recency(hours: Column, decay: float = 0.995) -> Column:
    return F.pow(F.lit(decay), hours)


def min_max(df: DataFrame, groups: list[str], column: str, alias: str) -> DataFrame:
    """Scaled to 0..1 within the group; a constant group is all 1."""
    bounds = df.groupBy(*groups).agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    scaled = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise((F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return df.join(bounds, groups).withColumn(alias, scaled).drop("lo", "hi")


def tfidf_relevance(items: DataFrame, group: str, uid: str, text: str, query: str, token: str = r"(?U)\b\w\w+\b") -> DataFrame:
    """Cosine of smooth-idf tf-idf vectors of each item and its group's query.

    The corpus of a group is its query and its items.  Texts are cut into words once; the
    counts are written and serve both the document frequencies and the vectors.  Tables of
    words are broadcast while they are small, so that a common word is no hot key.
    """
    words = lambda c: F.explode(F.regexp_extract_all(F.lower(c), F.lit(token), 0)).alias("w")
    queries = items.groupBy(group).agg(F.first(query).alias("q"), F.count(F.lit(1)).alias("n"))
    rows = items.select(group, F.col(uid).cast("string").alias("u"), words(F.col(text))).unionAll(queries.select(group, F.lit(None).cast("string").alias("u"), words(F.col("q"))))
    tf = durable(rows.groupBy(group, "u", "w").agg(F.count(F.lit(1)).alias("tf")))
    idf = tf.groupBy(group, "w").agg(F.count(F.lit(1)).alias("df")).join(queries.select(group, "n"), group).select(group, "w", (F.log((F.col("n") + 2) / (F.col("df") + 1)) + 1).alias("idf"))
    x = tf.join(small(idf), [group, "w"]).withColumn("x", F.col("tf") * F.col("idf"))
    asked = x.where("u IS NULL").select(group, "w", F.col("x").alias("y"))
    norm = asked.groupBy(group).agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("ny"))
    dots = x.where("u IS NOT NULL").join(small(asked), [group, "w"], "left").groupBy(group, "u").agg(F.sum(F.col("x") * F.coalesce("y", F.lit(0.0))).alias("dot"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("nx"))
    scored = dots.join(norm, group).select(group, "u", F.when((F.col("nx") > 0) & (F.col("ny") > 0), F.col("dot") / (F.col("nx") * F.col("ny"))).alias("relevance"))
    return items.withColumn("u", F.col(uid).cast("string")).join(scored, [group, "u"], "left").withColumn("relevance", F.coalesce("relevance", F.lit(0.0))).drop("u")


def retrieve(items: DataFrame, group: str, uid: str, text: str, query: str, importance: str, hours: str, k: int = 8, decay: float = 0.995, relevance: Callable[..., DataFrame] = tfidf_relevance) -> DataFrame:
    """The k items of each group with the highest sum of scaled recency, importance and relevance.

    ``relevance(items, group, uid, text, query)`` adds a column ``relevance``; any scorer
    of that form may stand in.  Ties go to the smaller uid.
    """
    scored = relevance(items, group, uid, text, query).withColumn("recency", recency(F.col(hours), decay))
    parts = {"recency": "r", importance: "i", "relevance": "v"}
    for column, alias in parts.items():
        scored = min_max(scored, [group], column, f"_{alias}")
    total = sum((F.col(f"_{a}") for a in parts.values()), F.lit(0.0))
    return top_memories(scored.withColumn("score", F.round(total, 9)), [group], "score", uid, k).drop(*[f"_{a}" for a in parts.values()])


def top_memories(scored: DataFrame, groups: list[str], score: str, position: str, k: int = 8) -> DataFrame:
    """The k best of each group, ties by position: a limit that the plan pushes below the shuffle."""
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(F.col(score).desc(), position))
    return scored.withColumn("place", place).where(F.col("place") <= k)


def reflection_batches(items: DataFrame, group: str, position: str, size: int = 5) -> DataFrame:
    """Full batches of consecutive items; a partial last batch is dropped."""
    numbered = items.withColumn("batch", F.floor(F.col(position) / size))
    full = numbered.groupBy(group, "batch").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == size).select(group, "batch")
    return numbered.join(full, [group, "batch"], "left_semi")


def stimulus_pairs(turns: DataFrame, thread: str, position: str, ranks: DataFrame, replier: str, personas: DataFrame) -> DataFrame:
    """Replies to each thread's opener with the persona that stands for the replier, and the direction.

    turns: (thread, position, sender rank of the opener as ``stimulus_rank``, replier);
    ranks: (replier, seniority_rank, department); personas: (seniority_rank, department,
    persona_id).  Replies whose replier has no role, or no persona, keep a null persona_id (see
    ``unmatched_pairs``).
    """
    roots = turns.where(F.col(position) == 0).select(thread, "stimulus_rank")
    replies = turns.where(F.col(position) > 0).drop("stimulus_rank").join(roots, thread)
    known = replies.join(ranks, replier, "left")
    out = known.join(personas, ["seniority_rank", "department"], "left")
    return out.withColumn("direction", direction(F.col("stimulus_rank"), F.col("seniority_rank")))


def stimulus_cells(pairs: DataFrame, messages: DataFrame, thread: str, model: str, label: str) -> DataFrame:
    """Pairs with a persona, as cells to run: stimulus and reply texts, and ids that no two replies share.

    pairs also has stimulus_uid and reply_uid; messages: (uid, subject, body).  Texts meet their
    pairs in two joins by id; order the result by thread and reply_uid where order matters.
    """
    text = lambda: F.concat(F.lit("Subject: "), F.coalesce("subject", F.lit("")), F.lit("\n\n"), F.coalesce("body", F.lit("")))
    known = pairs.where(F.col("persona_id").isNotNull())
    for side in ("stimulus", "reply"):
        known = known.join(messages.select(F.col("uid").alias(f"{side}_uid"), text().alias(f"{side}_text")), f"{side}_uid")
    scenario = F.concat(F.lit("real_"), F.col(thread).cast("string"))
    cell = F.concat_ws("__", F.lit(label), scenario, F.col("reply_uid").cast("string"))
    return known.withColumns({"scenario_id": scenario, "cell_id": cell, "model": F.lit(model), "replicate": F.lit(1), "task_type": F.lit("real_stimulus"), "stakes": F.lit("routine")})


def unmatched_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs, and those for which there is no persona."""
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("persona_id").isNull()).alias("unmatched"))


# ---- judging and statistics --------------------------------------------------


def scores_wide(long: DataFrame, item: list[str], key: str, keys: list[str]) -> DataFrame:
    """One row an item with score_* and evidence_* columns."""
    return long.groupBy(*item).agg(*[F.max(F.when(F.col(key) == k, F.col(v))).alias(f"{v}_{k}") for k in keys for v in ("score", "evidence")])


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Mann-Whitney AUC on average ranks, null for a single class."""
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).select(F.col(label).cast("boolean").alias("label"), F.col(score).alias("score"))
    counts = rows.groupBy("score").agg(F.count_if("label").alias("p"), F.count_if(~F.col("label")).alias("n"))  # a value is one row, however many share it
    one = counts.join(average_ranks(rows, "score", "r"), "score").agg(F.sum("p").cast("double").alias("p"), F.sum("n").cast("double").alias("n"), F.sum(F.col("p") * F.col("r")).alias("r"))
    return one.select(F.when((F.col("p") > 0) & (F.col("n") > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("n"))).alias("auc"))


def wilcoxon(df: DataFrame, a: str, b: str) -> DataFrame:
    """Paired signed-rank statistic W = min(W+, W-), median difference, number of non-zero pairs."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select((F.col(a) - F.col(b)).alias("d"))
    rows = d.where("d <> 0").select("d", F.abs("d").alias("size"))
    counts = rows.groupBy("size").agg(F.count_if(F.col("d") > 0).alias("plus"), F.count_if(F.col("d") < 0).alias("minus"))
    ranked = counts.join(average_ranks(rows, "size", "r"), "size")
    t = F.col("plus") + F.col("minus")
    sums = ranked.agg(*[F.coalesce(F.sum(F.col(c) * F.col("r")), F.lit(0.0)).alias(c) for c in ("plus", "minus")], F.coalesce(F.sum(t), F.lit(0)).alias("n"), F.coalesce(F.sum((t * t * t - t).cast("double")), F.lit(0.0)).alias("ties"))
    middle = medians(d, [], "d", "median_difference")  # one row
    return sums.crossJoin(F.broadcast(middle)).select(F.least("plus", "minus").alias("w"), "n", "ties", "median_difference")


def wilcoxon_p(w: float, n: int, ties: float = 0.0) -> float:
    """Two-sided p of W: exact up to 50 pairs without ties, else the normal approximation.

    ``ties`` is the sum of t**3 - t over groups of t equal differences; it lowers the variance.
    """
    if n == 0:
        return 1.0
    if n <= 50 and not ties:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for k in range(1, n + 1):
            for s in range(len(ways) - 1, k - 1, -1):
                ways[s] += ways[s - k]
        return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    variance = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    if variance <= 0:
        return 1.0
    z = (w - n * (n + 1) / 4) / math.sqrt(variance)
    return min(1.0, math.erfc(abs(z) / math.sqrt(2)))


def t_cdf(t: float, df: float) -> float:
    """Student's t distribution by the regularised incomplete beta function."""
    x = df / (df + t * t)
    tail = 0.5 * _beta(df / 2, 0.5, x)
    return 1 - tail if t > 0 else tail


def _beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    # the continued fraction from its end
    value = 1.0
    for m in range(200, 0, -1):
        k = m // 2
        c = k * (b - k) * x / ((a + m - 1) * (a + m)) if m % 2 == 0 else -(a + k) * (a + b + k) * x / ((a + m - 1) * (a + m))
        value = 1 + c / value
    return front / value


def tost_moments(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, mean difference and standard error of a paired equivalence test."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select((F.col(a) - F.col(b)).alias("d"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), (F.stddev_samp("d") / F.sqrt(F.count(F.lit(1)))).alias("se"))


def tost(n: int, mean: float, se: float | None, margin: float = 0.4, alpha: float = 0.05) -> tuple[float, float, bool]:
    """p of both one-sided tests, and whether the pair is equivalent."""
    if n < 2:
        return 1.0, 1.0, False
    if not se:
        low, high = float(mean <= -margin), float(mean >= margin)
    else:
        low, high = 1 - t_cdf((mean + margin) / se, n - 1), t_cdf((mean - margin) / se, n - 1)
    return low, high, max(low, high) < alpha


def text_auc(df: DataFrame, uid: str, text: str, label: str, folds: int = 5, seed: int = 20260807, leak: bool = False, rounds: int = 30, tol: float = 1e-6) -> DataFrame:
    """Mean cross-validated AUC of TF-IDF (without English stop words) and logistic regression.

    Folds are stratified: within each label, rows in a seeded hash order go to the folds in
    turn, in as many folds as the rarer label has rows, if those are fewer.  The vocabulary is
    exact (every word of two letters or more), and document frequencies are counted in each
    fold's training rows alone; with ``leak`` they are counted in all rows.  Folds are fitted side
    by side.  A single class, or one row of it, is an error.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import StopWordsRemover
    from pyspark.ml.linalg import SparseVector, VectorUDT

    rows = df.where(F.col(label).isNotNull()).select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(label).cast("double").alias("label"), seeded_order(seed, F.col(uid)).alias("order_key"), F.col(uid).alias("uid"))
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().limit(3).collect()}
    if len(sizes) != 2 or min(sizes.values()) < 2:
        raise ValueError(f"two labels with at least two rows each are needed, not {sizes}")
    folds = min(folds, *sizes.values())
    place = positions(rows.select("label", "order_key", "uid"), ["label", "order_key", "uid"], "place").select("uid", "label", (F.col("place") % folds).cast("int").alias("fold"))
    stop = StopWordsRemover.loadDefaultStopWords("english")
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\b\w\w+\b"), 0), lambda w: ~w.isin(stop))
    x = durable(rows.drop("order_key").join(place, ["uid", "label"]).select("uid", "label", "fold", words.alias("words")))
    tf = durable(x.select("uid", "label", "fold", F.explode("words").alias("w")).groupBy("uid", "label", "fold", "w").agg(F.count(F.lit(1)).alias("tf")))
    # every word has a number in all folds; one that no training row has, has no frequency there
    tf = tf.join(durable(positions(tf.select("w").distinct(), ["w"], "at")), "w")
    frequency = durable(tf.groupBy("at", "fold").agg(F.count(F.lit(1)).alias("df")))
    size = frequency.agg(F.coalesce(F.max("at"), F.lit(0)) + 1).first()[0]
    vectors = tf.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct(F.col("at").cast("int").alias("at"), F.col("tf").cast("double").alias("tf")))).alias("v"))
    sparse = F.udf(lambda at, v: SparseVector(size, at or [], v or []), VectorUDT(), useArrow=False)
    counts = durable(x.drop("words").join(vectors, "uid", "left").select("uid", "label", "fold", sparse("v.at", "v.tf").alias("counts")))
    n_fold = {r["fold"]: r["count"] for r in counts.groupBy("fold").count().collect()}  # a row a fold

    def one(k: int) -> float:
        train = sum(v for f, v in n_fold.items() if f != k)
        n = sum(n_fold.values()) if leak else train
        seen = (frequency if leak else frequency.where(F.col("fold") != k)).groupBy("at").agg(F.sum("df").alias("df")).toArrow()
        idf = [0.0] * size  # as large as the coefficients
        for at, df in zip(*(seen.column(c).to_pylist() for c in ("at", "df")), strict=True):
            idf[at] = math.log((n + 1) / (df + 1)) + 1
        rows = features(counts, idf)
        model = LogisticRegression(regParam=1 / train, maxIter=rounds, tol=tol, standardization=False).fit(rows.where(F.col("fold") != k))
        return BinaryClassificationEvaluator(numBins=0).evaluate(model.transform(rows.where(F.col("fold") == k)))

    with ThreadPoolExecutor(folds) as pool:
        values = list(pool.map(one, range(folds)))
    return df.sparkSession.createDataFrame([(folds, sum(values) / folds)], "folds int, mean_auc double")


def features(counts: DataFrame, idf: list[float]) -> DataFrame:
    """uid, label, fold, features: each row's tf-idf vector of unit length (zero without a known word)."""
    from pyspark.ml.feature import ElementwiseProduct, Normalizer
    from pyspark.ml.linalg import Vectors

    scaled = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="counts", outputCol="scaled").transform(counts)
    return Normalizer(inputCol="scaled", outputCol="features").transform(scaled).select("uid", "label", "fold", "features")
