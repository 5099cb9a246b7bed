"""Stratified samples, personas, experiment grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commlens.functions.text import seeded_order


#: Hexadecimal digits of the hash in the histogram that finds a sample's cut.
CUT_DIGITS = 3


def quotas(pool: DataFrame, strata: list[str], n: int) -> DataFrame:
    """Proportional quotas, rounded half to even; the residual goes to the largest stratum
    (the first one in key order on ties); never more than the stratum has.  Rows without a
    stratum count in the total only."""
    sizes = pool.groupBy(*strata).agg(F.count(F.lit(1)).alias("size"))
    total = F.sum("size").over(Window.partitionBy())  # one row a stratum
    named = sizes.withColumn("total", total).where(" AND ".join(f"{s} IS NOT NULL" for s in strata))
    raw = named.withColumn("quota", F.bround(F.col("size") * n / F.col("total")).cast("long"))
    order = Window.orderBy(F.col("size").desc(), *strata)
    residual = F.lit(n) - F.sum("quota").over(Window.partitionBy())
    fixed = raw.withColumns({"residual": residual, "place": F.row_number().over(order)})
    return fixed.select(*strata, "size", F.least("size", F.greatest(F.lit(0), F.col("quota") + F.when(F.col("place") == 1, F.col("residual")).otherwise(0))).cast("long").alias("quota"))


def stratified_sample(pool: DataFrame, strata: list[str], uid: str, n: int, seed: int) -> DataFrame:
    """Without replacement, in a seeded hash order; every stratum gives its whole quota.

    A histogram of the hash's first ``CUT_DIGITS`` digits finds the digits up to which a
    stratum's rows reach its quota, so the window sorts little more than the sample, not
    whole strata, whatever ids repeat.
    """
    q = quotas(pool, strata, n).where("quota > 0")
    keyed = pool.where(" AND ".join(f"{s} IS NOT NULL" for s in strata)).withColumn("order_key", seeded_order(seed, F.col(uid))).withColumn("digits", F.substring("order_key", 1, CUT_DIGITS))
    counts = keyed.groupBy(*strata, "digits").agg(F.count(F.lit(1)).alias("k"))  # at most 16**CUT_DIGITS rows a stratum
    upto = F.sum("k").over(Window.partitionBy(*strata).orderBy("digits"))
    cut = counts.withColumn("before", upto - F.col("k")).join(q, strata).where(F.col("before") < F.col("quota")).groupBy(*strata).agg(F.max("digits").alias("cut"), F.max("quota").alias("quota"))
    near = keyed.join(cut, strata).where(F.col("digits") <= F.col("cut"))
    place = F.row_number().over(Window.partitionBy(*strata).orderBy("order_key"))
    return near.withColumn("place", place).where(F.col("place") <= F.col("quota")).select(pool.columns)


def fully_eligible(threads: DataFrame, thread: str, eligible: Column) -> DataFrame:
    return threads.groupBy(thread).agg(F.bool_and(F.coalesce(eligible, F.lit(False))).alias("all_in")).where("all_in").select(thread)


def shots_and_replies(turns: DataFrame, thread: str, position: str, uid: str, eligible: Column, n_threads: int, n_replies: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Openers of sampled, wholly eligible threads; and a capped sample of their replies."""
    ok = fully_eligible(turns, thread, eligible)
    chosen = ok.orderBy(seeded_order(seed, F.col(thread))).limit(n_threads)
    rows = turns.join(chosen, thread, "left_semi")
    replies = rows.where(F.col(position) > 0).orderBy(seeded_order(seed, F.col(uid))).limit(n_replies)
    return rows.where(F.col(position) == 0), replies


def in_persona_cells(department: str, rank: str, departments: list[str], lowest: int = 1, highest: int = 5) -> Column:
    """Rows that personas are made of: some departments, ranks from lowest to highest."""
    return F.col(department).isin(departments) & F.col(rank).between(lowest, highest)


def persona_cells(df: DataFrame, rank: str, department: str, person: str, style: list[str]) -> DataFrame:
    """Style means and people by (rank, department) and by rank, in one pass."""
    g = df.groupingSets([[rank, department], [rank]], rank, department)
    return g.agg(F.grouping(department).cast("int").alias("pooled"), F.countDistinct(person).alias("n_people"), F.count(F.lit(1)).alias("n_messages"), *[F.avg(s).alias(s) for s in style])


def with_fallback(cells: DataFrame, grid: DataFrame, rank: str, department: str, style: list[str], least_people: int = 3) -> DataFrame:
    """Every grid cell's own style, or its rank's where fewer than ``least_people`` stand behind it."""
    values = ["n_people", "n_messages", *style]
    own = cells.where("pooled = 0").select(rank, department, *[F.col(v).alias(f"own_{v}") for v in values])
    pool = cells.where("pooled = 1").select(rank, *[F.col(v).alias(f"pool_{v}") for v in values])
    fine = F.coalesce(F.col("own_n_people"), F.lit(0)) >= least_people
    return (
        grid.join(own, [rank, department], "left")
        .join(pool, rank)
        .select(rank, department, F.when(fine, "cell").otherwise("rank_pooled").alias("derivation"), *[F.when(fine, F.col(f"own_{v}")).otherwise(F.col(f"pool_{v}")).alias(v) for v in values])
    )


def collapsed_ranks(personas: DataFrame, rank: str, style: list[str]) -> DataFrame:
    """Ranks of several personas that are all the same pool."""
    g = personas.groupBy(rank).agg(F.count(F.lit(1)).alias("n_personas"), F.bool_and(F.col("derivation") == "rank_pooled").alias("pooled"), F.countDistinct(F.struct(*style)).alias("styles"))
    return g.where("n_personas > 1 AND pooled AND styles = 1").select(rank, "n_personas")


def scenario_grid(tasks: DataFrame, directions: list[str], stakes: list[str]) -> DataFrame:
    """task x direction x stakes: a design of a few dozen rows, exploded from literals."""
    lists = {"direction": directions, "stakes": stakes}
    out = tasks
    for name, values in lists.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out.withColumn("scenario_id", F.concat_ws("_", "task_type", "direction", "stakes"))


def expand_grid(personas: DataFrame, scenarios: DataFrame, models: list[str], replicates: int) -> DataFrame:
    """All experiment cells with ids and cache groups.

    The product is the operator; the scenarios (a design of dozens) are carried as one array
    to every persona, so the product is a generator, not a cross join.
    """
    design = scenarios.agg(F.array_sort(F.collect_list(F.struct("scenario_id", "direction"))).alias("design"))
    x = personas.crossJoin(F.broadcast(design)).withColumn("s", F.explode("design")).withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    x = x.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    return x.select(
        F.concat(F.col("model"), F.lit("__"), F.col("persona_id"), F.lit("__"), F.col("s.scenario_id"), F.lit("__r"), F.col("replicate").cast("string")).alias("cell_id"),
        F.concat_ws("__", "model", "persona_id", "s.direction").alias("cache_group"),
        "persona_id", F.col("s.scenario_id").alias("scenario_id"), F.col("s.direction").alias("direction"), "model", "replicate",
    )


def design_summary(cells: DataFrame) -> DataFrame:
    groups = cells.groupBy("cache_group").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cell_id").alias("d"))
    return groups.agg(F.sum("n").alias("cells"), F.sum("d").alias("distinct_cells"), F.count(F.lit(1)).alias("cache_groups"), F.round(F.avg("n"), 6).alias("mean_group_size"))
