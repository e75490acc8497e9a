"""Pools to pairs, and the joins on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_pool(pool: DataFrame) -> DataFrame:
    """One row per (query, candidate); ``cand_pos`` counts from 0. A query without candidates has no rows."""
    return pool.select("query_idx", "src", "gold", F.posexplode("cands").alias("cand_pos", "cand"))


def _must(condition: Column, message: Column) -> Column:
    return F.when(condition, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))


def with_entities(pairs: DataFrame, sources: DataFrame, targets: DataFrame, key: str = "iri") -> DataFrame:
    """Both entities of each pair as structs; an id without an entity is an error.

    Sizes decide: Spark broadcasts an entity side under its threshold and
    sort-merges a larger one.
    """
    s = sources.select(F.col(key).alias("src"), F.struct(*sources.columns).alias("source"))
    t = targets.select(F.col(key).alias("cand"), F.struct(*targets.columns).alias("target"))
    joined = pairs.join(s, "src", "left").join(t, "cand", "left")
    found = _must(F.col("source").isNotNull() & F.col("target").isNotNull(), F.concat(F.lit("no entity for "), F.col("src"), F.lit(" or "), F.col("cand")))
    return joined.where(found)


def task_entities(pools: DataFrame, source: bool) -> DataFrame:
    """Distinct ids of one side of pools (gold isn't added)."""
    return (pools.select(F.col("src").alias("iri")) if source else pools.select(F.explode("cands").alias("iri"))).distinct()


def missing_entities(pairs: DataFrame, entities: DataFrame, *by: str) -> DataFrame:
    """Number of distinct candidates without an entity, by ``by``."""
    absent = pairs.select(*by, F.col("cand").alias("iri")).distinct().join(entities.select("iri"), "iri", "left_anti")
    return absent.groupBy(*by).agg(F.count(F.lit(1)).alias("n_missing"))


def checked_scores(pairs: DataFrame, scores: DataFrame, column: str) -> DataFrame:
    """The score of every pair; a missing cell or another id at its place is an error."""
    s = scores.select("query_idx", "cand_pos", F.col("src").alias("_src"), F.col("cand").alias("_cand"), F.col(column))
    joined = pairs.join(s, ["query_idx", "cand_pos"], "left")
    where = F.concat_ws(" ", F.lit("query"), F.col("query_idx"), F.lit("position"), F.col("cand_pos"))
    present = _must(F.col(column).isNotNull(), F.concat(F.lit("no score for "), where))
    same = _must((F.col("_src") == F.col("src")) & (F.col("_cand") == F.col("cand")), F.concat(F.lit("another entity at "), where))
    return joined.where(present & same).drop("_src", "_cand")


def score_faults(pairs: DataFrame, scores: DataFrame, column: str) -> DataFrame:
    """J06 as a report: counts of pairs, missing cells and mismatches."""
    s = scores.select("query_idx", "cand_pos", F.col("src").alias("_src"), F.col("cand").alias("_cand"), F.col(column).alias("_score"))
    joined = pairs.join(s, ["query_idx", "cand_pos"], "left")
    wrong = F.col("_score").isNotNull() & ((F.col("_src") != F.col("src")) | (F.col("_cand") != F.col("cand")))
    return joined.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("_score").isNull()).alias("missing"), F.count_if(wrong).alias("mismatched"))


def inspect_pools(pool: DataFrame) -> DataFrame:
    """One row of structural counts."""
    at = F.when(F.col("gold").isNull(), None).otherwise(F.array_position("cands", F.col("gold")) - 1)
    base = pool.select("src", "gold", F.size("cands").alias("n"), F.size(F.array_distinct("cands")).alias("d"), F.when(at >= 0, at).alias("at"))
    per_source = base.groupBy("src").agg(F.count(F.lit(1)).alias("c"), F.count(F.lit(1)).alias("queries"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.count_if(F.col("n") != F.col("d")).alias("dup"), F.count("gold").alias("golds"), F.count("at").alias("inside"), F.sum("at").alias("sum_at"), F.count_if(F.col("at") == 0).alias("first"))
    return per_source.agg(
        F.sum("queries").alias("queries"),
        F.count(F.lit(1)).alias("sources"),
        F.count_if(F.col("c") > 1).alias("sources_repeated"),
        F.min("lo").alias("min_pool"),
        F.max("hi").alias("max_pool"),
        F.sum("dup").alias("queries_with_duplicates"),
        F.sum("golds").alias("with_gold"),
        F.sum("inside").alias("gold_in_pool"),
        F.bround(F.sum("sum_at") / F.sum("inside"), 6).alias("mean_gold_pos"),
        F.sum("first").alias("gold_first"),
    )


def pool_sizes(pool: DataFrame) -> DataFrame:
    """How many queries have pools of each size."""
    return pool.groupBy(F.size("cands").alias("size")).agg(F.count(F.lit(1)).alias("queries"))


def distinct_targets(pool: DataFrame, *by: str) -> DataFrame:
    """Number of distinct candidate targets."""
    return pool.select(*by, F.explode("cands").alias("cand")).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("targets"))


def source_overlaps(pools: DataFrame) -> DataFrame:
    """For every two splits of ``pools(split, src, ...)`` the number of sources in both."""
    held = pools.select("split", "src").distinct()
    other = held.select(F.col("split").alias("other"), "src")
    return held.join(other, "src").where(F.col("split") < F.col("other")).groupBy("split", "other").agg(F.count(F.lit(1)).alias("sources"))


def ordered_entities(pools: DataFrame, source: bool) -> DataFrame:
    """``task_entities`` in code-point order."""
    return task_entities(pools, source).orderBy("iri")


def first_queries(pool: DataFrame, most: int) -> DataFrame:
    """The first queries in file order (a debug limit; 400 dev queries)."""
    return pool.orderBy("query_idx").limit(most)


def combined_scores(pairs: DataFrame, lexical: DataFrame, learned: DataFrame, lex: str = "lex", margin: str = "margin") -> DataFrame:
    """Every pair with its score from a lexical and a learned run, each checked against the pair it was stored for."""
    return checked_scores(checked_scores(pairs, lexical, lex), learned, margin)


def gold_deciles(pool: DataFrame) -> DataFrame:
    """Golds by tenth of the pool."""
    at = F.array_position("cands", F.col("gold")) - 1
    return pool.where("gold is not null").select(F.floor(at / 10).alias("bucket"), at.alias("at")).where("at >= 0").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
