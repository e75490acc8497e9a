"""Splits and negatives.

Two modes: ``exact`` repeats the seeded shuffles on small lists of distinct
sources or indices; the hashed mode orders by md5 and needs no order of rows,
so it runs on tables of any size.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dev_size(n: int, share: float) -> int:
    return max(1, round(n * share))


def exact_dev_sources(sources: Iterable[str], share: float = 0.1, seed: int = 0) -> set[str]:
    """The first of the shuffled sorted distinct sources."""
    known = sorted(set(sources))
    random.Random(seed).shuffle(known)
    return set(known[: dev_size(len(known), share)])


def exact_fit_sample(indices: Sequence[int], most: int = 400, seed: int = 0) -> list[int]:
    """R02."""
    return sorted(random.Random(seed).sample(list(indices), min(most, len(indices))))


def exact_holdout(n: int, seed: int = 0, most: int = 400) -> list[int]:
    """Calibration indices."""
    order = list(range(n))
    random.Random(seed).shuffle(order)
    return order[: min(most, n // 10)]


def exact_negatives(rest: Sequence, query_idx: int, k: int, seed: int = 0) -> list:
    """Random negatives of one query."""
    return random.Random(seed * 1000003 + query_idx).sample(list(rest), min(k, len(rest)))


def md5_key(seed: int, *columns: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)))


def dev_sources(pool: DataFrame, share: float = 0.1, seed: int = 0) -> DataFrame:
    """R01 hashed: distinct sources whose hash is among the smallest share (at least one).

    A threshold on the first 52 bits of the hash, not a global sort: with
    ``share`` 0.1 about a tenth of the sources, the smallest always.
    """
    place = F.conv(F.substring(md5_key(seed, "src"), 1, 13), 16, 10).cast("double") / float(1 << 52)
    placed = pool.select("src").distinct().withColumn("place", place)
    least = placed.agg(F.min("place").alias("least"))
    return placed.join(F.broadcast(least), (F.col("place") < share) | (F.col("place") == F.col("least"))).select("src")


def split(pool: DataFrame, dev: DataFrame, inside: bool) -> DataFrame:
    """J10, P11, S25."""
    return pool.join(dev, "src", "left_semi" if inside else "left_anti")


def fit_sample(pool: DataFrame, dev: DataFrame, most: int = 400, seed: int = 0) -> DataFrame:
    """R02 hashed: the first queries in hash order outside the dev sources."""
    return split(pool, dev, False).orderBy(md5_key(seed, "query_idx"), "query_idx").limit(most)


def without_golds(pairs: DataFrame) -> DataFrame:
    """Candidates that are no known gold of the same source in any query."""
    golds = pairs.where("gold is not null").select("src", F.col("gold").alias("cand")).distinct()
    return pairs.join(golds, ["src", "cand"], "left_anti")


def hard_negatives(scored: DataFrame, ratio: int, score: str = "lex") -> DataFrame:
    """The lexically nearest half (rounded up) of a query's negatives, ties by position."""
    w = Window.partitionBy("query_idx").orderBy(F.desc(score), "cand_pos")
    return without_golds(scored).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= -(-ratio // 2)).drop("rn")


def random_negatives(scored: DataFrame, hard: DataFrame, ratio: int, seed: int = 0, exact: bool = False) -> DataFrame:
    """The other half, from what is left of the pool."""
    k = ratio - -(-ratio // 2)
    rest = without_golds(scored).join(hard.select("query_idx", "cand_pos"), ["query_idx", "cand_pos"], "left_anti")
    if not exact:
        w = Window.partitionBy("query_idx").orderBy(md5_key(seed, "query_idx", "cand_pos"), "cand_pos")
        return rest.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("cand_pos")
        chosen = exact_negatives(range(len(group)), int(group["query_idx"].iloc[0]), k, seed)
        return group.iloc[chosen]

    return rest.groupBy("query_idx").applyInPandas(pick, rest.schema)


def training_pairs(scored: DataFrame, ratio: int = 5, seed: int = 0, score: str = "lex", exact: bool = False) -> DataFrame:
    """For every query with gold in its pool: the positive, hard and random negatives."""
    fit = scored.where("gold is not null")
    hard = hard_negatives(fit, ratio, score)
    chance = random_negatives(fit, hard, ratio, seed, exact)
    kind = lambda frame, name, label: frame.select("query_idx", "src", "cand", "cand_pos", F.lit(name).alias("kind"), F.lit(label).alias("label"))
    return kind(fit.where("cand = gold"), "positive", 1).unionByName(kind(hard, "hard", 0)).unionByName(kind(chance, "random", 0))


def gold_block(label: Column) -> Column:
    """one-hot over the two options, and the label."""
    return F.struct(F.array((label == 1).cast("double"), (label == 0).cast("double")).alias("probabilities"), F.when(label == 1, "A").otherwise("B").alias("label"))


def case_counts(cases: DataFrame, state_tokens: str = "state_tokens") -> DataFrame:
    """Positives, negatives, and the tokens of the longest state."""
    return cases.agg(F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives"), F.max(state_tokens).alias("max_state_tokens"))


def raw_subset(spark, path: str, query_idx: DataFrame) -> DataFrame:
    """``(ord, value)``, the header (``ord`` 0) and the lines of some queries, verbatim as they stand in the file."""
    from tessera.sources.pools import with_line_numbers

    lines = with_line_numbers(spark.read.text(path).select("value", "_metadata")).select("ord", "value")
    wanted = query_idx.select((F.col("query_idx") + 1).alias("ord")).distinct()
    return lines.where("ord = 0").unionByName(lines.join(wanted, "ord", "left_semi")).orderBy("ord")
