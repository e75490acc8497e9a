"""Lexical features and scores of whole pools."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import similarity
from tessera.operators.pairs import with_entities


def pool_features(pairs: DataFrame, sources: DataFrame, targets: DataFrame, characters: bool = False) -> DataFrame:
    """every pair in pool order of its query, with e_label, e_name, j and, with ``characters``, r and lex_score.

    ``sources`` and ``targets`` are ``(iri, names, sets)``: names and token
    sets are made once an entity. Without ``characters`` all stays in the JVM.
    """
    both = with_entities(pairs, sources, targets)
    a, b = F.col("source.names"), F.col("target.names")
    found = both.select(
        *pairs.columns, similarity.label_equal(a, b).alias("e_label"), similarity.name_equal(a, b).alias("e_name"), similarity.best_jaccard(F.col("source.sets"), F.col("target.sets")).alias("j"),
        *([a.alias("_a"), b.alias("_b")] if characters else []),
    )
    if not characters:
        return found
    scored = found.withColumn("r", similarity.ratio_or_exact(F.col("e_name"), F.col("_a"), F.col("_b"))).drop("_a", "_b")
    return scored.withColumn("lex_score", similarity.lex_score(F.col("e_label"), F.col("e_name"), F.col("j"), F.col("r")))


def group_features(entities: DataFrame, key: str, *by: str, block: int = 256) -> DataFrame:
    """F36, all four features, rounded to six places: every ordered pair of ``entities(key, names, sets, by)`` that agrees on ``by`` and differs in ``key``.

    A group is cut into blocks of ``block`` rows and every two blocks of it
    meet in a group of their own. So a task holds ``2 * block`` entities and
    ``block ** 2`` pairs, however large a group is, and a large group is
    shared out; a pair becomes a row only with its result, and what is
    shuffled is each entity twice for every block of its group.
    """
    group = Window.partitionBy(*by)
    placed = entities.dropna(subset=[key, *by]).withColumn("_at", F.floor((F.row_number().over(group.orderBy(key)) - 1) / block)).withColumn("_n", F.max("_at").over(group))
    other = placed.withColumn("_to", F.explode(F.sequence(F.lit(0).cast("long"), "_n")))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("_at").alias("i"), F.col("_to").alias("k")), F.struct(F.lit(1).alias("side"), F.col("_to").alias("i"), F.col("_at").alias("k")))
    dealt = other.withColumn("_s", F.explode(sides)).select(*(F.col(c).alias(f"_by{n}") for n, c in enumerate(by)), "_s.i", "_s.k", "_s.side", F.col(key).cast("long").alias("key"), "names", "sets")

    def run(table: pa.Table) -> pa.Table:
        side, keys = table.column("side").to_numpy(), table.column("key").to_numpy()
        named = list(zip(table.column("names").to_pylist(), table.column("sets").to_pylist(), strict=True))
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        e_label, e_name, j, r = similarity.feature_table([named[n] for n in a], [named[n] for n in b])
        query, cand = np.broadcast_to(keys[a][:, None], j.shape), np.broadcast_to(keys[b][None, :], j.shape)
        kept = query != cand
        score = similarity.lex_score(e_label, e_name, j, r)
        columns = [query, cand, e_label, e_name, *(similarity.bround(v, 6) for v in (j, r, score))]
        return pa.table([c[kept] for c in columns], names=["query_idx", "cand", "e_label", "e_name", "j", "r", "lex_score"])

    # by number, so that groups are shared out over all cores: their bytes are few for what they hold
    spark = entities.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    keys = [*(f"_by{n}" for n in range(len(by))), "i", "k"]
    schema = "query_idx long, cand long, e_label int, e_name int, j double, r double, lex_score double"
    return dealt.repartition(parts, *keys).groupBy(*keys).applyInArrow(run, schema)
