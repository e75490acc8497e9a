"""Connected components by alternating large-star and small-star rounds.

Every round is two aggregations with map-side combine and two equi-joins that
AQE can split where a node is hot; each is written to the shared folder, so no
lineage grows and a lost executor costs one round. Links never reach the
driver, only one row with their number and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._store import materialise, release

#: Salts that spread the links of one node.
SPREAD = 8


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # a hub's links are spread over tasks
    spread = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)).cast("array<bigint>")))
    joined = both.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SPREAD))).join(spread, ["u", "salt"])
    return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u")
    return linked.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()


def components(spark: SparkSession, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)``; a component is named by its smallest node.

    Self-links and null ends are ignored, repeated links count once.
    """
    edges = materialise(spark, edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _state(edges)
    if before[0]:
        for _ in range(most_rounds):
            last, edges = edges, materialise(spark, _small_star(_large_star(edges)), "edges")
            release(last)
            if (after := _state(edges)) == before:
                break
            before = after
        else:
            raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = materialise(spark, edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots), "components")
    release(edges)
    return found
