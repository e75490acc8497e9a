"""Resumable and incremental scoring.

Scores are appended as partitions of ``chunk`` queries; a run skips the chunks
that are complete. A torn append has no commit marker and is never read, so
nothing is truncated by hand. The same scoring as a stream watches a folder of
pools and appends each micro-batch once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tessera.schema import POOL


def chunk_of(size: int = 32):
    return F.floor(F.col("query_idx") / size).alias("chunk_id")


def complete_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Of scores in file order ``(ord, ...)``: how many whole blocks there are and how many rows to keep."""
    return rows.agg(F.floor(F.count(F.lit(1)) / block).alias("complete"), (F.floor(F.count(F.lit(1)) / block) * block).alias("rows_kept"))


def resumable(lines: DataFrame, columns: list[str], block: int) -> DataFrame:
    """Of the lines ``(ord, value)`` of a score file: whole blocks, and rows to keep. Another header starts at 0; lines without all their cells don't count."""
    header = F.max((F.col("ord") == 0) & (F.col("value") == "\t".join(columns)))
    whole = F.count_if((F.col("ord") > 0) & (F.size(F.split("value", "\t", -1)) == len(columns)))
    done = F.when(F.coalesce(header, F.lit(False)), F.floor(whole / block)).otherwise(0)
    return lines.agg(done.alias("complete"), (done * block).alias("rows_kept"))


def pending(pool: DataFrame, done: DataFrame | None, size: int = 32) -> DataFrame:
    """Queries of chunks that have not all their rows among ``done(query_idx, cand_pos)``."""
    placed = pool.withColumn("chunk_id", F.floor(F.col("query_idx") / size))
    if done is None:
        return placed
    want = placed.groupBy("chunk_id").agg(F.sum(F.size("cands")).alias("want"))
    have = done.select("query_idx", "cand_pos").distinct().groupBy(chunk_of(size)).agg(F.count(F.lit(1)).alias("have"))
    whole = want.join(have, "chunk_id").where("want = have").select("chunk_id")
    return placed.join(whole, "chunk_id", "left_anti")


def read_done(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def score_resumably(spark: SparkSession, pool: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, size: int = 32) -> DataFrame:
    """Score what is pending and replace whole chunks; repeating it changes nothing.

    Rows are dealt by chunk before they are written: a chunk is one file, where
    otherwise every task would leave one for every chunk it has rows of.
    """
    todo = pending(pool, read_done(spark, path), size)
    scored = score(todo.drop("chunk_id")).withColumn("chunk_id", F.floor(F.col("query_idx") / size)).repartition("chunk_id")
    scored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk_id").parquet(path)
    return spark.read.parquet(path)


def stream_scores(spark: SparkSession, folder: str, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Structured Streaming over a folder of pool tables: every file scored once, micro-batch by micro-batch."""
    pools = spark.readStream.schema(POOL).parquet(folder)

    def append(batch: DataFrame, epoch: int) -> None:
        score(batch).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(path)

    return pools.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
