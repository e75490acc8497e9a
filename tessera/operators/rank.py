"""Ranking and its measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sane(score: str) -> Column:
    return F.when(F.isnan(score), F.raise_error(F.lit("a score is not a number")).cast("double")).otherwise(F.col(score))


def ranked(scores: DataFrame, score: str, *by: str) -> DataFrame:
    """``rank`` from 1 within a query (and ``by``), best score first, ties by position; NaN is an error (Q3)."""
    w = Window.partitionBy(*by, "query_idx").orderBy(F.desc("_score"), "cand_pos")
    return scores.withColumn("_score", _sane(score)).withColumn("rank", F.row_number().over(w)).drop("_score")


def ranking(rows: DataFrame) -> DataFrame:
    """Candidates best first, one row per query; pools are bounded, so is the array."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "cand"))), lambda x: x["cand"])
    return rows.groupBy("query_idx", "src").agg(ordered.alias("ranked"))


def gold_ranks(rows: DataFrame, *by: str) -> DataFrame:
    """The best rank of the gold of every query; null where it is not in the pool."""
    return rows.groupBy(*by, "query_idx").agg(F.min(F.when(F.col("cand") == F.col("gold"), F.col("rank"))).alias("gold_rank"))


def gold_ranks_of(scores: DataFrame, listed: str) -> DataFrame:
    """W01, W04 by several scores at once, an array of them for each pair: per query and place ``k`` in the array what ``gold_ranks`` gives of ``ranked``.

    A rank is one more than the number of candidates before it, which is
    counted: pairs are sorted by query only, not again for each score.
    """
    gold = F.when(F.col("cand") == F.col("gold"), F.struct(F.col("cand_pos").alias("at"), F.col(listed).alias("scores")))
    held = scores.select("query_idx", "cand_pos", listed, F.collect_list(gold).over(Window.partitionBy("query_idx")).alias("golds"))
    each = held.select("query_idx", "cand_pos", listed, F.explode_outer("golds").alias("g")).select("query_idx", "cand_pos", "g", F.posexplode(listed).alias("k", "_score"))
    place = lambda score, at: F.struct(score.alias("score"), (-at).alias("at"))
    before = place(_sane("_score"), F.col("cand_pos")) > place(F.get("g.scores", F.col("k")), F.col("g.at"))
    counted = each.groupBy("query_idx", "k", F.col("g.at").alias("at")).agg(F.count_if(before).alias("n"))
    return counted.groupBy("query_idx", "k").agg(F.min(F.when(F.col("at").isNotNull(), F.col("n") + 1)).cast("int").alias("gold_rank"))


def metrics(ranks: DataFrame, *by: str, places: int = 6) -> DataFrame:
    """MRR and Hits@1/5/10; a missing gold counts 0, no queries give 0.

    Queries are first counted by rank, so the sum runs over at most a pool's
    size of exact integers, in rank order, whatever the partitioning (Q6).
    """
    counts = ranks.groupBy(*by, "gold_rank").agg(F.count(F.lit(1)).alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("gold_rank", F.lit(0)).alias("rank"), "n")))
    whole = counts.groupBy(*by).agg(ordered.alias("h"), F.sum("n").alias("queries"))
    n = F.greatest(F.coalesce("queries", F.lit(0)), F.lit(1))

    def total(term) -> Column:
        return F.aggregate(F.coalesce("h", F.array().cast("array<struct<rank:int,n:bigint>>")), F.lit(0.0), lambda s, x: s + F.when(x["rank"] > 0, term(x)).otherwise(0.0)) / n

    hit = lambda k: total(lambda x: F.when(x["rank"] <= k, x["n"].cast("double")).otherwise(0.0))
    return whole.select(*by, F.bround(total(lambda x: x["n"] / x["rank"]), places).alias("mrr"), *(F.bround(hit(k), places).alias(f"hits_at_{k}") for k in (1, 5, 10)), F.coalesce("queries", F.lit(0)).alias("queries"))


def macro_mean(per_pair: DataFrame) -> DataFrame:
    """The mean of each measure over pairs."""
    return per_pair.agg(*(F.bround(F.avg(c), 6).alias(c) for c in ("mrr", "hits_at_1", "hits_at_5", "hits_at_10")), F.count(F.lit(1)).alias("pairs"))


def tied_tops(scores: DataFrame, score: str) -> DataFrame:
    """Queries whose best score is shared."""
    w = Window.partitionBy("query_idx")
    top = scores.withColumn("_top", F.max(score).over(w)).where(F.col(score) == F.col("_top")).groupBy("query_idx").agg(F.count(F.lit(1)).alias("n"))
    return top.agg(F.count_if(F.col("n") > 1).alias("tied_queries"), F.count(F.lit(1)).alias("queries"))


def checked_ranking(rankings: DataFrame, pool: DataFrame) -> DataFrame:
    """Rankings in query order; one that is no permutation of its pool, or a differing number of queries, is an error."""
    joined = pool.select("query_idx", "src", "cands").join(rankings.select("query_idx", "ranked"), "query_idx", "full_outer")
    same = F.col("ranked").isNotNull() & F.col("cands").isNotNull() & (F.array_sort("ranked") == F.array_sort("cands"))
    fault = F.raise_error(F.concat(F.lit("no permutation of the pool: query "), F.col("query_idx"))).cast("boolean")
    return joined.where(F.when(F.coalesce(same, F.lit(False)), F.lit(True)).otherwise(fault)).select("query_idx", "src", "ranked").orderBy("query_idx")


def evaluate(rankings: DataFrame, pool: DataFrame, measured: bool = True) -> DataFrame:
    """Rankings checked against their pools; with ``measured`` their metrics, else (a split without gold) only how many passed."""
    sound = checked_ranking(rankings, pool)
    if not measured:
        return sound.agg(F.count(F.lit(1)).alias("queries"), F.lit(True).alias("validated"))
    golds = sound.join(pool.select("query_idx", "gold"), "query_idx")
    at = F.array_position("ranked", F.coalesce("gold", F.lit("")))
    return metrics(golds.select("query_idx", F.when(at > 0, at).cast("int").alias("gold_rank"))).withColumn("validated", F.lit(True))


def dev_metrics(scores: DataFrame, margin: str = "margin", *by: str) -> DataFrame:
    """Metrics of a checkpoint's dev ranking, by margins as they are (not rounded as in files)."""
    return metrics(gold_ranks(ranked(scores, margin, *by), *by), *by)


def submission_problems(rows: DataFrame, pool: DataFrame, size: int, most: int = 20) -> DataFrame:
    """What is wrong with submitted rows ``(query_idx, cells, src, ranked)``, the first ``most``.

    ``cells`` is the number of cells of the line, ``ranked`` null where its
    second cell is no list literal.
    """
    p = pool.select("query_idx", F.col("src").alias("_src"), "cands")
    joined = p.join(rows, "query_idx", "full_outer")
    known = F.col("ranked").isNotNull()
    iri = lambda x: x.startswith("http") & (F.lower(x) != "nan")
    found = F.array_compact(
        F.array(
            F.when(F.col("src").isNull() | F.col("_src").isNull(), "row count differs from the pool"),
            F.when(F.col("cells") != 2, "wrong number of cells"),
            F.when(F.col("src") != F.col("_src"), "source order mismatch"),
            F.when(F.col("src").isNotNull() & ~known, "not a list literal"),
            F.when(known & ((F.size("ranked") != size) | (F.size(F.array_distinct("ranked")) != size)), "wrong number of distinct candidates"),
            F.when(known & ((F.size(F.array_except("ranked", "cands")) > 0) | (F.size(F.array_except("cands", "ranked")) > 0)), "not a permutation of the pool"),
            F.when(known & F.exists("ranked", lambda x: ~iri(x)), "a candidate is not a full IRI"),
        )
    )
    return joined.select("query_idx", F.posexplode(found).alias("k", "problem")).orderBy("query_idx", "k").limit(most).select("query_idx", "problem")
