"""Blending two scores and choosing the blend."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scores import blend, minmax, sigmoid
from tessera.operators.rank import gold_ranks_of, metrics, ranked

MODES = ("minmax", "prob")
ALPHAS = tuple(k / 10 for k in range(11))


def scaled(scores: DataFrame, mode: str, margin: str = "margin", lex: str = "lex", temperature: float = 1.0) -> DataFrame:
    """Learned and lexical score as a mode takes them: both scaled per query, or the probability and the plain lexical score."""
    if mode == "minmax":
        return scores.withColumn("learned", minmax(F.col(margin), "query_idx")).withColumn("lexical", minmax(F.col(lex), "query_idx"))
    return scores.withColumn("learned", sigmoid(F.col(margin), temperature)).withColumn("lexical", F.col(lex).cast("double"))


def apply(scores: DataFrame, mode: str, alpha: float, places: int = 9, **columns) -> DataFrame:
    """``score`` of a frozen choice and the rank by it."""
    mixed = scaled(scores, mode, **columns).withColumn("score", F.bround(blend(alpha, F.col("learned"), F.col("lexical")), places))
    return ranked(mixed, "score")


def grid(spark: SparkSession, scores: DataFrame, places: int = 9, temperature: float = 1.0) -> DataFrame:
    """Measures of the 22 choices in one job.

    Scaled scores are computed once and the choices are a list inside a pair's
    row; what is counted of them is a row for each query and choice, so pairs
    are not sorted once more for each choice.
    """
    both = scaled(scores, "minmax").withColumnsRenamed({"learned": "m_learned", "lexical": "m_lexical"})
    both = scaled(both, "prob", temperature=temperature)
    choices = F.array(*(F.struct(F.lit(m).alias("mode"), F.lit(a).alias("alpha")) for m in MODES for a in ALPHAS))
    side = lambda learned, lexical: F.transform(F.array(*map(F.lit, ALPHAS)), lambda a: F.bround(blend(a, F.col(learned), F.col(lexical)), places))
    listed = both.select("query_idx", "cand_pos", "cand", "gold", F.concat(side("m_learned", "m_lexical"), side("learned", "lexical")).alias("scores"))
    ranks = gold_ranks_of(listed, "scores").withColumn("choice", F.get(choices, F.col("k")))
    return metrics(ranks.select("choice.mode", "choice.alpha", "gold_rank"), "mode", "alpha")


def choose(measured: DataFrame) -> DataFrame:
    """The best MRR; ties go to minmax, then to the smaller alpha. Without queries it refuses."""
    some = F.when(F.col("queries") > 0, F.lit(True)).otherwise(F.raise_error(F.lit("no gold to tune on")).cast("boolean"))
    return measured.where(some).orderBy(F.desc("mrr"), "mode", "alpha").limit(1)
