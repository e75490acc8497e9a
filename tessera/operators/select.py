"""Choosing training seeds and collecting runs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.schema import POOL_SIZE


def training_completed(done: str = "epochs_done", planned: str = "epochs_planned"):
    """Whether training ended, and in words."""
    ok = F.coalesce(F.col(done) >= F.col(planned), F.lit(False))
    ratio = F.concat(F.col(done).cast("string"), F.lit("/"), F.col(planned).cast("string"), F.lit(" epochs"))
    why = F.when(F.col(done).isNull(), "no training record").when(~ok, F.concat(F.lit("training stopped after "), ratio)).otherwise(ratio)
    return ok.alias("completed"), why.alias("reason")


def select_seed(seeds: DataFrame) -> DataFrame:
    """Per pair the completed seed of the best dev MRR, ties to the lower seed; none, or one without a measure, is an error."""
    ok, why = training_completed()
    judged = seeds.select("*", ok, why)
    missing = F.raise_error(F.concat(F.lit("no measures for seed "), F.col("seed"))).cast("double")
    mrr = F.when(F.col("completed"), F.coalesce("dev_mrr", missing))
    found = judged.withColumn("mrr", mrr).groupBy("pair").agg(
        F.max_by("seed", F.when(F.col("completed"), F.struct("mrr", -F.col("seed")))).alias("selected_seed"),
        F.max("mrr").alias("dev_mrr"),
        F.array_sort(F.collect_list(F.when(F.col("completed"), F.col("seed")))).alias("completed_seeds"),
        F.array_sort(F.collect_list(F.when(~F.col("completed"), F.struct("seed", "reason")))).alias("excluded"),
    )
    none = F.raise_error(F.concat(F.lit("no seed completed for "), F.col("pair"))).cast("boolean")
    return found.where(F.when(F.size("completed_seeds") > 0, F.lit(True)).otherwise(none))


def best_epoch(epochs: DataFrame) -> DataFrame:
    """The earliest epoch of the best dev MRR."""
    return epochs.groupBy("run").agg(F.max_by("epoch", F.struct("dev_mrr", -F.col("epoch"))).alias("best_epoch"), F.max("dev_mrr").alias("best_dev_mrr"))


def mean_loss(steps: DataFrame) -> DataFrame:
    """Mean loss of an epoch over finite steps, and how many were not."""
    finite = ~F.isnan("loss") & (F.abs("loss") < float("inf"))
    return steps.groupBy("epoch").agg(F.avg(F.when(finite, F.col("loss"))).alias("mean_loss"), F.count_if(~finite).alias("non_finite"))


def collect_runs(evals: DataFrame, meta: DataFrame) -> DataFrame:
    """Evaluations with what is recorded of their runs, by pair, split and method; a run without a record stays."""
    return evals.join(meta, "run_dir", "left").orderBy("pair", "split", "method")


def hard_subset(ranks: DataFrame, *by: str) -> DataFrame:
    """Queries that the lexical ranking gets wrong, and how the blend does on them."""
    rr = lambda c: F.coalesce(1.0 / F.col(c), F.lit(0.0))
    hard = ranks.where(F.coalesce(F.col("lex_rank") != 1, F.lit(True))).withColumns({"a": rr("lex_rank"), "b": rr("blend_rank")})
    return hard.groupBy(*by).agg(
        F.count(F.lit(1)).alias("queries"),
        F.bround(F.avg("a"), 6).alias("mrr_lexical"),
        F.bround(F.avg("b"), 6).alias("mrr_blend"),
        F.count_if(F.col("b") > F.col("a")).alias("better"),
        F.count_if(F.col("b") == F.col("a")).alias("equal"),
        F.count_if(F.col("b") < F.col("a")).alias("worse"),
    )


def paired_bootstrap(ranks: DataFrame, resamples: int = 10_000, seed: int = 0) -> DataFrame:
    """95 % interval of the mean gain in reciprocal rank on the hard subset, by drawing its queries with replacement.

    How often each of the distinct gains is drawn is multinomial, so a
    resample needs the number of queries of each gain and not the queries.
    A gain is a pair of ranks in a pool, so there are at most
    ``(POOL_SIZE + 2) ** 2`` of them whatever the number of queries; only
    these are gathered. No hard query gives null limits.
    """
    rr = lambda c: F.coalesce(1.0 / F.col(c), F.lit(0.0))
    hard = ranks.where(F.coalesce(F.col("lex_rank") != 1, F.lit(True))).groupBy("lex_rank", "blend_rank").agg(F.count(F.lit(1)).alias("n"))
    held = hard.select("lex_rank", "blend_rank", "n", (rr("blend_rank") - rr("lex_rank")).alias("gain")).orderBy("lex_rank", "blend_rank").limit((POOL_SIZE + 2) ** 2 + 1).collect()
    if len(held) > (POOL_SIZE + 2) ** 2:
        raise ValueError("ranks beyond the size of a pool")
    schema = "low double, high double"
    if not held:
        return ranks.sparkSession.createDataFrame([(None, None)], schema)
    n, gains = np.array([r.n for r in held], float), np.array([r.gain for r in held])
    rng = np.random.default_rng(seed)
    means = np.concatenate([rng.multinomial(int(n.sum()), n / n.sum(), size=min(100, resamples - at)) @ gains / n.sum() for at in range(0, resamples, 100)])
    low, high = np.percentile(means, [2.5, 97.5])
    return ranks.sparkSession.createDataFrame([(float(low), float(high))], schema)


def seed_names(pair: str, seed: int, ratio: int = 5, rep: str = "D") -> dict[str, str]:
    """F32: where the files of a training seed lie; the first seed has no suffix. Names are of this engine's own pattern."""
    run = "-".join(["learned", f"neg{ratio}", f"rep{rep}", *([f"seed{seed}"] if seed else [])])
    folder = f"checkpoints/{pair.lower()}/{run}"
    return {"run": run, "checkpoint": f"{folder}/best", "train_config": f"{folder}/train_config.json", "dev_dir": f"outputs/{pair}/train-dev/{run}", "dev_blend_dir": f"outputs/{pair}/train-dev/lexical+{run}"}


def seed_summary(seeds: DataFrame, *metrics: str) -> DataFrame:
    """Per pair the measures of every completed seed, as a JSON object by seed."""
    ok, _ = training_completed()
    each = seeds.select("*", ok).where("completed")
    shown = F.struct(F.col("seed").cast("string").alias("seed"), F.to_json(F.struct(*metrics)).alias("measures"))
    listed = F.array_sort(F.collect_list(shown))
    pairs = F.transform(listed, lambda x: F.concat(F.lit('"'), x["seed"], F.lit('":'), x["measures"]))
    return each.groupBy("pair").agg(F.count(F.lit(1)).alias("seeds"), F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")).alias("per_seed"))


def hardest(scored: DataFrame, score: str = "lex") -> DataFrame:
    """Per query the best-scored wrong candidate, ties to the largest id."""
    best = scored.where(~F.col("cand").eqNullSafe(F.col("gold")))
    return best.groupBy("query_idx").agg(F.max(F.struct(score, "cand")).alias("x")).select("query_idx", F.col("x.cand").alias("cand"), F.col(f"x.{score}").alias(score))


def running_best(epochs: DataFrame) -> DataFrame:
    """W11 as a stream of epochs: the best so far after each."""
    w = Window.partitionBy("run").orderBy("epoch")
    return epochs.withColumn("best_so_far", F.max("dev_mrr").over(w))
