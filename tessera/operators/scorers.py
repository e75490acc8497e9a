"""Pluggable scorers of pairs.

A scorer is a factory called once in every worker process; it returns a
function from source and target texts to logits of (equivalent, not).
The neural models of this task are not available offline; what is here is the
interface, and scorers that are what they say: a dot product of embeddings,
and a logistic regression on lexical features.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ScorePairs = Callable[[Sequence[str], Sequence[str]], np.ndarray]  # -> n x 2 logits
Scorer = Callable[[], ScorePairs]


def score_pairs(states: DataFrame, scorer: Scorer, batch: int = 16, temperature: float = 1.0, most_tokens: int = 512, raw: bool = False) -> DataFrame:
    """Prob, margin, choice and truncated of every pair of ``states(query_idx, src, cand, cand_pos, source_text, target_text, n_tokens)``.

    Rows are sorted by length inside their partition, so batches are even.
    With ``raw`` the scorer's two logits come along as they are (M02).
    """
    schema = "query_idx bigint, src string, cand string, cand_pos int, prob double, margin double, choice int, truncated int" + (", z0 double, z1 double" if raw else "")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = scorer()
        for part in parts:
            for at in range(0, len(part), batch):
                rows = part.iloc[at : at + batch]
                logits = np.asarray(score(rows["source_text"].tolist(), rows["target_text"].tolist()), float)
                margin = logits[:, 0] - logits[:, 1]
                prob = 1 / (1 + np.exp(-np.clip(margin / temperature, -700, 700)))
                found = pd.DataFrame({"query_idx": rows["query_idx"], "src": rows["src"], "cand": rows["cand"], "cand_pos": rows["cand_pos"], "prob": prob, "margin": margin, "choice": (margin < 0).astype("int32"), "truncated": (rows["n_tokens"] > most_tokens).astype("int32")})
                yield found.assign(z0=logits[:, 0], z1=logits[:, 1]) if raw else found

    return states.sortWithinPartitions("n_tokens").mapInPandas(run, schema)


def score_pools(states: DataFrame, scorer: Callable[[], Callable[[str, Sequence[str]], np.ndarray]]) -> DataFrame:
    """One question over a whole pool ``states(query_idx, src, source_text, options array<struct<cand, cand_pos, text>>)``; softmax over the pool."""
    schema = "query_idx bigint, src string, cand string, cand_pos int, prob double, logit double"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = scorer()
        for part in parts:
            for row in part.itertuples(index=False):
                options = [dict(o) if not hasattr(o, "asDict") else o.asDict() for o in row.options]
                logits = np.asarray(score(row.source_text, [o["text"] for o in options]), float)
                if len(logits) != len(options):
                    raise ValueError("the scorer returned another number of options")
                e = np.exp(logits - logits.max(initial=0))
                yield pd.DataFrame({"query_idx": row.query_idx, "src": row.src, "cand": [o["cand"] for o in options], "cand_pos": [o["cand_pos"] for o in options], "prob": e / e.sum(), "logit": logits})

    return states.mapInPandas(run, schema)


def dot_margin(a: Column, b: Column) -> Column:
    """Dot product of two float arrays, added up in order in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def token_overlap_scorer() -> ScorePairs:
    """A stand-in scorer for tests: logits from shared words."""

    def score(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
        out = []
        for x, y in zip(a, b, strict=True):
            s, t = set(x.lower().split()), set(y.lower().split())
            out.append((4 * len(s & t) / max(1, len(s | t)) - 1, 0.0))
        return np.array(out).reshape(-1, 2)

    return score


def fit_temperature(margin: np.ndarray, label: np.ndarray, grid: Sequence[float] = tuple(np.geomspace(0.05, 20, 61))) -> float:
    """The temperature of least log loss on held-out margins."""
    losses = {}
    for t in grid:
        z = np.clip(margin / t, -700, 700)
        losses[float(t)] = float(np.mean(np.logaddexp(0, np.where(label == 1, -z, z))))
    return min(losses, key=losses.get)


def fit_logistic(training: DataFrame, features: Sequence[str], label: str = "label"):
    """M07 stand-in: a logistic regression on lexical features (S26: its own ``save`` and ``load``)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_features"), LogisticRegression(featuresCol="_features", labelCol=label, maxIter=50)]).fit(training)


def batch_sweep(spark: SparkSession, states: DataFrame, scorer: Scorer, sizes: Sequence[int] = (8, 16, 32)) -> list[dict]:
    """Pairs per second and margin drift by batch size."""
    from tessera.operators.validate import margin_drift

    out, first = [], None
    for size in sizes:
        began = time.time()
        found = score_pairs(states, scorer, size).cache()
        try:
            n = found.count()
            took = max(1e-9, time.time() - began)
            first = found if first is None else first
            out.append({"batch_size": size, "pairs_per_sec": n / took, "max_margin_drift_vs_first": margin_drift(first, found).first()[0]})
        finally:
            if found is not first:
                found.unpersist()
    if first is not None:
        first.unpersist()
    return out
