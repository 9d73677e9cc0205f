"""Logistic models fitted by gradient descent, and predictions for sessions that were left out.

A fit takes a bounded sample of labelled rows (``SAMPLE``, those of least hash), as its gradient needs them at once;
predictions cover every row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 50_000
FOLDS = 32  # sessions whose models are updated together


def fit(x: np.ndarray, y: np.ndarray, steps: int = 2000, rate: float = 0.5, l2: float = 1e-3) -> np.ndarray:
    """Weights by full-batch descent; the first column is the intercept and isn't penalised."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        gradient = x.T @ (p - y) / max(1, len(y))
        gradient[1:] += l2 * w[1:]
        w -= rate * gradient
    return w


def _sample(df: DataFrame, keys: list[str], size: int) -> DataFrame:
    return df.orderBy(F.xxhash64(*keys)).limit(size)


def logistic_fit(df: DataFrame, features: str, label: str, keys: list[str], steps: int = 2000, sample: int = SAMPLE) -> np.ndarray:
    rows = _sample(df.select(*keys, features, label), keys, sample).toPandas()  # bounded by sample
    if rows.empty:
        return np.zeros(0)
    return fit(np.stack(rows[features]), rows[label].to_numpy(float), steps)


def _without(known: tuple, folds: list[str], common: np.ndarray, steps: int, l2: float = 1e-3) -> list[np.ndarray | None]:
    """Weights of the models without each of ``folds``: Newton steps from the common fit over distinct rows, to the optimum.

    What has no optimum, as only one class is left, or isn't reached is fitted by descent; None where no rows are left.
    """
    own, x, y, standardise = known
    rows, at = np.unique(x, axis=0, return_inverse=True)
    at, column, d = at.reshape(-1), {f: i for i, f in enumerate(folds)}, x.shape[1]
    n, hits = (np.repeat(np.bincount(at, w, minlength=len(rows))[:, None], len(folds), 1) for w in (np.ones(len(y)), y))
    taken = np.array([column.get(f, -1) for f in own])
    held = taken >= 0
    np.subtract.at(n, (at[held], taken[held]), 1.0)
    np.subtract.at(hits, (at[held], taken[held]), y[held])
    size = np.maximum(1, n.sum(0))
    sd = np.ones((d, len(folds)))
    if standardise:
        mean = rows.T @ n / size
        for k in range(1, d):
            sd[k] = np.sqrt((n * (rows[:, k, None] - mean[k]) ** 2).sum(0) / size)
        sd[sd < 1e-12] = 1
    penalty = l2 * sd**2  # of weights of plain features
    penalty[0] = 0
    squares = (rows[:, :, None] * rows[:, None, :]).reshape(len(rows), -1)
    w, moved = np.repeat(common[:, None], len(folds), 1), np.full(len(folds), np.inf)
    with np.errstate(all="ignore"):
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(rows @ w, -60, 60)))
            slope = rows.T @ (n * p - hits) / size + penalty * w
            bend = (squares.T @ (n * p * (1 - p)) / size).T.reshape(-1, d, d) + np.eye(d) * penalty.T[:, :, None]
            try:
                step = np.linalg.solve(bend, slope.T[:, :, None])[:, :, 0].T
            except np.linalg.LinAlgError:
                break
            w, moved = w - step, np.abs(step).max(0)
            if moved.max() < 1e-9:
                break
    out: list[np.ndarray | None] = []
    for f, i in column.items():
        rest = own != f
        if not rest.any():
            out.append(None)
        elif 0 < hits[:, i].sum() < size[i] and moved[i] < 1e-6:
            out.append(w[:, i])
        else:
            out.append(_plain_fit(x[rest], y[rest], standardise, steps))
    return out


def _plain_fit(x: np.ndarray, y: np.ndarray, standardise: bool, steps: int) -> np.ndarray:
    """Weights of plain features, by a fit of standardised ones if asked."""
    mu, sd = np.zeros(x.shape[1]), np.ones(x.shape[1])
    if standardise:
        mu[1:], sd[1:] = x[:, 1:].mean(0), x[:, 1:].std(0)
        sd[sd == 0] = 1
    w = fit((x - mu) / sd, y, steps) / sd
    w[0] -= mu @ w
    return w


def left_out_scores(df: DataFrame, features: str, label: str, keys: list[str], session: str = "session", steps: int = 2000, sample: int = SAMPLE, standardise: bool = False) -> DataFrame:
    """``df`` with ``p``: the prediction of a model that saw no row of the row's session; 0.5 without training rows.

    Each session of the sample has a model of its own, updated from a common fit; sessions without sampled rows take the common one.
    """
    spark = df.sparkSession
    marked = df.withColumn("__fold", F.coalesce(F.col(session).cast("string"), F.lit("")))
    known = _sample(marked.select(*keys, "__fold", features, label), keys, sample).toPandas()
    if known.empty:
        return marked.withColumn("p", F.lit(0.5)).drop("__fold")
    data = (known["__fold"].to_numpy(str), np.stack(known[features]), known[label].to_numpy(float), standardise)
    common = _plain_fit(*data[1:], steps)
    sent = spark.sparkContext.broadcast(data)
    folds = sorted(known["__fold"].unique())
    blocks = spark.createDataFrame([(folds[i : i + FOLDS],) for i in range(0, len(folds), FOLDS)], "folds array<string>")

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block in batch["folds"]:
                yield pd.DataFrame({"fold": list(block), "w": _without(sent.value, list(block), common, steps)})

    models = blocks.repartition(spark.sparkContext.defaultParallelism).mapInPandas(train, "fold string, w array<double>")
    joined = marked.join(F.broadcast(models), F.col("__fold") == F.col("fold"), "left")  # at most a row per sampled row
    w = F.when(F.col("fold").isNull(), F.array(*map(F.lit, common.tolist()))).otherwise(F.col("w"))
    z = F.aggregate(F.zip_with(features, w, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return joined.withColumn("p", F.coalesce(1 / (1 + F.exp(-z)), F.lit(0.5))).drop("__fold", "fold", "w")


def conformal_floors(scored: DataFrame, score: str, label: str, miss: float, session: str = "session", finite: bool = False) -> DataFrame:
    """Per session the needed score that the share ``miss`` of the other sessions' needed scores lie below: ``session, floor``.

    With ``finite`` the rank is that of the finite-sample guarantee, ``floor(miss * (n + 1)) - 1`` from 0, else ``floor(miss * n)``.
    Every session has a floor; it is 0 where no other has a needed score. Null scores have no rank. Windows see distinct scores and ranks only.
    """
    held = scored.withColumn("s", F.when(F.col(label), F.col(score))).groupBy(session, "s").agg(F.count("s").alias("k"))
    everywhere = held.filter(F.col("s").isNotNull()).groupBy("s").agg(F.sum("k").alias("k")).withColumn("upto", F.sum("k").over(Window.orderBy("s")))
    whole = everywhere.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"))
    own = held.withColumn("own", F.sum("k").over(Window.partitionBy(session).orderBy("s"))).withColumn("rest", -F.sum("k").over(Window.partitionBy(session)))
    ranked = own.join(everywhere.select("s", "upto"), "s", "left").join(F.broadcast(whole)).withColumn("rest", F.col("rest") + F.col("n"))
    # 1 - (1 - miss) is the share as the target 1 - miss gives it: 0.1 becomes 0.09999999999999998, and whole products one rank less
    at = F.floor((F.col("rest") + 1) * (1 - (1 - miss))) - 1 if finite else F.floor(F.col("rest") * miss)
    ranked = ranked.withColumn("rank", F.greatest(F.lit(0), F.least(F.col("rest") - 1, at)) + 1)
    passed = F.max(F.when(F.col("upto") - F.col("own") < F.col("rank"), F.col("own")))  # own scores below the floor
    wanted = ranked.groupBy(session).agg(F.max("rest").alias("rest"), (F.max("rank") + F.coalesce(passed, F.lit(0))).alias("upto"))
    marks = everywhere.select("upto", "s").unionByName(wanted.select("upto").distinct().withColumn("s", F.lit(None).cast("double")))
    least = F.last("s", ignorenulls=True).over(Window.orderBy(F.desc("upto"), F.col("s").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0))
    floors = marks.withColumn("floor", least).filter(F.col("s").isNull()).select("upto", "floor")
    return wanted.join(floors, "upto", "left").select(session, F.when(F.col("rest") > 0, F.col("floor")).otherwise(0.0).alias("floor"))
