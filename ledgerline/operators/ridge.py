"""A ridge regression per key from sufficient statistics.

One aggregation gives every key and fold its count, sums and products of the
features and the label (combined before the shuffle, so a hot key is a few
rows a task).  A key's statistics are the sum over its folds, and those of the
rows outside a fold are the difference, so the five fits of a cross-validation
and their errors need no second look at the rows.  The solve is a small linear
system per key, done for all keys of a batch at once.

Features are standardised (population deviation; a constant one keeps its
scale), the intercept is not penalised.  Rows with a null or NaN feature or label are
left out; keys with fewer than ``min_rows`` rows have no model.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.session import reliable_checkpoint


def solve(moments: np.ndarray, alpha: float) -> np.ndarray:
    """Intercept and coefficients from the matrices (any number of them) of sums of products of (1, features, label)."""
    n, d = moments[..., 0, 0, None], moments.shape[-1] - 2
    mean = moments[..., 0, :] / n
    spread = moments[..., 1:, 1:] - n[..., None] * mean[..., 1:, None] * mean[..., None, 1:]
    variance = np.diagonal(spread, axis1=-2, axis2=-1)[..., :d] / n
    scale = np.sqrt(np.where(variance <= 1e-12 * (1 + mean[..., 1:d + 1] ** 2), 1.0, variance))
    left = spread[..., :d, :d] / (scale[..., :, None] * scale[..., None, :]) + alpha * np.eye(d)
    coefs = np.linalg.solve(left, (spread[..., :d, d] / scale)[..., None])[..., 0] / scale
    return np.concatenate([mean[..., -1:] - (coefs * mean[..., 1:d + 1]).sum(axis=-1, keepdims=True), coefs], axis=-1)


def squared_error(moments: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Sum of squared errors of each model over the rows behind its ``moments``."""
    v = np.concatenate([model, np.full((*model.shape[:-1], 1), -1.0)], axis=-1)
    return np.maximum(np.einsum("...i,...ij,...j->...", v, moments, v), 0.0)


def fit_per_key(df: DataFrame, key: str, features: list[str], label: str, fold: Column, alpha: float = 1.0,
                folds: int = 5, min_rows: int = 10) -> DataFrame:
    """``key``, ``n``, ``intercept``, ``coefs``, ``rmse``, ``r2`` (null if the label is
    constant) over the key's rows and ``cv_rmse``, the mean over the folds of
    the error on rows that the model has not seen (null where no fold leaves
    rows outside)."""
    names = [f"_v{i}" for i in range(len(features) + 1)]
    values = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(n) for c, n in zip([*features, label], names)]
    x = df.select(F.col(key).alias("_key"), F.pmod(fold, F.lit(folds)).cast("int").alias("_fold"), *values).dropna(subset=["_key", *names])
    terms = [F.lit(1.0), *[F.col(n) for n in names]]
    size = len(terms)
    width = size * (size + 1) // 2
    sums = [F.sum(terms[i] * terms[j]) for i in range(size) for j in range(i, size)]
    stats = x.groupBy("_key", "_fold").agg(F.array(*sums).alias("sums"))
    per_key = stats.groupBy("_key").agg(F.flatten(F.collect_list("sums")).alias("sums"))  # at most a row a fold
    per_key = per_key.where(F.aggregate(F.sequence(F.lit(0), F.size("sums") - 1, F.lit(width)), F.lit(0.0),
                                        lambda a, i: a + F.get("sums", i)) >= min_rows)
    upper = np.triu_indices(size)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sums = batch.column(1)
            count = np.diff(sums.offsets.to_numpy()) // width  # parts of each key
            first = np.cumsum(count) - count
            own = np.repeat(np.arange(len(count)), count)
            parts = np.zeros((len(own), size, size))
            parts[:, upper[0], upper[1]] = sums.flatten().to_numpy().reshape(-1, width)
            parts += np.swapaxes(np.triu(parts, 1), 1, 2)
            total = np.add.reduceat(parts, first, axis=0)
            model = solve(total, alpha)
            n, sse = total[:, 0, 0], squared_error(total, model)
            sst = total[:, -1, -1] - total[:, 0, -1] ** 2 / n
            varies = sst > 1e-9 * (1 + total[:, -1, -1])
            held = np.flatnonzero(total[own, 0, 0] - parts[:, 0, 0] >= 1)  # parts with rows outside
            error = np.sqrt(squared_error(parts[held], solve(total[own[held]] - parts[held], alpha)) / parts[held, 0, 0])
            folds_of = np.bincount(own[held], minlength=len(count))
            cv = np.bincount(own[held], error, len(count)) / np.maximum(folds_of, 1)
            d = size - 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n.astype(np.int64)), pa.array(model[:, 0]),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(count) + 1) * d, pa.int32()), pa.array(model[:, 1:].ravel())), pa.array(np.sqrt(sse / n)),
                 pa.array(1 - sse / np.where(varies, sst, 1.0), mask=~varies), pa.array(cv, mask=folds_of == 0)],
                names=["_key", "n", "intercept", "coefs", "rmse", "r2", "cv_rmse"])

    kind = df.schema[key].dataType.simpleString()
    return per_key.mapInArrow(run, f"_key {kind}, n long, intercept double, coefs array<double>, rmse double, r2 double, cv_rmse double") \
                  .withColumnRenamed("_key", key)


def score_per_key(df: DataFrame, models: DataFrame, key: str, features: list[str], error: str = "no model") -> tuple[DataFrame, DataFrame]:
    """Rows whose key has a model, with ``prediction``; and the other rows, with ``error``.
    Rows meet their models once, both tables read what was written then."""
    x = df.join(models.select(F.col(key), F.col("intercept").alias("_b"), F.col("coefs").alias("_c")), key, "left")
    value = F.col("_b")
    for i, c in enumerate(features):
        value = value + F.get("_c", F.lit(i)) * F.col(c)
    x = reliable_checkpoint(x.select(*df.columns, value.alias("prediction"), F.col("_b").isNotNull().alias("_has_model")))
    failed = x.where(~F.col("_has_model")).drop("prediction", "_has_model").withColumn("error", F.lit(error))
    return x.where("_has_model").drop("_has_model"), failed
