"""Models: baselines, any callable as a scorer, and fits that Spark's own library makes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.variants import hash_uniform


def null_scores(df: DataFrame, ident: str, seed: int = 42) -> DataFrame:
    """A uniform score that depends on the id alone."""
    return df.withColumn("null_score", hash_uniform(F.col(ident), F.lit(seed)))


def mean_scores(df: DataFrame, label: str) -> DataFrame:
    """The mean training label for every row; 0.5 without any. df has split."""
    mean = df.where("split = 'train'").agg(F.coalesce(F.avg(F.col(label).cast("double")), F.lit(0.5)).alias("mean_score"))
    return df.crossJoin(F.broadcast(mean))  # one row


def with_predictions(df: DataFrame, predict: Callable[[pd.DataFrame], pd.Series], inputs: list[str], name: str = "prediction") -> DataFrame:
    """df with predict applied to batches of its input columns; one value for each row, or an error."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            frame = pd.concat(columns if isinstance(columns, tuple) else (columns,), axis=1, keys=inputs)
            out = pd.Series(predict(frame))
            if len(out) != len(frame):
                raise ValueError(f"{len(out)} predictions for {len(frame)} rows")
            yield out.astype(float)

    return df.withColumn(name, run(*inputs))


def run_models(df: DataFrame, predictors: dict[str, Callable[[pd.DataFrame], pd.Series]], inputs: list[str], keep: list[str]) -> DataFrame:
    """(keep, model, score, error): every model on every row, in one pass over df.

    A model that raises on a batch, or gives another number of values, has null scores there with the error's text; the
    other models and batches go on. keep and inputs are columns of df; null inputs are passed as they are.
    """
    names = list(dict.fromkeys([*keep, *inputs]))
    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for name, predict in predictors.items():
                out = frame[keep].copy()
                try:
                    found = pd.Series(predict(frame[inputs].copy()))
                    if len(found) != len(frame):
                        raise ValueError(f"{len(found)} predictions for {len(frame)} rows")
                    scores, error = found.astype(float).to_numpy(), None
                except Exception as e:  # recorded beside the rows that it concerns
                    scores, error = [None] * len(frame), f"{type(e).__name__}: {e}"
                yield out.assign(model=name, score=pd.Series(scores, index=out.index, dtype="float64"), error=error)

    found = df.select(*names).mapInPandas(run, f"{kept}{', ' if keep else ''}model string, score double, error string")
    return found.withColumn("score", F.when(F.isnan("score"), None).otherwise(F.col("score")))


def model_failures(scored: DataFrame) -> DataFrame:
    """(model, n, n_failed, error) of run_models: how many rows failed, and the least of the errors."""
    return scored.groupBy("model").agg(F.count("*").alias("n"), F.count("error").alias("n_failed"), F.min("error").alias("error"))


def long_scores(df: DataFrame, keep: list[str], scores: dict[str, Column]) -> DataFrame:
    """One row for each model: keep, model, score."""
    entries = F.array(*(F.struct(F.lit(k).alias("model"), v.cast("double").alias("score")) for k, v in scores.items()))
    return df.select(*keep, F.explode(entries).alias("e")).select(*keep, "e.model", "e.score")


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="skip").transform(df)


def ridge(df: DataFrame, label: str, features: list[str], alpha: float = 1.0):
    """Least squares with alpha times the squared weights. Spark's penalty is per row and divided by the label's deviation."""
    rows = _assembled(df, features)
    n, deviation = rows.agg(F.count(label), F.stddev_pop(label)).first()
    return LinearRegression(featuresCol="__x", labelCol=label, predictionCol="prediction", regParam=alpha / max(1, n) * (deviation or 1.0), standardization=False, solver="normal").fit(rows)


def elastic_net(df: DataFrame, label: str, features: list[str], alpha: float = 0.1, l1_ratio: float = 0.5, rounds: int = 5000):
    """Half the mean squared error plus alpha times l1_ratio |w| + (1 - l1_ratio) / 2 w^2; Spark divides the second part by the label's deviation."""
    rows = _assembled(df, features)
    deviation = rows.agg(F.stddev_samp(label)).first()[0] or 1.0
    one, two = alpha * l1_ratio / deviation, alpha * (1 - l1_ratio)
    return LinearRegression(featuresCol="__x", labelCol=label, predictionCol="prediction", regParam=(one + two) * deviation, elasticNetParam=one / (one + two) if alpha else 0.0, standardization=False, maxIter=rounds).fit(rows)


def predict(model, df: DataFrame, features: list[str]) -> DataFrame:
    return model.transform(_assembled(df, features)).drop("__x")


def incremental_r2(df: DataFrame, label: str, score: str, covariates: list[str]) -> float:
    """R2 with the score and covariates minus R2 with the covariates alone, by ordinary least squares."""
    rows = df.dropna(subset=[label, score, *covariates])
    fit = lambda features: LinearRegression(featuresCol="__x", labelCol=label, regParam=0.0).fit(VectorAssembler(inputCols=features, outputCol="__x").transform(rows)).summary.r2
    return fit([*covariates, score]) - fit(covariates)


def residuals(df: DataFrame, label: str, covariates: list[str]) -> DataFrame:
    """df with residual: the label less its least-squares fit on the covariates."""
    model = ridge(df.dropna(subset=[label, *covariates]), label, covariates, 0.0)
    return predict(model, df, covariates).withColumn("residual", F.col(label) - F.col("prediction")).drop("prediction")


def principal_components(panel: DataFrame, samples: DataFrame, features: list[str], k: int) -> DataFrame:
    """samples with pc, their place on the panel's first k components; both standardised as the panel."""
    join = VectorAssembler(inputCols=features, outputCol="__raw", handleInvalid="skip")
    scaler = StandardScaler(withMean=True, withStd=True, inputCol="__raw", outputCol="__x").fit(join.transform(panel))
    pca = PCA(k=k, inputCol="__x", outputCol="pc").fit(scaler.transform(join.transform(panel)))
    return pca.transform(scaler.transform(join.transform(samples))).drop("__raw", "__x")
