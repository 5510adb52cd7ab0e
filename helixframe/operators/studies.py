"""Accuracy of calls, correlations in tissues, effects by confidence, and adjustments of cohort studies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.operators import metrics


def diplotype(text: Column) -> Column:
    """The two haplotypes of a diplotype, whichever way round they are written."""
    return F.array_sort(F.split(text, "/"))


def diplotype_accuracy(truth: DataFrame, calls: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """(by, exact, phenotype_match, n) over the rows of truth; a missing call is wrong. Both have diplotype and phenotype."""
    t = truth.select(*keys, *(c for c in by if c not in keys), diplotype(F.col("diplotype")).alias("__td"), F.col("phenotype").alias("__tp"))
    c = calls.select(*keys, diplotype(F.col("diplotype")).alias("__cd"), F.col("phenotype").alias("__cp"))
    right = lambda a, b: F.avg(F.coalesce(F.col(a) == F.col(b), F.lit(False)).cast("double"))
    return t.join(c, keys, "left").groupBy(*by).agg(right("__td", "__cd").alias("exact"), right("__tp", "__cp").alias("phenotype_match"), F.count("*").alias("n"))


def tissue_correlations(df: DataFrame, y: str, p: str, gene: str = "gene", tissue: str = "tissue", least: float = 0.1) -> DataFrame:
    """(tissue, mean_r, share_above, n_loci): Pearson r across individuals by gene and tissue, and how many exceed `least`."""
    found = metrics.pearson(df, y, p, [gene, tissue])
    return found.groupBy(tissue).agg(F.avg("estimate").alias("mean_r"), F.avg((F.col("estimate") > least).cast("double")).alias("share_above"), F.count("*").alias("n_loci"))


def direction_by_confidence(df: DataFrame, true: str, predicted: str, confidence: str, thresholds: tuple[float, ...] = (0.9, 0.5)) -> DataFrame:
    """Direction accuracy of the rows above each threshold; a row counts under every threshold that it exceeds."""
    passed = F.filter(F.array(*(F.lit(float(t)) for t in thresholds)), lambda t: F.col(confidence) > t)
    return metrics.direction_accuracy(df.withColumn("threshold", F.explode(passed)), true, predicted, ["threshold"])


def quartile_performance(estimates: DataFrame, value: str = "estimate") -> DataFrame:
    """One row (bottom, top): means of the estimates up to the first and from the third quartile."""
    cut = estimates.agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.75)))).scalar()
    marked = estimates.select(F.col(value).alias("v"), cut.alias("cut"))
    return marked.agg(F.avg(F.when(F.col("v") <= F.col("cut")[0], F.col("v"))).alias("bottom"), F.avg(F.when(F.col("v") >= F.col("cut")[1], F.col("v"))).alias("top"))


def medication_adjusted(df: DataFrame, value: str, treated: Column, shift: float, exclude: bool = False) -> DataFrame:
    """Adds `shift` to the values of treated rows, or leaves these rows out; unknown treatment counts as none."""
    taken = F.coalesce(treated, F.lit(False))
    return df.where(~taken) if exclude else df.withColumn(value, F.col(value) + F.when(taken, float(shift)).otherwise(0.0))


def drop_from(estimates: DataFrame, group: str = "ancestry", reference: str = "EUR") -> DataFrame:
    """Adds drop: the reference group's estimate less the row's; null without either."""
    base = estimates.where(F.col(group) == reference).agg(F.max("estimate")).scalar()
    return estimates.withColumn("drop", base - F.col("estimate"))


def improvement(drops: DataFrame, other: DataFrame, group: str = "ancestry") -> DataFrame:
    """(group, ratio): how much smaller another method's drop is, (drop - other's drop) / drop; null where there is no drop."""
    both = drops.select(group, "drop").join(other.select(group, F.col("drop").alias("__d")), group)
    return both.select(group, ((F.col("drop") - F.col("__d")) / F.nullif(F.col("drop"), F.lit(0.0))).alias("ratio"))


def scores_without(genotypes: DataFrame, weights: DataFrame, dominant: Column, sample: str = "sample_id", variant: str = "variant_id") -> DataFrame:
    """(sample, score, score_without): sums of dosage times weight over all variants and over those not in a dominant locus."""
    part = F.col("dosage") * F.col("weight")
    joined = genotypes.select(sample, variant, "dosage").join(weights.select(variant, "weight", F.coalesce(dominant, F.lit(False)).alias("__in")), variant)
    return joined.groupBy(sample).agg(F.sum(part).alias("score"), F.coalesce(F.sum(F.when(~F.col("__in"), part)), F.lit(0.0)).alias("score_without"))
