"""Metrics of labelled scores, in each group of `by`; all from aggregates and bounded windows.

Missing labels and scores are left out. Rank metrics start from counts by distinct score, which keeps ties together;
running sums are taken inside score bins and offset by the totals of the bins below, so that no window holds all rows.
A score's bin depends on the score alone, so nothing is sampled or computed while the plan is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.shared import settled

#: Bins in each octave of scores: 0.5 to 1, 0.25 to 0.5 and so on.
OCTAVE_BINS = 1 << 16


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """a with b's columns, by keys that may be null."""
    if not keys:
        return a.crossJoin(b)
    other = b.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = a[keys[0]].eqNullSafe(other[f"__{keys[0]}"])
    for k in keys[1:]:
        on &= a[k].eqNullSafe(other[f"__{k}"])
    return a.join(other, on).drop(*(f"__{k}" for k in keys))


def score_bin(value: Column) -> Column:
    """A bin that never falls as the value grows: octaves of its size, cut evenly.

    Rounding of the logarithm at the edge of an octave does no harm, since an octave's last bin and the next one's first
    follow each other by either reckoning.
    """
    size = F.abs(value)
    octave = F.floor(F.log2(size))
    within = F.floor((size / F.pow(F.lit(2.0), octave) - 1) * OCTAVE_BINS)
    level = F.when(size == float("inf"), F.lit(1 << 40)).otherwise((octave + 1100) * OCTAVE_BINS + within).cast("long")
    return F.when(F.isnan(value), F.lit(1 << 41)).when(value == 0, F.lit(0)).when(value > 0, level).otherwise(-level).cast("long")


def running(counts: DataFrame, value: str, sums: list[str], by: list[str]) -> DataFrame:
    """counts with x_below (sum over smaller values) and x_all for each x of sums, in each group."""
    binned = counts.withColumn("__bin", score_bin(_d(value)))
    inner = Window.partitionBy(*by, "__bin").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    binned = binned.withColumns({f"__{x}": F.coalesce(F.sum(x).over(inner), F.lit(0)) for x in sums})
    # One row for each group and bin: at most OCTAVE_BINS for each octave that a group's scores span.
    totals = counts.withColumn("__bin", score_bin(_d(value))).groupBy(*by, "__bin").agg(*(F.sum(x).alias(f"__t_{x}") for x in sums))
    over = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = over.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, F.col("__bin").alias("__own"), *(F.coalesce(F.sum(f"__t_{x}").over(before), F.lit(0)).alias(f"__o_{x}") for x in sums), *(F.sum(f"__t_{x}").over(over).alias(f"{x}_all") for x in sums))
    other = totals.withColumnsRenamed({k: f"__{k}" for k in by})
    on = binned["__bin"] == other["__own"]
    for k in by:
        on &= binned[k].eqNullSafe(other[f"__{k}"])
    placed = binned.join(other, on)
    return placed.select(*(binned[c] for c in counts.columns), *((F.col(f"__{x}") + F.col(f"__o_{x}")).alias(f"{x}_below") for x in sums), *(f"{x}_all" for x in sums))


def score_counts(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """by, score, pos, neg (weighted counts of both classes) with their running and full sums."""
    by = by or []
    usable = df.where(F.col(label).isin(0, 1) & F.col(score).isNotNull() & ~F.isnan(score))
    counts = usable.groupBy(*by, F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    return running(counts, "score", ["pos", "neg"], by)


def _d(name: str) -> Column:
    return F.col(name).cast("double")


def _called() -> tuple[Column, Column]:
    """True and false positives if this score or above is called positive."""
    return _d("pos_all") - _d("pos_below"), _d("neg_all") - _d("neg_below")


def _left() -> tuple[Column, Column]:
    """True and false negatives if this score or below is called negative."""
    return _d("neg_below") + _d("neg"), _d("pos_below") + _d("pos")


def auroc(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """estimate (ties count one half), n; null where a class is missing."""
    area = F.sum(_d("pos") * (_d("neg_below") + F.lit(0.5) * _d("neg")))
    return score_counts(df, label, score, by).groupBy(*(by or [])).agg((area / F.nullif(F.max(_d("pos_all")) * F.max(_d("neg_all")), F.lit(0.0))).alias("estimate"), F.sum(F.col("pos") + F.col("neg")).alias("n"))


def auprc(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Average precision over descending distinct thresholds."""
    tp, fp = _called()
    counts = score_counts(df, label, score, by).where("pos_all > 0")
    return counts.groupBy(*(by or [])).agg(F.sum(_d("pos") / _d("pos_all") * tp / (tp + fp)).alias("estimate"), F.sum(F.col("pos") + F.col("neg")).alias("n"))


def ppv_at_sensitivity(df: DataFrame, label: str, score: str, target: float = 0.9, by: list[str] | None = None) -> DataFrame:
    """Precision at the highest threshold that reaches the sensitivity; 0 if none does."""
    tp, fp = _called()
    reached = F.when((tp >= target * _d("pos_all")) & (F.col("pos_all") > 0), F.col("score"))
    return score_counts(df, label, score, by).groupBy(*(by or [])).agg(F.coalesce(F.max_by(tp / (tp + fp), reached), F.lit(0.0)).alias("estimate"), F.sum(F.col("pos") + F.col("neg")).alias("n"))


def npv_at_specificity(df: DataFrame, label: str, score: str, target: float = 0.99, by: list[str] | None = None) -> DataFrame:
    """Share of true negatives at the smallest threshold that reaches the specificity; 0 without negatives."""
    tn, fn = _left()
    reached = F.when((tn >= target * _d("neg_all")) & (F.col("neg_all") > 0), F.col("score"))
    return score_counts(df, label, score, by).groupBy(*(by or [])).agg(F.coalesce(F.min_by(tn / (tn + fn), reached), F.lit(0.0)).alias("estimate"), F.sum(F.col("pos") + F.col("neg")).alias("n"))


def roc_curve(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    tp, fp = _called()
    return score_counts(df, label, score, by).select(*(by or []), "score", (fp / _d("neg_all")).alias("fpr"), (tp / _d("pos_all")).alias("tpr"))


def pr_curve(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    tp, fp = _called()
    prevalence = _d("pos_all") / (_d("pos_all") + _d("neg_all"))
    return score_counts(df, label, score, by).select(*(by or []), "score", (tp / _d("pos_all")).alias("recall"), (tp / (tp + fp)).alias("precision"), prevalence.alias("prevalence"))


def balanced_accuracy(df: DataFrame, label: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Mean recall of the classes that occur."""
    recalls = df.where(F.col(label).isNotNull() & F.col(predicted).isNotNull()).groupBy(*(by or []), label).agg(F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("__r"), F.count("*").alias("__n"))
    return recalls.groupBy(*(by or [])).agg(F.avg("__r").alias("estimate"), F.sum("__n").alias("n"))


def nri(df: DataFrame, label: str, old: str, new: str, threshold: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """Net reclassification: (up - down) / cases + (down - up) / controls; an empty side adds 0."""
    move = (F.col(new) >= threshold).cast("int") - (F.col(old) >= threshold).cast("int")
    side = lambda y, sign: F.coalesce(F.avg(F.when(F.col(label) == y, sign * move.cast("double"))), F.lit(0.0))
    return df.groupBy(*(by or [])).agg((side(1, 1) + side(0, -1)).alias("estimate"), F.count("*").alias("n"))


def incremental_r2(df: DataFrame, y: str, full: str, base: str, by: list[str] | None = None) -> DataFrame:
    """R2 of the full prediction minus R2 of the base prediction; 0 where y doesn't vary."""
    usable = df.where(F.col(y).isNotNull() & F.col(full).isNotNull() & F.col(base).isNotNull())
    error = lambda p: F.sum((_d(y) - _d(p)) * (_d(y) - _d(p)))
    total = F.var_pop(_d(y)) * F.count("*")
    return usable.groupBy(*(by or [])).agg(F.when(total == 0, 0.0).otherwise((error(base) - error(full)) / F.nullif(total, F.lit(0.0))).alias("estimate"), F.count("*").alias("n"))


def brier(df: DataFrame, label: str, prob: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.avg((F.col(prob) - F.col(label)) * (F.col(prob) - F.col(label))).alias("estimate"), F.count(F.col(prob) + F.col(label)).alias("n"))


def pearson(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """0 with fewer than three rows."""
    usable = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    return usable.groupBy(*(by or [])).agg(F.when(F.count("*") < 3, 0.0).otherwise(F.corr(_d(y), _d(p))).alias("estimate"), F.count("*").alias("n"))


def value_ranks(df: DataFrame, value: str, name: str, by: list[str]) -> DataFrame:
    """(by, __v, name): the mean rank of each distinct value in its group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__c"))
    return running(counts, "__v", ["__c"], by).select(*by, "__v", (_d("__c_below") + (_d("__c") + 1) / 2).alias(name))


def average_ranks(df: DataFrame, value: str, name: str, by: list[str] | None = None, of: DataFrame | None = None) -> DataFrame:
    """df with the rank of value in its group; ties share their mean rank. of: rows that df was made of without loss."""
    by = by or []
    return _same(df.withColumn("__v", F.col(value).cast("double")), value_ranks(df if of is None else of, value, name, by), [*by, "__v"]).drop("__v")


def spearman(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    usable = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).select(*(by or []), F.col(y).alias("y"), F.col(p).alias("p"))
    return pearson(average_ranks(average_ranks(usable, "y", "ry", by), "p", "rp", by, usable), "ry", "rp", by)


def regression_errors(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """mae, r_squared (0 if y is constant) and n."""
    usable = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    spread, error = F.var_pop(_d(y)), F.avg((_d(y) - _d(p)) * (_d(y) - _d(p)))
    return usable.groupBy(*(by or [])).agg(F.avg(F.abs(_d(y) - _d(p))).alias("mae"), F.when(spread == 0, 0.0).otherwise(1 - error / F.nullif(spread, F.lit(0.0))).alias("r_squared"), F.count("*").alias("n"))


def direction_accuracy(df: DataFrame, true: str, predicted: str, by: list[str] | None = None, keep_zeros: bool = False, z: float = 1.96) -> DataFrame:
    """Share of equal signs with its Wilson interval; rows of true effect 0 are left out unless keep_zeros; none gives 0.5.

    One definition keeps zeros and has this interval; the other leaves them out and has a bootstrap interval (see
    bootstrap.direction_interval)."""
    usable = df.where(F.col(true).isNotNull() & F.col(predicted).isNotNull() & (F.lit(keep_zeros) | (F.col(true) != 0)))
    rows = usable.groupBy(*(by or [])).agg(F.coalesce(F.avg((F.signum(_d(true)) == F.signum(_d(predicted))).cast("double")), F.lit(0.5)).alias("estimate"), F.count("*").alias("n"))
    p, n = F.col("estimate"), F.greatest(F.col("n"), F.lit(1)).cast("double")
    centre, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return rows.withColumns({"ci_lower": F.greatest(F.lit(0.0), centre - half), "ci_upper": F.least(F.lit(1.0), centre + half)})


def by_group_and_whole(df: DataFrame, metric, group: str, label: str, score: str, least: int = 30, whole: str = "ALL") -> DataFrame:
    """metric in each group and over all rows; a group with fewer rows than least keeps n but has no estimate."""
    both = df.select(label, score, F.explode(F.array(F.coalesce(F.col(group), F.lit("UNKNOWN")), F.lit(whole))).alias(group))
    return metric(both, label, score, [group]).withColumn("estimate", F.when((F.col("n") >= least) | (F.col(group) == whole), F.col("estimate")))


def portability(metrics: DataFrame, group: str = "ancestry", reference: str = "EUR") -> DataFrame:
    """Each group's estimate over the reference's; 0 where that is 0."""
    base = F.max(F.when(F.col(group) == reference, F.col("estimate"))).over(Window.partitionBy(F.lit(0)))
    return metrics.withColumn("ratio", F.when(base == 0, 0.0).otherwise(F.col("estimate") / F.nullif(base, F.lit(0.0))))


def ceiling_normalised(metrics: DataFrame, ceilings: DataFrame, on: list[str], impossible: str = "null") -> DataFrame:
    """estimate over its ceiling. impossible: what a ceiling that isn't positive gives: "null", "zero", or "error" when
    the row is computed. A missing ceiling gives null."""
    ratio = F.when(F.col("ceiling") > 0, F.col("estimate") / F.nullif(F.col("ceiling"), F.lit(0.0)))
    if impossible != "null":
        other = F.lit(0.0) if impossible == "zero" else F.raise_error(F.lit("a ceiling must be positive")).cast("double")
        ratio = F.when(F.col("ceiling") <= 0, other).otherwise(ratio)
    return metrics.join(ceilings, on, "left").withColumn("normalised", ratio)


def first_ceiling(metrics: DataFrame, ceilings: DataFrame, by: list[str], order: str = "ordinal") -> DataFrame:
    """(by, metric, estimate, ceiling, normalised) of each group's first metric that has an estimate; ceilings: (by, ceiling)."""
    usable = metrics.where(F.col("estimate").isNotNull() & ~F.isnan("estimate"))
    first = usable.groupBy(*by).agg(F.min_by(F.struct("metric", "estimate"), order).alias("f"))
    return ceiling_normalised(first.select(*by, "f.metric", "f.estimate"), ceilings, by)


def imputed(df: DataFrame, score: str, value: float = 0.5) -> DataFrame:
    """Missing scores as `value`, for a metric over all rows instead of the scored ones."""
    return df.withColumn(score, F.when(F.col(score).isNull() | F.isnan(score), value).otherwise(F.col(score)))


def is_binary(df: DataFrame, label: str) -> DataFrame:
    """One row (binary): whether every label that is there is 0 or 1, and there is one."""
    return df.where(F.col(label).isNotNull()).agg(((F.count("*") > 0) & F.coalesce(F.bool_and(F.col(label).isin(0, 1)), F.lit(False))).alias("binary"))


def quantiles(df: DataFrame, value: str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """(by, a column for each share by name): exact quantiles, interpolated between neighbours, of values that are there.

    Distinct values get their places from running counts, and a quantile is read where its place falls, so no buffer holds
    a group's values. NaN sorts last. A group without values isn't there; without `by` there is one row.
    """
    by = by or []
    rows = df.where(F.col(value).isNotNull()).groupBy(*by, _d(value).alias("__v")).agg(F.count("*").alias("__c"))
    placed = running(rows, "__v", ["__c"], by)
    at = {k: (F.col("__c_all") - 1) * F.lit(float(p)) for k, p in shares.items()}
    holds = lambda place: (F.col("__c_below") <= place) & (place < F.col("__c_below") + F.col("__c"))
    ends = [(F.max(F.when(holds(F.floor(x)), F.col("__v"))), F.max(F.when(holds(F.ceil(x)), F.col("__v"))), F.max(x - F.floor(x))) for x in at.values()]
    found = placed.groupBy(*by).agg(*(c.alias(f"__{k}{i}") for k, three in zip(shares, ends) for i, c in enumerate(three)))
    low, high, part = (lambda k, i=i: F.col(f"__{k}{i}") for i in range(3))
    return found.select(*by, *(F.when(low(k) == high(k), low(k)).otherwise((1 - part(k)) * low(k) + part(k) * high(k)).alias(k) for k in shares))


def residual_summary(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """median, mae and n of the residuals prediction - truth."""
    by = by or []
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).withColumn("__r", _d(p) - _d(y))
    sums = rows.groupBy(*by).agg(F.avg(F.abs("__r")).alias("mae"), F.count("*").alias("n"))
    return _same(sums, quantiles(rows, "__r", {"median": 0.5}, by), by).select(*by, "median", "mae", "n")


def equal_bins(df: DataFrame, value: str, bins: int = 50, by: list[str] | None = None) -> DataFrame:
    """(by, bin, least, n): counts in equal bins between the least and the greatest value of a group; the last bin holds the right edge."""
    by = by or []
    rows = df.where(F.col(value).isNotNull()).select(*by, _d(value).alias("__v"))
    ends = rows.groupBy(*by).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col("__v") - F.col("__lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))).otherwise(F.lit(0).cast("long"))
    placed = _same(rows, ends, by).withColumns({"bin": at, "least": F.col("__lo") + at * width})
    return placed.groupBy(*by, "bin", "least").agg(F.count("*").alias("n"))


def histogram(df: DataFrame, value: str, by: list[str], bins: int = 49) -> DataFrame:
    """(by, bin, n, density) over equal bins of [0, 1]; the right edge is inside."""
    counts = df.where(F.col(value).between(0, 1)).groupBy(*by, F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))
    return counts.withColumn("density", _d("n") * bins / F.sum("n").over(Window.partitionBy(*by)))


def calibration_bins(df: DataFrame, label: str, prob: str, bins: int = 10, by: list[str] | None = None) -> DataFrame:
    slot = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1)).alias("bin")
    return df.where(F.col(prob).isNotNull() & F.col(label).isNotNull()).groupBy(*(by or []), slot).agg(F.avg(prob).alias("mean_predicted"), F.avg(_d(label)).alias("observed"), F.count("*").alias("n"))


def coverage(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """total, scored, coverage, pos, neg."""
    has = F.col(score).isNotNull()
    return df.groupBy(*(by or [])).agg(F.count("*").alias("total"), F.count_if(has).alias("scored"), (F.count_if(has).cast("double") / F.count("*")).alias("coverage"), F.count_if(has & (F.col(label) == 1)).alias("pos"), F.count_if(has & (F.col(label) == 0)).alias("neg"))


def summary(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """mean, median, least, p25, p75, most of a column of estimates, with 1.96 standard errors."""
    by, v = by or [], _d(value)
    rows = df.where(F.col(value).isNotNull())
    sums = rows.groupBy(*by).agg(F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), (F.lit(1.96) * F.stddev_pop(v) / F.sqrt(F.nullif(F.count("*"), F.lit(0)))).alias("half_width"), F.count("*").alias("n"))
    both = _same(sums, quantiles(rows, value, {"median": 0.5, "p25": 0.25, "p75": 0.75}, by), by)
    return both.select(*by, "mean", "median", "least", "p25", "p75", "most", "half_width", "n")


def least_squares_line(df: DataFrame, y: str, x: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.regr_slope(_d(y), _d(x)).alias("slope"), F.regr_intercept(_d(y), _d(x)).alias("intercept"))


def calibration_lines(df: DataFrame, label: str, prob: str, by: list[str] | None = None, rounds: int = 50, tolerance: float = 1e-10) -> DataFrame:
    """(by, slope, intercept, n, converged) of an unpenalised logistic regression on the logit, in each group.

    Newton's method for all groups at once: a round is one aggregate over the rows of groups that still move, joined with a
    row of state for each; a step that makes a group's loss worse, by more than its sum's rounding, is halved, and the last
    step, within the tolerance, is taken too. Rows with equal probabilities are counted
    first. A group that lacks a class, or a second probability, has no line (null); where the classes separate, the line
    has no end and converged is false.
    """
    from helixframe.functions.variants import logit

    by = by or []
    group = F.to_json(F.struct(*by)) if by else F.lit("{}")
    usable = df.where(F.col(prob).isNotNull() & ~F.isnan(_d(prob)) & F.col(label).isin(0, 1))
    groups = usable.groupBy(*by, group.alias("__g")).agg(F.count("*").alias("n"))
    rows = settled(usable.groupBy(group.alias("__g"), logit(_d(prob)).alias("x")).agg(F.count("*").alias("w"), F.count_if(F.col(label) == 1).alias("p")))
    d = lambda c: F.col(c)
    start = rows.groupBy("__g").agg((F.count_distinct("x") > 1).alias("two"), (F.sum("p") > 0).alias("pos"), (F.sum("p") < F.sum("w")).alias("neg")).where("two AND pos AND neg")
    kinds = {"a": 0.0, "b": 1.0, "da": 0.0, "db": 0.0, "loss": float("inf")}
    # (a, b) is the line that stands, (da, db) the step from it that is tried next.
    state = settled(start.select("__g", *(F.lit(v).alias(k) for k, v in kinds.items())))
    done = []
    for _ in range(rounds):
        left = state.count()
        if not left:
            break
        at = rows.join(F.broadcast(state) if left <= 100_000 else state, "__g")
        z = (d("a") + d("da")) + (d("b") + d("db")) * d("x")
        p = 1 / (1 + F.exp(-z))
        w, e = d("w") * p * (1 - p), d("p") - d("w") * p
        loss = d("w") * (F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))) - d("p") * z
        sums = at.groupBy("__g", *(F.col(c) for c in kinds)).agg(F.sum(loss).alias("l"), F.sum(e).alias("g0"), F.sum(e * d("x")).alias("g1"), F.sum(w).alias("h0"), F.sum(w * d("x")).alias("h1"), F.sum(w * d("x") * d("x")).alias("h2"), F.sum("w").alias("rows"))
        det = F.nullif(d("h0") * d("h2") - d("h1") * d("h1"), F.lit(0.0))
        # Near the bottom a step changes the loss by less than the rounding of its sum: Newton's steps are right there.
        better = d("l") <= d("loss") + 1e-11 * F.abs("l")
        worse = ~better & (F.abs("da") + F.abs("db") > tolerance)
        a, b = F.when(better, d("a") + d("da")).otherwise(d("a")), F.when(better, d("b") + d("db")).otherwise(d("b"))
        newton = {"da": (d("h2") * d("g0") - d("h1") * d("g1")) / det, "db": (d("h0") * d("g1") - d("h1") * d("g0")) / det}
        step = {k: F.when(worse, d(k) / 2).otherwise(F.coalesce(v, F.lit(0.0))) for k, v in newton.items()}
        flat = ~worse & (det.isNull() | (d("l") <= 1e-8 * d("rows")))  # only where the classes separate
        stop = ~flat & ~worse & (~better | (F.abs(step["da"]) + F.abs(step["db"]) <= tolerance * (1 + F.abs(a) + F.abs(b))))
        end = {k: F.when(stop & better, v + step[f"d{k}"]).otherwise(v).alias(k) for k, v in {"a": a, "b": b}.items()}
        moved = settled(sums.select("__g", end["a"], end["b"], step["da"].alias("da"), step["db"].alias("db"), F.when(better, d("l")).otherwise(d("loss")).alias("loss"), stop.alias("stop"), flat.alias("flat")))
        done.append(moved.where("stop OR flat").select("__g", "a", "b", (~d("flat")).alias("converged")))
        state = moved.where("NOT stop AND NOT flat").drop("stop", "flat")
    done.append(state.select("__g", "a", "b", F.lit(False).alias("converged")))
    lines = done[0]
    for more in done[1:]:
        lines = lines.unionByName(more)
    return groups.join(lines, "__g", "left").select(*by, F.col("b").alias("slope"), F.col("a").alias("intercept"), "n", F.coalesce("converged", F.lit(False)).alias("converged"))


def calibration_line(df: DataFrame, label: str, prob: str, rounds: int = 50) -> tuple[float | None, float | None]:
    """(slope, intercept) over all rows."""
    found = calibration_lines(df, label, prob, rounds=rounds).collect()  # one row at most
    return (found[0]["slope"], found[0]["intercept"]) if found else (None, None)
