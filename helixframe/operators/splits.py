"""Train and test splits, seeded samples, and leakage checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.variants import draw_order, with_chr
from helixframe.operators.metrics import _same

KING = 0.0442


def temporal(df: DataFrame, date: str, cutoff) -> DataFrame:
    """split: train up to the cutoff, test after it; null dates in neither."""
    return df.withColumn("split", F.when(F.col(date) <= F.lit(cutoff), "train").when(F.col(date) > F.lit(cutoff), "test"))


def by_chromosome(df: DataFrame, chrom: str = "chrom", holdout: tuple[str, ...] = ("chr8", "chr21")) -> DataFrame:
    return df.withColumn("split", F.when(with_chr(F.col(chrom)).isin(*(c if c.startswith("chr") else f"chr{c}" for c in holdout)), "test").otherwise("train"))


def ensure_test(df: DataFrame) -> DataFrame:
    """df, or an error if its test part is empty."""
    if df.where("split = 'test'").isEmpty():
        raise ValueError("the test split is empty")
    return df


def individuals(df: DataFrame, ident: str, group: str, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 42) -> DataFrame:
    """split within each group (null: UNKNOWN) in seeded random order; shares are cut down, the rest is test."""
    if abs(sum(ratios) - 1) > 1e-6:
        raise ValueError("ratios must sum to 1")
    rows = ranked(df.withColumn("__g", F.coalesce(F.col(group), F.lit("UNKNOWN"))), ["__g"], draw_order(F.col(ident), seed), [ident])
    first, at = F.floor(F.col("__n") * F.lit(ratios[0])), F.col("__at")
    split = F.when(at <= first, "train").when(at <= first + F.floor(F.col("__n") * F.lit(ratios[1])), "val").otherwise("test")
    return rows.withColumn("split", split).drop("__g", "__at", "__n")


def ranked(df: DataFrame, by: list[str], digest: Column, ties: list[str], most: Column | int | None = None) -> DataFrame:
    """df with __at, the place from 1 in its group by a hexadecimal digest and then `ties`, and __n, the group's rows.

    The digest's first four digits deal a group to 65,536 bins, which follow each other as the digests do; rows are ordered
    inside a bin and moved by the counts of the bins before it, so that no window holds a group. most: places that are
    wanted (a number or a column); bins beyond are left out before anything is ordered.
    """
    rows = df.withColumn("__digest", digest).withColumn("__bin", F.conv(F.substring("__digest", 1, 4), 16, 10).cast("int"))
    over = Window.partitionBy(*(by or [F.lit(0)]))
    bins = rows.groupBy(*by, "__bin").agg(F.count("*").alias("__rows"))
    before = F.coalesce(F.sum("__rows").over(over.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = bins.select(*by, "__bin", before.alias("__before"), F.sum("__rows").over(over).alias("__n"))
    placed = _same(rows, bins, [*by, "__bin"])
    if most is not None:
        placed = placed.where(F.col("__before") < most)
    inside = F.row_number().over(Window.partitionBy(*by, "__bin").orderBy("__digest", *ties))
    placed = placed.withColumn("__at", inside + F.col("__before")).drop("__digest", "__bin", "__before")
    return placed if most is None else placed.where(F.col("__at") <= most)


def zero_shot(df: DataFrame) -> DataFrame:
    """Everything is test."""
    return df.withColumn("split", F.lit("test"))


def _related(split: DataFrame, ident: str, kinship: DataFrame, threshold: float, moving: str, held: tuple[str, ...]) -> DataFrame:
    """Ids of the split `moving` that are related to one of the splits `held`."""
    pairs = kinship.where(F.col("kinship") > threshold)
    both = pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).unionByName(pairs.select(F.col("id_b").alias("a"), F.col("id_a").alias("b")))
    own, other = split.where(F.col("split") == moving).select(F.col(ident).alias("a")), split.where(F.col("split").isin(*held)).select(F.col(ident).alias("b"))
    return both.join(own, "a", "left_semi").join(other, "b", "left_semi").select(F.col("a").alias(ident)).distinct()


def repair_related(split: DataFrame, ident: str, kinship: DataFrame, threshold: float = KING) -> DataFrame:
    """Moves test ids related to train or val into train, then val ids related to the larger train."""
    for moving, held in (("test", ("train", "val")), ("val", ("train",))):
        found = _related(split, ident, kinship, threshold, moving, held).withColumn("__moved", F.lit(True))
        split = split.join(found, ident, "left").withColumn("split", F.when(F.col("__moved"), "train").otherwise(F.col("split"))).drop("__moved")
    return split


def _repeat_digest(ident: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.col(ident).cast("string"), F.col("repeat").cast("string"), F.lit(str(seed))))


def leave_n_out(df: DataFrame, ident: str, n_out: int, repeats: int = 10, seed: int = 42) -> DataFrame:
    """(ident, repeat) of those held out in each repeat; an error unless n_out is less than the number of ids."""
    if df.select(ident).distinct().limit(n_out + 1).count() <= n_out:
        raise ValueError(f"cannot hold {n_out} out of so few")
    each = df.select(ident).distinct().withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    return ranked(each, ["repeat"], _repeat_digest(ident, seed), [ident], n_out).drop("__at", "__n")


def leave_one_out_means(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """df with `expected`, the mean of value over the other rows of the group: leave-one-out prediction by the mean, without
    a fold for each row. Null for a group's only value; rows without value have the mean of all."""
    by = by or []
    x = F.col(value).cast("double")
    sums = df.groupBy(*by).agg(F.sum(x).alias("__sum"), F.count(x).alias("__n"))
    joined = _same(df, sums, by)
    own = x.isNotNull().cast("int")
    return joined.withColumn("expected", (F.col("__sum") - F.coalesce(x, F.lit(0.0))) / F.nullif(F.col("__n") - own, F.lit(0))).drop("__sum", "__n")


def stratified_quotas(groups: DataFrame, group: str, n_out: int) -> DataFrame:
    """groups (group, n) with quota: half-even rounded shares, at most n; a surplus goes to the largest groups, a deficit
    comes from the smallest with a quota. One row for each group."""
    whole = Window.partitionBy(F.lit(0))
    q = groups.withColumn("quota", F.least(F.col("n"), F.bround(F.col("n").cast("double") / F.sum("n").over(whole) * n_out).cast("long")))
    q = q.withColumn("left", F.lit(n_out) - F.sum("quota").over(whole))
    room = F.col("n") - F.col("quota")
    up = F.coalesce(F.sum(room).over(whole.orderBy(F.col("n").desc(), group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    down = F.coalesce(F.sum("quota").over(whole.orderBy("n", group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    more = F.when(F.col("left") > 0, F.greatest(F.lit(0), F.least(room, F.col("left") - up))).otherwise(-F.greatest(F.lit(0), F.least(F.col("quota"), -F.col("left") - down)))
    return q.withColumns({"__up": up, "__down": down}).withColumn("quota", F.col("quota") + more).select(group, "n", "quota")


def stratified_leave_n_out(df: DataFrame, ident: str, group: str, n_out: int, repeats: int = 10, seed: int = 42) -> DataFrame:
    """(ident, group, repeat) held out, with each group's quota."""
    ids = df.select(ident, group).distinct()
    quotas = stratified_quotas(ids.groupBy(group).agg(F.count("*").alias("n")), group, n_out)
    each = ids.join(quotas, group).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    return ranked(each, [group, "repeat"], _repeat_digest(ident, seed), [ident], F.col("quota")).select(ident, group, "repeat")


def balanced_by_group(df: DataFrame, ident: str, group: str, label: str, least: int = 5, seed: int = 42) -> DataFrame:
    """As many of either label in each group that has at least `least` of both, in seeded random order."""
    rows = df.where(F.col(label).isin(0, 1))
    counts = rows.groupBy(group).agg(F.count_if(F.col(label) == 1).alias("__p"), F.count_if(F.col(label) == 0).alias("__b"))
    kept = rows.join(counts.where((F.col("__p") >= least) & (F.col("__b") >= least)), group)
    return ranked(kept, [group, label], draw_order(F.col(ident), seed), [ident], F.least("__p", "__b")).drop("__at", "__n", "__p", "__b")


def ensure_any(df: DataFrame, what: str = "no group has enough of both labels") -> DataFrame:
    """df, or an error if it is empty."""
    if df.isEmpty():
        raise ValueError(what)
    return df


def seeded_sample(df: DataFrame, ident: str, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(draw_order(F.col(ident), seed), ident).limit(n)


def unrelated(df: DataFrame, ident: str, kinship: DataFrame, threshold: float = KING) -> DataFrame:
    """Without the larger id of each related pair."""
    drop = kinship.where(F.col("kinship") > threshold).select(F.greatest("id_a", "id_b").alias(ident)).distinct()
    return df.join(drop, ident, "left_anti")


# Checks: one row (check, passed, violations) each.


def _check(rows: DataFrame, name: str, violations: Column) -> DataFrame:
    return rows.agg(violations.cast("long").alias("violations")).select(F.lit(name).alias("check"), (F.col("violations") == 0).alias("passed"), "violations")


def check_relatedness(split: DataFrame, ident: str, kinship: DataFrame, threshold: float = KING) -> DataFrame:
    """Related pairs that span two splits."""
    side = lambda c: split.select(F.col(ident).alias(c), F.col("split").alias(f"split_{c}"))
    pairs = kinship.where(F.col("kinship") > threshold).join(side("id_a"), "id_a").join(side("id_b"), "id_b")
    return _check(pairs, "relatedness", F.count_if(F.col("split_id_a") != F.col("split_id_b")))


def missing_input(rows: DataFrame, name: str, passed: bool) -> DataFrame:
    """The row of a check that lacks its input: relatedness without ids, labels and cohorts pass, all others fail."""
    return rows.sparkSession.createDataFrame([(name, passed, 0 if passed else 1)], "check string, passed boolean, violations long")


def check_temporal_by_id(test: DataFrame, dates: DataFrame, ident: str, date: str, cutoff) -> DataFrame:
    """Test ids whose own date lies before the cutoff; ids without a date don't count."""
    found = test.select(ident).distinct().join(dates.where(F.col(date).isNotNull()).groupBy(ident).agg(F.min(date).alias("__d")), ident)
    return _check(found, "temporal_by_id", F.count_if(F.col("__d") < F.lit(cutoff)))


def check_temporal(split: DataFrame, date: str, cutoff) -> DataFrame:
    late, early = (F.col("split") == "train") & (F.col(date) > F.lit(cutoff)), (F.col("split") == "test") & (F.col(date) <= F.lit(cutoff))
    return _check(split, "temporal", F.count_if(late | early))


def check_overlap(split: DataFrame, value: str, name: str) -> DataFrame:
    """Values that occur in train and in test: chromosomes, labels, ids."""
    sides = split.groupBy(value).agg(F.bool_or(F.col("split") == "train").alias("a"), F.bool_or(F.col("split") == "test").alias("b"))
    return _check(sides.where(F.col(value).isNotNull()), name, F.count_if(F.col("a") & F.col("b")))


def check_cohort(split: DataFrame, ident: str, cohort: DataFrame) -> DataFrame:
    """Test ids that were in the cohort behind the summary statistics."""
    found = split.where("split = 'test'").select(ident).distinct().join(cohort.select(ident), ident, "left_semi")
    return _check(found, "cohort", F.count("*"))


def check_batch(split: DataFrame, batch: str) -> DataFrame:
    """Test in one batch only, while there are several."""
    alone = (F.count_distinct(F.when(F.col("split") == "test", F.col(batch))) == 1) & (F.count_distinct(batch) > 1)
    return _check(split, "batch", alone.cast("int"))


def check_population_source(rows: DataFrame, source: str) -> DataFrame:
    from helixframe.functions.variants import population_source_passes

    return _check(rows, "population_source", F.count_if(~population_source_passes(F.col(source))))


def report(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


#: The checks by name; a check without its inputs passes or fails as told.
PASSES_WITHOUT_INPUT = {"relatedness": True, "temporal": False, "chromosome": False, "label": True, "population": True, "summary_stat": True}


def named_checks(split: DataFrame, ident: str = "id", kinship: DataFrame | None = None, date: str | None = None, cutoff=None, chrom: str | None = None, label: str | None = None, source: str | None = None, cohort: DataFrame | None = None, threshold: float = KING) -> dict[str, DataFrame]:
    """The checks that have their inputs: columns of split (with split), a kinship table, a cohort."""
    made = {}
    if kinship is not None:
        made["relatedness"] = check_relatedness(split, ident, kinship, threshold)
    if date is not None and cutoff is not None:
        made["temporal"] = check_temporal(split, date, cutoff)
    if chrom is not None:
        made["chromosome"] = check_overlap(split, chrom, "chromosome")
    if label is not None:
        made["label"] = check_overlap(split, label, "label")
    if source is not None:
        made["population"] = check_population_source(split, source)
    if cohort is not None:
        made["summary_stat"] = check_cohort(split, ident, cohort)
    return made


def run_checks(names: list[str], split: DataFrame, ident: str | None = "id", **inputs) -> DataFrame:
    """A row for each named check. An unknown name is a row that fails. Without inputs the rule of the check holds;
    relatedness with ids but without kinship fails."""
    made = named_checks(split, ident or "id", **inputs)
    rows = []
    for name in names:
        if name in made:
            rows.append(made[name].withColumn("check", F.lit(name)))
        else:
            passed = PASSES_WITHOUT_INPUT.get(name, False) and not (name == "relatedness" and ident is not None)
            rows.append(missing_input(split, name, passed))
    return report(rows)


def verify(checks: list[DataFrame]) -> DataFrame:
    """The report, or an error that names the checks that fail."""
    rows = report(checks)
    failed = [r["check"] for r in rows.where("NOT passed").collect()]  # a row for each check
    if failed:
        raise ValueError(f"leakage: {', '.join(failed)}")
    return rows
