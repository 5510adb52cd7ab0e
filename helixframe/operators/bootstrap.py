"""Bootstrap intervals with Poisson weights.

A row's weight in replicate b is drawn from a Poisson distribution by a hash of the row's id and b, so a resample needs
no shuffle of rows: a metric that is a ratio of sums becomes one aggregate over weighted sums, all replicates at once.
Rank metrics count the pairs of scores in rank order, slot by slot, for all replicates at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators import metrics

CAP = 50_000
#: Numbers of partial sums that a task keeps.
HELD = 4_000_000


def weights(ids: np.ndarray, replicates: int, rate: float, seed: int) -> np.ndarray:
    """rows x replicates, Poisson by inversion of a mixed hash of id, replicate and seed."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (np.arange(replicates, dtype=np.uint64) + np.uint64(seed << 20))[None, :] * np.uint64(0xBF58476D1CE4E5B9)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    u = (x >> np.uint64(11)).astype(np.float64) / (1 << 53)
    out, p, total, k = np.zeros(u.shape, np.int64), math.exp(-rate), math.exp(-rate), 0
    most = u.max(initial=0.0)
    while k < 40 and total < most:
        out += u > total
        k += 1
        p *= rate / k
        total += p
    return out


#: What the second definition of intervals asks for: resamples as large as the data, and no bounds unless any is valid.
WITHOUT_CAP = {"cap": None, "least_valid": 0.0, "otherwise": "null"}


def interval(replicates: DataFrame, points: DataFrame, by: list[str], alpha: float = 0.05, least_valid: float = 0.5, n: int = 1000, otherwise: str = "point") -> DataFrame:
    """points with ci_lower and ci_upper from replicate values. Where fewer than the share least_valid (or none) are valid,
    both are the point itself, or null if `otherwise` says so."""
    valid = replicates.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy(*by).agg(F.percentile("value", alpha / 2).alias("lo"), F.percentile("value", 1 - alpha / 2).alias("hi"), F.count("*").alias("__v"))
    joined = points.join(valid, by, "left") if by else points.crossJoin(valid)  # one row each
    enough = F.coalesce(F.col("__v"), F.lit(0)) >= F.greatest(F.lit(least_valid * n), F.lit(1.0))
    rest = F.col("estimate") if otherwise == "point" else F.lit(None).cast("double")
    return joined.withColumns({"ci_lower": F.when(enough, F.col("lo")).otherwise(rest), "ci_upper": F.when(enough, F.col("hi")).otherwise(rest)}).drop("lo", "hi", "__v")


def sums_interval(df: DataFrame, ident: str, sums: dict[str, Column], value: Column, by: list[str] | None = None, replicates: int = 1000, alpha: float = 0.05, seed: int = 42, cap: int | None = CAP, least_valid: float = 0.5, otherwise: str = "point") -> DataFrame:
    """(by, estimate, n, ci_lower, ci_upper) of any metric that is an expression over sums, in each group.

    sums: the summand of each row by name; value: an expression over columns of these names, and n. Rows with a missing
    summand are left out. Each task hands on one row of partial sums for each group and replicate, so a resample moves
    no rows. With a cap, the expected size of a resample is at most cap rows, which widens the interval as a smaller
    sample would. Fewer valid replicates than the share least_valid give the point itself as both bounds, or null (see
    interval). A task hands on its sums whenever it holds HELD numbers.
    """
    by, names = by or [], list(sums)
    group = F.to_json(F.struct(*by)) if by else F.lit("{}")
    used = df.select(*by, group.alias("__g"), F.xxhash64(ident).alias("__h"), F.array(*(c.cast("double") for c in sums.values())).alias("__s"))
    used = used.where(~F.exists("__s", lambda x: x.isNull()))
    points = used.groupBy(*by, "__g").agg(*(F.sum(F.get("__s", F.lit(i))).alias(k) for i, k in enumerate(names)), F.count("*").alias("n"))
    points = points.select(*by, "__g", value.alias("estimate"), "n")
    rows = used.select(F.col("__g").alias("g"), F.col("__h").alias("h"), F.col("__s").alias("s"))
    sized = rows.join(points.select(F.col("__g").alias("g"), "n"), "g") if cap else rows.withColumn("n", F.lit(1).cast("long"))
    fields = [f"x{i}" for i in range(len(names) + 1)]

    def handed_on(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, s in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * replicates), pa.array(np.arange(replicates)), *map(pa.array, s)], ["g", "__r", *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            g = np.array(batch.column("g").to_pylist(), object)
            h, n = batch.column("h").to_numpy(), batch.column("n").to_numpy()
            x = np.ones((len(names) + 1, len(h)))
            x[:-1] = batch.column("s").flatten().to_numpy().reshape(len(h), len(names)).T
            for name in dict.fromkeys(g.tolist()):
                rows = np.flatnonzero(g == name)
                for at in range(0, len(rows), 2048):
                    part = rows[at : at + 2048]
                    rate = min(1.0, cap / n[part[0]]) if cap else 1.0
                    w = weights(h[part], replicates, rate, seed)
                    held[name] = held.get(name, 0) + x[:, part] @ w
                if len(held) * replicates * len(fields) >= HELD:
                    yield from handed_on(held)
                    held.clear()
        yield from handed_on(held)

    partial = sized.select("g", "h", "n", "s").mapInArrow(run, "g string, __r long, " + ", ".join(f"{f} double" for f in fields))
    each = partial.groupBy(F.col("g").alias("__g"), "__r").agg(*(F.sum(f).alias(k) for f, k in zip(fields, [*names, "n"])))
    return interval(each.select("__g", value.alias("value")), points, ["__g"], alpha, least_valid, replicates, otherwise).drop("__g")


def _ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def ratio_interval(df: DataFrame, ident: str, numerator: Column, denominator: Column, by: list[str] | None = None, **options) -> DataFrame:
    """estimate = sum(numerator) / sum(denominator) with its interval, in each group."""
    return sums_interval(df, ident, {"a": numerator, "b": denominator}, _ratio(F.col("a"), F.col("b")), by, **options)


def _both(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropna(subset=list(columns))


def pearson_interval(df: DataFrame, ident: str, y: str, p: str, by: list[str] | None = None, **options) -> DataFrame:
    """Pearson's r; of ranks (metrics.average_ranks) it is Spearman's with the ranks of all rows."""
    a, b = F.col(y).cast("double"), F.col(p).cast("double")
    sums = {"sy": a, "sp": b, "syy": a * a, "spp": b * b, "syp": a * b}
    n, c = F.col("n"), F.col
    spread = lambda s, ss: F.greatest(F.lit(0.0), n * c(ss) - c(s) * c(s))
    value = F.when(n < 3, 0.0).otherwise(_ratio(n * c("syp") - c("sy") * c("sp"), F.sqrt(spread("sy", "syy")) * F.sqrt(spread("sp", "spp"))))
    return sums_interval(_both(df, y, p), ident, sums, value, by, **options)


def r_squared_interval(df: DataFrame, ident: str, y: str, p: str, by: list[str] | None = None, **options) -> DataFrame:
    """R2 of a prediction; 0 where y doesn't vary."""
    a, e = F.col(y).cast("double"), F.col(y).cast("double") - F.col(p).cast("double")
    total = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    value = F.when(total <= 1e-12 * F.col("syy"), 0.0).otherwise(1 - _ratio(F.col("see"), total))
    return sums_interval(_both(df, y, p), ident, {"sy": a, "syy": a * a, "see": e * e}, value, by, **options)


def incremental_r2_interval(df: DataFrame, ident: str, y: str, full: str, base: str, by: list[str] | None = None, **options) -> DataFrame:
    """R2 of the full prediction minus R2 of the base prediction, both resampled with their rows."""
    a = F.col(y).cast("double")
    e, f = a - F.col(base).cast("double"), a - F.col(full).cast("double")
    total = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    value = F.when(total <= 1e-12 * F.col("syy"), 0.0).otherwise(_ratio(F.col("seb") - F.col("sef"), total))
    return sums_interval(_both(df, y, full, base), ident, {"sy": a, "syy": a * a, "seb": e * e, "sef": f * f}, value, by, **options)


def direction_interval(df: DataFrame, ident: str, true: str, predicted: str, by: list[str] | None = None, **options) -> DataFrame:
    """Share of equal signs among rows whose true effect isn't 0; groups without such rows aren't there."""
    rows = _both(df, true, predicted).where(F.col(true) != 0)
    return ratio_interval(rows, ident, (F.signum(F.col(true).cast("double")) == F.signum(F.col(predicted).cast("double"))).cast("double"), F.lit(1.0), by, **options)


def balanced_accuracy_interval(df: DataFrame, ident: str, label: str, predicted: str, by: list[str] | None = None, **options) -> DataFrame:
    """Mean recall of the classes 0 and 1 that occur in a resample."""
    rows = _both(df, label, predicted).where(F.col(label).isin(0, 1))
    is_one, right = (F.col(label) == 1).cast("double"), (F.col(label) == F.col(predicted)).cast("double")
    sums = {"p": is_one, "q": 1 - is_one, "rp": is_one * right, "rq": (1 - is_one) * right}
    of = lambda r, k: _ratio(F.col(r), F.col(k))
    value = F.coalesce((of("rp", "p") + of("rq", "q")) / 2, of("rp", "p"), of("rq", "q"))
    return sums_interval(rows, ident, sums, value, by, **options)


def nri_interval(df: DataFrame, ident: str, label: str, old: str, new: str, threshold: float = 0.5, by: list[str] | None = None, **options) -> DataFrame:
    """Net reclassification; an empty side adds 0."""
    rows = _both(df, label, old, new).where(F.col(label).isin(0, 1))
    move, one = (F.col(new) >= threshold).cast("double") - (F.col(old) >= threshold).cast("double"), (F.col(label) == 1).cast("double")
    side = lambda m, k: F.coalesce(_ratio(F.col(m), F.col(k)), F.lit(0.0))
    return sums_interval(rows, ident, {"p": one, "q": 1 - one, "up": one * move, "down": (1 - one) * move}, side("up", "p") - side("down", "q"), by, **options)


def spearman_interval(df: DataFrame, ident: str, y: str, p: str, by: list[str] | None = None, **options) -> DataFrame:
    """Spearman's rho as the correlation of the ranks among all rows, which resamples keep."""
    rows = _both(df, y, p).select(*(by or []), ident, F.col(y).alias("__y"), F.col(p).alias("__p"))
    ranked = metrics.average_ranks(metrics.average_ranks(rows, "__y", "__ry", by), "__p", "__rp", by)
    return pearson_interval(ranked, ident, "__ry", "__rp", by, **options)


def _dealt(df: DataFrame, ident: str, label: str, score: str, by: list[str], slot_rows: int) -> DataFrame:
    """(g, slot, part, s, h, y, n): each group's distinct scores, in rank order, in slots of about slot_rows rows.

    A score with more rows than that is a slot of its own, with an odd number, whose rows only need counting and may lie in
    several parts. No part holds more than two slots' worth of rows.
    """
    group = F.to_json(F.struct(*by)) if by else F.lit("{}")
    rows = df.where(F.col(label).isin(0, 1) & F.col(score).isNotNull() & ~F.isnan(score)).select(group.alias("g"), F.xxhash64(ident).alias("h"), F.col(score).alias("s"), F.col(label).cast("long").alias("y"))
    ranks = metrics.score_counts(rows, "y", "s", ["g"])
    own = F.col("pos") + F.col("neg")
    tied = own > slot_rows
    slot = F.floor((F.col("pos_below") + F.col("neg_below")) / slot_rows).cast("long") * 2 + tied.cast("long")
    ranks = ranks.select("g", F.col("score").alias("s"), slot.alias("slot"), F.when(tied, F.ceil(own / slot_rows)).otherwise(1).cast("long").alias("parts"), (F.col("pos_all") + F.col("neg_all")).alias("n"))
    placed = rows.join(ranks, ["g", "s"]).withColumn("part", F.pmod(F.xxhash64("h"), F.col("parts")))
    return placed.select("g", "slot", "part", F.col("s").cast("double").alias("s"), "h", "y", "n")


def _by_score(s: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positives, negatives) of each distinct score of ascending s and each replicate, by weights w."""
    heads = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    pos, neg = (np.add.reduceat(w * (y == k)[:, None], heads) for k in (1, 0))
    return pos.astype(np.float64), neg.astype(np.float64)


def _slot_sums(dealt: DataFrame, replicates: int, seed: int, cap: int | None) -> DataFrame:
    """(g, b, slot, pos, neg, pairs): sums of each replicate in each slot; pairs counts those in order within the slot."""
    ordered = dealt.repartition("g", "slot", "part").sortWithinPartitions("g", "slot", "part", "s")

    def counted(g: str, slot: int, s: np.ndarray, h: np.ndarray, y: np.ndarray, n: int) -> pa.RecordBatch:
        rate = min(1.0, cap / n) if cap else 1.0
        sums = np.zeros((3, replicates))
        if slot & 1:
            for at in range(0, len(h), 2048):
                w, hit = weights(h[at : at + 2048], replicates, rate, seed), y[at : at + 2048] == 1
                sums[:2] += w[hit].sum(0), w[~hit].sum(0)
        else:
            pos, neg = _by_score(s, y, weights(h, replicates, rate, seed))
            sums[:] = pos.sum(0), neg.sum(0), (pos * (np.cumsum(neg, 0) - 0.5 * neg)).sum(0)
        return pa.RecordBatch.from_arrays([pa.array([g]), pa.array([slot], pa.int64()), *(pa.array([x], pa.list_(pa.float64())) for x in sums)], ["g", "slot", "pos", "neg", "pairs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in _then_none(batches):
            held = [t for t in (rest, pa.Table.from_batches([batch]) if batch is not None else None) if t is not None]
            table = pa.concat_tables(held).combine_chunks() if held else None
            if table is None or not table.num_rows:
                continue
            names = np.array(table.column("g").to_pylist(), object)
            slots, parts, s, h, y, n = (table.column(c).to_numpy() for c in ("slot", "part", "s", "h", "y", "n"))
            heads = np.flatnonzero(np.concatenate([[True], (names[1:] != names[:-1]) | (slots[1:] != slots[:-1]) | (parts[1:] != parts[:-1])]))
            stops = np.concatenate([heads[1:], [len(names)]])
            if batch is not None:
                rest = table.slice(heads[-1])
                heads, stops = heads[:-1], stops[:-1]
            for a, b in zip(heads.tolist(), stops.tolist()):
                yield counted(names[a], int(slots[a]), s[a:b], h[a:b], y[a:b], int(n[a]))

    sums = ordered.mapInArrow(run, "g string, slot long, pos array<double>, neg array<double>, pairs array<double>")
    each = sums.select("g", "slot", F.posexplode(F.arrays_zip("pos", "neg", "pairs")).alias("b", "x"))
    return each.groupBy("g", "b", "slot").agg(*(F.sum(f"x.{c}").alias(c) for c in ("pos", "neg", "pairs")))


def _below(long: DataFrame, name: str) -> Column:
    """The sum of a replicate's lower slots."""
    return F.coalesce(F.sum(name).over(Window.partitionBy("g", "b").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))


def auroc_interval(df: DataFrame, ident: str, label: str, score: str, by: list[str] | None = None, replicates: int = 500, alpha: float = 0.05, seed: int = 42, cap: int | None = CAP, slot_rows: int = 2048, least_valid: float = 0.5, otherwise: str = "point") -> DataFrame:
    """AUROC with its interval: the point and every replicate rank the exact scores.

    A task counts a slot's pairs for all replicates and hands on three sums for each. No task holds a group's rows.
    """
    by = by or []
    group = F.to_json(F.struct(*by)) if by else F.lit("{}")
    long = _slot_sums(_dealt(df, ident, label, score, by, slot_rows), replicates, seed, cap)
    pairs = F.when(F.col("slot") % 2 == 1, F.lit(0.5) * F.col("pos") * F.col("neg")).otherwise(F.col("pairs"))
    area = long.withColumn("below", _below(long, "neg")).groupBy("g", "b").agg((F.sum(F.col("pos") * F.col("below") + pairs) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))).alias("value"))
    points = metrics.auroc(df, label, score, by).withColumn("__g", group)
    return interval(area.withColumnRenamed("g", "__g"), points, ["__g"], alpha, least_valid, replicates, otherwise).drop("__g")


#: The metrics that read a threshold curve.
CURVES = ("auprc", "ppv", "npv")


def curve_intervals(df: DataFrame, ident: str, label: str, score: str, by: list[str] | None = None, kinds: tuple[str, ...] = CURVES, sensitivity: float = 0.9, specificity: float = 0.99, replicates: int = 1000, alpha: float = 0.05, seed: int = 42, cap: int | None = CAP, slot_rows: int = 2048, least_valid: float = 0.5, otherwise: str = "point") -> DataFrame:
    """(by, metric, estimate, n, ci_lower, ci_upper) of average precision, precision at a sensitivity and share of true
    negatives at a specificity.

    What a slot adds to a replicate's curve depends on the replicate's positives and negatives in all slots above it. A
    first pass over the slots counts both, windows over slots make the offsets, and a second pass meets each slot's rows
    with its offsets. A threshold metric is read in the one slot where the replicate's curve crosses the target. A
    replicate without positives has no average precision; the others are 0 without their class, as in the point.
    """
    by = by or []
    group = F.to_json(F.struct(*by)) if by else F.lit("{}")
    dealt = _dealt(df, ident, label, score, by, slot_rows)
    long = _slot_sums(dealt, replicates, seed, cap)
    whole = Window.partitionBy("g", "b")
    state = long.select("g", "b", "slot", "pos", "neg", _below(long, "pos").alias("pos_below"), _below(long, "neg").alias("neg_below"), F.sum("pos").over(whole).alias("pos_all"), F.sum("neg").over(whole).alias("neg_all"))
    # A slot of one score is one point of the curve.
    tp, fp = F.col("pos_all") - F.col("pos_below"), F.col("neg_all") - F.col("neg_below")
    tn, fn = F.col("neg_below") + F.col("neg"), F.col("pos_below") + F.col("pos")
    reach, keep = sensitivity * F.col("pos_all"), specificity * F.col("neg_all")
    ties = state.where("slot % 2 = 1").select(
        "g",
        "b",
        F.coalesce(_ratio(F.col("pos"), F.col("pos_all")) * _ratio(tp, tp + fp), F.lit(0.0)).alias("auprc"),
        F.when((F.col("pos_all") > 0) & (tp >= reach) & (tp - F.col("pos") < reach), _ratio(tp, tp + fp)).alias("ppv"),
        F.when((F.col("neg_all") > 0) & (tn >= keep) & (F.col("neg_below") < keep), _ratio(tn, tn + fn)).alias("npv"),
        "pos_all",
    )
    names = ["pos", "neg", "pos_below", "neg_below", "pos_all", "neg_all"]
    sides = state.where("slot % 2 = 0").groupBy("g", "slot").agg(F.array_sort(F.collect_list(F.struct("b", *names))).alias("x")).select("g", "slot", *(F.col(f"x.{c}").alias(c) for c in names))

    def read(rows: pa.Table, side: pa.Table) -> pa.Table:
        """One slot: at most two slots' worth of rows, and a row of offsets."""
        pos_own, neg_own, pos_below, neg_below, pos_all, neg_all = (side.column(c)[0].values.to_numpy() for c in names)
        rows = rows.sort_by("s")
        n = rows.column("n")[0].as_py()
        pos, neg = _by_score(rows.column("s").to_numpy(), rows.column("y").to_numpy(), weights(rows.column("h").to_numpy(), replicates, min(1.0, cap / n) if cap else 1.0, seed))
        up_pos, up_neg = np.cumsum(pos, 0), np.cumsum(neg, 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            tp, fp = pos_all - pos_below - up_pos + pos, neg_all - neg_below - up_neg + neg
            auprc = np.where(pos > 0, pos / pos_all * tp / (tp + fp), 0.0).sum(0)
            reached = (tp >= sensitivity * pos_all) & (pos_all > 0)
            at = reached.sum(0) - 1  # tp falls with the score: the last that reaches
            here = (at >= 0) & (pos_all - pos_below - pos_own < sensitivity * pos_all)
            pick = lambda x, at: x[np.maximum(at, 0), np.arange(replicates)]
            ppv = np.where(here, pick(tp / (tp + fp), at), np.nan)
            tn, fn = neg_below + up_neg, pos_below + up_pos
            kept = (tn >= specificity * neg_all) & (neg_all > 0)
            first = kept.argmax(0)
            npv = np.where(kept.any(0) & (neg_below < specificity * neg_all), pick(tn / (tn + fn), first), np.nan)
        out = [pa.array([rows.column("g")[0].as_py()] * replicates), pa.array(np.arange(replicates, dtype=np.int32)), pa.array(auprc), *(pa.array(x, from_pandas=True) for x in (ppv, npv)), pa.array(pos_all)]
        return pa.table(out, ["g", "b", "auprc", "ppv", "npv", "pos_all"])

    plain = dealt.where("slot % 2 = 0").groupBy("g", "slot").cogroup(sides.groupBy("g", "slot")).applyInArrow(read, "g string, b int, auprc double, ppv double, npv double, pos_all double")
    each = plain.unionByName(ties).groupBy("g", "b").agg(F.sum("auprc").alias("auprc"), F.max("ppv").alias("ppv"), F.max("npv").alias("npv"), F.max("pos_all").alias("pos_all"))
    value = {"auprc": F.when(F.col("pos_all") > 0, F.col("auprc")), "ppv": F.coalesce("ppv", F.lit(0.0)), "npv": F.coalesce("npv", F.lit(0.0))}
    values = each.select(F.col("g").alias("__g"), F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), value[k].alias("value")) for k in kinds))).alias("x")).select("__g", "x.metric", "x.value")
    point = {"auprc": lambda: metrics.auprc(df, label, score, by), "ppv": lambda: metrics.ppv_at_sensitivity(df, label, score, sensitivity, by), "npv": lambda: metrics.npv_at_specificity(df, label, score, specificity, by)}
    points = reduce(DataFrame.unionByName, [point[k]().select(*by, F.lit(k).alias("metric"), "estimate", "n") for k in kinds]).withColumn("__g", group)
    return interval(values, points, ["__g", "metric"], alpha, least_valid, replicates, otherwise).drop("__g")


def auprc_interval(df: DataFrame, ident: str, label: str, score: str, by: list[str] | None = None, **options) -> DataFrame:
    """Average precision with its interval."""
    return curve_intervals(df, ident, label, score, by, ("auprc",), **options).drop("metric")


def ppv_interval(df: DataFrame, ident: str, label: str, score: str, target: float = 0.9, by: list[str] | None = None, **options) -> DataFrame:
    """Precision at a sensitivity with its interval."""
    return curve_intervals(df, ident, label, score, by, ("ppv",), sensitivity=target, **options).drop("metric")


def npv_interval(df: DataFrame, ident: str, label: str, score: str, target: float = 0.99, by: list[str] | None = None, **options) -> DataFrame:
    """Share of true negatives at a specificity with its interval."""
    return curve_intervals(df, ident, label, score, by, ("npv",), specificity=target, **options).drop("metric")


def _explained(gram: np.ndarray, n: np.ndarray) -> np.ndarray:
    """R2 with all columns minus R2 without the last but one, by least squares from matrices of sums of products.

    gram: cases x m x m over (1, covariates, score, y). NaN with no rows; 0 where y doesn't vary.
    """
    with np.errstate(divide="ignore", invalid="ignore"):
        centred = gram[:, 1:, 1:] - gram[:, 1:, :1] * gram[:, :1, 1:] / n[:, None, None]
    bad = ~(n > 0)
    centred[bad] = 0.0
    scale = np.sqrt(np.maximum(np.einsum("kii->ki", centred), 0.0))
    flat = scale <= 1e-7 * np.sqrt(np.maximum(np.einsum("kii->ki", gram[:, 1:, 1:]), 0.0))
    unit = np.where(flat, 1.0, scale)
    centred = np.where(flat[:, :, None] | flat[:, None, :], 0.0, centred / unit[:, :, None] / unit[:, None, :])
    m = centred.shape[1] - 1

    def fitted(k: int) -> np.ndarray:
        x, y = centred[:, :k, :k], centred[:, :k, m]
        return np.einsum("ki,kij,kj->k", y, np.linalg.pinv(x, rcond=1e-10, hermitian=True), y) if k else np.zeros(len(n))

    return np.where(bad, np.nan, np.where(flat[:, m], 0.0, fitted(m) - fitted(m - 1)))


def covariate_r2_interval(df: DataFrame, ident: str, y: str, score: str, covariates: list[str], by: list[str] | None = None, **options) -> DataFrame:
    """(by, estimate, n, ci_lower, ci_upper): R2 of least squares on covariates and score minus that on covariates alone.

    One aggregate makes each group's and replicate's matrix of products, and batches of matrices are solved at once.
    Covariates are resampled with their rows. Columns are moved by their group's mean first, which changes no fit and
    keeps the sums exact; covariates that don't vary or depend on others add nothing.
    """
    by, names = by or [], [*covariates, score, y]
    cells = [(i, j) for i in range(len(names) + 1) for j in range(i, len(names) + 1) if j]
    rows = _both(df, *names).select(*by, ident, *(F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(names, 1)))
    means = rows.groupBy(*by).agg(*(F.avg(f"__x{i}").alias(f"__m{i}") for i in range(1, len(names) + 1)))
    rows = metrics._same(rows, means, by)
    moved = [F.lit(1.0), *(F.col(f"__x{i}") - F.col(f"__m{i}") for i in range(1, len(names) + 1))]
    size = len(names) + 1

    @F.arrow_udf("double")
    def solve(n: pa.Array, sums: pa.Array) -> pa.Array:
        flat, count = sums.flatten().to_numpy(zero_copy_only=False).reshape(len(n), len(cells)), n.to_numpy(zero_copy_only=False).astype(np.float64)
        gram = np.zeros((len(count), size, size))
        gram[:, 0, 0] = count
        for k, (i, j) in enumerate(cells):
            gram[:, i, j] = gram[:, j, i] = flat[:, k]
        return pa.array(_explained(gram, count), from_pandas=True)

    sums = {f"c{i}_{j}": moved[i] * moved[j] for i, j in cells}
    return sums_interval(rows, ident, sums, solve(F.col("n").cast("double"), F.array(*sums)), by, **options)


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None
