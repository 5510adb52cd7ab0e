"""The result store and tables made from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(runs: DataFrame, by: list[str], order: list[str] | None = None) -> DataFrame:
    """The last run of each of `by`, by time, then number."""
    w = Window.partitionBy(*by).orderBy(*(F.col(c).desc() for c in order or ["ts", "run_no"]))
    return runs.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def list_runs(runs: DataFrame, task: str | None = None, model: str | None = None, limit: int = 50) -> DataFrame:
    """Runs whose task contains `task`, newest first."""
    rows = runs
    if task is not None:
        rows = rows.where(F.col("task_id").contains(task))
    if model is not None:
        rows = rows.where(F.col("model_name") == model)
    return rows.orderBy(F.col("ts").desc(), F.col("run_no").desc()).limit(limit)


def compare(runs: DataFrame, tasks: list[str]) -> DataFrame:
    """Latest estimate of every model, a column for each task."""
    last = latest(runs, ["model_name", "task_id"])
    return last.groupBy("model_name").pivot("task_id", tasks).agg(F.first("estimate"))


def history(runs: DataFrame, task: str, model: str, metric: str) -> DataFrame:
    rows = runs.where((F.col("task_id") == task) & (F.col("model_name") == model) & (F.col("metric") == metric) & F.col("estimate").isNotNull() & ~F.isnan("estimate"))
    return rows.select("run_no", "ts", "estimate").orderBy("ts", "run_no")


def series(runs: DataFrame) -> DataFrame:
    """history of every (task, model, metric): place (from 1) of each run that has an estimate, in time, and the change from the one before."""
    usable = runs.where(F.col("estimate").isNotNull() & ~F.isnan("estimate"))
    w = Window.partitionBy("task_id", "model_name", "metric").orderBy("ts", "run_no")
    return usable.select("task_id", "model_name", "metric", "run_no", "estimate", F.row_number().over(w).alias("place"), (F.col("estimate") - F.lag("estimate").over(w)).alias("change"))


def bars(compared: DataFrame, columns: list[str]) -> DataFrame:
    """A comparison for bars: missing estimates as 0."""
    return compared.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in columns})


def summary_lines(runs: DataFrame) -> DataFrame:
    """(run_no, line): task, model and split of a run with its metrics and their intervals, in the order of their names."""
    metric = F.format_string("%s=%.4f [%.4f, %.4f]", "metric", "estimate", "ci_lower", "ci_upper")
    usable = runs.where(F.col("estimate").isNotNull() & ~F.isnan("estimate"))
    rows = usable.groupBy("run_no", "task_id", "model_name").agg(F.array_join(F.array_sort(F.collect_list(metric)), ", ").alias("m"))
    return rows.select("run_no", F.format_string("%s | %s | %s", "task_id", "model_name", "m").alias("line"))


def against_baselines(results: DataFrame, baselines: DataFrame, metrics: list[str], circular: DataFrame | None = None) -> DataFrame:
    """(label, a column for each metric): the model's row, then the baselines by name; baselines that share data with the
    test (circular: model_name, reason) say so. Both have model_name, metric, estimate."""
    model = results.select(F.lit(0).alias("place"), F.lit("**Model**").alias("label"), "metric", "estimate")
    others = baselines.join(circular, "model_name", "left") if circular is not None else baselines.withColumn("reason", F.lit(None).cast("string"))
    label = F.when(F.col("reason").isNotNull(), F.format_string("%s (circularity: %s)", "model_name", "reason")).otherwise(F.col("model_name"))
    rows = model.unionByName(others.select(F.lit(1).alias("place"), label.alias("label"), "metric", "estimate"))
    return rows.groupBy("place", "label").pivot("metric", metrics).agg(F.first("estimate")).orderBy("place", "label").drop("place")


def unpivot_counts(compared: DataFrame, by: str) -> DataFrame:
    """(by, metric, value): precision, recall and f1 of a call-set comparison as rows."""
    return compared.unpivot(by, ["precision", "recall", "f1"], "metric", "value")


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value): the distinct values of each column that are there, as text."""
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(F.explode(each).alias("e")).select("e.*").where(F.col("value").isNotNull()).distinct()


def validate(expected: DataFrame, actual: DataFrame, on: list[str], tolerance: float = 0.05) -> DataFrame:
    """Every expected value with its actual one and what there is to warn of."""
    state = F.when(F.col("estimate").isNull(), "missing").when(F.abs(F.col("estimate") - F.col("expected")) > tolerance, "differs").otherwise("ok")
    return expected.join(actual, on, "left").withColumn("state", state)


def gates(metrics: DataFrame, thresholds: DataFrame, on: list[str]) -> DataFrame:
    """pass or fail against each metric's threshold; none without one."""
    gate = F.when(F.col("threshold").isNull(), "none").when(F.col("estimate") >= F.col("threshold"), "pass").otherwise("fail")
    return metrics.join(thresholds, on, "left").withColumn("gate", gate)


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


BAD = ("failed", "timeout", "skipped")


def tool_status(errors: Column, warnings: Column) -> Column:
    return F.when(F.size(errors) > 0, "failed").when(F.size(warnings) > 0, "partial").otherwise("ok")


def pipeline_status(results: DataFrame, run: str = "run_id") -> DataFrame:
    """One status for each run, weighed by how critical its tools are."""
    bad = F.col("status").isin(*BAD)
    counts = results.groupBy(run).agg(
        F.bool_or(bad & (F.col("criticality") == "critical")).alias("broken"),
        F.bool_or((bad & (F.col("criticality") != "optional")) | (F.col("status") == "partial")).alias("partial"),
        F.count("*").alias("n_tools"),
        *(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("ok", "partial", "failed", "skipped")),
    )
    return counts.withColumn("status", F.when(F.col("broken"), "failed").when(F.col("partial"), "partial").otherwise("ok")).drop("broken", "partial")


def run_times(results: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, seconds, and for each status the sorted distinct names of its tools); results: tool_name, status, started_at, finished_at."""
    names = {s: F.array_sort(F.collect_set(F.when(F.col("status") == s, F.col("tool_name")))).alias(f"{s}_tools") for s in ("ok", "partial", "failed", "skipped")}
    seconds = F.max("finished_at").cast("double") - F.min("started_at").cast("double")
    return results.groupBy(run).agg(F.round(seconds, 3).alias("seconds"), *names.values())


def passes_over_runs(gated: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_pass, n_runs)."""
    return gated.groupBy(*by).agg(F.count_if(F.col("gate") == "pass").alias("n_pass"), F.count("*").alias("n_runs"))


def tier0(runs: DataFrame) -> DataFrame:
    """(run_no, heading, metric, value): a row for each metric of sanity checks, its value with interval and n. runs:
    task_id, gate, gate_reason, metric, estimate, ci_lower, ci_upper, n."""
    mark = F.when(F.col("gate") == "pass", " [PASS]").when(F.col("gate") == "fail", F.format_string(" [FAIL: %s]", F.coalesce("gate_reason", F.lit("")))).otherwise("")
    value = F.format_string("%.4f (%.4f–%.4f), N=%d", "estimate", "ci_lower", "ci_upper", "n")
    return runs.where(F.col("estimate").isNotNull()).select("run_no", F.concat("task_id", mark).alias("heading"), "metric", value.alias("value"))


def tier0_facts(runs: DataFrame) -> DataFrame:
    """(run_no, place, field, value): what stands above the metrics of a sanity check, in order: its model, split, number of
    samples and whether its leakage checks passed. runs, with a row for each metric or one: run_no, model_name, split_type,
    n_samples, leakage_passed (null: not checked, which counts as failed)."""
    one = runs.groupBy("run_no").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("model_name", "split_type", "n_samples")), F.bool_and(F.coalesce("leakage_passed", F.lit(False))).alias("passed"))
    facts = {"Model": F.col("model_name"), "Split": F.col("split_type"), "N": F.col("n_samples").cast("string"), "Anti-leakage": F.when(F.col("passed"), "all passed").otherwise("FAILED")}
    entries = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(k).alias("field"), F.coalesce(v, F.lit("")).alias("value")) for i, (k, v) in enumerate(facts.items())))
    return one.select("run_no", F.explode(entries).alias("e")).select("run_no", "e.*")


def tier1(runs: DataFrame) -> DataFrame:
    """(task_id, model_name, metric, value, n_single): metrics of the aggregates, and how many single tasks there are in all."""
    single = runs.where(~F.col("task_id").contains("aggregate")).agg(F.count_distinct("run_no")).scalar()
    rows = runs.where(F.col("task_id").contains("aggregate") & F.col("estimate").isNotNull())
    return rows.select("task_id", "model_name", "metric", F.format_string("%.4f", "estimate").alias("value"), single.alias("n_single"))


def tier3(runs: DataFrame) -> DataFrame:
    """(organism, trait, value, n, ceiling, n_skipped) of cross-validated R2 by trait: mean and deviation from the upper
    bound, the share of its ceiling, and how many traits of the organism were skipped. runs: tier, organism, trait,
    estimate, ci_upper, n, ceiling, skipped."""
    rows = runs.where(F.col("tier") == 3)
    skipped = rows.groupBy("organism").agg(F.count_if(F.coalesce("skipped", F.lit(False))).alias("n_skipped"))
    value = F.format_string("%.3f ± %.3f", F.col("estimate"), (F.col("ci_upper") - F.col("estimate")) / 1.96)
    share = F.when(F.col("ceiling") > 0, F.format_string("%.2f (%.1f%%)", F.col("ceiling"), 100 * F.col("estimate") / F.nullif(F.col("ceiling"), F.lit(0.0)))).otherwise("")
    return rows.where(F.col("estimate").isNotNull()).select("organism", "trait", value.alias("value"), "n", share.alias("ceiling")).join(skipped, "organism")


def status_buckets(results: DataFrame, modes: DataFrame) -> DataFrame:
    """(mode, status, n, tools): tools of each mode and status in the order of the modes (mode, place, tool_name); tools
    of no mode come last, as unknown."""
    rows = results.join(modes, "tool_name", "left").select("tool_name", "status", F.coalesce("mode", F.lit("unknown")).alias("mode"), F.coalesce("place", F.lit(1 << 30)).alias("place"))
    tools = F.array_sort(F.collect_set("tool_name"))
    return rows.groupBy("mode", "place", "status").agg(F.count("*").alias("n"), tools.alias("tools")).orderBy("place", "mode", "status").drop("place")


def scorecard(sections: DataFrame) -> DataFrame:
    """(section, task_id, model_name, metric, estimate, ci_lower, ci_upper, n, error): a row for each metric, and one with
    the error, cut to 80 characters, of a section without. sections: section, task_id, model_name, error, metrics (a map
    from metric to estimate, ci_lower, ci_upper, n)."""
    rows = sections.select("section", F.coalesce("task_id", "section").alias("task_id"), F.coalesce("model_name", F.lit("")).alias("model_name"), F.substring("error", 1, 80).alias("error"), F.explode_outer(F.when(F.col("error").isNull(), F.col("metrics"))).alias("metric", "m"))
    return rows.where(F.col("error").isNotNull() | (F.col("m.estimate").isNotNull() & ~F.isnan("m.estimate"))).select("section", "task_id", "model_name", "metric", "m.estimate", "m.ci_lower", "m.ci_upper", "m.n", "error")


def pivot_by_group(metrics: DataFrame, groups: list[str], group: str = "ancestry") -> DataFrame:
    """A row for each metric, a column for each group."""
    return metrics.groupBy("metric").pivot(group, groups).agg(F.first("estimate"))


def flat_metrics(metrics: Column) -> Column:
    """A map of structs with an estimate as a map of numbers, without missing ones."""
    return F.transform_values(F.map_filter(metrics, lambda _, v: v["estimate"].isNotNull()), lambda _, v: v["estimate"])
