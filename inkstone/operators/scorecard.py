"""Scorecards and matrices over audited drafts.

Drafts have ``runner, task, generation, condition`` ('baseline' or 'treatment') and a text. All sums combine before
their shuffle; keys of scorecards (runners, tasks, rules) are few, whatever the number of drafts.

Defined results: drafts that repeat count as often as they stand; null texts have no violations; null keys are keys of
their own. Empty tables give no rows. Columns beside the named ones stay behind, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.operators.audit import audit, rule_results
from inkstone.runtime import cut_lineage


def draft_counts(drafts: DataFrame) -> DataFrame:
    """Violations by ``runner, task, generation, condition, rule``, mechanical rules only; zeros stay."""
    flat = rule_results(audit(drafts.select("runner", "task", "generation", "condition", "text"), mechanical_only=True, counts_only=True))
    return flat.groupBy("runner", "task", "generation", "condition", "rule").agg(F.sum("count").alias("n"))


def _sides(where: Column | None = None) -> list[Column]:
    def side(name: str) -> Column:
        hit = F.col("condition") == name
        return F.coalesce(F.sum(F.when(hit if where is None else hit & where, F.col("n"))), F.lit(0))

    return [side("baseline").alias("baseline"), side("treatment").alias("treatment")]


def _task_sums(counts: DataFrame, generation: int) -> DataFrame:
    """``runner, task, baseline, treatment, dominant``, from one reading of the counts."""
    first = [side.alias(f"__{name}") for side, name in zip(_sides(F.col("generation") == generation), ("a", "b"), strict=True)]
    each = counts.groupBy("runner", "task", "rule").agg(*_sides(), *first)
    delta = F.col("__b") - F.col("__a")
    best = F.min(F.when(delta != 0, F.struct(delta.alias("delta"), "rule"))).alias("__best")
    sums = each.groupBy("runner", "task").agg(F.sum("baseline").alias("baseline"), F.sum("treatment").alias("treatment"), best)
    return sums.withColumn("dominant", F.coalesce("__best.rule", F.lit("—"))).drop("__best")


def dominant_rules(counts: DataFrame, generation: int = 1) -> DataFrame:
    """``runner, task, dominant``: the rule whose change in one generation is smallest (most negative), ties by name;
    a dash where nothing changed."""
    return _task_sums(counts.where(F.col("generation") == generation), generation).select("runner", "task", "dominant")


def task_rows(counts: DataFrame) -> DataFrame:
    """``runner, task, baseline, treatment, delta, dominant``; a dash without a runner or a task."""
    dominant = F.when(F.col("runner").isNotNull() & F.col("task").isNotNull(), F.col("dominant")).otherwise("—")
    return _task_sums(counts, 1).select("runner", "task", "baseline", "treatment", (F.col("treatment") - F.col("baseline")).alias("delta"), dominant.alias("dominant"))


def rule_rows(counts: DataFrame) -> DataFrame:
    """``runner, rule, baseline, treatment, delta`` of rules with a violation on either side."""
    sums = counts.groupBy("runner", "rule").agg(*_sides()).where("baseline + treatment > 0")
    return sums.withColumn("delta", F.col("treatment") - F.col("baseline"))


def percent(baseline: Column, delta: Column) -> Column:
    """Signed whole percent, halves to even; 'n/a' without a baseline."""
    value = F.bround(100 * delta / F.nullif(baseline, F.lit(0)), 0).cast("long")
    zero = F.when(delta < 0, "-0%").otherwise("+0%")
    return F.when(baseline == 0, "n/a").when(value == 0, zero).otherwise(F.concat(F.when(value > 0, "+").otherwise(""), value.cast("string"), F.lit("%")))


def signed(delta: Column) -> Column:
    return F.when(delta > 0, F.concat(F.lit("+"), delta.cast("string"))).otherwise(delta.cast("string"))


def total_rows(counts: DataFrame) -> DataFrame:
    """``runner, baseline, treatment, delta, pct``."""
    sums = counts.groupBy("runner").agg(*_sides()).withColumn("delta", F.col("treatment") - F.col("baseline"))
    return sums.withColumn("pct", percent(F.col("baseline"), F.col("delta")))


def runners_of(rules: DataFrame, most: int = 200) -> list[str]:
    """The names of the runners in the data, in order; more than ``most`` are an error, since each becomes a column."""
    found = [r.runner for r in rules.select("runner").where(F.col("runner").isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} runners")
    return sorted(found)


def matrix(rules: DataFrame, runners: list[str] | None = None, most: int = 200) -> DataFrame:
    """``rule`` and one column of signed deltas per runner; a runner without the rule shows 0. Runners that are not given
    are those found in the data, at most ``most``; the rows are then written to the shared folder and read twice."""
    if runners is None:
        rules = cut_lineage(rules)
        runners = runners_of(rules, most)
    wide = rules.groupBy("rule").pivot("runner", runners).agg(F.sum("delta"))
    return wide.select("rule", *[signed(F.coalesce(F.col(f"`{r}`"), F.lit(0))).alias(r) for r in runners])


def completeness(counts: DataFrame, n_tasks: int) -> DataFrame:
    """``runner, processed, complete``: whether each runner has drafts of as many tasks as the list has."""
    seen = counts.groupBy("runner").agg(F.countDistinct("task").alias("processed"))
    return seen.withColumn("complete", F.col("processed") == n_tasks)
