"""Benchmark files: task lists, scorecards and matrices as Markdown.

Defined results: null and empty texts hold no tasks; a scorecard without its totals is an error. Repeated files give their
rows again. Columns beside the named ones stay behind. Empty tables give no rows, and a matrix without any.

Counts are small, what they are counted from is not: scorecards and matrices, which read them more than once, write them to
the shared folder first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.operators import scorecard as sc
from inkstone.runtime import cut_lineage

TASK = r'(?s)<task id="([^"]+)">(?:(?!</task>).)*?<prompt>[^\n]*\n(.*?)</prompt>'


def scan_tasks(files: DataFrame) -> DataFrame:
    """``file, task, prompt`` of ``<task id="..."><prompt>`` blocks: the lines between the two lines with the marks."""
    lines = lambda x: F.substring(x, F.lit(1), F.length(x) - F.length(F.substring_index(x, "\n", -1)) - 1)
    prompts = F.transform(F.regexp_extract_all("text", F.lit(TASK), F.lit(2)), lines)
    each = F.arrays_zip(F.regexp_extract_all("text", F.lit(TASK), F.lit(1)).alias("task"), prompts.alias("prompt"))
    return files.select("file", F.inline(each))


def _table(rows: Column) -> Column:
    """Rows (an array of ordered structs with ``line``) as text."""
    return F.array_join(F.transform(F.sort_array(rows), lambda r: r["line"]), "")


def utc_date(clock: Column) -> Column:
    """A moment as its day in UTC, whatever the session's time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds(clock) / 86400).cast("int")).cast("string")


def render_scorecards(counts: DataFrame, version: str, generations: int, date: str | Column = "") -> DataFrame:
    """``file, text``: one scorecard per runner. Tasks and rules are few, so a runner's rows fit in one row. ``date`` is a
    text, or a timestamp of which the day in UTC is written: ``F.current_timestamp()``, or a fixed one."""
    counts = cut_lineage(counts)
    date = utc_date(date) if isinstance(date, Column) else F.lit(date)
    cells = lambda *c: F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(x).cast("string") for x in c]), F.lit(" |\n"))
    tasks = sc.task_rows(counts).groupBy("runner").agg(
        F.collect_list(F.struct("task", cells("task", "baseline", "treatment", "delta", "dominant").alias("line"))).alias("tasks"),
        F.sum("baseline").alias("b"), F.sum("treatment").alias("t"),
    )
    rules = sc.rule_rows(counts).groupBy("runner").agg(F.collect_list(F.struct("rule", cells("rule", "baseline", "treatment", "delta").alias("line"))).alias("rules"))
    text = F.concat(
        F.lit(f"# Benchmark v{version}\n\n- Runner: "), "runner", F.lit(f"\n- Generations per condition: {generations}\n- Date: "), date, F.lit("\n\n## Per-task delta (mechanical rules)\n\n"),
        F.lit("| Task | Baseline total | Treatment total | Delta | Dominant rule |\n|---|---|---|---|---|\n"), _table(F.col("tasks")),
        F.lit("\n## Totals\n\n| | Baseline | Treatment | Delta |\n|---|---|---|---|\n"),
        F.format_string("| total violations | %d | %d | %d |\n", F.col("b"), F.col("t"), F.col("t") - F.col("b")),
        F.lit("\n## Per-rule aggregate\n\n| Rule | Baseline | Treatment | Delta |\n|---|---|---|---|\n"),
        F.coalesce(_table(F.col("rules")), F.lit("")), F.lit("\n_Numbers are directional, not a claim of statistical significance._\n"),
    )
    return tasks.join(rules, "runner", "left").select(F.concat("runner", F.lit(".md")).alias("file"), text.alias("text"))


def scan_scorecards(files: DataFrame) -> DataFrame:
    """``runner, rule, baseline, treatment, delta, total_baseline, total_treatment`` of scorecards.

    A card without totals or without the section of rules is an error, as is one with violations but no rows of rules.
    """
    totals = r"\| total violations \| ([0-9]+) \| ([0-9]+) \| (-?[0-9]+) \|"
    row = r"(?m)^\| (RULE-[^ \t\n]+) \| ([0-9]+) \| ([0-9]+) \| (-?[0-9]+) \|"
    section = F.regexp_extract("text", r"(?ms)^## Per-rule aggregate[^\n]*\n(.*?)(?=^## |\z)", 1)
    runner = F.regexp_extract("text", r"(?m)^- Runner: ([^\n]+)$", 1)
    cards = files.select(
        F.when(runner == "", F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1)).otherwise(runner).alias("runner"),
        *[F.regexp_extract("text", totals, k).alias(f"t{k}") for k in (1, 2)],
        F.col("text").rlike(r"(?m)^## Per-rule aggregate").alias("sectioned"),
        F.arrays_zip(*[F.regexp_extract_all(section, F.lit(row), F.lit(k)).alias(f"c{k}") for k in range(1, 5)]).alias("rows"),
        "file",
    )
    broken = F.when(F.col("t1") == "", "no totals row").when(~F.col("sectioned"), "no section of rules")
    broken = broken.when((F.col("t1").cast("long") + F.col("t2").cast("long") > 0) & (F.size("rows") == 0), "violations but no rows of rules")
    checked = F.when(broken.isNotNull(), F.raise_error(F.concat("file", F.lit(": "), broken))).otherwise(F.col("rows"))
    flat = cards.select("runner", "t1", "t2", F.inline(checked))
    number = lambda c: F.col(c).cast("long")
    return flat.select("runner", F.col("c1").alias("rule"), number("c2").alias("baseline"), number("c3").alias("treatment"), number("c4").alias("delta"), number("t1").alias("total_baseline"), number("t2").alias("total_treatment"))


def matrix_lines(counts: DataFrame, runners: list[str] | None = None) -> DataFrame:
    """``part, k, line``: rows of the matrix's two tables, totals (1) and rules (2), to be ordered by part and k."""
    counts = cut_lineage(counts)
    return _matrix_lines(counts, sc.runners_of(counts) if runners is None else runners)


def _matrix_lines(counts: DataFrame, runners: list[str]) -> DataFrame:
    total = sc.total_rows(counts).where(F.col("runner").isin(runners))
    totals = total.select(F.lit(1).alias("part"), F.col("runner").alias("k"), F.concat(F.lit("| "), F.concat_ws(" | ", "runner", F.col("baseline").cast("string"), F.col("treatment").cast("string"), sc.signed(F.col("delta")), "pct"), F.lit(" |")).alias("line"))
    rules = sc.matrix(sc.rule_rows(counts), runners)
    rows = rules.select(F.lit(2).alias("part"), F.col("rule").alias("k"), F.concat(F.lit("| "), F.concat_ws(" | ", "rule", *[F.col(f"`{r}`") for r in runners]), F.lit(" |")).alias("line"))
    return totals.unionByName(rows)


def render_matrix(counts: DataFrame, runners: list[str] | None, version: str, cards: DataFrame | None = None, date: str | Column = "") -> DataFrame:
    """``text``: the matrix as one Markdown text; its size depends on the numbers of runners and rules only. Without
    ``runners`` those found in the data are shown; ``date`` is as in scorecards.

    With ``cards`` (``file, text`` of scorecards) a folded part follows with each runner's card without its title.
    """
    counts = cut_lineage(counts)
    runners = sc.runners_of(counts) if runners is None else runners
    date = utc_date(date) if isinstance(date, Column) else F.lit(date)
    lines = _matrix_lines(counts, runners)
    if cards is not None:
        body = F.regexp_replace(F.regexp_replace("text", r"\A# [^\n]*\n+", ""), r"\s+\z", "")
        detail = cards.select(F.regexp_replace("file", r"\.md$", "").alias("k"), body.alias("line")).where(F.col("k").isin(runners))
        lines = lines.unionByName(detail.select(F.lit(3).alias("part"), "k", F.concat(F.lit("### "), "k", F.lit("\n\n"), "line", F.lit("\n")).alias("line")))
    lines = lines.agg(F.sort_array(F.collect_list(F.struct("part", "k", "line"))).alias("all"))
    part = lambda n: F.array_join(F.transform(F.filter("all", lambda x: x["part"] == n), lambda x: x["line"]), "\n")
    head = F.concat(F.lit(f"# Benchmark v{version} (matrix)\n\n- Models compared: {len(runners)}\n- Date: "), date, F.lit("\n\n## Totals\n\n| Model | Baseline | Treatment | Δ | Δ% |\n|---|---|---|---|---|\n"))
    middle = f"\n\n## Per-rule Δ (treatment − baseline)\n\n| Rule | {' | '.join(runners)} |\n|---|{'---|' * len(runners)}\n"
    folded = [] if cards is None else [F.lit("\n\n<details>\n<summary><b>Detail by model</b></summary>\n\n"), part(3), F.lit("\n</details>")]
    return lines.select(F.concat(head, part(1), F.lit(middle), part(2), *folded, F.lit("\n\n_Numbers are directional._\n")).alias("text"))
