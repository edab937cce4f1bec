"""Audit and comparison of documents.

An audit gives 24 rule results for every document. Everything up to the flat results happens inside a row, so auditing a
table needs no shuffle; only the sums over documents do, and they combine before it.

Defined results: a null text is an empty one and has 24 results without violations. Rows that repeat are audited as rows
of their own; ``compare`` sums rows of one key. Extra columns are kept under their names, whatever they are; a column of
the caller's gives way where a result has a column of its name: ``rule_results`` and ``total_violations`` of an audit,
``place`` to ``violations`` of flat results, and those of single violations. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions.jsontext import pretty_json
from inkstone.operators.detectors import VIOLATION, all_detectors, marked
from inkstone.operators.rules import note, results
from inkstone.operators.structure import with_open_text, with_structure


def _found(rule: str) -> str:
    return f"__{rule}"


def results_column(mechanical_only: bool = False, judge: bool = False, severities: dict[str, str] | None = None, rules: list[str] | None = None, counts_only: bool = False, skipped_only: bool = False) -> Column:
    """The results of a document whose violations stand in a column per rule, as an array in catalogue order.

    Each violation column is used more than once here, so the optimizer leaves the detectors in a projection of their
    own: expressions stay shallow and every detector runs once.
    """
    rows = []
    for place, rule, severity, detector in results():
        why = note(rule, detector, mechanical_only, judge)
        if (rules is not None and rule not in rules) or (skipped_only and why is None):
            continue
        violations = F.array().cast(VIOLATION) if why is not None else F.col(f"`{_found(rule)}`")
        n = F.lit(0) if why is not None else violations if counts_only else F.size(violations)
        status = F.lit("skipped") if why is not None else F.when(n > 0, "violation").otherwise("ok")
        told = [] if counts_only else [violations.alias("violations")]
        rows.append(
            F.struct(
                F.lit(place).alias("place"), F.lit(rule).alias("rule"), F.lit((severities or {}).get(rule, severity)).alias("severity"), F.lit(detector).alias("detector"),
                status.alias("status"), n.alias("count"), F.lit(why or "").alias("note"), *told,
            )
        )
    return F.array(*rows)


def audit(
    docs: DataFrame, text_col: str = "text", mechanical_only: bool = False, judge: bool = False, audit_only: bool = True, severities: dict[str, str] | None = None,
    rules: list[str] | None = None, counts_only: bool = False, skipped_only: bool = False,
) -> DataFrame:
    """``docs`` without its text, with ``rule_results`` and ``total_violations``. ``audit_only`` changes nothing.

    ``rules`` names the rules to audit, ``skipped_only`` keeps the results that need no detector; what is not asked for is
    not in the plan. With ``counts_only`` results have no ``violations``, and detectors count in place of telling where.
    """
    keys = [c for c in docs.columns if c not in (text_col, "rule_results", "total_violations")]
    detected = {} if skipped_only else all_detectors(mechanical_only, rules, counts_only)
    # The caller's columns travel in a struct, so none of theirs meets one of ours.
    row = F.struct(F.lit(0).alias("__none"), *[F.col(f"`{c}`") for c in keys]).alias("__row")
    kept = docs.select(row, F.col(f"`{text_col}`").alias("__text"))
    if counts_only:
        kept = with_open_text(kept, "__text").withColumn("marked", marked(F.col("clear")))
    found = with_structure(kept, "__text").select("__row", *[column.alias(_found(rule)) for (rule, _), column in detected.items()])
    count = (lambda c: c) if counts_only else F.size
    total = sum((count(F.col(f"`{_found(rule)}`")) for rule, _ in detected), F.lit(0))
    told = results_column(mechanical_only, judge, severities, rules, counts_only, skipped_only)
    return found.select(*[F.col(f"__row.`{c}`").alias(c) for c in keys], told.alias("rule_results"), total.alias("total_violations"))


RESULT = ["place", "rule", "severity", "detector", "status", "count", "note", "violations"]
SINGLE = ["rule", "severity", "detector", "ordinal", "line", "column", "excerpt", "detail"]


def _callers(audited: DataFrame, own: list[str]) -> list[Column]:
    """The caller's columns that keep their names beside ``own`` ones."""
    return [F.col(f"`{c}`") for c in audited.columns if c not in ("rule_results", "total_violations", *own)]


def rule_results(audited: DataFrame) -> DataFrame:
    """24 rows per document."""
    # The outer form: for the other one the optimizer adds a filter on the array's size, which runs every detector again.
    return audited.select(*_callers(audited, RESULT), F.inline_outer("rule_results"))


def violations(audited: DataFrame) -> DataFrame:
    """One row per violation, with its place in its result."""
    # Callers' columns travel in a struct: some are named like a column of the results and stay here.
    row = F.struct(F.lit(0).alias("__none"), *_callers(audited, SINGLE)).alias("__row")
    hit = audited.select(row, F.inline_outer("rule_results")).where("status = 'violation'")
    flat = hit.select("__row", "rule", "severity", "detector", F.posexplode("violations").alias("at", "v"))
    kept = [F.col(f"__row.`{c}`") for c in flat.schema["__row"].dataType.names[1:]]
    return flat.select(*kept, "rule", "severity", "detector", (F.col("at") + 1).alias("ordinal"), "v.*")


def compare(a: DataFrame, b: DataFrame, key: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``key, rule, a, b, delta`` for each pair of texts with equal keys; mechanical rules unless told otherwise.

    Both sides are audited in one plan and summed by pair and rule, so a pair costs one shuffle of 21 small rows and no
    join. A key that only one side has counts as zero on the other. The key's column must not be named like a result.
    """
    if key in ("rule", "a", "b", "delta"):
        raise ValueError(f"a key cannot be named {key}")
    options = {"mechanical_only": True, "counts_only": True} | options
    texts = lambda rows, side: rows.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text_col}`").alias("text"), F.lit(side).alias("__side"))
    flat = rule_results(audit(texts(a, 0).unionByName(texts(b, 1)), **options))
    side = lambda s: F.coalesce(F.sum(F.when(F.col("__side") == s, F.col("count"))), F.lit(0))
    summed = flat.groupBy("__key", "rule").agg(side(0).alias("a"), side(1).alias("b"))
    return summed.select(F.col("__key").alias(key), "rule", "a", "b", (F.col("b") - F.col("a")).alias("delta"))


def compare_totals(compared: DataFrame, key: str = "doc_id") -> DataFrame:
    return compared.groupBy(key).agg(F.sum("a").alias("total_a"), F.sum("b").alias("total_b"))


def _review(file: Column, source: str) -> Column:
    """The audit as a struct for printing. Fields stand in the order of their names."""
    rows = F.transform(
        "rule_results",
        lambda r: F.struct(
            r["count"].alias("count"), r["detector"].alias("detector"), r["note"].alias("note"), r["rule"].alias("rule"), r["severity"].alias("severity"), r["status"].alias("status"),
            F.transform(r["violations"], lambda v: F.struct(v["column"].alias("column"), v["detail"].alias("detail"), v["excerpt"].alias("excerpt"), v["line"].alias("line"))).alias("violations"),
        ),
    )
    return F.struct(F.lit("review").alias("command"), file.alias("file"), rows.alias("rule_results"), F.lit(source).alias("rules_source"), F.col("total_violations"))


def canonical_json(audited: DataFrame, file: Column, source: str = "package-bundle") -> DataFrame:
    """``review_json``: the audit as JSON in one line, with sorted keys."""
    return audited.select(*_callers(audited, ["review_json"]), F.to_json(_review(file, source)).alias("review_json"))


def review_text(audited: DataFrame, file: Column, source: str = "package-bundle") -> DataFrame:
    """``review_text``: the audit as indented JSON with sorted keys and a line end, as the command line prints it."""
    row = F.struct(F.lit(0).alias("__none"), *_callers(audited, ["review_text"])).alias("__row")
    whole = audited.select(row, _review(file, source).alias("__review"))
    kept = [F.col(f"__row.`{c}`") for c in whole.schema["__row"].dataType.names[1:]]
    return whole.select(*kept, pretty_json(whole, "__review").alias("review_text"))


def compare_text(compared: DataFrame, file_a: Column, file_b: Column, key: str = "doc_id", source: str = "package-bundle") -> DataFrame:
    """``key, compare_text``: each pair's comparison as indented JSON; ``file_a`` and ``file_b`` are expressions of the key."""
    delta = F.struct("rule", F.struct("a", "b", "delta"))
    sums = compared.groupBy(key).agg(F.map_from_entries(F.collect_list(delta)).alias("__rules"), F.sum("a").alias("__a"), F.sum("b").alias("__b"))
    whole = sums.select(key, F.struct(
        F.lit("review-compare").alias("command"), file_a.alias("file_a"), file_b.alias("file_b"), F.col("__rules").alias("per_rule_delta"), F.lit(source).alias("rules_source"),
        F.col("__a").alias("total_a"), F.col("__b").alias("total_b"),
    ).alias("__review"))
    return whole.select(key, pretty_json(whole, "__review").alias("compare_text"))


def human_report(audited: DataFrame, file: Column, first: int = 5) -> DataFrame:
    """``report``: total, the first violations of each rule, and how many results were skipped."""

    def rule(r: Column) -> Column:
        head = F.format_string("  %s [%s, %s]: %d\n", r["rule"], r["severity"], r["detector"], r["count"])
        shown = F.transform(F.slice(r["violations"], 1, first), lambda v: F.format_string("    L%d:C%d  %s\n", v["line"], v["column"], v["detail"]))
        return F.concat(head, F.array_join(shown, ""))

    hit = F.filter("rule_results", lambda r: r["status"] == "violation")
    skipped = F.size(F.filter("rule_results", lambda r: r["status"] == "skipped"))
    tail = F.when(skipped > 0, F.format_string("  (%d rule(s) skipped; they need a judge)\n", skipped)).otherwise("")
    text = F.concat(F.format_string("review %s: %d violation(s)\n", file, F.col("total_violations")), F.array_join(F.transform(hit, rule), ""), tail)
    return audited.select(*_callers(audited, ["report"]), text.alias("report"))
