"""The rule catalogue: 21 rules in file order, their severities, and which kinds of detector each has."""

from __future__ import annotations

# Rule, severity, kinds of detector (m: per line, s: per paragraph or list, j: needs a judge).
CATALOGUE = [
    ("RULE-01", "critical", "j"),
    ("RULE-02", "high", "sj"),
    ("RULE-03", "high", "j"),
    ("RULE-04", "high", "j"),
    ("RULE-05", "high", "mj"),
    ("RULE-06", "medium", "mj"),
    ("RULE-07", "medium", "s"),
    ("RULE-08", "high", "j"),
    ("RULE-09", "medium", "s"),
    ("RULE-10", "medium", "s"),
    ("RULE-11", "medium", "j"),
    ("RULE-12", "high", "m"),
    ("RULE-A", "medium", "s"),
    ("RULE-B", "medium", "m"),
    ("RULE-C", "medium", "s"),
    ("RULE-D", "medium", "m"),
    ("RULE-E", "medium", "s"),
    ("RULE-F", "medium", "j"),
    ("RULE-G", "low", "m"),
    ("RULE-H", "critical", "j"),
    ("RULE-I", "low", "m"),
]
KINDS = {"m": "mechanical", "s": "structural", "j": "semantic"}
#: Paragraph rules that are listed without a detector.
DEFERRED = ("RULE-02", "RULE-07", "RULE-09", "RULE-10")


def results() -> list[tuple[int, str, str, str]]:
    """(place, rule, severity, detector) of the 24 results of an audit, in order."""
    rows = [(rule, severity, KINDS[k]) for rule, severity, kinds in CATALOGUE for k in kinds]
    return [(i, *row) for i, row in enumerate(rows, 1)]


def note(rule: str, detector: str, mechanical_only: bool, judge: bool) -> str | None:
    """Why a result is skipped; None for a result that runs."""
    if detector == "semantic":
        if judge and not mechanical_only:
            return "semantic detection is left to the judge that hosts the audit"
        return "semantic detectors need a judge; run the audit inside a host that has one"
    if detector == "structural":
        if mechanical_only:
            return "structural detectors disabled (--mechanical-only)"
        if rule in DEFERRED:
            return f"structural detector for {rule} is deferred to a future release"
    return None
