"""Totals by rule of five texts with known faults: plain, line faults, paragraph faults, both, and Markdown around them."""

from inkstone.operators.audit import audit, rule_results

PLAIN = """# Notes on a River

The river rises in the hills; it runs south for ninety miles. A well-kept path follows it.

Most visitors walk the lower part. Few of them reach the spring.
"""
LINES = """Additionally, we delve into the realm of pivotal ideas and foster a deep dive.

We leverage a novel approach, and the team will utilize and underscore it. This may, furthermore, bolster the plan.

It's a vast paradigm shift — it doesn't stop, and we'll embrace the state of the art and push the envelope.

The committee met in the old town hall on the first day of the week and talked about the roads, the school, the bridge, the two mills and the price of bread until it was dark.
"""
PARAGRAPHS = """The mill is old. The wheel is new. A door stands open at the end of the day.

We saw it. We left. Rain fell.

- wood
- stone

The work went on for years. Overall, it was done.
"""
BOTH = """It's a level playing field — we don't circle back on a novel realm, and we embrace it.

- one
- two

Work began in May. In summary, it went well.

Work ended in June. These changes represent a start.
"""
MARKDOWN = """---
title: x
---

# A Title in Case

| one | a table |
|---|---|

```
it's — code, and we delve
```

The call `it's — so` stays. The tests pass — all of them. Most are short.
"""
TOTALS = {
    "plain": (PLAIN, 0, {}),
    "lines": (LINES, 22, {"RULE-05": 6, "RULE-06": 10, "RULE-12": 1, "RULE-B": 1, "RULE-D": 1, "RULE-I": 3}),
    "paragraphs": (PARAGRAPHS, 5, {"RULE-05": 1, "RULE-A": 1, "RULE-C": 2, "RULE-E": 1}),
    "both": (BOTH, 11, {"RULE-05": 3, "RULE-06": 2, "RULE-A": 1, "RULE-B": 1, "RULE-E": 2, "RULE-I": 2}),
    "markdown": (MARKDOWN, 2, {"RULE-B": 1, "RULE-C": 1}),
}


def test_totals_of_known_texts(spark):
    docs = spark.createDataFrame([(k, v[0]) for k, v in TOTALS.items()], "doc_id string, text string")
    audited = audit(docs)
    found = {}
    for r in rule_results(audited).where("count > 0").collect():
        of = found.setdefault(r.doc_id, {})
        of[r.rule] = of.get(r.rule, 0) + r["count"]
    assert {k: found.get(k, {}) for k in TOTALS} == {k: v[2] for k, v in TOTALS.items()}
    assert {r.doc_id: r.total_violations for r in audited.collect()} == {k: v[1] for k, v in TOTALS.items()}
    assert rule_results(audited).where("status = 'skipped'").select("rule").distinct().count() == 13
