"""What installing or removing tools would do to projects: actions derived from requests, present files and manifests.

A plan is one tool in one project. Each mode of a request becomes steps (a file and what is to stand in it); steps meet the
present files in one join by plan and path, and a table of transitions turns (kind of step, state of the file) into an
action with hashes before and after, into nothing where the file is already right, or into a refusal. A plan with a
refusal has no other action: nothing of it would be written.

    whole     a shared file: create, owned-file-write, or nothing if the text is the same
    copy      owned-file-write, or nothing if the text is the same
    block     a marked block in a file of the user's: create, update-marker, nothing; refused if its marks are ambiguous
    signed    a signed file: owned-file-write or nothing; refused if what stands there is unsigned or was edited
    proved    a file that the plan's manifest must own: owned-file-write or nothing by canonical bytes; refused if the
              file is there without a manifest, is not listed in it, or has drifted from it
    manifest  manifest-write or nothing, by canonical bytes
    unblock, unsign, unlink   the same for removal: remove-marker and owned-file-remove
    say       something to tell: always an action

Defined results: a null text of a present file is an empty file, which has no hash before. Modes that are not known are
refused. Repeated steps of one plan stand as often as they are asked for; of a present path that is repeated the smallest
text counts. Null plans meet nothing. Empty tables give no rows; columns beside the named ones stay behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.functions import canon
from inkstone.functions.chars import let
from inkstone.functions.jsontext import pretty_json

# Operations as the action files name them.
WRITE, CREATE, REMOVE = "owned-file-write", "create", "owned-file-remove"
ACTIONS = ["plan", "order", "op", "path", "content_sha256_before", "content_sha256_after", "message"]


def _step(kind: str, path, text, op: str = "") -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(kind).alias("kind"), as_column(path).cast("string").alias("path"), F.coalesce(as_column(text).cast("string"), F.lit("")).alias("text"), F.lit(op).alias("op"))


def enable_steps(requests: DataFrame, home: str = ".inkstone") -> DataFrame:
    """``plan, step, kind, path, text, op`` of ``requests``: ``plan, install_mode, target_path, adapter_source, body`` (the
    adapter's text), ``rules`` (the shared text), ``import_line, snippet``."""
    rules = _step("whole", f"{home}/RULES.md", F.col("rules"))
    adapter = F.concat(F.lit(f"{home}/"), F.element_at(F.split("adapter_source", "/"), -1))
    target, body = F.col("target_path"), F.col("body")
    by_mode = {
        "import-marker": [_step("copy", adapter, body), _step("block", target, F.col("import_line"))],
        "append-block": [_step("block", target, body)],
        "owned-file": [_step("signed", target, body)],
        "multi-file-required": [_step("copy", target, body), _step("say", target, F.col("snippet"), "print-snippet")],
        "print-only": [_step("copy", target, body), _step("say", target, body, "print-prompt")],
    }
    steps = F.array(_step("unknown", target, ""))
    for mode, own in by_mode.items():
        steps = F.when(F.col("install_mode") == mode, F.array(rules, *own)).otherwise(steps)
    return _numbered(requests.select("plan", F.posexplode(steps).alias("step", "s")))


def disable_steps(requests: DataFrame) -> DataFrame:
    """The same for removal, from ``plan, install_mode, target_path``."""
    kinds = {"import-marker": "unblock", "append-block": "unblock", "owned-file": "unsign", "multi-file-required": "unlink", "print-only": "unlink"}
    step = _step("unknown", F.col("target_path"), "")
    for mode, kind in kinds.items():
        step = F.when(F.col("install_mode") == mode, _step(kind, F.col("target_path"), "")).otherwise(step)
    return _numbered(requests.select("plan", F.lit(0).alias("step"), step.alias("s")))


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.select("plan", F.col("step").cast("long").alias("step"), "s.*")


def _hash(text: Column) -> Column:
    return F.sha2(text, 256)


def _transition(version: str, owner: str) -> Column:
    """``op, after, refused`` from ``kind, text, have`` (null where no file is), and ``listed, declared, managed`` of manifests."""
    have, text, kind = F.col("have"), F.col("text"), F.col("kind")
    there = have.isNotNull()
    result = lambda op, after=None, refused=None: F.struct(
        (op if isinstance(op, Column) else F.lit(op)).cast("string").alias("op"), (F.lit(None) if after is None else after).cast("string").alias("after"), (F.lit(None) if refused is None else refused).cast("string").alias("refused")
    )
    unless_same = lambda op, new, same: result(F.when(~same, op), F.when(~same, new))
    same = F.coalesce(have == text, F.lit(False))

    def block(edit: Column, as_marked) -> Column:
        return let(edit, lambda e: F.when(e["action"] == "error", result(None, refused=F.lit("the marks of its block are ambiguous"))).otherwise(as_marked(e)))

    old = F.coalesce(have, F.lit(""))
    put = block(canon.upsert_block(old, version, text, owner), lambda e: unless_same(e["action"], _hash(e["text"]), e["text"] == old))
    cut = block(canon.remove_block(old, owner), lambda e: result(F.when(there & (e["action"] != "noop"), e["action"]), F.when(there & (e["action"] != "noop"), _hash(e["text"]))))
    state = canon.verify(have, owner)
    foreign = F.when(there & (state == "unsigned"), "it is not signed by its owner").when(there & (state == "mismatch"), "it was edited since it was signed")
    signed = let(canon.sign(text, version, owner), lambda s: F.when(foreign.isNotNull(), result(None, refused=foreign)).otherwise(unless_same(F.lit(WRITE), _hash(s), F.coalesce(s == have, F.lit(False)))))
    gone = F.when(there, F.lit(REMOVE))
    digest = lambda x: canon.canonical_hash(x)
    stranger = F.when(there & ~F.coalesce("managed", F.lit(False)), "no manifest lists it").when(there & F.col("declared").isNull(), "the manifest does not list it").when(there & (F.col("declared") != digest(have)), "it has drifted from the manifest")
    by_bytes = lambda op: unless_same(F.lit(op), digest(text), F.coalesce(digest(have) == digest(text), F.lit(False)))
    cases = {
        "whole": unless_same(F.when(there, WRITE).otherwise(CREATE), _hash(text), same),
        "copy": unless_same(F.lit(WRITE), _hash(text), same),
        "block": put,
        "unblock": cut,
        "signed": signed,
        "unsign": F.when(foreign.isNotNull(), result(None, refused=foreign)).otherwise(result(gone)),
        "unlink": result(gone),
        "proved": F.when(stranger.isNotNull(), result(None, refused=stranger)).otherwise(by_bytes(WRITE)),
        "manifest": by_bytes("manifest-write"),
        "say": result(F.col("op"), F.when(F.col("path") != "", _hash(text))),
        "stop": result(None, refused=text),
    }
    found = result(None, refused=F.lit("the mode is not known"))
    for name, case in cases.items():
        found = F.when(kind == name, case).otherwise(found)
    return found


def actions(steps: DataFrame, present: DataFrame, manifests: DataFrame | None = None, version: str = "1.0", owner: str = canon.OWNER) -> DataFrame:
    """``plan, order, op, path, content_sha256_before, content_sha256_after, message`` of every action, and of a refused plan
    one row with the op 'refuse', the path and why.

    ``steps`` come from the functions of this module, ``present`` is ``plan, path, text``; ``manifests`` (``plan, path,
    sha256``, with a null path for a manifest without entries) lists what earlier installations own.
    """
    files = present.select("plan", "path", F.coalesce("text", F.lit("")).alias("have")).groupBy("plan", "path").agg(F.min("have").alias("have"))
    rows = steps.join(files, ["plan", "path"], "left")
    if manifests is None:
        rows = rows.withColumn("declared", F.lit(None).cast("string")).withColumn("managed", F.lit(False))
    else:
        listed = manifests.where(F.col("path").isNotNull()).groupBy("plan", "path").agg(F.min("sha256").alias("declared"))
        rows = rows.join(listed, ["plan", "path"], "left").join(manifests.select("plan", F.lit(True).alias("managed")).distinct(), "plan", "left")
    by_bytes = F.col("kind").isin("proved", "manifest")
    before = F.when(F.col("kind") == "say", None).when(by_bytes, F.when(F.col("have").isNotNull(), canon.canonical_hash(F.col("have"))))
    blank = F.col("kind").isin("block", "signed") & (F.col("have") == "")
    before = before.when(~blank, F.when(F.col("have").isNotNull(), _hash(F.col("have"))))
    told = rows.select("plan", "step", "path", "kind", F.col("text").alias("said"), before.alias("before"), _transition(version, owner).alias("t"))
    told = told.select("plan", "step", "path", "before", "t.*", F.when((F.col("kind") == "say") & (F.col("path") == ""), F.col("said")).alias("message"))
    told = told.where(F.col("op").isNotNull() | F.col("refused").isNotNull())
    # A plan is one tool in one project: its steps stand together.
    plan = Window.partitionBy("plan").orderBy(F.col("refused").isNull(), "step", "path")
    told = told.withColumn("k", F.row_number().over(plan)).withColumn("stopped", F.max(F.col("refused").isNotNull()).over(Window.partitionBy("plan")))
    kept = told.where(~F.col("stopped") | (F.col("k") == 1))
    free = ~F.col("stopped")
    return kept.select(
        "plan", (F.col("k") - 1).cast("long").alias("order"), F.when(free, F.col("op")).otherwise("refuse").alias("op"), "path",
        F.when(free, F.col("before")).alias("content_sha256_before"), F.when(free, F.col("after")).alias("content_sha256_after"), F.when(free, F.col("message")).otherwise(F.col("refused")).alias("message"),
    )


def active_surfaces(tools: DataFrame, present: DataFrame) -> DataFrame:
    """``plan, surface``: tools (``surface, target_path``) whose target is a file of the plan's project, or a folder with files."""
    steps = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    reached = present.select("plan", F.explode(above).alias("target")).distinct()
    return reached.join(tools.select("surface", F.regexp_replace("target_path", "/+$", "").alias("target")), "target").select("plan", "surface").distinct()


def skill_steps(requests: DataFrame, groups: DataFrame, references: DataFrame, active: DataFrame, broken: DataFrame | None = None, home: str = ".inkstone", maker: str = "inkstone 1.0") -> DataFrame:
    """Steps of skills with references: the files of every target group that an active surface belongs to, their manifest,
    and a message for each active surface that no group covers.

    ``requests``: ``plan, tool, skill`` (the skill's text), ``rules, message`` (with ``{tool}``, or null for none);
    ``groups``: ``tool, target_path, surfaces``; ``references``: ``tool, path, text``, what folders are filled with;
    ``broken`` (``plan, error``) names plans whose manifest cannot be read, which are refused.
    """
    asked = requests.select("plan", "tool", "skill", "rules", "message")
    wide = asked.join(groups.select("tool", "target_path", F.explode("surfaces").alias("surface")), "tool").join(active, ["plan", "surface"])
    to_write = wide.groupBy("plan", "tool", "target_path").agg(F.sort_array(F.collect_set("surface")).alias("covered"))
    single = F.col("target_path").rlike(r"\.mdc?\z")
    skills = to_write.where(single).join(asked.select("plan", "skill"), "plan").select("plan", "tool", F.col("target_path").alias("path"), F.col("skill").alias("text"), "covered")
    filled = to_write.where(~single).join(references.select("tool", F.col("path").alias("inner"), "text"), "tool")
    filled = filled.select("plan", "tool", F.concat(F.regexp_replace("target_path", "/+$", ""), F.lit("/"), "inner").alias("path"), "text", "covered")
    files = skills.unionByName(filled)
    numbered = files.withColumn("step", F.row_number().over(Window.partitionBy("plan").orderBy("path")).cast("long"))
    proved = numbered.select("plan", "step", F.lit("proved").alias("kind"), "path", F.coalesce("text", F.lit("")).alias("text"), F.lit("").alias("op"))

    covered_plans = to_write.select("plan", "tool").distinct()
    rules = asked.join(covered_plans, ["plan", "tool"], "left_semi").select("plan", F.lit(0).cast("long").alias("step"), F.lit("whole").alias("kind"), F.lit(f"{home}/RULES.md").alias("path"), F.coalesce("rules", F.lit("")).alias("text"), F.lit("").alias("op"))
    entry = F.struct(F.col("covered").alias("covered_surfaces"), F.lit("file").alias("kind"), F.col("path"), canon.canonical_hash(F.coalesce("text", F.lit(""))).alias("sha256"))
    owned = files.groupBy("plan", "tool").agg(F.collect_list(entry).alias("e"))
    owned = covered_plans.join(owned, ["plan", "tool"], "left").withColumn("e", F.coalesce("e", F.array().cast(owned.schema["e"].dataType)))
    by_path = F.array_sort("e", lambda a, b: F.when(a["path"] < b["path"], -1).when(a["path"] > b["path"], 1).otherwise(0))
    owned = owned.select("plan", "tool", F.struct(by_path.alias("entries"), F.lit(maker).alias("generated_by"), F.lit(1).alias("schema_version"), F.col("tool")).alias("doc"))
    last = F.lit(1 << 40).cast("long")
    path = F.concat(F.lit(f"{home}/skills/"), "tool", F.lit("/manifest.json"))
    manifest = owned.select("plan", last.alias("step"), F.lit("manifest").alias("kind"), path.alias("path"), pretty_json(owned, "doc").alias("text"), F.lit("").alias("op"))

    reached = wide.select("plan", "surface").distinct()
    left = active.join(asked.where(F.col("message").isNotNull() & (F.col("message") != "")), "plan").join(reached, ["plan", "surface"], "left_anti").join(covered_plans.select("plan"), "plan", "left_semi")
    place = (F.row_number().over(Window.partitionBy("plan").orderBy("surface")) + last).cast("long")
    say = lambda rows, step, text: rows.select("plan", step.alias("step"), F.lit("say").alias("kind"), F.lit("").alias("path"), text.alias("text"), F.lit("print-message").alias("op"))
    uncovered = say(left, place, F.replace("message", F.lit("{tool}"), F.col("surface")))
    idle = say(asked.join(covered_plans, "plan", "left_anti"), F.lit(0).cast("long"), F.lit("no active surface takes this skill"))
    steps = proved.unionByName(rules).unionByName(manifest).unionByName(uncovered)
    if broken is not None:
        stop = broken.where(F.col("error").isNotNull()).join(covered_plans.select("plan"), "plan", "left_semi")
        steps = steps.unionByName(stop.select("plan", F.lit(-1).cast("long").alias("step"), F.lit("stop").alias("kind"), F.lit("").alias("path"), F.concat(F.lit("its manifest: "), "error").alias("text"), F.lit("").alias("op")))
    return steps.unionByName(idle)
