"""Registries of tools and manifests of written files.

Defined results: empty tables give empty results; repeated rows join and count as often as they stand; a null key meets
no other. Columns beside the named ones are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstone.functions import canon

# The ways a tool takes a rule file in.
MODES = ["import-marker", "append-block", "owned-file", "multi-file-required", "print-only", "skill-with-references"]
TOOL = "name string, install_mode string, target_path string, adapter_source string, load_class string, target_groups array<struct<target_path:string,surfaces:array<string>>>"
REGISTRY = f"schema_version int, tools array<struct<{TOOL.replace(' string', ':string').replace('target_groups array', 'target_groups:array')}>>"


def read_tools(spark: SparkSession, path: str) -> DataFrame:
    """One row per tool of a registry file ``{"schema_version": 1, "tools": [...]}``; another version is an error."""
    rows = spark.read.schema(REGISTRY).json(path, multiLine=True)
    checked = F.when(F.col("schema_version") == 1, F.col("tools")).otherwise(F.raise_error(F.lit("unknown schema_version")).cast(rows.schema["tools"].dataType))
    return rows.select(F.inline(checked))


def check_tools(tools: DataFrame, required: dict[str, list[str]], forbidden: dict[str, list[str]]) -> DataFrame:
    """``name, missing, unwanted``: fields that a tool's mode requires or forbids."""
    fields = [f.name for f in tools.schema.fields if f.name not in ("name", "install_mode")]
    present = F.filter(F.array(*[F.when(F.col(f).isNotNull(), f) for f in fields]), lambda x: x.isNotNull())

    def by_mode(table: dict[str, list[str]]):
        rules = F.create_map(*[x for mode, names in table.items() for x in (F.lit(mode), F.array(*map(F.lit, names)).cast(T.ArrayType(T.StringType())))])
        return F.coalesce(F.try_element_at(rules, F.col("install_mode")), F.array().cast("array<string>"))

    return tools.select("name", F.array_except(by_mode(required), present).alias("missing"), F.array_intersect(by_mode(forbidden), present).alias("unwanted"))


def drift(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """``path, state``: 'unchanged', 'drifted' (other bytes), 'missing' (listed only) or 'unlisted' (present only)."""
    files = present.select("path", canon.canonical_hash(F.col("text")).alias("actual"))
    both = manifest.select("path", F.col("sha256").alias("declared")).join(files, "path", "full_outer")
    state = F.when(F.col("actual").isNull(), "missing").when(F.col("declared").isNull(), "unlisted").when(F.col("actual") == F.col("declared"), "unchanged").otherwise("drifted")
    return both.select("path", state.alias("state"))


def coverage(targets: DataFrame, covered: DataFrame) -> DataFrame:
    """``tool, active, served, uncovered``: sorted surfaces of each tool, those that are covered and those that are not;
    of a tool without a row of cover, or a null one, none is covered."""
    rows = targets.join(covered, "tool", "left").withColumn("covered", F.coalesce("covered", F.array().cast("array<string>")))
    text = lambda x: F.array_join(F.array_sort(x), ",")
    return rows.select("tool", text(F.col("active")).alias("active"), text(F.array_intersect("active", "covered")).alias("served"), text(F.array_except("active", "covered")).alias("uncovered"))


def actions_json(actions: DataFrame) -> DataFrame:
    """``plan, actions_json``: all actions of each plan as JSON with sorted keys, ordered by path, op and order; a null is
    written as null. A plan is one tool's installation, so its actions fit in a row."""
    ordered = F.sort_array(F.collect_list(F.struct("path", "op", F.col("order").alias("place"), "content_sha256_after", "content_sha256_before")))
    out = F.transform("a", lambda x: F.struct(x["content_sha256_after"].alias("content_sha256_after"), x["content_sha256_before"].alias("content_sha256_before"), x["op"].alias("op"), x["place"].alias("order"), x["path"].alias("path")))
    return actions.groupBy("plan").agg(ordered.alias("a")).select("plan", F.to_json(out, {"ignoreNullFields": "false"}).alias("actions_json"))


def manifest_errors(files: DataFrame, key: str = "file") -> DataFrame:
    """``key, error``: the first fault of each manifest text, null for a sound one.

    Sound is a JSON object whose ``entries`` is a list of objects, each with a ``path`` (a string, not empty), the
    ``kind`` "file" and a ``sha256`` of 64 lowercase hex digits; entries count from 0. A null text is sound: no manifest.
    """
    whole = F.try_parse_json("text")
    kind = lambda v, path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    string = lambda e, name: F.when(kind(e, f"$.{name}") == "STRING", F.try_variant_get(e, f"$.{name}", "string"))

    def fault(e: Column, k: Column) -> Column:
        found = (
            F.when(e.isNull() | ~F.coalesce(F.schema_of_variant(e).startswith("OBJECT"), F.lit(False)), "is no object")
            .when(F.coalesce(string(e, "path"), F.lit("")) == "", "has no path")
            .when(F.coalesce(string(e, "kind"), F.lit("")) != "file", "has another kind than file")
            .when(~F.coalesce(string(e, "sha256"), F.lit("")).rlike(r"\A[0-9a-f]{64}\z"), "has no valid sha256")
        )
        return F.when(found.isNotNull(), F.concat(F.lit("entry "), k.cast("string"), F.lit(" "), found))

    rows = files.select(key, "text", whole.alias("v")).select(key, "text", "v", F.try_variant_get("v", "$.entries", "array<variant>").alias("entries"))
    faults = F.filter(F.transform("entries", fault), lambda x: x.isNotNull())
    error = (
        F.when(F.col("text").isNull(), None)
        .when(F.col("v").isNull(), "no JSON")
        .when(~F.schema_of_variant("v").startswith("OBJECT"), "no object")
        .when(~F.coalesce(kind(F.col("v"), "$.entries").startswith("ARRAY"), F.lit(False)), "entries is no list")
        .otherwise(F.get(faults, F.lit(0)))
    )
    return rows.select(key, error.alias("error"))


def _with_folders(paths: DataFrame, *keep: str) -> DataFrame:
    """``paths`` once for each path and each folder above it, so that folders meet their files by equality."""
    steps = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    return paths.select(*keep, F.explode(above).alias("target"))


def uncovered_targets(targets: DataFrame, present: DataFrame, manifest: DataFrame) -> DataFrame:
    """``tool, target_path``: targets that exist (a file, or a folder with files in it) without an entry in the manifest.

    ``present`` and ``manifest`` list the ``path`` of files. The folders of many files combine before they shuffle. A
    trailing slash of a target does not count.
    """
    wanted = targets.select("tool", "target_path", F.regexp_replace("target_path", "/+$", "").alias("target"))
    reached = lambda files: _with_folders(files).distinct()
    return wanted.join(reached(present), "target", "left_semi").join(reached(manifest), "target", "left_anti").select("tool", "target_path")


def output_states(expected: DataFrame, present: DataFrame) -> DataFrame:
    """``path, state`` of every expected file: 'current', 'out of date' (other bytes) or 'missing'. Hashes are compared,
    so that no text is shuffled."""
    digest = lambda files, name: files.select("path", F.sha2(F.coalesce("text", F.lit("")), 256).alias(name))
    both = digest(expected, "want").join(digest(present, "have"), "path", "left")
    return both.select("path", F.when(F.col("have").isNull(), "missing").when(F.col("have") == F.col("want"), "current").otherwise("out of date").alias("state"))
