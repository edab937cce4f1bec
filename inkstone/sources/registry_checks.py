"""Faults of tool registries: every fault of every tool, where a loader would stop at the first.

A registry is a JSON object with ``schema_version`` 1 and ``tools``, an object from names to tools. Registries are rows, so
thousands are checked at once. What needs one tool is checked inside its row; that a surface is a tool which takes part
in no skill mode, and that target paths of a tool stay apart when they are normalised, is found by joins and windows over
the exploded groups, shuffled by registry and surface, and by registry, tool and path.

Defined results: a field whose value is JSON null is there, as in other readers of JSON. A null text has the fault "no
JSON"; an empty one too. Repeated registries (rows of one key) are checked as one registry each. An empty table gives no
rows. Columns beside the key and the text stay behind. Two tools of one name, or other repeated keys, are no JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.runtime import cut_lineage

# Fields by kind of mode, in the order in which they are told.
PLAIN_MODES = ["append-block", "import-marker", "multi-file-required", "owned-file", "print-only"]
SKILL_MODES = ["skill-with-references"]
PLAIN_FIELDS = ["adapter_source", "install_mode", "load_class", "target_path"]
SKILL_FIELDS = ["install_mode", "manual_step_message", "references_source", "skill_source", "target_groups"]
OUTPUT = ["registry", "tool", "place", "fault"]


def _kind(value: Column, path: str = "$") -> Column:
    """First word of a variant's type: OBJECT, ARRAY, STRING, BIGINT, VOID and so on; null where nothing stands."""
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(value, path, "variant")), "^[A-Z]+", 0)


def _text(value: Column, path: str = "$") -> Column:
    """A string value; null for other kinds."""
    return F.when(_kind(value, path) == "STRING", F.try_variant_get(value, path, "string"))


def _is(value: Column, kind: str, path: str = "$") -> Column:
    return F.coalesce(_kind(value, path) == kind, F.lit(False))


def parsed(registries: DataFrame, key: str = "registry", text_col: str = "text") -> DataFrame:
    """``row, registry, whole``: each text as a variant, null where it is no JSON."""
    rows = registries.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("registry"), F.col(f"`{text_col}`").alias("text"))
    rows = cut_lineage(rows)  # row numbers meet in joins, so they must not be dealt out anew
    return rows.select("row", "registry", F.try_parse_json("text").alias("whole"))


def registry_level_faults(rows: DataFrame) -> DataFrame:
    """``row, registry, fault`` of registries that hold no tools to check."""
    whole = F.col("whole")
    version = F.try_variant_get(whole, "$.schema_version", "string")
    fault = (
        F.when(whole.isNull(), "no JSON")
        .when(~_is(whole, "OBJECT"), "no object")
        .when(F.coalesce(version, F.lit("")) != "1", F.concat(F.lit("schema_version is "), F.coalesce(version, F.lit("missing")), F.lit(", not 1")))
        .when(~_is(whole, "OBJECT", "$.tools"), "tools is no object")
    )
    return rows.select("row", "registry", fault.alias("fault"))


def tools_of(rows: DataFrame) -> DataFrame:
    """``row, registry, tool, spec, mode, fields`` of registries without a fault of their own."""
    sound = rows.join(registry_level_faults(rows).where(F.col("fault").isNull()).select("row"), "row", "left_semi")
    tools = sound.select("row", "registry", F.explode(F.try_variant_get("whole", "$.tools", "map<string,variant>")).alias("tool", "spec"))
    fields = F.map_keys(F.try_variant_get("spec", "$", "map<string,variant>"))
    return tools.select("row", "registry", "tool", "spec", _text(F.col("spec"), "$.install_mode").alias("mode"), F.coalesce(fields, F.array().cast("array<string>")).alias("fields"))


def _mode_faults() -> Column:
    """The faults of a tool's mode and fields, in order."""
    fields, mode = F.col("fields"), F.coalesce("mode", F.lit(""))
    names = lambda x: F.array(*[F.lit(n) for n in x]).cast("array<string>")
    told = lambda what, found: F.transform(found, lambda n: F.concat(F.lit(f"{what} "), n))
    both = lambda needs, bars: F.concat(told("misses", F.array_except(names(needs), fields)), told("must not have", F.array_intersect(names(bars), fields)))
    one = lambda text: F.array(F.lit(text))
    return (
        F.when(~_is(F.col("spec"), "OBJECT"), one("is no object"))
        .when(~F.array_contains(fields, "install_mode"), one("misses install_mode"))
        .when(mode.isin(PLAIN_MODES), both(PLAIN_FIELDS, [f for f in SKILL_FIELDS if f != "install_mode"]))
        .when(mode.isin(SKILL_MODES), both(SKILL_FIELDS, [f for f in PLAIN_FIELDS if f != "install_mode"]))
        .otherwise(one("has an unknown install_mode"))
    )


def groups_of(tools: DataFrame) -> DataFrame:
    """``row, registry, tool, g, group, target, parts``: the target groups of skill tools; ``parts`` without empty ones and dots."""
    skills = tools.where(F.col("mode").isin(SKILL_MODES))
    groups = skills.select("row", "registry", "tool", F.posexplode(F.try_variant_get("spec", "$.target_groups", "array<variant>")).alias("g", "group"))
    groups = groups.withColumn("target", _text(F.col("group"), "$.target_path"))
    steps = F.split(F.replace(F.col("target"), F.lit("\\"), F.lit("/")), "/")
    return groups.withColumn("parts", F.filter(steps, lambda p: ~p.isin("", ".")))


def _group_faults() -> Column:
    """The faults of one target group apart from other rows."""
    group, target = F.col("group"), F.col("target")
    whole = _is(group, "OBJECT") & _kind(group, "$.target_path").isNotNull() & _kind(group, "$.surfaces").isNotNull()
    surfaces = F.try_variant_get(group, "$.surfaces", "array<variant>")
    path = (
        F.when(F.coalesce(target, F.lit("")) == "", "target_path is no text")
        .when(target.startswith("/"), "target_path is absolute")
        .when(F.substring(target, 2, 1) == ":", "target_path names a drive")
        .when(F.array_contains("parts", ".."), "target_path leaves the folder")
    )
    listed = F.when(~_is(group, "ARRAY", "$.surfaces") | (F.size(surfaces) == 0), "surfaces is no list with entries")
    return F.when(whole, F.filter(F.array(path, listed), lambda x: x.isNotNull())).otherwise(F.array(F.lit("needs target_path and surfaces")))


def _surfaces_of(groups: DataFrame) -> DataFrame:
    listed = groups.where(_is(F.col("group"), "ARRAY", "$.surfaces"))
    rows = listed.select("row", "registry", "tool", "g", F.posexplode(F.try_variant_get("group", "$.surfaces", "array<variant>")).alias("s", "v"))
    return rows.withColumn("surface", F.coalesce(_text(F.col("v")), F.lit("")))


def registry_faults(registries: DataFrame, key: str = "registry", text_col: str = "text") -> DataFrame:
    """``registry, tool, place, fault``: a row for each fault; ``tool`` and ``place`` (as ``target_groups[0].surfaces[1]``)
    are null where the fault is the registry's or the tool's."""
    rows = parsed(registries, key, text_col)
    tools = tools_of(rows)
    groups = groups_of(tools)
    surfaces = _surfaces_of(groups)
    none = F.lit(None).cast("string")
    at = F.format_string("target_groups[%d]", "g")
    within = F.concat(at, F.format_string(".surfaces[%d]", "s"))

    own = registry_level_faults(rows).where(F.col("fault").isNotNull()).select("registry", none.alias("tool"), none.alias("place"), "fault")
    by_mode = tools.select("registry", "tool", none.alias("place"), F.explode(_mode_faults()).alias("fault"))
    no_groups = tools.where(F.col("mode").isin(SKILL_MODES) & F.array_contains("fields", "target_groups") & (~_is(F.col("spec"), "ARRAY", "$.target_groups") | (F.size(F.try_variant_get("spec", "$.target_groups", "array<variant>")) == 0)))
    no_groups = no_groups.select("registry", "tool", F.lit("target_groups").alias("place"), F.lit("is no list with entries").alias("fault"))
    in_group = groups.select("registry", "tool", at.alias("place"), F.explode(_group_faults()).alias("fault"))

    norm = F.array_join("parts", "/")
    first = F.min("g").over(Window.partitionBy("row", "tool", norm))
    apart = groups.where(F.coalesce("target", F.lit("")) != "").withColumn("first", first).where(F.col("first") < F.col("g"))
    apart = apart.select("registry", "tool", at.alias("place"), F.format_string("target_path is that of target_groups[%d]", "first").alias("fault"))

    no_text = surfaces.where("surface = ''").select("registry", "tool", within.alias("place"), F.lit("is no text").alias("fault"))
    hosts = tools.where(F.col("mode").isin(PLAIN_MODES)).select("row", F.col("tool").alias("surface"))
    unknown = surfaces.where("surface <> ''").join(hosts, ["row", "surface"], "left_anti")
    unknown = unknown.select("registry", "tool", within.alias("place"), F.concat(F.lit("names no tool that takes skills: "), "surface").alias("fault"))

    found = own
    for more in (by_mode, no_groups, in_group, apart, no_text, unknown):
        found = found.unionByName(more)
    return found.select(*OUTPUT)
