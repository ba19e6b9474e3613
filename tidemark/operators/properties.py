"""Properties of projects as their files write them: the chain of property files above a project, nearest last."""

from __future__ import annotations

from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .safety import sdk_runner

# The properties that are read, the names of files and elements, and the name that the SDK's runner goes by.
PROPERTIES = (
    "UseMicrosoftTestingPlatformRunner",
    "TestingPlatformDotnetTestSupport",
    "EnableMSTestRunner",
    "EnableNUnitRunner",
    "IsTestProject",
    "OutputType",
    "TargetFramework",
    "TargetFrameworks",
    "UsingMicrosoftNETSdkTest",
)
PROPS_FILE = "Directory.Build.props"
GROUP = "PropertyGroup"
SDK_FILE = "global.json"
SDK_RUNNER = "GlobalJsonTestRunner"

_SETTINGS = "array<struct<name:string,value:string>>"


def _local(tag: object) -> str:
    """A tag without its namespace; comments and instructions have none."""
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def _settings(text: str | None, wanted: frozenset[str]) -> list[dict[str, str]]:
    try:
        document = ElementTree.fromstring(text or "")
    except (ElementTree.ParseError, ValueError):
        return []
    found: dict[str, str] = {}
    for group in document.iter():
        if _local(group.tag) == GROUP:
            found |= {_local(e.tag): "".join(e.itertext()).strip() for e in group if _local(e.tag) in wanted}
    return [{"name": n, "value": v} for n, v in found.items()]


def written_settings(text: Column, names: tuple[str, ...] = PROPERTIES) -> Column:
    """(name, value) of every named property that an XML text sets in a property group at any depth, its last value.

    Namespaces, attributes and conditions aren't minded; values are trimmed, and an empty one is a value. A text that is
    null or not well-formed sets nothing.
    """
    wanted = frozenset(names)

    @F.pandas_udf(_SETTINGS)
    def read(texts: pd.Series) -> pd.Series:
        return pd.Series([_settings(t, wanted) for t in texts], dtype=object)

    return read(text)


def folders_above(path: Column) -> Column:
    """The folders that hold a path, from the root ('') down."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.concat_ws("/", F.slice(parts, F.lit(1), n)))


def property_chain(projects: DataFrame, files: DataFrame, names: tuple[str, ...] = PROPERTIES) -> DataFrame:
    """A10: (root, project, name, value) of what a project's files say, the nearest file that sets a property winning.

    `projects`: root, path; `files`: root, path, text; paths are relative to their repository's root and separated by `/`.
    First come the property files of the folders from the root down, then the project's own file. The runner of the
    root's SDK file is told under a name of its own. A project that is listed twice is told once; a project without
    any setting, and one whose path is null, has no row.

    A file is parsed once, however many projects are below it; what it sets joins projects by (root, folder).
    """
    asked = projects.select("root", F.col("path").alias("project")).where("project IS NOT NULL").distinct()
    folder = F.regexp_replace(F.concat(F.lit("/"), "path"), "/[^/]*$", "")
    above = files.where((F.col("path") == PROPS_FILE) | F.endswith("path", F.lit("/" + PROPS_FILE))).select(
        "root", F.substring(folder, 2, 1 << 30).alias("folder"), written_settings(F.col("text"), names).alias("settings")
    )
    chained = asked.select("root", "project", F.posexplode(folders_above(F.col("project"))).alias("depth", "folder"))
    inherited = chained.join(above, ["root", "folder"]).select("root", "project", "depth", "settings")
    own = files.withColumnRenamed("path", "project").join(asked, ["root", "project"], "left_semi")
    # Deeper than any folder above it.
    own = own.select(
        "root", "project", F.size(F.split("project", "/")).alias("depth"), written_settings(F.col("text"), names).alias("settings")
    )
    each = inherited.unionByName(own).select("root", "project", "depth", F.inline("settings"))
    nearest = each.groupBy("root", "project", "name").agg(F.max_by("value", "depth").alias("value"))
    runners = files.where(F.col("path") == SDK_FILE).select("root", sdk_runner(F.col("text")).alias("value")).where("value IS NOT NULL")
    told = asked.join(runners, "root").select("root", "project", F.lit(SDK_RUNNER).alias("name"), "value")
    return nearest.unionByName(told)
