"""Test results (TRX), run ledgers (JSON lines), and fragment tables, both in published versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import qualify_test_name, short_hash
from ..plans.workdir import CODEC, dropped, written
from ..schemas import LEDGER_ROWS, RUNS
from .versions import Versions

FORMAT = 9
_TRX = (
    "TestDefinitions struct<UnitTest: array<struct<_id: string, TestMethod: struct<_className: string, _name: string>>>>, "
    "Results struct<UnitTestResult: array<struct<_testId: string, _testName: string, _outcome: string>>>"
)


def parse_trx(texts: DataFrame, project: str = "project", text_col: str = "text") -> DataFrame:
    """(project, test, result) of TRX documents; a result without a definition goes by its own name.

    Broken documents give no rows.
    """
    plain = F.regexp_replace(F.col(text_col), r'\sxmlns="[^"]*"', "")
    parsed = texts.select(project, F.from_xml(plain, _TRX, {"mode": "PERMISSIVE"}).alias("x"))
    results = parsed.select(project, F.explode("x.Results.UnitTestResult").alias("r"))
    defined = parsed.select(project, F.explode("x.TestDefinitions.UnitTest").alias("d")).select(
        project,
        F.col("d._id").alias("id"),
        qualify_test_name(F.col("d.TestMethod._className"), F.col("d.TestMethod._name")).alias("name"),
    )
    named = results.select(project, F.col("r._testId").alias("id"), F.col("r._testName").alias("own"), F.col("r._outcome").alias("result"))
    return named.join(defined.dropDuplicates([project, "id"]), [project, "id"], "left").select(
        project, F.coalesce("name", "own").alias("test"), "result"
    )


def _parse_runs(lines: DataFrame) -> DataFrame:
    numbered = lines.where(F.trim("value") != "").withColumn("seq", F.monotonically_increasing_id())
    parsed = numbered.select("seq", F.from_json("value", RUNS, {"mode": "PERMISSIVE"}).alias("r"))
    return parsed.where(F.col("r.at").isNotNull()).select("seq", "r.*")


def _version_runs(spark: SparkSession, path: str, said: dict) -> DataFrame:
    return _parse_runs(spark.read.text(f"{path.rstrip('/')}/{said['folders'][0]}"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Runs of a ledger in order (`seq`): of its newest version, or of plain JSON lines.

    Blank and broken lines cost only themselves.
    """
    last = Versions(spark, path).latest()
    return _version_runs(spark, path, last[1]) if last else _parse_runs(spark.read.text(path))


def _publish_runs(spark: SparkSession, path: str, new: DataFrame, rows: int, append: bool) -> int:
    versions = Versions(spark, path)

    def make(last: dict | None) -> dict:
        # Old runs come before new ones, each in their own order.
        parts = [new.withColumn("_part", F.lit(1))]
        if append and last is not None:
            parts.append(_version_runs(spark, path, last).withColumn("_part", F.lit(0)))
        whole = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
        kept = whole.orderBy(F.col("_part").desc(), F.col("seq").desc()).limit(rows)
        ordered = kept.coalesce(1).sortWithinPartitions("_part", "seq").drop("seq", "_part")
        folder = versions.new_folder()
        ordered.select(F.to_json(F.struct("*")).alias("value")).write.text(f"{versions.path}/{folder}")
        return {"folders": [folder]}

    return versions.publish(make)


def write_ledger(runs: DataFrame, path: str, rows: int = LEDGER_ROWS) -> None:
    """The last rows, in order, as the ledger's next version; a hundred rows fit one task.

    `runs` may be what was read from the same ledger: what it reads stays until two versions have followed.
    """
    _publish_runs(runs.sparkSession, path, runs, rows, False)


def append_ledger(runs: DataFrame, path: str, rows: int = LEDGER_ROWS) -> None:
    """Runs behind those of the ledger, of which the last `rows` stay; a writer that comes second appends to the first's."""
    _publish_runs(runs.sparkSession, path, runs, rows, True)


class FragmentStore:
    """Graph fragments by project as Parquet, valid for one format and SDK only."""

    def __init__(self, spark: SparkSession, path: str, sdk: str, solution: str, type_flow: bool = False):
        self.spark, self.sdk = spark, sdk
        name = spark.range(1).select(
            short_hash(F.lit(solution), F.lit(sdk), F.lit("type-flow") if type_flow else F.lit(None).cast("string"))
        ).first()[0]
        self.path = f"{path.rstrip('/')}/graph-{name}"
        self.versions = Versions(spark, self.path)

    def _fits(self, said: dict | None) -> dict | None:
        """What a version says, if its format and SDK are ours; anything else means an empty cache."""
        return said if said is not None and said["format"] == FORMAT and said["sdk"] == self.sdk else None

    def _manifest(self) -> dict | None:
        last = self.versions.latest()
        return self._fits(last[1]) if last else None

    def valid(self) -> bool:
        return self._manifest() is not None

    def _table(self, said: dict, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{said['tables'][name]}")

    def read(self, table: str, schema: str) -> DataFrame:
        said = self._manifest()
        if said is None or table not in said["tables"]:
            return self.spark.createDataFrame([], schema)
        return self._table(said, table, schema)

    def write(
        self, tables: dict[str, DataFrame], rebuilt: int, projects: int, known_projects: int, current: DataFrame | None = None
    ) -> bool:
        """Each table partitioned by project; nothing is written if nothing changed. Returns whether it was.

        Only rebuilt projects need be given: those of `current` (project) that aren't in a table are taken over from the
        last version, those that left the solution aren't. A table that isn't given is taken over as a whole: by its
        folder, or without the projects that left. Versions are written aside and published at once (see `Versions`).
        """
        if rebuilt == 0 and projects == known_projects and self.valid():
            return False
        names = None if current is None else written(current.select("project").distinct(), "projects")
        given = {name: written(df, "fragments") for name, df in tables.items()}

        def make(last: dict | None) -> dict:
            old = self._fits(last) or {"tables": {}, "schemas": {}}
            folders, schemas = {}, dict(old["schemas"])
            for name in sorted(given.keys() | old["tables"].keys()):
                df = given.get(name)
                if df is None and names is None:
                    folders[name] = old["tables"][name]
                    continue
                if name in old["tables"]:
                    before = self._table(old, name, df.schema if df is not None else schemas[name])
                    if df is not None:
                        before = before.join(df.select("project").distinct(), "project", "left_anti")
                    if names is not None:
                        before = before.join(names, "project", "left_semi")
                    df = before if df is None else df.unionByName(before.select(*df.columns))
                folders[name] = self.versions.new_folder()
                schemas[name] = ", ".join(f"`{c}` {kind}" for c, kind in df.dtypes)
                df.write.option("compression", CODEC).partitionBy("project").parquet(f"{self.path}/{folders[name]}")
            return {
                "format": FORMAT, "sdk": self.sdk, "tables": folders, "schemas": schemas, "folders": sorted(folders.values()),
            }

        self.versions.publish(make)
        for df in given.values():
            dropped(df)
        return True


def fragment_reuse(current: DataFrame, cached: DataFrame) -> DataFrame:
    """C11, L1: (project, fingerprint, reused): a project is reused if its fingerprint is the cached one."""
    old = cached.select("project", F.col("fingerprint").alias("cached"))
    return current.join(old, "project", "left").select(
        "project", "fingerprint", F.col("fingerprint").eqNullSafe(F.col("cached")).alias("reused")
    )


def content_hash(documents: DataFrame, references: DataFrame) -> DataFrame:
    """(project, content_hash): SHA-256 over sorted document hashes and sorted references, 32 digits.

    Both lists hold fixed-size hashes and names of one project.
    """
    docs = documents.groupBy("project").agg(F.array_sort(F.collect_list("hash")).alias("hashes"))
    refs = references.groupBy("project").agg(F.array_sort(F.collect_set("references")).alias("refs"))
    joined = docs.join(refs, "project", "left")
    lines = F.concat("hashes", F.coalesce("refs", F.array().cast("array<string>")))
    return joined.select("project", F.left(F.sha2(F.array_join(lines, "\n"), 256), F.lit(32)).alias("content_hash"))


def surface_hash(members: DataFrame) -> DataFrame:
    """(project, surface_hash) from (project, type, member): sorted types, each with its sorted members."""
    by_type = members.groupBy("project", "type").agg(F.array_sort(F.collect_set("member")).alias("m"))
    entry = F.concat_ws(":", "type", F.array_join("m", ","))
    by_project = by_type.groupBy("project").agg(F.array_sort(F.collect_list(entry)).alias("t"))
    return by_project.select("project", F.left(F.sha2(F.array_join("t", "\n"), 256), F.lit(32)).alias("surface_hash"))
