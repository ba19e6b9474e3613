"""The operators' inputs, made from the driver's tables: foreign keys as dependencies, orders as tests, and so on.

Each instance comes as a DataFrame and, for the oracles, as a SQL common table expression of the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.changes import resolve_diff
from .plans.analyze import Inputs
from .plans.workdir import written
from .schemas import PROJECT_REFS, REFLECTIONS
from .schemas import ROUTES as ROUTES_SCHEMA


class Bed:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def nodes(self) -> DataFrame:
        nation = self.table("nation")
        customer = self.table("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        supplier = self.table("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        orders = self.table("orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
        none = F.lit(None).cast("string")

        def rows(df: DataFrame, letter: str, key: str, kind: str, project: Column, owner: Column = none) -> DataFrame:
            return df.select(
                keyed(letter, key).alias("key"), F.lit(kind).alias("kind"), project.alias("project"), owner.alias("containing_type")
            )

        out = rows(self.table("region"), "R", "r_regionkey", "Type", F.col("r_name"))
        out = out.unionByName(rows(nation, "N", "n_nationkey", "Type", F.col("n_name")))
        out = out.unionByName(rows(customer, "C", "c_custkey", "Type", F.col("n_name")))
        out = out.unionByName(rows(supplier, "S", "s_suppkey", "Type", F.col("n_name")))
        out = out.unionByName(rows(self.table("part"), "P", "p_partkey", "Type", F.lit("parts")))
        return out.unionByName(rows(orders, "O", "o_orderkey", "Method", F.col("n_name"), keyed("C", "o_custkey")))

    def raw_edges(self) -> DataFrame:
        nation, customer, supplier = self.table("nation"), self.table("customer"), self.table("supplier")
        lines = self.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
        first = lines.where("l_linenumber = 1")

        def rows(df: DataFrame, a: tuple[str, str], b: tuple[str, str], kind: int) -> DataFrame:
            return df.select(keyed(*a).alias("src"), keyed(*b).alias("dst"), F.lit(kind).alias("kind"))

        order, part = ("O", "l_orderkey"), ("P", "l_partkey")
        return (
            rows(nation, ("R", "n_regionkey"), ("N", "n_nationkey"), 8)
            .unionByName(rows(customer, ("N", "c_nationkey"), ("C", "c_custkey"), 8))
            .unionByName(rows(supplier, ("N", "s_nationkey"), ("S", "s_suppkey"), 8))
            .unionByName(rows(lines, part, order, 1))
            .unionByName(rows(lines, ("S", "l_suppkey"), order, 1))
            .unionByName(rows(first, order, part, 256))
            .unionByName(rows(first, part, order, 2))
        )

    def interface_graph(self) -> tuple[DataFrame, DataFrame]:
        """Nodes and raw edges with interfaces: regions declare a member for each segment, customers implement it.

        An order uses its customer's member if the customer's key is odd, else the interface's.
        """
        nation = self.table("nation")
        customer = self.table("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        orders = self.table("orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
        declared = F.concat(F.lit("M"), F.col("n_regionkey").cast("string"), F.lit("|"), F.col("c_mktsegment"))
        none = F.lit(None).cast("string")

        def node(df: DataFrame, key: Column, kind: str, owner: Column) -> DataFrame:
            return df.select(
                key.alias("key"), F.lit(kind).alias("kind"), F.lit("p").alias("project"), owner.alias("containing_type")
            ).distinct()

        nodes = (
            node(nation, keyed("R", "n_regionkey"), "Type", none)
            .unionByName(node(nation, keyed("N", "n_nationkey"), "Type", none))
            .unionByName(node(customer, declared, "Method", keyed("R", "n_regionkey")))
            .unionByName(node(customer, keyed("C", "c_custkey"), "Method", keyed("N", "c_nationkey")))
            .unionByName(node(orders, keyed("O", "o_orderkey"), "Method", none))
        )

        def edge(df: DataFrame, a: Column, b: Column, kind: int) -> DataFrame:
            return df.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("kind"))

        used = F.when(F.col("c_custkey") % 2 == 1, keyed("C", "c_custkey")).otherwise(declared)
        edges = (
            edge(nation, keyed("R", "n_regionkey"), keyed("N", "n_nationkey"), 8)
            .unionByName(edge(customer, keyed("C", "c_custkey"), declared, 256))
            .unionByName(edge(customer, declared, keyed("C", "c_custkey"), 2))
            .unionByName(edge(orders, used, keyed("O", "o_orderkey"), 1))
            .unionByName(edge(orders.where("o_orderkey % 3 = 0"), keyed("N", "c_nationkey"), keyed("O", "o_orderkey"), 1))
        )
        return nodes, edges

    def declared(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Types, bases and members: suppliers as classes in a tree, which implement an interface for each nation.

        Those derive from one for each region, and these from a single one; each level hands its argument on.
        """
        nation, supplier = self.table("nation"), self.table("supplier")
        lines = self.table("lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        by_nation = lines.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))

        def kind(df: DataFrame, name: Column, interface: bool, abstract: Column) -> DataFrame:
            return df.select(name.alias("type"), F.lit(interface).alias("is_interface"), abstract.alias("is_abstract")).distinct()

        no = F.lit(False)
        types = (
            kind(nation, F.lit("K"), True, no)
            .unionByName(kind(nation, keyed("J", "n_regionkey"), True, no))
            .unionByName(kind(nation, keyed("I", "n_nationkey"), True, no))
            .unionByName(kind(nation, keyed("T", "n_nationkey"), False, no))
            .unionByName(kind(supplier, keyed("S", "s_suppkey"), False, F.col("s_acctbal") < 0))
        )

        def base(df: DataFrame, name: Column, of: Column, arg: Column | None) -> DataFrame:
            args = F.array(*[] if arg is None else [arg]).cast("array<string>")
            return df.select(name.alias("type"), of.alias("base"), args.alias("args")).distinct()

        own = keyed("S", "s_suppkey")
        above = F.concat(F.lit("S"), F.floor(F.col("s_suppkey") / 3).cast("string"))
        bases = (
            base(nation, keyed("J", "n_regionkey"), F.lit("K"), F.lit("List<!0!>"))
            .unionByName(base(nation, keyed("I", "n_nationkey"), keyed("J", "n_regionkey"), F.lit("!0!")))
            .unionByName(base(supplier, own, keyed("I", "s_nationkey"), keyed("T", "s_nationkey")))
            .unionByName(base(supplier.where("s_suppkey >= 3"), own, above, None))
        )

        def member(df: DataFrame, owner: Column, name: Column, param: Column, **more: Column) -> DataFrame:
            given = {"is_override": no, "is_overridable": no, "is_public": F.lit(True), "explicit_of": F.lit(None).cast("string"), "is_accessor": no}
            columns = [c.alias(k) for k, c in (given | more).items()]
            key = F.concat(owner, F.lit("."), name)
            return df.select(key.alias("member"), owner.alias("type"), name.alias("name"), F.array(param).alias("params"), *columns).distinct()

        odd = F.col("l_linenumber") % 2 == 1
        mine = lines.groupBy("l_suppkey", "s_nationkey", "l_linenumber").agg(
            F.count("*").alias("n"), F.max("l_quantity").alias("most"), F.min("l_tax").alias("least")
        )
        number, flag = keyed("M", "l_linenumber"), F.concat(F.lit("F"), F.col("l_returnflag"))
        declared = F.concat(keyed("I", "s_nationkey"), F.lit("."), number)
        members = (
            member(nation, F.lit("K"), F.lit("G"), F.lit("!0!"))
            .unionByName(member(by_nation, keyed("J", "n_regionkey"), flag, F.lit("!0!")))
            .unionByName(member(lines, keyed("I", "s_nationkey"), number, F.when(odd, "!0!").otherwise("int"), is_accessor=F.col("l_linenumber") == 7))
            .unionByName(
                member(
                    mine, keyed("S", "l_suppkey"), number, F.when(odd, keyed("T", "s_nationkey")).otherwise("int"),
                    is_override=F.col("n") % 2 == 1, is_overridable=F.col("n") % 3 != 0, is_public=F.col("most") > 49,
                    explicit_of=F.when(F.col("least") < 0.005, declared),
                )
            )
            .unionByName(member(lines, keyed("S", "l_suppkey"), flag, keyed("T", "s_nationkey"), is_overridable=F.lit(True)))
            .unionByName(
                member(supplier.where("s_acctbal > 5000"), own, F.lit("G"), F.concat(F.lit("List<"), keyed("T", "s_nationkey"), F.lit(">")))
            )
        )
        return types, bases, members

    def symbols(self) -> DataFrame:
        """Lines lead to the line before, to their order, to its customer, and on by halving the customer's key."""
        lines, orders, customer = self.table("lineitem"), self.table("orders"), self.table("customer")
        line = F.concat(keyed("L", "l_orderkey"), F.lit("."), F.col("l_linenumber").cast("string"))
        before = F.concat(keyed("L", "l_orderkey"), F.lit("."), (F.col("l_linenumber") - 1).cast("string"))
        half = F.concat(F.lit("C"), F.floor(F.col("c_custkey") / 2).cast("string"))
        no = F.lit(False)

        def rows(df: DataFrame, symbol: Column, to: Column, low: Column, private: Column, explicit: Column) -> DataFrame:
            return df.select(symbol.alias("symbol"), to.alias("to"), low.alias("is_dropped"), private.alias("is_private"), explicit.alias("is_explicit"))

        return (
            rows(lines, line, F.when(F.col("l_linenumber") > 1, before).otherwise(keyed("O", "l_orderkey")), no, no, F.col("l_linenumber") == 6)
            .distinct()
            .unionByName(rows(orders, keyed("O", "o_orderkey"), keyed("C", "o_custkey"), no, F.col("o_orderstatus") == "P", no))
            .unionByName(
                rows(customer, keyed("C", "c_custkey"), F.when(F.col("c_custkey") > 1, half), F.col("c_acctbal") < -900, F.col("c_acctbal") < -950, no)
            )
        )

    def tests(self) -> DataFrame:
        """Orders by customer by nation; selected: all of every third customer, and the finished of the rest."""
        nation = self.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
        owners = self.table("customer").select("c_custkey", "c_nationkey").join(nation, "c_nationkey")
        orders = self.table("orders").join(owners, F.col("o_custkey") == F.col("c_custkey"))
        return orders.select(
            keyed("O", "o_orderkey").alias("symbol_key"),
            keyed("C", "o_custkey").alias("class_key"),
            F.col("n_name").alias("project"),
            F.col("n_name").alias("namespace"),
            keyed("C", "o_custkey").alias("class_name"),
            F.concat_ws(" ", F.col("o_orderpriority"), keyed("O", "o_orderkey")).alias("method_name"),
            F.col("o_orderpriority").alias("priority"),
            ((F.col("o_custkey") % 3 == 0) | ((F.col("o_orderstatus") == "F") & (F.col("o_custkey") % 3 == 1))).alias("selected"),
        )

    def sites(self) -> DataFrame:
        start = 10 * F.col("l_linenumber")
        return self.table("lineitem").select(
            F.lit("parts").alias("project"),
            keyed("P", "l_partkey").alias("file"),
            start.cast("int").alias("start_line"),
            (start + F.floor("l_quantity")).cast("int").alias("end_line"),
            F.concat(keyed("L", "l_orderkey"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("key"),
            (F.col("l_linenumber") == 1).alias("is_type"),
            (F.col("l_linenumber") == 7).alias("is_inlined"),
        )

    def hunks(self) -> DataFrame:
        start = (13 * F.col("l_linenumber")).cast("int")
        return (
            self.table("lineitem")
            .select(
                F.lit("parts").alias("project"),
                keyed("P", "l_partkey").alias("file"),
                start.alias("start_line"),
                (start + 2).alias("end_line"),
            )
            .distinct()
        )

    def routes(self) -> DataFrame:
        """Paths of pages; every tenth page serves its path with digits as a parameter, the others name theirs."""
        path = F.regexp_extract(F.col("url"), r"^[^:]*://[^/?#]*([^?#]*)", 1)
        serves = F.col("page_id") % 10 == 0
        return self.table("pages").select(
            F.when(serves, F.regexp_replace(path, "[0-9]+", "{id}")).otherwise(path).alias("template"),
            keyed("G", "page_id").alias("owner"),
            serves.alias("is_endpoint"),
            F.concat(F.lit("web"), (F.col("page_id") % 7).cast("string")).alias("project"),
            F.concat(F.lit("src/Web"), (F.col("page_id") % 7).cast("string"), F.lit("/Routes"), (F.col("page_id") % 13).cast("string"), F.lit(".cs")).alias("file"),
            (F.col("page_id") % 97 + 1).cast("int").alias("line"),
        )

    def solution(self) -> Inputs:
        """Customers as classes of their nation's project, orders as their methods, order lines as tests that call them.

        Every customer's file changed, on lines that its balance tells; files of the segment FURNITURE only in comments.
        In those of BUILDING lines were removed as well, of orders that are gone unless finished, and in one region of
        classes that are gone. A data file, a file of another language and documents changed beside them.
        """
        nation = self.table("nation").withColumnsRenamed({"n_name": "project", "n_regionkey": "region"})
        own = self.table("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
            "c_custkey",
            "project",
            "region",
            "c_mktsegment",
            F.concat(F.lit("src/"), "project", F.lit("/C"), "c_custkey", F.lit(".cs")).alias("file"),
            F.concat("project", F.lit(".C"), "c_custkey").alias("path"),
            (F.floor(F.abs("c_acctbal")) + 2).cast("int").alias("at"),
        )
        orders = self.table("orders").join(own, F.col("o_custkey") == F.col("c_custkey")).withColumn(
            "line", (F.col("o_orderkey") * 7 % 10000 + 2).cast("int")
        )
        suppliers = self.table("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
            "s_suppkey", F.concat(F.lit("test_"), "project").alias("test_project")
        )
        lines = self.table("lineitem").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        order_key = F.concat(F.lit("a|M:"), "path", F.lit(".O"), "o_orderkey")
        class_key, class_name = F.concat(F.lit("a|T:"), "path"), keyed("P", "l_partkey")
        method = F.concat_ws("_", keyed("L", "l_orderkey"), "l_linenumber", "l_suppkey")
        test_key = F.concat(F.lit("a|M:T."), class_name, F.lit("."), method)
        none = F.lit(None).cast("string")

        def node(df: DataFrame, key: Column, kind: str, project: Column, owner: Column = none) -> DataFrame:
            file = F.lit(None).cast("string").alias("file")
            return df.select(
                key.alias("key"), key.alias("display"), F.lit(kind).alias("kind"), project.alias("project"), owner.alias("containing_type"), file, F.lit(0).alias("ord")
            ).distinct()

        nodes = (
            node(own, class_key, "Type", F.col("project"))
            .unionByName(node(orders, order_key, "Method", F.col("project"), class_key))
            .unionByName(node(lines, test_key, "Method", F.col("test_project"), F.concat(F.lit("a|T:T."), class_name)))
        )
        named = orders.select(F.col("o_orderkey").alias("l_orderkey"), order_key.alias("src"))
        edges = lines.join(named, "l_orderkey").select("src", test_key.alias("dst"), F.lit(1).alias("kind")).distinct()

        def site(df: DataFrame, key: Column, start: Column, end: Column, is_type: bool) -> DataFrame:
            return df.select(
                "project", "file", start.alias("start_line"), end.alias("end_line"), key.alias("key"), F.lit(is_type).alias("is_type"), F.lit(False).alias("is_inlined")
            )

        whole = (F.lit(1), F.lit(20000))
        sites = site(own, class_key, *whole, True).unionByName(site(orders, order_key, F.col("line"), F.col("line") + 5, False))
        gone = (F.col("c_mktsegment") == "BUILDING") & (F.col("region") == 4)
        old_path = F.when(gone, F.concat("project", F.lit(".Gone"), "c_custkey")).otherwise(F.col("path"))
        old_name = F.concat(F.when(F.col("o_orderstatus") == "F", "O").otherwise("Old"), "o_orderkey")

        def old(df: DataFrame, start: Column, end: Column, name: Column, is_type: bool) -> DataFrame:
            return df.select(
                "project", "file", start.alias("start_line"), end.alias("end_line"), F.lit(is_type).alias("is_type"), old_path.alias("type_path"), name.alias("member_name")
            )

        decls = old(own, *whole, none, True).unionByName(old(orders, F.col("line"), F.col("line") + 5, old_name, False))
        others = self.table("region").select(
            F.when(F.col("r_name") == "AMERICA", "src/NATION_1/data.json")
            .when(F.col("r_name") == "ASIA", "fs/lib.fs")
            .otherwise(F.concat(F.lit("docs/"), "r_name", F.lit(".md")))
            .alias("file")
        )
        changed = own.select("file").unionByName(others).select(
            F.col("file").alias("path"), none.alias("old_path"), F.lit("Modified").alias("kind")
        )
        hunk = lambda df, side, n: df.select(F.col("file").alias("path"), F.lit(side).alias("side"), F.col("at").alias("start_line"), (F.col("at") + n).alias("end_line"))
        hunks = hunk(own, "new", 1500).unionByName(hunk(own.where("c_mktsegment = 'BUILDING'"), "old", 300))
        frame = self.spark.createDataFrame
        tests = lines.select(
            test_key.alias("symbol_key"), F.concat(F.lit("a|T:T."), class_name).alias("class_key"), F.lit("T").alias("namespace"), class_name.alias("class_name"),
            method.alias("method_name"), F.col("test_project").alias("project"), F.lit("NUnit").alias("framework"), F.lit(False).alias("is_parameterized"),
        ).distinct()
        sources = nation.select(F.col("project").alias("name"), F.concat(F.lit("src/"), "project").alias("dir"))
        testing = nation.select(F.concat(F.lit("test_"), "project").alias("name"), F.concat(F.lit("tests/"), "project").alias("dir"))
        refs = nation.select(F.concat(F.lit("test_"), "project").alias("project"), F.col("project").alias("references"))
        return Inputs(
            nodes=written(nodes, "nodes"),
            edges=written(edges, "edges"),
            documents=own.select("project", "file"),
            sites=written(sites, "sites"),
            projects=sources.unionByName(testing),
            project_refs=refs.unionByName(frame([("test_NATION_2", "FS")], PROJECT_REFS)),
            tests=written(tests, "tests"),
            diff=written(resolve_diff(changed, hunks, frame([], "path string")), "diff"),
            routes=frame([], ROUTES_SCHEMA),
            reflections=frame([], REFLECTIONS),
            old_decls=written(decls, "decls"),
            trivia_files=own.where("c_mktsegment = 'FURNITURE'").select("project", "file"),
            foreign=frame([("FS", "F#", "fs")], "name string, language string, dir string"),
        )

    def runs(self) -> DataFrame:
        """Events as runs, a ledger for each user: errors are full runs."""
        full = F.col("event_type") == "error"
        return self.table("events").select(
            "user_id",
            F.col("ts").cast("string").alias("at"),
            F.col("event_id").alias("seq"),
            full.alias("fullRun"),
            (F.col("value") / 10).alias("analysisSeconds"),
            F.col("value").alias("suiteSeconds"),
            F.when(full, F.lit(100)).otherwise((F.col("event_id") % 100).cast("int")).alias("selectedTests"),
            F.lit(100).alias("totalTests"),
        )


def keyed(letter: str, column: str) -> Column:
    return F.concat(F.lit(letter), F.col(column).cast("string"))


SOLUTION = """own AS (
  SELECT c_custkey AS c, n_name AS project, n_regionkey AS region, c_mktsegment AS segment, n_name || '.C' || c_custkey AS path,
         floor(abs(c_acctbal))::INT + 2 AS first FROM customer JOIN nation ON c_nationkey = n_nationkey
), met AS (
  SELECT own.*, o_orderkey AS o, o_orderstatus AS status, o_orderkey * 7 % 10000 + 2 AS line FROM orders JOIN own ON o_custkey = c
), new_hits AS (
  SELECT * FROM met WHERE segment <> 'FURNITURE' AND line <= first + 1500 AND first <= line + 5
), old_hits AS (
  SELECT * FROM met WHERE segment = 'BUILDING' AND line <= first + 300 AND first <= line + 5
), seeds AS (
  SELECT 'a|M:' || path || '.O' || o AS key FROM new_hits
  UNION SELECT 'a|T:' || path FROM own WHERE segment <> 'FURNITURE' AND c NOT IN (SELECT c FROM new_hits)
  UNION SELECT CASE WHEN status = 'F' THEN 'a|M:' || path || '.O' || o ELSE 'a|T:' || path END FROM old_hits WHERE region <> 4
  UNION SELECT 'a|T:' || path FROM own WHERE segment = 'BUILDING' AND region <> 4 AND c NOT IN (SELECT c FROM old_hits)
), wide AS (
  SELECT DISTINCT project FROM own WHERE segment = 'BUILDING' AND region = 4 UNION SELECT 'NATION_1'
), lines AS (
  SELECT DISTINCT 'test_' || n_name AS project, 'a|M:T.P' || l_partkey || '.L' || l_orderkey || '_' || l_linenumber || '_' || l_suppkey AS symbol_key,
         'T.P' || l_partkey || '.L' || l_orderkey || '_' || l_linenumber || '_' || l_suppkey AS fqn, l_orderkey AS o
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
), reached AS (
  SELECT o, 2 AS hops FROM met WHERE 'a|M:' || path || '.O' || o IN (SELECT key FROM seeds)
  UNION ALL SELECT o, 3 FROM met WHERE 'a|T:' || path IN (SELECT key FROM seeds)
), nearest AS (
  SELECT o, min(hops) AS hops FROM reached GROUP BY o
), chosen AS (
  SELECT project, symbol_key, fqn, coalesce(hops, 2147483647) AS hops FROM lines l LEFT JOIN nearest n ON l.o = n.o
  WHERE n.o IS NOT NULL OR project IN (SELECT 'test_' || project FROM wide) OR project = 'test_NATION_2'
)"""

NODES = """nodes AS (
  SELECT 'R' || r_regionkey AS key, 'Type' AS kind, r_name AS project, NULL::VARCHAR AS containing_type FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'Type', n_name, NULL FROM nation
  UNION ALL SELECT 'C' || c_custkey, 'Type', n_name, NULL FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'S' || s_suppkey, 'Type', n_name, NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'P' || p_partkey, 'Type', 'parts', NULL FROM part
  UNION ALL SELECT 'O' || o_orderkey, 'Method', n_name, 'C' || o_custkey
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""

EDGES = """raw AS (
  SELECT 'R' || n_regionkey AS src, 'N' || n_nationkey AS dst, 8 AS kind FROM nation
  UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey, 8 FROM customer
  UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey, 8 FROM supplier
  UNION ALL SELECT 'P' || l_partkey, 'O' || l_orderkey, 1 FROM lineitem
  UNION ALL SELECT 'S' || l_suppkey, 'O' || l_orderkey, 1 FROM lineitem
  UNION ALL SELECT 'O' || l_orderkey, 'P' || l_partkey, 256 FROM lineitem WHERE l_linenumber = 1
  UNION ALL SELECT 'P' || l_partkey, 'O' || l_orderkey, 2 FROM lineitem WHERE l_linenumber = 1
), edges AS (
  SELECT src, dst, bit_or(kind) AS kind FROM raw WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY src, dst
)"""

DECLARED = """types AS (
  SELECT 'K' AS type, TRUE AS iface, FALSE AS abstract UNION SELECT 'J' || n_regionkey, TRUE, FALSE FROM nation
  UNION SELECT 'I' || n_nationkey, TRUE, FALSE FROM nation UNION SELECT 'T' || n_nationkey, FALSE, FALSE FROM nation
  UNION SELECT 'S' || s_suppkey, FALSE, s_acctbal < 0 FROM supplier
), bases AS (
  SELECT 'J' || n_regionkey AS type, 'K' AS base, 'List<!0!>' AS arg, TRUE AS iface FROM nation
  UNION SELECT 'I' || n_nationkey, 'J' || n_regionkey, '!0!', TRUE FROM nation
  UNION SELECT 'S' || s_suppkey, 'I' || s_nationkey, 'T' || s_nationkey, TRUE FROM supplier
  UNION SELECT 'S' || s_suppkey, 'S' || s_suppkey // 3, NULL, FALSE FROM supplier WHERE s_suppkey >= 3
), members AS (
  SELECT 'K.G' AS member, 'K' AS type, 'G' AS name, '!0!' AS param, FALSE AS over, FALSE AS may, TRUE AS pub, NULL AS expl, FALSE AS acc
  UNION SELECT 'J' || n_regionkey || '.F' || l_returnflag, 'J' || n_regionkey, 'F' || l_returnflag, '!0!', FALSE, FALSE, TRUE, NULL, FALSE
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  UNION SELECT 'I' || s_nationkey || '.M' || l_linenumber, 'I' || s_nationkey, 'M' || l_linenumber,
    CASE WHEN l_linenumber % 2 = 1 THEN '!0!' ELSE 'int' END, FALSE, FALSE, TRUE, NULL, l_linenumber = 7
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  UNION SELECT 'S' || l_suppkey || '.M' || l_linenumber, 'S' || l_suppkey, 'M' || l_linenumber,
    CASE WHEN l_linenumber % 2 = 1 THEN 'T' || s_nationkey ELSE 'int' END, count(*) % 2 = 1, count(*) % 3 <> 0, max(l_quantity) > 49,
    CASE WHEN min(l_tax) < 0.005 THEN 'I' || s_nationkey || '.M' || l_linenumber END, FALSE
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_suppkey, s_nationkey, l_linenumber
  UNION SELECT 'S' || l_suppkey || '.F' || l_returnflag, 'S' || l_suppkey, 'F' || l_returnflag, 'T' || s_nationkey, FALSE, TRUE, TRUE, NULL, FALSE
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  UNION SELECT 'S' || s_suppkey || '.G', 'S' || s_suppkey, 'G', 'List<T' || s_nationkey || '>', FALSE, FALSE, TRUE, NULL, FALSE
    FROM supplier WHERE s_acctbal > 5000
), up(type, base, arg, depth, iface) AS (
  SELECT type, base, arg, 1, iface FROM bases UNION
  SELECT u.type, b.base, replace(b.arg, '!0!', coalesce(u.arg, '')), u.depth + 1, b.iface FROM up u JOIN bases b ON u.base = b.type
), above AS (
  SELECT type, base, arg, min(depth) AS depth, iface FROM up GROUP BY type, base, arg, iface
)"""

SYMBOLS = """symbols AS (
  SELECT DISTINCT 'L' || l_orderkey || '.' || l_linenumber AS symbol,
         CASE WHEN l_linenumber > 1 THEN 'L' || l_orderkey || '.' || l_linenumber - 1 ELSE 'O' || l_orderkey END AS target,
         FALSE AS gone, FALSE AS priv, l_linenumber = 6 AS expl FROM lineitem
  UNION ALL SELECT 'O' || o_orderkey, 'C' || o_custkey, FALSE, o_orderstatus = 'P', FALSE FROM orders
  UNION ALL SELECT 'C' || c_custkey, CASE WHEN c_custkey > 1 THEN 'C' || c_custkey // 2 END, c_acctbal < -900, c_acctbal < -950, FALSE FROM customer
)"""

STEPS = """steps AS (
  SELECT src, dst, (kind & 768) <> 0 AND (kind & (~768)) = 0 AS up, (kind & 6) <> 0 AND (kind & (~6)) = 0 AS down FROM edges
  UNION ALL
  SELECT m.containing_type, m.key, FALSE, FALSE FROM nodes m JOIN nodes t ON m.containing_type = t.key AND t.kind = 'Type'
)"""

TESTS = """tests AS (
  SELECT 'O' || o_orderkey AS symbol_key, 'C' || o_custkey AS class_key, n_name AS project, n_name AS namespace,
         'C' || o_custkey AS class_name, o_orderpriority || ' O' || o_orderkey AS method_name,
         o_orderpriority AS priority,
         o_custkey % 3 = 0 OR (o_orderstatus = 'F' AND o_custkey % 3 = 1) AS selected,
         n_name || '.C' || o_custkey AS full_class,
         n_name || '.C' || o_custkey || '.' || o_orderpriority || ' O' || o_orderkey AS fqn
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""

SITES = """sites AS (
  SELECT 'P' || l_partkey AS file, 10 * l_linenumber AS s, (10 * l_linenumber + floor(l_quantity))::INT AS e,
         'L' || l_orderkey || '-' || l_linenumber AS key, l_linenumber = 1 AS is_type, l_linenumber = 7 AS is_inlined
  FROM lineitem
), hunks AS (
  SELECT DISTINCT 'P' || l_partkey AS file, 13 * l_linenumber AS start_line, 13 * l_linenumber + 2 AS end_line
  FROM lineitem
)"""

ROUTES = """paths AS (
  SELECT page_id, page_id % 10 = 0 AS is_endpoint, regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1) AS path FROM pages
), routes AS (
  SELECT CASE WHEN is_endpoint THEN regexp_replace(path, '[0-9]+', '{id}', 'g') ELSE path END AS template,
         'G' || page_id AS owner, is_endpoint, 'web' || (page_id % 7) AS project,
         'src/Web' || (page_id % 7) || '/Routes' || (page_id % 13) || '.cs' AS file, page_id % 97 + 1 AS line
  FROM paths
), parts AS (
  SELECT *, [CASE WHEN contains(x, '{') THEN '*' ELSE lower(x) END
             FOR x IN string_split(trim(template), '/') IF x <> ''] AS segments
  FROM routes
), normal AS (
  SELECT * FROM parts WHERE len([x FOR x IN segments IF x <> '*']) > 0
)"""
