"""Queries over the driver's tables, one or more for each group of operators, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import filters as fx
from .functions import names
from .functions.routes import attribute_name, normalise_route
from .operators import changes, declarations, discovery, filters, graph, harness, ledger, properties, report, routes, safety, selection, typeflow
from .plans import analyze as analysis
from .plans import maintain
from .plans.intervals import longest_prefix
from .plans.workdir import new_path, written
from .sources import gitdiff, results
from .streaming import watch
from .testbed import DECLARED, EDGES, NODES, ROUTES, SITES, SOLUTION, STEPS, SYMBOLS, TESTS, Bed, keyed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable[[Bed], DataFrame]], Callable[[Bed], DataFrame]]:
    def register(f: Callable[[Bed], DataFrame]) -> Callable[[Bed], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Bed(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _graph(bed: Bed) -> graph.Graph:
    return _graph_of(bed.nodes(), bed.raw_edges())


def _graph_of(nodes: DataFrame, edges: DataFrame) -> graph.Graph:
    return graph.Graph(written(nodes, "nodes", ("key",)), written(graph.merge_edges(edges), "edges", ("src", "dst")))


def _keys(bed: Bed, *keys: str) -> DataFrame:
    return bed.spark.createDataFrame([(k,) for k in keys], "key string")


# Graph ---------------------------------------------------------------------------------------------------------------


@query(f"WITH {EDGES} SELECT src, dst, kind FROM edges")
def edge_merge(bed: Bed) -> DataFrame:
    return graph.merge_edges(bed.raw_edges())


@query(
    f"""WITH {NODES}, {EDGES}
    SELECT count(*) FILTER (kind = 'Type') AS types, count(*) FILTER (kind <> 'Type') AS members,
           (SELECT count(*) FROM edges) AS edges FROM nodes"""
)
def graph_summary(bed: Bed) -> DataFrame:
    return graph.graph_summary(bed.nodes(), bed.raw_edges())


@query(
    f"""WITH {EDGES}
    SELECT src, dst, (kind & 768) <> 0 AND (kind & (~768)) = 0 AS upward,
           (kind & 6) <> 0 AND (kind & (~6)) = 0 AS downward, (kind & 1152) <> 0 AND (kind & (~1152)) = 0 AS dispatch
    FROM edges"""
)
def edge_class(bed: Bed) -> DataFrame:
    return graph.classify_edges(graph.merge_edges(bed.raw_edges())).drop("kind")


@query(
    """WITH rows AS (
      SELECT 'P' || p_partkey AS key, 'T' || p_partkey % 5 AS display, CASE WHEN p_partkey % 4 > 0 THEN p_brand END AS file,
             1000 - p_partkey AS ord FROM part
      UNION ALL SELECT 'P' || l_partkey, 'L' || l_linenumber, 'f' || l_suppkey, 2000000 + l_orderkey * 10 + l_linenumber
      FROM lineitem)
    SELECT key, arg_min(display, ord) AS display, arg_min(file, ord) FILTER (file IS NOT NULL) AS file, min(ord) AS ord
    FROM rows GROUP BY key"""
)
def node_merge(bed: Bed) -> DataFrame:
    none = F.lit(None).cast("string")
    first = bed.table("part").select(
        keyed("P", "p_partkey").alias("key"),
        F.concat(F.lit("T"), (F.col("p_partkey") % 5).cast("string")).alias("display"),
        F.when(F.col("p_partkey") % 4 > 0, F.col("p_brand")).alias("file"),
        (1000 - F.col("p_partkey")).alias("ord"),
    )
    more = bed.table("lineitem").select(
        keyed("P", "l_partkey").alias("key"),
        F.concat(F.lit("L"), F.col("l_linenumber").cast("string")).alias("display"),
        keyed("f", "l_suppkey").alias("file"),
        (F.lit(2000000) + F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
    )
    filled = [
        x.withColumns({"kind": none, "project": none, "containing_type": none}) for x in (first, more)
    ]
    return graph.merge_nodes(*filled).select("key", "display", "file", "ord")


def _walk_sql(seed: str, up: bool, free: bool) -> str:
    return f"""WITH RECURSIVE {NODES}, {EDGES}, {STEPS}, w(key, free) AS (
      SELECT {seed}, {str(free).upper()} UNION
      SELECT s.dst, NOT s.up FROM w JOIN steps s ON w.key = s.src
      WHERE ({str(up).upper()} OR NOT s.up) AND (w.free OR NOT s.down))
    SELECT DISTINCT key FROM w"""


@query(_walk_sql("'S1'", False, True))
def walk_plain(bed: Bed) -> DataFrame:
    return graph.reach(_graph(bed), _keys(bed, "S1"), False).select("key")


@query(_walk_sql("'P7'", True, False))
def walk_two_state(bed: Bed) -> DataFrame:
    return graph.reach(_graph(bed), _keys(bed, "P7"), True, seeds_restricted=True).select("key")


@query(
    f"""WITH RECURSIVE {NODES}, {EDGES}, {STEPS}, w(key, hops) AS (
      SELECT 'R1', 1 UNION SELECT s.dst, w.hops + 1 FROM w JOIN steps s ON w.key = s.src WHERE NOT s.up AND w.hops < 20)
    SELECT key, min(hops)::INT AS hops FROM w GROUP BY key"""
)
def walk_hops(bed: Bed) -> DataFrame:
    return graph.reach(_graph(bed), _keys(bed, "R1"), False)


@query(
    f"""WITH RECURSIVE {NODES}, {EDGES}, {STEPS}, w(key, hops) AS (
      SELECT 'R1', 1 UNION SELECT s.dst, w.hops + 1 FROM w JOIN steps s ON w.key = s.src WHERE NOT s.up AND w.hops < 20),
    h AS (SELECT key, min(hops) AS hops FROM w GROUP BY key)
    SELECT key AS target, hops::INT AS nodes, 'R1' AS seed FROM h WHERE key LIKE 'O%'"""
)
def explain_paths(bed: Bed) -> DataFrame:
    g = _graph(bed)
    seeds = _keys(bed, "R1").select(F.lit("").alias("origin"), "key")
    walked = written(graph.walk(g, seeds, False, predecessors=True), "walked")
    found = graph.paths_to(walked, walked.where(F.startswith("key", F.lit("O"))).select("key"))
    return found.select("target", F.size("path").alias("nodes"), F.element_at("path", 1)["key"].alias("seed"))


@query(
    f"""WITH {NODES}, {EDGES}
    SELECT t.key AS type FROM nodes t WHERE t.kind = 'Type' AND NOT EXISTS (
      SELECT 1 FROM edges e LEFT JOIN nodes d ON e.dst = d.key
      WHERE e.src = t.key AND e.kind NOT IN (128, 1024) AND e.dst <> e.src
        AND d.containing_type IS DISTINCT FROM t.key)"""
)
def container_resolved(bed: Bed) -> DataFrame:
    return graph.container_resolved(bed.nodes(), graph.merge_edges(bed.raw_edges()))


_REFS = """refs AS (
  SELECT n_name AS project, r_name AS refd FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION SELECT r_name, 'ROOT' FROM region UNION SELECT 'ROOT', r_name FROM region WHERE r_regionkey = 0)"""


def _refs(bed: Bed) -> DataFrame:
    region, nation, customer = bed.table("region"), bed.table("nation"), bed.table("customer")
    by_region = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    by_nation = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return (
        by_region.select(F.col("n_name").alias("project"), F.col("r_name").alias("references"))
        .unionByName(by_nation.select(F.col("c_name").alias("project"), F.col("n_name").alias("references")))
        .unionByName(region.select(F.col("r_name").alias("project"), F.lit("ROOT").alias("references")))
        .unionByName(region.where("r_regionkey = 0").select(F.lit("ROOT").alias("project"), F.col("r_name").alias("references")))
    )


@query(
    f"""WITH RECURSIVE {_REFS}, c(project) AS (
      SELECT r_name FROM region WHERE r_regionkey = 1 UNION SELECT r.project FROM c JOIN refs r ON r.refd = c.project)
    SELECT project FROM c"""
)
def project_closure(bed: Bed) -> DataFrame:
    seeds = bed.table("region").where("r_regionkey = 1").select(F.col("r_name").alias("project"))
    return graph.project_closure(_refs(bed), seeds)


@query(
    f"""WITH RECURSIVE {_REFS}, c(project, refd) AS (
      SELECT project, refd FROM refs UNION SELECT c.project, r.refd FROM c JOIN refs r ON r.project = c.refd)
    SELECT project, string_agg(refd, ',' ORDER BY refd) AS closure FROM c WHERE project <> refd GROUP BY project"""
)
def dependency_closure(bed: Bed) -> DataFrame:
    return graph.dependency_closure(_refs(bed)).select("project", F.array_join("closure", ",").alias("closure"))


_INTERFACES = """own AS (SELECT c_custkey AS c, c_nationkey AS n, n_regionkey AS r, 'M' || n_regionkey || '|' || c_mktsegment AS m
    FROM customer JOIN nation ON c_nationkey = n_nationkey),
  nodes AS (SELECT DISTINCT 'R' || n_regionkey AS key, 'Type' AS kind, NULL::VARCHAR AS containing_type FROM nation
    UNION SELECT 'N' || n_nationkey, 'Type', NULL FROM nation UNION SELECT m, 'Method', 'R' || r FROM own
    UNION SELECT 'C' || c, 'Method', 'N' || n FROM own UNION SELECT 'O' || o_orderkey, 'Method', NULL FROM orders JOIN own ON o_custkey = c),
  raw AS (SELECT 'R' || n_regionkey AS src, 'N' || n_nationkey AS dst, 8 AS kind FROM nation
    UNION ALL SELECT 'C' || c, m, 256 FROM own UNION ALL SELECT m, 'C' || c, 2 FROM own
    UNION ALL SELECT CASE WHEN c % 2 = 1 THEN 'C' || c ELSE m END, 'O' || o_orderkey, 1 FROM orders JOIN own ON o_custkey = c
    UNION ALL SELECT 'N' || n, 'O' || o_orderkey, 1 FROM orders JOIN own ON o_custkey = c WHERE o_orderkey % 3 = 0),
  edges AS (SELECT src, dst, bit_or(kind) AS kind FROM raw GROUP BY src, dst)"""


@query(
    f"""WITH RECURSIVE {_INTERFACES}, {STEPS},
    w(key, hops) AS (SELECT unnest(['C1', 'C4', 'N2']), 1 UNION SELECT s.dst, w.hops + 1 FROM w JOIN steps s ON w.key = s.src WHERE NOT s.up AND hops < 9),
    impacted AS (SELECT key, min(hops) AS hops FROM w GROUP BY key),
    pairs AS (SELECT e.src AS impl, e.dst AS decl, i.hops, n.containing_type AS type FROM edges e JOIN impacted i ON e.src = i.key JOIN nodes n ON n.key = e.src
      WHERE e.kind = 256),
    d(origin, key, free, hops) AS (SELECT DISTINCT decl, decl, FALSE, 1 FROM pairs UNION
      SELECT origin, s.dst, NOT s.up, d.hops + 1 FROM d JOIN steps s ON d.key = s.src WHERE (free OR NOT s.down) AND d.hops < 9),
    t(origin, key) AS (SELECT DISTINCT type, type FROM pairs UNION SELECT origin, s.dst FROM t JOIN steps s ON t.key = s.src WHERE NOT s.up),
    bounded AS (SELECT DISTINCT origin FROM t JOIN nodes n ON t.key = n.key WHERE t.key <> origin AND n.containing_type IS DISTINCT FROM origin),
    added AS (SELECT d.key, p.hops + d.hops AS hops FROM pairs p JOIN d ON d.origin = p.decl
      WHERE p.type NOT IN (SELECT origin FROM bounded) OR d.key = p.decl OR EXISTS (SELECT 1 FROM t WHERE t.origin = p.type AND t.key = d.key))
    SELECT key, min(hops)::INT AS hops FROM (SELECT * FROM impacted UNION ALL SELECT * FROM added WHERE key NOT IN (SELECT key FROM impacted)) GROUP BY key"""
)
def generalise_select(bed: Bed) -> DataFrame:
    nodes, edges = bed.interface_graph()
    g = _graph_of(nodes, edges)
    return graph.traverse(g, _keys(bed, "C1", "C4", "N2"))


@query(
    f"""WITH RECURSIVE {_INTERFACES}, steps AS (
      SELECT src, dst, (kind & 768) <> 0 AND (kind & (~768)) = 0 AS up, (kind & 6) <> 0 AND (kind & (~6)) = 0 AS down, kind FROM edges UNION ALL
      SELECT m.containing_type, m.key, FALSE, FALSE, 32 FROM nodes m JOIN nodes t ON m.containing_type = t.key AND t.kind = 'Type'),
    w(key, hops, via) AS (SELECT unnest(['C1', 'C4', 'N2']), 1, NULL::STRUCT(pred VARCHAR, kind INT) UNION
      SELECT s.dst, w.hops + 1, {{'pred': s.src, 'kind': s.kind}} FROM w JOIN steps s ON w.key = s.src WHERE NOT s.up AND hops < 9),
    impacted AS (SELECT key, min({{'hops': hops, 'via': via}}) AS least FROM w GROUP BY key),
    pairs AS (SELECT e.src AS impl, e.dst AS decl, e.kind, i.least.hops AS hops, n.containing_type AS type
      FROM edges e JOIN impacted i ON e.src = i.key JOIN nodes n ON n.key = e.src WHERE e.kind = 256),
    d(origin, key, free, hops, via) AS (SELECT DISTINCT decl, decl, FALSE, 1, NULL::STRUCT(pred VARCHAR, kind INT) FROM pairs UNION
      SELECT origin, s.dst, NOT s.up, d.hops + 1, {{'pred': s.src, 'kind': s.kind}} FROM d JOIN steps s ON d.key = s.src WHERE (free OR NOT s.down) AND d.hops < 9),
    nearest AS (SELECT origin, key, min({{'hops': hops, 'via': via}}) AS least FROM d GROUP BY origin, key),
    t(origin, key) AS (SELECT DISTINCT type, type FROM pairs UNION SELECT origin, s.dst FROM t JOIN steps s ON t.key = s.src WHERE NOT s.up),
    bounded AS (SELECT DISTINCT origin FROM t JOIN nodes n ON t.key = n.key WHERE t.key <> origin AND n.containing_type IS DISTINCT FROM origin),
    added AS (SELECT n.key, {{'hops': p.hops + n.least.hops, 'via': CASE WHEN n.key = p.decl THEN {{'pred': p.impl, 'kind': p.kind}} ELSE n.least.via END}} AS least
      FROM pairs p JOIN nearest n ON n.origin = p.decl
      WHERE p.type NOT IN (SELECT origin FROM bounded) OR n.key = p.decl OR EXISTS (SELECT 1 FROM t WHERE t.origin = p.type AND t.key = n.key)),
    walked AS (SELECT * FROM impacted UNION ALL SELECT key, min(least) FROM added WHERE key NOT IN (SELECT key FROM impacted) GROUP BY key),
    c(target, head, path, kinds) AS (SELECT key, key, [key], []::INT[] FROM walked UNION
      SELECT target, least.via.pred, list_prepend(least.via.pred, path), list_prepend(least.via.kind, kinds)
      FROM c JOIN walked ON head = key WHERE least.via IS NOT NULL AND NOT list_contains(path, least.via.pred))
    SELECT target, array_to_string(path, ' > ') AS path, array_to_string(kinds, ',') AS kinds, len(list_filter(kinds, lambda k: k = 256))::INT AS upward
    FROM c JOIN walked ON head = key WHERE least.via IS NULL OR list_contains(path, least.via.pred)"""
)
def explain_generalised(bed: Bed) -> DataFrame:
    """The chain from a seed to every impacted key, over declarations that upward edges lead to."""
    nodes, edges = bed.interface_graph()
    g = _graph_of(nodes, edges)
    walked = written(graph.traverse(g, _keys(bed, "C1", "C4", "N2"), predecessors=True), "walked")
    kinds = F.filter(F.transform("path", lambda p: p["kind"]), lambda k: k.isNotNull())
    return graph.paths_to(walked, walked.select("key")).select(
        "target",
        F.array_join(F.transform("path", lambda p: p["key"]), " > ").alias("path"),
        F.array_join(F.transform(kinds, lambda k: k.cast("string")), ",").alias("kinds"),
        F.size(F.filter(kinds, lambda k: k == 256)).alias("upward"),
    )


# Type flow -----------------------------------------------------------------------------------------------------------

_FLOW = f"""{NODES}, {EDGES}, succ AS (
  SELECT src, dst FROM edges WHERE (kind & (~1158)) <> 0
  UNION SELECT containing_type, key FROM nodes WHERE containing_type IS NOT NULL)"""


def _facts(bed: Bed) -> DataFrame:
    return bed.table("supplier").select(
        keyed("S", "s_suppkey").alias("member"),
        F.array(F.concat(F.lit("T"), (F.col("s_suppkey") % 10).cast("string"))).alias("obtained"),
        (F.col("s_suppkey") % 37 == 36).alias("is_unknown"),
    )


@query(
    f"""WITH RECURSIVE {_FLOW}, u(node) AS (
      SELECT 'S' || s_suppkey FROM supplier WHERE s_suppkey % 37 = 36 UNION SELECT s.dst FROM u JOIN succ s ON u.node = s.src),
    f(node, type) AS (
      SELECT 'S' || s_suppkey, 'T' || s_suppkey % 10 FROM supplier WHERE s_suppkey % 37 <> 36
      UNION SELECT s.dst, f.type FROM f JOIN succ s ON f.node = s.src)
    SELECT node, type FROM f WHERE node NOT IN (SELECT node FROM u)"""
)
def type_flow_obtainable(bed: Bed) -> DataFrame:
    known, _ = typeflow.obtainable(written(bed.nodes(), "nodes"), graph.merge_edges(bed.raw_edges()), _facts(bed))
    return known


@query(
    f"""WITH RECURSIVE {_INTERFACES}, succ AS (SELECT src, dst FROM edges WHERE (kind & (~1158)) <> 0
      UNION SELECT 'C' || c, 'N' || n FROM own UNION SELECT containing_type, key FROM nodes WHERE containing_type IS NOT NULL),
    f(node, type) AS (SELECT 'C' || c_custkey, c_custkey FROM customer UNION SELECT s.dst, f.type FROM f JOIN succ s ON f.node = s.src),
    u(node) AS (SELECT node FROM f GROUP BY node HAVING count(*) > 4 UNION SELECT s.dst FROM u JOIN succ s ON u.node = s.src)
    SELECT node, count(*)::INT AS types FROM f WHERE node NOT IN (SELECT node FROM u) GROUP BY node UNION ALL SELECT node, -1 FROM u"""
)
def type_flow_saturated(bed: Bed) -> DataFrame:
    facts = bed.table("customer").select(
        keyed("C", "c_custkey").alias("member"), F.array(keyed("T", "c_custkey")).alias("obtained"), F.lit(False).alias("is_unknown")
    )
    nodes, edges = bed.interface_graph()
    up = graph.merge_edges(edges).unionByName(
        bed.table("customer").select(keyed("C", "c_custkey").alias("src"), keyed("N", "c_nationkey").alias("dst"), F.lit(1).alias("kind"))
    )
    known, unknown = typeflow.obtainable(nodes, up, facts, saturation=4)
    counted = known.groupBy("node").agg(F.count("*").cast("int").alias("types"))
    return counted.unionByName(unknown.select("node", F.lit(-1).alias("types")))


@query(
    f"""WITH {NODES}, {EDGES}
    SELECT DISTINCT containing_type AS type FROM nodes JOIN edges ON src = key
    WHERE (edges.kind & 768) <> 0 AND (edges.kind & (~768)) = 0 AND containing_type IS NOT NULL"""
)
def type_flow_bounded(bed: Bed) -> DataFrame:
    return typeflow.bounded_types(bed.nodes(), graph.merge_edges(bed.raw_edges()))


# Changes -------------------------------------------------------------------------------------------------------------

_DECLS = f"""{SITES}, touched AS (
  SELECT h.*, CASE WHEN is_type THEN 2 ELSE 1 END AS tier, key, is_inlined
  FROM hunks h JOIN sites t ON h.file = t.file AND t.s <= h.end_line AND h.start_line <= t.e
), best AS (
  SELECT file, start_line, end_line, min(tier) AS tier FROM touched GROUP BY ALL
), inside AS (
  SELECT t.* FROM touched t JOIN best b USING (file, start_line, end_line, tier)
), outside AS (
  SELECT h.*, 3 AS tier, s.key, FALSE AS is_inlined FROM hunks h
  LEFT JOIN (SELECT DISTINCT file, key FROM sites WHERE is_type) s ON h.file = s.file
  WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.file = h.file AND b.start_line = h.start_line)
), declared AS (SELECT DISTINCT * FROM (SELECT * FROM inside UNION ALL SELECT * FROM outside))"""


@query(f"WITH {_DECLS} SELECT file, start_line, end_line, tier, key, is_inlined FROM declared")
def changed_decls(bed: Bed) -> DataFrame:
    return changes.changed_declarations(bed.hunks(), bed.sites(), bucket=16).drop("project")


@query(
    f"""WITH {_DECLS}
    SELECT 'seed' AS what, key AS value FROM declared WHERE key IS NOT NULL AND NOT is_inlined
    UNION SELECT 'seed', 'T' || split_part(key, '-', 1) FROM declared WHERE is_inlined
    UNION SELECT 'ConstantInlining', key || ': its value is copied to where it is used' FROM declared WHERE is_inlined
    UNION SELECT 'unmapped', file || ':' || start_line || '-' || end_line FROM declared WHERE key IS NULL"""
)
def change_seeds(bed: Bed) -> DataFrame:
    spark = bed.spark
    declared = changes.changed_declarations(bed.hunks(), bed.sites(), bucket=16)
    inlined = bed.sites().where("is_inlined").select("key").distinct()
    owners = inlined.select(
        "key", F.concat(F.lit("T"), F.substring_index("key", "-", 1)).alias("containing_type"), F.col("key").alias("display")
    )
    nothing = spark.createDataFrame([], "project string, file string")
    usings = spark.createDataFrame([], "project string, file string, start_line int, end_line int")
    found = changes.new_side(declared, owners, nothing, usings)
    return (
        found.seeds.select(F.lit("seed").alias("what"), F.col("key").alias("value"))
        .unionByName(found.widenings.select(F.col("cause").alias("what"), F.col("detail").alias("value")))
        .unionByName(found.unmapped.select(F.lit("unmapped").alias("what"), F.col("detail").alias("value")))
    )


@query(
    """WITH old AS (
      SELECT p_brand AS file, p_partkey % 90 + 1 AS s, p_partkey % 90 + 4 AS e, p_partkey % 5 = 0 AS is_type,
             p_brand || '.' || split_part(p_name, ' ', 1) AS path, split_part(p_name, ' ', 2) AS member FROM part),
    hunks AS (SELECT DISTINCT p_brand AS file, p_size AS start_line, p_size + 1 AS end_line FROM part),
    types AS (SELECT DISTINCT p_brand || '.' || split_part(p_name, ' ', 1) AS path,
                p_type || '|' || p_brand || '.' || split_part(p_name, ' ', 1) AS type FROM part WHERE p_size <= 25),
    members AS (SELECT DISTINCT p_type || '|' || p_brand || '.' || split_part(p_name, ' ', 1) AS type,
                split_part(p_name, ' ', 2) AS member, 'm' || p_partkey AS key FROM part WHERE p_size <= 12),
    touched AS (SELECT h.*, o.is_type, o.path, o.member FROM hunks h JOIN old o
                ON h.file = o.file AND o.s <= h.end_line AND h.start_line <= o.e),
    best AS (SELECT file, start_line, bool_and(is_type) AS only_types FROM touched GROUP BY ALL),
    asked AS (SELECT DISTINCT t.file, t.path, CASE WHEN NOT t.is_type THEN t.member END AS member
              FROM touched t JOIN best b USING (file, start_line) WHERE t.is_type = b.only_types)
    SELECT DISTINCT a.file, a.path AS type_path, coalesce(m.key, t.type) AS key
    FROM asked a LEFT JOIN types t ON a.path = t.path LEFT JOIN members m ON t.type = m.type AND a.member = m.member"""
)
def old_side_match(bed: Bed) -> DataFrame:
    part = bed.table("part")
    word = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    path = F.concat_ws(".", "p_brand", word(1))
    key = F.concat_ws("|", "p_type", path)
    line = (F.col("p_partkey") % 90).cast("int")
    decls = part.select(
        F.lit("p").alias("project"),
        F.col("p_brand").alias("file"),
        (line + 1).alias("start_line"),
        (line + 4).alias("end_line"),
        (F.col("p_partkey") % 5 == 0).alias("is_type"),
        path.alias("type_path"),
        word(2).alias("member_name"),
    )
    hunks = (
        part.select(F.lit("p").alias("project"), F.col("p_brand").alias("file"), F.col("p_size").alias("start_line"), (F.col("p_size") + 1).alias("end_line"))
        .distinct()
    )
    types = part.where("p_size <= 25").select(path.alias("type_path"), key.alias("type")).distinct()
    members = part.where("p_size <= 12").select(
        key.alias("type"), word(2).alias("member_name"), keyed("m", "p_partkey").alias("member")
    ).distinct()
    return changes.old_side(hunks, decls, types, members).select("file", "type_path", "key")


_URL_PATH = "regexp_extract(url, '^[^:]*://([^?#]*)', 1)"


@query(
    f"""WITH files AS (SELECT page_id, {_URL_PATH} AS path FROM pages),
    dirs AS (SELECT DISTINCT regexp_extract(path, '^([^/]*)', 1) AS dir, 'host' AS name FROM files WHERE page_id % 3 = 0
             UNION SELECT DISTINCT regexp_extract(path, '^([^/]*/[^/]*)', 1), 'section' FROM files WHERE page_id % 7 = 0),
    met AS (SELECT f.page_id, f.path, d.dir, d.name, row_number() OVER (
              PARTITION BY f.page_id ORDER BY length(d.dir) DESC NULLS LAST, d.name) AS n
            FROM files f LEFT JOIN dirs d ON starts_with(f.path, d.dir || '/') AND d.dir <> '')
    SELECT page_id, path, dir, name FROM met WHERE n = 1"""
)
def owning_prefix(bed: Bed) -> DataFrame:
    files = bed.table("pages").select("page_id", F.regexp_extract("url", r"^[^:]*://([^?#]*)", 1).alias("path"))
    hosts = files.where("page_id % 3 = 0").select(F.regexp_extract("path", r"^([^/]*)", 1).alias("dir"), F.lit("host").alias("name"))
    sections = files.where("page_id % 7 = 0").select(
        F.regexp_extract("path", r"^([^/]*/[^/]*)", 1).alias("dir"), F.lit("section").alias("name")
    )
    dirs = hosts.unionByName(sections).distinct().where("dir <> ''").withColumn("ord", F.col("name"))
    return longest_prefix(files, "path", dirs, "dir", "ord").select("page_id", "path", "dir", "name")


@query(
    """WITH variants AS (
      SELECT doc_id, text AS old_text, CASE doc_id % 3 WHEN 0 THEN replace(text, ' ', '  ') WHEN 1 THEN text || ' more' ELSE text END
        AS new_text, doc_id % 5 = 4 AS has_generated FROM documents)
    SELECT doc_id, NOT has_generated AND [x FOR x IN regexp_split_to_array(old_text, '[ \\n]+') IF x <> '']
      = [x FOR x IN regexp_split_to_array(new_text, '[ \\n]+') IF x <> ''] AS trivia_only FROM variants"""
)
def trivia_only(bed: Bed) -> DataFrame:
    new = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit(" "), F.lit("  "))).when(
        F.col("doc_id") % 3 == 1, F.concat("text", F.lit(" more"))
    ).otherwise(F.col("text"))
    tokens = lambda c: F.filter(F.split(c, "[ \n]+"), lambda x: x != "")
    rows = bed.table("documents").select(
        "doc_id",
        F.lit("Modified").alias("kind"),
        (F.col("doc_id") % 5 == 4).alias("has_generated"),
        tokens(F.col("text")).alias("old_tokens"),
        tokens(new).alias("new_tokens"),
    )
    return changes.trivia_only(rows).select("doc_id", "trivia_only")


@query(
    """WITH g AS (SELECT source AS project, doc_id AS hint, text AS base_text,
        CASE WHEN doc_id % 50 = 7 AND source IN ('src7', 'src1') THEN NULL WHEN doc_id % 5 = 0 THEN text || '.' ELSE text END AS head_text,
        source <> 'src3' AS inside FROM documents),
    s AS (SELECT project, count(*) AS emitted,
            count(*) FILTER (base_text IS DISTINCT FROM head_text AND head_text IS NOT NULL) AS changed,
            count(*) FILTER (head_text IS NULL) AS missing, bool_and(inside) AS inside FROM g GROUP BY project)
    SELECT project, emitted, changed, missing, CASE WHEN emitted = 0 THEN 'none' WHEN NOT inside THEN 'widen'
      WHEN missing > 0 THEN 'all' WHEN changed = 0 THEN 'note' ELSE 'changed' END AS verdict FROM s"""
)
def generated_diff(bed: Bed) -> DataFrame:
    head = (
        F.when((F.col("doc_id") % 50 == 7) & F.col("source").isin("src7", "src1"), F.lit(None).cast("string"))
        .when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(".")))
        .otherwise(F.col("text"))
    )
    rows = bed.table("documents").select(
        F.col("source").alias("project"),
        F.col("doc_id").alias("hint"),
        F.col("text").alias("base_text"),
        head.alias("head_text"),
        (F.col("source") != "src3").alias("in_compilation"),
    )
    return changes.generated_diff(rows)


@query(
    """WITH f AS (SELECT lang AS project, source AS file, lang || '-' || (doc_id % 9) AS description, doc_id AS ord FROM documents)
    SELECT project, file, arg_min(description, ord) AS first, count(*) - 1 AS more FROM f GROUP BY project, file"""
)
def reflection_files(bed: Bed) -> DataFrame:
    rows = bed.table("documents").select(
        F.col("lang").alias("project"),
        F.col("source").alias("file"),
        F.concat("lang", F.lit("-"), (F.col("doc_id") % 9).cast("string")).alias("description"),
        F.col("doc_id").alias("ord"),
    )
    return changes.reflection_files(rows)


@query(
    """WITH c AS (SELECT 'src/' || p_name || '-' || p_partkey || '.cs' AS path, p_partkey, p_size FROM part WHERE p_type IN ('SMALL', 'PROMO', 'ECONOMY')),
    u AS (SELECT CASE WHEN p_size % 10 = 0 THEN 'src/bin/' ELSE 'src/' END || p_name || '-' || p_partkey || CASE WHEN p_size % 3 = 0
            THEN '.json' ELSE '.cs' END AS path FROM part),
    files AS (SELECT DISTINCT path, 'Modified' AS kind FROM c
              UNION SELECT DISTINCT path, 'Added' FROM u WHERE path NOT IN (SELECT path FROM c)),
    h AS (SELECT DISTINCT path, 'new' AS side, p_partkey % 100 + 1 AS s, p_partkey % 100 + 3 AS e FROM c WHERE p_size <= 20),
    sides AS (SELECT f.*, side FROM files f, (VALUES ('old'), ('new')) v(side) WHERE NOT regexp_matches(path, '(^|/)(bin|obj|\\.tidemark)/')),
    r AS (SELECT path, side, string_agg(s || '-' || e, ',' ORDER BY s, e) AS ranges FROM h GROUP BY path, side)
    SELECT s.path, s.kind, s.side, CASE WHEN NOT ends_with(lower(s.path), '.cs') THEN ''
        WHEN s.path IN (SELECT path FROM h) THEN coalesce(r.ranges, '')
        WHEN s.side = 'old' AND s.kind = 'Added' THEN '' ELSE '1-2147483647' END AS ranges
    FROM sides s LEFT JOIN r ON s.path = r.path AND s.side = r.side"""
)
def diff_resolution(bed: Bed) -> DataFrame:
    part = bed.table("part")
    name = F.concat_ws("-", "p_name", "p_partkey")
    tracked = part.where(F.col("p_type").isin("SMALL", "PROMO", "ECONOMY")).withColumn("path", F.concat(F.lit("src/"), name, F.lit(".cs")))
    changed = tracked.select("path", F.lit(None).cast("string").alias("old_path"), F.lit("Modified").alias("kind")).distinct()
    line = (F.col("p_partkey") % 100).cast("int")
    hunks = tracked.where("p_size <= 20").select(
        "path", F.lit("new").alias("side"), (line + 1).alias("start_line"), (line + 3).alias("end_line")
    )
    folder = F.when(F.col("p_size") % 10 == 0, "src/bin/").otherwise("src/")
    ending = F.when(F.col("p_size") % 3 == 0, ".json").otherwise(".cs")
    untracked = part.select(F.concat(folder, name, ending).alias("path"))
    ranges = F.transform("ranges", lambda r: F.concat_ws("-", r["start_line"], r["end_line"]))
    return changes.resolve_diff(changed, hunks, untracked).select("path", "kind", "side", F.array_join(ranges, ",").alias("ranges"))


@query(
    """WITH n AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey, l_partkey, l_suppkey, l_linenumber::BIGINT AS ln FROM lineitem),
    h AS (SELECT id, 'old' AS side, l_orderkey AS s, 1 AS n FROM n UNION ALL SELECT id, 'new', l_partkey, ln - 1 FROM n
          UNION ALL SELECT id, 'old', l_suppkey, ln FROM n UNION ALL SELECT id, 'new', l_suppkey, 0 FROM n),
    named AS (SELECT id, 'f' || id || '.cs' AS path FROM n UNION ALL SELECT id, 'g' || id || '.cs' FROM n WHERE id % 2 = 0)
    SELECT DISTINCT path, side, (CASE WHEN n = 0 THEN greatest(1, s) ELSE s END)::INT AS start_line,
           (CASE WHEN n = 0 THEN greatest(1, s + 1) ELSE s + n - 1 END)::INT AS end_line
    FROM h JOIN named USING (id)"""
)
def hunk_scan(bed: Bed) -> DataFrame:
    rows = bed.table("lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id")
    )
    new = F.format_string("f%d.cs", "id")
    old = F.when(F.col("id") % 2 == 0, F.format_string("g%d.cs", "id")).otherwise(new)
    text = F.concat(
        F.format_string("diff --git a/%s b/%s\n--- a/%s\n+++ b/%s\n", old, new, old, new),
        # Removed and added lines that look like names.
        F.format_string("@@ -%d +%d,%d @@ x\n-old\n--- a/drop note\n+++ b/add note\n", F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber") - 1),
        F.format_string("@@ -%d,%d +%d,0 @@\n", "l_suppkey", "l_linenumber", "l_suppkey"),
    )
    # A text for each thousand files or so.
    texts = rows.select(F.call_function("div", F.col("id"), F.lit(8000)).alias("part"), text.alias("t")).groupBy("part").agg(
        F.array_join(F.collect_list("t"), "").alias("text")
    )
    return gitdiff.parse_hunks_by_file(texts, "part").drop("part")


@query(
    """SELECT doc_id, source || '/' || doc_id || '.cs' AS path, CASE WHEN doc_id % 3 = 1 THEN lang || '/' || doc_id || '.cs' END AS old_path,
        CASE doc_id % 3 WHEN 0 THEN 'Added' WHEN 1 THEN 'Renamed' ELSE 'Deleted' END AS kind FROM documents"""
)
def name_status(bed: Bed) -> DataFrame:
    nul = F.lit("\0")
    path = F.concat("source", F.lit("\\"), F.col("doc_id").cast("string"), F.lit(".cs"))
    old = F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".cs"))
    record = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("A"), nul, path, nul))
        .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("R087"), nul, old, nul, path, nul))
        .otherwise(F.concat(F.lit("D"), nul, path, nul))
    )
    texts = bed.table("documents").groupBy((F.col("doc_id") % 50).alias("part")).agg(
        F.array_join(F.collect_list(record), "").alias("text")
    )
    found = gitdiff.parse_name_status(texts)
    return found.withColumn("doc_id", F.regexp_extract("path", r"/(\d+)\.cs", 1).cast("long"))


# Routes --------------------------------------------------------------------------------------------------------------


@query(f"WITH {ROUTES} SELECT DISTINCT template, CASE WHEN len([x FOR x IN segments IF x <> '*']) > 0 THEN array_to_string(segments, '/') END AS normal FROM parts")
def route_normalise(bed: Bed) -> DataFrame:
    return bed.routes().select("template", normalise_route(F.col("template")).alias("normal")).distinct()


@query(
    f"""WITH {ROUTES}
    SELECT DISTINCT e.owner AS src, r.owner AS dst, 1024 AS kind FROM normal e JOIN normal r
    ON e.is_endpoint AND NOT r.is_endpoint AND len(e.segments) = len(r.segments) AND e.owner <> r.owner
    AND len([i FOR i IN range(1, len(e.segments) + 1) IF e.segments[i] <> '*' AND e.segments[i] <> r.segments[i]]) = 0"""
)
def route_match(bed: Bed) -> DataFrame:
    return routes.match_routes(bed.routes())


@query(
    f"""WITH {ROUTES}, h AS (
      SELECT CASE WHEN page_id % 2 = 0 THEN 'WEB' || (page_id % 7) || '/Routes' || (page_id % 13) || '.cs'
             ELSE 's' || (page_id % 13) || '.CS' END AS path, page_id % 50 AS a, page_id % 50 + 5 AS b FROM pages),
    hit AS (SELECT r.* FROM routes r JOIN h ON r.is_endpoint AND ends_with(lower(r.file), lower(h.path)) AND r.line BETWEEN h.a AND h.b),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY file, line, template) AS n FROM hit)
    SELECT project, template FROM ranked WHERE n = 1"""
)
def route_widen(bed: Bed) -> DataFrame:
    page = F.col("page_id")
    s = lambda c: c.cast("string")
    path = F.when(page % 2 == 0, F.concat(F.lit("WEB"), s(page % 7), F.lit("/Routes"), s(page % 13), F.lit(".cs"))).otherwise(
        F.concat(F.lit("s"), s(page % 13), F.lit(".CS"))
    )
    hunks = bed.table("pages").select(
        path.alias("path"), F.lit("new").alias("side"), (page % 50).cast("int").alias("start_line"), (page % 50 + 5).cast("int").alias("end_line")
    )
    return routes.changed_templates(bed.routes(), hunks).select("project", "template")


# Safety and names ----------------------------------------------------------------------------------------------------

_TRIGGER_PATH = """CASE p_partkey % 8 WHEN 0 THEN 'Src/' || p_brand || '/' || p_name || '.CSPROJ' WHEN 1 THEN p_type || '/Directory.Build.' || p_size
  WHEN 2 THEN 'a/Global.json' WHEN 3 THEN 'a/' || p_name || '.cs' WHEN 4 THEN p_name || '.props' WHEN 5 THEN 'x/.editorconfig'
  WHEN 6 THEN 'docs/' || p_name ELSE 'a/' || p_name || '.sln.txt' END"""


@query(
    f"""WITH p AS (SELECT p_partkey, {_TRIGGER_PATH} AS path FROM part),
    n AS (SELECT *, lower(regexp_extract(path, '([^/]*)$', 1)) AS name FROM p)
    SELECT p_partkey, path, CASE
      WHEN name IN ('global.json', 'nuget.config', 'packages.lock.json', '.editorconfig', 'dotnet-tools.json')
        THEN path || ': every build reads it'
      WHEN regexp_matches(name, '^directory\\.(build|packages|solution)\\.') THEN path || ': projects below it are built by it'
      WHEN regexp_matches(name, '\\.(csproj|vbproj|fsproj|sln|slnx|slnf|props|targets)$')
        THEN path || ': it steers the build, which no symbol stands for' END AS reason,
      path <> '' AND NOT ends_with(lower(path), '.cs') AS is_content FROM n"""
)
def full_run_triggers(bed: Bed) -> DataFrame:
    rows = bed.table("part").select("p_partkey", F.expr(_TRIGGER_PATH).alias("path"))
    path = F.col("path")
    return rows.select(
        "p_partkey", "path", safety.trigger_reason(path).alias("reason"), safety.is_content(path).alias("is_content")
    )


_WATCH_PATH = """CASE p_partkey % 6 WHEN 0 THEN '/repo/src/' || p_name || '.cs' WHEN 1 THEN '/repo/Bin/' || p_name WHEN 2 THEN '/other/' || p_name
  WHEN 3 THEN '/repo/a/testresults/' || p_name WHEN 4 THEN '/repo/' || p_brand || '.slnx' ELSE '/repo/binary/' || p_name || '.csproj' END"""


@query(
    f"""WITH p AS (SELECT p_partkey, {_WATCH_PATH} AS path FROM part)
    SELECT p_partkey, starts_with(path, '/repo/') AND NOT regexp_matches(lower(substr(path, 7)),
             '(^|/)(bin|obj|\\.git|\\.vs|\\.idea|node_modules|testresults|artifacts|\\.tidemark)(/|$)') AS watched,
           regexp_matches(lower(path), '(proj|\\.props|\\.targets|\\.sln|\\.slnx|\\.slnf)$') AS reopen FROM p"""
)
def watch_paths(bed: Bed) -> DataFrame:
    rows = bed.table("part").select("p_partkey", F.expr(_WATCH_PATH).alias("path"))
    path = F.col("path")
    return rows.select("p_partkey", safety.is_watched(path, "/repo").alias("watched"), safety.needs_reopen(path).alias("reopen"))


@query(
    """WITH a AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN ['xunit.v3.core', 'xunit.core'] WHEN 1 THEN ['xunit.abstractions']
        WHEN 2 THEN ['nunit.framework', 'Microsoft.Testing.Platform'] WHEN 3 THEN ['TUnit.Core']
        WHEN 4 THEN ['Microsoft.VisualStudio.TestPlatform.TestFramework', 'Microsoft.VisualStudio.TestPlatform.ObjectModel']
        WHEN 5 THEN ['x'] ELSE ['Microsoft.Testing.Platform'] END AS asm, p_size % 5 = 0 AS asked, p_size % 7 = 0 AS sdk, p_size % 11 = 0 AS explicit_no
        FROM part),
    f AS (SELECT *, CASE WHEN p_partkey % 7 = 0 THEN 'XUnitV3' WHEN p_partkey % 7 = 1 THEN 'XUnitV2' WHEN p_partkey % 7 = 2 THEN 'NUnit'
        WHEN p_partkey % 7 = 4 THEN 'MSTest' WHEN p_partkey % 7 = 3 THEN 'TUnit' ELSE 'Unknown' END AS framework FROM a)
    SELECT p_partkey, framework, CASE WHEN framework = 'TUnit' OR asked OR sdk THEN 'MicrosoftTestingPlatform'
        WHEN list_contains(asm, 'Microsoft.VisualStudio.TestPlatform.ObjectModel') THEN 'VSTest'
        WHEN list_contains(asm, 'Microsoft.Testing.Platform') THEN 'MicrosoftTestingPlatform' ELSE 'VSTest' END AS runner,
        NOT explicit_no AND framework <> 'Unknown' AS is_test FROM f"""
)
def project_kinds(bed: Bed) -> DataFrame:
    lists = [
        ["xunit.v3.core", "xunit.core"],
        ["xunit.abstractions"],
        ["nunit.framework", "Microsoft.Testing.Platform"],
        ["TUnit.Core"],
        ["Microsoft.VisualStudio.TestPlatform.TestFramework", "Microsoft.VisualStudio.TestPlatform.ObjectModel"],
        ["x"],
        ["Microsoft.Testing.Platform"],
    ]
    choice = F.element_at(F.array(*[F.array(*map(F.lit, x)) for x in lists]), (F.col("p_partkey") % 7 + 1).cast("int"))
    size = F.col("p_size")
    props = F.create_map(
        F.lit("EnableNUnitRunner"),
        F.when(size % 5 == 0, "TRUE").otherwise("false"),
        F.lit("GlobalJsonTestRunner"),
        F.when(size % 7 == 0, "Microsoft.Testing.Platform").otherwise("VSTest"),
    )
    rows = bed.table("part").select("p_partkey", choice.alias("asm"), props.alias("props"), (size % 11 == 0).alias("no"))
    rows = rows.withColumn("framework", safety.detect_framework(F.col("asm")))
    explicit = F.when(F.col("no"), F.lit(False))
    return rows.select(
        "p_partkey",
        "framework",
        safety.detect_runner(F.col("framework"), F.col("props"), F.col("asm")).alias("runner"),
        safety.is_test_project(explicit, F.lit(None).cast("boolean"), F.col("framework")).alias("is_test"),
    )


_KEY = """CASE p_partkey % 5 WHEN 0 THEN p_brand || '|T:Lib.' || p_type || '`1.In`2' WHEN 1 THEN p_brand || '|M:Lib.' || p_type || '.Do`1(System.Int32,A.B)'
  WHEN 2 THEN p_brand || '|M:Lib.X.Ns#IFace#' || p_type WHEN 3 THEN p_brand || '|M:Lib.X.#ctor(System.String)' ELSE 'Method:' || p_name END"""


@query(
    f"""WITH k AS (SELECT p_partkey, {_KEY} AS key FROM part),
    d AS (SELECT *, CASE WHEN contains(key, '|') THEN regexp_extract(key, '^[^|]*\\|(.*)$', 1) END AS doc FROM k),
    b AS (SELECT *, split_part(substr(doc, 3), '(', 1) AS body FROM d),
    l AS (SELECT *, regexp_extract(body, '([^.]*)$', 1) AS last FROM b)
    SELECT p_partkey, key, CASE WHEN starts_with(doc, 'T:') THEN
             array_to_string([split_part(x, '`', 1) FOR x IN string_split(substr(doc, 3), '.')], '.') END AS type_path,
           CASE WHEN doc IS NOT NULL THEN nullif(split_part(CASE WHEN contains(substr(last, 2), '#')
             THEN regexp_extract(last, '([^#]*)$', 1) ELSE last END, '`', 1), '') END AS simple_name FROM l"""
)
def symbol_keys(bed: Bed) -> DataFrame:
    rows = bed.table("part").select("p_partkey", F.expr(_KEY).alias("key"))
    return rows.select(
        "p_partkey", "key", names.type_path(F.col("key")).alias("type_path"), names.simple_name(F.col("key")).alias("simple_name")
    )


_TEST_NAME = """CASE p_partkey % 4 WHEN 0 THEN ' Ns.C.' || p_type || '(x: 1, y: f(2)) ' WHEN 1 THEN 'Ns.C.' || p_type || ' '
  WHEN 2 THEN p_type || '(a)(b) tail' ELSE 'M&(a|b)=~!' || p_brand END"""


@query(
    f"""WITH t AS (SELECT p_partkey, p_brand, p_type, {_TEST_NAME} AS name FROM part)
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Ns.C.' || p_type WHEN 1 THEN 'Ns.C.' || p_type WHEN 2 THEN p_type || ' tail'
             ELSE 'M&=~!' || p_brand END AS plain,
           CASE WHEN starts_with(trim(name), 'Ns.C.') THEN trim(name) ELSE 'Ns.C.' || trim(name) END AS qualified,
           regexp_replace(name, '([\\\\()&|=!~])', '\\\\\\1', 'g') AS vstest,
           regexp_replace(name, '([/*()\\[\\]|&,\\\\])', '\\\\\\1', 'g') AS tree,
           CASE WHEN contains(name, ' ') OR contains(name, '|') THEN '"' || name || '"' ELSE name END AS quoted FROM t"""
)
def normalize_names(bed: Bed) -> DataFrame:
    rows = bed.table("part").select("p_partkey", F.expr(_TEST_NAME).alias("name"))
    name = F.col("name")
    return rows.select(
        "p_partkey",
        names.normalize_test_name(name).alias("plain"),
        names.qualify_test_name(F.lit("Ns.C"), F.trim(name)).alias("qualified"),
        fx.escape_vstest(name).alias("vstest"),
        fx.escape_tree_node(name).alias("tree"),
        fx.shell_quote(name).alias("quoted"),
    )


# Selection and filters -----------------------------------------------------------------------------------------------

_ORDERED = f"""{NODES}, {EDGES}, {STEPS}, {TESTS}, w(key, hops) AS (
  SELECT unnest(['S1', 'N3']), 1 UNION SELECT s.dst, w.hops + 1 FROM w JOIN steps s ON w.key = s.src WHERE NOT s.up AND w.hops < 20),
reached AS (SELECT key, min(hops) AS hops FROM w GROUP BY key),
chosen AS (SELECT t.*, least(coalesce(m.hops, 2147483647), coalesce(c.hops, 2147483647))::INT AS hops
  FROM tests t LEFT JOIN reached m ON t.symbol_key = m.key LEFT JOIN reached c ON t.class_key = c.key
  WHERE m.key IS NOT NULL OR c.key IS NOT NULL OR t.project = 'NATION_5'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY hops, fqn, symbol_key)::INT AS rank FROM chosen)"""


def _ranked(bed: Bed) -> DataFrame:
    reached = graph.reach(_graph(bed), _keys(bed, "S1", "N3"), False)
    tests = selection.named_tests(bed.tests().drop("selected"))
    widened = bed.spark.createDataFrame([("NATION_5",)], "project string")
    return selection.run_order(selection.select_tests(tests, reached, widened))


@query(f"WITH RECURSIVE {_ORDERED} SELECT project, rank, fqn, hops FROM ranked")
def run_order(bed: Bed) -> DataFrame:
    return _ranked(bed).select("project", "rank", "fqn", "hops")


@query(
    f"""WITH RECURSIVE {_ORDERED},
    classes AS (SELECT project, full_class, min(rank) AS first, count(*) AS size FROM ranked GROUP BY ALL),
    taken AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY project ORDER BY first
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken, sum(size) OVER (PARTITION BY project) AS total FROM classes)
    SELECT r.project, r.rank, r.fqn, t.taken < greatest(1, ceil(t.total * 0.25)) AS in_wave
    FROM ranked r JOIN taken t USING (project, full_class)"""
)
def first_wave(bed: Bed) -> DataFrame:
    return selection.first_wave(_ranked(bed)).select("project", "rank", "fqn", "in_wave")


_COLLAPSE = f"""{TESTS}, classes AS (
  SELECT project, full_class, count(*) AS total, count(*) FILTER (selected) AS selected,
         count(*) FILTER (selected) > 1 AND count(*) = count(*) FILTER (selected) AS whole FROM tests GROUP BY ALL),
terms AS (SELECT DISTINCT t.project, CASE WHEN c.whole THEN t.full_class || '.' ELSE t.fqn END AS term, NOT c.whole AS single
  FROM tests t JOIN classes c USING (project, full_class) WHERE t.selected)"""


def _named(bed: Bed) -> DataFrame:
    return selection.named_tests(bed.tests())


@query(f"WITH {_COLLAPSE} SELECT project, full_class, total, selected, whole FROM classes")
def class_collapse(bed: Bed) -> DataFrame:
    return filters.collapse_classes(_named(bed))


@query(
    f"""WITH {_COLLAPSE},
    chosen AS (SELECT t.*, bool_and(c.whole) OVER (PARTITION BY t.project) AS all_whole
               FROM tests t JOIN classes c USING (project, full_class) WHERE t.selected)
    SELECT project, 'vstest' AS dialect, '--filter ' || string_agg('FullyQualifiedName~' || regexp_replace(term, '([\\\\()&|=!~])', '\\\\\\1', 'g'),
             '|' ORDER BY single, term) AS line FROM terms GROUP BY project
    UNION ALL
    SELECT project, 'xunit', string_agg(DISTINCT CASE WHEN all_whole THEN '--filter-class ' || full_class ELSE '--filter-method ' || fqn END, ' '
             ORDER BY CASE WHEN all_whole THEN '--filter-class ' || full_class ELSE '--filter-method ' || fqn END) FROM chosen GROUP BY project
    UNION ALL
    SELECT project, 'tree', '--treenode-filter /*/' || any_value(namespace) || '/' || string_agg(DISTINCT class_name, '|' ORDER BY class_name)
             || '/' || CASE WHEN bool_and(all_whole) THEN '*' ELSE string_agg(DISTINCT method_name, '|' ORDER BY method_name) END
    FROM chosen GROUP BY project"""
)
def filter_terms(bed: Bed) -> DataFrame:
    tests = _named(bed)

    def line(dialect, name: str) -> DataFrame:
        return dialect.arguments(tests).select("project", F.lit(name).alias("dialect"), F.array_join("arguments", " ").alias("line"))

    return (
        line(filters.VsTest(), "vstest")
        .unionByName(line(filters.ClassOrMethod(), "xunit"))
        .unionByName(line(filters.TreeNode(), "tree"))
    )


_PREFIXED = """pre AS (
  SELECT r_name AS project, 'T' || o_orderkey AS fqn, o_orderpriority = '1-URGENT' AS selected, 'K' || o_orderkey AS full_class
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
names AS (SELECT project, fqn, bool_or(selected) AS selected FROM pre GROUP BY ALL)"""


@query(
    f"""WITH {_PREFIXED}
    SELECT DISTINCT c.project, c.fqn FROM names c JOIN names t ON c.project = t.project AND t.selected AND contains(c.fqn, t.fqn)
    WHERE NOT c.selected"""
)
def extra_matches(bed: Bed) -> DataFrame:
    nation, region = bed.table("nation"), bed.table("region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    owners = bed.table("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")
    orders = bed.table("orders").join(owners, F.col("o_custkey") == F.col("c_custkey"))
    names_of = (
        orders.select(
            F.col("r_name").alias("project"),
            keyed("T", "o_orderkey").alias("fqn"),
            (F.col("o_orderpriority") == "1-URGENT").alias("selected"),
        )
        .groupBy("project", "fqn")
        .agg(F.bool_or("selected").alias("selected"))
        .withColumn("full_class", F.concat(F.lit("K"), "fqn"))
    )
    return filters.VsTest().extra(names_of)


@query(
    f"""WITH {_COLLAPSE}, counted AS (
      SELECT project, count(*) FILTER (selected) AS selected, count(*) AS total FROM tests GROUP BY project),
    lines AS (SELECT project, 8 + 3 + 3 + length(string_agg('FullyQualifiedName~' || regexp_replace(term, '([\\\\()&|=!~])', '\\\\\\1', 'g'), '|'))
              AS n FROM terms GROUP BY project),
    reasoned AS (SELECT c.*, CASE WHEN selected = 0 THEN 'nothing selected' WHEN selected / total >= 0.45 THEN 'most of the project is selected'
        WHEN n > 12000 THEN 'the filter would be too long' END AS reason FROM counted c LEFT JOIN lines USING (project))
    SELECT project, selected, total, reason IS NULL AS filtered, reason FROM reasoned"""
)
def filter_plan(bed: Bed) -> DataFrame:
    return filters.filter_plans(_named(bed), filters.VsTest(), coverage=0.45, length_limit=12_000).drop("arguments", "extra_matches")


def _wave_terms(name: str, chosen: str) -> str:
    """Terms and extra matches of the marked tests for which `chosen` holds."""
    return f"""{name}_classes AS (SELECT project, full_class, count(*) FILTER ({chosen}) > 1 AND count(*) = count(*) FILTER ({chosen}) AS whole FROM marked GROUP BY ALL),
    {name}_terms AS (SELECT DISTINCT m.project, CASE WHEN c.whole THEN full_class || '.' ELSE fqn END AS term
      FROM marked m JOIN {name}_classes c USING (project, full_class) WHERE {chosen}),
    {name}_extra AS (SELECT DISTINCT m.project, m.fqn FROM marked m JOIN {name}_terms t ON m.project = t.project AND contains(m.fqn, t.term)
      WHERE NOT coalesce({chosen}, FALSE) AND (m.project, m.fqn) NOT IN (SELECT (project, fqn) FROM marked WHERE {chosen}))"""


@query(
    f"""WITH {_COLLAPSE}, ranked AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY length(priority), fqn, symbol_key) AS rank FROM tests WHERE selected),
    firsts AS (SELECT project, full_class, min(rank) AS first, count(*) AS size FROM ranked GROUP BY ALL),
    sums AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY project ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
      sum(size) OVER (PARTITION BY project) AS n FROM firsts),
    marked AS (SELECT t.*, coalesce(t.selected AND s.taken < greatest(1, ceil(s.n * 0.25)), FALSE) AS in_wave FROM tests t LEFT JOIN sums s USING (project, full_class)),
    {_wave_terms("wave", "selected AND in_wave")}, {_wave_terms("rest", "selected AND NOT in_wave")}, {_wave_terms("single", "selected")},
    overlap AS (SELECT project FROM wave_extra e WHERE (project, fqn) IN (SELECT (project, fqn) FROM marked WHERE selected AND NOT in_wave)
      UNION SELECT project FROM rest_extra WHERE (project, fqn) IN (SELECT (project, fqn) FROM marked WHERE selected AND in_wave)),
    beyond AS (SELECT project FROM (SELECT * FROM wave_extra UNION SELECT * FROM rest_extra) WHERE (project, fqn) NOT IN (
      SELECT (project, fqn) FROM marked WHERE selected UNION SELECT (project, fqn) FROM single_extra)),
    c AS (SELECT project, count(*) FILTER (selected) AS selected, count(*) FILTER (in_wave) AS wave FROM marked GROUP BY project),
    reasoned AS (SELECT *, CASE WHEN selected < 8 THEN 'few' WHEN wave = selected THEN 'one_class' WHEN wave * 2 > selected THEN 'most'
      WHEN project IN (SELECT * FROM overlap) THEN 'overlap' WHEN project IN (SELECT * FROM beyond) THEN 'beyond' END AS reason FROM c)
    SELECT project, selected, wave, reason, reason IS NULL AS split FROM reasoned"""
)
def wave_plan(bed: Bed) -> DataFrame:
    tests = _named(bed)
    ranked = selection.run_order(tests.where("selected").withColumn("hops", F.length("priority")))
    waves = selection.first_wave(ranked).select("project", "symbol_key", "in_wave", "rank")
    marked = tests.join(waves, ["project", "symbol_key"], "left")
    return filters.wave_plans(marked, filters.VsTest())


@query(
    f"""WITH {_COLLAPSE}, counted AS (
      SELECT project, count(*) AS tests, count(*) FILTER (selected) AS impacted FROM tests GROUP BY project)
    SELECT project, tests, impacted, CASE WHEN impacted = 0 THEN 0 WHEN impacted / tests < 0.45 THEN impacted ELSE tests END AS selected
    FROM counted"""
)
def project_totals(bed: Bed) -> DataFrame:
    tests = _named(bed)
    return report.project_totals(tests, filters.filter_plans(tests, filters.VsTest(), coverage=0.45))


# Harness, ledger, reports --------------------------------------------------------------------------------------------


@query(
    """SELECT source AS project, 'D' || l.doc_id || CASE WHEN l.doc_id % 2 = 0 THEN '(x)' ELSE '' END AS test
    FROM labels l JOIN documents d ON l.doc_id = d.doc_id
    WHERE toxic = 1 AND source <> 'src4' AND quality <> 1"""
)
def shadow_misses(bed: Bed) -> DataFrame:
    rows = bed.table("labels").join(bed.table("documents").select("doc_id", "source"), "doc_id")
    name = F.concat(F.lit("D"), F.col("doc_id").cast("string"))
    failures = rows.where("toxic = 1").select(
        F.col("source").alias("project"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(name, F.lit("(x)"))).otherwise(name).alias("test"),
    )
    selected = rows.where("quality = 1").select(F.col("source").alias("project"), name.alias("fqn"))
    unfiltered = bed.spark.createDataFrame([("src4",)], "project string")
    return harness.missed_failures(failures, selected, unfiltered)


@query(
    """WITH c AS (SELECT source, count(*) FILTER (toxic = 1) AS failures, count(*) FILTER (toxic = 1 AND quality = 0) AS misses,
        count(*) FILTER (d.doc_id % 90 = 0) AS unobserved FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY source)
    SELECT source, misses, failures, unobserved, CASE WHEN misses > 0 THEN 'Miss' WHEN unobserved > 0 THEN 'Inconclusive'
      WHEN failures = 0 THEN 'NoFailures' ELSE 'Clean' END AS verdict,
      CASE WHEN misses > 0 THEN 1 WHEN unobserved > 0 THEN 2 ELSE 0 END AS exit_code FROM c"""
)
def shadow_verdict(bed: Bed) -> DataFrame:
    rows = bed.table("labels").join(bed.table("documents").select("doc_id", "source"), "doc_id")
    counts = rows.groupBy("source").agg(
        F.count_if(F.col("toxic") == 1).alias("failures"),
        F.count_if((F.col("toxic") == 1) & (F.col("quality") == 0)).alias("misses"),
        F.count_if(F.col("doc_id") % 90 == 0).alias("unobserved"),
    )
    return harness.shadow_verdict(counts.withColumn("timed_out", F.lit(0))).drop("timed_out")


_RUNS = """runs AS (SELECT user_id, event_id AS seq, event_type = 'error' AS full_run, value / 10 AS a, value AS t,
  CASE WHEN event_type = 'error' THEN 100 ELSE event_id % 100 END AS selected, 100 AS total FROM events),
v AS (SELECT user_id, count(*) AS usable, count(*) FILTER (NOT full_run) AS runs, avg(a) FILTER (NOT full_run) AS a,
  avg(selected / total) FILTER (NOT full_run) AS f, avg(t) FILTER (full_run) AS tf, max(t) AS tm FROM runs WHERE total > 0 AND t > 0 GROUP BY user_id),
told AS (SELECT *, coalesce(tf, tm) AS t, usable >= 3 AND runs > 0 AS ok FROM v)"""


@query(
    f"""WITH {_RUNS}
    SELECT user_id, usable, runs, CASE WHEN ok THEN round(a, 6) END AS analysis_seconds, CASE WHEN ok THEN round(f, 6) END AS selected_fraction,
      CASE WHEN ok THEN round(t, 6) END AS suite_seconds, CASE WHEN ok THEN round(a + f * t, 6) END AS selective_seconds,
      CASE WHEN ok THEN tf IS NOT NULL END AS suite_observed, CASE WHEN ok THEN round(t - (a + f * t), 6) END AS net_seconds,
      CASE WHEN ok AND f < 1 AND a > 0 THEN round(a / (1 - f), 6) END AS break_even,
      coalesce(ok AND (0.5 - 20 / 80) * (t * 80 / 100) >= 4.5, FALSE) AS split FROM told"""
)
def ledger_verdict(bed: Bed) -> DataFrame:
    found = ledger.verdict(bed.runs(), ["user_id"])
    figures = ["analysis_seconds", "selected_fraction", "suite_seconds", "selective_seconds", "net_seconds"]
    return found.select(
        "user_id",
        "usable",
        "runs",
        "suite_observed",
        *[F.round(c, 6).alias(c) for c in figures],
        F.round(ledger.break_even(F.col("analysis_seconds"), F.col("selected_fraction")), 6).alias("break_even"),
        ledger.split_pays(F.col("suite_seconds"), F.lit(20), F.lit(80), F.lit(100)).alias("split"),
    )


@query(
    """SELECT user_id, count(*) AS commits, round(avg(CASE WHEN event_id % 50 = 0 THEN 1 ELSE (event_id % 50) / 50 END), 6) AS selection_ratio,
      round(avg((event_type = 'error')::INT), 6) AS full_run_rate, round(avg((event_type IN ('click', 'error'))::INT), 6) AS widening_rate,
      round(avg(value), 6) AS seconds FROM events GROUP BY user_id"""
)
def replay_summary(bed: Bed) -> DataFrame:
    part = F.col("event_id") % 50
    rows = bed.table("events").select(
        "user_id",
        part.alias("selected"),
        F.when(part == 0, 0).otherwise(50).alias("total"),
        (F.col("event_type") == "error").alias("full_run"),
        F.col("event_type").isin("click", "error").cast("int").alias("widenings"),
        F.col("value").alias("seconds"),
    )
    found = harness.replay_summary(rows, ["user_id"])
    rounded = [F.round(c, 6).alias(c) for c in ("selection_ratio", "full_run_rate", "widening_rate", "seconds")]
    return found.select("user_id", "commits", *rounded)


_FAILED = """ranked AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS rank,
  o_orderpriority = '1-URGENT' AS failed FROM orders),
firsts AS (SELECT o_custkey, min(rank) FILTER (failed) AS first_failure, count(*) AS ordered FROM ranked GROUP BY o_custkey)"""


def _firsts(bed: Bed) -> DataFrame:
    ranked = harness.rank_in_run(bed.table("orders"), ["o_custkey"], ["o_totalprice", "o_orderkey"])
    return harness.first_failures(ranked.withColumn("failed", F.col("o_orderpriority") == "1-URGENT"), ["o_custkey"])


@query(f"WITH {_FAILED} SELECT o_custkey, coalesce(first_failure, 0)::INT AS first_failure, ordered FROM firsts")
def first_failure(bed: Bed) -> DataFrame:
    return _firsts(bed).withColumn("first_failure", F.coalesce("first_failure", F.lit(0)))


@query(
    f"""WITH {_FAILED} SELECT count(*) AS located, round(avg(first_failure / ordered), 6) AS ordered_share,
      round(avg((ordered + 1) / (2 * ordered)), 6) AS expected_share FROM firsts WHERE first_failure IS NOT NULL"""
)
def time_to_failure(bed: Bed) -> DataFrame:
    found = harness.time_to_failure(_firsts(bed))
    return found.select("located", F.round("ordered_share", 6).alias("ordered_share"), F.round("expected_share", 6).alias("expected_share"))


@query(
    """SELECT count(*) FILTER (event_type IN ('view', 'click')) AS usable, count(*) FILTER (event_type = 'signup') AS skipped,
      count(*) FILTER (event_type = 'error') AS timed_out, count(*) FILTER (event_type = 'click') AS misses, FALSE AS passed FROM events"""
)
def mutation_summary(bed: Bed) -> DataFrame:
    kind = F.col("event_type")
    outcome = (
        F.when(kind == "view", "Clean").when(kind == "click", "Miss").when(kind == "signup", "Skipped").when(kind == "error", "TimedOut").otherwise("Other")
    )
    rows = bed.table("events").select(outcome.alias("outcome"), F.when(kind == "click", F.array(F.lit("t"))).alias("misses"))
    return harness.mutation_summary(rows)


@query("SELECT event_type AS skip_reason, count(*) AS times FROM events WHERE value > 50 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def skip_reasons_topk(bed: Bed) -> DataFrame:
    return harness.skip_reasons(bed.table("events").where("value > 50").select(F.col("event_type").alias("skip_reason")))


_HASHED = """h AS (SELECT source AS project, sha256(text) AS hash, lang FROM documents),
content AS (SELECT project, string_agg(hash, chr(10) ORDER BY hash) AS a FROM h GROUP BY project),
refs AS (SELECT project, string_agg(DISTINCT lang, chr(10) ORDER BY lang) AS b FROM h GROUP BY project)"""


def _content(bed: Bed) -> DataFrame:
    docs = bed.table("documents").select(F.col("source").alias("project"), F.sha2("text", 256).alias("hash"), F.col("lang").alias("references"))
    return results.content_hash(docs, docs)


@query(f"WITH {_HASHED} SELECT project, left(sha256(a || chr(10) || b), 32) AS content_hash FROM content JOIN refs USING (project)")
def content_hash(bed: Bed) -> DataFrame:
    return _content(bed)


@query(
    """WITH t AS (SELECT n_name AS project, c_mktsegment AS type, string_agg(DISTINCT c_name, ',' ORDER BY c_name) AS m
      FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
    SELECT project, left(sha256(string_agg(type || ':' || m, chr(10) ORDER BY type || ':' || m)), 32) AS surface_hash FROM t GROUP BY project"""
)
def surface_hash(bed: Bed) -> DataFrame:
    rows = bed.table("customer").join(bed.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return results.surface_hash(rows.select(F.col("n_name").alias("project"), F.col("c_mktsegment").alias("type"), F.col("c_name").alias("member")))


@query(
    f"""WITH {_HASHED}, now AS (SELECT project, left(sha256(a || chr(10) || b), 32) AS fingerprint FROM content JOIN refs USING (project))
    SELECT project, fingerprint, project NOT IN ('src2', 'src9') AS reused FROM now"""
)
def fragment_reuse(bed: Bed) -> DataFrame:
    current = _content(bed).withColumnRenamed("content_hash", "fingerprint")
    changed = F.when(F.col("project") == "src2", F.lit("other")).otherwise(F.col("fingerprint"))
    cached = current.where("project <> 'src9'").withColumn("fingerprint", changed)
    return results.fragment_reuse(current, cached)


@query(
    """WITH e AS (SELECT user_id, ts, event_type AS path, event_type = 'error' AS lost,
        ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR AS far FROM events),
    g AS (SELECT *, sum(coalesce(far, FALSE)::INT) OVER (PARTITION BY user_id ORDER BY ts) AS batch FROM e)
    SELECT user_id, min(ts) AS opened, max(ts) + INTERVAL 6 HOUR AS closed, string_agg(DISTINCT path, ',' ORDER BY path) AS paths,
      bool_or(lost) AS lost, count(*) AS events FROM g GROUP BY user_id, batch"""
)
def quiet_sessions(bed: Bed) -> DataFrame:
    events = bed.table("events").select("user_id", "ts", F.col("event_type").alias("path"), (F.col("event_type") == "error").alias("lost"))
    found = watch.batches(events, "6 hours", ["user_id"])
    return found.withColumn("paths", F.array_join("paths", ","))


@query(
    """WITH s AS (SELECT source || '/' || doc_id AS path, sha256(text) AS hash, doc_id FROM documents)
    SELECT path, CASE WHEN doc_id % 10 = 0 THEN 'added' WHEN doc_id % 10 = 1 THEN 'removed' ELSE 'changed' END AS change
    FROM s WHERE doc_id % 10 < 2 OR doc_id % 10 = 5"""
)
def moved_documents(bed: Bed) -> DataFrame:
    rows = bed.table("documents").select(
        F.concat_ws("/", "source", "doc_id").alias("path"), F.sha2("text", 256).alias("hash"), F.col("doc_id").alias("n")
    )
    state = rows.where("n % 10 <> 0").select("path", "hash")
    touched = F.when(F.col("n") % 10 == 5, F.lit("new")).otherwise(F.col("hash"))
    return watch.moved_documents(state, rows.where("n % 10 <> 1").select("path", touched.alias("hash")))


@query(
    """SELECT l_orderkey AS id, bool_or(l_returnflag = 'R' AND l_linenumber = 7 OR l_linestatus = 'O' AND l_linenumber = 6
      OR l_partkey % 11 = 0) AS reopen FROM lineitem GROUP BY l_orderkey"""
)
def reopen_decisions(bed: Bed) -> DataFrame:
    lines = bed.table("lineitem")
    project_file = (F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 6)
    name = F.when(project_file, keyed("a/P", "l_partkey")).otherwise(keyed("a/F", "l_partkey"))
    batch = lines.select(
        F.col("l_orderkey").alias("id"),
        F.concat(name, F.when(project_file, ".csproj").otherwise(".cs")).alias("path"),
        ((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7) | project_file & (F.col("l_partkey") % 11 == 0)).alias("lost"),
        F.lit(True).alias("exists"),
    )
    known = lines.where("l_partkey % 11 <> 0").select(F.concat(keyed("a/F", "l_partkey"), F.lit(".cs")).alias("path"))
    return watch.reopen_decisions(batch, known)


#: Orders whose results are in the same TRX files, one for each project.
_TRX_ORDERS = 100_000


@query(
    """SELECT 'p' || o_custkey % 20 AS project, CASE WHEN o_orderkey % 3 = 0 THEN 'own' || o_orderkey ELSE 'Ns.K.T' || o_orderkey END AS test,
      CASE WHEN o_orderstatus = 'F' THEN 'Failed' ELSE 'Passed' END AS result FROM orders"""
)
def trx_results(bed: Bed) -> DataFrame:
    oid = F.col("o_orderkey").cast("string")
    rows = bed.table("orders").select(
        F.concat(F.lit("p"), (F.col("o_custkey") % 20).cast("string")).alias("project"),
        # A run writes a file for so many orders: files grow in number with the table, not in length.
        F.floor(F.col("o_orderkey") / _TRX_ORDERS).alias("file"),
        F.when(
            F.col("o_orderkey") % 3 != 0,
            F.concat(F.lit('<UnitTest id="i'), oid, F.lit('"><TestMethod className="Ns.K" name="T'), oid, F.lit('"/></UnitTest>')),
        )
        .otherwise("")
        .alias("definition"),
        F.concat(
            F.lit('<UnitTestResult testId="i'),
            oid,
            F.lit('" testName="own'),
            oid,
            F.lit('" outcome="'),
            F.when(F.col("o_orderstatus") == "F", "Failed").otherwise("Passed"),
            F.lit('"/>'),
        ).alias("outcome"),
    )
    text = F.concat(
        F.lit('<TestRun xmlns="http://x/2010"><TestDefinitions>'),
        F.array_join(F.collect_list("definition"), ""),
        F.lit("</TestDefinitions><Results>"),
        F.array_join(F.collect_list("outcome"), ""),
        F.lit("</Results></TestRun>"),
    )
    return results.parse_trx(rows.groupBy("project", "file").agg(text.alias("text")))


@query(
    """SELECT event_id, '{"userId":' || user_id || ',"eventType":"' || event_type || '"' || CASE WHEN event_id % 2 = 0
      THEN ',"evenValue":' || event_id ELSE '' END || '}' AS json FROM events"""
)
def report_json(bed: Bed) -> DataFrame:
    rows = bed.table("events").select(
        "event_id", "user_id", "event_type", F.when(F.col("event_id") % 2 == 0, F.col("event_id")).alias("even_value")
    )
    return rows.select("event_id", report.json_of(["user_id", "event_type", "even_value"]).alias("json"))


# Extractor tables and remaining rules ---------------------------------------------------------------------------------


@query(
    """WITH bases AS (SELECT DISTINCT p_brand AS type, p_type AS base FROM part WHERE p_size < 10),
    marks AS (SELECT DISTINCT type FROM bases WHERE base IN ('SMALL', 'PROMO') UNION SELECT unnest(['SMALL', 'PROMO'])),
    methods AS (SELECT 'C' || p_partkey % 100 AS class, split_part(p_name, ' ', 2) AS method, 'P' || p_partkey AS symbol_key, p_size AS depth, p_brand AS a
                FROM part),
    found AS (SELECT *, row_number() OVER (PARTITION BY class, method ORDER BY depth, symbol_key) AS n FROM methods WHERE a IN (SELECT type FROM marks))
    SELECT class, method, symbol_key, 'NUnit' AS framework FROM found WHERE n = 1"""
)
def test_discovery(bed: Bed) -> DataFrame:
    return _discovered(bed)


def _discovered(bed: Bed) -> DataFrame:
    part = bed.table("part")
    methods = part.select(
        F.concat(F.lit("C"), (F.col("p_partkey") % 100).cast("string")).alias("class"),
        F.split_part("p_name", F.lit(" "), F.lit(2)).alias("method"),
        keyed("P", "p_partkey").alias("symbol_key"),
        F.col("p_size").alias("depth"),
    )
    attributes = part.select(keyed("P", "p_partkey").alias("symbol_key"), F.col("p_brand").alias("attribute"))
    bases = part.where("p_size < 10").select(F.col("p_brand").alias("type"), F.col("p_type").alias("base")).distinct()
    markers = bed.spark.createDataFrame([("SMALL", "NUnit"), ("PROMO", "NUnit")], "attribute string, framework string")
    return discovery.discover_tests(methods, attributes, bases, markers)


@query(
    """SELECT DISTINCT 'F' || s_suppkey AS src, 'O' || o_orderkey AS dst, 16 AS kind FROM supplier JOIN orders ON s_suppkey = o_custkey"""
)
def fixture_edges(bed: Bed) -> DataFrame:
    fixtures = bed.table("supplier").select(keyed("K", "s_suppkey").alias("class"), keyed("F", "s_suppkey").alias("key"))
    tests = bed.table("orders").select(keyed("K", "o_custkey").alias("class"), keyed("O", "o_orderkey").alias("symbol_key"))
    return discovery.fixture_edges(fixtures, tests)


@query(
    """SELECT DISTINCT l_returnflag || '|P' || l_partkey AS src, l_linestatus || '|O' || l_orderkey AS dst, 1 AS kind
    FROM lineitem WHERE l_returnflag IN ('A', 'N', 'F') AND l_linestatus IN ('A', 'N', 'F')"""
)
def tracked_edges(bed: Bed) -> DataFrame:
    edges = bed.table("lineitem").select(
        F.concat_ws("|", "l_returnflag", keyed("P", "l_partkey")).alias("src"),
        F.concat_ws("|", "l_linestatus", keyed("O", "l_orderkey")).alias("dst"),
        F.lit(1).alias("kind"),
    )
    tracked = bed.spark.createDataFrame([("A",), ("N",), ("F",)], "assembly string")
    return discovery.tracked_edges(edges, tracked).distinct()


@query(
    """WITH a AS (SELECT 'u' || user_id % 20 AS file, 'o' || event_id AS owner, event_type AS member, 't' || event_id % 3 AS receiver, event_id AS ord FROM events),
    hit AS (SELECT *, receiver || '.' || member AS description FROM a
            WHERE (receiver = 't1' AND member = 'view') OR (member IN ('click', 'error') AND receiver = 't2'))
    SELECT file, description, arg_min(owner, ord) AS owner FROM hit GROUP BY ALL"""
)
def reflection_rules(bed: Bed) -> DataFrame:
    receiver = F.concat(F.lit("t"), (F.col("event_id") % 3).cast("string"))
    accesses = bed.table("events").select(
        F.lit("p").alias("project"),
        F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")).alias("file"),
        keyed("o", "event_id").alias("owner"),
        F.col("event_type").alias("member"),
        receiver.alias("receiver"),
        receiver.alias("declaring_type"),
        F.col("event_id").alias("ord"),
    )
    frame = bed.spark.createDataFrame
    strong = frame([("t1", "view")], "type string, member string")
    weak, receivers = frame([("click",), ("error",)], "member string"), frame([("t2",)], "type string")
    return discovery.reflecting_members(accesses, strong, weak, receivers).select("file", "description", "owner")


@query(
    """WITH b AS (SELECT n_name AS type, r_name AS base FROM nation JOIN region ON n_regionkey = r_regionkey),
    o AS (SELECT 'C' || c_custkey AS member, n_name AS type FROM customer JOIN nation ON c_nationkey = n_nationkey),
    w AS (SELECT member, type FROM o UNION SELECT member, base FROM o JOIN b USING (type)),
    s AS (SELECT member, string_agg(type, ',' ORDER BY type) AS obtained FROM w GROUP BY member),
    u AS (SELECT 'C' || c_custkey AS member FROM customer WHERE c_custkey % 9 = 0 UNION SELECT 'S' || s_suppkey FROM supplier)
    SELECT coalesce(s.member, u.member) AS member, coalesce(obtained, '') AS obtained, u.member IS NOT NULL AS is_unknown FROM s FULL JOIN u ON s.member = u.member"""
)
def closed_facts(bed: Bed) -> DataFrame:
    nation, region, customer = bed.table("nation"), bed.table("region"), bed.table("customer")
    bases = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("type"), F.col("r_name").alias("base"))
    obtained = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(keyed("C", "c_custkey").alias("member"), F.col("n_name").alias("type"))
    untracked = customer.where("c_custkey % 9 = 0").select(keyed("C", "c_custkey").alias("member")).unionByName(
        bed.table("supplier").select(keyed("S", "s_suppkey").alias("member"))
    )
    found = discovery.closed_facts(obtained, bases, untracked)
    return found.withColumn("obtained", F.array_join("obtained", ","))


@query(
    """WITH loaded AS (SELECT DISTINCT lower(p_brand || '/' || p_name) AS p, p_type AS fw FROM part WHERE p_size <= 25),
    d AS (SELECT CASE WHEN p_partkey % 5 > 0 THEN upper(p_brand || '/' || p_name) END AS path, 'm' || p_partkey AS reason FROM part),
    declared AS (SELECT DISTINCT p_brand || '/' || p_name AS file, length(p_name) % 4 AS n FROM part),
    counts AS (SELECT p, count(DISTINCT fw) AS c FROM loaded GROUP BY p)
    SELECT coalesce(path, '') AS file, reason FROM d WHERE path IS NULL OR lower(path) NOT IN (SELECT p FROM loaded)
    UNION ALL
    SELECT file, coalesce(c, 0) || ' of ' || n || ' target frameworks loaded' FROM declared LEFT JOIN counts ON lower(file) = p WHERE coalesce(c, 0) < n"""
)
def load_failures(bed: Bed) -> DataFrame:
    part = bed.table("part")
    file = F.concat_ws("/", "p_brand", "p_name")
    diagnostics = part.select(
        keyed("m", "p_partkey").alias("message"), F.when(F.col("p_partkey") % 5 > 0, F.upper(file)).alias("path")
    )
    loaded = part.where("p_size <= 25").select(file.alias("file"), F.col("p_type").alias("framework")).distinct()
    declared = part.select(file.alias("file"), (F.length("p_name") % 4).alias("n")).distinct()
    return safety.load_failures(diagnostics, loaded, declared)


@query(
    """SELECT p_brand AS project, p_type AS name, arg_max(p_name, p_partkey) AS value FROM part GROUP BY ALL"""
)
def declared_properties(bed: Bed) -> DataFrame:
    rows = bed.table("part").select(
        F.col("p_brand").alias("project"), F.col("p_type").alias("name"), F.col("p_name").alias("value"), F.col("p_partkey").alias("file_order")
    )
    return safety.declared_properties(rows)


@query(
    """WITH p AS (SELECT p_type AS root, p_brand, p_size, p_brand || '/s' || p_size || '/P' || p_partkey || '.csproj' AS project,
      p_partkey, p_name, length(p_name) AS n FROM part),
    brand AS (SELECT p_type AS root, p_brand, 'net' || max(p_size) || '.0' AS fw FROM part GROUP BY ALL),
    size AS (SELECT p_type AS root, p_brand, p_size, CASE WHEN count(*) > 1 THEN 'true' ELSE 'false' END AS test FROM part GROUP BY ALL),
    root AS (SELECT p_type AS root, 'r' || count(*) AS runner FROM part GROUP BY ALL),
    s AS (
      SELECT root, project, 'OutputType' AS name, CASE WHEN n % 3 = 0 OR n % 3 = 1 AND p_size = 7 THEN 'Library' WHEN n % 3 = 1 THEN p_name ELSE '' END AS value FROM p
      UNION ALL SELECT root, project, 'EnableMSTestRunner', CASE WHEN n % 3 = 1 AND p_size <> 7 THEN p_brand ELSE root END FROM p
      UNION ALL SELECT p.root, project, 'TargetFramework', fw FROM p JOIN brand USING (root, p_brand)
      UNION ALL SELECT p.root, project, 'IsTestProject', test FROM p JOIN size USING (root, p_brand, p_size)
      UNION ALL SELECT p.root, project, 'GlobalJsonTestRunner', runner FROM p JOIN root USING (root))
    SELECT root, project, name, value FROM s"""
)
def property_chain(bed: Bed) -> DataFrame:
    part = bed.table("part").withColumn("root", F.col("p_type"))
    path = F.concat("p_brand", F.lit("/s"), F.col("p_size").cast("string"), F.lit("/P"), F.col("p_partkey").cast("string"), F.lit(".csproj"))
    part = part.withColumn("project", path)

    def text(*parts) -> Column:
        return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])

    def setting(name: str, value) -> Column:
        return text(f"<{name}>", value, f"</{name}>")

    def props(df: DataFrame, folder, *settings) -> DataFrame:
        body = text("<Project><PropertyGroup>", *settings, "</PropertyGroup></Project>")
        return df.select("root", text(folder, "Directory.Build.props").alias("path"), body.alias("text"))

    n = F.length("p_name") % 3
    # A third of the projects set nothing of ours; a third set two values, one of them in a nested group and twice, and are
    # broken at one size; a third empty one.
    said = text(
        '<Project xmlns="urn:p"><PropertyGroup><OutputType Condition="c">x</OutputType></PropertyGroup><Choose><When><PropertyGroup>',
        setting("OutputType", text("\n ", F.col("p_name"), "\n")),
        setting("EnableMSTestRunner", F.col("p_brand")),
        "</PropertyGroup></When></Choose>",
        F.when(F.col("p_size") == 7, "<").otherwise(""),
        "</Project>",
    )
    own = F.when(n == 0, "<Project><PropertyGroup><Other>1</Other></PropertyGroup><OutputType>y</OutputType></Project>").when(n == 1, said)
    own = own.otherwise("<Project><PropertyGroup><OutputType/></PropertyGroup></Project>")
    by_root = part.groupBy("root").agg(F.count("*").cast("string").alias("n"))
    by_brand = part.groupBy("root", "p_brand").agg(F.max("p_size").cast("string").alias("most"))
    by_size = part.groupBy("root", "p_brand", "p_size").agg(F.count("*").alias("n"))
    runner = text('{"test": {"runner": "r', F.col("n"), '"}}').alias("text")
    files = (
        part.select("root", F.col("project").alias("path"), own.alias("text"))
        .unionByName(props(by_root, "", setting("OutputType", "Library"), setting("EnableMSTestRunner", F.col("root")), setting("TargetFramework", "net1.0")))
        .unionByName(props(by_brand, text(F.col("p_brand"), "/"), setting("TargetFramework", text("net", F.col("most"), ".0")), setting("IsTestProject", "maybe")))
        .unionByName(
            props(
                by_size,
                text(F.col("p_brand"), "/s", F.col("p_size").cast("string"), "/"),
                setting("IsTestProject", F.when(F.col("n") > 1, "true").otherwise("false")),
            )
        )
        .unionByName(by_root.select("root", F.lit("global.json").alias("path"), runner))
    )
    return properties.property_chain(part.select("root", F.col("project").alias("path")), files)


@query(
    """WITH m AS (SELECT 'f' || p_size AS file, p_brand AS variable, '/' || p_name || '/' AS template, p_partkey FROM part),
    g AS (SELECT DISTINCT 'f' || p_size AS file, p_brand AS variable, '/api/' || p_size || '/' AS prefix FROM part WHERE p_size <= 25)
    SELECT p_partkey, CASE WHEN prefix IS NULL THEN template ELSE rtrim(prefix, '/') || '/' || ltrim(template, '/') END AS template
    FROM m LEFT JOIN g USING (file, variable)"""
)
def route_prefix(bed: Bed) -> DataFrame:
    part = bed.table("part")
    file = F.concat(F.lit("f"), F.col("p_size").cast("string")).alias("file")
    maps = part.select(file, F.col("p_brand").alias("variable"), F.concat(F.lit("/"), "p_name", F.lit("/")).alias("template"), "p_partkey")
    groups = part.where("p_size <= 25").select(
        file, F.col("p_brand").alias("variable"), F.concat(F.lit("/api/"), F.col("p_size").cast("string"), F.lit("/")).alias("prefix")
    )
    return routes.resolve_prefixes(maps, groups.distinct()).select("p_partkey", "template")


@query(
    f"""WITH {TESTS}, hits AS (SELECT symbol_key, fqn, ends_with(lower(fqn), 'urgent o77') AS exact FROM tests WHERE contains(lower(fqn), 'urgent o77'))
    SELECT * FROM hits WHERE exact OR NOT (SELECT bool_or(exact) FROM hits)"""
)
def explain_matches(bed: Bed) -> DataFrame:
    return report.explain_matches(_named(bed), "URGENT o77").select("symbol_key", "fqn", "exact")


@query(
    """WITH s AS (SELECT n_name AS project, count(*) AS selected FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 1 GROUP BY 1)
    SELECT n_name AS project, coalesce(selected, 0) AS selected, coalesce(selected > 60, TRUE) AS filtered
    FROM nation LEFT JOIN s ON n_name = project WHERE n_regionkey < 3"""
)
def default_selections(bed: Bed) -> DataFrame:
    nation = bed.table("nation")
    named = nation.select(F.col("n_name").alias("name"), (F.col("n_regionkey") < 3).alias("is_test"))
    counts = (
        bed.table("customer").join(nation.where("n_regionkey <> 1"), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("n_name").alias("project")).agg(F.count("*").alias("selected"))
    )
    return harness.default_selections(named, counts.withColumn("filtered", F.col("selected") > 60))


@query("SELECT event_id AS seq, user_id FROM events ORDER BY event_id DESC LIMIT 100")
def ledger_rows(bed: Bed) -> DataFrame:
    return ledger.keep_last(bed.table("events").select(F.col("event_id").alias("seq"), "user_id"))


@query(
    """SELECT p_partkey, array_to_string(CASE WHEN p_size % 2 = 0 THEN ['dotnet', 'test', p_name] ELSE ['dotnet', 'test', '--project', p_name] END
      || CASE WHEN p_partkey % 5 = 0 THEN ['--no-build'] ELSE [] END
      || CASE WHEN p_size % 2 = 0 AND p_partkey % 2 = 0 AND p_partkey % 3 > 0 THEN ['--'] ELSE [] END
      || CASE WHEN p_partkey % 3 > 0 THEN ['--filter', p_brand] ELSE [] END, ' ') AS command FROM part"""
)
def test_commands(bed: Bed) -> DataFrame:
    key, none = F.col("p_partkey"), F.lit(None).cast("array<string>")
    words = report.test_command(
        F.col("p_name"),
        F.col("p_size") % 2 == 0,
        key % 2 == 0,
        F.when(key % 3 > 0, F.array(F.lit("--filter"), F.col("p_brand"))).otherwise(none),
        F.when(key % 5 == 0, F.array(F.lit("--no-build"))).otherwise(none),
    )
    return bed.table("part").select("p_partkey", F.array_join(words, " ").alias("command"))


@query(
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'Type:' || p_name ELSE coalesce(CASE WHEN p_size % 3 = 1 THEN p_brand END, '<none>') || '|T:' || p_type END AS key,
      CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_brand || '.' || p_type END AS class, p_brand || '+' || p_type AS nested,
      CASE WHEN length(p_name || p_name || p_name || p_name || p_name || p_name) > 48
        THEN left(p_name || p_name || p_name || p_name || p_name || p_name, 45) || '...' ELSE p_name || p_name || p_name || p_name || p_name || p_name END AS short,
      left(sha256(p_name || '|' || p_brand), 16) AS hash, least(greatest(4.0 * p_size, 120.0), 1800.0)::DOUBLE AS budget,
      CASE WHEN k & 256 <> 0 THEN 'implementation -> interface member' WHEN k & 2 <> 0 THEN 'interface member -> implementation'
        WHEN k & 512 <> 0 THEN 'override -> virtual member' WHEN k & 4 <> 0 THEN 'virtual member -> override'
        WHEN k & 16 <> 0 THEN 'fixture -> test' WHEN k & 8 <> 0 THEN 'base type -> derived type' WHEN k & 32 <> 0 THEN 'type -> declared member'
        WHEN k & 64 <> 0 THEN 'attribute -> annotated symbol' WHEN k & 1024 <> 0 THEN 'endpoint -> a member naming its route'
        WHEN k & 128 <> 0 THEN 'handler -> the request type that selects it' ELSE 'referenced by' END AS edge,
      left(sha256(p_name), 9) AS short_commit, CASE WHEN p_size % 3 = 1 THEN 'T:' || p_type END AS documentation_id,
      CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_type || 'Fact' END AS attribute, 'src/' || p_name || '/a.cs' AS path
    FROM (SELECT *, (p_partkey * 37 % 2048)::INT AS k FROM part)"""
)
def scalar_texts(bed: Bed) -> DataFrame:
    # Numbers of 11 bits: every kind of edge, alone and with others.
    rows = bed.table("part").withColumn("kind", (F.col("p_partkey") * 37 % 2048).cast("int"))
    size = F.col("p_size")
    id_of = F.when(size % 3 == 1, F.concat(F.lit("a|T:"), "p_type")).when(size % 3 == 0, F.concat(F.lit("a|t:"), "p_type")).otherwise(F.col("p_type"))
    attribute = F.when(size % 2 == 0, F.concat(F.lit("N.M."), "p_type", F.lit("Attribute"))).otherwise(F.concat("p_type", F.lit("Fact")))
    return rows.select(
        "p_partkey",
        names.symbol_key(
            F.when(size % 3 == 1, F.col("p_brand")),
            F.when(size % 3 != 0, F.concat(F.lit("T:"), "p_type")),
            F.lit("Type"),
            F.col("p_name"),
        ).alias("key"),
        names.full_class_name(F.when(size % 2 == 0, F.lit("")).otherwise(F.col("p_brand")), F.col("p_type")).alias("class"),
        names.nested_class(F.array("p_brand", "p_type")).alias("nested"),
        names.truncate(F.repeat("p_name", F.lit(6))).alias("short"),
        names.short_hash(F.col("p_name"), F.col("p_brand")).alias("hash"),
        names.suite_budget(size.cast("double")).alias("budget"),
        fx.edge_text(F.col("kind")).alias("edge"),
        names.short_commit(F.sha2("p_name", 256)).alias("short_commit"),
        names.documentation_id(id_of).alias("documentation_id"),
        attribute_name(attribute).alias("attribute"),
        names.normalize_path(F.concat(F.lit(" src\\"), "p_name", F.lit("\\a.cs "))).alias("path"),
    )


@query(
    """WITH reached AS (SELECT 'N' || c_nationkey AS type, 'C' || c_custkey AS key, c_mktsegment = 'BUILDING' OR c_acctbal < 0 AS keep, c_nationkey AS n FROM customer),
    bounding AS (SELECT type FROM reached WHERE n % 4 = 0 AND n % 8 <> 4),
    kept AS (SELECT type, key FROM reached WHERE type IN (SELECT type FROM bounding) AND keep)
    SELECT type, key FROM kept UNION ALL SELECT type, key FROM reached WHERE type NOT IN (SELECT type FROM kept)"""
)
def type_flow_narrow(bed: Bed) -> DataFrame:
    customer = bed.table("customer")
    kind, key = keyed("N", "c_nationkey").alias("type"), keyed("C", "c_custkey").alias("key")
    reached = customer.select(kind, key)
    types = bed.table("nation").where("n_nationkey % 4 = 0").select(keyed("N", "n_nationkey").alias("type"))
    facts = bed.table("nation").where("n_nationkey % 8 <> 4").select(F.array(keyed("N", "n_nationkey")).alias("obtained"))
    known = customer.where("c_mktsegment = 'BUILDING'").select(keyed("C", "c_custkey").alias("node"), kind)
    unknown = customer.where("c_acctbal < 0").select(keyed("C", "c_custkey").alias("node"))
    return typeflow.narrow(reached, types, facts, known, unknown)


@query(
    """WITH a AS (SELECT DISTINCT c_mktsegment AS project, 'x' || c_nationkey AS detail FROM customer WHERE c_nationkey < 15),
    b AS (SELECT DISTINCT c_mktsegment, 'x' || c_nationkey FROM customer WHERE c_nationkey >= 10)
    SELECT 'widening' AS what, project, detail FROM (SELECT * FROM a UNION SELECT * FROM b)
    UNION ALL SELECT 'seed', '', 'C' || c_custkey FROM customer
    UNION ALL SELECT 'unmapped', '', 'u' || c_custkey FROM customer WHERE c_nationkey < 15
    UNION ALL SELECT 'unmapped', '', 'u' || c_custkey FROM customer WHERE c_nationkey >= 10"""
)
def change_union(bed: Bed) -> DataFrame:
    def of(nations: str) -> changes.ChangeSet:
        rows = bed.table("customer").where(nations)
        wide = rows.select(
            F.col("c_mktsegment").alias("project"), F.lit("c").alias("cause"), keyed("x", "c_nationkey").alias("detail"), F.lit(True).alias("widens")
        )
        lost = rows.select(keyed("u", "c_custkey").alias("detail"))
        return changes.ChangeSet(rows.select(keyed("C", "c_custkey").alias("key")), wide, lost, lost.limit(0))

    both = of("c_nationkey < 15").union(of("c_nationkey >= 10"))
    none = F.lit("").alias("project")
    return (
        both.widenings.select(F.lit("widening").alias("what"), "project", "detail")
        .unionByName(both.seeds.select(F.lit("seed").alias("what"), none, F.col("key").alias("detail")))
        .unionByName(both.unmapped.select(F.lit("unmapped").alias("what"), none, "detail"))
    )


# The whole analysis, and what stands beside it ------------------------------------------------------------------------


@query(
    f"""WITH {SOLUTION} SELECT project, symbol_key, hops, row_number() OVER (PARTITION BY project ORDER BY hops, fqn, symbol_key)::INT AS rank FROM chosen"""
)
def analyze_selection(bed: Bed) -> DataFrame:
    out = analysis.analyze(bed.solution(), analysis.Options(fallback=False))
    return out.tests.where("selected").select("project", "symbol_key", "hops", "rank")


@query(
    f"""WITH {SOLUTION} SELECT 'seed' AS what, NULL AS project, key AS detail FROM seeds
    UNION ALL SELECT 'DeletedType', project, project || '.Gone' || c || ' was declared in src/' || project || '/C' || c || '.cs and is gone'
      FROM own WHERE segment = 'BUILDING' AND region = 4
    UNION ALL SELECT 'ContentFile', 'NATION_1', 'src/NATION_1/data.json isn''t source and may be read at run time' FROM region WHERE r_name = 'AMERICA'
    UNION ALL SELECT 'ForeignLanguage', 'FS', 'fs/lib.fs is F#, of which no symbol is known' FROM region WHERE r_name = 'ASIA'
    UNION ALL SELECT 'note', NULL, 'src/' || project || '/C' || c || '.cs: only comments or formatting' FROM own WHERE segment = 'FURNITURE'"""
)
def analyze_changes(bed: Bed) -> DataFrame:
    found, _ = analysis.resolve_changes(bed.solution())
    none = F.lit(None).cast("string").alias("project")
    return (
        found.seeds.select(F.lit("seed").alias("what"), none, F.col("key").alias("detail"))
        .unionByName(found.widenings.select(F.col("cause").alias("what"), "project", "detail"))
        .unionByName(found.notes.select(F.lit("note").alias("what"), none, "detail"))
    )


@query(
    """WITH files AS (SELECT DISTINCT p_brand || '/' || p_type || '/' || p_name || CASE WHEN p_size <= 10 THEN '.cs' ELSE '.txt' END AS path FROM part),
    listing AS (SELECT DISTINCT p_brand AS dir, p_brand || '/A.fsproj' AS file FROM part WHERE p_retailprice < 950
      UNION SELECT DISTINCT p_brand || '/' || p_type, p_brand || '/' || p_type || '/B.vcxproj' FROM part WHERE p_size = 50)
    SELECT path, arg_max(file, length(dir)) AS project_file FROM files JOIN listing ON starts_with(path, dir || '/')
    WHERE NOT ends_with(path, '.cs') GROUP BY path"""
)
def unloaded_projects(bed: Bed) -> DataFrame:
    part = bed.table("part")
    ending = F.when(F.col("p_size") <= 10, ".cs").otherwise(".txt")
    files = part.select(F.concat("p_brand", F.lit("/"), "p_type", F.lit("/"), "p_name", ending).alias("path")).distinct()
    listing = part.where("p_retailprice < 950").select(F.concat("p_brand", F.lit("/A.fsproj")).alias("path"))
    listing = listing.unionByName(part.where("p_size = 50").select(F.concat("p_brand", F.lit("/"), "p_type", F.lit("/B.vcxproj")).alias("path")))
    # Files of other kinds are no project files.
    listing = listing.distinct().unionByName(part.select(F.concat("p_brand", F.lit("/"), "p_type", F.lit("/notes.md")).alias("path")).distinct())
    return changes.nearest_project_file(files, listing)


@query(
    """WITH r AS (SELECT source AS project, 'src/' || lang || '.cs' AS file, 'Load' || doc_id AS description,
        CASE WHEN n_chars > 300 THEN 'D' || doc_id END AS owner, doc_id AS ord FROM documents),
    g AS (SELECT project, file, arg_min(description, ord) AS first, count(*) - 1 AS more FROM r GROUP BY ALL)
    SELECT 'seed' AS what, '' AS project, owner AS detail FROM r WHERE owner IS NOT NULL
    UNION ALL SELECT 'told', project, regexp_extract(file, '([^/]*)$', 1) || ' uses ' || first || CASE WHEN more > 0 THEN ' and ' || more || ' more' ELSE '' END
      || '; such members count as changed every time' FROM g
    UNION ALL SELECT 'widens', project, regexp_extract(file, '([^/]*)$', 1) || ' uses ' || description || ', but in no member' FROM r WHERE owner IS NULL
    UNION ALL SELECT 'seed', '', 'X'"""
)
def reflection_seeds(bed: Bed) -> DataFrame:
    rows = bed.table("documents").select(
        F.col("source").alias("project"),
        F.concat(F.lit("src/"), "lang", F.lit(".cs")).alias("file"),
        keyed("Load", "doc_id").alias("description"),
        F.when(F.col("n_chars") > 300, keyed("D", "doc_id")).alias("owner"),
        F.col("doc_id").alias("ord"),
    )
    frame = bed.spark.createDataFrame
    none = frame([], "detail string")
    start = changes.ChangeSet(_keys(bed, "X"), frame([], "project string, cause string, detail string, widens boolean"), none, none)
    found = changes.seed_reflections(start, rows)
    told = found.widenings.select(F.when(F.col("widens"), "widens").otherwise("told").alias("what"), "project", "detail")
    return told.unionByName(found.seeds.select(F.lit("seed").alias("what"), F.lit("").alias("project"), F.col("key").alias("detail")))


@query(
    """WITH failed AS (SELECT DISTINCT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1),
    s AS (SELECT source, count(*) FILTER (n_chars > 15000) AS selected, lang <> 'de' AS filtered FROM documents WHERE source <> 'src5' GROUP BY source, lang <> 'de')
    SELECT f.source AS project FROM failed f LEFT JOIN (SELECT source, sum(selected)::BIGINT AS selected, bool_and(filtered) AS filtered FROM s GROUP BY source) s
      ON f.source = s.source WHERE coalesce(selected, 0) = 0 AND coalesce(filtered, TRUE)"""
)
def silent_projects(bed: Bed) -> DataFrame:
    docs = bed.table("documents")
    failed = docs.join(bed.table("labels").where("toxic = 1"), "doc_id", "left_semi").select(F.col("source").alias("project"))
    state = docs.where("source <> 'src5'").groupBy(F.col("source").alias("project")).agg(
        F.count_if(F.col("n_chars") > 15000).alias("selected"), F.bool_and(F.col("lang") != "de").alias("filtered")
    )
    return harness.silent_projects(failed, state)


@query(
    """SELECT 'f' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, 'old' AS side, l_partkey + 1 AS start_line,
      (l_partkey + l_linenumber)::INT AS end_line FROM lineitem
    UNION ALL SELECT 'f' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey, 'new', greatest(1, l_suppkey), greatest(1, l_suppkey + 1) FROM lineitem"""
)
def hunk_scan_single(bed: Bed) -> DataFrame:
    name = F.concat_ws("-", keyed("f", "l_orderkey"), "l_linenumber", "l_partkey", "l_suppkey")
    text = F.format_string("--- a/x\n+++ b/x\n@@ -%d,%d +%d,0 @@ class X\n-a\n+b\n", F.col("l_partkey") + 1, F.col("l_linenumber"), F.col("l_suppkey"))
    return gitdiff.parse_hunks(bed.table("lineitem").select(name.alias("id"), text.alias("text")), "id")


@query(
    """SELECT event_id, CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'click' THEN 'Microsoft.Testing.Platform' ELSE 'VSTest' END AS runner,
      CASE WHEN event_type = 'view' THEN NULL ELSE event_type = 'click' END AS platform FROM events"""
)
def sdk_runners(bed: Bed) -> DataFrame:
    kind = F.col("event_type")
    text = (
        F.when(kind == "view", "{broken")
        .when(kind == "click", '{"sdk": {"version": "9.0.1"}, "test": {"runner": "Microsoft.Testing.Platform"}}')
        .otherwise('{"test": {"runner": "VSTest"}}')
    )
    runner = safety.sdk_runner(text)
    return bed.table("events").select("event_id", runner.alias("runner"), safety.is_testing_platform(runner).alias("platform"))


@query(
    """WITH d AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'NETSDK1045' WHEN 'click' THEN 'CS0518' ELSE 'X' END AS code,
        CASE WHEN event_type = 'view' AND value > 50 THEN 'The SDK does not support targeting .NET 10.0.' WHEN event_type = 'error'
          THEN 'current version Does Not Support Targeting net11.0' ELSE 'failed' END AS message,
        CASE WHEN value > 20 THEN 'net10.0' ELSE 'net8.0' END AS declared FROM events)
    SELECT * FROM (SELECT event_id, CASE WHEN code = 'NETSDK1045' OR contains(lower(message), 'does not support targeting') THEN 'the SDK 9.0.1 is too old for ' ||
        CASE WHEN contains(message, 'net11.0') THEN 'net11.0' WHEN contains(message, '.NET 10.0') THEN 'net10.0' ELSE 'the project''s framework' END
      WHEN code = 'CS0518' AND declared = 'net10.0' THEN 'no reference resolved: the SDK 9.0.1 is too old for net10.0' END AS described FROM d)
    WHERE described IS NOT NULL"""
)
def sdk_mismatches(bed: Bed) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    rows = bed.table("events").select(
        "event_id",
        F.when(kind == "view", "NETSDK1045").when(kind == "click", "CS0518").otherwise("X").alias("code"),
        F.when((kind == "view") & (value > 50), "The SDK does not support targeting .NET 10.0.")
        .when(kind == "error", "current version Does Not Support Targeting net11.0")
        .otherwise("failed")
        .alias("message"),
        F.array(F.lit("netstandard2.0"), F.when(value > 20, "net10.0").otherwise("net8.0")).alias("declared_frameworks"),
        F.lit("9.0.1").alias("registered"),
    )
    return safety.sdk_mismatch(rows).select("event_id", "described")


@query(
    """SELECT event_id, CASE WHEN event_type = 'click' THEN 'Reached' WHEN value < 10 THEN 'Absent' WHEN event_type = 'view' THEN 'Unfiltered'
      WHEN user_id < 50 THEN 'Widened' ELSE 'NotReached' END AS verdict FROM events"""
)
def explain_verdicts(bed: Bed) -> DataFrame:
    kind = F.col("event_type")
    verdict = report.explain_verdict(kind == "click", F.col("user_id") < 50, F.when(F.col("value") < 10, 0).otherwise(1), kind != "view")
    return bed.table("events").select("event_id", verdict.alias("verdict"))


@query(
    f"""WITH {_RUNS}, n AS (SELECT user_id, CASE WHEN ok THEN t - (a + f * t) END AS net FROM told)
    SELECT user_id, CASE WHEN net IS NULL THEN 'not enough runs' WHEN net >= 0 THEN 'selection saves time'
      ELSE 'selection costs more than it saves' END AS advice FROM n"""
)
def ledger_advice(bed: Bed) -> DataFrame:
    return ledger.verdict(bed.runs(), ["user_id"]).select("user_id", ledger.advice(F.col("net_seconds")).alias("advice"))


@query(
    """SELECT event_id AS ord, '| ' || left(sha256(event_id::VARCHAR), 9) || ' | a\\|' || event_type || ' | ' || event_id % 8 || '/8 | ' ||
      CASE event_id % 8 WHEN 0 THEN '0.0' WHEN 1 THEN '12.5' WHEN 2 THEN '25.0' WHEN 3 THEN '37.5' WHEN 4 THEN '50.0' WHEN 5 THEN '62.5' WHEN 6 THEN '75.0' ELSE '87.5' END
      || ' % | ' || CASE WHEN event_type = 'error' THEN 'full' ELSE 'selective' END || ' | ' || user_id || '.0 s |' AS line FROM events"""
)
def replay_lines(bed: Bed) -> DataFrame:
    rows = bed.table("events").select(
        F.col("event_id").alias("ord"),
        F.sha2(F.col("event_id").cast("string"), 256).alias("commit"),
        F.concat(F.lit("a|"), "event_type").alias("subject"),
        (F.col("event_id") % 8).alias("selected"),
        F.lit(8).alias("total"),
        (F.col("event_type") == "error").alias("full_run"),
        F.col("user_id").cast("double").alias("seconds"),
    )
    return harness.replay_table(rows)


@query(
    f"""WITH {NODES}, {EDGES}, {TESTS}, s AS (SELECT count(*) FILTER (kind = 'Type') AS types, count(*) FILTER (kind <> 'Type') AS members,
        (SELECT count(*) FROM edges) AS edges FROM nodes)
    SELECT 0 AS ord, '{{"types":' || types || ',"members":' || members || ',"edges":' || edges || '}}' AS json FROM s
    UNION ALL SELECT 1, '{{"fullyQualifiedName":"' || fqn || '","projectName":"' || project || '","framework":"NUnit","isParameterized":false}}' FROM tests"""
)
def graph_json(bed: Bed) -> DataFrame:
    tests = _named(bed).withColumns({"framework": F.lit("NUnit"), "is_parameterized": F.lit(False)})
    return report.graph_json(graph.graph_summary(bed.nodes(), bed.raw_edges()), tests)


@query(
    """SELECT event_id AS at, value AS analysisSeconds FROM events
    ORDER BY CASE WHEN value > 300 THEN 2 WHEN value > 50 THEN 1 ELSE 0 END DESC, event_id DESC LIMIT 100"""
)
def ledger_file(bed: Bed) -> DataFrame:
    """Written as a ledger, appended to twice, and read back; a ledger keeps its last hundred rows."""
    path = new_path(bed.spark, "ledger")
    runs = bed.table("events").select(
        F.col("event_id").alias("seq"),
        F.col("event_id").cast("string").alias("at"),
        F.lit("c").alias("headCommit"),
        F.lit(False).alias("fullRun"),
        F.col("value").alias("analysisSeconds"),
    )
    few, many = F.col("analysisSeconds") > 300, F.col("analysisSeconds") > 50
    results.write_ledger(runs.where(~many), path)
    results.append_ledger(runs.where(many & ~few), path)
    results.append_ledger(runs.where(few), path)
    return results.read_ledger(bed.spark, path).select(F.col("at").cast("long").alias("at"), "analysisSeconds")


@query(
    f"""WITH {NODES}, {EDGES} SELECT src, dst, kind, CASE WHEN src[1] = 'P' THEN 'P' ELSE 'rest' END AS project FROM edges
    WHERE src[1] <> 'S' UNION ALL SELECT src, dst, kind + 1, 'S' FROM edges WHERE src[1] = 'S'
    UNION ALL SELECT key, containing_type, 0, left(key, 1) FROM nodes WHERE key[1] IN ('P', 'S')"""
)
def fragment_file(bed: Bed) -> DataFrame:
    """Two tables of fragments written, one project of one of them rebuilt and some gone, and both read back."""
    head = F.left("src", F.lit(1))
    edges = written(graph.merge_edges(bed.raw_edges()), "edges")
    edges = edges.withColumn("project", F.when(head.isin("P", "S"), head).otherwise("rest"))
    nodes = bed.nodes().select("key", "containing_type", F.left("key", F.lit(1)).alias("project"))
    store = results.FragmentStore(bed.spark, new_path(bed.spark, "fragments"), "9.0", "a.sln")
    gone = edges.withColumn("project", F.lit("gone"))
    store.write({"edges": edges.unionByName(gone), "nodes": nodes}, 4, 4, 0)
    rebuilt = edges.where("project = 'S'").withColumn("kind", F.col("kind") + 1)
    current = bed.spark.createDataFrame([("P",), ("S",), ("rest",)], "project string")
    store.write({"edges": rebuilt}, 1, 3, 4, current)
    kept = store.read("nodes", "key string, containing_type string, project string")
    out = store.read("edges", "src string, dst string, kind int, project string")
    return out.unionByName(kept.select(F.col("key").alias("src"), F.col("containing_type").alias("dst"), F.lit(0).alias("kind"), "project"))


# Maintained state ----------------------------------------------------------------------------------------------------


@query(ORACLES["walk_hops"])
def maintained_walk(bed: Bed) -> DataFrame:
    """A walk built without suppliers' edges and with short cuts to all customers, then changed to the whole graph."""
    edges = written(maintain.edges_of(_graph(bed).steps), "edges")
    late = F.startswith("src", F.lit("S"))
    short_cuts = bed.table("customer").select(
        F.lit("R1").alias("src"), keyed("C", "c_custkey").alias("dst"), F.lit(False).alias("up"), F.lit(False).alias("down")
    )
    walk = maintain.MaintainedWalk(bed.spark, new_path(bed.spark, "walk"), False, buckets=16)
    walk.change(edges.where(~late).unionByName(short_cuts).unionByName(maintain.seed_edges(_keys(bed, "R1"))), edges.limit(0))
    walk.change(edges.where(late), short_cuts)
    return walk.rows()


# Declarations --------------------------------------------------------------------------------------------------------


def _above(bed: Bed) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    types, bases, members = bed.declared()
    types, members = written(types, "types"), written(members, "members")
    return types, declarations.ancestors(types, bases), members, types.select("type")


@query(f"WITH RECURSIVE {DECLARED} SELECT DISTINCT base AS src, type AS dst, 8 AS kind FROM above WHERE base IN (SELECT type FROM types)")
def derived_edges(bed: Bed) -> DataFrame:
    _, above, _, tracked = _above(bed)
    return declarations.derived_edges(above, tracked)


@query(
    f"""WITH RECURSIVE {DECLARED}, levels AS (
      SELECT type, type AS owner, NULL AS arg, 0 AS depth FROM types UNION ALL SELECT type, base, arg, depth FROM above WHERE NOT iface),
    wanted AS (
      SELECT DISTINCT a.type, m.member AS general, m.name, replace(m.param, '!0!', a.arg) AS param, t.iface
      FROM above a JOIN members m ON a.base = m.type JOIN types t ON a.type = t.type WHERE a.iface AND NOT m.acc),
    impl AS (
      SELECT w.type, w.general, w.param, m.member, row_number() OVER (
        PARTITION BY w.type, w.general, w.param ORDER BY l.depth, m.expl IS NULL, m.member) AS n
      FROM wanted w JOIN levels l ON w.type = l.type JOIN members m ON m.type = l.owner AND m.name = w.name AND m.param = w.param
      WHERE NOT m.acc AND (m.expl = w.general OR m.pub AND m.expl IS NULL AND NOT w.iface)),
    over AS (
      SELECT o.member AS specific, m.member, row_number() OVER (PARTITION BY o.member ORDER BY l.depth, m.expl IS NULL, m.member) AS n
      FROM members o JOIN levels l ON o.type = l.type AND l.depth > 0
      JOIN members m ON m.type = l.owner AND m.name = o.name AND m.param = o.param WHERE o.over AND m.may AND NOT o.acc AND NOT m.acc),
    pairs AS (
      SELECT general, member AS specific, 2 AS down, 256 AS up FROM impl WHERE n = 1 UNION SELECT member, specific, 4, 512 FROM over WHERE n = 1)
    SELECT general AS src, specific AS dst, down AS kind FROM pairs WHERE general <> specific
    UNION ALL SELECT specific, general, up FROM pairs WHERE general <> specific"""
)
def member_links(bed: Bed) -> DataFrame:
    return declarations.member_links(*_above(bed))


@query(
    f"""WITH RECURSIVE {DECLARED}, requests AS (
      SELECT DISTINCT a.type, regexp_replace(replace(m.param, '!0!', a.arg), '<.*', '') AS dst
      FROM above a JOIN types t ON a.type = t.type JOIN members m ON a.base = m.type
      WHERE a.iface AND NOT t.iface AND NOT t.abstract AND replace(m.param, '!0!', a.arg) = a.arg)
    SELECT type AS src, dst, 128 AS kind FROM requests WHERE type <> dst AND dst IN (SELECT type FROM types)
    UNION SELECT m.member, r.dst, 128 FROM requests r JOIN members m ON r.type = m.type WHERE r.type <> r.dst AND r.dst IN (SELECT type FROM types)"""
)
def request_edges(bed: Bed) -> DataFrame:
    return declarations.request_edges(*_above(bed))


@query(
    f"""WITH RECURSIVE {SYMBOLS}, w(symbol, here, n) AS (
      SELECT symbol, symbol, 0 FROM symbols
      UNION ALL SELECT w.symbol, s.target, n + 1 FROM w JOIN symbols s ON w.here = s.symbol WHERE n < 16 AND s.target IS NOT NULL AND NOT s.gone),
    ends AS (SELECT symbol, max_by(here, n) AS key FROM w GROUP BY symbol)
    SELECT e.symbol, CASE WHEN coalesce(s.gone, FALSE) THEN NULL ELSE e.key END AS key FROM ends e LEFT JOIN symbols s ON e.key = s.symbol"""
)
def symbol_redirects(bed: Bed) -> DataFrame:
    return declarations.normalised(bed.symbols())


@query(
    f"""WITH RECURSIVE {SYMBOLS}, w(symbol, target, priv) AS (
      SELECT symbol, target, priv FROM symbols
      UNION ALL SELECT w.symbol, s.target, s.priv FROM w JOIN symbols s ON w.target = s.symbol),
    hidden AS (SELECT symbol, bool_or(priv) AS hidden FROM w GROUP BY symbol)
    SELECT symbol, expl OR NOT hidden AS visible FROM symbols JOIN hidden USING (symbol)"""
)
def surface_visibility(bed: Bed) -> DataFrame:
    return declarations.visible(bed.symbols().withColumnRenamed("to", "container"))
