"""Graph queries over a twin of a code graph in the star schema.

Nations and brands are files, customers and suppliers are functions in their nation, parts in their brand. A customer calls the
parts they ordered, a part calls its suppliers; a nation imports its region. An edge of two orders or more is sure (high), its line is the least order key.
Every tenth customer is a test.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.session import dealt, table


def _customer():
    return F.concat(F.lit("nation_"), F.col("c_nationkey"), F.lit("::Customer#"), F.col("c_custkey"))


def _supplier():
    return F.concat(F.lit("nation_"), F.col("s_nationkey"), F.lit("::Supplier#"), F.col("s_suppkey"))


def _part():
    return F.concat(F.col("p_brand"), F.lit("::Part#"), F.col("p_partkey"))



def nodes(spark, d):
    null = F.lit(None).cast("string")
    nation = table(spark, d, "nation")
    out = [
        table(spark, d, "region").select(F.concat(F.lit("region_"), "r_regionkey").alias("id"), F.lit("folder").alias("type"), F.col("r_name").alias("name"), F.concat(F.lit("region_"), "r_regionkey").alias("path"), null.alias("parent")),
        nation.select(F.concat(F.lit("nation_"), "n_nationkey").alias("id"), F.lit("file").alias("type"), F.col("n_name").alias("name"), F.concat(F.lit("nation_"), "n_nationkey").alias("path"), F.concat(F.lit("region_"), "n_regionkey").alias("parent")),
        table(spark, d, "part").select(F.col("p_brand").alias("id")).distinct().select("id", F.lit("file").alias("type"), F.col("id").alias("name"), F.col("id").alias("path"), null.alias("parent")),
        table(spark, d, "customer").select(_customer().alias("id"), F.lit("function").alias("type"), F.col("c_name").alias("name"), F.concat(F.lit("nation_"), "c_nationkey").alias("path"), F.concat(F.lit("nation_"), "c_nationkey").alias("parent")),
        table(spark, d, "supplier").select(_supplier().alias("id"), F.lit("method").alias("type"), F.col("s_name").alias("name"), F.concat(F.lit("nation_"), "s_nationkey").alias("path"), F.concat(F.lit("nation_"), "s_nationkey").alias("parent")),
        table(spark, d, "part").select(_part().alias("id"), F.lit("class").alias("type"), F.col("p_name").alias("name"), F.col("p_brand").alias("path"), F.col("p_brand").alias("parent")),
    ]
    total = out[0]
    for x in out[1:]:
        total = total.unionByName(x)
    return total


def calls(spark, d):
    """Calls from the pairs of keys: counted first, so that the joins with names see one row a pair. Pairs hardly repeat, so they are dealt out before they are counted."""
    item = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    sure = F.when(F.col("n") >= 2, "high").otherwise("medium")
    one = dealt(item.select("l_orderkey", "l_partkey"), "l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    one = dealt(one.select("o_custkey", "l_partkey", "l_orderkey"), "o_custkey", "l_partkey").groupBy("o_custkey", "l_partkey").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("line"))
    one = one.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    one = one.select(_customer().alias("source"), _part().alias("target"), F.lit("calls").alias("type"), "line", sure.alias("confidence"))
    two = dealt(item, "l_partkey", "l_suppkey").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("line"))
    two = two.join(part, F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return one.unionByName(two.select(_part().alias("source"), _supplier().alias("target"), F.lit("calls").alias("type"), "line", sure.alias("confidence")))


def edges(spark, d):
    none = F.lit(None).cast("string")
    inside = nodes(spark, d).where("parent IS NOT NULL").select(F.col("parent").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("type"), F.lit(None).cast("long").alias("line"), none.alias("confidence"))
    imports = table(spark, d, "nation").select(F.concat(F.lit("nation_"), "n_nationkey").alias("source"), F.concat(F.lit("region_"), "n_regionkey").alias("target"), F.lit("imports").alias("type"), F.col("n_nationkey").cast("long").alias("line"), none.alias("confidence"))
    return calls(spark, d).unionByName(inside).unionByName(imports)


def events_graph(spark, d):
    """Users whose events follow each other: a cyclic graph."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id")
    day = F.to_date("ts")
    follows = e.select(F.col("user_id").cast("string").alias("source"), F.lead("user_id").over(Window.partitionBy(day).orderBy("ts", "event_id")).cast("string").alias("target"), F.col("event_id").alias("line")).where("target IS NOT NULL AND source <> target")
    return follows.groupBy("source", "target").agg(F.lit("calls").alias("type"), F.min("line").alias("line"), F.when(F.count("*") >= 2, "high").otherwise("medium").alias("confidence"))


def _tests(spark, d):
    return table(spark, d, "customer").where("c_custkey % 10 = 0").select(_customer().alias("id"))


def _changed(spark, d):
    """The suppliers of nation 3."""
    return table(spark, d, "supplier").where("s_nationkey = 3").select(_supplier().alias("id"))


ENTRY = "nation_7"
_PARTS = "SELECT p_partkey, p_brand || '::Part#' || p_partkey AS id FROM part"
CALLS = f"""
cu AS (SELECT c_custkey, 'nation_' || c_nationkey || '::Customer#' || c_custkey AS id FROM customer), su AS (SELECT s_suppkey, 'nation_' || s_nationkey || '::Supplier#' || s_suppkey AS id FROM supplier), pa AS ({_PARTS}),
ca AS (SELECT cu.id AS source, pa.id AS target, min(l_orderkey) AS line, CASE WHEN count(*) >= 2 THEN 'high' ELSE 'medium' END AS confidence FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN cu ON o_custkey = c_custkey JOIN pa ON l_partkey = p_partkey GROUP BY 1, 2
 UNION ALL SELECT pa.id, su.id, min(l_orderkey), CASE WHEN count(*) >= 2 THEN 'high' ELSE 'medium' END FROM lineitem JOIN pa ON l_partkey = p_partkey JOIN su ON l_suppkey = s_suppkey GROUP BY 1, 2)"""
NODES = """
nd AS (SELECT 'region_' || r_regionkey AS id, 'folder' AS type, r_name AS name, 'region_' || r_regionkey AS path, NULL AS parent FROM region
 UNION ALL SELECT 'nation_' || n_nationkey, 'file', n_name, 'nation_' || n_nationkey, 'region_' || n_regionkey FROM nation UNION ALL SELECT DISTINCT p_brand, 'file', p_brand, p_brand, NULL FROM part
 UNION ALL SELECT 'nation_' || c_nationkey || '::Customer#' || c_custkey, 'function', c_name, 'nation_' || c_nationkey, 'nation_' || c_nationkey FROM customer
 UNION ALL SELECT 'nation_' || s_nationkey || '::Supplier#' || s_suppkey, 'method', s_name, 'nation_' || s_nationkey, 'nation_' || s_nationkey FROM supplier
 UNION ALL SELECT p_brand || '::Part#' || p_partkey, 'class', p_name, p_brand, p_brand FROM part)"""
EDGES = f"""{CALLS}, {NODES},
ed AS (SELECT source, target, 'calls' AS type, line, confidence FROM ca UNION ALL SELECT parent, id, 'contains', NULL, NULL FROM nd WHERE parent IS NOT NULL
 UNION ALL SELECT 'nation_' || n_nationkey, 'region_' || n_regionkey, 'imports', n_nationkey, NULL FROM nation)"""
LINKS = f"""{EDGES},
fl AS (SELECT split_part(source, '::', 1) AS source, split_part(target, '::', 1) AS target, max(CASE WHEN type = 'imports' THEN 1 ELSE 0 END) AS imports, count(*) FILTER (type = 'calls') AS calls
 FROM ed WHERE type IN ('calls', 'imports') AND split_part(source, '::', 1) <> split_part(target, '::', 1) GROUP BY 1, 2),
cn AS (SELECT path, sum(o) AS outgoing, sum(i) AS incoming, sum(o) + sum(i) AS connections FROM (SELECT source AS path, calls + imports AS o, 0 AS i FROM fl UNION ALL SELECT target, 0, calls + imports FROM fl) GROUP BY path)"""
FLOW = """
fo AS (SELECT source, target, min(event_id) AS line, CASE WHEN count(*) >= 2 THEN 'high' ELSE 'medium' END AS confidence FROM (SELECT CAST(user_id AS VARCHAR) AS source, CAST(lead(user_id) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS VARCHAR) AS target, event_id FROM events)
 WHERE target IS NOT NULL AND source <> target GROUP BY 1, 2)"""
_BACK = """
r AS (SELECT id, 0 AS depth, false AS guessed FROM ch UNION SELECT e.source, r.depth + 1, r.guessed OR e.confidence <> 'high' FROM r JOIN {e} e ON e.target = r.id WHERE r.depth < 3 AND e.source NOT IN (SELECT id FROM ts)),
b AS (SELECT id, min(depth) AS depth FROM r GROUP BY id)
SELECT id, b.depth, bool_and(guessed) AS guessed FROM b JOIN r USING (id, depth) WHERE b.depth > 0 GROUP BY ALL"""


def _ripple(spark, d):
    return G.ripple(calls(spark, d), _changed(spark, d), 3, _tests(spark, d))


def _ripple_cyclic(spark, d):
    e = events_graph(spark, d)
    return G.ripple(e, e.groupBy().agg(F.min("target").alias("id")), 3)


def _tests_for(spark, d):
    return G.tests_reaching(calls(spark, d), _changed(spark, d), _tests(spark, d))


def _risk(spark, d):
    c, changed, tests = calls(spark, d), _changed(spark, d), _tests(spark, d)
    affected, tested = G.ripple_and_tested(c, changed, tests)
    return G.risk(changed.withColumn("signature_changed", F.col("id").endswith("7")), affected, tested)


def _sessions(spark, d):
    """Events inside the spans of their users' days, innermost span: hours of a day that hold a purchase, and the day itself."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 60).alias("line"), "event_type")
    day = e.groupBy("path", F.floor(F.col("line") / 1440).alias("k")).agg(F.min("line").alias("first"), F.max("line").alias("last")).select("path", F.concat(F.lit("day"), "k").alias("id"), "first", "last")
    hour = e.where("event_type = 'purchase'").groupBy("path", F.floor(F.col("line") / 60).alias("k")).agg(F.lit(1)).select("path", F.concat(F.lit("hour"), "k").alias("id"), (F.col("k") * 60).alias("first"), (F.col("k") * 60 + 59).alias("last"))
    return G.innermost(e.select("path", "line").distinct(), day.unionByName(hour))


def _top_connected(spark, d):
    e = edges(spark, d)
    return G.calls_by_node(e).select("id", (F.col("calls_in") + F.col("calls_out")).alias("degree")).orderBy(F.desc("degree"), "id").limit(5)


def _entry(spark, d):
    """The file that most likely starts the program: uses of others less uses by others, both capped, and the shortest path."""
    c = G.connections(G.file_links(edges(spark, d)))
    score = F.least(F.col("outgoing"), F.lit(6)) * 0.5 - F.least(F.col("incoming"), F.lit(6)) * 0.4 - (F.length("path") - F.length(F.replace("path", F.lit("#"), F.lit("")))) * 0.3
    return c.select("path", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "path").limit(1)


QUERIES = {
    "graph_nodes": nodes,
    "graph_edges_merged": lambda s, d: G.merge_edges(edges(s, d)),
    "graph_stats": lambda s, d: G.stats(nodes(s, d), edges(s, d)),
    "degree": lambda s, d: G.degrees(edges(s, d)),
    "calls_by_node": lambda s, d: G.calls_by_node(edges(s, d)),
    "top_connected": _top_connected,
    "most_called": lambda s, d: G.calls_by_node(edges(s, d)).select("id", "calls_in").orderBy(F.desc("calls_in"), "id").limit(2),
    "file_links": lambda s, d: G.file_links(edges(s, d)),
    "connections": lambda s, d: G.connections(G.file_links(edges(s, d))),
    "callers": lambda s, d: G.callers(edges(s, d), _changed(s, d)),
    "callees": lambda s, d: G.callees(edges(s, d), _tests(s, d)),
    "ripple_bfs": _ripple,
    "ripple_cyclic": _ripple_cyclic,
    "tests_reaching": _tests_for,
    "depends_closure": lambda s, d: G.closure(calls(s, d), table(s, d, "customer").where("c_custkey = 7").select(_customer().alias("id"))),
    "impact_closure": lambda s, d: G.closure(calls(s, d), table(s, d, "supplier").where("s_suppkey = 7").select(_supplier().alias("id")), forward=False),
    "reading_order": lambda s, d: G.reading_order(G.file_links(edges(s, d)), ENTRY, G.connections(G.file_links(edges(s, d))).select("path", "connections")),
    "layering": lambda s, d: G.layering(G.file_links(edges(s, d)), ENTRY, 4),
    "ancestors_climb": lambda s, d: G.ancestors(nodes(s, d)),
    "enclosing_interval": _sessions,
    "entry_pick": _entry,
    "busiest": lambda s, d: nodes(s, d).where("type IN ('function', 'method', 'class')").groupBy("path").agg(F.count("*").alias("functions")).orderBy(F.desc("functions"), "path").limit(1),
    "risk_rules": _risk,
}
_CHANGED = "ch AS (SELECT id FROM su JOIN supplier USING (s_suppkey) WHERE s_nationkey = 3), ts AS (SELECT id FROM cu WHERE c_custkey % 10 = 0)"
_REACH = """
tr AS (SELECT id AS origin, id, 0 AS depth FROM {o} UNION SELECT origin, source, depth + 1 FROM tr JOIN ca ON target = id WHERE depth < 6 AND id NOT IN (SELECT id FROM ts))"""
ORACLES = {
    "graph_nodes": f"WITH {NODES} SELECT * FROM nd",
    "graph_edges_merged": f"WITH {EDGES} SELECT * FROM ed",
    "graph_stats": f"WITH {EDGES} SELECT 'nodes' AS kind, type AS name, count(*) AS n FROM nd GROUP BY type UNION ALL SELECT 'edges', type, count(*) FROM ed GROUP BY type",
    "degree": f"""WITH {EDGES}, x AS (SELECT *, split_part(source, '::', 1) AS fs, split_part(target, '::', 1) AS ft FROM ed WHERE type IN ('calls', 'imports'))
SELECT id, count(*) AS degree FROM (SELECT source AS id FROM x UNION ALL SELECT target FROM x UNION ALL SELECT fs FROM x WHERE type = 'calls' AND fs <> ft UNION ALL SELECT ft FROM x WHERE type = 'calls' AND fs <> ft) GROUP BY id""",
    "calls_by_node": f"WITH {CALLS} SELECT id, CAST(sum(i) AS BIGINT) AS calls_in, CAST(sum(o) AS BIGINT) AS calls_out FROM (SELECT source AS id, 0 AS i, 1 AS o FROM ca UNION ALL SELECT target, 1, 0 FROM ca) GROUP BY id",
    "top_connected": f"WITH {CALLS} SELECT id, count(*) AS degree FROM (SELECT source AS id FROM ca UNION ALL SELECT target FROM ca) GROUP BY id ORDER BY degree DESC, id LIMIT 5",
    "most_called": f"WITH {CALLS} SELECT target AS id, count(*) AS calls_in FROM ca GROUP BY target ORDER BY calls_in DESC, id LIMIT 2",
    "file_links": f"WITH {LINKS} SELECT source, target, CAST(imports AS BIGINT) AS imports, calls FROM fl",
    "connections": f"WITH {LINKS} SELECT path, CAST(outgoing AS BIGINT) AS outgoing, CAST(incoming AS BIGINT) AS incoming, CAST(connections AS BIGINT) AS connections FROM cn",
    "callers": f"WITH {CALLS} SELECT DISTINCT source AS id FROM ca WHERE target LIKE 'nation_3::Supplier#%'",
    "callees": f"WITH {CALLS} SELECT DISTINCT target AS id FROM ca JOIN cu ON source = cu.id WHERE c_custkey % 10 = 0",
    "ripple_bfs": f"WITH RECURSIVE {CALLS}, {_CHANGED}, {_BACK.format(e='ca')}",
    "ripple_cyclic": f"WITH RECURSIVE {FLOW}, ch AS (SELECT min(target) AS id FROM fo), ts AS (SELECT 'none' AS id), {_BACK.format(e='fo')}",
    "tests_reaching": f"WITH RECURSIVE {CALLS}, {_CHANGED}, {_REACH.format(o='ch')}, p AS (SELECT DISTINCT origin, id FROM tr WHERE depth > 0 AND id IN (SELECT id FROM ts)), q AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY id) AS n FROM p) SELECT origin, id AS test FROM q WHERE n <= 6",
    "depends_closure": f"WITH RECURSIVE {CALLS}, r AS (SELECT id, 0 AS depth FROM cu WHERE c_custkey = 7 UNION SELECT target, depth + 1 FROM r JOIN ca ON source = id) SELECT id, min(depth) AS depth FROM r WHERE depth > 0 GROUP BY id",
    "impact_closure": f"WITH RECURSIVE {CALLS}, r AS (SELECT id, 0 AS depth FROM su WHERE s_suppkey = 7 UNION SELECT source, depth + 1 FROM r JOIN ca ON target = id) SELECT id, min(depth) AS depth FROM r WHERE depth > 0 GROUP BY id",
    "reading_order": f"""WITH RECURSIVE {LINKS}, w AS (SELECT '{ENTRY}' AS path, ['{ENTRY}'] AS walk, 0 AS depth UNION ALL SELECT fl.target, list_append(walk, fl.target), depth + 1 FROM w JOIN fl ON fl.source = w.path WHERE depth < 3 AND NOT list_contains(walk, fl.target)),
m AS (SELECT path, min(depth) AS depth FROM w GROUP BY path), k AS (SELECT path, m.depth, min(walk) AS walk FROM m JOIN w USING (path, depth) GROUP BY path, m.depth),
o AS (SELECT path, depth, walk, CAST(NULL AS HUGEINT) AS connections FROM k UNION ALL SELECT path, NULL, NULL, connections FROM cn WHERE path NOT IN (SELECT path FROM k)),
n AS (SELECT row_number() OVER (ORDER BY depth NULLS LAST, walk NULLS LAST, connections DESC, path) AS place, path FROM o) SELECT * FROM n WHERE place <= 8""",
    "layering": f"WITH RECURSIVE {LINKS}, w AS (SELECT '{ENTRY}' AS path, 0 AS level UNION SELECT fl.target, level + 1 FROM w JOIN fl ON fl.source = w.path WHERE level < 4) SELECT path, max(level) AS level FROM w GROUP BY path",
    "ancestors_climb": f"WITH RECURSIVE {NODES}, r AS (SELECT id, parent AS ancestor, 1 AS distance FROM nd WHERE parent IS NOT NULL UNION ALL SELECT r.id, nd.parent, distance + 1 FROM r JOIN nd ON nd.id = r.ancestor WHERE nd.parent IS NOT NULL) SELECT * FROM r",
    "enclosing_interval": """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS path, CAST(floor(epoch(ts) / 60) AS BIGINT) AS line, event_type FROM events),
s AS (SELECT path, 'day' || CAST(floor(line / 1440) AS BIGINT) AS id, min(line) AS first, max(line) AS last FROM e GROUP BY 1, 2 UNION ALL
 SELECT DISTINCT path, 'hour' || CAST(floor(line / 60) AS BIGINT), CAST(floor(line / 60) AS BIGINT) * 60, CAST(floor(line / 60) AS BIGINT) * 60 + 59 FROM e WHERE event_type = 'purchase')
SELECT path, line, arg_max(id, lpad(CAST(first AS VARCHAR), 12, '0') || id) AS id FROM (SELECT DISTINCT path, line FROM e) p JOIN s USING (path) WHERE line BETWEEN first AND last GROUP BY path, line""",
    "entry_pick": f"WITH {LINKS} SELECT path, round(CAST(least(outgoing, 6) AS DOUBLE) * 0.5 - CAST(least(incoming, 6) AS DOUBLE) * 0.4 - CAST(length(path) - length(replace(path, '#', '')) AS DOUBLE) * 0.3, 6) AS score FROM cn ORDER BY score DESC, path LIMIT 1",
    "busiest": f"WITH {NODES} SELECT path, count(*) AS functions FROM nd WHERE type IN ('function', 'method', 'class') GROUP BY path ORDER BY functions DESC, path LIMIT 1",
    "risk_rules": f"""WITH RECURSIVE {CALLS}, {_CHANGED}, {_BACK.format(e='ca').replace('SELECT id, b.depth', ', af AS (SELECT id, b.depth')}), al AS (SELECT id FROM ch UNION ALL SELECT id FROM af), {_REACH.format(o='al')},
te AS (SELECT DISTINCT origin AS id FROM tr WHERE depth > 0 AND id IN (SELECT id FROM ts)),
c AS (SELECT count(*) AS changed, count(*) FILTER (id NOT IN (SELECT id FROM te)) AS untested, bool_or(id LIKE '%7') AS signature FROM ch),
a AS (SELECT count(*) AS affected, count(*) FILTER (depth = 1) AS direct, count(*) FILTER (depth = 1 AND id NOT IN (SELECT id FROM te)) AS untested_direct, coalesce(bool_or(guessed), false) AS guessed FROM af),
x AS (SELECT * FROM c, a)
SELECT CASE WHEN untested_direct > 0 OR untested > 0 THEN 'High' ELSE 'Medium' END AS level, 'a signature changed' AS reason FROM x WHERE signature AND direct > 0
UNION ALL SELECT 'High', 'wide ripple' FROM x WHERE affected >= 15 UNION ALL SELECT 'Medium', 'changed code without tests is used' FROM x WHERE untested > 0 AND direct > 0
UNION ALL SELECT 'Medium', 'affected code without tests' FROM x WHERE NOT (untested > 0 AND direct > 0) AND untested_direct > 0 UNION ALL SELECT 'Note', 'guessed links' FROM x WHERE guessed
UNION ALL SELECT 'Low', 'nothing else is at risk' FROM x WHERE NOT ((signature AND direct > 0) OR affected >= 15 OR (untested > 0 AND direct > 0) OR untested_direct > 0)""",
}
