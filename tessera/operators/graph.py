"""The property graph as two tables, and what is counted and walked over it.

nodes(id, type, name, path, parent) and edges(source, target, type, line, confidence). Walks are loops over a frontier table: each
step is one join and one aggregation, nodes seen are taken out by an anti join, and the lineage is cut at each step. The edges a walk follows are written
once before it, so that no step makes them again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut, dealt, drop


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (source, target, type): the least line, the best confidence."""
    best = F.when(F.max((F.col("confidence") == "high").cast("int")) == 1, "high").when(F.count("confidence") > 0, "medium")
    return dealt(edges, "source", "target", "type").groupBy("source", "target", "type").agg(F.min("line").alias("line"), best.alias("confidence"))


def file_of(node: Column) -> Column:
    return F.substring_index(node, "::", 1)


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): nodes and edges by type."""
    a = nodes.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("nodes").alias("kind"), "name", "n")
    b = edges.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("edges").alias("kind"), "name", "n")
    return a.unionByName(b)


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): ends of calls and imports; a call between files counts for both files too. One pass, no join."""
    fs, ft = file_of(F.col("source")), file_of(F.col("target"))
    between = (F.col("type") == "calls") & (fs != ft)
    ends = F.array(F.col("source"), F.col("target"))
    every = F.when(between, F.concat(ends, F.array(fs, ft))).otherwise(ends)
    return edges.where(F.col("type").isin("calls", "imports")).select(F.explode(every).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def calls_by_node(edges: DataFrame) -> DataFrame:
    """(id, calls_in, calls_out)."""
    ends = F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o"))))
    e = edges.where("type = 'calls'").select(ends.alias("e"))
    return e.groupBy(F.col("e.id").alias("id")).agg(F.sum("e.i").alias("calls_in"), F.sum("e.o").alias("calls_out"))


def file_links(edges: DataFrame) -> DataFrame:
    """(source, target, imports 0/1, calls) between different files."""
    e = edges.where(F.col("type").isin("calls", "imports")).select(file_of(F.col("source")).alias("source"), file_of(F.col("target")).alias("target"), "type").where("source <> target")
    return e.groupBy("source", "target").agg(F.max((F.col("type") == "imports").cast("long")).alias("imports"), F.sum((F.col("type") == "calls").cast("long")).alias("calls"))


def connections(links: DataFrame) -> DataFrame:
    """(path, outgoing, incoming, connections) from file_links()."""
    w = F.col("calls") + F.col("imports")
    ends = F.explode(F.array(F.struct(F.col("source").alias("path"), w.alias("o"), F.lit(0).cast("long").alias("i")), F.struct(F.col("target").alias("path"), F.lit(0).cast("long").alias("o"), w.alias("i"))))
    got = links.select(ends.alias("e")).groupBy(F.col("e.path").alias("path")).agg(F.sum("e.o").alias("outgoing"), F.sum("e.i").alias("incoming"))
    return got.withColumn("connections", F.col("outgoing") + F.col("incoming"))


def callers(edges: DataFrame, of: DataFrame) -> DataFrame:
    """(id): what calls one of the nodes (id)."""
    return edges.where("type = 'calls'").join(of.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("source").alias("id")).distinct()


def callees(edges: DataFrame, of: DataFrame) -> DataFrame:
    """(id): what one of the nodes (id) calls."""
    return edges.where("type = 'calls'").join(of.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id")).distinct()


def _written(edges: DataFrame) -> DataFrame:
    """Calls (source, target, guess), written once for walks in either direction."""
    return cut(edges.where("type = 'calls'").select("source", "target", (F.col("confidence") != "high").alias("guess")))


def ripple(edges: DataFrame, changed: DataFrame, depth: int = 3, skip: DataFrame | None = None) -> DataFrame:
    """Callers of callers of `changed` (id), at most `depth` steps back: (id, depth, guessed). The least depth wins, then a way without a
    guessed link. `skip` (id) are never entered."""
    links = _written(edges)
    out = _ripple(links, changed, depth, skip)
    drop(links)
    return out


def _ripple(links: DataFrame, changed: DataFrame, depth: int, skip: DataFrame | None) -> DataFrame:
    seen = front = cut(changed.select("id", F.lit(0).alias("depth"), F.lit(False).alias("guessed")))
    for k in range(1, depth + 1):
        step = links.join(front.select(F.col("id").alias("target"), "guessed"), "target").groupBy(F.col("source").alias("id")).agg(F.min(F.col("guessed") | F.col("guess")).alias("guessed"))
        if skip is not None:
            step = step.join(skip.select("id"), "id", "left_anti")
        front = cut(step.select("id", F.lit(k).alias("depth"), "guessed").join(seen.select("id"), "id", "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.where("depth > 0")


def _reached(links: DataFrame, tests: DataFrame, depth: int) -> DataFrame:
    """(id, far): by how few calls, up to `depth`, a test (id) comes to each node on a way through no other test; tests themselves have a row of 0 as well. One row a
    node, however many tests there are."""
    seen = front = tests.select("id", F.lit(0).alias("far"))
    for k in range(1, depth + 1):
        step = links.join(front.select(F.col("id").alias("source")), "source").select(F.col("target").alias("id")).distinct()
        step = cut(step.join(seen.where("far > 0").select("id"), "id", "left_anti").withColumn("far", F.lit(k)))
        if step.isEmpty():
            break
        seen = seen.unionByName(step)
        front = step.join(tests, "id", "left_anti")
    return seen


def tests_reaching(edges: DataFrame, origins: DataFrame, tests: DataFrame, depth: int = 6, most: int = 6) -> DataFrame:
    """(origin, test): the first tests, by id, that reach each origin in at most `depth` calls; the walk stops at tests.

    The walk back from each origin enters only nodes that a test comes to in the calls that are left, which one walk forward from all tests finds.
    """
    links, tests = _written(edges), cut(tests.select("id").distinct())
    far = _reached(links, tests, depth).groupBy("id").agg(F.min("far").alias("far"))
    calls = cut(links.join(far.withColumnRenamed("id", "source"), "source").select(F.col("source").alias("next"), F.col("target").alias("id"), "far"))
    drop(links)
    seen = front = cut(origins.select(F.col("id").alias("origin"), "id"))
    found = None
    for k in range(1, depth + 1):
        step = front.join(calls.where(F.col("far") <= depth - k), "id").select("origin", F.col("next").alias("id"), (F.col("far") == 0).alias("test")).distinct()
        step = cut(step.join(seen, ["origin", "id"], "left_anti"))
        if step.isEmpty():
            break
        hit = step.where("test").select("origin", "id")
        found = hit if found is None else found.unionByName(hit)
        front = step.where("NOT test").select("origin", "id")
        seen = seen.unionByName(step.select("origin", "id"))
    drop(calls)
    found = found if found is not None else seen.limit(0)
    place = F.row_number().over(Window.partitionBy("origin").orderBy("id"))
    return found.withColumn("place", place).where(F.col("place") <= most).select("origin", F.col("id").alias("test"))


def ripple_and_tested(edges: DataFrame, changed: DataFrame, tests: DataFrame, depth: int = 3, test_depth: int = 6) -> tuple[DataFrame, DataFrame]:
    """ripple() of `changed` (id) that skips tests, and (id): which nodes a test reaches in at most `test_depth` calls. Whether a node is tested takes one walk from all
    tests, not one from each node; both walks read the same calls."""
    links, tests = _written(edges), cut(tests.select("id").distinct())
    affected, reached = _ripple(links, changed, depth, tests), _reached(links, tests, test_depth)
    drop(links)
    return affected, reached.where("far > 0").select("id")


def closure(edges: DataFrame, start: DataFrame, forward: bool = True) -> DataFrame:
    """(id, depth): all that `start` (id) reaches along calls and imports, or with forward=False all that reaches it."""
    s, t = ("source", "target") if forward else ("target", "source")
    links = cut(edges.where(F.col("type").isin("calls", "imports")).select(F.col(s).alias("id"), F.col(t).alias("next")))
    seen = front = cut(start.select("id", F.lit(0).alias("depth")))
    k = 0
    while True:
        k += 1
        front = cut(links.join(front.select("id"), "id").select(F.col("next").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(k)))
        if front.isEmpty():
            drop(links, front)
            return seen.where("depth > 0")
        seen = seen.unionByName(front)


def reading_order(links: DataFrame, entry: str, sizes: DataFrame, most: int = 8) -> DataFrame:
    """(place, path): breadth first from `entry` over sorted links, then other files (path, connections) by connections.

    A file's place within a depth is by its parent's place, then its path; both are kept as the list of paths walked.
    """
    seen = front = links.sparkSession.createDataFrame([(entry, [entry], 0)], "path string, walk array<string>, depth int")
    ends = cut(links.select(F.col("source").alias("path"), F.col("target").alias("next")).distinct())
    k = 0
    while True:
        k += 1
        step = ends.join(front.select("path", "walk"), "path").select(F.col("next").alias("path"), F.concat("walk", F.array("next")).alias("walk"))
        front = cut(step.groupBy("path").agg(F.min("walk").alias("walk")).withColumn("depth", F.lit(k)).join(seen.select("path"), "path", "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    rest = sizes.join(seen.select("path"), "path", "left_anti").select("path", F.lit(None).cast("array<string>").alias("walk"), F.lit(None).cast("int").alias("depth"), "connections")
    every = seen.withColumn("connections", F.lit(None).cast("long")).unionByName(rest)
    best = every.orderBy(F.col("depth").asc_nulls_last(), F.col("walk").asc_nulls_last(), F.desc("connections"), "path").limit(most)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.col("depth").asc_nulls_last(), F.col("walk").asc_nulls_last(), F.desc("connections"), "path"))).select(F.col("place").cast("long").alias("place"), "path")


def layering(links: DataFrame, entry: str, rounds: int = 6) -> DataFrame:
    """(path, level): the longest walk from `entry`, of at most `rounds` steps, so that cycles end."""
    front = links.sparkSession.createDataFrame([(entry,)], "path string")
    levels = front.withColumn("level", F.lit(0))
    ends = cut(links.select(F.col("source").alias("path"), F.col("target").alias("next")).distinct())
    for k in range(1, rounds + 1):
        front = cut(ends.join(front, "path").select(F.col("next").alias("path")).distinct())
        levels = levels.unionByName(front.withColumn("level", F.lit(k)))
    return levels.groupBy("path").agg(F.max("level").alias("level"))


def ancestors(nodes: DataFrame) -> DataFrame:
    """(id, ancestor, distance) along parent, to the top. Parents are no cycle: a node comes after what it's in."""
    up = cut(nodes.where("parent IS NOT NULL").select("id", F.col("parent").alias("ancestor")))
    out = step = up.withColumn("distance", F.lit(1))
    k = 1
    while True:
        k += 1
        step = cut(step.select("id", F.col("ancestor").alias("mid")).join(up.select(F.col("id").alias("mid"), "ancestor"), "mid").select("id", "ancestor", F.lit(k).alias("distance")))
        if step.isEmpty():
            break
        out = out.unionByName(step)
    return out


def innermost(points: DataFrame, spans: DataFrame, width: int = 64) -> DataFrame:
    """points (path, line) -> (path, line, id): of the spans (path, id, first, last) that hold the line, the one that begins last.

    An interval join by buckets of `width` lines: a span is put into each bucket it touches, so the join is on equal keys.
    """
    b = F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width))).alias("bucket")
    held = spans.select("path", "id", "first", "last", b)
    p = points.withColumn("bucket", F.floor(F.col("line") / width))
    hit = p.join(held, ["path", "bucket"]).where("line BETWEEN first AND last")
    return hit.groupBy("path", "line").agg(F.max_by("id", F.struct("first", "id")).alias("id"))


#: How bad a reason is.
RISK = {"High": 3, "Medium": 2, "Low": 1, "Note": 0}


def risk(changed: DataFrame, affected: DataFrame, tested: DataFrame) -> DataFrame:
    """(level, reason) rules over changed (id, signature_changed), affected (id, depth, guessed) and tested (id): one row a rule that holds."""
    c = changed.join(tested.select("id", F.lit(True).alias("t")), "id", "left").agg(
        F.count("*").alias("changed"), F.count_if(F.col("t").isNull()).alias("untested"), F.coalesce(F.max(F.col("signature_changed")), F.lit(False)).alias("signature")
    )
    a = affected.join(tested.select("id", F.lit(True).alias("t")), "id", "left").agg(
        F.count("*").alias("affected"), F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.expr("depth = 1 AND t IS NULL")).alias("untested_direct"), F.coalesce(F.max("guessed"), F.lit(False)).alias("guessed")
    )
    x = c.crossJoin(a)  # one row each
    medium = (F.col("untested") > 0) & (F.col("direct") > 0)
    rules = [
        (F.col("signature") & (F.col("direct") > 0), F.when((F.col("untested_direct") > 0) | (F.col("untested") > 0), "High").otherwise("Medium"), "a signature changed"),
        (F.col("affected") >= 15, F.lit("High"), "wide ripple"),
        (medium, F.lit("Medium"), "changed code without tests is used"),
        (~medium & (F.col("untested_direct") > 0), F.lit("Medium"), "affected code without tests"),
        (F.col("guessed"), F.lit("Note"), "guessed links"),
    ]
    worse = (F.col("signature") & (F.col("direct") > 0)) | (F.col("affected") >= 15) | medium | (F.col("untested_direct") > 0)
    rules.append((~worse, F.lit("Low"), "nothing else is at risk"))
    held = F.filter(F.array(*(F.when(w, F.struct(level.alias("level"), F.lit(r).alias("reason"))) for w, level, r in rules)), lambda r: r.isNotNull())
    return x.select(F.explode(held).alias("r")).select("r.level", "r.reason")
