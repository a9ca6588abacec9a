"""Change impact and small functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import answers as A
from tessera.functions.flow import flowcharts
from tessera.operators import graph as G
from tessera.operators import impact as I  # noqa: E741
from tessera.operators.report import GLOSSARY, glossary_terms
from tessera.plans import graphs
from tessera.session import spread, table


def _spans(spark, d):
    """Orders are definitions of 40 lines in their customer's file, one after the other; every third holds another that is 10 lines long."""
    o = table(spark, d, "orders").select(F.concat(F.lit("f"), F.col("o_custkey")).alias("path"), "o_orderkey", (F.col("o_orderkey") % 500 * 40 + 1).cast("int").alias("first"))
    outer = o.select("path", F.concat("path", F.lit("::o"), "o_orderkey").alias("id"), "first", (F.col("first") + 39).alias("last"))
    inner = o.where("o_orderkey % 3 = 0").select("path", F.concat("path", F.lit("::o"), "o_orderkey", F.lit(".x")).alias("id"), (F.col("first") + 10).alias("first"), (F.col("first") + 19).alias("last"))
    return outer.unionByName(inner)


def _lines(spark, d):
    """Lines of a change: one for each line item, at a line of its order's file; every fourth is a place where lines were taken out."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("f"), F.col("o_custkey")).alias("path"))
    item = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey").join(o, "l_orderkey")
    return item.select("path", ((F.col("l_orderkey") % 500) * 40 + F.col("l_partkey") % 57 + 1).cast("int").alias("line"), (F.col("l_partkey") % 4 != 0).alias("added"))


def changed_definitions(spark, d):
    old = table(spark, d, "orders").where("o_orderkey % 5 <> 0").select(F.concat(F.lit("f"), F.col("o_custkey")).alias("path"), F.concat(F.lit("o"), F.col("o_orderkey")).alias("qual"))
    return I.changed_definitions(_lines(spark, d), _spans(spark, d), old)


def file_level(spark, d):
    at = _lines(spark, d)
    return I.file_level(at, _spans(spark, d), at.where("line % 7 < 5").select("path", "line").distinct())


def file_importers(spark, d):
    e = graphs.edges(spark, d)
    changed = table(spark, d, "region").where("r_regionkey IN (1, 3)").select(F.concat(F.lit("region_"), "r_regionkey").alias("path"))
    tests = table(spark, d, "nation").where("n_nationkey % 4 = 0").select(F.concat(F.lit("nation_"), "n_nationkey").alias("path"))
    return I.importers(e, changed, tests)


def still_called(spark, d):
    gone = table(spark, d, "part").where("p_size = 50").select(F.col("p_partkey").alias("name"), F.concat("p_brand", F.lit("."), "p_partkey").alias("qual"))
    calls = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("path"), F.col("l_orderkey").alias("line"), F.col("l_linenumber").alias("caller"), F.col("l_partkey").alias("name"))
    return I.still_called(gone, calls)


def uses_sets(spark, d):
    found = I.uses(G.file_links(graphs.edges(spark, d)))
    return found.select("path", I.names_list("uses").alias("uses"), F.size("used_by").cast("long").alias("n_used_by"))


def retrieved_subgraph(spark, d):
    e = graphs.edges(spark, d).where("type = 'calls'")
    top = G.calls_by_node(e).orderBy(F.desc(F.col("calls_in") + F.col("calls_out")), "id").limit(200)
    return I.subgraph(e, top).select("source", "target", "confidence")


def change_totals(spark, d):
    at = _lines(spark, d)
    return I.totals(at.groupBy("path").agg(F.count_if("added").alias("added"), F.count_if(~F.col("added")).alias("removed")))


_SNIPPETS = ("#include <x.h>", "int main(void) {", "public static void f()", "def f(a):", "interface Shape {", "const a = b", "x: number", "plain", "int main( public", "from a import b")


def code_language(spark, d):
    snippet = F.element_at(F.array(*map(F.lit, _SNIPPETS)), (F.col("doc_id") % len(_SNIPPETS) + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", A.code_language(F.concat(F.substring("text", 1, 60), F.lit("\n"), snippet)).alias("language"))


def tag_names(spark, d):
    return table(spark, d, "part").select("p_partkey", A.tag(F.concat_ws(" / ", "p_name", "p_brand", "p_type")).alias("tag"), A.with_article(F.col("p_name")).alias("one"), A.counted(F.col("p_size") % 3, F.col("p_brand")).alias("some"))


def lists_in_words(spark, d):
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    return n.select("n_regionkey", A.in_a_row(F.slice(F.col("names"), F.lit(1), (F.col("n_regionkey") + 1).cast("int"))).alias("said"))


_ASKED = ("What is a loop used for?", "what does the loop in main() do", "Explain classes", "the whole program", "does it return", "why use an import here")


def questions(spark, d):
    asked = F.element_at(F.array(*map(F.lit, _ASKED)), ((F.col("conv_id") + F.col("turn")) % len(_ASKED) + 1).cast("int"))
    q = table(spark, d, "conversations").select("conv_id", "turn", asked.alias("q"))
    return q.select("conv_id", "turn", A.concept_question(F.col("q"), glossary_terms(F.col("q"))).alias("concept"), A.general_question(F.col("q")).alias("general"), A.pointing_question(F.col("q")).alias("pointing"))


def repository_links(spark, d):
    link = F.concat(F.when(F.col("page_id") % 2 == 0, "https://").otherwise(""), F.lit("github.com/own-"), F.col("page_id"), F.when(F.col("page_id") % 5 == 0, "").otherwise("/re.po"), F.when(F.col("page_id") % 3 == 0, ".git").when(F.col("page_id") % 3 == 1, "/tree/main/x").otherwise("/"))
    r = table(spark, d, "pages").select("page_id", A.repository(link).alias("r"))
    return r.select("page_id", "r.owner", "r.name", "r.branch")


def json_parts(spark, d):
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.concat(F.lit("so: ```json\n"), "props", F.lit("\n``` done"))).when(k == 1, F.concat(F.lit("it is "), "props", F.lit(" then"))).when(k == 2, F.lit(" none } { ")).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", A.json_part(text).alias("part"))


def error_kinds(spark, d):
    status = F.element_at(F.array(*map(F.lit, (429, 500, 401, 404, 400, 400, 429))), (F.col("event_id") % 7 + 1).cast("int"))
    said = F.element_at(F.array(*map(F.lit, ("slow down", "limit per day", "location is not supported", "no such region: not supported", "bad api key"))), (F.col("event_id") % 5 + 1).cast("int"))
    code = F.when(F.col("event_id") % 11 == 0, "RATE_LIMIT_X").otherwise(F.lit(""))
    return table(spark, d, "events").groupBy(A.error_kind(status, code, said).alias("kind")).agg(F.count("*").alias("n"))


def key_hints(spark, d):
    key = F.concat(F.element_at(F.array(*map(F.lit, ("AIza", "gsk_", "sk-ant-", "", "'x"))), (F.col("c_custkey") % 5 + 1).cast("int")), F.when(F.col("c_custkey") % 5 == 3, "").otherwise(F.col("c_name")))
    return table(spark, d, "customer").select("c_custkey", A.key_hint(key).alias("hint"), A.redacted(F.concat(F.lit("key "), "c_name"), ["Customer#", "short"]).alias("said"))


def code_summaries(spark, d):
    names = table(spark, d, "part").groupBy("p_brand").agg(F.slice(F.sort_array(F.collect_list("p_name")), 1, 7).alias("names"), F.min("p_size").alias("k"))
    path = F.concat("p_brand", F.when(F.col("p_brand").endswith("2"), ".h").otherwise(".c"))
    kept = F.when(F.col("p_brand").endswith("1"), F.array().cast("array<string>")).when(F.col("p_brand").endswith("3"), F.slice("names", 1, 1)).otherwise(F.col("names"))
    doc = F.when(F.col("p_brand").endswith("4"), "Reads all. Then stops.").otherwise("")
    return names.select("p_brand", A.summary_of_code(path, doc, kept).alias("said"))


def chart_boxes(spark, d):
    """Boxes by kind of charts of a function with p_size decisions, in four languages: beyond the budget the rest is one folded box."""
    k = F.col("p_partkey") % 4
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (k + 1).cast("int"))
    code = F.concat(pick("int f(int a) {", "class A { int f(int a) {", "function f(a) {", "function f(a: number): number {"), F.expr("repeat('\\n  if (a > 1) { g(a); }', p_size)"), F.lit("\n  return a;\n}"), pick("", "}", "", ""))
    part = spread(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey")  # charts take milliseconds each, and the file may be one split
    files = part.select(F.col("p_partkey").cast("string").alias("path"), pick("c", "java", "javascript", "typescript").alias("language"), code.cast("binary").alias("content"))
    return flowcharts(files).select("path", "function", F.explode("boxes.kind").alias("kind")).groupBy("path", "function", "kind").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (chart_boxes, changed_definitions, file_level, file_importers, still_called, uses_sets, retrieved_subgraph, change_totals, code_language, tag_names, lists_in_words, questions, repository_links, json_parts, error_kinds, key_hints, code_summaries)}


def _pick(values, key):
    return f"[{', '.join(chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39) for v in values)}][{key} % {len(values)} + 1]"


_Q = chr(39) * 2
_SP = """sp AS (SELECT 'f' || o_custkey AS path, 'f' || o_custkey || '::o' || o_orderkey AS id, o_orderkey % 500 * 40 + 1 AS a, o_orderkey % 500 * 40 + 40 AS z FROM orders
 UNION ALL SELECT 'f' || o_custkey, 'f' || o_custkey || '::o' || o_orderkey || '.x', o_orderkey % 500 * 40 + 11, o_orderkey % 500 * 40 + 20 FROM orders WHERE o_orderkey % 3 = 0),
li AS (SELECT 'f' || o_custkey AS path, l_orderkey % 500 * 40 + l_partkey % 57 + 1 AS line, l_partkey % 4 <> 0 AS added FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R')"""
_TERMS = f"len(list_filter([{', '.join(f'regexp_matches(lower(q), {chr(39)}{p}{chr(39)})' for p, _ in GLOSSARY.values())}], lambda x: x))"
ORACLES = {
    "chart_boxes": """SELECT p_partkey::VARCHAR AS path, CASE WHEN p_partkey % 4 = 1 THEN 'A.f' ELSE 'f' END AS function, kind, n FROM (
SELECT p_partkey, unnest(['start', 'end', 'decision', 'action', 'return', 'folded']) AS kind, unnest([1, 1, least(p_size, 34), least(p_size, 34), CASE WHEN p_size < 34 THEN 1 ELSE 0 END, CASE WHEN p_size < 34 THEN 0 ELSE 1 END]) AS n FROM part) WHERE n > 0""",
    "changed_definitions": f"""WITH {_SP}, h AS (SELECT DISTINCT sp.* FROM sp JOIN li ON sp.path = li.path AND line BETWEEN a AND z),
i AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.path = h.path AND o.id <> h.id AND o.a >= h.a AND o.z <= h.z AND (o.a > h.a OR o.z < h.z))),
s AS (SELECT i.*, EXISTS (SELECT 1 FROM orders WHERE o_orderkey % 5 <> 0 AND 'f' || o_custkey || '::o' || o_orderkey = i.id) AS was FROM i)
SELECT id, CASE WHEN was THEN 'modified' ELSE 'added' END AS status, was AND EXISTS (SELECT 1 FROM li WHERE li.path = s.path AND line = a AND added) AS signature_changed FROM s""",
    "file_level": f"WITH {_SP} SELECT DISTINCT path FROM li WHERE line % 7 >= 5 AND NOT EXISTS (SELECT 1 FROM sp WHERE sp.path = li.path AND line BETWEEN a AND z)",
    "file_importers": f"WITH {graphs.EDGES} SELECT source AS path, target AS imports, line FROM ed JOIN nation ON source = 'nation_' || n_nationkey WHERE type = 'imports' AND target IN ('region_1', 'region_3') AND n_nationkey % 4 <> 0",
    "still_called": "SELECT p_brand || '.' || p_partkey AS qual, l_suppkey AS path, l_orderkey AS line, l_linenumber AS caller FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 50 ORDER BY path, line, caller, qual LIMIT 20",
    "uses_sets": f"""WITH {graphs.LINKS}, u AS (SELECT path, list_sort(list(DISTINCT t) FILTER (t IS NOT NULL)) AS u, count(DISTINCT b) AS n FROM (SELECT source AS path, target AS t, NULL AS b FROM fl UNION ALL SELECT target, NULL, source FROM fl) GROUP BY path)
SELECT path, CASE WHEN coalesce(len(u), 0) = 0 THEN 'none' WHEN len(u) > 12 THEN array_to_string(u[:12], ', ') || ' (+' || (len(u) - 12) || ' more)' ELSE array_to_string(u, ', ') END AS uses, n AS n_used_by FROM u""",
    "retrieved_subgraph": f"WITH {graphs.CALLS}, t AS (SELECT id FROM (SELECT source AS id FROM ca UNION ALL SELECT target FROM ca) GROUP BY id ORDER BY count(*) DESC, id LIMIT 200) SELECT source, target, confidence FROM ca WHERE source IN (SELECT id FROM t) AND target IN (SELECT id FROM t)",
    "change_totals": f"WITH {_SP} SELECT count(DISTINCT path) AS files, count(*) FILTER (added) AS added, count(*) FILTER (NOT added) AS removed FROM li",
    "code_language": f"""SELECT doc_id, CASE WHEN regexp_matches(c, '{A.CODE_LANGUAGES[0][1]}') OR (regexp_matches(c, '{A.C_MAIN}') AND NOT contains(c, 'public')) THEN 'c'
{' '.join(f"WHEN regexp_matches(c, '{x}') THEN '{n}'" for n, x in A.CODE_LANGUAGES[1:])} ELSE 'python' END AS language FROM (SELECT doc_id, left(text, 60) || chr(10) || {_pick(_SNIPPETS, 'doc_id')} AS c FROM documents)""",
    "tag_names": """SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_brand || ' / ' || p_type), '[^a-z0-9+#.-]+', '-', 'g'), '^-+|-+$', '', 'g') AS tag,
CASE WHEN lower(left(p_name, 1)) IN ('a', 'e', 'i', 'o', 'u') THEN 'an ' ELSE 'a ' END || p_name AS one, (p_size % 3) || ' ' || p_brand || CASE WHEN p_size % 3 = 1 THEN '' ELSE 's' END AS some FROM part""",
    "lists_in_words": "SELECT n_regionkey, CASE WHEN n_regionkey = 0 THEN l[1] ELSE array_to_string(l[1:n_regionkey], ', ') || ' and ' || l[n_regionkey + 1] END AS said FROM (SELECT n_regionkey, list_sort(list(n_name)) AS l FROM nation GROUP BY n_regionkey)",
    "questions": f"""SELECT conv_id, turn, {_TERMS} > 0 AND regexp_matches(q, '{A.CONCEPT.replace(chr(39), _Q)}') AND NOT regexp_matches(q, '{A.SPECIFIC}') AS concept, regexp_matches(q, '{A.GENERAL}') AS general, regexp_matches(q, '{A.POINTING}') AS pointing
FROM (SELECT conv_id, turn, {_pick(_ASKED, '(conv_id + turn)')} AS q FROM conversations)""",
    "repository_links": """SELECT page_id, CASE WHEN page_id % 5 <> 0 THEN 'own-' || page_id END AS owner, CASE WHEN page_id % 5 <> 0 THEN 're.po' END AS name, CASE WHEN page_id % 5 <> 0 AND page_id % 3 = 1 THEN 'main/x' END AS branch FROM pages""",
    "json_parts": "SELECT event_id, CASE WHEN event_id % 4 = 2 THEN 'none } {' ELSE trim(props) END AS part FROM events",
    "error_kinds": f"""SELECT CASE WHEN (s = 429 OR x = 0) AND contains(m, 'per day') THEN 'daily' WHEN s = 429 OR x = 0 THEN 'rate' WHEN s = 500 THEN 'overloaded' WHEN contains(m, 'location is') OR contains(m, 'region') THEN 'region' WHEN s = 401 OR contains(m, 'api key') THEN 'auth' WHEN s = 404 THEN 'model' ELSE 'bad_request' END AS kind, count(*) AS n
FROM (SELECT [429, 500, 401, 404, 400, 400, 429][event_id % 7 + 1] AS s, event_id % 11 AS x, {_pick(("slow down", "limit per day", "location is not supported", "no such region: not supported", "bad api key"), 'event_id')} AS m FROM events) GROUP BY 1""",
    "key_hints": """SELECT c_custkey, CASE c_custkey % 5 WHEN 3 THEN 'missing' WHEN 0 THEN 'set, AI Studio style (AIza...), ' || (4 + length(c_name)) || ' characters' WHEN 1 THEN 'set, Groq style (gsk_...), ' || (4 + length(c_name)) || ' characters'
WHEN 2 THEN 'set, Anthropic style (sk-ant-...), ' || (7 + length(c_name)) || ' characters' ELSE 'set, unknown format, ' || (2 + length(c_name)) || ' characters - has spaces or quotes around it!' END AS hint, 'key ' || replace(c_name, 'Customer#', '***') AS said FROM customer""",
    "code_summaries": """SELECT p_brand, CASE right(p_brand, 1) WHEN '4' THEN 'Reads all.' WHEN '2' THEN 'A header file: it lists functions so other files can use them.' WHEN '1' THEN 'No functions here; it may hold settings or a small script.' WHEN '3' THEN 'Defines 1 function: ' || l[1] || '.'
ELSE 'Defines ' || least(7, len(l)) || ' function' || CASE WHEN len(l) = 1 THEN '' ELSE 's' END || ': ' || array_to_string(l[1:4], ', ') || CASE WHEN len(l) > 4 THEN ' and ' || (least(7, len(l)) - 4) || ' more' ELSE '' END || '.' END AS said FROM (SELECT p_brand, list_sort(list(p_name)) AS l FROM part GROUP BY p_brand)""",
}
