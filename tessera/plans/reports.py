"""Report queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import full_lines
from tessera.operators import graph as G
from tessera.operators import report as R
from tessera.operators.sequence import greedy_batches
from tessera.plans import graphs
from tessera.session import table


def overview_row(spark, d):
    files = table(spark, d, "documents").select(F.col("lang").alias("language"), full_lines(F.col("text")).alias("lines"))
    return R.overview(graphs.nodes(spark, d), graphs.edges(spark, d), files)


def key_symbols(spark, d):
    s = graphs.nodes(spark, d).where("type IN ('function', 'method', 'class')")
    s = s.select("id", "path", "type", "name", F.lit(True).alias("top"), (F.length("name") % 9).cast("long").alias("size"))
    return R.key_symbols(s, G.degrees(graphs.edges(spark, d)))


def size_estimate(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    b = greedy_batches(docs, "source", "doc_id", "n_chars", 45_000, 10).join(docs, ["source", "doc_id"])
    return R.size_estimate(b.groupBy("source", "batch").agg(F.sum("n_chars").alias("chars"), F.count("*").alias("files"), F.sum(F.col("doc_id") % 5).alias("symbols")))


def glossary_terms(spark, d):
    """Terms of each turn, in words that the turns hold: their text with a keyword by turn."""
    word = F.element_at(F.array(*map(F.lit, ("loops", "an exception", "the function returns", "nothing", "classes and imports"))), (F.col("turn") % 5 + 1).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(R.glossary_terms(F.concat_ws(" ", "text", word)), ",").alias("terms"))


def columnar_pack(spark, d):
    """Flattened for comparison: sizes and ends of the arrays over all blocks."""
    p = R.columnar_pack(graphs.nodes(spark, d), graphs.edges(spark, d))
    n, calls = F.size("ids").cast("long"), (F.size("calls") / 2).cast("long")
    total = F.aggregate("calls", F.lit(0).cast("long"), lambda a, x: a + x)
    of = p.select("block", n.alias("n"), F.get("ids", F.lit(0)).alias("first"), F.try_element_at("ids", F.lit(-1)).alias("last"), calls.alias("calls"), total.alias("total"))
    held = F.when(F.col("n") > 0, F.col("block"))
    return of.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min_by("first", held).alias("first"), F.max_by("last", held).alias("last"), F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"))


QUERIES = {"overview_row": overview_row, "key_symbols": key_symbols, "size_estimate": size_estimate, "glossary_terms": glossary_terms, "columnar_pack": columnar_pack}
_DEGREE = """x AS (SELECT *, split_part(source, '::', 1) AS fs, split_part(target, '::', 1) AS ft FROM ed WHERE type IN ('calls', 'imports')),
dg AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM x UNION ALL SELECT target FROM x UNION ALL SELECT fs FROM x WHERE type = 'calls' AND fs <> ft UNION ALL SELECT ft FROM x WHERE type = 'calls' AND fs <> ft) GROUP BY id)"""
_TURN = "text || ' ' || CASE turn % 5 WHEN 0 THEN 'loops' WHEN 1 THEN 'an exception' WHEN 2 THEN 'the function returns' WHEN 3 THEN 'nothing' ELSE 'classes and imports' END"
ORACLES = {
    "overview_row": f"""WITH {graphs.LINKS}, l AS (SELECT lang, sum(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda y: trim(y) <> ''))) AS lines FROM documents GROUP BY lang),
v AS (SELECT (SELECT count(*) FROM nd WHERE type = 'file') AS files, (SELECT count(*) FROM nd WHERE type IN ('function', 'method')) AS functions, (SELECT count(*) FROM nd WHERE type = 'class') AS classes, (SELECT count(*) FROM ed WHERE type = 'calls') AS calls, (SELECT count(*) FROM ed WHERE type = 'imports') AS imports,
 CAST((SELECT sum(lines) FROM l) AS BIGINT) AS lines, (SELECT lang FROM l ORDER BY lines DESC, lang DESC LIMIT 1) AS language, (SELECT path FROM cn ORDER BY connections DESC, path LIMIT 1) AS busiest)
SELECT *, 'A project in ' || language || ' with ' || files || ' files and ' || functions || ' functions (' || lines || ' lines of code). ' || calls || ' calls were found.' AS said FROM v""",
    "key_symbols": f"""WITH {graphs.EDGES}, {_DEGREE},
s AS (SELECT path, id, CAST(degree AS DOUBLE) * 3 + 8 + CASE WHEN type = 'class' THEN 5 ELSE 0 END + CAST(length(name) % 9 AS DOUBLE) / 10 - CASE WHEN regexp_matches(name, '^_($|[^_])') THEN 6 ELSE 0 END AS score FROM (SELECT nd.*, coalesce(degree, 0) AS degree FROM nd LEFT JOIN dg USING (id) WHERE type IN ('function', 'method', 'class')) WHERE length(name) % 9 >= 3 OR degree >= 2),
p AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY round(score, 6) DESC, id) AS place, id, round(score, 6) AS score FROM s) SELECT * FROM p WHERE place <= 6""",
    "size_estimate": """WITH RECURSIVE o AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
r AS (SELECT source, doc_id, n_chars, i, 0 AS batch, n_chars AS w, 1 AS n FROM o WHERE i = 1 UNION ALL
SELECT o.source, o.doc_id, o.n_chars, o.i, batch + CASE WHEN w + o.n_chars > 45000 OR n >= 10 THEN 1 ELSE 0 END, CASE WHEN w + o.n_chars > 45000 OR n >= 10 THEN o.n_chars ELSE w + o.n_chars END, CASE WHEN w + o.n_chars > 45000 OR n >= 10 THEN 1 ELSE n + 1 END FROM r JOIN o ON o.source = r.source AND o.i = r.i + 1),
b AS (SELECT source, batch, sum(n_chars) AS chars, count(*) AS files, sum(doc_id % 5) AS symbols FROM r GROUP BY source, batch)
SELECT count(*) AS batches, CAST(sum(chars // 4 + 1200) AS BIGINT) AS tokens_in, CAST(sum(files * 130 + symbols * 45) AS BIGINT) AS tokens_out FROM b""",
    "glossary_terms": f"SELECT conv_id, turn, array_to_string(list_filter([{', '.join(f"CASE WHEN regexp_matches(q, '{p}') THEN '{k}' END" for k, (p, _) in R.GLOSSARY.items())}], lambda x: x IS NOT NULL), ',') AS terms FROM (SELECT conv_id, turn, lower({_TURN}) AS q FROM conversations)",
    "columnar_pack": f"WITH {graphs.EDGES}, p AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS place FROM nd) SELECT (SELECT count(*) FROM p) AS n, (SELECT min(id) FROM p) AS first, (SELECT max(id) FROM p) AS last, count(*) AS calls, CAST(sum(s.place + t.place) AS BIGINT) AS total FROM ca JOIN p s ON ca.source = s.id JOIN p t ON ca.target = t.id",
}
