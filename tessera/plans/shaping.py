"""Classifier, resolution and sequence queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import classify as C
from tessera.operators import resolve as R
from tessera.operators import sequence as S
from tessera.session import table

NAMES = ("test_cart.py", "cart.test.ts", "Panel.tsx", "order_controller.py", "models.py", "mail_service.py", "util.py", "thing.py", "README.md", "app.min.js", ".env.local")
FOLDERS = ("src", "src/components/x", "app/api", "core/jobs", "db", "lib/shared", "tests/unit", "node_modules/a", ".git")


def _pick(names, key):
    return F.element_at(F.array(*map(F.lit, names)), (F.col(key) % len(names) + 1).cast("int"))


def paths(spark, d):
    """A made-up path for each page: a folder and a name from literal lists, under the page's host."""
    host = F.regexp_extract("url", "^https?://([^/:?#]+)", 1)
    return table(spark, d, "pages").select("page_id", F.concat_ws("/", host, _pick(FOLDERS, "page_id"), _pick(NAMES, "page_id")).alias("path"), F.floor(F.col("page_id") / 7).alias("k"))


def _case(names, key):
    return "CASE " + " ".join(f"WHEN {key} % {len(names)} = {i} THEN '{n}'" for i, n in enumerate(names)) + " END"


PATHS = f"p AS (SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) || '/' || {_case(FOLDERS, 'page_id')} || '/' || {_case(NAMES, 'page_id')} AS path, page_id // 7 AS k, string_split(path, '/') AS parts, parts[-1] AS name FROM pages)"
_BASE = "regexp_replace(name, '^(.+)[.][^.]*$', '\\1')"
_FOLD = "list_transform(parts[:-2], lambda f: lower(f))"
_LAYER = f"""CASE WHEN len(list_filter({_FOLD}, lambda f: regexp_matches(f, '{C.TEST_FOLDER}'))) > 0 OR regexp_matches({_BASE}, '{C.TEST_FILE}') THEN 'Tests' WHEN regexp_matches(name, '[.](tsx|jsx)$') THEN 'UI'
{' '.join(f"WHEN regexp_matches(lower(split_part({_BASE}, '.', 1)), '{x}') THEN '{layer}'" for layer, x in C.STEMS)}
ELSE coalesce(list_filter(list_transform(list_reverse({_FOLD}), lambda f: CASE {' '.join(f"WHEN list_contains({names.split()}, f) THEN '{layer}'" for layer, names in C.FOLDERS.items())} END), lambda x: x IS NOT NULL)[1], 'Unclassified') END"""


def layer_guess(spark, d):
    return paths(spark, d).select("page_id", C.guess_layer(F.col("path")).alias("layer"))


def layer_override(spark, d):
    files = paths(spark, d)
    keys = files.where("page_id % 5 = 0").select(F.regexp_extract("path", "^([^/]+/)", 1).alias("key"), F.lit("Utility").alias("layer")).distinct()
    keys = keys.unionByName(files.where("page_id % 15 = 0").select(F.col("path").alias("key"), F.lit("API").alias("layer")).distinct())
    one = files.groupBy("path").agg(F.min(F.when(F.col("page_id") % 3 == 0, "Service")).alias("ai_layer"))
    return C.resolve_layers(one, keys)


def safe_path(spark, d):
    odd = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("/"), "path")).when(F.col("page_id") % 5 == 1, F.concat(F.lit("a/./b//"), "path")).when(F.col("page_id") % 5 == 2, F.concat(F.lit("a/../"), "path")).when(F.col("page_id") % 5 == 3, F.concat(F.lit("C:\\"), "path")).otherwise(F.replace("path", F.lit("/"), F.lit("\\")))
    return paths(spark, d).select("page_id", C.safe_path(odd).alias("safe"))


def skip_reasons(spark, d):
    return paths(spark, d).groupBy(F.coalesce(C.skip_reason(F.col("path")), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def language_guess(spark, d):
    return paths(spark, d).select("page_id", C.language(F.col("path")).alias("language"))


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")


def resolve_ranked(spark, d):
    """Each page asks for a name beside it with three endings; what another page has wins by order."""
    f = paths(spark, d)
    stem = F.regexp_replace("path", "[.][^./]*$", "")
    asked = f.select(F.col("page_id").alias("id"), F.posexplode(F.array(F.concat(stem, F.lit(".pyi")), F.concat(stem, F.lit(".ts")), F.concat(stem, F.lit(".py")))).alias("rank", "path"))
    return R.ranked(asked, f)


def resolve_unique_suffix(spark, d):
    f = paths(spark, d)
    return R.unique_suffix(f.select(F.col("page_id").alias("id"), F.substring_index("path", "/", -3).alias("suffix")), f)


def resolve_wildcard(spark, d):
    f = paths(spark, d)
    return R.members_of(f.select(F.col("k").alias("id"), F.regexp_replace("path", "/[^/]*$", "").alias("folder")).distinct(), f)


def external_anti(spark, d):
    """Parts that an order holds and that aren't among large parts."""
    item = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_partkey").alias("source"))
    known = table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("source"))
    return R.external(item, item.join(known, "source", "left_semi"))


def link_cascade(spark, d):
    """A line's target: its part if large; a veto if returned; its supplier if alone in its nation with that balance's sign; else the part, unsure."""
    item = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), "l_partkey", "l_suppkey", "l_returnflag")
    part = table(spark, d, "part").select("p_partkey", "p_size")
    row = item.join(part, F.col("l_partkey") == F.col("p_partkey"))
    text = lambda c: F.col(c).cast("string").alias("target")
    one = row.where("p_size > 30").select("id", F.lit(1).alias("rank"), text("l_partkey"), F.lit("high").alias("confidence"))
    two = row.where("l_returnflag = 'R'").select("id", F.lit(2).alias("rank"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("confidence"))
    only = table(spark, d, "supplier").groupBy("s_nationkey", (F.col("s_acctbal") > 0).alias("up")).agg(F.count("*").alias("n"), F.min("s_suppkey").alias("s")).where("n = 1")
    three = row.join(only, F.col("l_suppkey") == F.col("s")).select("id", F.lit(3).alias("rank"), text("l_suppkey"), F.lit("high").alias("confidence"))
    four = row.select("id", F.lit(4).alias("rank"), text("l_partkey"), F.lit("medium").alias("confidence"))
    return R.cascade([one, two, three, four])


def occurrence_ids(spark, d):
    item = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return S.occurrence_ids(item, ["l_orderkey"], "l_returnflag", "l_linenumber").select("l_orderkey", "l_linenumber", "qual")


def batch_fixed(spark, d):
    return S.fixed_batches(_docs(spark, d).select("doc_id", "n_chars"), [F.desc("n_chars"), F.col("doc_id")], 8).select("doc_id", "place", "batch")


def batch_greedy(spark, d):
    return S.greedy_batches(_docs(spark, d), "source", "doc_id", "n_chars", 45_000, 10)


def group_islands(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    return S.islands(e, ["user_id"], ["ts", "event_id"], "event_type").groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_type").alias("event_type"))


def _doctored(spark, d):
    docs = _docs(spark, d)
    return docs.where("doc_id % 11 <> 3").withColumn("text", F.when(F.col("doc_id") % 7 == 2, F.concat("text", F.lit(" more"))).otherwise(F.col("text")))


def hash_incremental(spark, d):
    return S.changes(_docs(spark, d), _doctored(spark, d), "doc_id", "text")


def carry_over(spark, d):
    old = _docs(spark, d).withColumn("note", F.when(F.col("doc_id") % 2 == 0, F.col("source")))
    return S.carry_over(_doctored(spark, d), old, "doc_id", "text", "note")


def rate_limit(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("s"))
    return S.accepted(e.select("user_id", "s", "event_id"), "user_id", ["s", "event_id"], "s", 2, 86_400).select("user_id", "event_id", "ok")


def daily_quota(spark, d):
    return table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("provider")).agg(F.count("*").alias("n"))


def retention_offset(spark, d):
    """Orders of a customer beyond the three newest."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return o.withColumn("n", n).where("n > 3").select("o_custkey", "o_orderkey")


def answer_cache_join(spark, d):
    """Turns whose request was seen before, by hash: the first answer's place."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.sha2(F.concat_ws("|", "role", F.lower("text")), 256).alias("key"))
    first = c.groupBy("key").agg(F.min(F.struct("conv_id", "turn")).alias("f"))
    return c.join(first, "key").select("conv_id", "turn", F.col("f.conv_id").alias("first_conv"), F.col("f.turn").alias("first_turn"))


def json_accept(spark, d):
    """Properties that parse and hold a whole k, clipped to a range."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    return table(spark, d, "events").select("event_id", k.alias("k")).where("k IS NOT NULL AND k BETWEEN 0 AND 50")


def change_lines(spark, d):
    """Lines of orders, old and new version: an order on or after the cut-off is new; what changed by line."""
    item = table(spark, d, "lineitem").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate")), "l_orderkey")
    new = F.col("o_orderdate") >= F.lit("1997-06-01").cast("timestamp_ntz")
    return item.groupBy("l_partkey").agg(F.count_if(new).alias("added"), F.count_if(~new).alias("kept"), F.min(F.when(new, F.col("l_linenumber"))).alias("first_line"))


def removed_defs(spark, d):
    """Parts only in orders before the cut-off."""
    item = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    return item.groupBy("l_partkey").agg(F.max("o_orderdate").alias("last")).where(F.col("last") < F.lit("2000-06-01").cast("timestamp_ntz")).select("l_partkey")


def html_links(spark, d):
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.posexplode(links).alias("pos", "href")).select("page_id", F.col("pos").cast("long").alias("pos"), "href")


QUERIES = {
    "layer_guess": layer_guess,
    "layer_override": layer_override,
    "safe_path": safe_path,
    "skip_reason": skip_reasons,
    "language_guess": language_guess,
    "generated_detector": lambda s, d: _docs(s, d).select("doc_id", C.is_generated(F.concat_ws("/", "source", F.lit("x.txt")), F.concat(F.when(F.col("doc_id") % 9 == 0, "# Code generated by a tool\n").otherwise(""), F.col("text"))).alias("generated")),
    "trivial_detector": lambda s, d: _docs(s, d).select("doc_id", C.code_lines(F.col("text")).alias("code_lines"), C.trivial(F.col("text")).alias("said")),
    "first_sentence": lambda s, d: _docs(s, d).select("doc_id", T.first_sentence(F.col("text")).alias("said")),
    "clip": lambda s, d: _docs(s, d).select("doc_id", T.clip(F.col("text"), 80).alias("said")),
    "slug": lambda s, d: table(s, d, "conversations").select("conv_id", "turn", T.slug(F.col("text")).alias("slug")),
    "citation_extract": lambda s, d: table(s, d, "conversations").select("conv_id", "turn", F.size(F.regexp_extract_all("text", F.lit("[A-Za-z_./]+:[0-9]+"), F.lit(0))).cast("long").alias("n")),
    "resolve_ranked_candidates": resolve_ranked,
    "resolve_unique_suffix": resolve_unique_suffix,
    "resolve_wildcard": resolve_wildcard,
    "external_anti": external_anti,
    "link_cascade": link_cascade,
    "occurrence_ids": occurrence_ids,
    "batch_fixed": batch_fixed,
    "batch_greedy": batch_greedy,
    "group_islands": group_islands,
    "hash_incremental": hash_incremental,
    "carry_over": carry_over,
    "rate_limit": rate_limit,
    "daily_quota": daily_quota,
    "retention_offset": retention_offset,
    "answer_cache_join": answer_cache_join,
    "json_accept": json_accept,
    "change_lines": change_lines,
    "removed_defs": removed_defs,
    "html_links": html_links,
}
_LINES = "list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: trim(l) <> '')"
_FLAT = "trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))"
_NEW = "(SELECT doc_id, CASE WHEN doc_id % 7 = 2 THEN text || ' more' ELSE text END AS text FROM documents WHERE doc_id % 11 <> 3)"
_DATED = "lineitem JOIN orders ON l_orderkey = o_orderkey"
_EXT = "lower(regexp_extract(name, '^.+[.]([^./]*)$', 1))"
ORACLES = {
    "layer_guess": f"WITH {PATHS} SELECT page_id, {_LAYER} AS layer FROM p",
    "layer_override": f"""WITH {PATHS}, o AS (SELECT DISTINCT regexp_extract(path, '^([^/]+/)', 1) AS key, 'Utility' AS layer FROM p WHERE page_id % 5 = 0 UNION SELECT path, 'API' FROM p WHERE page_id % 15 = 0),
f AS (SELECT path, any_value(parts) AS parts, any_value(name) AS name, min(CASE WHEN page_id % 3 = 0 THEN 'Service' END) AS ai FROM p GROUP BY path),
b AS (SELECT path, arg_max(layer, length(key)) AS own FROM f JOIN o ON path = key OR (key LIKE '%/' AND starts_with(path, key)) GROUP BY path), g AS (SELECT f.*, {_LAYER} AS guess FROM f)
SELECT g.path, coalesce(own, CASE WHEN ai IS NOT NULL AND guess <> 'Tests' THEN ai END, guess) AS layer, CASE WHEN own IS NOT NULL THEN 'user' WHEN ai IS NOT NULL AND guess <> 'Tests' THEN 'ai' ELSE 'guess' END AS decided FROM g LEFT JOIN b USING (path)""",
    "safe_path": f"WITH {PATHS} SELECT page_id, CASE page_id % 5 WHEN 1 THEN 'a/b/' || path WHEN 4 THEN path END AS safe FROM p",
    "skip_reason": f"""WITH {PATHS} SELECT CASE WHEN len(list_filter(parts[:-2], lambda f: list_contains({C.SKIP_FOLDERS}, f) OR starts_with(f, '.'))) > 0 THEN 'library or hidden folders' WHEN starts_with(lower(name), '.env') THEN 'secret files' WHEN lower(name) = 'readme.md' THEN 'kept'
WHEN NOT list_contains({list(C.LANGUAGES)}, {_EXT}) THEN 'not code' WHEN contains(lower(name), '.min.') THEN 'generated code' ELSE 'kept' END AS reason, count(*) AS n FROM p GROUP BY 1""",
    "language_guess": f"WITH {PATHS} SELECT page_id, CASE {_EXT} {' '.join(f"WHEN '{e}' THEN '{x}'" for e, x in C.LANGUAGES.items())} ELSE 'other' END AS language FROM p",
    "generated_detector": f"SELECT doc_id, doc_id % 9 = 0 OR regexp_matches(array_to_string(string_split(text, chr(10))[1:5], chr(10)), '{C.GENERATED_HEADER}') AS generated FROM documents",
    "trivial_detector": f"SELECT doc_id, n AS code_lines, CASE WHEN n = 0 THEN 'empty' WHEN n <= 3 THEN 'very small: ' || n || ' line(s)' END AS said FROM (SELECT doc_id, CAST(len(list_filter({_LINES}, lambda l: NOT regexp_matches(trim(l), '^(#|//|/[*]|[*])'))) AS BIGINT) AS n FROM documents)",
    "first_sentence": f"SELECT doc_id, CASE WHEN regexp_extract(f, '^(.*?[.!?])( |$)', 1) <> '' THEN regexp_extract(f, '^(.*?[.!?])( |$)', 1) ELSE f END AS said FROM (SELECT doc_id, {_FLAT} AS f FROM documents)",
    "clip": f"SELECT doc_id, CASE WHEN length(f) <= 80 THEN f ELSE rtrim(left(f, 79)) || '…' END AS said FROM (SELECT doc_id, {_FLAT} AS f FROM documents)",
    "slug": "SELECT conv_id, turn, CASE WHEN s = '' THEN 'note' ELSE s END AS slug FROM (SELECT conv_id, turn, regexp_replace(left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+', ''), 40), '-+$', '') AS s FROM conversations)",
    "citation_extract": "SELECT conv_id, turn, CAST(len(regexp_extract_all(text, '[A-Za-z_./]+:[0-9]+')) AS BIGINT) AS n FROM conversations",
    "resolve_ranked_candidates": f"WITH {PATHS}, a AS (SELECT page_id AS id, regexp_replace(path, '[.][^./]*$', '') AS s FROM p), c AS (SELECT id, unnest([1, 2, 3]) AS rank, unnest([s || '.pyi', s || '.ts', s || '.py']) AS path FROM a) SELECT id, arg_min(path, rank) AS path FROM c WHERE path IN (SELECT path FROM p) GROUP BY id",
    "resolve_unique_suffix": f"WITH {PATHS}, a AS (SELECT page_id AS id, array_to_string(parts[-3:], '/') AS s FROM p), u AS (SELECT DISTINCT path FROM p) SELECT id, min(path) AS path FROM a JOIN u ON path = s OR ends_with(path, '/' || s) GROUP BY id HAVING count(*) = 1",
    "resolve_wildcard": f"WITH {PATHS}, a AS (SELECT DISTINCT k AS id, array_to_string(parts[:-2], '/') AS f FROM p), u AS (SELECT DISTINCT path, array_to_string(parts[:-2], '/') AS dir FROM p) SELECT DISTINCT id, path FROM a JOIN u ON dir = f OR ends_with(dir, '/' || f)",
    "external_anti": "SELECT DISTINCT l_orderkey AS path, l_partkey AS source FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)",
    "link_cascade": """WITH o AS (SELECT min(s_suppkey) AS s FROM supplier GROUP BY s_nationkey, s_acctbal > 0 HAVING count(*) = 1),
l AS (SELECT l_orderkey || '-' || l_linenumber AS id, * FROM lineitem JOIN part ON l_partkey = p_partkey),
u AS (SELECT id, 1 AS rank, l_partkey AS t, 'high' AS confidence FROM l WHERE p_size > 30 UNION ALL SELECT id, 2, NULL, NULL FROM l WHERE l_returnflag = 'R' UNION ALL SELECT id, 3, l_suppkey, 'high' FROM l WHERE l_suppkey IN (SELECT s FROM o) UNION ALL SELECT id, 4, l_partkey, 'medium' FROM l),
n AS (SELECT id, rank, CAST(t AS VARCHAR) AS target, confidence, row_number() OVER (PARTITION BY id ORDER BY rank, CAST(t AS VARCHAR)) AS i FROM u) SELECT id, target, confidence, rank FROM n WHERE i = 1 AND target IS NOT NULL""",
    "occurrence_ids": "SELECT l_orderkey, l_linenumber, l_returnflag || CASE WHEN n > 1 THEN '#' || n ELSE '' END AS qual FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS n FROM lineitem)",
    "batch_fixed": "SELECT doc_id, place, place // 8 AS batch FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS place FROM documents)",
    "batch_greedy": """WITH RECURSIVE o AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
r AS (SELECT source, doc_id, i, 0 AS batch, n_chars AS w, 1 AS n FROM o WHERE i = 1 UNION ALL
SELECT o.source, o.doc_id, o.i, batch + CASE WHEN w + n_chars > 45000 OR n >= 10 THEN 1 ELSE 0 END, CASE WHEN w + n_chars > 45000 OR n >= 10 THEN n_chars ELSE w + n_chars END, CASE WHEN w + n_chars > 45000 OR n >= 10 THEN 1 ELSE n + 1 END FROM r JOIN o ON o.source = r.source AND o.i = r.i + 1)
SELECT source, doc_id, CAST(batch AS BIGINT) AS batch FROM r""",
    "group_islands": """WITH a AS (SELECT *, CASE WHEN lag(event_type) OVER w <> event_type THEN 1 ELSE 0 END AS x FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM a) SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(event_id) AS first, max(event_type) AS event_type FROM b GROUP BY user_id, island""",
    "hash_incremental": f"SELECT o.doc_id, CASE WHEN n.doc_id IS NULL THEN 'removed' WHEN sha256(o.text) = sha256(n.text) THEN 'same' ELSE 'changed' END AS state FROM documents o LEFT JOIN {_NEW} n USING (doc_id)",
    "carry_over": f"SELECT n.doc_id, CASE WHEN o.doc_id % 2 = 0 THEN source END AS note, o.doc_id % 2 = 0 AND o.text <> n.text AS stale FROM {_NEW} n JOIN documents o USING (doc_id)",
    "rate_limit": """WITH RECURSIVE e AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) AS i FROM events),
r AS (SELECT user_id, event_id, i, true AS ok, [s] AS q FROM e WHERE i = 1 UNION ALL
SELECT e.user_id, e.event_id, e.i, len(list_filter(q, lambda t: s - t <= 86400)) < 2, CASE WHEN len(list_filter(q, lambda t: s - t <= 86400)) < 2 THEN list_append(list_filter(q, lambda t: s - t <= 86400), s) ELSE list_filter(q, lambda t: s - t <= 86400) END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id, event_id, ok FROM r""",
    "daily_quota": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS provider, count(*) AS n FROM events GROUP BY 1, 2",
    "retention_offset": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) > 3",
    "answer_cache_join": "SELECT conv_id, turn, first_value(conv_id) OVER w AS first_conv, first_value(turn) OVER w AS first_turn FROM conversations WINDOW w AS (PARTITION BY role || '|' || lower(text) ORDER BY conv_id, turn)",
    "json_accept": "SELECT event_id, k FROM (SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE k BETWEEN 0 AND 50",
    "change_lines": f"SELECT l_partkey, count(*) FILTER (o_orderdate >= '1997-06-01') AS added, count(*) FILTER (NOT o_orderdate >= '1997-06-01') AS kept, min(l_linenumber) FILTER (o_orderdate >= '1997-06-01') AS first_line FROM {_DATED} GROUP BY l_partkey",
    "removed_defs": f"SELECT l_partkey FROM {_DATED} GROUP BY l_partkey HAVING max(o_orderdate) < '2000-06-01'",
    "html_links": """SELECT page_id, unnest(range(0, len(l))) AS pos, unnest(l) AS href FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages)""",
}
