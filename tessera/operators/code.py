"""From files to the property graph: import resolution and call linking as ranked joins.

Each rule of the cascade is a join that gives (call, rank, target, confidence); a rule that knows that a call leaves the tree gives a null target, a veto. The
rule of least rank decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.parse import parse_files, table_of
from tessera.operators.graph import ancestors, merge_edges
from tessera.operators.resolve import cascade, first_wins, suffixes

# Method names that built-in types have, and receivers that are globals of a language; a call by such a name alone is never linked.
COMMON = (
    "get set add append extend insert pop push shift remove delete clear copy update keys values items has map filter reduce forEach find some every "
    "includes indexOf index count sort reverse slice splice concat join split replace strip trim lower upper format startswith endswith startsWith endsWith "
    "toString valueOf equals hashCode size length isEmpty contains then catch finally resolve reject log error warn info debug read write open close "
    "send emit on off call apply bind next run start stop encode decode load loads dump dumps parse stringify json print println exec match "
    "test search execute fetch all first save"
).split()
GLOBALS = "globalThis window global document console navigator Math JSON Object Array Promise Reflect Number String Date process Buffer os sys System".split()


def _climb(folder, dots):
    """A folder, dots - 1 levels up."""
    parts = F.split(folder, "/")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - dots + 1, F.lit(0))), "/")


def _clean(path):
    """Without ./ and with ../ taken out."""
    return F.array_join(
        F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda acc, p: F.when(p.isin("", "."), acc).when((p == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(p)))), "/"
    )


def resolve_imports(files: DataFrame, imports: DataFrame) -> DataFrame:
    """imports (path, language, source) -> (path, source, target): distinct pairs that a file of the tree answers."""
    asked = imports.select("path", "language", "source").distinct()
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    at = lambda base, *tails: F.array(*(_clean(F.concat_ws("/", base, F.concat(F.lit(""), t))) for t in tails))
    dots = F.length(F.regexp_extract("source", "^([.]*)", 1))
    module = F.replace(F.regexp_replace("source", "^[.]+", ""), F.lit("."), F.lit("/"))
    py = lambda base: at(base, F.concat(module, F.lit(".py")), F.concat(module, F.lit("/__init__.py")), F.concat(module, F.lit(".pyi")))
    python = F.when(dots > 0, py(_climb(folder, dots))).otherwise(F.concat(py(folder), py(F.lit(""))))
    stem = F.regexp_replace("source", "[.](js|jsx|mjs|cjs)$", "")
    endings = [F.col("source"), *(F.concat(stem, F.lit(e)) for e in (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".d.ts")), *(F.concat("source", F.lit(e)) for e in ("/index.ts", "/index.tsx", "/index.js", "/index.jsx"))]
    script = F.when(F.col("source").startswith("."), at(folder, *endings)).otherwise(F.array().cast("array<string>"))
    c = at(folder, F.col("source"))
    near = F.when(F.col("language") == "python", python).when(F.col("language").isin("javascript", "typescript"), script).when(F.col("language") == "c", c).otherwise(F.array().cast("array<string>"))
    known = files.select(F.col("path").alias("target")).distinct()
    first = asked.select("path", "source", F.posexplode(near).alias("rank", "target")).join(known, "target")
    # anywhere in the tree, if one file alone ends so; Java names may end in members
    dotted = F.replace("source", F.lit("."), F.lit("/"))
    tails = (
        F.when((F.col("language") == "python") & (dots == 0), F.array(F.struct(F.lit(90).alias("rank"), F.concat(module, F.lit(".py")).alias("suffix")), F.struct(F.lit(91).alias("rank"), F.concat(module, F.lit("/__init__.py")).alias("suffix"))))
        .when(F.col("language") == "java", F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.struct((k + 90).alias("rank"), F.concat(F.array_join(F.slice(F.split(dotted, "/"), F.lit(1), F.greatest(F.size(F.split(dotted, "/")) - k, F.lit(0))), "/"), F.lit(".java")).alias("suffix"))))
        .when(F.col("language") == "c", F.array(F.struct(F.lit(90).alias("rank"), F.substring_index("source", "/", -1).alias("suffix"))))
    )
    only = suffixes(files.select("path").distinct()).groupBy("suffix").agg(F.count("*").alias("n"), F.min("path").alias("target")).where("n = 1")
    second = asked.select("path", "source", F.inline(tails)).join(only.select("suffix", "target"), "suffix").select("path", "source", "rank", "target")
    every = first.select("path", "source", "rank", "target").unionByName(second).where("target <> path")
    return every.groupBy("path", "source").agg(F.min_by("target", F.struct("rank", "target")).alias("target"))


def link_calls(definitions: DataFrame, calls: DataFrame, bindings: DataFrame, resolved: DataFrame) -> DataFrame:
    """(source, target, line, confidence) of calls whose target the cascade finds."""
    calls = calls.withColumn("id", F.concat_ws("|", "path", "pos"))
    d = first_wins(definitions.select("path", "pos", "name", "kind", "parent", F.col("id").alias("target")), ["path", "parent", "name"], "pos")
    top = d.where("parent IS NULL").select("path", "name", "target", "kind")
    member = d.where("parent IS NOT NULL").select(F.col("parent").alias("owner"), "name", "target")
    scope = definitions.select(F.col("id").alias("caller"), "parent", "kind")
    bare, dotted = calls.where("receiver IS NULL"), calls.where("receiver IS NOT NULL")

    def rule(found: DataFrame, rank: int, confidence: str = "high") -> DataFrame:
        return found.select("id", F.lit(rank).alias("rank"), "target", F.lit(confidence).alias("confidence"))

    def veto(found: DataFrame, rank: int) -> DataFrame:
        return found.select("id", F.lit(rank).alias("rank"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("confidence"))

    # what is around a definition, to the top
    around = ancestors(scope.select(F.col("caller").alias("id"), "parent")).select(F.col("id").alias("caller"), F.col("ancestor").alias("owner"), F.col("distance").alias("far"))
    classes = definitions.where("kind IN ('class', 'interface', 'enum', 'record')").select(F.col("id").alias("owner"))
    holder = around.join(classes, "owner").groupBy("caller").agg(F.min_by("owner", "far").alias("owner"))
    own = dotted.where("receiver IN ('self', 'this', 'cls')").join(holder, "caller").join(member, ["owner", "name"])
    inner = bare.join(member.withColumnRenamed("owner", "caller"), ["caller", "name"])
    beside = bare.join(around.join(classes, "owner", "left_anti"), "caller").join(member, ["owner", "name"])
    java = bare.where("language = 'java'").join(holder, "caller").join(member, ["owner", "name"])
    same = bare.join(top, ["path", "name"])
    bound = first_wins(bindings.where("local <> '*'"), ["path", "local"], "pos").select("path", F.col("local"), F.col("source"), "imported")
    bound = bound.join(resolved.withColumnRenamed("target", "file"), ["path", "source"], "left")
    named = bare.join(bound.withColumnRenamed("local", "name"), ["path", "name"])
    tops = top.select(F.col("path").alias("file"), F.col("name").alias("imported"), "target", F.col("kind").alias("made"))
    through = named.join(tops, ["file", "imported"])
    outside = named.where("file IS NULL")
    stars = bindings.where("local = '*'").select("path", "source").join(resolved, ["path", "source"]).select("path", F.col("target").alias("file")).distinct()
    starred = bare.join(stars, "path").join(top.select(F.col("path").alias("file"), "name", "target"), ["file", "name"])
    bodies = top.select(F.regexp_replace("path", "[.]c$", ".h").alias("file"), "name", "target").where("file LIKE '%.h'")
    partner = bare.where("language = 'c'").join(stars, "path").join(bodies, ["file", "name"])
    module = dotted.join(bound.withColumnRenamed("local", "receiver"), ["path", "receiver"])
    on_module = module.where("imported = '*'").join(top.select(F.col("path").alias("file"), "name", "target"), ["file", "name"])
    on_class = module.join(tops.withColumnRenamed("target", "owner"), ["file", "imported"]).join(member, ["owner", "name"])
    gone = module.where("file IS NULL")
    local_class = dotted.join(top.select("path", F.col("name").alias("receiver"), F.col("target").alias("owner")), ["path", "receiver"]).join(member, ["owner", "name"])
    typed = definitions.where("kind IN ('class', 'interface', 'enum', 'record')").groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("owner")).where("n = 1").select(F.col("name").alias("receiver_type"), "owner")
    declared = dotted.where("receiver_type IS NOT NULL").join(typed, "receiver_type").join(member, ["owner", "name"])
    untyped = dotted.where("receiver_type IS NOT NULL").join(typed, "receiver_type", "left_anti")
    unique = definitions.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("target")).where("n = 1").where(~F.col("name").isin(*COMMON)).select("name", "target")
    known = F.substring_index("receiver", ".", 1).isin(*GLOBALS)
    guessed = calls.where("receiver IS NOT NULL AND NOT receiver IN ('self', 'this', 'cls', '?') OR language = 'c'").where(F.col("receiver").isNull() | ~known).join(unique, "name").where("target <> caller")
    found = cascade(
        [rule(declared, 1), veto(untyped, 2), rule(own, 3), rule(inner, 4), rule(beside, 5), rule(java, 6), rule(same, 7), rule(through, 8), veto(outside, 9), rule(starred, 10), rule(partner, 11), rule(on_module, 12), rule(on_class, 13), veto(gone, 14), rule(local_class, 15), rule(guessed, 16, "medium")]
    )
    return calls.join(found, "id").where("caller <> target").select(F.col("caller").alias("source"), "target", F.col("line").cast("long").alias("line"), "confidence")


def build_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files (path, language, content, hash) -> nodes and edges (source, target, type, line, confidence)."""
    facts = parse_files(files).persist()
    definitions, imports, bindings, calls = (table_of(facts, n) for n in ("definitions", "imports", "bindings", "calls"))
    resolved = resolve_imports(files, imports.select("path", "language", "source").unionByName(_submodules(bindings)))
    outside = imports.join(resolved, ["path", "source"], "left_anti").groupBy("path").agg(F.sort_array(F.collect_set("source")).alias("external_imports"))
    null = F.lit(None).cast("string")
    file_nodes = facts.select("path", "language", "doc", "has_errors").join(outside, "path", "left")
    file_nodes = file_nodes.select(F.col("path").alias("id"), F.lit("file").alias("type"), F.substring_index("path", "/", -1).alias("name"), "path", "language", null.alias("parent"), "doc", "has_errors", F.coalesce("external_imports", F.array().cast("array<string>")).alias("external_imports"))
    nodes = file_nodes.unionByName(definitions.select("id", F.col("kind").alias("type"), "name", "path", "parent", "start_line", "end_line", "signature", "doc"), allowMissingColumns=True)
    contains = definitions.select(F.coalesce("parent", "path").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("type"), F.lit(None).cast("long").alias("line"), null.alias("confidence"))
    lined = imports.join(resolved, ["path", "source"]).select(F.col("path").alias("source"), "target", F.lit("imports").alias("type"), F.col("line").cast("long").alias("line"), null.alias("confidence"))
    linked = link_calls(definitions, calls, bindings, resolved).select("source", "target", F.lit("calls").alias("type"), "line", "confidence")
    return nodes, merge_edges(contains.unionByName(lined).unionByName(linked))


def _submodules(bindings: DataFrame) -> DataFrame:
    """from package import module: the module may be a file."""
    b = bindings.where("language = 'python' AND imported <> '*'")
    joiner = F.when(F.col("source").endswith("."), "").otherwise(".")
    return b.select("path", "language", F.concat("source", joiner, "imported").alias("source"))
