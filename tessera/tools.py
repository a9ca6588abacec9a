"""The tools of a project: what an assistant, the command line or a service asks of a graph. Each answers with a DataFrame, empty if nothing is found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.flow import flowcharts
from tessera.operators import graph as G
from tessera.operators import report, search
from tessera.operators.code import build_graph
from tessera.session import cut


class Project:
    """files (path, language, content, hash) with their graph, made once."""

    def __init__(self, files: DataFrame, nodes: DataFrame | None = None, edges: DataFrame | None = None):
        self.files = files
        if nodes is None or edges is None:
            nodes, edges = build_graph(files)
            nodes, edges = cut(nodes), cut(edges)
        self.nodes, self.edges = nodes, edges
        self.symbols = nodes.where("type <> 'file'")
        self.lines = report.file_lines(files)

    def chunks(self, lines: int = 151, class_lines: int = 6) -> DataFrame:
        """(id, text): a symbol's name twice, its doc, its path and the beginning of its body."""
        last = F.least(F.col("end_line"), F.col("start_line") + F.when(F.col("type").isin("class", "interface", "enum", "record"), class_lines - 1).otherwise(lines - 1))
        spans = self.symbols.select("id", "path", "doc", F.col("start_line").alias("first"), last.alias("last"))
        rows = self.files.select("path", F.split(F.decode("content", "UTF-8"), "\n").alias("ls"))
        body = F.array_join(F.slice("ls", F.col("first"), F.greatest(F.col("last") - F.col("first") + 1, F.lit(0))), "\n")
        qual = F.element_at(F.split("id", "::"), 2)
        return spans.join(rows, "path").select("id", F.concat_ws(" ", qual, qual, F.coalesce("doc", F.lit("")), "path", body).alias("text"))

    def links(self) -> DataFrame:
        return self.edges.where("type = 'calls'").select("source", "target", "confidence")

    def find(self, name: str) -> DataFrame:
        """Symbols by id, file::name, qualified or plain name: the closest kind of match only."""
        qual = F.element_at(F.split("id", "::"), 2)
        rank = F.when(F.col("id") == name, 0).when(F.col("id").endswith("/" + name), 1).when(qual == name, 2).when(F.col("name") == name, 3)
        from pyspark.sql import Window

        found = self.symbols.withColumn("rank", rank).where("rank IS NOT NULL")
        return found.withColumn("best", F.min("rank").over(Window.partitionBy())).where("rank = best").select("id", "type", "path", "start_line", "end_line", "signature", "doc")  # few rows: those of one name

    def search_code(self, question: str) -> DataFrame:
        return search.synonym_search(self.chunks(), question)

    def retrieve(self, question: str) -> DataFrame:
        return search.retrieve(self.chunks(), self.links(), question)

    def read_function(self, name: str, most: int = 70) -> DataFrame:
        f = self.find(name)
        return self.lines.join(F.broadcast(f.select("path", "start_line", "end_line")), "path").where(F.col("line").between(F.col("start_line"), F.least(F.col("end_line"), F.col("start_line") + most - 1))).select("path", "line", "text").orderBy("path", "line")

    def read_file(self, path: str, first: int = 1, last: int | None = None) -> DataFrame:
        ok = (F.col("path") == path) | F.col("path").endswith("/" + path)
        return self.lines.where(ok & F.col("line").between(first, last or first + 39)).orderBy("path", "line")

    def find_callers(self, name: str) -> DataFrame:
        return G.callers(self.edges, self.find(name)).orderBy("id")

    def find_callees(self, name: str) -> DataFrame:
        return G.callees(self.edges, self.find(name)).orderBy("id")

    def get_flowchart(self, name: str) -> DataFrame:
        paths = F.broadcast(self.find(name).select("path").distinct())
        charts = flowcharts(self.files.join(paths, "path", "left_semi"))
        return charts.where((F.col("function") == name) | F.col("function").endswith("." + name) | (F.concat_ws("::", "path", "function") == name)).select("path", "function", F.inline("boxes"))

    def project_overview(self) -> DataFrame:
        counted = self.lines.where(F.trim("text") != "").groupBy("path").agg(F.count("*").alias("lines"))
        return report.overview(self.nodes, self.edges, self.files.select("path", "language").join(counted, "path"))

    def glossary(self, question: str) -> DataFrame:
        spark = self.files.sparkSession
        terms = spark.createDataFrame([(k, said) for k, (_, said) in report.GLOSSARY.items()], "term string, said string")
        return terms.where(F.array_contains(report.glossary_terms(F.lit(question)), F.col("term")))

    def find_construct(self, kind: str, within: str | None = None) -> DataFrame:
        found = report.constructs(self.lines).where(F.col("kind") == kind)
        spans = self.symbols.where("type IN ('function', 'method')").select("path", "id", F.col("start_line").alias("first"), F.col("end_line").alias("last"))
        placed = found.join(G.innermost(found.select("path", "line"), spans), ["path", "line"], "left")
        return (placed.join(F.broadcast(self.find(within).select("id")), "id", "left_semi") if within else placed).select("path", "line", "kind", "id").orderBy("path", "line")

    def impact(self, changed: DataFrame, depth: int = 3) -> tuple[DataFrame, DataFrame]:
        """changed hunks (path, new_start, new_len) -> (changed symbols, ripple of callers)."""
        at = changed.where("new_start IS NOT NULL").select("path", F.explode(F.when(F.col("new_len") > 0, F.sequence(F.col("new_start"), F.col("new_start") + F.col("new_len") - 1)).otherwise(F.array(F.greatest(F.col("new_start"), F.lit(1)), F.col("new_start") + 1))).alias("line")).distinct()
        spans = self.symbols.select("path", "id", F.col("start_line").alias("first"), F.col("end_line").alias("last"))
        hit = cut(G.innermost(at, spans).select("id").distinct())
        return hit, G.ripple(self.edges, hit, depth)

    def call(self, tool: str, **given) -> DataFrame | None:
        """A tool by name; None if there is none of that name."""
        known = ("search_code", "read_function", "read_file", "find_callers", "find_callees", "get_flowchart", "project_overview", "glossary", "find_construct")
        return getattr(self, tool)(**given) if tool in known else None
