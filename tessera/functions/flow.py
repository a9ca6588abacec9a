"""Control-flow charts of functions: boxes and edges, at most BUDGET boxes. Python is charted here, languages with braces in `braces`.

Simple statements are grouped three to a box; what can't be reached is left out; loops have back edges; break, continue, return and raise leave their
block. Each box is explained by a sentence made from its statement.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

from pyspark.sql import DataFrame

from tessera.session import ship

BUDGET, GROUP = 70, 3
CHARTS = "path string, function string, boxes array<struct<n:int,kind:string,label:string,first:int,last:int,said:string>>, edges array<struct<source:int,target:int,label:string>>"
_WORDS = {ast.Eq: "equals", ast.NotEq: "isn't", ast.Lt: "is less than", ast.LtE: "is at most", ast.Gt: "is more than", ast.GtE: "is at least", ast.Is: "is", ast.IsNot: "isn't", ast.In: "is in", ast.NotIn: "isn't in"}


def in_words(node: ast.expr) -> str:
    """A condition as words."""
    if isinstance(node, ast.BoolOp):
        return (" and " if isinstance(node.op, ast.And) else " or ").join(map(in_words, node.values))
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
        return f"not ({in_words(node.operand)})"
    if isinstance(node, ast.Compare) and len(node.ops) == 1:
        return f"{ast.unparse(node.left)} {_WORDS[type(node.ops[0])]} {ast.unparse(node.comparators[0])}"
    return ast.unparse(node)


def said(node: ast.stmt) -> str:
    """A simple statement as a sentence."""
    if isinstance(node, ast.AugAssign):
        verb = {ast.Add: "Add {} to {}", ast.Sub: "Take {} from {}", ast.Mult: "Multiply {1} by {0}", ast.Div: "Divide {1} by {0}"}.get(type(node.op), "Combine {} with {}")
        return verb.format(ast.unparse(node.value), ast.unparse(node.target)) + "."
    if isinstance(node, ast.Assign | ast.AnnAssign) and node.value is not None:
        targets = ", ".join(map(ast.unparse, node.targets)) if isinstance(node, ast.Assign) else ast.unparse(node.target)
        if isinstance(node.value, ast.Call) and getattr(node.value.func, "id", "") == "input":
            return f"Ask the user and keep the answer in {targets}."
        return f"Set {targets} to {ast.unparse(node.value)}."
    if isinstance(node, ast.Expr) and isinstance(node.value, ast.Call):
        name = ast.unparse(node.value.func)
        args = ", ".join(ast.unparse(a) for a in node.value.args)
        return f"Show {args or 'an empty line'}." if name == "print" else f"Run {name}()" + (f" with {args}." if args else ".")
    return f"Do: {ast.unparse(node)}"[:160]


class Chart:
    def __init__(self, function: ast.FunctionDef | ast.AsyncFunctionDef):
        self.boxes: list[dict] = []
        self.edges: list[dict] = []
        self.loops: list[tuple[int, list]] = []
        start = self.box("start", function.name, function, f"{function.name} begins.")
        self.ends: list[tuple[int, str]] = []
        out = self.block(function.body, [(start, "")])
        self.end = self.box("end", "end", function, f"{function.name} is done.", function.end_lineno)
        self.join(out + self.ends, self.end)

    def full(self) -> bool:
        return len(self.boxes) >= BUDGET - 1

    def box(self, kind: str, label: str, node, sentence: str, first: int | None = None, last: int | None = None) -> int:
        first = first or node.lineno
        self.boxes.append(dict(n=len(self.boxes), kind=kind, label=label[:120], first=first, last=last or (first if kind in ("start", "decision", "loop", "switch") else node.end_lineno), said=sentence))
        return len(self.boxes) - 1

    def join(self, ways: list[tuple[int, str]], target: int) -> None:
        for source, label in ways:
            self.edges.append(dict(source=source, target=target, label=label))

    def block(self, body: list[ast.stmt], ways: list) -> list:
        """Adds a block that begins after `ways`; the ways out of it."""
        group: list[ast.stmt] = []

        def flush(ways):
            if not group:
                return ways
            n = self.box("action", "\n".join(ast.unparse(g) for g in group), group[0], " ".join(map(said, group)), group[0].lineno, group[-1].end_lineno)
            self.join(ways, n)
            group.clear()
            return [(n, "")]

        for node in body:
            if not ways:
                break  # what follows can't be reached
            if self.full():
                ways = flush(ways)
                n = self.box("folded", "...", node, "The rest of this part isn't drawn.", node.lineno, body[-1].end_lineno)
                self.join(ways, n)
                return [(n, "")]
            if isinstance(node, ast.If | ast.While | ast.For | ast.AsyncFor | ast.Try | ast.With | ast.AsyncWith | ast.Match | ast.Return | ast.Raise | ast.Break | ast.Continue):
                ways = self.compound(node, flush(ways))
            elif not (isinstance(node, ast.Pass | ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) or isinstance(node, ast.Expr) and isinstance(node.value, ast.Constant)):
                group.append(node)
                if len(group) == GROUP:
                    ways = flush(ways)
        return flush(ways)

    def compound(self, node: ast.stmt, ways: list) -> list:
        if isinstance(node, ast.If):
            n = self.box("decision", ast.unparse(node.test) + "?", node, f"Is it so that {in_words(node.test)}?")
            self.join(ways, n)
            return self.block(node.body, [(n, "yes")]) + (self.block(node.orelse, [(n, "no")]) if node.orelse else [(n, "no")])
        if isinstance(node, ast.While | ast.For | ast.AsyncFor):
            forever = isinstance(node, ast.While) and isinstance(node.test, ast.Constant) and bool(node.test.value)
            each = not isinstance(node, ast.While)
            label = f"next {ast.unparse(node.target)} in {ast.unparse(node.iter)}?" if each else "repeat forever" if forever else ast.unparse(node.test) + "?"
            sentence = "Repeat until something leaves the loop." if forever else f"For each {ast.unparse(node.target)} in {ast.unparse(node.iter)}, repeat." if each else f"Repeat while {in_words(node.test)}."
            out = "no more" if each else "no"
            n = self.box("loop", label, node, sentence)
            self.join(ways, n)
            self.loops.append((n, []))
            self.join(self.block(node.body, [(n, "" if forever else "yes")]), n)
            _, left = self.loops.pop()
            return left + ([] if forever else self.block(node.orelse, [(n, out)]) if node.orelse else [(n, out)])
        if isinstance(node, ast.Match):
            n = self.box("switch", f"which {ast.unparse(node.subject)}?", node, f"Which case is {ast.unparse(node.subject)}?")
            self.join(ways, n)
            out, rest = [], True
            for case in node.cases:
                label = ast.unparse(case.pattern)
                rest = rest and not (label == "_" and case.guard is None)
                out += self.block(case.body, [(n, "other" if label == "_" else label)])
            return out + ([(n, "other")] if rest else [])
        if isinstance(node, ast.Try):
            n = self.box("try", "try", node, "Try what follows; an error leads to its own steps.", node.lineno, node.lineno)
            self.join(ways, n)
            out = self.block(node.body, [(n, "")])
            caught = []
            for h in node.handlers:
                caught += self.block(h.body, [(n, "if error")])
            out = self.block(node.orelse, out) + caught if node.orelse else out + caught
            return self.block(node.finalbody, out) if node.finalbody else out
        if isinstance(node, ast.With | ast.AsyncWith):
            n = self.box("action", "with " + ", ".join(ast.unparse(i) for i in node.items), node, "Open " + ", ".join(ast.unparse(i.context_expr) for i in node.items) + " for what follows.", node.lineno, node.lineno)
            self.join(ways, n)
            return self.block(node.body, [(n, "")])
        if isinstance(node, ast.Break | ast.Continue):
            if self.loops:
                if isinstance(node, ast.Break):
                    self.loops[-1][1].extend(ways)
                else:
                    self.join(ways, self.loops[-1][0])
            return []
        back = isinstance(node, ast.Return)
        value = node.value if back else node.exc
        n = self.box("return" if back else "stop", ast.unparse(node), node, (f"Give back {ast.unparse(value)}." if value is not None else "Stop here.") if back else f"Stop with {ast.unparse(value) if value is not None else 'the error'}.")
        self.join(ways, n)
        self.ends.append((n, "" if back else "error"))
        return []

    def mermaid(self) -> str:
        """The chart as Mermaid text."""
        clean = lambda t: t.replace('"', "'").replace("\n", " ")
        shapes = {"start": "([{}])", "end": "([{}])", "decision": "{{{}}}", "switch": "{{{}}}", "loop": "{{{{{}}}}}", "return": "([{}])", "stop": "([{}])"}
        out = ["flowchart TD"] + [f"  n{b['n']}" + shapes.get(b["kind"], "[{}]").format(f'"{clean(b["label"])}"') for b in self.boxes]
        return "\n".join(out + [f"  n{e['source']} -->" + (f"|{clean(e['label'])}|" if e["label"] else "") + f" n{e['target']}" for e in self.edges])


def charts_of(text: str) -> Iterator[tuple[str, Chart]]:
    """(qualified name, chart) of every function of a text that parses."""

    def walk(body, above):
        for node in body:
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                yield ".".join([*above, node.name]), Chart(node)
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                yield from walk(node.body, [*above, node.name])

    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    yield from walk(tree.body, [])


def _charts(text: str, language: str) -> list[dict]:
    from tessera.functions.braces import brace_charts

    return [dict(function=name, boxes=c.boxes, edges=c.edges) for name, c in (charts_of(text) if language == "python" else brace_charts(text, language))]


#: Bytes of texts whose charts a task keeps, and files that become rows at once.
KEPT, SLICE = 16_000_000, 1024


def flowcharts(files: DataFrame) -> DataFrame:
    """files (path, language, content) -> CHARTS, one row a function of Python, JavaScript, TypeScript, Java or C.

    Copies of a text are charted once a task while it's kept. Rows are made some files at a time, so memory doesn't grow with a batch.
    """
    ship(files.sparkSession)
    schema = files.sparkSession.createDataFrame([], CHARTS).schema

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        inner = pa.schema([f for f in arrow if f.name != "path"])
        known: dict[tuple[str, bytes], list[dict]] = {}
        held = 0
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                at: dict[tuple[str, bytes], range] = {}  # rows of this slice's distinct texts
                rows, paths, take = [], [], []
                for path, language, data in zip(*(part.column(x).to_pylist() for x in ("path", "language", "content")), strict=True):
                    key = (language, data or b"")
                    if key not in at:
                        if key not in known:
                            if held > KEPT:
                                known.clear()
                                held = 0
                            known[key] = _charts(key[1].decode("utf-8", errors="replace").replace("\r\n", "\n"), language)
                            held += len(key[1])
                        at[key] = range(len(rows), len(rows) + len(known[key]))
                        rows += known[key]
                    take += at[key]
                    paths += [path] * len(at[key])
                made = pa.Table.from_pylist(rows, inner).combine_chunks().take(pa.array(take, pa.int64())).add_column(0, arrow.field("path"), pa.array(paths, pa.string()))
                yield from made.to_batches()

    return files.where("language IN ('python', 'javascript', 'typescript', 'java', 'c')").select("path", "language", "content").mapInArrow(run, schema)
