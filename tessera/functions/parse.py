"""Source text to facts: definitions, imports, bindings and calls of one file.

Python is read by its own grammar; a file that it refuses is cut back to what still parses, with an error flag. JavaScript, TypeScript, Java and C share a
tokenizer and a reader of braces and parentheses that needs no correct file.
"""

from __future__ import annotations

import ast
import inspect
import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import ship

FACTS = (
    "path string, language string, doc string, has_errors boolean, "
    "definitions array<struct<pos:int,id:string,name:string,kind:string,parent:string,start_line:int,end_line:int,signature:string,doc:string>>, "
    "imports array<struct<pos:int,source:string,line:int>>, bindings array<struct<pos:int,local:string,source:string,imported:string>>, "
    "calls array<struct<pos:int,caller:string,name:string,receiver:string,receiver_type:string,line:int>>"
)


class Facts:
    def __init__(self, path: str, language: str):
        self.path, self.language, self.doc, self.errors = path, language, "", False
        self.definitions: list[dict] = []
        self.imports: list[dict] = []
        self.bindings: list[dict] = []
        self.calls: list[dict] = []
        self.seen: dict[str, int] = {}

    def define(self, name: str, kind: str, parent: dict | None, start: int, end: int, signature: str, doc: str = "") -> dict:
        base = f"{parent['id'].split('::', 1)[1].split('#')[0]}.{name}" if parent else name
        n = self.seen[base] = self.seen.get(base, 0) + 1
        signature = signature.strip()
        d = dict(pos=len(self.definitions), id=f"{self.path}::{base}" + (f"#{n}" if n > 1 else ""), name=name, kind=kind, parent=parent["id"] if parent else None, start_line=start, end_line=end, signature=signature if len(signature) <= 200 else signature[:199] + "…", doc=doc[:1000])
        self.definitions.append(d)
        return d

    def imported(self, source: str, line: int, *names: tuple[str, str]) -> None:
        self.imports.append(dict(pos=len(self.imports), source=source, line=line))
        for local, what in names:
            self.bindings.append(dict(pos=len(self.bindings), local=local, source=source, imported=what))

    def called(self, caller: dict | None, name: str, receiver: str | None, line: int, receiver_type: str | None = None) -> None:
        self.calls.append(dict(pos=len(self.calls), caller=caller["id"] if caller else self.path, name=name, receiver=receiver, receiver_type=receiver_type, line=line))

    def row(self) -> dict:
        return dict(path=self.path, language=self.language, doc=self.doc, has_errors=self.errors, definitions=self.definitions, imports=self.imports, bindings=self.bindings, calls=self.calls)


def _receiver(node: ast.expr) -> str:
    """A dotted name, or ? for anything else."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else "?"


class _Python(ast.NodeVisitor):
    def __init__(self, facts: Facts, lines: list[str]):
        self.facts, self.lines, self.scopes = facts, lines, []

    def _define(self, node, kind: str) -> None:
        if any(getattr(d, "id", getattr(d, "attr", "")) == "overload" for d in node.decorator_list):
            return
        parent = self.scopes[-1] if self.scopes else None
        for outer in [*node.decorator_list, *(node.args.defaults + [d for d in node.args.kw_defaults if d] if kind != "class" else node.bases + [k.value for k in node.keywords])]:
            self.visit(outer)  # these run in the scope around it
        start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        made = self.facts.define(node.name, "method" if kind == "function" and parent and parent["kind"] == "class" else kind, parent, start, node.end_lineno, self.lines[node.lineno - 1], (ast.get_docstring(node) or "").strip())
        self.scopes.append(made)
        for child in node.body:
            self.visit(child)
        self.scopes.pop()

    def visit_FunctionDef(self, node):
        self._define(node, "function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node):
        self._define(node, "class")

    def visit_Import(self, node):
        for a in node.names:
            local = a.asname or (a.name if "." not in a.name else None)
            self.facts.imported(a.name, node.lineno, *([(local, "*")] if local else []))

    def visit_ImportFrom(self, node):
        names = [("*", "*") if a.name == "*" else (a.asname or a.name, a.name) for a in node.names]
        self.facts.imported("." * node.level + (node.module or ""), node.lineno, *names)

    def visit_Call(self, node):
        caller = self.scopes[-1] if self.scopes else None
        if isinstance(node.func, ast.Name):
            self.facts.called(caller, node.func.id, None, node.lineno)
        elif isinstance(node.func, ast.Attribute):
            self.facts.called(caller, node.func.attr, _receiver(node.func.value), node.lineno)
        self.generic_visit(node)


def _python(facts: Facts, text: str) -> None:
    lines = text.split("\n")
    tree = None
    for _ in range(len(lines) + 1):
        try:
            tree = ast.parse("\n".join(lines))
            break
        except SyntaxError as e:
            # the block of the refused line is blanked: it, and what is indented deeper below
            facts.errors = True
            at = min(max((e.lineno or 1) - 1, 0), len(lines) - 1)
            while at > 0 and not lines[at].strip():
                at -= 1
            if not lines[at].strip():
                break
            depth, k = len(lines[at]) - len(lines[at].lstrip()), at
            lines[at] = ""
            while k + 1 < len(lines) and (not lines[k + 1].strip() or len(lines[k + 1]) - len(lines[k + 1].lstrip()) > depth):
                k += 1
                lines[k] = ""
        except (ValueError, RecursionError):
            facts.errors = True
            break
    if tree is not None:
        facts.doc = (ast.get_docstring(tree) or "").strip()[:1000]
        _Python(facts, lines).visit(tree)


class Token(NamedTuple):
    kind: str  # name, text, mark
    text: str
    line: int
    at: int


_TOKEN = re.compile(r"""(?P<doc>/\*.*?(?:\*/|\Z))|(?P<note>//[^\n]*)|(?P<text>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?)|(?P<name>[A-Za-z_$@][\w$]*)|(?P<number>\d[\w.]*)|(?P<line>\n)|(?P<mark>=>|->|::|\.\.\.|[^\s\w])""", re.S)
_CONTROL = frozenset("if for while switch catch return else do new throw typeof sizeof function super await yield case in of instanceof delete void synchronized assert import".split())
_TYPES = {"class": "class", "interface": "interface", "@interface": "interface", "enum": "enum", "record": "record", "struct": "record"}


def _tokens(text: str) -> tuple[list[Token], dict[int, str]]:
    """Tokens, and block comments by the line on which they end."""
    out, docs, line = [], {}, 1
    for m in _TOKEN.finditer(text):
        kind, said = m.lastgroup, m.group()
        if kind == "doc":
            docs[line + said.count("\n")] = inspect.cleandoc("\n".join(re.sub(r"^\s*\*? ?", "", x) for x in re.sub(r"^/\*+|\*+/$", "", said).split("\n"))).strip()
        elif kind in ("name", "text", "mark"):
            out.append(Token(kind, said, line, m.start()))
        line += said.count("\n")
    return out, docs


def _matching(tokens: list[Token]) -> dict[int, int]:
    """Where each opening bracket is closed; unclosed ones at the end."""
    out, held = {}, []
    for i, t in enumerate(tokens):
        if t.kind == "mark" and t.text in "({[":
            held.append(i)
        elif t.kind == "mark" and t.text in ")}]":
            while held and tokens[held[-1]].text != {")": "(", "}": "{", "]": "["}[t.text]:
                out[held.pop()] = i
            if held:
                out[held.pop()] = i
    return out | {i: len(tokens) - 1 for i in held}


class _Braces:
    """Definitions, calls and imports of a brace language."""

    def __init__(self, facts: Facts, text: str):
        self.facts, self.lines = facts, text.split("\n")
        self.tokens, self.docs = _tokens(text)
        self.match = _matching(self.tokens)
        self.ends: list[tuple[int, dict]] = []  # scopes: closing token, definition
        self.java, self.c = facts.language == "java", facts.language == "c"
        self.types: dict[str, str] = {}

    def at(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def scope(self) -> dict | None:
        return self.ends[-1][1] if self.ends else None

    def open(self, name: str, kind: str, first: int, body: int | None, end: int) -> None:
        line, last = self.tokens[first].line, self.tokens[min(end, len(self.tokens) - 1)].line
        made = self.facts.define(name, kind, self.scope(), line, last, self.lines[line - 1], self.docs.get(line - 1, ""))
        if body is not None:
            self.ends.append((end, made))

    def body_after(self, i: int) -> int | None:
        """The brace that opens a body after a parameter list closed at i: past types and throws, before any end of statement."""
        for k in range(i + 1, min(i + 40, len(self.tokens))):
            t = self.at(k)
            if t == "{":
                return k
            if t in (";", "}", "=", ")", "=>") or t == "(":
                return None
        return None

    def statement(self, i: int) -> int:
        """The first token of the statement that holds token i."""
        k = i
        while k > 0 and self.at(k - 1) not in (";", "{", "}"):
            k -= 1
        while self.at(k).startswith("@") and self.at(k) != "@interface" and k < i:
            k = self.match.get(k + 1, k) + 1 if self.at(k + 1) == "(" else k + 1
        while self.c and self.at(k) == "#" and k < i:  # preprocessor lines before
            line = self.tokens[k].line
            while k < i and self.tokens[k].line == line:
                k += 1
        return k

    def run(self) -> None:
        i = 0
        while i < len(self.tokens):
            while self.ends and i > self.ends[-1][0]:
                self.ends.pop()
            i = self.step(i)

    def step(self, i: int) -> int:
        t, nxt, prev = self.tokens[i], self.at(i + 1), self.at(i - 1)
        if t.kind != "name":
            if self.c and t.text == "#" and nxt == "include" and self.at(i + 2).startswith('"'):
                self.facts.imported(self.at(i + 2).strip('"'), t.line, ("*", "*"))
            return i + 1
        if t.text in _TYPES and prev not in (".", "->") and (t.text != "record" or nxt[:1].isupper()) and not (self.c and t.text in ("class", "record", "interface")):
            return self.type(i)
        if t.text == "import" and not self.c:
            return self.java_import(i) if self.java else self.js_import(i)
        if t.text == "export" and not self.java and not self.c:
            return self.js_export(i)
        inside = self.scope()
        if t.text == "function" and not self.java and not self.c:
            k = i + 1 + (nxt == "*")
            name = self.at(k) if self.tokens[k].kind == "name" else self.assigned(i) or ("default" if prev == "default" else "")
            p = k + (self.at(k) != "(")
            body = self.body_after(self.match.get(p, p))
            if name and body is not None:
                self.open(name, "function", self.statement(i), body, self.match[body])
                return body + 1
            return p + 1
        if not self.c and not self.java and nxt == "=" and (arrow := self.arrow(i + 2)):
            inside_class = inside and inside["kind"] == "class" and self.ends[-1][0] == self.around(i)
            if inside_class or self.at(i - 1) in ("const", "let", "var"):
                self.open(t.text, "method" if inside_class else "function", self.statement(i), arrow[0], arrow[1])
                return arrow[0]
        if nxt == "(" and t.text not in _CONTROL:
            close = self.match[i + 1]
            body = self.body_after(close)
            member = inside is not None and inside["kind"] in ("class", "interface", "enum", "record") and self.around(i) == self.ends[-1][0]
            if self.java and member and prev != "." and prev != "new" and (body is not None or self.at(close + 1) in (";", "throws")) and self.at(i - 1) not in ("=", "(", ",", "return"):
                end = self.match[body] if body is not None else close + 1
                self.open(t.text, "method", self.statement(i), body, end)
                return body + 1 if body is not None else close + 1
            if not self.java and not self.c and member and body is not None and prev != "." and self.at(i - 1) != "new":
                self.open(t.text, "method", self.statement(i), body, self.match[body])
                return body + 1
            if self.c and inside is None and body is not None and body == close + 1 and i > 0:
                self.open(t.text, "function", self.statement(i), body, self.match[body])
                return body + 1
            if not (self.c and inside is None):
                self.call(i)
        elif t.text == "new" and self.tokens[min(i + 1, len(self.tokens) - 1)].kind == "name":
            k = i + 1
            while self.at(k + 1) == "." and k + 2 < len(self.tokens):
                k += 2
            self.facts.called(inside, self.at(k), None, t.line)
            return k + 1
        elif self.java and t.text[:1].isupper() and i + 1 < len(self.tokens) and self.tokens[i + 1].kind == "name" and self.at(i + 2) in ("=", ";", ")", ",", ":"):
            self.types[nxt] = t.text
        if not self.java and not self.c and t.text == "require" and nxt == "(" and self.at(i + 2)[:1] in "'\"":
            names = self.required(i)
            self.facts.imported(self.at(i + 2).strip("'\""), t.line, *names)
        return i + 1

    def around(self, i: int) -> int:
        """The closing token of the innermost brace around token i."""
        return min((c for o, c in self.match.items() if o < i <= c and self.at(o) == "{"), default=-1)

    def assigned(self, i: int) -> str:
        k = i - 1
        if self.at(k) == "async":
            k -= 1
        return self.at(k - 1) if self.at(k) == "=" else ""

    def arrow(self, k: int) -> tuple[int, int] | None:
        """Body and end of an arrow function that begins at token k."""
        k += self.at(k) == "async"
        close = self.match[k] if self.at(k) == "(" else k
        for j in range(close + 1, min(close + 12, len(self.tokens))):
            if self.at(j) == "=>":
                if self.at(j + 1) == "{":
                    return j + 1, self.match[j + 1]
                end = j + 1
                while end < len(self.tokens) and self.at(end) not in (";", "}") and self.tokens[end].line == self.tokens[j + 1].line:
                    end = self.match.get(end, end) + 1
                return j + 1, end - 1
            if self.at(j) not in (":", "<", ">", "[", "]", "|") and self.tokens[j].kind != "name":
                return None
        return None

    def required(self, i: int) -> list[tuple[str, str]]:
        if self.at(i - 1) != "=":
            return []
        if self.at(i - 2) == "}":
            k = i - 3
            names = []
            while k > 0 and self.at(k) != "{":
                if self.tokens[k].kind == "name":
                    names.append((self.at(k), self.at(k - 2) if self.at(k - 1) == ":" else self.at(k)))
                    k -= 2 if self.at(k - 1) == ":" else 0
                k -= 1
            return names[::-1]
        return [(self.at(i - 2), "*")]

    def type(self, i: int) -> int:
        kind, name = _TYPES[self.at(i)], self.at(i + 1)
        k = i + 1
        while k < len(self.tokens) and self.at(k) not in ("{", ";", ")", "="):
            k = self.match.get(k, k) + 1 if self.at(k) == "(" else k + 1
        if self.at(k) != "{":
            return i + 1
        end = self.match[k]
        if name == "{" or not name:  # typedef struct { ... } Name, or a nameless class
            name = self.at(end + 1) if self.c else self.assigned(i) or ("default" if self.at(i - 1) == "default" else "")
        if self.c and self.tokens[min(end + 1, len(self.tokens) - 1)].kind == "name" and self.at(i - 1) == "typedef":
            name = self.at(end + 1)
        if not name or self.tokens[i + 1].kind != "name" and self.at(i + 1) != "{":
            return i + 1
        self.open(name, kind, self.statement(i), k, end)
        return k + 1

    def call(self, i: int) -> None:
        name, receiver, k = self.at(i), None, i - 1
        if self.at(k) in (".", "->"):
            parts = []
            while self.at(k) in (".", "->") and k > 0:
                if self.tokens[k - 1].kind != "name":
                    parts = ["?"]
                    break
                parts.insert(0, self.at(k - 1))
                k -= 2
            receiver = ".".join(parts)
        declared = self.types.get(receiver.removeprefix("this.")) if self.java and receiver else None
        self.facts.called(self.scope(), name, receiver, self.tokens[i].line, declared)

    def java_import(self, i: int) -> int:
        k = i + 1 + (self.at(i + 1) == "static")
        parts = []
        while k < len(self.tokens) and self.at(k) != ";":
            parts.append(self.at(k))
            k += 1
        source = "".join(parts)
        last = source.rpartition(".")[2]
        names = [("*", "*")] if last == "*" else [(last, last if self.at(i + 1) == "static" else "*")]
        self.facts.imported(source, self.tokens[i].line, *names)
        return k

    def js_names(self, i: int) -> tuple[int, list[tuple[str, str]], str | None]:
        """From token i: the end, names bound, and the module."""
        names, k = [], i
        while k < len(self.tokens) and self.at(k) != ";" and self.tokens[k].kind != "text":
            t = self.tokens[k]
            if t.text == "*" and self.at(k + 1) == "as":
                names.append((self.at(k + 2), "*"))
                k += 2
            elif t.kind == "name" and t.text not in ("from", "type", "as"):
                if self.at(k + 1) == "as":
                    names.append((self.at(k + 2), t.text))
                    k += 2
                else:
                    inner = any(o < k < c for o, c in self.match.items() if self.at(o) == "{" and o >= i)
                    names.append((t.text, t.text if inner else "default"))
            elif t.text == "(":
                return k, [], None
            k += 1
        return k, names, self.at(k).strip("'\"`") if k < len(self.tokens) and self.tokens[k].kind == "text" else None

    def js_import(self, i: int) -> int:
        k, names, source = self.js_names(i + 1)
        if source:
            self.facts.imported(source, self.tokens[i].line, *names)
            return k + 1
        return i + 1

    def js_export(self, i: int) -> int:
        if self.at(i + 1) in ("{", "*"):
            close = self.match.get(i + 1, i + 1)
            for k in range(close, min(close + 5, len(self.tokens))):
                if self.at(k) == "from":
                    self.facts.imported(self.at(k + 1).strip("'\""), self.tokens[i].line)
                    return k + 2
            return close + 1
        return i + 1


def parse(path: str, language: str, content: bytes | None) -> dict:
    """The facts of one file, as a row of FACTS."""
    facts = Facts(path, language)
    text = (content or b"").decode("utf-8", errors="replace").replace("\r\n", "\n")
    if language == "python":
        _python(facts, text)
    elif language in ("javascript", "typescript", "java", "c"):
        reader = _Braces(facts, text)
        facts.errors = sum(t.text == "{" for t in reader.tokens) != sum(t.text == "}" for t in reader.tokens)
        facts.doc = next((d for line, d in sorted(reader.docs.items()) if line <= 12), "")[:1000]
        reader.run()
    return facts.row()


def parse_files(files: DataFrame) -> DataFrame:
    """files (path, language, content) -> FACTS, one row a file."""
    ship(files.sparkSession)
    schema = files.sparkSession.createDataFrame([], FACTS).schema

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            found = [parse(p, lang, c) for p, lang, c in zip(*(batch.column(c).to_pylist() for c in ("path", "language", "content")), strict=True)]
            yield from pa.Table.from_pylist(found, arrow).to_batches()

    return files.select("path", "language", "content").mapInArrow(run, schema)


def table_of(facts: DataFrame, name: str) -> DataFrame:
    """One of the fact tables: definitions, imports, bindings, calls, with the file's path."""
    return facts.select("path", "language", F.inline(name))
