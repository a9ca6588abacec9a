"""Control-flow charts of functions in JavaScript, TypeScript, Java and C, from tokens and matched brackets; no correct file is needed.

A body is read into statements first, then laid out as boxes and edges. Where a language lets statements end without a semicolon, a line end ends one
unless the signs around it go on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from tessera.functions.flow import GROUP, Chart
from tessera.functions.parse import _TOKEN, Facts, Token, _Braces, _matching

_JUMPS = ("return", "throw", "break", "continue")
_NESTED = ("function", "class", "interface", "enum", "record")
_GOES_ON = frozenset(", . + - * / = ( [ { & | ? : => < > ! % ^ ~ :: ->".split())
_GOES_ON_BEFORE = frozenset(", . + * / = ? : & | < > ) ] } % ^ => :: -> instanceof in of".split())
_COMPARE = ((r"\s*&&\s*", " and "), (r"\s*\|\|\s*", " or "), (r"\s*!==?\s*", " isn't "), (r"\s*===?\s*", " equals "), (r"\s*<=\s*", " is at most "), (r"\s*>=\s*", " is at least "), (r"\s+<\s+", " is less than "), (r"\s+>\s+", " is more than "), (r"!(?=[\w(])", "not "))
_SHOW = ("printf", "puts", "console.log", "System.out.println", "System.out.print")


def condition_in_words(text: str) -> str:
    for sign, words in _COMPARE:
        text = re.sub(sign, words, text)
    return text


def statement_in_words(text: str) -> str:
    """A simple statement as a sentence: a step by one, a compound assignment, an assignment, a call; else as it stands."""
    flat = " ".join(text.split()).rstrip(";").strip()
    if m := re.fullmatch(r"(?:(\+\+|--)\s*([\w.\[\]]+)|([\w.\[\]]+)\s*(\+\+|--))", flat):
        return f"Add 1 to {m[2] or m[3]}." if "+" in (m[1] or m[4]) else f"Take 1 from {m[2] or m[3]}."
    if m := re.fullmatch(r"([\w.\[\]]+)\s*([-+*/])=\s*(.+)", flat):
        return {"+": "Add {1} to {0}.", "-": "Take {1} from {0}.", "*": "Multiply {0} by {1}.", "/": "Divide {0} by {1}."}[m[2]].format(m[1], m[3])
    if m := re.fullmatch(r"(?:[\w<>\[\], .*:]*[\s*])?([\w.\[\]]+)(?:\s*:\s*[\w<>\[\]]+)?\s*=(?![=>])\s*(.+)", flat):
        return f"Set {m[1]} to {m[2]}."
    if m := re.fullmatch(r"(?:await\s+)?([\w.]+)\s*\((.*)\)", flat):
        return f"Show {m[2] or 'an empty line'}." if m[1] in _SHOW else f"Run {m[1]}()" + (f" with {m[2]}." if m[2] else ".")
    return f"Do: {flat}"[:160]


class _Statements:
    """Statements of token ranges, as tuples that begin with their kind and first token."""

    def __init__(self, text: str, language: str):
        self.text, self.script = text, language in ("javascript", "typescript")
        self.tokens, line = [], 1
        for m in _TOKEN.finditer(text):
            if m.lastgroup not in ("doc", "note", "line"):
                self.tokens.append(Token(m.lastgroup, m.group(), line, m.start()))
            line += m.group().count("\n")
        self.match = _matching(self.tokens)
        self.at = {t.at: i for i, t in enumerate(self.tokens)}

    def said(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def slice(self, a: int, b: int) -> str:
        """The text of tokens a to b, b not included, in one line."""
        if a >= b:
            return ""
        last = self.tokens[b - 1]
        return " ".join(self.text[self.tokens[a].at : last.at + len(last.text)].split())

    def closing(self, i: int) -> int:
        return self.match.get(i, i)

    def find(self, a: int, b: int, *signs: str) -> int:
        """The first of the signs outside brackets, or b."""
        while a < b and self.said(a) not in signs:
            a = self.closing(a) + 1
        return min(a, b)

    def simple_end(self, i: int, end: int) -> int:
        k = i
        while k < end:
            word = self.said(k)
            if word == ";":
                return k + 1
            if k > i and self.script and self.tokens[k].line > self.tokens[k - 1].line and self.said(k - 1) not in _GOES_ON and word not in _GOES_ON_BEFORE:
                return k
            after = self.closing(k) + 1
            if word == "{" and self.said(i) in _NESTED:
                return min(after, end)
            k = after
        return end

    def block(self, i: int, end: int) -> list[tuple]:
        out = []
        while i < end:
            got, i = self.statement(i, end)
            out += got
        return out

    def body(self, i: int, end: int) -> tuple[list[tuple], int]:
        """A block's statements, or the one statement, and what follows."""
        return self.statement(i, end) if i < end else ([], end)

    def expression_end(self, i: int) -> int:
        """The last token of an expression that begins at i, up to a sign or line end that ends it."""
        k = i
        while k < len(self.tokens) and self.said(k) not in (";", ",", ")", "]", "}"):
            if k > i and self.tokens[k].line > self.tokens[k - 1].line and self.said(k - 1) not in _GOES_ON and self.said(k) not in _GOES_ON_BEFORE:
                break
            k = self.closing(k) + 1
        return min(max(k - 1, i), len(self.tokens) - 1)

    def statement(self, i: int, end: int) -> tuple[list[tuple], int]:
        word, nxt = self.said(i), self.said(i + 1)
        if word == "{":
            close = self.closing(i)
            return self.block(i + 1, min(close, end)), close + 1
        if word == ";":
            return [], i + 1
        if self.tokens[i].kind == "name" and nxt == ":" and word != "default":
            return self.statement(i + 2, end) if i + 2 < end else ([], end)  # a label
        if word == "synchronized" and nxt == "(":
            return self.body(self.closing(i + 1) + 1, end)
        head = i + 1 + (word == "for" and nxt == "await")
        if word in ("if", "while", "for", "switch") and self.said(head) == "(":
            close = self.closing(head)
            if word == "switch":
                open_ = close + 1
                return [("switch", i, (head + 1, close), self.cases(open_ + 1, self.closing(open_)))], self.closing(open_) + 1
            inner, k = self.body(close + 1, end) if close + 1 < end else ([], end)
            if word == "while":
                return [("while", i, (head + 1, close), inner)], k
            if word == "for":
                return [self.loop(i, head + 1, close, inner)], k
            other = None
            if self.said(k) == "else" and k < end:
                other, k = self.body(k + 1, end) if k + 1 < end else ([], end)
            return [("if", i, (head + 1, close), inner, other)], k
        if word == "do" and i + 1 < end:
            inner, k = self.body(i + 1, end)
            if self.said(k) == "while" and self.said(k + 1) == "(":
                close = self.closing(k + 1)
                return [("do", k, (k + 2, close), inner)], close + 1 + (self.said(close + 1) == ";")
            return inner, k
        if word == "try":
            k = self.closing(i + 1) + 1 if nxt == "(" else i + 1
            inner, k = self.body(k, end)
            caught, final = [], None
            while self.said(k) == "catch" and k < end:
                own, k = self.body(self.closing(k + 1) + 1 if self.said(k + 1) == "(" else k + 1, end)
                caught.append(own)
            if self.said(k) == "finally" and k < end:
                final, k = self.body(k + 1, end)
            return [("try", i, inner, caught, final)], k
        k = max(self.simple_end(i, end), i + 1)
        return [(word if word in _JUMPS else "simple", i, k)], k

    def loop(self, i: int, a: int, b: int, inner: list[tuple]) -> tuple:
        first = self.find(a, b, ";")
        if first < b:
            second = self.find(first + 1, b, ";")
            return ("for", i, (a, first), (first + 1, second), (second + 1, b), inner)
        cut = self.find(a, b, "of", "in") if self.script else self.find(a, b, ":")
        names = [k for k in range(a, cut) if self.said(k) not in ("const", "let", "var", "final")]
        start = (names[0] if self.script else names[-1]) if names else cut
        return ("each", i, (start, cut), (cut + 1, b), inner)

    def cases(self, i: int, end: int) -> list[tuple[str, list[tuple], bool]]:
        """(label, statements, whether it runs into the next) in order."""
        out = []
        while i < end:
            if self.said(i) not in ("case", "default"):
                i += 1
                continue
            colon = self.find(i + 1, end, ":", "->")
            label = self.slice(i + 1, colon) if self.said(i) == "case" else "default"
            falls, i, own = self.said(colon) == ":", colon + 1, []
            if falls:
                while i < end and self.said(i) not in ("case", "default"):
                    got, i = self.statement(i, end)
                    own += got
            elif i < end:
                own, i = self.statement(i, end)
            out.append((label, own, falls))
        return out


class BraceChart(Chart):
    """The chart of one function: its name, the names of its parameters, and its body's tokens from `body` to `end`."""

    def __init__(self, source: _Statements, name: str, names: list[str], first: int, body: int, end: int):
        self.source, self.boxes, self.edges = source, [], []
        self.held: list[tuple[list, list | None]] = []  # ways out by break, ways back by continue (None in a switch)
        self.ends: list[tuple[int, str]] = []
        start = self.box("start", f"start: {name}({', '.join(names)})", None, f"{name} begins.", first, max(first, source.tokens[body].line))
        if source.said(body) == "{":
            out = self.seq(source.block(body + 1, end), [(start, "")])
        else:
            value = source.slice(body, end + 1)
            n = self.box("return", f"return {value}", None, f"Give back {value}.", source.tokens[body].line, source.tokens[end].line)
            self.join([(start, "")], n)
            out = [(n, "")]
        last = source.tokens[min(end, len(source.tokens) - 1)].line
        self.end = self.box("end", "end", None, f"{name} is done.", last, last)
        self.join(out + self.ends, self.end)

    def lines(self, a: int, b: int) -> tuple[int, int]:
        return self.source.tokens[a].line, self.source.tokens[max(a, b - 1)].line

    def header(self, kind: str, label: str, at: int, sentence: str, ways: list) -> int:
        line = self.source.tokens[at].line
        n = self.box(kind, label, None, sentence, line, line)
        self.join(ways, n)
        return n

    def action(self, spans: list[tuple[int, int]], ways: list) -> list:
        texts = [self.source.slice(a, b) for a, b in spans]
        n = self.box("action", "\n".join(texts), None, " ".join(map(statement_in_words, texts)), self.lines(*spans[0])[0], self.lines(*spans[-1])[1])
        self.join(ways, n)
        return [(n, "")]

    def seq(self, nodes: list[tuple], ways: list) -> list:
        i = 0
        while i < len(nodes) and ways:  # what follows a jump can't be reached
            node = nodes[i]
            if self.full():
                first, last = self.source.tokens[node[1]].line, self.source.tokens[nodes[-1][1]].line
                n = self.box("folded", "...", None, "The rest of this part isn't drawn.", first, last)
                self.join(ways, n)
                return [(n, "")]
            if node[0] == "simple":
                group = [node]
                while i + 1 < len(nodes) and len(group) < GROUP and nodes[i + 1][0] == "simple":
                    i += 1
                    group.append(nodes[i])
                ways = self.action([(a, b) for _, a, b in group], ways)
            else:
                ways = getattr(self, f"on_{node[0]}")(ways, *node[1:])
            i += 1
        return ways

    def repeat(self, nodes: list[tuple], ways: list) -> tuple[list, list, list]:
        """Lays out a loop's body: ways out of its end, by break, by continue."""
        self.held.append(([], []))
        out = self.seq(nodes, ways)
        return out, *self.held.pop()

    def on_if(self, ways, at, cond, inner, other):
        text = self.source.slice(*cond)
        n = self.header("decision", text + "?", at, f"Is it so that {condition_in_words(text)}?", ways)
        return self.seq(inner, [(n, "yes")]) + (self.seq(other, [(n, "no")]) if other else [(n, "no")])

    def on_while(self, ways, at, cond, inner):
        text = self.source.slice(*cond)
        forever = text in ("true", "1")
        n = self.header("loop", "repeat forever" if forever else text + "?", at, "Repeat until something leaves the loop." if forever else f"Repeat while {condition_in_words(text)}.", ways)
        out, left, back = self.repeat(inner, [(n, "" if forever else "yes")])
        self.join(out + back, n)
        return ([] if forever else [(n, "no")]) + left

    def on_for(self, ways, at, init, cond, step, inner):
        if init[0] < init[1]:
            ways = self.action([init], ways)
        text, after = self.source.slice(*cond), self.source.slice(*step)
        start = f" It starts with `{self.source.slice(*init)}`." if init[0] < init[1] else ""
        n = self.header("loop", text + "?" if text else "repeat forever", at, (f"Repeat while {condition_in_words(text)}." if text else "Repeat until something leaves the loop.") + start, ways)
        out, left, back = self.repeat(inner, [(n, "yes")])
        out += back
        if after and out:
            out = self.action([step], out)
        self.join(out, n)
        return ([(n, "no")] if text else []) + left

    def on_each(self, ways, at, name, items, inner):
        v, every = self.source.slice(*name), self.source.slice(*items)
        n = self.header("loop", f"next {v} in {every}?", at, f"For each {v} in {every}, repeat.", ways)
        out, left, back = self.repeat(inner, [(n, "yes")])
        self.join(out + back, n)
        return [(n, "no more"), *left]

    def on_do(self, ways, at, cond, inner):
        first, text = len(self.boxes), self.source.slice(*cond)
        out, left, back = self.repeat(inner, ways)
        n = self.header("loop", text + "?", at, f"Do that again while {condition_in_words(text)}.", out + back)
        self.join([(n, "yes")], min(first, n))
        return [(n, "no"), *left]

    def on_switch(self, ways, at, value, cases):
        text = self.source.slice(*value)
        n = self.header("switch", f"which {text}?", at, f"Which case is {text}?", ways)
        self.held.append(([], None))
        out, falling, labels = [], [], []
        for label, inner, falls in cases:
            labels.append(label)
            if not inner and falls:
                continue  # shares the next case's statements
            end = self.seq(inner, [(n, ", ".join(labels)), *falling])
            labels, falling = [], end if falls else []
            out += [] if falls else end
        left, _ = self.held.pop()
        rest = [(n, ", ".join(labels))] if labels else []
        return out + rest + falling + left + ([] if any(c[0] == "default" for c in cases) else [(n, "other")])

    def on_try(self, ways, at, inner, caught, final):
        n = self.header("try", "try", at, "Try what follows; an error leads to its own steps.", ways)
        out = self.seq(inner, [(n, "")])
        for c in caught:
            out += self.seq(c, [(n, "if error")])
        return self.seq(final, out) if final else out

    def on_break(self, ways, a, b):
        if not self.held:
            return self.action([(a, b)], ways)
        self.held[-1][0].extend(ways)
        return []

    def on_continue(self, ways, a, b):
        loop = next((back for _, back in reversed(self.held) if back is not None), None)
        if loop is None:
            return self.action([(a, b)], ways)
        loop.extend(ways)
        return []

    def _leave(self, kind, ways, a, b, sentence, label):
        n = self.box(kind, self.source.slice(a, b), None, sentence, *self.lines(a, b))
        self.join(ways, n)
        self.ends.append((n, label))
        return []

    def on_return(self, ways, a, b):
        value = self.source.slice(a + 1, b).rstrip(";").strip()
        return self._leave("return", ways, a, b, f"Give back {value}." if value else "Stop here.", "")

    def on_throw(self, ways, a, b):
        return self._leave("stop", ways, a, b, f"Stop with {self.source.slice(a + 1, b).rstrip(';').strip()}.", "error")


class _Found(_Braces):
    """Also where bodies are: (definition, first line, offset of the body's first token)."""

    def __init__(self, facts: Facts, text: str):
        super().__init__(facts, text)
        self.bodies: list[tuple[dict, int, int]] = []

    def open(self, name, kind, first, body, end):
        super().open(name, kind, first, body, end)
        if body is not None and kind in ("function", "method"):
            self.bodies.append((self.facts.definitions[-1], self.tokens[first].line, self.tokens[body].at))


def parameter_names(source: _Statements, body: int) -> list[str]:
    """The names in the parentheses before a body: a script's before type and default, others' last word."""
    close = next((k for k in range(body - 1, max(-1, body - 200), -1) if source.said(k) in (")", ";", "}", "{")), -1)
    if source.said(close) != ")":
        return [source.said(body - 2)] if source.said(body - 1) == "=>" else []
    a = next((o for o, c in source.match.items() if c == close), close) + 1
    out = []
    while a < close:
        b = source.find(a, close, ",")
        words = [source.said(k) for k in range(a, source.find(a, b, ":", "=") if source.script else source.find(a, b, "[")) if source.tokens[k].kind == "name"]
        out += [words[0] if source.script and words[0] not in ("public", "private", "readonly") else words[-1]] if words and words != ["void"] else []
        a = b + 1
    return out


def brace_charts(text: str, language: str) -> Iterator[tuple[str, BraceChart]]:
    """(qualified name, chart) of every function with a body; one nested too deep to be read has none."""
    facts = Facts("", language)
    reader = _Found(facts, text)
    reader.run()
    source = _Statements(text, language)
    for made, line, body in reader.bodies:
        first = source.at[body]
        last = source.closing(first) if source.said(first) == "{" else source.expression_end(first)
        try:
            chart = BraceChart(source, made["name"], parameter_names(source, first), line, first, last)
        except RecursionError:
            continue
        yield made["id"].split("::", 1)[1], chart
