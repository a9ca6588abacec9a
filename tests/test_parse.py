import os
import subprocess

import pytest

from tessera.functions.parse import parse
from tessera.operators import code
from tessera.sources import tree

PY = b'''"""Orders."""
import logging
import numpy as np
from .models import Order as O
from .utils import *

log = logging.getLogger(__name__)


@cached
def place(items, when=now()):
    """Place it. Twice."""
    def inner(x):
        return slugify(x)
    order = O(items)
    order.total()
    return inner(order)


class Shop:
    def open(self):
        self.close()

    def close(self):
        np.zeros(3)
'''
TS = b'''import def, { get as fetchIt, type Thing } from "./api.js";
import * as path from 'path';
const { one, two: deux } = require("./lib");
/** Says hello. */
export function hello(name: string): void { fetchIt(name); path.join(`a${one(1)}`); }
export const run = async (x) => { deux(x); new Shop(x).open(); };
class Shop extends Base {
  state = 1;
  handle = (e) => this.open(e);
  open(e: Event) { if (e) { return this.close(e); } }
  close(e) {}
}
export interface Thing { a: number }
export { hello } from "./again";
'''
JAVA = b'''package com.shop;
import com.shop.model.Order;
import static com.shop.util.Text.trim;
import java.util.*;
/** Orders. */
public class OrderService implements Service {
  private final OrderRepo repo = new OrderRepo();
  @Override
  public Order place(Order o) throws Bad { return repo.save(trim(o)); }
  public Order place(Order o, int n) { for (int i = 0; i < n; i++) { place(o); } return o; }
  enum State { A, B }
}
'''
CSRC = b'''#include "stats.h"
#include <stdio.h>
/* A pair. */
typedef struct { int a; } Pair;
struct Node { struct Node *next; };
int later(int x);
static int twice(int x) { return x * 2; }
int main(void) {
  Pair p;
  if (twice(2) > 3) { printf("%d", p.cb(twice(1))); }
  return 0;
}
'''


def by(facts, kind, *names):
    return [tuple(x[n] for n in names) for x in facts[kind]]


def test_python():
    f = parse("shop/services.py", "python", PY)
    assert f["doc"] == "Orders." and not f["has_errors"]
    assert by(f, "definitions", "id", "kind", "start_line") == [("shop/services.py::place", "function", 10), ("shop/services.py::place.inner", "function", 13), ("shop/services.py::Shop", "class", 20), ("shop/services.py::Shop.open", "method", 21), ("shop/services.py::Shop.close", "method", 24)]
    assert by(f, "bindings", "local", "source", "imported") == [("logging", "logging", "*"), ("np", "numpy", "*"), ("O", ".models", "Order"), ("*", ".utils", "*")]
    calls = by(f, "calls", "caller", "name", "receiver")
    assert ("shop/services.py", "now", None) in calls and ("shop/services.py::place.inner", "slugify", None) in calls
    assert ("shop/services.py::place", "total", "order") in calls and ("shop/services.py::Shop.open", "close", "self") in calls


def test_broken_python_still_yields_what_is_right():
    f = parse("a.py", "python", b"def good():\n    return 1\n\ndef bad(:\n    x = (\n\nclass Fine:\n    pass\n")
    assert f["has_errors"] and [d["name"] for d in f["definitions"]] == ["good", "Fine"]
    assert parse("a.py", "python", None)["definitions"] == []


def test_typescript():
    f = parse("src/index.ts", "typescript", TS)
    assert by(f, "definitions", "name", "kind") == [("hello", "function"), ("run", "function"), ("Shop", "class"), ("handle", "method"), ("open", "method"), ("close", "method"), ("Thing", "interface")]
    assert f["definitions"][0]["doc"] == "Says hello."
    assert by(f, "imports", "source") == [("./api.js",), ("path",), ("./lib",), ("./again",)]
    assert {("fetchIt", "./api.js", "get"), ("path", "path", "*"), ("one", "./lib", "one"), ("deux", "./lib", "two")} <= set(by(f, "bindings", "local", "source", "imported"))
    calls = by(f, "calls", "caller", "name", "receiver")
    assert ("src/index.ts::hello", "fetchIt", None) in calls and ("src/index.ts::hello", "join", "path") in calls
    assert ("src/index.ts::Shop.open", "close", "this") in calls and ("src/index.ts::run", "Shop", None) in calls


def test_java():
    f = parse("com/shop/OrderService.java", "java", JAVA)
    assert by(f, "definitions", "id", "kind") == [("com/shop/OrderService.java::OrderService", "class"), ("com/shop/OrderService.java::OrderService.place", "method"), ("com/shop/OrderService.java::OrderService.place#2", "method"), ("com/shop/OrderService.java::OrderService.State", "enum")]
    assert by(f, "imports", "source") == [("com.shop.model.Order",), ("com.shop.util.Text.trim",), ("java.util.*",)]
    assert ("com/shop/OrderService.java::OrderService.place", "save", "repo", "OrderRepo") in by(f, "calls", "caller", "name", "receiver", "receiver_type")


def test_c():
    f = parse("main.c", "c", CSRC)
    assert by(f, "definitions", "name", "kind") == [("Pair", "record"), ("Node", "record"), ("twice", "function"), ("main", "function")]
    assert by(f, "imports", "source") == [("stats.h",)]
    assert ("main.c::main", "cb", "p") in by(f, "calls", "caller", "name", "receiver") and ("main.c::main", "twice", None) in by(f, "calls", "caller", "name", "receiver")


@pytest.fixture
def project(tmp_path):
    files = {
        "shop/__init__.py": b"", "shop/services.py": PY, "shop/models.py": b"class Order:\n    def total(self):\n        return add(1)\n\ndef add(x):\n    return x\n", "shop/utils.py": b"def slugify(x):\n    return x\n",
        "web/api.ts": b"export function get(n) { return n; }\n", "web/index.ts": b"import { get } from './api.js';\nexport function go() { get(1); }\n", "node_modules/x/y.js": b"function no() {}",
        "c/main.c": b'#include "stats.h"\nint main(void) { return mean(1); }\n', "c/stats.h": b"int mean(int x);\n", "c/stats.c": b'#include "stats.h"\nint mean(int x) { return x; }\n', "notes.txt": b"no",
    }
    for name, data in files.items():
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_bytes(data)
    return tmp_path


def test_tree_reads_hidden_looking_names(spark, project):
    found = tree.read_tree(spark, str(project)).collect()
    assert [r.path for r in sorted(found, key=lambda r: r.path)] == ["c/main.c", "c/stats.c", "c/stats.h", "shop/__init__.py", "shop/models.py", "shop/services.py", "shop/utils.py", "web/api.ts", "web/index.ts"]
    assert all(len(r.hash) == 64 and r.error is None for r in found)


def test_graph_of_a_tree(spark, project):
    nodes, edges = code.build_graph(tree.read_tree(spark, str(project)))
    e = {(r.source, r.target, r.type): r.confidence for r in edges.collect()}
    assert ("shop/services.py", "shop/models.py", "imports") in e and ("web/index.ts", "web/api.ts", "imports") in e and ("c/main.c", "c/stats.h", "imports") in e
    assert e[("shop/services.py::place", "shop/models.py::Order", "calls")] == "high"
    assert e[("shop/services.py::place", "shop/services.py::place.inner", "calls")] == "high"
    assert e[("shop/services.py::place.inner", "shop/utils.py::slugify", "calls")] == "high"
    assert e[("shop/services.py::Shop.open", "shop/services.py::Shop.close", "calls")] == "high"
    assert e[("shop/services.py::place", "shop/models.py::Order.total", "calls")] == "medium"
    assert e[("web/index.ts::go", "web/api.ts::get", "calls")] == "high"
    assert e[("c/main.c::main", "c/stats.c::mean", "calls")] in ("high", "medium")
    assert not any(t.endswith("zeros") for _, t, _ in e)
    externals = {r.id: r.external_imports for r in nodes.where("type = 'file'").collect()}
    assert externals["shop/services.py"] == ["logging", "numpy"]
    again = {(r.source, r.target, r.type): r.confidence for r in code.build_graph(tree.read_tree(spark, str(project)))[1].collect()}
    assert again == e


def test_zip_refuses_what_is_unsafe(spark):
    import io
    import zipfile

    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name in ("top/a.py", "top/../../evil.py", "top/.env", "top/node_modules/b.js", "top/readme.md", "top/c.bin"):
            z.writestr(name, "x = 1")
    got = {r.path: r.skipped for r in tree.read_zips(spark.createDataFrame([("z", data.getvalue()), ("bad", b"no")], "path string, content binary")).collect()}
    assert got["a.py"] is None and got["readme.md"] is None and got["../../evil.py"] == "unsafe file names"
    assert got[".env"] == "secret files" and got["node_modules/b.js"] == "library or hidden folders" and got["c.bin"] == "not code" and got[None] == "not a zip file"


def test_diff(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-c", "user.name=x", "-c", "user.email=x@y", *a], cwd=tmp_path, check=True, capture_output=True, text=True).stdout
    run("init", "-q")
    (tmp_path / "a.py").write_text("one\ntwo\nthree\n")
    (tmp_path / "b.py").write_text("same " * 40 + "\n")
    (tmp_path / "d.py").write_text("gone\n")
    run("add", "-A")
    run("commit", "-qm", "x")
    (tmp_path / "a.py").write_text("one\n2\nthree\nfour\n")
    run("mv", "b.py", "c.py")
    run("rm", "-q", "d.py")
    (tmp_path / "n.py").write_text("new\n")
    run("add", "-A")
    text = run("diff", "--cached", "-M", "--unified=0")
    got = tree.parse_diff(spark.createDataFrame([(1, text)], "id int, text string")).collect()
    assert sorted((r.path, r.status, r.new_start, r.new_len) for r in got if r.new_start is not None) == [("a.py", "modified", 2, 1), ("a.py", "modified", 4, 1), ("d.py", "deleted", 0, 0), ("n.py", "added", 1, 1)]
    assert [(r.old_path, r.path) for r in got if r.status == "renamed"] == [("b.py", "c.py")]


def test_tools(spark, project):
    from tessera.tools import Project

    p = Project(tree.read_tree(spark, str(project)))
    assert [r.id for r in p.find_callers("slugify").collect()] == ["shop/services.py::place.inner"]
    assert "shop/models.py::Order" in [r.id for r in p.find_callees("place").collect()]
    assert p.search_code("slugify text").first().id == "shop/utils.py::slugify"
    assert [r.text for r in p.read_function("slugify").collect()] == ["def slugify(x):", "    return x"]
    assert p.read_file("models.py", 1, 2).count() == 2
    assert p.get_flowchart("inner").count() == 3
    assert p.project_overview().first().functions == 11
    assert [r.term for r in p.glossary("what does this loop do").collect()] == ["loop"]
    assert {r.id for r in p.find_construct("return", "inner").collect()} == {"shop/services.py::place.inner"}
    assert p.call("no_such_tool") is None and p.call("find_callers", name="nothing").count() == 0
    changed, affected = p.impact(spark.createDataFrame([("shop/utils.py", 2, 1)], "path string, new_start int, new_len int"))
    assert [r.id for r in changed.collect()] == ["shop/utils.py::slugify"]
    assert {(r.id, r.depth) for r in affected.collect()} == {("shop/services.py::place.inner", 1), ("shop/services.py::place", 2)}
